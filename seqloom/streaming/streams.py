"""Unbounded folders of sequence files: each new file's records appear in a micro-batch, with the readers' own grammar.

Streams are append-only; records have no event time. Back pressure is the number of files taken in a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql import functions as F

from seqloom.operators.rejects import parse_lines
from seqloom.sources.readers import _fasta_columns


def _lines(spark: SparkSession, path: str, sep: str, files_a_batch: int) -> DataFrame:
    return spark.readStream.format("text").option("lineSep", sep).option("maxFilesPerTrigger", files_a_batch).load(path)


def stream_fasta(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    """name, sequence of every file that arrives in a folder."""
    return _fasta_columns(_lines(spark, path, "\n>", files_a_batch))


def stream_lines(spark: SparkSession, path: str, fmt: str, files_a_batch: int = 100) -> DataFrame:
    """Lines of 'pileup' or 'gff' files as they arrive, typed or with a reason (see seqloom.operators.rejects)."""
    lines = _lines(spark, path, "\n", files_a_batch).where("value != ''").select(F.xxhash64("value").alias("line_id"), F.col("value").alias("line"))
    return parse_lines(lines, fmt)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands every batch to ``each``, what is there now and then stops. The checkpoint folder makes a restart go on where it ended."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
