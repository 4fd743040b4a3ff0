"""Sizes of texts in tokens of a public tokenizer, whose vocabulary is read from a file and never copied into the library.

The driver alone must see the file; it is shipped to the executors with the job.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.session import spread

#: Byte-level BPE ranks; another file's path may be given instead.
VOCABULARY = os.path.join(os.environ.get("SEQLOOM_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")
#: Fixed value: the vocabulary's own split into words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ship(spark: SparkSession, vocabulary: str) -> str:
    """Sends the file along to every executor; its name there."""
    spark.sparkContext.addFile(vocabulary)
    return os.path.basename(vocabulary)


def n_tokens(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of a text; 0 for an empty one, null for null. Whole texts are encoded."""
    name = ship(SparkSession.active(), vocabulary)

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        e = encoding(SparkFiles.get(name))
        return pd.Series([None if t is None else len(e.encode_ordinary(t)) for t in texts], dtype="Int64")

    return count(text)


def sized(df: DataFrame, id_col: str, text: str, source: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``id``, ``source`` (null: ''), ``n_tokens`` of the rows with a text and an id."""
    rows = spread(df.select(F.col(f"`{id_col}`"), F.col(f"`{source}`"), F.col(f"`{text}`")))
    rows = rows.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("source"), F.col(f"`{text}`").alias("text"))
    return rows.where("id is not null and text is not null").select("id", "source", n_tokens(F.col("text"), vocabulary).alias("n_tokens"))
