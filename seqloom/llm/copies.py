"""Copies that differ only in layout, collapsed by recursive radix partitioning of their canonical bytes.

1. Each input partition counts its copies in a trie before anything is shuffled, so a text that makes up a third of all
   rows reaches its bucket as one row per partition and not as so many rows. The partial counts are written; what follows reads them.
2. A histogram of the canonical texts' first bytes finds buckets of more bytes than fit a task; those alone are split by
   further bytes, twice as deep each time, until each fits or holds one text only. The prefixes to be split are tables, joined
   to the texts; the driver learns of none.
3. Each bucket's rows meet in one task, sorted by bucket, and are counted in a trie of their own with a terminal counter
   and the smallest id at each end.
4. The ids of copies never travel with the texts: the partial lists are joined to their class by digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from seqloom.session import cut_lineage, release

FIRST_DEPTH = 8
#: Canonical bytes after which a partition's trie is handed on and begun anew.
FLUSH_BYTES = 48 << 20
CHUNK = 24


class Trie:
    """A burst trie over CHUNK bytes a step. An end holds the rest of its key, a counter, the smallest id and the ids."""

    def __init__(self, keep_ids: bool):
        self.root: dict = {}
        self.keep = keep_ids
        self.bytes = 0

    def add(self, key: str, n: int, first, ids=None) -> None:
        node, at = self.root, 0
        while True:
            chunk = key[at : at + CHUNK]
            at += CHUNK
            slot = node.get(chunk)
            if slot is None:
                node[chunk] = [key, n, first, [first] if self.keep else None]
                self.bytes += len(key) + 120
                return
            if type(slot) is dict:
                node = slot
            elif slot[0] == key:
                slot[1] += n
                if first < slot[2]:
                    slot[2] = first
                if self.keep:
                    slot[3].append(first)
                    self.bytes += 32
                return
            else:  # two keys share all chunks so far: the older end moves one level down
                node[chunk] = {slot[0][at : at + CHUNK]: slot}
                node = node[chunk]

    def ends(self) -> Iterator[list]:
        stack = [self.root]
        while stack:
            for slot in stack.pop().values():
                if type(slot) is dict:
                    stack.append(slot)
                else:
                    yield slot


def _partials(rows: DataFrame, ids: bool) -> DataFrame:
    """(g, canon, n, first[, ids]) counted within each input partition."""
    kind = rows.schema["id"].dataType
    fields = [T.StructField("g", T.StringType()), T.StructField("canon", T.StringType()), T.StructField("n", T.LongType()), T.StructField("first", kind)]
    schema = T.StructType(fields + ([T.StructField("ids", T.ArrayType(kind))] if ids else []))
    arrow = to_arrow_schema(schema)

    def emit(tries: dict[str, Trie]) -> Iterator[pa.RecordBatch]:
        for g, trie in tries.items():
            ends = list(trie.ends())
            for a in range(0, len(ends), 20_000):
                part = ends[a : a + 20_000]
                cols = [[g] * len(part), [e[0] for e in part], [e[1] for e in part], [e[2] for e in part]] + ([[e[3] for e in part]] if ids else [])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, Trie] = {}
        for b in batches:
            for g, canon, key in zip(*(c.to_pylist() for c in b.columns)):
                if g not in tries:
                    tries[g] = Trie(ids)
                tries[g].add(canon, 1, key)
            if sum(t.bytes for t in tries.values()) > FLUSH_BYTES:
                yield from emit(tries)
                tries = {}
        yield from emit(tries)

    return rows.select("g", "canon", "id").mapInArrow(kernel, schema)


def _split_points(partial: DataFrame, fit_bytes: int) -> dict[int, DataFrame]:
    """By depth, a table of the (g, p) whose buckets must be split by further bytes."""
    out: dict[int, DataFrame] = {}
    depth = FIRST_DEPTH
    left = partial.select("g", "canon")
    while True:
        h = F.xxhash64("canon")
        hist = left.groupBy("g", F.substring("canon", 1, depth).alias("p")).agg(F.sum(F.length("canon") + 32).alias("bytes"), F.min(h).alias("a"), F.max(h).alias("b"))
        over = cut_lineage(hist.where((F.col("bytes") > fit_bytes) & (F.col("a") != F.col("b"))).select("g", "p"))
        if over.isEmpty():
            release(over)
            return out
        out[depth] = over
        left = left.withColumn("p", F.substring("canon", 1, depth)).join(over, ["g", "p"], "left_semi").drop("p")
        depth *= 2


def _bucketed(rows: DataFrame, points: dict[int, DataFrame]) -> DataFrame:
    """Adds the bucket: the shortest prefix that needs no split."""
    bucket: Column = F.substring("canon", 1, FIRST_DEPTH)
    for depth, known in sorted(points.items()):
        over = known.withColumn("over", F.lit(True))
        rows = rows.withColumn("p", F.substring("canon", 1, depth)).join(over, ["g", "p"], "left").drop("p").withColumnRenamed("over", f"over{depth}")
        bucket = F.when(F.col(f"over{depth}"), F.substring("canon", 1, depth * 2)).otherwise(bucket)
    return rows.withColumn("bucket", bucket).drop(*(f"over{d}" for d in points))


def collapse(df: DataFrame, id_col: str, canonical: Column, group: Column | None = None, *, fit_bytes: int = 64 << 20) -> DataFrame:
    """One row for each distinct canonical text of a group: ``g``, ``first_id``, ``n_copies``, ``digest``.

    canonical: the text without its layout. Rows whose canonical text is null or empty, or whose id is null, are left out.
    group: rows of different groups never match (default: one group, '').  first_id is the smallest id, compared as its
    type is; n_copies counts all rows of the class, the first among them. Rows repeated under one id count each.
    Very long texts are compared whole. An empty table gives no rows. fit_bytes: canonical bytes that one task counts at a time.
    """
    return _collapsed(cut_lineage(_partials(_rows(df, id_col, canonical, group), ids=False)), fit_bytes)


def _collapsed(partial: DataFrame, fit_bytes: int) -> DataFrame:
    points = _split_points(partial, fit_bytes)
    kind = partial.schema["first"].dataType
    schema = T.StructType([T.StructField("g", T.StringType()), T.StructField("first_id", kind), T.StructField("n_copies", T.LongType()), T.StructField("canon", T.StringType())])
    arrow = to_arrow_schema(schema)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, trie = None, Trie(False)

        def emit():
            ends = list(trie.ends())
            for a in range(0, len(ends), 20_000):
                part = ends[a : a + 20_000]
                cols = [[now[0]] * len(part), [e[2] for e in part], [e[1] for e in part], [e[0] for e in part]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

        for b in batches:
            for g, bucket, canon, n, first in zip(*(c.to_pylist() for c in b.columns)):
                if (g, bucket) != now:  # rows come sorted by bucket: the last one's trie is complete
                    if now is not None:
                        yield from emit()
                    now, trie = (g, bucket), Trie(False)
                trie.add(canon, n, first)
        if now is not None:
            yield from emit()

    met = _bucketed(partial.select("g", "canon", "n", "first"), points).select("g", "bucket", "canon", "n", "first").repartition("g", "bucket").sortWithinPartitions("g", "bucket")
    return met.mapInArrow(kernel, schema).select("g", "first_id", "n_copies", F.md5("canon").alias("digest"))


def copies(df: DataFrame, id_col: str, canonical: Column, group: Column | None = None, *, fit_bytes: int = 64 << 20) -> DataFrame:
    """Every copy with the first of its class: ``g``, ``first_id``, ``copy_id``. See collapse() for what counts.

    An id that occurs on several equal rows is listed once for each further row unless it is the first id itself.
    """
    partial = cut_lineage(_partials(_rows(df, id_col, canonical, group), ids=True).withColumn("digest", F.md5("canon")))
    classes = _collapsed(partial, fit_bytes).where("n_copies > 1")
    lists = partial.select("g", "digest", "ids")
    return (
        lists.join(classes, ["g", "digest"])
        .select("g", "first_id", F.explode("ids").alias("copy_id"))
        .where(F.col("copy_id") != F.col("first_id"))
    )


def _rows(df: DataFrame, id_col: str, canonical: Column, group: Column | None) -> DataFrame:
    g = F.lit("") if group is None else group
    return df.select(g.alias("g"), canonical.alias("canon"), F.col(f"`{id_col}`").alias("id")).where("canon is not null and canon != '' and id is not null and g is not null")
