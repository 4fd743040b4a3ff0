"""Oversized sequences cut into overlapping pieces at assembly gaps, by recursive bisection.

A stretch longer than the limit minus the overlap is cut at the strongest boundary near its midpoint, the longest run of N in
its middle half (of equal ones the nearest to the midpoint), else at the gap nearest to the midpoint anywhere in it, else
at the midpoint itself; both halves are treated the same way. At the end each piece but the first is extended by
the overlap to its left. The work on an item needs nothing but the item: the pass has no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from seqloom.functions.letters import letters

#: Letters of pieces in one Arrow batch.
BATCH_LETTERS = 16 << 20


def find_gaps(text: bytes, gap_min: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of at least gap_min N."""
    n = np.concatenate([[False], np.frombuffer(text, np.uint8) == ord("N"), [False]])
    edges = np.flatnonzero(n[1:] != n[:-1])
    a, b = edges[::2], edges[1::2]
    long = b - a >= gap_min
    return a[long], b[long]


def bisect(size: int, gaps: tuple[np.ndarray, np.ndarray], limit: int, overlap: int) -> list[tuple[int, bool]]:
    """Cut positions in order, each with whether it lies in a gap. No stretch between two cuts exceeds limit - overlap."""
    most = limit - overlap
    starts, ends = gaps
    middles = (starts + ends) // 2
    cuts: list[tuple[int, bool]] = []
    stack = [(0, size)]
    while stack:
        lo, hi = stack.pop()
        if hi - lo <= most:
            continue
        mid = (lo + hi) // 2
        # A cut lies inside its gap, more than the overlap from either end, so that every piece has more than its overlap.
        a, b = np.searchsorted(middles, [lo + overlap + 1, hi - overlap])
        cut, at_gap = mid, False
        if a < b:
            m = middles[a:b]
            away = np.abs(m - mid)
            near = away <= (hi - lo) // 4
            if near.any():
                strength = (ends - starts)[a:b]
                k = np.lexsort((away, -np.where(near, strength, -1)))[0]
            else:
                k = int(np.argmin(away))
            cut, at_gap = int(m[k]), True
        cuts.append((cut, at_gap))
        stack += [(lo, cut), (cut, hi)]
    return sorted(cuts)


def split_items(df: DataFrame, id_col: str, sequence: str, *, limit: int, overlap: int, gap_min: int, group: Column | None = None) -> DataFrame:
    """The pieces of every item with more than ``limit`` letters: ``src``, ``item_id``, ``piece_no`` (from 0), ``start_pos``, ``end_pos``
    (half-open, in letters of the item), ``overlap`` (letters shared with the piece before), ``at_gap`` (whether its left cut lies in a gap), ``piece``.

    Only letters count and only they are in the pieces. Pieces have at most ``limit`` letters; consecutive ones overlap by
    exactly ``overlap`` letters. Items of at most ``limit`` letters, and null or letterless ones, give no rows; pass them on as they
    are. Rows repeated under one id are cut each. A null id is kept. An empty table gives no rows. Texts are cut whole however long they are.
    """
    if not 0 <= overlap < limit - overlap - 1:
        raise ValueError("the overlap must be less than half of the limit")
    kind = df.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("src", T.StringType()), T.StructField("item_id", kind), T.StructField("piece_no", T.IntegerType()), T.StructField("start_pos", T.LongType()),
        T.StructField("end_pos", T.LongType()), T.StructField("overlap", T.IntegerType()), T.StructField("at_gap", T.BooleanType()), T.StructField("piece", T.StringType()),
    ])
    arrow = to_arrow_schema(schema)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0

        def emit():
            cols = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

        for b in batches:
            for src, key, text in zip(*b.columns):
                text = text.as_py()
                if len(text) <= limit:
                    continue
                raw = text.encode()
                cuts = bisect(len(raw), find_gaps(raw, gap_min), limit, overlap)
                edges = [(0, False), *cuts]
                for i, ((a, at_gap), z) in enumerate(zip(edges, [*(c for c, _ in cuts), len(raw)])):
                    left = overlap if i else 0
                    out.append((src.as_py(), key.as_py(), i, a - left, z, left, at_gap, text[a - left : z]))
                    held += z - a + left
                    if held > BATCH_LETTERS:
                        yield emit()
                        out.clear()
                        held = 0
        if out:
            yield emit()

    src = F.lit("") if group is None else group
    # The raw text is at least as long as its letters: most rows never reach Python.
    long = df.select(src.alias("src"), F.col(f"`{id_col}`").alias("item_id"), F.col(f"`{sequence}`").alias("text")).where(F.length("text") > limit)
    return long.select("src", "item_id", letters(F.col("text")).alias("text")).where(F.length("text") > limit).mapInArrow(kernel, schema)
