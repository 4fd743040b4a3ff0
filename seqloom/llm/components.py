"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.session import cut_lineage, release


def _shape(e: DataFrame) -> tuple:
    """The edges with their lineage cut, and a fingerprint of them as a set."""
    e = cut_lineage(e)
    return e, tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node``, ``component`` (the smallest node of its component) for every node of an edge. Self-loops and repeated edges do no harm.

    Each step is two aggregations to a minimum, combined before they are shuffled, and a join on the node, whose hot keys
    the adaptive skew join splits. The edges between steps are checkpointed in the shared folder; the driver only sees
    their count and hash. Rows with a null end are left out.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"`{a}` is not null and `{b}` is not null and u != v").distinct()
    e, seen = _shape(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u != v")
        new = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        last = e
        e, now = _shape(new)
        release(last)  # what came of it is written
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
