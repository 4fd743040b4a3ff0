"""Continuous periods and gaps of interval sets, per entity.

Overlapping intervals are merged by Spark's own session windows: every interval opens a session at its start whose
duration is the interval's own length, so the engine's session merge is the interval merge, with a partial
aggregation before the shuffle. Touching periods are joined afterwards, gaps come from the end that precedes a period's start.

Hot entities (one may hold a third of all rows) are cut into blocks at approximate quantiles of their start positions,
merged block by block in parallel, and stitched through one summary row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.session import cut_lineage

#: Most entities that are cut into blocks, and most blocks of one. Both bound what is broadcast (a few MB); an entity
#: beyond the first bound holds less than 1/HOT_ENTITIES of the rows.
HOT_ENTITIES = 512
MAX_BLOCKS = 1024


def _micros(n: Column) -> Column:
    """An interval of n microseconds, exact for n < 10**18."""
    zero = F.lit(0)
    return F.make_interval(zero, zero, zero, zero, zero, zero, (n.cast("decimal(18,0)") * F.lit("0.000001").cast("decimal(7,6)")).cast("decimal(18,6)"))


def merge_intervals(
    df: DataFrame,
    entity: list[str],
    start: str = "start_pos",
    end: str = "end_pos",
    *,
    hot_rows: int = 1_000_000,
) -> DataFrame:
    """Periods and gaps of half-open intervals ``[start, end)``.

    Returns the entity columns and ``kind`` ('period' or 'gap'), ``from_pos``, ``to_pos``.

    A row counts if every entity column, start and end are not null and start < end; all others are ignored. Entities are
    compared exactly. Periods are maximal: overlapping, nested, repeated and touching intervals join. A gap lies
    between two consecutive periods of an entity. An empty table gives no rows. Other columns of df, whatever their
    names, are not read. Positions are whole numbers of magnitude below 10**17.

    hot_rows: entities with more rows are cut into blocks of about that many rows.
    """
    keys = [f"__k{i}" for i in range(len(entity))]
    iv = df.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(entity, keys)), F.col(f"`{start}`").cast("long").alias("__s"), F.col(f"`{end}`").cast("long").alias("__e"))
    for k in keys:
        iv = iv.where(F.col(k).isNotNull())
    iv = iv.where(F.col("__s") < F.col("__e"))

    # The driver learns which entities are hot, at most HOT_ENTITIES of them. Without any, nothing is cut and nothing stitched.
    counts = iv.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot_rows)
    hot_keys = counts.orderBy(F.desc("__n"), *keys).limit(HOT_ENTITIES)
    known = hot_keys.collect()
    if not known:
        return _named(_opened(_sessions(iv.withColumn("__b", F.lit(-1)), keys), keys), keys, entity)
    hot_keys = df.sparkSession.createDataFrame(known, hot_keys.schema)
    # Quantiles of MAX_BLOCKS steps serve every hot entity; a smaller one takes every q-th of them.
    steps = F.array(*(F.lit(i / MAX_BLOCKS) for i in range(1, MAX_BLOCKS)))
    hot = (
        iv.join(F.broadcast(hot_keys), keys)
        .groupBy(*keys)
        .agg(F.percentile_approx("__s", steps, F.lit(20000)).alias("__q"), F.first("__n").alias("__n"))
        .select(
            *keys,
            F.array_distinct(
                F.filter("__q", lambda x, i: (i + 1) % F.greatest(F.lit(1), F.floor(F.lit(MAX_BLOCKS) * hot_rows / F.col("__n"))) == 0)
            ).alias("__cuts"),
        )
    )
    blocked = iv.join(F.broadcast(hot), keys, "left").select(
        *keys, "__s", "__e",
        F.when(F.col("__cuts").isNull(), F.lit(-1)).otherwise(F.size(F.filter("__cuts", lambda c: c <= F.col("__s")))).alias("__b"),
    )

    # One pass of the merge serves both kinds; what follows reads its result twice.
    sessions = cut_lineage(_sessions(blocked, keys))
    one = _opened(sessions.where(F.col("__b") == -1), keys)

    # Stitching: what earlier blocks of the entity reach. One row per block of a hot entity.
    split = sessions.where(F.col("__b") >= 0)
    ends = split.groupBy(*keys, "__b").agg(F.max("__e").alias("__end"))
    whole, block = Window.partitionBy(*keys), Window.partitionBy(*keys, "__b")
    carried = ends.select(
        *keys, "__b",
        F.max("__end").over(whole.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)).alias("__reach"),
        F.max("__end").over(whole).alias("__all_end"),
    )
    split = split.join(carried, [*keys, "__b"]).withColumn("__prev", F.greatest("__prev", "__reach"))
    many = split.where(F.col("__prev").isNull() | (F.col("__s") > F.col("__prev"))).withColumn("__next_prev", F.lead("__prev").over(block.orderBy("__s")))
    firsts = many.groupBy(*keys, "__b").agg(F.min("__s").alias("__s"), F.min("__prev").alias("__first_prev"))
    later = firsts.select(*keys, "__b", F.lead("__first_prev").over(whole.orderBy("__b")).alias("__later"))
    many = many.join(later, [*keys, "__b"]).withColumn("__to", F.coalesce("__next_prev", "__later", "__all_end")).select(*keys, "__s", "__prev", "__to")
    return _named(one.unionByName(many), keys, entity)


def _sessions(blocked: DataFrame, keys: list[str]) -> DataFrame:
    """Merged intervals of each entity and block, with the furthest end before each and the block's own end."""
    merged = (
        blocked.groupBy(*keys, "__b", F.session_window(F.timestamp_micros("__s"), _micros(F.col("__e") - F.col("__s"))).alias("__w"))
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(*keys, "__b", F.unix_micros("__w.start").alias("__s"), F.unix_micros("__w.end").alias("__e"))
    )
    block = Window.partitionBy(*keys, "__b")
    before = block.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    return merged.select("*", F.max("__e").over(before).alias("__prev"), F.max("__e").over(block).alias("__block_end"))


def _opened(sessions: DataFrame, keys: list[str]) -> DataFrame:
    """Rows at which a period starts, with the end of the period before it and its own, in entities of one block."""
    block = Window.partitionBy(*keys, "__b")
    opened = sessions.where(F.col("__prev").isNull() | (F.col("__s") > F.col("__prev"))).withColumn("__next_prev", F.lead("__prev").over(block.orderBy("__s")))
    return opened.withColumn("__to", F.coalesce("__next_prev", "__block_end")).select(*keys, "__s", "__prev", "__to")


def _named(periods: DataFrame, keys: list[str], entity: list[str]) -> DataFrame:
    piece = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), F.col(a).alias("from_pos"), F.col(b).alias("to_pos"))
    return (
        periods.select(*keys, F.explode(F.array(piece("period", "__s", "__to"), piece("gap", "__prev", "__s"))).alias("__x"))
        .where(F.col("__x.from_pos").isNotNull())
        .select(*(F.col(k).alias(c) for c, k in zip(entity, keys)), "__x.kind", "__x.from_pos", "__x.to_pos")
    )
