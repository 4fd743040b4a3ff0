"""Sources mixed to target shares of all tokens, by entropy balancing.

The rates nearest to one copy of every text (in relative entropy) that meet each source's token target are exponential in the
text's tokens: rate = min(max_repeats, exp(tilt * tokens / mean tokens)), one tilt a source. Newton's method finds the tilts
from the dual; each step is one distributed sum over a histogram of (source, tokens). Rates become whole copies by
systematic rounding along the histogram, whose cumulated error stays below one copy a source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.tokens import VOCABULARY, sized
from seqloom.session import cut_lineage

#: Cells into which the texts of one source and size are spread, so that no size gathers in one task: so many at least, and one more for so many texts.
LEAST_CELLS, CELL_TEXTS = 16, 4_000_000
#: Newton's steps end when every source is as near to its goal; one that is still further off than ENOUGH after MOST_STEPS is an error.
MOST_STEPS, TOLERANCE, ENOUGH, FULL = 60, 1e-7, 1e-4, 1e9


def _case(values: dict[str, float]) -> Column:
    return F.create_map(*(x for s, v in values.items() for x in (F.lit(s), F.lit(float(v)))))[F.col("source")]


def rate(tilts: dict[str, float], means: dict[str, float], caps: dict[str, int]):
    """The rate of a row of ``source`` and ``n_tokens``."""
    return F.least(_case(caps), F.exp(F.least(F.lit(700.0), _case(tilts) * F.col("n_tokens") / _case(means))))


def plan_totals(have: dict[str, float], shares: dict[str, float], caps: dict[str, int], total: float | None = None) -> dict[str, float]:
    """Tokens that each source is to give. Sources without text leave their share to the others, in proportion.

    Without a total it is all tokens there are, or the most that every source can give its share of within its repeats.
    """
    able = {s: x for s, x in shares.items() if have.get(s, 0) > 0 and x > 0}
    if not able:
        return {}
    scale = sum(able.values())
    most = min(caps[s] * have[s] * scale / x for s, x in able.items())
    total = min(most, sum(have[s] for s in able)) if total is None else min(total, most)
    return {s: total * x / scale for s, x in able.items()}


def balance(hist: DataFrame, goals: dict[str, float], caps: dict[str, int], means: dict[str, float], have: dict[str, float]) -> dict[str, float]:
    """The tilt of each source in ``hist`` (source, n_tokens, n) for which its expected tokens meet the goal."""
    tilts, low, high = dict.fromkeys(goals, 0.0), dict.fromkeys(goals, -math.inf), dict.fromkeys(goals, math.inf)
    full = {s for s, goal in goals.items() if goal >= caps[s] * have[s] * (1 - TOLERANCE)}  # every text at its cap: no finite tilt
    tilts |= dict.fromkeys(full, FULL)
    open_ = set(goals) - full
    off_by: dict[str, float] = {}
    for _ in range(MOST_STEPS):
        if not open_:
            break
        r = rate(tilts, means, caps)
        gives = F.col("n") * r * F.col("n_tokens")
        slope = F.when(r < _case(caps), gives * F.col("n_tokens") / _case(means)).otherwise(0.0)
        for row in hist.where(F.col("source").isin(*open_)).groupBy("source").agg(F.sum(gives).alias("g"), F.sum(slope).alias("d")).collect():
            s, off = row.source, row.g - goals[row.source]
            off_by[s] = abs(off) / goals[s]
            if abs(off) <= TOLERANCE * goals[s]:
                open_.discard(s)
                continue
            (high if off > 0 else low)[s] = tilts[s]
            # Newton's step on the logarithm of the tokens, which is nearly linear in the tilt.
            step = tilts[s] - math.log(row.g / goals[s]) * row.g / row.d if row.d > 0 and row.g > 0 else math.nan
            if not low[s] < step < high[s]:  # outside of what is known to hold the root: halve, or widen an open side
                step = (low[s] + high[s]) / 2 if math.isfinite(low[s] + high[s]) else tilts[s] + (1.0 if off < 0 else -1.0) * max(1.0, abs(tilts[s]))
            if step == tilts[s]:
                open_.discard(s)
            tilts[s] = step
    if late := {s: x for s, x in off_by.items() if x > ENOUGH}:
        raise ArithmeticError(f"tilts didn't converge: {late}")
    return tilts


def mix(
    df: DataFrame, targets: dict[str, tuple[float, int]], id_col: str = "doc_id", text: str = "text", source: str = "source", *, total: float | None = None, vocabulary: str = VOCABULARY
) -> DataFrame:
    """``id_col``, ``source``, ``n_tokens``, ``copies`` (from 1 to the source's max_repeats) of every text that is used.

    targets: source -> (share of all tokens, max_repeats). Sources not named are not used; named ones without text get nothing and
    their share falls to the others (see plan_totals). Texts without tokens, and rows of null text, id or source, are not used. Equal texts
    under two ids are two texts. An empty table gives no rows. The result is deterministic.
    """
    # The filter on the sizes comes after they are written: before, it would be pushed below and every text encoded twice.
    named = df.where(F.col(f"`{source}`").isin(*targets))
    sizes = cut_lineage(sized(named, id_col, text, source, vocabulary)).where(F.col("n_tokens") > 0)
    cells = max(LEAST_CELLS, sizes.count() // CELL_TEXTS)
    sizes = sizes.withColumn("cell", F.pmod(F.xxhash64("id"), F.lit(cells)))
    hist = cut_lineage(sizes.groupBy("source", "n_tokens", "cell").agg(F.count(F.lit(1)).alias("n")))
    had = {r.source: r for r in hist.groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("t"), F.sum("n").alias("n")).collect()}
    caps = {s: max(0, m) for s, (_, m) in targets.items()}
    goals = plan_totals({s: r.t for s, r in had.items() if caps[s]}, {s: x for s, (x, _) in targets.items()}, caps, total)
    empty = sizes.limit(0).select(F.col("id").alias(id_col), "source", "n_tokens", F.lit(0).alias("copies"))
    if not goals:
        return empty
    means = {s: had[s].t / had[s].n for s in goals}
    tilts = balance(cut_lineage(hist.groupBy("source", "n_tokens").agg(F.sum("n").alias("n"))), goals, caps, means, {s: had[s].t for s in goals})

    order = Window.partitionBy("source").orderBy("n_tokens", "cell")
    r = rate(tilts, means, caps)
    cells = hist.where(F.col("source").isin(*goals)).withColumn("r", r).withColumn("before", F.coalesce(F.sum(F.col("n") * F.col("r")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    place = F.row_number().over(Window.partitionBy("source", "n_tokens", "cell").orderBy(F.xxhash64("id", F.lit(11)), "id"))
    at = lambda k: F.floor(F.round(F.col("before") + k * F.col("r") + 0.5, 6))
    # The cells grow with the data and are larger in memory than their files let the planner think: merged, never broadcast.
    chosen = sizes.withColumn("k", place).join(cells.drop("n").hint("merge"), ["source", "n_tokens", "cell"]).withColumn("copies", F.least(_case(caps), at(F.col("k")) - at(F.col("k") - 1)).cast("int"))
    return chosen.where("copies > 0").select(F.col("id").alias(id_col), "source", "n_tokens", "copies")


def share_report(spark, mixed: DataFrame, targets: dict[str, tuple[float, int]]) -> DataFrame:
    """Every target source: ``source``, ``target_share``, ``actual_share``, ``n_tokens``, ``n_texts``, ``most_copies``."""
    goal = spark.createDataFrame([(s, float(x)) for s, (x, _) in targets.items()], "source string, target_share double")
    got = mixed.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("n_tokens"), F.count(F.lit(1)).alias("n_texts"), F.max("copies").alias("most_copies"))
    got = goal.join(got, "source", "left").fillna(0, ["n_tokens", "n_texts", "most_copies"])
    return got.withColumn("actual_share", F.round(F.try_divide("n_tokens", F.sum("n_tokens").over(Window.partitionBy(F.lit(0)))), 6))
