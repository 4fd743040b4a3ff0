"""Texts packed into containers of fixed capacity, every window of containers mixed to target proportions.

Texts are spread over shards by the hash of their id, so each shard holds every source in its proportion however
skewed the sources are. Within a shard a deficit round-robin over one queue for each source fills window after window: a source
may add texts as long as its deficit, its share of all windows so far less what it has added, covers them. What a
window took is put into containers by best fit, largest first; containers with room stay open for the windows to come.
Deficits are carried from window to window and, by prefix sums over the shards' totals, from shard to shard. Shares and
deficits are a table joined to the texts, so there may be any number of sources.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.tokens import VOCABULARY, sized
from seqloom.session import cut_lineage

WINDOW_CONTAINERS, OPEN_CONTAINERS = 64, 512
#: Tokens of a shard (plus one for each text), which one task packs at a time.
SHARD_TOKENS = 8_000_000
#: The share of a source that has none of all tokens, such as one of empty texts only.
LEAST_SHARE = 1e-9
#: Shards whose totals are summed up before the sums of sums are.
SUM_BLOCK = 1024


def round_robin(queues: dict[str, list[int]], shares: dict[str, float], deficits: dict[str, float], window: int):
    """Windows as lists of (source, place in its queue). Sizes are the queues' values; every value is given out once."""
    at = dict.fromkeys(queues, 0)
    left = {s for s, q in queues.items() if q}
    deficit = {s: deficits.get(s, 0.0) for s in queues}
    while left:
        total = sum(shares.get(s, LEAST_SHARE) for s in left)
        took: list[tuple[str, int]] = []
        for s in sorted(left):
            deficit[s] += window * shares.get(s, LEAST_SHARE) / total
        for s in sorted(left):
            q = queues[s]
            while at[s] < len(q) and q[at[s]] <= deficit[s]:
                deficit[s] -= q[at[s]]
                took.append((s, at[s]))
                at[s] += 1
        left = {s for s in left if at[s] < len(queues[s])}
        if took:
            yield took


class Packer:
    """Best fit into open containers, kept sorted by free room."""

    def __init__(self, capacity: int):
        self.capacity, self.open, self.used = capacity, [], 0

    def put(self, size: int) -> tuple[int, int]:
        """The container and the place in it where an item of that size goes."""
        k = bisect_left(self.open, (size, -1))
        free, box = self.open.pop(k) if k < len(self.open) else (self.capacity, self._new())
        if free > size or size == 0:
            insort(self.open, (free - size, box))
        if len(self.open) > OPEN_CONTAINERS:
            self.open.pop(0)  # the fullest
        return box, self.capacity - free

    def _new(self) -> int:
        self.used += 1
        return self.used - 1


def sums_before(df: DataFrame, by: list[str], at: str, value: str, name: str) -> DataFrame:
    """df with ``name``: the sum of ``value`` over the rows of equal ``by`` whose ``at`` is less. Two levels, so no task sees more than
    SUM_BLOCK of the numbers or one number for each SUM_BLOCK of them.
    """
    block = F.floor(F.col(at) / SUM_BLOCK).alias("__block")
    totals = df.groupBy(*by, block).agg(F.sum(value).alias("__sum"))
    earlier = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "__block", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__earlier"))
    within = Window.partitionBy(*by, "__block").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("__block", block).withColumn("__within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return rows.join(totals, [*by, "__block"]).withColumn(name, F.col("__earlier") + F.col("__within")).drop("__block", "__earlier", "__within")


def _shares(totals: DataFrame, targets: dict[str, float]) -> DataFrame:
    """``source``, ``share`` of every source that has texts: its target, or its part of all tokens; they sum to one."""
    whole = totals.agg(F.sum("t")).first()[0] or 1  # one row
    given = totals.sparkSession.createDataFrame(list(targets.items()), "source string, target double")
    raw = totals.join(F.broadcast(given), "source", "left").select("source", F.greatest(F.coalesce("target", F.col("t") / whole), F.lit(LEAST_SHARE)).alias("share"))
    scale = raw.agg(F.sum("share")).first()[0] or 1.0
    return raw.withColumn("share", F.col("share") / scale)


def pack(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", *, capacity: int, targets: dict[str, float] | None = None,
    vocabulary: str = VOCABULARY, shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """``container_id``, ``window_id``, ``start_token`` (place in the container), ``id_col``, ``piece_no``, ``from_token`` (place in the text), ``n_tokens``, ``source``.

    Every text is packed once and whole unless it has more than ``capacity`` tokens: then into full pieces and a rest. An empty text is an
    item of no tokens. Rows of null text or id are left out; a null source is a source named ''. Rows repeated under
    one id are packed each. An empty table gives no rows. targets: shares of the sources in every window (default, and for sources
    without one: their share of all tokens); a source that runs out leaves its share to the others. window_id tells which window
    took an item; its container may have been opened by an earlier one. The result is deterministic.
    """
    sizes = cut_lineage(sized(df, id_col, text, source, vocabulary))
    totals = cut_lineage(sizes.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")))
    whole = totals.agg(F.coalesce(F.sum(F.col("t") + F.col("n")), F.lit(0))).first()[0]
    shards = max(1, -(-whole // shard_tokens))
    shares = cut_lineage(_shares(totals, targets or {}))

    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("n_tokens") - 1) / capacity)).cast("int")), lambda i: F.struct(i.alias("piece_no"), F.least(F.lit(capacity), F.col("n_tokens") - i * capacity).alias("n")))
    items = sizes.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).select("shard", "id", "source", F.explode(pieces).alias("p")).select("shard", "id", "source", "p.piece_no", F.col("p.n").cast("long").alias("n"))

    # What earlier shards gave each source beyond or below its share: prefix sums over one row for each shard and source.
    made = cut_lineage(items.groupBy("shard", "source").agg(F.sum("n").alias("t")))
    before = sums_before(made.groupBy("shard").agg(F.sum("t").alias("t")), [], "shard", "t", "before").select("shard", "before")
    had = sums_before(made, ["source"], "shard", "t", "had")
    deficit: Column = F.col("share") * F.col("before") - F.col("had")
    owed = had.join(before, "shard").join(shares, "source").select("shard", "source", "share", deficit.alias("deficit"))
    kind = sizes.schema["id"].dataType.simpleString()
    schema = f"container_id long, window_id long, start_token long, id {kind}, piece_no int, from_token long, n_tokens long, source string"

    def fill(key, f: pd.DataFrame) -> pd.DataFrame:
        shard = int(key[0])
        f = f.sort_values(["h", "id", "piece_no"], kind="stable").reset_index(drop=True)
        rows = {s: g.index.to_numpy() for s, g in f.groupby("source")}
        n = f["n"].to_numpy()
        queues = {s: n[i].tolist() for s, i in rows.items()}
        deficits, shares = dict(zip(f["source"], f["deficit"])), dict(zip(f["source"], f["share"]))
        packer, where = Packer(capacity), {}
        for window, took in enumerate(round_robin(queues, shares, deficits, capacity * WINDOW_CONTAINERS)):
            for size, i in sorted(((int(n[rows[s][k]]), int(rows[s][k])) for s, k in took), key=lambda x: (-x[0], x[1])):
                where[i] = (*packer.put(size), window)
        spots = [where[i] for i in range(len(f))]
        return pd.DataFrame({
            "container_id": [(shard << 32) + b for b, _, _ in spots], "window_id": [(shard << 32) + w for _, _, w in spots], "start_token": [a for _, a, _ in spots], "id": f["id"],
            "piece_no": f["piece_no"], "from_token": f["piece_no"].astype("int64") * capacity, "n_tokens": f["n"], "source": f["source"],
        })

    ready = items.withColumn("h", F.xxhash64("id", F.lit(7))).join(owed, ["shard", "source"])
    return ready.groupBy("shard").applyInPandas(fill, schema).withColumnRenamed("id", id_col)


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, items, tokens, fill (share of all room that is used), full_containers (none of whose room is unused)."""
    boxes = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    return boxes.agg(
        F.count(F.lit(1)).alias("n_containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_items"), F.coalesce(F.sum("t"), F.lit(0)).alias("n_tokens"),
        F.round(F.sum("t") / (F.count(F.lit(1)) * capacity), 6).alias("fill"), F.count_if(F.col("t") == capacity).alias("n_full"), F.max("t").alias("most"),
    )


def window_report(packed: DataFrame, targets: dict[str, float]) -> DataFrame:
    """How near every window keeps to the targets: ``source``, ``target_share``, ``actual_share`` (of all tokens), ``n_windows``, ``mean_off``.

    mean_off is the mean distance of the source's share of a window from what is due to it, over the windows in which it still had texts (up to
    the last of its shard that took one): its target among the targets of the sources that still had some. Sources without a target have
    their share of all tokens for one.
    """
    spark = packed.sparkSession
    by = packed.groupBy("window_id", "source").agg(F.sum("n_tokens").alias("t"))
    whole = by.groupBy("window_id").agg(F.sum("t").alias("all"))
    shard = F.shiftright("window_id", 32)
    last = by.groupBy(shard.alias("shard"), "source").agg(F.max("window_id").alias("last"))
    open_ = whole.where("all > 0").withColumn("shard", shard).join(last, "shard").where("window_id <= last")
    total = by.groupBy("source").agg(F.sum("t").alias("t"))
    sums = total.agg(F.sum("t").alias("all"))
    given = spark.createDataFrame(list(targets.items()), "source string, target double")
    goal = total.join(F.broadcast(given), "source", "left").crossJoin(F.broadcast(sums))  # one row
    goal = goal.select("source", F.coalesce("target", F.col("t") / F.col("all")).alias("target"), (F.col("t") / F.col("all")).alias("actual"))
    per = open_.join(by, ["window_id", "source"], "left").join(goal, "source")
    due = F.col("target") / F.sum("target").over(Window.partitionBy("window_id"))
    per = per.withColumn("off", F.abs(F.coalesce("t", F.lit(0)) / F.col("all") - due))
    return per.groupBy("source").agg(
        F.round(F.first("target"), 6).alias("target_share"), F.round(F.first("actual"), 6).alias("actual_share"), F.count(F.lit(1)).alias("n_windows"), F.round(F.avg("off"), 6).alias("mean_off"),
    )
