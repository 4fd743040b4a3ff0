"""Pairs of near-duplicate sequences, found by an LSH forest and verified exactly.

Every distinct text gets TREES signatures of DEPTH minhash values. In each tree the texts are sorted by signature; those
that share the longest prefixes stand next to each other and are the candidates. Two values must be shared; where a region of
the order that shares them is crowded (common leaders, runs of one letter), the prefix is lengthened until the region
is not: the depth adapts region by region. The texts of crowded regions are sorted in MORE_TREES further trees, in which all DEPTH values
must be shared; these regions are compared whole, whatever their size. A sketch of two bits of each value thins the candidates
where they are found; the rest are verified on their whole sets of substrings.

A pair of similarity 0.70 shares two values in at least one of 12 trees with probability 0.9997. If its regions are crowded, it shares
four values in one of 12 + 30 trees unless it is among 1 in 100,000 pairs, so the probability is 0.9997 there too.
Equal texts are one node of the forest: copies are expanded from the pairs of their representatives at the very end.

No task compares an unbounded region: one that shares all values and is larger than BLOCK rows is handed on in blocks, and each pair of
blocks is compared by itself. Which pairs come out doesn't depend on where the batches of rows end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.session import cut_lineage, release

TREES, DEPTH = 12, 4
#: Further trees for the texts of crowded regions: 1 - (1 - 0.7^4)^30 of the pairs of similarity 0.70 that lengthened prefixes miss.
MORE_TREES = 30
#: Values whose sketches may differ: 3.9 standard deviations above the mean at similarity 0.70.
MOST_DIFFERENT = 22
#: Rows of a region that are compared at once; beyond it the prefix is lengthened.
CROWD = 512
#: Rows that are looked at together, and rows of a block of a region that can't be split by further values.
HELD, BLOCK = 100_000, 4096  # HELD must be more than twice BLOCK
#: For planning only: the share of texts whose signatures show which regions are too large for a task, and how large that is.
PLAN_SHARE, HOT_ROWS, MOST_HOT = 64, 2_000_000, 100_000

_rng = np.random.default_rng(20240607)
_XOR = _rng.integers(0, 2**32, TREES * DEPTH, dtype=np.uint32)
_MUL = _rng.integers(0, 2**31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_MORE_XOR = _rng.integers(0, 2**32, MORE_TREES * DEPTH, dtype=np.uint32)
_MORE_MUL = _rng.integers(0, 2**31, MORE_TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def concatenated(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and the offsets of each."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def shingle_codes(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """5-bit codes of all k-letter substrings (k <= 12) and the offsets of each text's. Texts shorter than k have none."""
    c = (data.astype(np.uint64) - np.uint64(65)) & np.uint64(31)
    n = max(0, len(c) - k + 1)
    codes = np.zeros(n, np.uint64)
    for j in range(k):
        codes = (codes << np.uint64(5)) | c[j : n + j]
    many = np.maximum(np.diff(offsets) - k + 1, 0)
    keep = np.ones(len(data), bool)
    for j in range(1, k):
        at = offsets[1:] - j
        keep[at[at >= offsets[:-1]]] = False
    return codes[keep[:n]], np.concatenate([[0], np.cumsum(many)])


def signatures(texts: pa.Array, k: int, xor: np.ndarray = _XOR, mul: np.ndarray = _MUL) -> np.ndarray:
    """(number of texts, TREES * DEPTH) minhash values, one for each function; all texts must have at least k letters."""
    data, offsets = concatenated(texts)
    codes, bounds = shingle_codes(data, offsets, k)
    codes ^= codes >> np.uint64(31)
    codes *= np.uint64(0x9E3779B97F4A7C15)
    codes ^= codes >> np.uint64(29)
    x = (codes >> np.uint64(16)).astype(np.uint32)
    out = np.empty((len(texts), len(xor)), np.uint32)
    a = 0
    while a < len(texts):  # stretches that fit the cache
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + 24_000, "right")) - 1)
        part, starts = x[bounds[a] : bounds[b]], bounds[a:b] - bounds[a]
        for f in range(len(xor)):
            out[a:b, f] = np.minimum.reduceat((part ^ xor[f]) * mul[f], starts)
        a = b
    return out


def _sketch(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of each value, packed into two words."""
    bits = ((values >> np.uint32(7)) & np.uint32(3)).astype(np.uint64)
    half = bits.shape[1] // 2
    pack = lambda part: (part << (np.arange(part.shape[1], dtype=np.uint64) * np.uint64(2))).sum(axis=1, dtype=np.uint64)
    return pack(bits[:, :half]).view(np.int64), pack(bits[:, half:]).view(np.int64)


def hot_prefixes(hot: list[tuple[int, int]]) -> list[np.ndarray]:
    """The sorted prefixes of each tree whose regions are too large for one task."""
    return [np.sort(np.array([h for tree, h in hot if tree == t], np.int64)) for t in range(TREES)]


def _tree_rows(b: pa.RecordBatch, k: int, hot: list[np.ndarray]) -> pa.RecordBatch:
    values = signatures(b.column(1), k)
    n = len(values)
    s1, s2 = _sketch(values)
    v = values.reshape(n, TREES, DEPTH).astype(np.uint64)
    near = ((v[:, :, 0] << np.uint64(32)) | v[:, :, 1]).view(np.int64)
    deep = ((v[:, :, 2] << np.uint64(32)) | v[:, :, 3]).view(np.int64)
    # Rows of a region too large for one task are spread by their deeper values, the others by the prefix alone.
    spread = np.zeros((n, TREES), np.int64)
    for t, mine in enumerate(hot):
        if len(mine):
            at = np.minimum(np.searchsorted(mine, near[:, t]), len(mine) - 1)
            spread[:, t] = np.where(mine[at] == near[:, t], deep[:, t] >> 32 | 1 << 32, 0)  # never 0 where it is spread
    return _batch(b.column(0), near, spread, deep, s1, s2)


def _batch(rep: pa.Array, near: np.ndarray, spread: np.ndarray, deep: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> pa.RecordBatch:
    n, trees = near.shape
    tree = np.tile(np.arange(trees, dtype=np.int32), (n, 1))
    cols = [tree.ravel(), near.ravel(), spread.ravel(), deep.ravel(), np.repeat(rep.to_numpy(), trees), np.repeat(s1, trees), np.repeat(s2, trees)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["tree", "near", "spread", "deep", "rep", "s1", "s2"])


def _more_rows(b: pa.RecordBatch, k: int) -> pa.RecordBatch:
    """Rows of the further trees: all values of a tree make one key, so a region is never split."""
    values = signatures(b.column(1), k, _MORE_XOR, _MORE_MUL)
    v = values.reshape(len(values), MORE_TREES, DEPTH).astype(np.uint64)
    key = np.zeros(v.shape[:2], np.uint64)
    for j in range(DEPTH):
        key = (key ^ v[:, :, j]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    none = np.zeros(key.shape, np.int64)
    return _batch(b.column(0), key.view(np.int64), none, none, *_sketch(values[:, : TREES * DEPTH]))


_TREE_SCHEMA = "tree int, near long, spread long, deep long, rep long, s1 long, s2 long"


def forest_rows(texts: DataFrame, k: int, hot: list[np.ndarray], more: bool = False) -> DataFrame:
    """Rows of the first trees, or of the further ones."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                yield _more_rows(b.slice(at, 2000), k) if more else _tree_rows(b.slice(at, 2000), k, hot)

    return texts.select("rep", "seq").mapInArrow(kernel, _TREE_SCHEMA)


def _runs(*cols: np.ndarray) -> np.ndarray:
    """Where a new run of equal rows begins."""
    new = np.ones(len(cols[0]), bool)
    if len(new) > 1:
        new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
    return new


def _compared(at: np.ndarray, step: int, s1: np.ndarray, s2: np.ndarray, other: np.ndarray | None = None) -> np.ndarray:
    """Those places whose sketch is near that of the place ``step`` further on (or of ``other``)."""
    to = at + step if other is None else other
    fives = np.int64(0x5555555555555555)
    off = np.zeros(len(at), np.int64)
    for s in (s1, s2):
        x = s[at] ^ s[to]
        off += np.bitwise_count((x | (x >> 1)) & fives)
    return off <= MOST_DIFFERENT


def neighbours(tree, near, torn, deep, rep, s1, s2, crowd: int = CROWD, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates among rows in signature order (regions of two shared values, of three or four where crowded), and the rows of
    regions that share all values and have more than ``block`` rows, which are not compared here.

    torn: not 0 for rows of a region of which others are elsewhere, 2 if even some that share the third value are; it counts as crowded.
    Rows of regions that are crowded come as pairs with themselves.
    """
    region = np.cumsum(_runs(tree, near))
    sizes = np.bincount(region)
    split = (sizes > crowd) | (np.bincount(region, weights=torn != 0) > 0)
    alone = np.unique(rep[split[region]])
    crowded = split[region]
    for values, level in ((deep >> 32, 2), (deep, 3)):
        if not crowded.any():
            break
        finer = np.cumsum(_runs(region, np.where(crowded, values, 0)))
        region, sizes = finer, np.bincount(finer)
        crowded &= ((sizes > crowd) | (np.bincount(region, weights=torn >= level) > 0))[region]
    big = crowded & (sizes[region] > block)
    found = []
    alive = np.flatnonzero((sizes[region] > 1) & ~big)
    step = 1
    while len(alive):
        alive = alive[alive + step < len(region)]
        alive = alive[region[alive] == region[alive + step]]
        hit = alive[_compared(alive, step, s1, s2)]
        found.append(np.stack([rep[hit], rep[hit + step]]))
        step += 1
    found.append(np.stack([alone, alone]))
    both = np.sort(np.concatenate(found, axis=1), axis=0)
    both = np.unique(both, axis=1) if both.size else both
    return both[0], both[1], np.flatnonzero(big)


_PAIR_SCHEMA = "a long, b long, tree int, near long, deep long, block int, s1 long, s2 long"
_PAIR_NAMES = ["a", "b", "tree", "near", "deep", "block", "s1", "s2"]


def candidates(rows: DataFrame, whole: bool = False) -> DataFrame:
    """Distinct candidate pairs ``a`` < ``b``, and ``a`` = ``b`` for texts of regions that were split. The result is written.

    whole: rows of the further trees, whose regions are never split: a crowded one is compared whole, in blocks if it is large.
    """
    held_rows, block = HELD, BLOCK  # as the driver has them
    crowd = BLOCK if whole else CROWD

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        count: dict[tuple, int] = {}  # rows handed on of each region that is in sight

        def emit(cols):
            a, b, big = neighbours(*cols, crowd, block)
            tree, near, _, deep, rep, s1, s2 = (c[big] for c in cols)
            none = np.zeros(len(a), np.int64)
            keys = list(zip(tree.tolist(), near.tolist(), deep.tolist()))
            place = np.zeros(len(big), np.int64)
            for i, key in enumerate(keys):
                place[i] = count.get(key, 0) // block
                count[key] = count.get(key, 0) + 1
            for key in list(count)[:-1]:  # rows come in order: a region that was left doesn't come back
                del count[key]
            cols = [np.r_[a, rep], np.r_[b, rep], np.r_[none, tree].astype(np.int32), np.r_[none, near], np.r_[none, deep], np.r_[none - 1, place].astype(np.int32), np.r_[none, s1], np.r_[none, s2]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=_PAIR_NAMES)

        for batch in batches:
            new = [c.to_numpy() for c in batch.columns]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            while held is not None and len(held[0]) >= held_rows:
                cut = int(np.flatnonzero(_runs(held[0], held[1]))[-1])  # the last region may go on in the next batch
                if not cut:  # it fills the buffer: it is crowded and cut between its third values, or its fourth
                    for level, values in ((1, held[3] >> 32), (2, held[3])):
                        if not cut:
                            held[2] = np.full(len(held[2]), level, np.int64)
                            cut = int(np.flatnonzero(_runs(values))[-1])
                # If it has one only, it is handed on in blocks; so many rows stay that the rest is known for such a region too.
                cut = cut or len(held[0]) - block - 1
                yield emit([c[:cut] for c in held])
                held = [c[cut:] for c in held]
        if held is not None and len(held[0]):
            yield emit(held)

    order = rows.repartition("tree", "near", "spread").sortWithinPartitions("tree", "near", "deep")
    found = cut_lineage(order.select("tree", "near", "spread", "deep", "rep", "s1", "s2").mapInArrow(kernel, _PAIR_SCHEMA))
    pairs = found.where("block < 0").select("a", "b")
    blocks = found.where("block >= 0")
    if not blocks.isEmpty():
        pairs = pairs.unionByName(_block_pairs(blocks.withColumnRenamed("a", "rep").drop("b")))
    out = cut_lineage(pairs.distinct())
    release(found)
    return out


def _block_pairs(rows: DataFrame) -> DataFrame:
    """Candidates of regions too large to be compared at once: every pair of their blocks is compared by itself."""
    region = ["tree", "near", "deep"]
    last = rows.groupBy(*region).agg(F.max("block").alias("last"))
    met = rows.join(last, region).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    met = met.select(*region, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "s1", "s2")

    def kernel(key, t):
        i = key[3].as_py()
        block, rep, s1, s2 = (t.column(c).to_numpy() for c in ("block", "rep", "s1", "s2"))
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == key[4].as_py())
        same = i == key[4].as_py()
        out = []
        for n, x in enumerate(left):
            others = right[n + 1 :] if same else right
            hit = others[_compared(np.full(len(others), x), 0, s1, s2, others)]
            out.append(np.stack([np.full(len(hit), rep[x]), rep[hit]]))
        both = np.sort(np.concatenate(out, axis=1), axis=0) if out else np.zeros((2, 0), np.int64)
        return pa.table({"a": both[0], "b": both[1]})

    return met.groupBy(*region, "i", "j").applyInArrow(kernel, "a long, b long").where("a < b")


def shared_shares(left: pa.Array, right: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of texts: substrings in both, and in either."""
    sets = []
    for texts in (left, right):
        codes, bounds = shingle_codes(*concatenated(texts), k)
        row = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(bounds))
        key = np.sort((row << np.uint64(5 * k)) | codes)
        sets.append(key[_runs(key)] if len(key) else key)
    every = np.sort(np.concatenate(sets), kind="stable")
    common = every[1:][every[1:] == every[:-1]]
    count = lambda keys: np.bincount((keys >> np.uint64(5 * k)).astype(np.int64), minlength=len(left))
    both = count(common)
    return both, count(sets[0]) + count(sets[1]) - both


def verified(pairs: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """Pairs whose similarity reaches the threshold, with the number of copies on each side."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):  # bounded memory; row numbers fit the bits above a code
                b = batch.slice(at, 500)
                both, either = shared_shares(b.column("seq_a"), b.column("seq_b"), k)
                ok = both + 1e-9 >= threshold * either
                kept = b.select(["a", "b", "n_a", "n_b"]).filter(pa.array(ok))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(both[ok] / either[ok])], names=["a", "b", "n_a", "n_b", "similarity"])

    side = lambda x: texts.select(F.col("rep").alias(x), F.col("seq").alias(f"seq_{x}"), F.col("n").alias(f"n_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(kernel, "a long, b long, n_a long, n_b long, similarity double")


def distinct_texts(df: DataFrame, id_col: str, text: str, k: int) -> DataFrame:
    """``seq``, ``rep`` (smallest id), ``n``, ``digest``: the distinct texts of at least k letters, written once. Counted within partitions before the shuffle."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("seq")).where((F.length("seq") >= k) & F.col("id").isNotNull())
    return cut_lineage(rows.groupBy("seq").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).withColumn("digest", F.md5("seq")))


def near_pairs(df: DataFrame, id_col: str, text: str, *, k: int = 9, threshold: float = 0.70, texts: DataFrame | None = None) -> DataFrame:
    """Pairs of representatives of distinct texts: ``a`` < ``b``, ``n_a``, ``n_b`` (copies of each), ``similarity``.

    text: a column of letters A-Z only. Similarity is the share of the union of two texts' sets of distinct k-letter
    substrings that both have. The smallest id represents equal texts. Null texts, texts of fewer than k letters and rows of null
    id are left out; ids must be unique. An empty table gives no rows. Texts are compared whole. The result is written.
    texts: what distinct_texts() gave for the same columns, if it is there already.
    """
    own = texts is None
    texts = distinct_texts(df, id_col, text, k) if texts is None else texts
    plan = forest_rows(texts.where(F.pmod(F.xxhash64("rep"), F.lit(PLAN_SHARE)) == 0), k, hot_prefixes([]))
    crowds = plan.groupBy("tree", "near").count().where(F.col("count") * PLAN_SHARE > HOT_ROWS).orderBy(F.desc("count")).limit(MOST_HOT)
    hot = hot_prefixes([(r.tree, r.near) for r in crowds.collect()])
    found = candidates(forest_rows(texts, k, hot))
    pairs = found.where("a < b")
    crowded = found.where("a = b").select(F.col("a").alias("rep"))
    if not crowded.isEmpty():
        more = candidates(forest_rows(texts.join(crowded, "rep"), k, hot, more=True), whole=True).where("a < b")
        pairs = pairs.unionByName(more).distinct()
    out = cut_lineage(verified(pairs, texts, k, threshold))
    release(found, *([texts] if own else []))
    return out


def expand_copies(pairs: DataFrame, df: DataFrame, id_col: str, text: str, *, k: int = 9, texts: DataFrame | None = None) -> DataFrame:
    """All pairs of ids (``id_a`` < ``id_b``) behind the pairs of representatives; copies of one text are not paired with each other."""
    texts = distinct_texts(df, id_col, text, k) if texts is None else texts
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.md5(f"`{text}`").alias("digest")).where("id is not null")
    members = cut_lineage(rows.join(texts.where("n > 1").select("digest", "rep"), "digest").select("rep", "id"))
    release(texts)
    for side in "ab":
        alone = pairs.where(f"n_{side} = 1").withColumn(f"id_{side}", F.col(side))
        shared = pairs.where(f"n_{side} > 1").join(members.select(F.col("rep").alias(side), F.col("id").alias(f"id_{side}")), side)
        pairs = alone.unionByName(shared)
    return pairs.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
