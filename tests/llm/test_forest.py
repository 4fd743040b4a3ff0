import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqloom.llm import forest
from seqloom.llm.components import components
from seqloom.llm.forest import expand_copies, near_pairs, shared_shares, shingle_codes, concatenated


def grams(t, k=9):
    return {t[i : i + k] for i in range(len(t) - k + 1)}


def plain(rows, threshold=0.7):
    rows = [(i, t, grams(t)) for i, t in rows if i is not None and t is not None and len(t) >= 9]
    return {(min(i, j), max(i, j)) for n, (i, a, x) in enumerate(rows) for j, b, y in rows[n + 1 :] if a != b and len(x & y) + 1e-9 >= threshold * len(x | y)}


def mutated(rnd, t, n):
    t = list(t)
    for _ in range(n):
        i = rnd.randrange(len(t))
        t[i : i + 1] = rnd.choice([[], [rnd.choice("ACGT")], [t[i], rnd.choice("ACGT")]])
    return "".join(t)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    out = []
    for _ in range(40):
        stem = "".join(rnd.choice("ACGT") for _ in range(rnd.choice([40, 200, 400])))
        family = [stem] + [mutated(rnd, stem, rnd.choice([1, 2, 5])) for _ in range(3)]
        out += family + [rnd.choice(family)]
    out += ["ACGTACGTA", "ACGTACGT", "", None, "N" * 50, "N" * 60, "ACGT" * 5000, "ACGT" * 5000 + "A"]
    out += [out[0]] * 30  # a hot copy
    return [(i * 3, t) for i, t in enumerate(out)] + [(None, out[0])]


def test_pairs_with_copies(spark, rows):
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "id long, letters string, a int, rep string").repartition(4)
    got = expand_copies(near_pairs(df, "id", "letters"), df, "id", "letters").collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == plain(rows)
    none = df.limit(0)
    assert expand_copies(near_pairs(none, "id", "letters"), none, "id", "letters").count() == 0


def test_crowded_and_hot_regions(spark, monkeypatch):
    """Regions of the order that outgrow their bounds are compared by longer prefixes; recall stays high."""
    rnd = random.Random(2)
    leader = "".join(rnd.choice("ACGT") for _ in range(60))
    rows = []
    for _ in range(150):
        t = leader + "".join(rnd.choice("ACGT") for _ in range(150))
        rows += [t, mutated(rnd, t, 2)]
    rows = list(enumerate(rows))
    want = plain(rows)
    monkeypatch.setattr(forest, "CROWD", 8)
    monkeypatch.setattr(forest, "HOT_ROWS", 60)
    monkeypatch.setattr(forest, "PLAN_SHARE", 2)
    df = spark.createDataFrame(rows, "id long, letters string")
    got = {(r.a, r.b) for r in near_pairs(df, "id", "letters").collect()}
    assert got <= want and len(got) >= 0.98 * len(want)


def test_crowded_pairs_at_the_threshold(spark, monkeypatch):
    """Pairs of similarity near 0.70 are found in crowded regions as they are in others."""
    rnd = random.Random(5)
    leader = "".join(rnd.choice("ACGT") for _ in range(200))
    rows = []
    for _ in range(200):
        t = leader + "".join(rnd.choice("ACGT") for _ in range(200))
        rows += [t, t[:-67] + "".join(rnd.choice("ACGT") for _ in range(67))]
    rows = list(enumerate(rows))
    want = plain(rows)
    assert len(want) >= 150
    monkeypatch.setattr(forest, "CROWD", 1)
    df = spark.createDataFrame(rows, "id long, letters string")
    got = {(r.a, r.b) for r in near_pairs(df, "id", "letters").collect()}
    assert got <= want and len(got) >= 0.995 * len(want)


def family_rows():
    """A third of all texts are of one family whose signatures are mostly equal; the rest share a leader."""
    rnd = random.Random(9)
    base = "".join(rnd.choice("ACGT") for _ in range(2000))
    leader = "".join(rnd.choice("ACGT") for _ in range(60))
    rows = [base[:i] + "T" + base[i + 1 :] for i in range(5, 1900, 13)] + [base]
    for _ in range(100):
        t = leader + "".join(rnd.choice("ACGT") for _ in range(120))
        rows += [t, mutated(rnd, t, 2)]
    return list(enumerate(sorted(set(rows))))


def test_large_regions_in_blocks_whatever_the_batches(spark, monkeypatch):
    rows = family_rows()
    want = plain(rows)
    df = spark.createDataFrame(rows, "id long, letters string").repartition(3)
    monkeypatch.setattr(forest, "CROWD", 6)
    monkeypatch.setattr(forest, "BLOCK", 10)
    got = []
    for held in (100_000, 97, 25):
        monkeypatch.setattr(forest, "HELD", held)
        for arrow in ("10000", "17"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", arrow)
            got.append({(r.a, r.b) for r in near_pairs(df, "id", "letters").collect()})
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(x == got[0] for x in got) and got[0] <= want and len(got[0]) >= 0.995 * len(want)


def test_kernels():
    texts = pa.array(["ACGTACGTACG", "ACG", "", "ACGTACGTA", "ACGTACGTAT"])
    codes, bounds = shingle_codes(*concatenated(texts), 9)
    assert list(np.diff(bounds)) == [3, 0, 0, 1, 2] and codes[0] == codes[3] == codes[4]
    both, either = shared_shares(texts, texts.take(pa.array([3, 1, 2, 4, 4])), 9)
    assert list(both) == [1, 0, 0, 1, 2] and list(either) == [3, 0, 0, 2, 2]
    assert list(shared_shares(texts.slice(3), texts.slice(3), 9)[0]) == [1, 2]


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(50)] + [(None, 1), (5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
