import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from seqloom.functions.letters import letters, name_fields
from seqloom.llm.copies import Trie, collapse, copies


def plain(rows):
    classes = defaultdict(list)
    for g, i, t in rows:
        if None not in (g, i, t) and t:
            classes[g, t].append(i)
    return Counter((g, min(v), len(v)) for (g, _), v in classes.items()), Counter((g, min(v), i) for (g, _), v in classes.items() for i in v if i != min(v))


@pytest.mark.parametrize("fit", [64 << 20, 300])
def test_against_grouping(spark, fit):
    rnd = random.Random(5)
    stem = "ACGTTGCA" * 40
    pool = ["".join(rnd.choice("AC") for _ in range(rnd.randint(1, 12))) for _ in range(60)] + [stem + "A", stem + "C", stem, stem[:8], stem[:24], stem[:25], "", None, "Z" * 300_000]
    rows = [(rnd.choice(["a", "a", "b", None]), rnd.choice([i, i, 7, None]), rnd.choice(pool)) for i in range(700)] + [("a", 1000 + i, "HOT") for i in range(500)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "src string, id long, canon string, digest string, n int, bucket int").repartition(3)
    ones, more = plain(rows)
    assert Counter(tuple(r) for r in collapse(df, "id", F.col("canon"), F.col("src"), fit_bytes=fit).select("g", "first_id", "n_copies").collect()) == ones
    assert Counter(tuple(r) for r in copies(df, "id", F.col("canon"), F.col("src"), fit_bytes=fit).collect()) == more
    assert collapse(df.limit(0), "id", F.col("canon")).count() == 0 and copies(df.limit(0), "id", F.col("canon")).count() == 0


def test_trie():
    t = Trie(True)
    for i, k in enumerate(["A" * 24, "A" * 48, "A" * 47, "A" * 24, "B", "A" * 48 + "C", "A" * 48]):
        t.add(k, 1, i)
    assert {e[0]: (e[1], e[2], sorted(e[3])) for e in t.ends()} == {"A" * 24: (2, 0, [0, 3]), "A" * 48: (2, 1, [1, 6]), "A" * 47: (1, 2, [2]), "B": (1, 4, [4]), "A" * 48 + "C": (1, 5, [5])}


def test_canonical(spark):
    df = spark.createDataFrame([("a|B c|", "1 ac-gt\r\n*é"), (" b-C||A", "ACGT"), (None, None)], "n string, s string")
    got = [tuple(r) for r in df.select(name_fields(F.col("n")), letters(F.col("s"))).collect()]
    assert got == [("|A|BC", "ACGT"), ("|A|BC", "ACGT"), (None, None)]
