import random

import pytest

from seqloom.operators.intervals import merge_intervals


def plain(rows):
    out = []
    for key in {r[:2] for r in rows if None not in r}:
        periods = []
        for s, e in sorted((r[2], r[3]) for r in rows if r[:2] == key and None not in r and r[2] < r[3]):
            if periods and s <= periods[-1][1]:
                periods[-1][1] = max(e, periods[-1][1])
            else:
                periods.append([s, e])
        out += [(*key, "period", a, b) for a, b in periods] + [(*key, "gap", x[1], y[0]) for x, y in zip(periods, periods[1:])]
    return sorted(out)


SCHEMA = "a string, b string, s long, e long, kind string, from_pos int, __w int"


@pytest.mark.parametrize("hot_rows", [1_000_000, 5])
@pytest.mark.parametrize("seed", [1, 2])
def test_random(spark, hot_rows, seed):
    rnd = random.Random(seed)
    rows = []
    for _ in range(400):
        s = rnd.choice([rnd.randint(-500, 500), 10**16 + rnd.randint(0, 50)])
        rows.append((rnd.choice(["x", "x", "y", "Y", None]), rnd.choice(["f", "g", None]), rnd.choice([s, s, s, None]), rnd.choice([s + rnd.randint(-3, 12), None, s + 1, s]), None, 0, 0))
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(r) for r in merge_intervals(df, ["a", "b"], "s", "e", hot_rows=hot_rows).collect())
    assert got == plain([r[:4] for r in rows])


@pytest.mark.parametrize("rows", [[], [("x", "f", 1, 5)] * 3, [("x", "f", 1, 5), ("x", "f", 5, 9)], [("x", "f", 1, 100), ("x", "f", 5, 9), ("x", "f", 101, 102)], [("x", "f", 3, 3)]])
@pytest.mark.parametrize("hot_rows", [1_000_000, 1])
def test_edges(spark, rows, hot_rows):
    df = spark.createDataFrame([(*r, None, 0, 0) for r in rows], SCHEMA)
    assert sorted(tuple(r) for r in merge_intervals(df, ["a", "b"], "s", "e", hot_rows=hot_rows).collect()) == plain(rows)
