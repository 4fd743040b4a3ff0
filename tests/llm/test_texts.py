import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from seqloom.llm.mixing import mix, plan_totals, share_report
from seqloom.llm.packing import Packer, fill_report, pack, round_robin, sums_before, window_report
from seqloom.llm.tokens import encoding, n_tokens, VOCABULARY
from seqloom.llm.truncation import find_truncated, is_near, last_block, line_form, near, running_forms, tail, truncation_rates

COLUMNS = "doc_id long, text string, source string, n_tokens string, cell int, shard int, form string, key string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "f", "k") for r in rows], COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def texts(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    rows = [(i, " ".join(word() for _ in range(rnd.choice([1, 20, 60, 400]))), rnd.choice(["hot"] * 6 + ["small", "mid", "mid", None])) for i in range(400)]
    rows += [(900, "", "hot"), (901, None, "hot"), (None, "a b", "hot"), (902, "x y z " * 3000, "small"), (0, "again", "mid")]
    return rows


def test_tokens(spark, texts):
    got = {r.doc_id: r.n for r in frame(spark, [t for t in texts if t[0]]).select("doc_id", n_tokens(F.col("text")).alias("n")).collect()}
    e = encoding(VOCABULARY)
    assert got[900] == 0 and got[901] is None and all(got[i] == len(e.encode_ordinary(t)) for i, t, _ in texts if i and t)
    assert e.decode(e.encode_ordinary("Ein Tête-à-tête, 12 €!")) == "Ein Tête-à-tête, 12 €!"


@pytest.mark.parametrize("shard_tokens", [8_000_000, 9_000])
def test_packing(spark, texts, shard_tokens):
    e = encoding(VOCABULARY)
    packed = pack(frame(spark, texts), capacity=512, targets={"hot": 0.2, "small": 0.5, "absent": 0.3}, shard_tokens=shard_tokens).cache()
    rows = packed.collect()
    want = Counter((i, len(e.encode_ordinary(t))) for i, t, _ in texts if i is not None and t is not None)
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert sum(r.n_tokens for r in rows) == sum(n * c for (_, n), c in want.items())
    for (i, n), c in want.items():
        if i:
            pieces = sorted(by[i], key=lambda r: r.piece_no)
            assert sum(p.n_tokens for p in pieces) == n and (len(pieces) == 1 or n > 512) and [p.from_token for p in pieces] == [512 * k for k in range(len(pieces))] and all(p.n_tokens == 512 for p in pieces[:-1])
    boxes = defaultdict(list)
    for r in rows:
        boxes[r.container_id].append((r.start_token, r.n_tokens))
    for b in boxes.values():
        at = 0
        for start, n in sorted(b):
            assert start == at
            at += n
        assert at <= 512
    report = fill_report(packed, 512).first()
    assert report.n_items == len(rows) and report.most <= 512 and report.fill > (0.97 if shard_tokens > 10**6 else 0.85)
    assert sorted(rows) == sorted(pack(frame(spark, texts), capacity=512, targets={"hot": 0.2, "small": 0.5, "absent": 0.3}, shard_tokens=shard_tokens).collect())
    assert pack(frame(spark, []), capacity=512).count() == 0 and fill_report(pack(frame(spark, []), capacity=512), 512).first().n_items == 0


def test_round_robin_keeps_shares():
    rnd = random.Random(1)
    queues = {s: [rnd.randint(1, 100) for _ in range(n)] for s, n in (("a", 3000), ("b", 1000), ("c", 10))}
    shares = {"a": 0.5, "b": 0.3, "c": 0.2}
    windows = list(round_robin(queues, shares, {"b": 500.0}, 2000))
    out = [w for took in windows for w in took]
    assert Counter(s for s, _ in out) == {"a": 3000, "b": 1000, "c": 10} and all([k for s, k in out if s == x] == list(range(len(q))) for x, q in queues.items())
    given = Counter()
    for took in windows[:20]:
        for s, k in took:
            given[s] += queues[s][k]
    assert abs((given["b"] - 500) / given["a"] - 0.6) < 0.03
    assert list(round_robin({}, {}, {}, 10)) == [] and list(round_robin({"a": []}, {"a": 1.0}, {}, 10)) == []
    assert len(list(round_robin({"a": [10**6]}, {"a": 1.0}, {}, 10))) == 1  # an item larger than a window waits until its deficit covers it


def test_packer():
    p = Packer(10)
    assert [p.put(n) for n in (6, 5, 4, 5, 0, 10)] == [(0, 0), (1, 0), (0, 6), (1, 5), (2, 0), (2, 0)]


def test_plan():
    assert plan_totals({"a": 100, "b": 10}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 2}) == {"a": 20.0, "b": 20.0}
    assert plan_totals({"a": 100, "b": 0}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 2}) == {"a": 100.0} and plan_totals({}, {"a": 1.0}, {"a": 1}) == {}
    assert plan_totals({"a": 100, "b": 100}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 2}, total=50) == {"a": 25.0, "b": 25.0}


def test_mixing(spark, texts):
    targets = {"hot": (0.3, 1), "small": (0.4, 3), "mid": (0.2, 2), "absent": (0.1, 4)}
    rows = [(i, t, s) for i, t, s in texts if i != 902]
    got = mix(frame(spark, rows), targets).cache()
    assert all(1 <= r.copies <= targets[r.source][1] for r in got.collect())
    share = {r.source: r for r in share_report(spark, got, targets).collect()}
    assert share["absent"].n_tokens == 0 and all(abs(share[s].actual_share - targets[s][0] / 0.9) < 0.03 for s in ("hot", "small", "mid"))
    assert got.count() == got.select("doc_id").distinct().count() or got.groupBy("doc_id").count().where("count > 1").first().doc_id == 0
    assert mix(frame(spark, []), targets).count() == 0 and mix(frame(spark, rows), {"absent": (1.0, 2)}).count() == 0 and mix(frame(spark, rows), {"hot": (1.0, 0)}).count() == 0
    assert sorted(got.collect()) == sorted(mix(frame(spark, rows), targets).collect())


BODY = "COURT\n\nHeadnote: The lease was void.\n\n1. The appellant relied on the deed. The deed was lost.\n2. It is common ground that the claim fails, see Doe v. Roe [1990] 1 KAE 5."
ENDS = ["Appeal dismissed. No order as to costs.", "It is so ordered.", "(13 pages)", "Registrar: L. Doe", "Delivered at Velmora on 3 May 1999", "La présidente, Doe\nLe greffier, Roe"]


PAGES = "\nVelmora Court - Page 2\n3. The deed was not produced.\nVelmora Court - Page 3\n4. The claim fails."


def test_truncated(spark):
    rows, cut = [], set()
    for i in range(120):
        rows.append((i, BODY.replace("deed.", "deed" + " of trust" * (7 * i % 61) + ".", 1) + (PAGES if i % 3 == 0 else "") + "\n\n" + ENDS[i % 6].replace("Doe", f"Q{i}oe") + ("\n\nVelmora Court - Page 4\n" if i % 4 == 0 else ""), ["a", None][i % 2]))
    for k, stop in enumerate(["1. The appellant relied on the de", "1. The appellant relied on the deed. The deed was lost.", "The lease was", "the claim fails, see Doe v. Roe [1990] 1 KAE 5."]):
        text = BODY[: BODY.index(stop) + len(stop)] if k < 3 else BODY
        for j, end in enumerate(["", "…", "\n\nVelmora Court - Page 2", " [...]"]):
            cut.add(1000 + 10 * k + j)
            rows.append((1000 + 10 * k + j, text.replace("claim fails", ["claim fails", "claim fell", "claim lies", "claim is bad"][j]) + end, "b"))
    for i in range(12):  # a field limit of 100 characters
        cut.add(2000 + i)
        rows.append((2000 + i, ("x" * i + BODY)[:100], "limit"))
    rows += [(3000, "", "a"), (3001, None, "a"), (3002, "y" * 3_000_000, "a")]
    # Whole texts: misread letters in the closing, and one that has just a limit's length but closes.
    rows += [(4000, BODY + "\n\nAppeal disrnissed. No order as to c0sts.", "a"), (4001, BODY[:1] * (100 - len("\n\nIt is so ordered.") - 1) + "." + "\n\nIt is so ordered.", "limit")]
    # The same text over and over makes no spike.
    rows += [(5000 + i, BODY + "\n\nIt is so ordered.", "again") for i in range(30)]
    got = {r.doc_id: r for r in find_truncated(frame(spark, rows)).collect()}
    assert {i for i, r in got.items() if r.cut} == cut | {3002} and 3000 not in got and 3001 not in got
    # One that a limit cut just after a full stop is told by its end.
    stops = {2000 + i for i in range(12) if ("x" * i + BODY)[:100].rstrip().endswith(".")}
    assert all(got[i].limit_chars and got[i].reason == ("transfer" if i in stops else "chars") for i in range(2000, 2012)) and got[1000].reason == "transfer" and got[0].reason is None
    assert got[4001].limit_chars and not got[4001].cut and not any(r.limit_chars for i, r in got.items() if i >= 5000)
    rate = {r.source: r for r in truncation_rates(find_truncated(frame(spark, rows))).collect()}
    assert rate["limit"].n_cut == 12 and rate["b"].n_cut == rate["b"].n_transfer == 16 and rate[None].n_cut == 0 and rate["limit"].n_at_limit == 12 - len(stops)
    assert find_truncated(frame(spark, [])).count() == 0
    both = find_truncated(spark.createDataFrame([(i, "s", "z" * 50 + str(i % 7) * (i % 9), "q" * 20 + chr(97 + i)) for i in range(20)], "doc_id long, source string, one string, two string"), text=["one", "two"])
    assert {(r.column, r.limit_chars) for r in both.collect() if r.limit_chars} == {("two", True)} and both.count() == 40


def test_ends_of_texts():
    assert line_form("Delivered at New Velmora on 3 May 1999") == "N on 9" and line_form("For the 2 parties: X & Co") == "N the 9 parties: N & N" and line_form("") == ""
    assert line_form("0rder accordingly!") == line_form("Order accordingly!") and line_form("rendu le 3 mai 1999.") == line_form("rendu le 14 décembre 2001.") == "rendu le 9"
    assert running_forms("A B - Page 2 \nx\nA B - Page 3\n7\n8\nclause 4\nclause 9\n" + "y" * 300 + " 4\n" + "y" * 300 + " 5") == {"N - N 9"}
    assert near("abcd", "abd") == 1 and near("", "ab") == 2 and is_near("N dismlssed. N order", {"N dismissed. N order"}) and not is_near("N dismissed. N ord", {"N dismissed. N order"}) and not is_near("x", {"N"})
    page = frozenset({"N - N 9"})
    assert last_block(tail("a\n\nb.\nc\n\nX Court - Page 3\n\n"), page) == ("b. | c", False) and last_block(tail(""), page) == ("", True) and last_block(tail("a."), page) == ("a.", True)
    assert last_block(tail("a\n" * 50), page)[0] is None and last_block(tail("a.\nX Y - Page 2\n\nb"), page) == ("b", True)


def test_sums_before(spark):
    rows = [(k, i, (7 * i + k) % 11) for k in range(3) for i in range(0, 5000, 1 + k)]
    got = sums_before(spark.createDataFrame(rows, "k int, i int, v long"), ["k"], "i", "v", "b").collect()
    want, at = {}, defaultdict(int)
    for k, i, v in rows:
        want[k, i] = at[k]
        at[k] += v
    assert {(r.k, r.i): r.b for r in got} == want


def test_packing_many_sources(spark):
    """Any number of sources, and every text is there."""
    df = spark.createDataFrame([(i, f"some words {i} " * (1 + i % 5), f"s{i % 7}") for i in range(70)], "doc_id long, text string, source string")
    for shard_tokens in (8_000_000, 300):
        got = [(r.doc_id, r.source) for r in pack(df, capacity=64, shard_tokens=shard_tokens).collect()]
        assert sorted(got) == [(i, f"s{i % 7}") for i in range(70)]
    many = spark.range(200_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b "), F.col("id").cast("string")).alias("text"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("source"))
    row = pack(many, capacity=512).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("d"), F.countDistinct("source").alias("s")).first()
    assert tuple(row) == (200_000, 200_000, 200_000)


def test_windows_keep_to_the_targets(spark):
    rnd = random.Random(4)
    df = spark.createDataFrame([(i, "w " * rnd.randint(20, 200), "abbccc"[i % 6]) for i in range(6000)], "doc_id long, text string, source string")
    targets = {"a": 0.5, "b": 0.3, "c": 0.2}
    report = {r.source: r for r in window_report(pack(df, capacity=64, targets=targets), targets).collect()}
    assert all(report[s].mean_off < 0.05 and report[s].target_share == x for s, x in targets.items()) and sum(r.actual_share for r in report.values()) == pytest.approx(1, abs=1e-5)
