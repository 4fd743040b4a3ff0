import random

import pytest

from seqloom.llm import names
from seqloom.llm.names import Rarity, Roles, grams, link_mentions, mention_pairs, mentions, one_error, parse_organisation, parse_person, plain_vowels, similar_names, soft_similarity

ROLES = Roles(frozenset({"jr", "phd"}), frozenset({"van", "von"}), frozenset({"jo", "leo"}))


@pytest.mark.parametrize("raw,want", [
    ("Doe,J.A.", ("doe", "", "j", "a")), ("Doe JA", ("doe", "", "j", "a")), ("J.A. Doe", ("doe", "", "j", "a")), ("Josie A. Doe", ("doe", "josie", "j", "a")), ("DOE,JO", ("doe", "jo", "j", "")), ("Doe,JO", ("doe", "", "j", "o")),
    ("Doe,Bob PhD", ("doe", "bob", "b", "")), ("van Doe,J. Jr.", ("doe", "", "j", "")), ("VAN DOE J", ("doe", "", "j", "")), ("Maggie van Doe", ("doe", "maggie", "m", "")), ("MAGGIE VAN DOELL", ("doell", "maggie", "m", "")), ("Döe,J.*  ", ("doe", "", "j", "")), ("Doe,OE", ("doe", "", "o", "e")),
    ("Doe", ("doe", "", "", "")), ("Doe,", ("doe", "", "", "")), ("Doe,M.D.", ("doe", "", "m", "d")), ("Doe MD", ("doe", "", "m", "d")), ("DOE,J.R. JR.", ("doe", "", "j", "r")), ("Doe-Roe,J.", ("doeroe", "", "j", "")), ("Van", ("van", "", "", "")), ("de Doe,J.", ("doe", "", "j", "")),
])
def test_people(raw, want):
    words, *rest = parse_person(raw, ROLES)
    assert (" ".join(words), *rest) == want


def test_odd_names():
    assert parse_person("...") is None and parse_person("") is None and parse_person("12") is None and parse_organisation("") == [] and parse_organisation("The Int'l") == ["intl", "the"]
    assert grams("") == [] and grams("ab") == ["##a", "#ab"] and set(grams("abc")) <= set(grams("abcdef"))


def weights(text):
    return {w: 6.0 if w == "kuterosen" else 0.3 if w in ("the", "for", "intl", "international", plain_vowels("sequencing")) else 2.0 for w in parse_organisation(text)}


@pytest.mark.parametrize("a,b,same", [
    ("The Int'l Kuterosen Microb. Sequencing Consortium", "Kuterosen Microbiome, Consort.", True), ("Kuterosen MC", "Consortium for the Kuterosen Microbiome", True), ("Kuterosen PWG", "Kuterosen Proteome Working Group", True), ("Kuterosen PWG", "Kuterosen Prot. WG", True),
    ("Kuterosen Consortium-Microbiome", "Kuterosen Proteome Consortium", False), ("Kuterosen Microbiome Network", "Kuterosen Microbiome Consortium", False), ("Kuterosen MC", "Kuterosen MC", True), ("Kuterosen MN", "Netw. for the Kuterosen Microb.", True),
    ("Kuterosen PWG", "Gogigevik Plasmid WG", False),
])
def test_organisations(a, b, same):
    assert (soft_similarity(weights(a), weights(b)) >= 0.85) is same and soft_similarity(weights(a), weights(b)) == pytest.approx(soft_similarity(weights(b), weights(a)))
    assert soft_similarity({}, {}) == 0 and soft_similarity({"a": 1.0}, {}) == 0


def test_one_error():
    for a, b in (("abcdef", "abcde"), ("abcdef", "abxdef"), ("abcdef", "abdcef"), ("abcdef", "xabcdef"), ("abcdef", "abcdeff")):
        assert one_error(a, b) and one_error(b, a)
    assert not one_error("abc", "abc") and not one_error("abcdef", "abdcfe") and not one_error("abcdef", "ab") and not one_error("abcd", "cbad")


def test_prefix_filter_is_exact(spark):
    """Against all pairs: those whose weighted similarity reaches the threshold, verified."""
    rnd = random.Random(3)
    words = {"".join(rnd.choice("abce") for _ in range(rnd.randint(4, 9))) for _ in range(400)} | {"abcd", "abcde" * 40, "abcde" * 40 + "x"}
    got = {(r.x, r.y) for r in similar_names(spark.createDataFrame([("p", w) for w in words], "kind string, main string")).collect()}
    df = {}
    for w in words:
        for g in grams(w):
            df["p", g] = df.get(("p", g), 0) + 1
    r = Rarity({"p": len(words)}, df)
    weight = lambda gs: sum(r.gram("p", g) for g in gs)
    want = set()
    for a in words:
        for b in words:
            x, y = set(grams(a)), set(grams(b))
            if a < b and len(x & y) > 1 and weight(x & y) >= names.LEAST_SHARED['p'] * weight(x | y):
                p, q = plain_vowels(a), plain_vowels(b)
                if p == q or min(len(a), len(b)) >= names.SHORTEST and (one_error(p, q) or one_error(a, b)):
                    want.add((a, b))
    assert want and want <= got and all(plain_vowels(a) == plain_vowels(b) or one_error(plain_vowels(a), plain_vowels(b)) or one_error(a, b) for a, b in got)


def test_linking(spark):
    def word(i):
        return "".join(chr(97 + (i * 7 + k * 5) % 26) for k in range(8)).capitalize()

    rows = [
        (1, "Tozafezo,Josephine N. and Glibezolund,O.E. PhD", "Kuterosen Microbiome Consortium"), (2, "Josie Tozafezo, GLIBEZOLUND OE", None), (3, "Tozaefzo,J.N.", "Kuterosen MC"),
        (4, "Tozafezo,B., Glibezolund,O.K.", "Kuterosen Proteome Network"), (5, None, None), (6, "", "  "), (7, "Tozafezo,J.N. and J. Tozafezo", ""), (8, "-", "***"), (8, "-", None), (None, "Tozafezo,J.N.", None), (9, "X" * 5000 + ",A.", None),
    ] + [(20 + i, None, f"{word(i)} {a} {b}") for i, (a, b) in enumerate([("Microbiome", "Consortium"), ("Proteome", "Network")] * 5)]
    # What teaches the roles: titles after initials, and a short form beside initials of its formal name.
    rows += [(100 + i, f"{word(i)},R. PhD, Bob {word(i)}, Q{word(3 * i)},S.", None) for i in range(8)]
    df = spark.createDataFrame([(*r, "p", 1) for r in rows], "ref_id long, authors string, consortium string, kind string, n int")
    linked = link_mentions(df)
    assert linked.count() == mentions(df).count() == 27 + 24
    pairs = {tuple(r) for r in mention_pairs(linked).collect()}
    j = [(1, 1), (2, 1), (3, 1), (7, 1), (7, 2)]
    people = {(*a, *b) for a in j for b in j if a[0] < b[0]}
    assert pairs == people | {(1, 2, 2, 2), (1, 0, 3, 0)}
    by = {(r.ref_id, r.author_no): r.entity for r in linked.collect()}
    assert all(by[100 + i, 1] == by[100 + i, 2] != by[100 + i, 3] for i in range(8))
    none = df.limit(0)
    assert mention_pairs(link_mentions(none)).count() == 0


@pytest.mark.parametrize("block", [4096, 7])
def test_hot_spelling(spark, monkeypatch, block):
    monkeypatch.setattr(names, "PAIR_BLOCK", block)
    df = spark.range(300).selectExpr("id ref_id", "if(id % 3 = 0, concat('Hot,A. and Rare', id, 'son,B.'), 'Other,C.') authors", "cast(null as string) consortium")
    pairs = mention_pairs(link_mentions(df))
    assert pairs.count() == pairs.distinct().count() >= 100 * 99 // 2 + 200 * 199 // 2
