import pytest
from pyspark.sql import functions as F

from seqloom.functions.genetic_code import genetic_code
from seqloom.functions.kernels import turned
from seqloom.functions.sequence import translate_dna
from seqloom.operators import codons as C
from seqloom.operators import primers as P
from seqloom.operators import synthesis as Y
from seqloom.operators.cloning import ENZYMES, Enzyme, digest_parts, enzyme, fragments_of, golden_gate, ligate
from seqloom.operators.fold import Fold, fold, fold_one

GENE = "aataattacaccgagataacacatcatggataaaccgatactcaaagattctatgaagctatttgaggcacttggtacgatcaagtcgcgctcaatgtttggtggcttcggacttttcgctgatgaaacgatgtttgcactggttgtgaatgatcaacttcacatacgagcagaccagcaaacttcatctaacttcgagaagcaagggctaaaaccgtacgtttataaaaagcgtggttttccagtcgttactaagtactacgcgatttccgacgacttgtgggaatccagtgaacgcttgatagaagtagcgaagaagtcgttagaacaagccaatttggaaaaaaagcaacaggcaagtagtaagcccgacaggttgaaagacctgcctaacttacgactagcgactgaacgaatgcttaagaaagctggtataaaatcagttgaacaacttgaagagaaaggtgcattgaatgcttacaaagcgatacgtgactctcactccgcaaaagtaagtattgagctactctgggctttagaaggagcgataaacggcacgcactggagcgtcgttcctcaatctcgcagagaagagctggaaaatgcgctttcttaa"


def test_primer_design(spark):
    df = spark.createDataFrame([(GENE,), ("ACGT",), (None,), ("A" * 3000,)], "s string")
    got = df.select(P.design_primers(F.col("s"), 55.0).alias("p")).select("p.*").collect()
    assert tuple(got[0]) == ("AATAATTACACCGAGATAACACATCATGG", "TTAAGAAAGCGCATTTTCCAGC") and tuple(got[1]) == tuple(got[2]) == (None, None)
    over = df.limit(1).select(P.design_primers(F.col("s"), 55.0, "TTATAGGTCTCATACT", "ATGAAGAGACCATATA").alias("p")).first().p
    assert tuple(over) == ("TTATAGGTCTCATACTAATAATTACACCGAGATAACACATCATGG", "TATATGGTCTCTTCATTTAAGAAAGCGCATTTTCCAGC")


def test_pcr(spark):
    ends = ["TATATGGTCTCTTCATTTAAGAAAGCGCATTTTCCAGC", "TTATAGGTCTCATACTAATAATTACACCGAGATAACACATCATGG", "CTGCAGGTCGACTCTAG"]
    whole = "TTATAGGTCTCATACT" + GENE.upper() + "ATGAAGAGACCATATA"
    ring = ["actctgggctttagaaggagcgataaacggc", "aagtgcctcaaatagcttcatagaatctttgagtatcgg"]
    inner = ["gatactcaaagattctatgaagctatttgaggcacttggtacg", "tatcgctttgtaagcattcaatgcacctttctcttcaagttg", "gtcgttcctcaatctcgcagagaagagctggaaaatg"]
    again = ["AATAATTACACCGAGATAACACATCATGG", "CCATGATGTGTTATCTCGGTGTAATTATTTTAAGAAAGCGCATTTTCCAGC"]
    df = spark.createDataFrame([(1, GENE, ends), (2, None, ends), (3, GENE, None), (4, GENE, inner), (5, GENE, again), (6, GENE, ["ACGT"]), (7, "", ends), (8, GENE, [])], "r int, t string, p array<string>")
    got = {r.r: r for r in P.pcr(df, "r", "t", "p", 55.0).collect()}
    assert got[1].products == [whole] and got[1].error is None and got[2].error == got[3].error == "no input" and got[2].products == []
    assert len(got[4].products) == 1 and got[5].error == "concatemers" and got[6].error == "short primer" and got[7].products == got[8].products == [] and got[7].error is None
    (one,) = P.pcr(df.limit(1), "r", "t", ring, 55.0, circular=True).collect()
    assert one.products[0].startswith("ACTCTGGGCTTTAGAAGGAGC") and one.products[0].endswith("GAAGCTATTTGAGGCACTT")
    assert [r.error for r in P.pcr(df.where("r = 5"), "r", "t", again, 55.0, check=False).collect()] == [None]


def brute_products(t, primers, target, circular):
    """Pairs of sites by their definition."""
    f, r = {}, {}
    for p in primers:
        b = P.binding_part(p, target)
        for i in range(len(t)) if b else ():
            if t.startswith(b, i):
                f.setdefault(i, []).append((p, b))
            if t.startswith(turned(b), i):
                r.setdefault(i, []).append(p)
    out, places = [], sorted(f)
    for i in places:
        later = [x for x in places if x > i]
        after = sorted(x for x in r if x > i and (not later or x < later[0]))
        for x in after if not later else after[:1]:
            out += [(i, x, t[i:x])]
        if not later and not after and circular:
            out += [(i, x, t[i:] + t[:x]) for x in sorted(r) if x < places[0]]
    return [p[: len(p) - len(b)] + body + turned(q) for i, x, body in out for p, b in f[i] for q in r[x]]


def test_pcr_against_all_pairs(spark):
    import random

    rnd = random.Random(6)
    rows = []
    for i in range(60):
        unit = ["".join(rnd.choice("ACGT") for _ in range(24)) for _ in range(3)]
        t = "".join(rnd.choice([*unit, *map(turned, unit), "".join(rnd.choice("ACGT") for _ in range(9))]) for _ in range(rnd.randint(2, 9)))
        rows.append((i, t, unit))
    df = spark.createDataFrame(rows, "r int, t string, p array<string>")
    for circular in (False, True):
        got = {r.r: r.products for r in P.pcr(df, "r", "t", "p", 50.0, circular, check=False).collect()}
        assert got == {i: brute_products(t, p, 50.0, circular) for i, t, p in rows} and any(got.values())


def test_barcodes():
    s = P.de_bruijn(4)
    assert s.startswith("AAAATAAAGAAACAATTAATGAATC") and len(s) == 259 and len({s[i : i + 4] for i in range(256)}) == 256
    assert P.barcodes(20, 4)[0] == "AAAATAAAGAAACAATTAAT" and P.barcodes_gc(20, 4, 0.25, 0.75)[0] == "GAAACAATTAATGAATCAAG" and P.barcodes(20, 4, ["GGCCGCGCCCC"])[-1] == "CTCTCGGTCGCTCCGTCCCG"


BSAI, OTHER = "GGTCTCAATGC", "ATGCAGAGACC"


def test_digest(spark):
    def digest(s, ring, directional, e):
        x = spark.createDataFrame([(s,)], "s string").select(fragments_of(F.col("s"), F.lit(ring), e, directional).alias("x")).first().x
        return [tuple(r) for r in x]

    part = "ATATATA" + OTHER + BSAI + "ATGCATCGATCGACTAGCATG" + OTHER + BSAI[:8]
    e = enzyme("BsaI")
    assert digest(part, False, True, e) == [("ATGCATCGATCGACTAGCATG", "ATGC", "ATGC")]
    assert [x[0] for x in digest(part, True, True, e)] == ["ATGCATCGATCGACTAGCATG", "TATA"]
    single = "ATATATATATATATAT" + BSAI + "GCGCGCGCGCGCGCGCGCGC"
    assert [x[0] for x in digest(single, False, False, e)] == ["GCGCGCGCGCGCGCGCGCGC", "ATATATATATATATATGGTCTCA"] and [x[0] for x in digest(single, True, False, e)] == ["GCGCGCGCGCGCGCGCGCGCATATATATATATATATGGTCTCA"]
    s = "AGCTGCTGTTTAAAGCTATTACTTTGAGACC"
    (a, _, o), (b, p, _) = digest(s, False, False, e)
    assert o == p == "ACTT" and a + o + b == s
    assert digest("", False, True, e) == [] and digest("GAATTCAAAA" * 3, False, True, Enzyme("EcoRI", "GAATTC", 0, 0)) == [("AAAAGAATTC", "", "")] * 2
    with pytest.raises(KeyError):
        enzyme("EcoRFake")
    df = spark.createDataFrame([(1, part, None), (2, None, True), (3, "ACGT", False), (4, part.lower(), True)], "id int, s string, ring boolean")
    assert [tuple(r) for r in digest_parts(df.limit(3), "id", "s", e).collect()] == [(1, 1, "ATGCATCGATCGACTAGCATG", "ATGC", "ATGC")]
    assert [(r.id, r.fragment_no) for r in digest_parts(df, "id", "s", e, circular="ring").orderBy("id", "fragment_no").collect()] == [(1, 1), (4, 1), (4, 2)]


def test_ligation(spark):
    made, loops = ligate([("AAAAAA", "GTTG", "CTAT"), ("AAAAAA", "CAAC", "ATAG")])
    assert len(made) == 1 and not loops and ligate([]) == ([], [])
    # One piece that fits itself, two that make a ring of two, whichever way they lie, and one that only comes back turned round.
    assert ligate([("ACGTT", "AATG", "AATG")])[0] == ["AATGACGTT"]
    ring = [("CCCCA", "AATG", "CGAG"), ("TTTGA", "CGAG", "AATG")]
    flipped = [ring[0], (turned("TTTGA"), turned("AATG"), turned("CGAG"))]
    assert ligate(ring)[0] == ligate(flipped)[0] == ["AATGCCCCACGAGTTTGA"]
    assert ligate([("CCCCA", "AATG", "CGAG"), ("GGGTA", "CGAG", turned("CGAG"))])[1] == ["AATGCCCCACGAG"]
    ends, bodies = ["AATG", "CGAG", "TACT", "AATG"], ["ACGTTGCAAC", "TTGACCATGC", "CATTGACGGA"]
    rows = [(1, i, "TTGGTCTCA" + ends[i] + bodies[i] + ends[i + 1] + "TGAGACCAA", False) for i in range(3)] + [(None, 0, "A", False), (2, 0, None, None)]
    got = {r.r: r for r in golden_gate(spark.createDataFrame(rows, "r int, o int, s string, ring boolean"), "r", "s", "ring", ENZYMES["BsaI"], "o").collect()}
    assert got[1].constructs == ["AATG" + "".join(b + e for b, e in zip(bodies, ends[1:3] + [""]))] and got[1].loops == [] and got[2].constructs == [] and None not in got


def test_fidelity():
    counts = Y.ideal_fidelity()
    assert Y.set_efficiency(["AATG", "CGAG"], counts) == 1.0 and Y.set_efficiency(["AATG", "AATC"], counts) < 1
    free = dict(Y.next_overhangs(["AGAC"], counts))
    assert "GTCT" not in free and "GATC" not in free and "AGAC" not in free and len(free) == 238
    s = (GENE * 2).upper()
    pieces, share, error = Y.fragment(s, 90, 110, counts)
    assert error is None and 0 < share <= 1 and all(len(p) <= 110 for p in pieces) and pieces[0] + "".join(p[4:] for p in pieces[1:]) == s
    assert Y.fragment("A" * 300, 40, 80, counts)[2] and Y.fragment(s, 105, 95, counts)[2] and Y.fragment(s, 7, 95, counts)[2]
    # Against the definition, word by word.
    words = ["AATG", "AATC", "CGAG", "TACT", "GGGA"]
    n = lambda x, y: counts.counts[Y.CODE[x], Y.CODE[y]]
    share = 1.0
    for x in words:
        total = sum(n(x, y) + n(x, turned(y)) for y in words)
        share *= n(x, x) / total if total != n(x, x) else 1.0
    assert Y.set_efficiency(words, counts) == pytest.approx(share) and Y.set_efficiency([], counts) == 1.0
    for w, x in Y.next_overhangs(words, counts):
        assert x == pytest.approx((Y.set_efficiency([*words, w], counts) + Y.set_efficiency([*words, turned(w)], counts)) / 2)
    assert Y.fragment("", 90, 110, counts)[0] == [""] and Y.fragment("ACGTN" * 100, 90, 110, counts)[2] == "no place to cut"
    only = Y.fragment(s, 60, 110, counts, include=[s[i : i + 4] for i in range(0, len(s), 9)])
    assert only[2] is None


def test_measured_fidelity(tmp_path):
    """A published table, and the same as a list: the partner of a row is what it is ligated with."""
    (tmp_path / "t.csv").write_text("Overhang,TTTT,GTTT,CATT\nAAAA,600,3,0\nAAAC,2,500,0\nAATG,0,0,400\n")
    (tmp_path / "t.json").write_text('[["AAAA","AAAA",600],["AAAA","AAAC",3],["AAAC","AAAA",2],["AAAC","AAAC",500],["AATG","AATG",400]]')
    a, b = (Y.read_fidelity(str(tmp_path / f"t.{x}")) for x in ("csv", "json"))
    assert (a.counts == b.counts).all() and Y.set_efficiency(["AAAA", "AAAC", "AATG"], a) == pytest.approx(600 / 603 * 500 / 502)


def rows(weights=None):
    return [(a, t, (weights or {}).get(t, 10)) for t, a in genetic_code(1).items()]


def test_fixing(spark):
    fixed, changes, error = Y.fix_cds("ATGTATTGA", rows({"TAT": 40, "TAC": 30}), Y.usual_finders(["TAT"]))
    assert fixed == "ATGTACTGA" and error is None and changes == [(1, 0, "TAT", "TAC", "unwanted word")]
    assert Y.fix_cds("AT", rows(), [])[2] and Y.fix_cds("ATG", rows()[:60], [])[2] and Y.fix_cds("ATG", rows(), [lambda s: [Y.Suggestion(0, 1, "XY", 1, "")]])[2]
    assert Y.fix_cds("GGG", rows(), [Y.bound_gc(0.1, 0.05)])[2] and Y.fix_cds("ATG", rows(), [lambda s: [Y.Suggestion(10**18, 10, "GC", 1, "")]])[2]
    gene = "ATGGGTCTCGAAGACAAAAAAAAAAAACTGACTGGATCACCGTTAGGTCTCCATGACTAA"
    fixed, _, error = Y.fix_cds(gene, rows(), Y.usual_finders(["GGTCTC", "GAAGAC"]))
    code = genetic_code(1)
    read = lambda s: "".join(code[s[i : i + 3]] for i in range(0, len(s), 3))
    assert error is None and read(fixed) == read(gene) and not any(w in x for w in ("GGTCTC", "GAAGAC", "A" * 8) for x in (fixed, turned(fixed)))
    got = spark.createDataFrame([("ATGTATTGA",), (None,), ("A",)], "s string").select(Y.fixed_cds(F.col("s"), rows(), Y.usual_finders(["TAT"])).alias("f")).select("f.*").collect()
    assert got[0].fixed == "ATGTACTGA" and got[0].changes[0].codon_to == "TAC" and got[1].fixed is None and got[2].error


def test_codon_tables(spark):
    table = lambda r: spark.createDataFrame(r, "letter string, triplet string, weight long")
    a, b = table([("F", "TTT", 1), ("F", "TTC", 3), ("M", "ATG", 0)]), table([("F", "TTT", 90), ("F", "TTC", 10), ("M", "ATG", 5)])
    assert {r.triplet: r.weight for r in C.add_tables(a, b).collect()} == {"TTT": 91, "TTC": 13, "ATG": 5}
    assert {r.triplet: r.weight for r in C.compromise(a, b, 0.1).collect()} == {"TTT": 5750, "TTC": 4250, "ATG": None}
    assert {r.triplet: r.weight for r in C.compromise(a, b, 0.2).collect()} == {"TTT": 5750, "TTC": 0, "ATG": None}
    with pytest.raises(ValueError):
        C.compromise(a, b, 1.5)
    assert {(r.triplet, r.low, r.high) for r in C.codon_cdf(b).collect()} == {("TTT", 0.0, 1.0), ("ATG", 0.0, 1.0)}
    df = spark.createDataFrame([("atgTTTttcTAAG",), ("",), (None,), ("AT",)], "s string")
    assert {r.triplet: r.n for r in C.codon_frequency(df, F.col("s")).collect()} == {"ATG": 1, "TTT": 1, "TTC": 1, "TAA": 1}
    weights = C.weigh(C.codon_dim(spark), C.codon_frequency(df, F.col("s")))
    assert weights.count() == 64 and weights.where("weight = 1").count() == 4


def test_optimize(spark):
    code = genetic_code(1)
    df = spark.createDataFrame([("MFKLSTV*",), ("mfkl",), ("MXB",), ("",), (None,)], "p string")
    got = df.select("p", C.optimize(F.col("p"), rows(), 3).alias("d")).withColumn("back", translate_dna("d", code)).collect()
    assert [r.back for r in got] == ["MFKLSTV*", "MFKL", None, None, None]
    again, other = (df.select(C.optimize(F.col("p"), rows(), s).alias("d")).first().d for s in (3, 4))
    assert again == got[0].d and other != got[0].d


# Published estimates of free energies at 37 degrees.
ESTIMATES = {
    "GGGAGGTCGTTACATCTGGGTAACACCGGTACTGATCCGGTGACCTCCC": -10.94, "GGGAGGTCGCTCCAGCTGGGAGGAGCGTTGGGGGTATATACCCCCAACACCGGTACTGATCCGGTGACCTCCC": -23.4, "TAGCTCAGCTGGGAGAGCGCCTGCTTTGCACGCAGGAGGT": -6.85,
    "GGGGGCATAGCTCAGCTGGGAGAGCGCCTGCTTTGCACGCAGGAGGTCTGCGGTTCGATCCCGCGCGCTCCCACCA": -15.5, "TGAGACGGAAGGGGATGATTGTCCCCTTCCGTCTCA": -18.1, "ACCCCCTCCTTCCTTGGATCAAGGGGCTCAA": -3.65, "ACCCCCUCCUUCCUUGGAUCAAGGGGCUCAA": -9.5,
    "AAGGGGUUGGUCGCCUCGACUAAGCGGCUUGGAAUUCC": -10.1, "UUGGAGUACACAACCUGUACACUCUUUC": -4.3, "AGGGAAAAUCCC": -3.3, "GCUUACGAGCAAGUUAAGCAAC": -4.6, "UGGGAGGUCGUCUAACGGUAGGACGGCGGACUCUGGAUCCGCUGGUGGAGGUUCGAGUCCUCCCCUCCCAGCCA": -32.8,
    "GGGCGAUGAGGCCCGCCCAAACUGCCCUGAAAAGGGCUGAUGGCCUCUACUG": -20.7, "GGGGGCAUAGCUCAGCUGGGAGAGCGCCUGCUUUGCACGCAGGAGGUCUGCGGUUCGAUCCCGCGCGCUCCCACCA": -31.4,
}


def test_fold(spark):
    for s, want in ESTIMATES.items():
        assert abs(fold_one(s)[0] - want) <= max(2.7, 0.1 * abs(want)), s
    assert fold_one("ACCCCCUCCUUCCUUGGAUCAAGGGGCUCAA")[1] == ".((((.(((......)))....))))"
    _, text, parts = fold_one("GGGAGGTCGTTACATCTGGGTAACACCGGTACTGATCCGGTGACCTCCC")
    assert text == "(((((((((((((......))))).((((.......)))).))))))))" and [(a, p) for _, kind, p, a in parts if kind == "branching loop"] == [([(8, 23), (25, 39)], (7, 41))]
    f = Fold("GCUCAGCUGGGAGAGC")
    c = f.c
    assert f.m.stack[c[1], c[2], c[14], c[13]] == pytest.approx(-2.1, abs=0.1) and f.v[0, 15] == pytest.approx(-3.8, abs=0.2)
    assert Fold("CCUGCUUUGCACGCAGG").v[0, 16] == pytest.approx(-6.4, abs=0.2) and Fold("GCGGUUCGAUCCCGC").v[0, 14] == pytest.approx(-4.2, abs=0.2)
    assert Fold("ACCCCCATCCTTCCTTGAGTCAAGGGGCTCAA").bulge(5, 7, 18, 17) == pytest.approx(3.22, abs=0.4) and Fold("ACCCCCTCCTTCCTTGGATCAAGGGGCTCAA").interior(6, 10, 21, 17) == pytest.approx(3.5, abs=0.1)
    assert [Fold(s).hairpin(i, j) for s, i, j in (("ACCCCCTCCTTCCTTGGATCAAGGGGCTCAA", 11, 16), ("ACCCGCAAGCCCTCCTTCCTTGGATCAAGGGGCTCAA", 3, 8), ("CUUUGCACG", 0, 8))] == [pytest.approx(x, abs=y) for x, y in ((4.3, 1.0), (0.67, 0.1), (4.5, 0.2))]
    assert Fold("GGGGAAAACCCC").hairpin(0, 3) == float("inf")
    got = spark.createDataFrame([("ACGUT",), ("",), (None,), ("ACGT" * 150,), ("GGGGAAAACCCC",), ("ggggaaaacccc",), ("AAAAAAAAAA",)], "s string").select(fold(F.col("s")).alias("f")).select("f.*").collect()
    assert got[0].error and got[1].mfe is None and got[2].dot_bracket is None and got[3].error == "too long" and got[4].dot_bracket == got[5].dot_bracket == "((((....))))" and got[6].mfe is None and got[6].dot_bracket == ""


def test_fold_adds_up():
    """A structure's parts have the energy that the tables say, and no pair crosses another."""
    import random

    rnd = random.Random(12)
    for n in (5, 9, 20, 60, 120, *range(140, 200, 3)):
        for letters in ("ACGT", "ACGU"):
            f = Fold("".join(rnd.choice(letters) for _ in range(n)))
            parts = f.parts() if f.x[n] < float("inf") else []
            for g, kind, (i, j), inner in parts:
                assert f.v[i, j] == pytest.approx(g + sum(f.v[p] for p in inner))
                want = {"hairpin": lambda: f.hairpin(i, j), "bulge": lambda: f.bulge(i, inner[0][0], j, inner[0][1]), "interior loop": lambda: f.interior(i, inner[0][0], j, inner[0][1])}.get(kind)
                assert want is None or g == pytest.approx(want())
                assert all(i < p < q < j for p, q in inner) and all(a[1] < b[0] for a, b in zip(inner, inner[1:]))
            pairs = [p for _, _, p, _ in parts]
            assert len({x for p in pairs for x in p}) == 2 * len(pairs)
