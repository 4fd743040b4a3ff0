import random

import pytest
from pyspark.sql import functions as F

from seqloom.functions import kernels as K
from seqloom.functions import sequence as S
from seqloom.functions.genetic_code import DIFFERENT, genetic_code, start_codons, stop_codons


def one(spark, value, of):
    return spark.createDataFrame([(value,)], "s string").select(of(F.col("s")).alias("x")).first().x


@pytest.mark.parametrize("value,of,want", [
    ("GATTACA", S.reverse, "ACATTAG"), ("GATTACA", S.complement, "CTAATGT"), ("GATTACA", S.reverse_complement, "TGTAATC"), ("gatNrz", S.complement, None), ("GAUUACA", S.complement_rna, "CUAAUGU"),
    ("GATTXCA", lambda s: S.complement(s, strict=False), "CTAA\x00GT"), ("GAUUACA", S.reverse_complement_rna, "UGUAAUC"), ("Z", S.complement_base, " "), ("A", S.complement_base, "T"), (None, S.complement_base, None),
    ("GGTATC", S.gc_content, 0.5), ("", S.gc_content, None), ("GGTCTC", S.is_palindromic, False), ("GATC", S.is_palindromic, True), ("GATTACA", S.is_dna, True), ("GAUUACA", S.is_dna, False), ("GATC\n", S.is_dna, False), ("", S.is_dna, True),
    ("GAUUACA", S.is_rna, True), ("RANDOM STRING", S.is_rna, False), ("ACGTCCGGACTT", S.marmur_doty, 31.0), ("ATX", S.iupac_variants, None), (None, S.iupac_variants, None),
    ("ACGTA", lambda s: S.kmers(s, 3), ["ACG", "CGT"]), ("ACGTA", lambda s: S.kmers(s, 3, last=True), ["ACG", "CGT", "GTA"]), ("AC", lambda s: S.kmers(s, 3), []), ("AAAA", lambda s: S.count_overlapping(s, "AA"), 3),
    ("banana", lambda s: S.locate_all(s, "ana"), [1, 3]), ("banana", lambda s: S.locate_all(s, "x"), []), ("", lambda s: S.locate_all(s, "x"), []), ("banana", lambda s: S.extract(s, 1, 3), "an"), ("ban", lambda s: S.extract(s, 1, 4), None),
    ("banana", K.bwt, "annb$aa"), ("", K.bwt, None), ("a$b", K.bwt, None), ("ATGXXXTAAG", lambda s: S.translate_dna(s, genetic_code(1)), "M*"), ("", lambda s: S.translate_dna(s, genetic_code(1)), None), ("AT", lambda s: S.translate_dna(s, genetic_code(1)), ""),
    ("C", lambda s: S.encode(s, list("ACGT")), 1), ("2", lambda s: S.encode(s, list("ACGT")), 2), ("9", lambda s: S.encode(s, list("ACGT")), None), ("x", lambda s: S.encode(s, list("ACGT")), None),
    ("TTAGCCCAT", lambda s: K.seqhash(s, "DNA", True, True), "v1_DCD_a376845b679740014f3eb501429b45e592ecc32a6ba8ba922cbe99217f6e9287"),
    ("TTAGCCCAT", lambda s: K.seqhash(s, "DNA", True, False), "v1_DCS_ef79b6e62394e22a176942dfc6a5e62eeef7b5281ffcb2686ecde208ec836ba4"),
    ("TTAGCCCAT", lambda s: K.seqhash(s, "DNA", False, True), "v1_DLD_c2c9fc44df72035082a152e94b04492182331bc3be2f62729d203e072211bdbf"),
    ("TTAGCCCAT", lambda s: K.seqhash(s, "RNA", False, False), "v1_RLS_063ea37d1154351639f9a48546bdae62fd8a3c18f3d3d3061060c9a55352d967"),
    ("MGC*", lambda s: K.seqhash(s, "PROTEIN"), "v1_PLS_922ec11f5227ce77a42f07f565a7a1a479772b5cf3f1f6e93afc5ecbc0fd5955"),
    ("ATGC", lambda s: K.seqhash(s, "DNA", False, True), "v1_DLD_f4028f93e08c5c23cbb8daa189b0a9802b378f1a1c919dcbcf1608a615f46350"),
    ("MGC*", lambda s: K.seqhash(s, "PROTEIN", double=True), None), ("AT1", lambda s: K.seqhash(s, "DNA"), None), (None, lambda s: K.seqhash(s, "DNA"), None),
])
def test_values(spark, value, of, want):
    assert one(spark, value, of) == want


def test_iupac(spark):
    got = one(spark, "ATGGARAAYGAYGARCTN", S.iupac_variants)
    assert got[:4] == ["ATGGAGAATGATGAGCTG", "ATGGAGAATGATGAGCTA", "ATGGAGAATGATGAGCTT", "ATGGAGAATGATGAGCTC"] and len(got) == len(set(got)) == 64


def test_melting(spark):
    assert abs(one(spark, "ACGTAGATCTACGT", lambda s: S.santa_lucia(s, 0.1e-6, 0.35))["melting_temp"] - 47.428514) < 1e-6
    assert abs(one(spark, "GTAAAACGACGGCCAGT", S.melting_temp) / 52.8 - 1) < 0.02
    assert abs(one(spark, "ACGATGGCAGTAGCATGC", lambda s: S.santa_lucia(s, 0.1e-6, 0.35))["melting_temp"] / 62.7 - 1) < 0.02


def test_rotations_have_one_form():
    rnd = random.Random(1)
    s = "".join(rnd.choice("ACGT") for _ in range(300))
    assert {K.rotate(s[i:] + s[:i]) for i in range(len(s))} == {min(s[i:] + s[:i] for i in range(len(s)))}
    assert {K.canonical(x[i:] + x[:i], "DNA", True, True) for i in range(0, 300, 7) for x in (s, K.turned(s))} == {K.canonical(s, "DNA", True, True)}
    assert K.rotate("AAAA") == "AAAA" and K.rotate("") == "" and K.rotate("ABAB") == "ABAB"


def test_blake3_sizes():
    data = lambda n: bytes(i % 251 for i in range(n))
    assert K.blake3_hex([data(0), data(1), data(1024), data(1025), data(3072), data(31744)]) == [
        "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262", "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213",
        "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7", "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444",
        "b98cb0ff3623be03326b373de6b9095218513e64f1ee2edd2525c7ad1e5cffd2", "62b6960e1a44bcc1eb1a611a8d6235b6b4b78f32e7abc4fb4c6cdcce94895c47",
    ]


def test_sketches():
    a, b = "ATCGATCGATCGATCGATCGATCGATCGATCGATCGAATGCGATCGATCGATCGATCGATCG", "ATGCGATCGATCGATCGATCGATCGATCGATCGATCGATCGATCGATCGATCGATCGATCGA"
    x, y, z = K.sketch_of(a, 17, 10), K.sketch_of(a, 17, 9), K.sketch_of(b, 17, 5)
    assert x[:9] == y and K.sketch_of("ACG", 17, 3) == [0, 0, 0] and len(z) == 5


def test_sketch_similarity(spark):
    rows = [([1, 1, 2], [1, 2, 2, 3], 2 / 3), ([1], [2], 0.0), (None, [1], None)]
    got = spark.createDataFrame(rows, "a array<long>, b array<long>, want double").select(K.mash_similarity(F.col("a"), F.col("b")).alias("x"), "want").collect()
    assert all(r.x == r.want or r.want is None and (r.x is None or r.x != r.x) for r in got)


def test_alignment():
    one = K.Scoring()
    assert K.align("GATTACA", "GCATGCU", one, False) == (0, "G-ATTACA", "GCA-TGCU") and K.align("GATTACA", "GCATGCU", one, True) == (2, "AT", "AT")
    # The published example scores by the matrix's rows in another order of letters than its own.
    swapped = K.scoring_of((x, y, K.NUC_4_ROWS[i][j]) for i, x in enumerate("ACGT-") for j, y in enumerate("ACGT-"))
    assert K.align("GATTACA", "GCATGCT", swapped, True) == (15, "GATTAC", "GCATGC")
    assert K.align("AAAA", "AAAA", K.nuc_4(), True) == (20, "AAAA", "AAAA") and K.align("GATTACA", "GCATGCT", K.nuc_4(), True)[0] == 17 and K.align("AAAT", "T", one, False) == (-2, "T", "T")
    assert K.align("", "", one, False) == (0, "", "") and K.align("gat", "GAT", one, False) is None


def plain_align(a, b, score, gap, local):
    """The matrix cell by cell."""
    n, m = len(a), len(b)
    h = [[0 if local else gap * (i + j) for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            h[i][j] = max(h[i - 1][j - 1] + score(a[i - 1], b[j - 1]), h[i - 1][j] + gap, h[i][j - 1] + gap, *([0] if local else []))
    return max(map(max, h)) if local else h[n][m]


def test_alignment_against_plain_matrix():
    rnd = random.Random(8)
    for _ in range(40):
        a, b = ("".join(rnd.choice("ACGT") for _ in range(rnd.randint(0, 40))) for _ in range(2))
        for scoring, score in ((K.Scoring(-2, 3, -1), lambda p, q: 3 if p == q else -1), (K.nuc_4(-3), lambda p, q: 5 if p == q else -4)):
            for local in (False, True):
                got = K.align(a, b, scoring, local)
                assert got == K.align(a, b, scoring, local, kept_cells=10) and got[0] == plain_align(a, b, score, scoring.gap, local)
                assert len(got[1]) == len(got[2]) and got[1].replace("-", "") in a and got[2].replace("-", "") in b
                if local:
                    assert got[0] == sum(scoring.gap if "-" in (p, q) else score(p, q) for p, q in zip(got[1], got[2]))


def test_suffix_search(spark):
    rnd = random.Random(2)
    s = "".join(rnd.choice("AC") for _ in range(400))
    got = spark.createDataFrame([(s,)], "s string").select(*(K.locate_in(F.col("s"), K.suffix_array(F.col("s")), p) for p in ("ACA", "A", "CCCCCCCCCCCCC", ""))).first()
    for p, x in zip(("ACA", "A", "CCCCCCCCCCCCC"), got):
        assert sorted(x) == [i for i in range(len(s)) if s.startswith(p, i)]
    assert got[3] is None


def test_fm_index(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(a) for _ in range(n)) for a in ("AC", "ACGT", "xyzé", "# $A") for n in (1, 2, 31, 32, 33, 300)]
    patterns = ("A", "AC", "CAC", "zz", "é", "$", "AAAAAAAAAAAAAAAAAAAAAAAA")
    for t in texts:
        f = K.FMIndex(K.fm_of(t))
        for p in patterns:
            want = [i for i in range(len(t)) if t.startswith(p, i)]
            low, high = f.range(p)
            assert high - low == len(want) and sorted(f.start(i) for i in range(low, high)) == want
    df = spark.createDataFrame([("ACAC",), ("",), (None,), ("A$",)], "s string").withColumn("x", K.fm_index(F.col("s")))
    assert [tuple(r) for r in df.select(K.fm_count(F.col("x"), "AC"), K.fm_locate(F.col("x"), "AC")).collect()] == [(2, [0, 2]), (None, None), (None, None), (0, [])]


def test_genetic_codes():
    assert len(DIFFERENT) == 25 and all(len(genetic_code(n)) == 64 for n in DIFFERENT)
    assert genetic_code(1)["TGA"] == "*" and genetic_code(2)["AGA"] == "*" and genetic_code(12)["CTG"] == "S" and start_codons(3) == ["ATA", "ATG", "GTG"] and stop_codons(27) == ["TGA"] and stop_codons(11) == ["TAA", "TAG", "TGA"]
    with pytest.raises(ValueError):
        genetic_code(7)


def test_features(spark):
    seg = "array<struct<seg_start:bigint,seg_end:bigint,complement:boolean>>"
    rows = [("AACCGGTT", [(0, 2, False), (4, 6, True)], False), ("AACCGGTT", [(0, 2, False), (4, 6, True)], True), ("AACC", [(2, 2, False)], False), (None, [(0, 1, False)], False)]
    df = spark.createDataFrame(rows, f"p string, segs {seg}, c boolean")
    assert [r[0] for r in df.select(S.feature_sequence("p", "segs", "c")).collect()][:3] == ["AACC", "GGTT", ""]


def test_random(spark):
    df = spark.range(20).select(S.random_sequence(30, F.col("id")).alias("d"), S.random_protein(12, F.col("id")).alias("p"), S.random_protein(2, F.col("id")).alias("none"))
    a, b = df.collect(), df.collect()
    assert a == b and len({r.d for r in a}) == 20 and all(set(r.d) <= set("ACGT") and len(r.d) == 30 and r.p[0] == "M" and r.p[-1] == "*" and len(r.p) == 12 and r.none is None for r in a)
