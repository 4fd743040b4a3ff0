"""Queries that must take every sequence, whole."""

from pyspark.sql import functions as F

from seqloom.functions.kernels import turned
from seqloom.plans import reference as R


def test_fragments_of_all_lengths(spark, sf):
    short = {r.id for r in R.dna(spark, sf).where(F.length("seq") < 200).collect()}
    got = {r.id for r in R.QUERIES["fragment_sequences"](spark, sf).select("id").collect()}
    assert short and short <= got and got == {r.id for r in R.dna(spark, sf).collect()}


def test_palindromes_are_whole(spark):
    """A palindromic start doesn't make a palindrome."""
    from unittest import mock

    rows = spark.createDataFrame([(1, "ACGTAA"), (2, "ACGTACGT"), (3, "ACGT"), (4, "GAATTC!")], "fasta_id long, sequence string")
    with mock.patch.object(R, "table", lambda *_: rows):
        got = {r.id: r.value for r in R.QUERIES["is_palindromic"](spark, "").collect()}
    assert got == {1: False, 2: True, 3: True, 4: True}


def test_index_queries_on_whole_sequences(spark):
    """Against brute force, and every sequence is there."""
    import hashlib
    import random
    from unittest import mock

    rnd = random.Random(3)
    seqs = {i: "".join(rnd.choice("ACGT") for _ in range(n)) for i, n in enumerate([1, 2, 33, 200, 600])}
    rows = spark.createDataFrame(list(seqs.items()), "fasta_id long, sequence string")
    ring = lambda s: min(s[i:] + s[:i] for i in range(len(s)))
    bwt = lambda s: "".join(x[-1] for x in sorted((s + "$")[i:] + (s + "$")[:i] for i in range(len(s) + 1)))
    want = {
        "burrows_wheeler_all": bwt, "burrows_wheeler": bwt, "canonical_rotation_all": ring, "canonical_rotation": ring, "canonical_circular": lambda s: hashlib.md5(min(ring(s), ring(turned(s))).encode()).hexdigest(),
        "suffix_array_locate": lambda s: ",".join(str(i) for i in range(len(s)) if s[i : i + 2] == "GT"),
    }
    with mock.patch.object(R, "table", lambda *_: rows):
        for name, f in want.items():
            assert {r.id: r.value for r in R.QUERIES[name](spark, "").collect()} == {i: f(s) for i, s in seqs.items()}, name
        assert {r.id for r in R.QUERIES["mash_distance"](spark, "").collect()} == {0, 1, 2, 3}
        folded = {r.id: r.value for r in R.QUERIES["fold_dna"](spark, "").collect()}
    assert set(folded) == set(seqs) and "too long" in folded[4] and "dot_bracket" in folded[3]
