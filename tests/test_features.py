from pyspark.sql import functions as F

from seqloom.functions.register import register_all
from seqloom.operators.features import add_features, location, with_sequences


def test_location(spark):
    got = spark.createDataFrame([("complement(join(1..2,5..6))",), ("bad",), (None,)], "s string").select(location(F.col("s")).alias("x")).select("x.*").collect()
    assert got[0].complement and got[0].start_pos == 0 and got[0].end_pos == 6 and len(got[0].segments) == 2 and got[1].error and got[1].segments is None and got[2].error is None


def test_features(spark):
    seg = "array<struct<seg_start:bigint,seg_end:bigint,complement:boolean>>"
    f = spark.createDataFrame([("r", 0, False, [(0, 2, False)]), ("r", 1, True, [(0, 2, False)]), ("none", 0, False, [(0, 1, False)])], f"record_id string, feature_idx int, complement boolean, segments {seg}")
    r = spark.createDataFrame([("r", "AACC")], "record_id string, sequence string")
    assert sorted((x.feature_idx, x.feature_sequence) for x in with_sequences(f, r).collect()) == [(0, "AA"), (1, "TT")]
    more = add_features(f, spark.createDataFrame([("r", 7, False), ("r", 3, None), ("new", 1, True)], "record_id string, feature_idx int, complement boolean"))
    assert sorted((x.record_id, x.feature_idx) for x in more.collect()) == [("new", 0), ("none", 0), ("r", 0), ("r", 1), ("r", 2), ("r", 3)]


def test_sql_functions(spark):
    assert "seq_gc_content" in register_all(spark)
    r = spark.sql("select seq_reverse_complement('GATTACA') a, seq_gc_content('GGTATC') b, seq_is_dna('ACGU') c, seq_letters('1 ac-g') d, seq_marmur_doty('ACGTCCGGACTT') e, seq_is_palindromic('GATC') f").first()
    assert tuple(r) == ("TGTAATC", 0.5, False, "ACG", 31.0, True)
