import __spark_entry__ as e


def test_contract():
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 60
    assert {"p1_found", "p3_found", "p5_found"} <= set(q)


def test_entry(spark):
    df = e.entry(spark)
    assert df.columns == ["id", "forward", "reverse"] and df.count() > 0
