import __spark_entry__ as E


def test_entry_and_registry(spark):
    df = E.entry(spark)
    assert set(df.columns) == {"qid", "query", "count"}
    assert df.count() > 0
    q, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(q)
    assert len(q) >= 50
