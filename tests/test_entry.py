import __spark_entry__ as e


def test_entry_points(spark):
    queries, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 70
    assert e.entry(spark).count() > 0
