import __spark_entry__ as entry


def test_entry_and_keys(spark):
    assert entry.entry(spark).columns == ["episode", "frame", "step", "threshold"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
