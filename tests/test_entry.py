"""The contract of the entry: names, SQL, and that the rest works without the optional subpackage."""

import __spark_entry__ as entry


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p1_found", "hybrid_search"} <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0
