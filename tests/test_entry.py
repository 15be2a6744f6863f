"""The driver's three functions."""

import __spark_entry__ as entry


def test_entry_and_registries(spark):
    assert entry.entry(spark).count() == 30
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_wrapped_queries_keep_names(spark):
    assert entry.queries()["central_top30"].__name__ == "central_top30"
