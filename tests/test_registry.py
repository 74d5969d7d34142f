"""Every registered SQL counterpart belongs to a query; the flagship query runs."""

import __spark_entry__ as entry


def test_registry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
