"""The driver's entry points."""

from __future__ import annotations

import __spark_entry__ as entry

from vertexloom.queries import QUERIES, SQL


def test_entry(spark, tiny):
    df = entry.entry(spark)
    assert df.columns == ["customer_names", "customers", "nation"] and df.count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_missing_modules_are_left_out():
    assert entry._optional("vertexloom.no_such_part.registry") is None and entry._optional("no_such_module") is None
    assert entry._optional("vertexloom.queries") is not None
