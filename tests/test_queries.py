"""Every registered query of the graph engine against its SQL."""

from __future__ import annotations

import json
import math

import duckdb
import pytest

from vertexloom.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(tiny):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    return v


def canonical(columns, rows) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(json.dumps([plain(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tiny, duck, name):
    df = QUERIES[name](spark, tiny)
    got = df.collect()
    if name not in SQL:
        assert got
        return
    want = duck.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical(df.columns, got) == canonical(columns, want.fetchall())
