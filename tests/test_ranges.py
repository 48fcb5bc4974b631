"""Comparisons by order with a tag, where many rows share a key."""

from __future__ import annotations

import math
import operator

import pytest
from pyspark.sql import functions as F

from vertexloom import api
from vertexloom.operators import ranges
from vertexloom.queries import QUERIES
from vertexloom.schema import Schema
from vertexloom.sources.spec import Source
from vertexloom.syntax import shorthand

SDL = """
schema { query: Query }
type Query { A: [A!]! }
type A { id: Int!  x: Float  up: H  peer: P }
type H { key: Int!  b: [B!] }
type B { id: Int!  y: Float  good: Int! }
type P { x: Float }
"""
NAN = float("nan")
OPS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
A = [(i, k, x, p) for i, (k, x, p) in enumerate([(1, 3.0, 1), (1, None, 2), (1, NAN, 9), (2, 0.0, 1), (2, -0.0, None), (3, 1.0, 2), (None, 2.0, 1), (1, 3.0, 3), (1, -5.0, 3)])]
B = [(i, k, y, i % 3) for i, (k, y) in enumerate([(1, 1.0), (1, 3.0), (1, 3.0), (1, NAN), (1, None), (1, 7.5), (2, 0.0), (2, -0.0), (2, -1.0), (None, 4.0), (1, 2.0), (1, -6.0)])]
P = {1: 2.0, 2: None, 3: 3.0}


def rank(v):
    return (1, 0.0) if math.isnan(v) else (0, v)


def meets(op, y, x):
    return x is not None and y is not None and OPS[op](rank(y), rank(x))


@pytest.fixture(scope="module")
def graph(spark):
    s = Source(spark, Schema(SDL))
    s.vertex("A", spark.createDataFrame(A, "id bigint, hub bigint, x double, pid bigint"), order=["id"])
    s.vertex("H", spark.createDataFrame([(1,), (2,), (3,)], "key bigint"), order=["key"])
    s.vertex("B", spark.createDataFrame(B, "id bigint, hub int, y double, good bigint"), order=["id"])
    s.vertex("P", spark.createDataFrame(list(P.items()), "pid bigint, x double"), order=["pid"])
    s.root("A")
    s.edge_keys("A", "up", [("hub", "key")])
    s.edge_keys("H", "b", [("key", "hub")])
    s.edge_keys("A", "peer", [("pid", "pid")])
    return s


def run(graph, text, **arguments):
    return [tuple(r) for r in api.execute_query(graph, shorthand(text), arguments).collect()]


def found(op, a, good=(0, 1, 2)):
    return [b[0] for b in B if a[1] is not None and b[1] == a[1] and b[3] in good and meets(op, b[2], a[2])]


@pytest.mark.parametrize("op", OPS)
def test_pairs(graph, monkeypatch, op):
    monkeypatch.setattr(ranges, "BLOCK", 2)
    got = run(graph, f'{{ A {{ id @output x @tag(name: "t") up {{ b {{ other: id @output good ?(!= $bad) y ?({op} %t) }} }} }} }}', bad=2)
    assert sorted(got) == sorted((a[0], b) for a in A for b in found(op, a, (0, 1)))


@pytest.mark.parametrize("op", OPS)
def test_lists(graph, monkeypatch, op):
    monkeypatch.setattr(ranges, "BLOCK", 2)
    got = run(graph, f'{{ A {{ id @output x @tag(name: "t") up {{ b @fold {{ other: id @output y ?({op} %t) }} }} }} }}')
    assert sorted(got) == sorted((a[0], found(op, a)) for a in A if a[1])


def test_pairs_are_made_by_all_tasks(spark, tiny):
    df = QUERIES["tag_theta"](spark, tiny)
    assert df.select(F.spark_partition_id().alias("p")).distinct().count() > 1


@pytest.mark.parametrize("op", OPS)
def test_counts(graph, op):
    text = f'{{ A {{ id @output x @tag(name: "t") up {{ b @fold &count %s {{ y ?({op} %%t) good ?(!= $bad) }} }} }} }}'
    want = {a[0]: len(found(op, a, (0, 1))) for a in A if a[1]}
    assert sorted(run(graph, text % '@output(name: "n")', bad=2)) == sorted(want.items())
    assert sorted(run(graph, text % '?(>= $n)', bad=2, n=1)) == sorted((i,) for i, n in want.items() if n)
    assert sorted(run(graph, text % '?(= $n)', bad=2, n=0)) == sorted((i,) for i, n in want.items() if not n)
    assert sorted(run(graph, text % '?(>= $n) @output(name: "n")', bad=2, n=2)) == sorted((i, n) for i, n in want.items() if n >= 2)


@pytest.mark.parametrize("op", OPS)
def test_counts_by_a_tag_that_may_be_absent(graph, op):
    got = run(graph, f'{{ A {{ id @output peer @optional {{ x @tag(name: "t") }} up {{ b @fold &count @output(name: "n") {{ y ?({op} %t) }} }} }} }}')
    assert sorted(got) == sorted((a[0], sum(b[1] == a[1] and (a[3] not in P or meets(op, b[2], P[a[3]])) for b in B)) for a in A if a[1])


def test_counts_make_no_pairs(spark, tiny):
    larger = tiny.replace("sf0.001", "sf0.01")
    rows = api.trace(QUERIES["fold_imported_tag"](spark, larger))
    read = sum(spark.read.parquet(f"{larger}/{t}.parquet").count() for t in ("supplier", "customer", "nation"))
    assert max(n for _, _, n in rows if n is not None) <= read
