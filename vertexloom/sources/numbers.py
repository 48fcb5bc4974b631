"""Whole numbers as a graph: what their names are, what they divide and are divided by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.schema import Schema
from vertexloom.sources.spec import Get, Source

_NUMBER = "vowelsInName: [String]  value: Int  name: String  multiple(max: Int!): [Composite!]  successor: Number!  predecessor: Number"
SDL = f"""
schema {{ query: RootSchemaQuery }}
type RootSchemaQuery {{
  Four: Composite!  Two: Prime!  One: Number!  Zero: Number!
  NumberImplicitNullDefault(max: Int!, min: Int): [Number!]
  Number(max: Int!, min: Int! = 0): [Number!]
}}
interface Named {{ name: String }}
interface Number implements Named {{ {_NUMBER} }}
type Neither implements Number & Named {{ {_NUMBER} }}
type Prime implements Number & Named {{ {_NUMBER} }}
type Composite implements Number & Named {{ {_NUMBER}  divisor: [Number!]!  primeFactor: [Prime!]! }}
type Letter implements Named {{ name: String }}
"""
NAMES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()


def _upto(low: Column, high: Column) -> Column:
    """low, low + 1, ... high; empty if there is none."""
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))


def _name(get: Get) -> Column:
    names = F.array(*map(F.lit, NAMES))
    return F.when(get("value").between(0, len(NAMES) - 1), F.try_element_at(names, (get("value") + 1).cast("int")))


def _proper(v: Column) -> Column:
    one = F.lit(1).cast("long")
    return F.filter(_upto(one, v - 1), lambda d: v % d == 0)


def _is_prime(v: Column) -> Column:
    two = F.lit(2).cast("long")
    root = F.floor(F.sqrt(F.greatest(v, F.lit(0)).cast("double")))
    return (v >= 2) & ~F.exists(_upto(two, root), lambda d: v % d == 0)


def _typename(get: Get) -> Column:
    v = get("value")
    return F.when(v < 2, "Neither").when(_is_prime(v), "Prime").otherwise("Composite")


def _values(a: Column) -> Column:
    return F.transform(a, lambda x: F.struct(x.alias("value")))


def _multiples(get: Get, max: int) -> Column:
    v = get("value")
    first = F.when(_is_prime(v), F.lit(2)).otherwise(F.lit(1)).cast("long")
    return F.when(v >= 2, _values(F.transform(_upto(first, F.lit(max).cast("long")), lambda k: k * v))).otherwise(_values(F.array().cast("array<bigint>")))


def numbers_source(spark: SparkSession) -> Source:
    def span(raw: DataFrame, min: int | None = 0, max: int = 0) -> DataFrame:
        low = 0 if min is None else min
        return spark.range(low, max + 1 if max >= low else low).select(F.col("id").alias("value"))

    def fixed(n: int):
        return lambda raw: span(raw, n, n)

    vowels = lambda get: F.filter(F.split(_name(get), ""), lambda c: c.isin(*"aeiou"))
    s = Source(spark, Schema(SDL))
    s.vertex("Number", spark.range(0).select(F.col("id").alias("value")), {"name": _name, "vowelsInName": vowels}, typename=_typename, order=["value"])
    s.vertex("Letter", spark.range(0).select(F.lit("").alias("name")))
    for name, rows in {"Number": span, "NumberImplicitNullDefault": span, "Zero": fixed(0), "One": fixed(1), "Two": fixed(2), "Four": fixed(4)}.items():
        s.root(name, rows)
    s.edge_array("Number", "predecessor", lambda get: F.when(get("value") > 0, _values(F.array(get("value") - 1))), ["value"])
    s.edge_array("Number", "successor", lambda get: _values(F.array(get("value") + 1)), ["value"])
    s.edge_array("Number", "multiple", _multiples, ["value"])
    s.edge_array("Composite", "divisor", lambda get: _values(_proper(get("value"))), ["value"])
    s.edge_array("Composite", "primeFactor", lambda get: _values(F.filter(_proper(get("value")), _is_prime)), ["value"])
    return s
