"""Run queries: ``execute_query(source, query, arguments)`` returns a DataFrame."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import fields, is_dataclass
from typing import TypeVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.operators.compiler import Compiler
from vertexloom.plans import ir
from vertexloom.plans.frontend import compile_query
from vertexloom.sources.spec import Source
from vertexloom.types import Type

T = TypeVar("T")


def prepare(source: Source, query: str) -> ir.Query:
    """Parse and check a query once, to run it with several sets of arguments."""
    return compile_query(source.schema, query)


def execute_query(source: Source, query: str | ir.Query, arguments: dict[str, object] | None = None) -> DataFrame:
    """One column an output, in order of name; nothing runs until the caller acts on it."""
    checked = prepare(source, query) if isinstance(query, str) else query
    return Compiler(source, checked, arguments or {}).dataframe()


def output_types(source: Source, query: str) -> dict[str, Type]:
    return prepare(source, query).output_types


def rows(df: DataFrame) -> Iterator[dict[str, object]]:
    """Rows one by one, fetched a partition at a time."""
    for r in df.toLocalIterator():
        yield r.asDict(recursive=True)


def as_structs(df: DataFrame, kind: type[T]) -> Iterator[T]:
    """Rows as instances of a dataclass whose fields are outputs."""
    if not is_dataclass(kind):
        raise TypeError(f"{kind} is no dataclass")
    names = [f.name for f in fields(kind)]
    if missing := set(names) - set(df.columns):
        raise ValueError(f"the query has no output {sorted(missing)}")
    for r in df.select(*names).toLocalIterator():
        yield kind(**r.asDict(recursive=True))


def as_json(df: DataFrame) -> DataFrame:
    """One string column with each row as a JSON object, nulls included."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def explain(df: DataFrame) -> str:
    """The plan that Spark chose, as text."""
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def trace(df: DataFrame) -> list[tuple[int, str, int | None]]:
    """Run the query and tell how many rows each of its operations put out: (depth, operation, rows), from the result down; None where Spark doesn't count."""
    query = df._jdf.queryExecution()
    query.toRdd().count()
    out: list[tuple[int, str, int | None]] = []

    def walk(node, depth: int) -> None:
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan(), depth)
        inner = node.plan() if name.startswith(("ShuffleQueryStage", "BroadcastQueryStage", "ResultQueryStage", "TableCacheQueryStage")) else None
        if inner is not None:
            return walk(inner, depth)
        metrics = node.metrics()
        rows = metrics.get("numOutputRows")
        out.append((depth, name, rows.get().value() if rows.isDefined() else None))
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i), depth + 1)

    walk(query.executedPlan(), 0)
    return out
