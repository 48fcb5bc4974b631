"""Queries over a stream of root vertices.

Filters, coercions and required or optional edges to tables become a stream-static
join and run as they are.  Folds and recursion need whole inputs, so a query that has
them is run on each micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame

from vertexloom.api import execute_query, prepare
from vertexloom.plans import ir
from vertexloom.sources.spec import Source


def with_rows(source: Source, type_name: str, rows: DataFrame) -> Source:
    """The same source with other rows for one vertex type."""
    table = source.tables[type_name]
    return replace(source, tables=source.tables | {type_name: replace(table, rows=rows)})


def _row_by_row(c: ir.Component) -> bool:
    return all(isinstance(s, ir.Edge) and s.recursion is None for s in c.steps)


def stream_query(source: Source, type_name: str, rows: DataFrame, query: str, arguments: dict | None = None) -> DataFrame:
    """The query as a streaming DataFrame; ``rows`` are the stream's raw vertices of ``type_name``."""
    checked = prepare(source, query)
    if not _row_by_row(checked.component):
        raise ValueError("folds and recursion need whole inputs: use each_batch")
    return execute_query(with_rows(source, type_name, rows), checked, arguments)


def each_batch(source: Source, type_name: str, query: str, arguments: dict | None, sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``: runs the query over each micro-batch and hands the result to ``sink``."""
    checked = prepare(source, query)

    def run(batch: DataFrame, number: int) -> None:
        sink(execute_query(with_rows(source, type_name, batch), checked, arguments), number)

    return run
