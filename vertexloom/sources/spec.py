"""How a schema's vertices and edges are found in tables.

A source is declared, not run: vertex types are DataFrames, edges are join keys,
computed arrays or functions that return a DataFrame.  Queries over it become one
plan, so filters and columns reach the scans.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.errors import SourceError
from vertexloom.plans.hints import VertexHints
from vertexloom.schema import Schema
from vertexloom.types import Type

#: Looks up a raw column of a vertex.
Get = Callable[[str], Column]


@dataclass(frozen=True)
class Mapped:
    """A property that follows from one raw column, larger where that is larger, with the way back.

    ``inverse(value, type)`` is what a constant stands for among raw values of a type,
    or None if it can't be said; so constants are converted, not the column, and reach the scan.
    """

    raw: str
    forward: Callable[[Column], Column]
    inverse: Callable[[object, str], Column | None]

    def __call__(self, get: Get) -> Column:
        return self.forward(get(self.raw))


Property = str | Callable[[Get], Column]
TYPENAME = "__typename"


@dataclass
class VertexTable:
    """``rows`` may be a function, called once if a query needs the table."""

    rows: DataFrame | Callable[[], DataFrame]
    properties: dict[str, Property]
    typename: Callable[[Get], Column] | None
    order: tuple[str, ...]

    @property
    def raw(self) -> DataFrame:
        if not isinstance(self.rows, DataFrame):
            self.rows = self.rows()
        return self.rows


@dataclass
class EdgeKeys:
    """Vertices whose ``on`` columns equal those of the start."""

    on: tuple[tuple[str, str], ...]
    where: Callable[..., Column] | None = None
    order: tuple[str, ...] | None = None

    @property
    def uses(self) -> tuple[str, ...]:
        return tuple(a for a, _ in self.on)


@dataclass
class EdgeArray:
    """Vertices given by an array of structs of raw columns, worked out from the start's own columns."""

    array: Callable[..., Column]
    uses: tuple[str, ...]


@dataclass
class EdgeTable(EdgeKeys):
    """As keys, but the far side is whatever a function returns: raw columns of the target.

    A function with a parameter ``starts`` gets the distinct keys that the query arrives
    with (named as the start's columns), and beside them, under the names in ``hints.tags``, the tagged
    values that neighbours are compared with: enough to fetch what is asked for and no more.
    """

    rows: Callable[..., DataFrame] | None = None


@dataclass
class Root:
    rows: Callable[..., DataFrame] | None


@dataclass
class Source:
    spark: SparkSession
    schema: Schema
    tables: dict[str, VertexTable] = field(default_factory=dict)
    edges: dict[tuple[str, str], EdgeKeys | EdgeArray] = field(default_factory=dict)
    roots: dict[str, Root] = field(default_factory=dict)

    # declaring

    def vertex(self, type_name: str, raw: DataFrame | Callable[[], DataFrame], properties: dict[str, Property] | None = None, typename: Callable[[Get], Column] | None = None, order: Sequence[str] = ()) -> Source:
        """``properties`` need to name only those that aren't raw columns of the same name."""
        self.tables[type_name] = VertexTable(raw, properties or {}, typename, tuple(order))
        return self

    def root(self, name: str, rows: Callable[..., DataFrame] | None = None) -> Source:
        """``rows(raw, **parameters)`` narrows or makes the raw rows; without it all vertices are taken."""
        self.roots[name] = Root(rows)
        return self

    def _edge(self, types: str | Iterable[str], name: str, edge) -> Source:
        for t in [types] if isinstance(types, str) else types:
            self.edges[t, name] = edge
        return self

    def edge_keys(self, types, name: str, on: Sequence[tuple[str, str]], where: Callable[..., Column] | None = None, order: Sequence[str] | None = None) -> Source:
        """``where(get, **parameters)`` restricts which edges exist."""
        return self._edge(types, name, EdgeKeys(tuple(on), where, None if order is None else tuple(order)))

    def edge_array(self, types, name: str, array: Callable[..., Column], uses: Sequence[str]) -> Source:
        return self._edge(types, name, EdgeArray(array, tuple(uses)))

    def edge_table(self, types, name: str, rows: Callable[..., DataFrame], on: Sequence[tuple[str, str]], order: Sequence[str] | None = None) -> Source:
        return self._edge(types, name, EdgeTable(tuple(on), None, None if order is None else tuple(order), rows))

    # reading

    def find_edge(self, type_name: str, name: str) -> EdgeKeys | EdgeArray:
        for t in [type_name, *self.schema.types[type_name].implements]:
            if (t, name) in self.edges:
                return self.edges[t, name]
        below = [self.edges[t, name] for t in self.schema.concrete(type_name) if (t, name) in self.edges]
        if below and all(e is below[0] for e in below):
            return below[0]
        raise SourceError("UnknownEdge", type_name, name)

    def table_of(self, type_name: str) -> tuple[VertexTable, str] | None:
        for t in [type_name, *self.schema.types[type_name].implements]:
            if t in self.tables:
                return self.tables[t], t
        return None

    def column(self, type_name: str, name: str, get: Get) -> Column:
        """A property, raw column or the type name of a vertex whose raw columns ``get`` finds."""
        table, _ = self.table_of(type_name)
        if name == TYPENAME:
            return table.typename(get) if table.typename else F.lit(type_name)
        made = table.properties.get(name, name)
        out = get(made) if isinstance(made, str) else made(get)
        f = self._declared(type_name, name)
        return out.cast(f.type.spark()) if f else out

    def named(self, type_name: str, name: str, get: Get, alias: str) -> Column:
        """``column`` under another name; said as one expression where it is a raw column, for each call to Spark takes its time."""
        table, _ = self.table_of(type_name)
        made = table.properties.get(name, name)
        if name == TYPENAME or not isinstance(made, str):
            return self.column(type_name, name, get).alias(alias)
        f = self._declared(type_name, name)
        return F.expr(f"CAST({quoted(made)} AS {f.type.spark()}) AS {quoted(alias)}" if f else f"{quoted(made)} AS {quoted(alias)}")

    def _declared(self, type_name: str, name: str):
        f = next((x for t in [type_name, *self.schema.subtypes(type_name)] if (x := self.schema.field(t, name))), None)
        return f if f is not None and not self.schema.is_edge(f) else None

    def order_of(self, type_name: str) -> tuple[str, ...]:
        found = self.table_of(type_name)
        return found[0].order if found else ()

    @staticmethod
    def narrowed(raw: DataFrame, table: VertexTable, hints: VertexHints | None) -> DataFrame:
        """Without rows that filters of ``hints`` on mapped properties would drop."""
        for name, c in hints.candidates.items() if hints else ():
            made = table.properties.get(name)
            if not isinstance(made, Mapped) or made.raw not in raw.columns:
                continue
            kind, column = raw.schema[made.raw].dataType.simpleString(), raw[made.raw]
            same = [made.inverse(v, kind) for v in c.values or () if v is not None]
            if c.values and len(same) == len(c.values) and all(v is not None for v in same):
                raw = raw.where(reduce(lambda a, b: a | b, [column == v for v in same]))
            if c.low and (v := made.inverse(c.low[0], kind)) is not None:
                raw = raw.where(column >= v)
            if c.high and (v := made.inverse(c.high[0], kind)) is not None:
                raw = raw.where(column <= v)
        return raw

    def frame(self, type_name: str, names: Iterable[str], prefix: str = "", raw: DataFrame | None = None, hints: VertexHints | None = None) -> DataFrame:
        """All vertices of a type (or those of ``raw``) with the named columns."""
        names = sorted(names)
        found = self.table_of(type_name)
        if found:
            table, own = found
            raw = self.narrowed(table.raw if raw is None else raw, table, hints)
            get = lambda n: raw[n]
            if own != type_name and table.typename:
                raw = raw.where(table.typename(get).isin(self.schema.concrete(type_name)))
            view = own if table.typename else type_name
            return raw.select(*[self.named(view, n, get, prefix + n) for n in names])
        parts = []
        for t in self.schema.concrete(type_name):
            found = self.table_of(t)
            if found is None:
                raise SourceError("UnknownVertexType", t)
            table = found[0]
            have = [n for n in names if n == TYPENAME or n in table.properties or n in table.raw.columns]
            parts.append(self.frame(t, have, prefix))
        if not parts:
            raise SourceError("UnknownVertexType", type_name)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        missing = [n for n in names if prefix + n not in out.columns]
        return out.select("*", *[F.lit(None).cast("string").alias(prefix + n) for n in missing])

    def start(self, name: str, type_name: str, parameters: dict[str, object], names: Iterable[str], prefix: str, hints: VertexHints | None = None) -> DataFrame:
        root = self.roots.get(name)
        if root is None:
            raise SourceError("UnknownStartingEdge", name)
        if root.rows is None:
            return self.frame(type_name, names, prefix, hints=hints)
        found = self.table_of(type_name)
        if found is None:
            raise SourceError("StartingEdgeNeedsTable", name, type_name)
        return self.frame(type_name, names, prefix, root.rows(found[0].raw, **parameters, **asked(root.rows, hints)), hints)

    def joined_with(self, schema: Schema, *others: Source) -> Source:
        """One source over several backends, under a schema that spans them; edges between them can be added."""
        out = Source(self.spark, schema, dict(self.tables), dict(self.edges), dict(self.roots))
        for o in others:
            out.tables |= o.tables
            out.edges |= o.edges
            out.roots |= o.roots
        return out


def quoted(name: str) -> str:
    """A column's name in an expression."""
    return f"`{name.replace('`', '``')}`"


def asked(rows: Callable, hints: VertexHints | None) -> dict[str, object]:
    """The hints, for a function that takes them."""
    return {"hints": hints} if hints is not None and takes(rows, "hints") else {}


def takes(rows: Callable, name: str) -> bool:
    return name in inspect.signature(rows).parameters


def check_source(source: Source) -> list[SourceError]:
    """Where a source falls short of its schema: types, properties, edges and starting edges that don't resolve."""
    out: list[SourceError] = []
    s = source.schema
    for t in s.vertex_types.values():
        if t.kind == "interface" and not s.concrete(t.name) and t.name not in source.tables:
            continue
        for f in t.fields:
            if s.is_edge(f):
                try:
                    edge = source.find_edge(t.name, f.name)
                    source.frame(t.name, edge.uses).schema  # noqa: B018
                    if isinstance(edge, EdgeTable):
                        if not takes(edge.rows, "starts") and not f.parameters:
                            hints = {"hints": VertexHints(f.type.name, None, frozenset())} if takes(edge.rows, "hints") else {}
                            rows = edge.rows(source.spark, **hints)
                            rows.select(*[b for _, b in edge.on]).schema  # noqa: B018
                    elif isinstance(edge, EdgeKeys):
                        source.frame(f.type.name, [b for _, b in edge.on]).schema  # noqa: B018
                except SourceError as e:
                    out.append(e)
                except Exception as e:  # the analyser's own words
                    out.append(SourceError("EdgeDoesNotResolve", t.name, f.name, str(e).split("\n")[0]))
                continue
            try:
                kind = source.frame(t.name, [f.name]).schema[0].dataType.simpleString()
                if kind != Type(f.type.name, f.type.nullable).spark():
                    out.append(SourceError("PropertyHasWrongType", t.name, f.name, kind, f.type))
            except SourceError as e:
                out.append(e)
            except Exception as e:
                out.append(SourceError("PropertyDoesNotResolve", t.name, f.name, str(e).split("\n")[0]))
    for f in s.types[s.query_type].fields:
        if f.name not in source.roots:
            out.append(SourceError("UnknownStartingEdge", f.name))
    return out
