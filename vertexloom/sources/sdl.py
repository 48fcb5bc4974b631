"""Build schema texts from short declarations, write source skeletons, and infer schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vertexloom.plans.directives import Node, query_tree
from vertexloom.plans.frontend import TYPENAME
from vertexloom.schema import Schema
from vertexloom.syntax import parse_query


def vertex_sdl(name: str, implements: str = "", interface: bool = False, edges: str = "", **properties: str) -> str:
    """A type whose properties are given by scalar type, e.g. ``Int="id score?"``; ``?`` marks nullable ones."""
    fields = [f"{p.rstrip('?')}: {kind}{'' if p.endswith('?') else '!'}" for kind, names in properties.items() for p in names.split()]
    parents = f" implements {implements}" if implements else ""
    return f"{'interface' if interface else 'type'} {name}{parents} {{ {' '.join([*fields, edges])} }}"


def schema_sdl(roots: str, *types: str, query: str = "RootSchemaQuery") -> str:
    return "\n".join([f"schema {{ query: {query} }}", f"type {query} {{ {roots} }}", *types])


def skeleton(schema: Schema) -> str:
    """Python text that declares a source for a schema, with the tables and keys left to fill in."""
    out = ["from vertexloom.schema import Schema", "from vertexloom.sources.spec import Source", "", "", "def make_source(spark, sdl, tables):", "    s = Source(spark, Schema(sdl))"]
    for t in schema.vertex_types.values():
        if t.kind == "type":
            own = [f.name for f in t.fields if not schema.is_edge(f)]
            out.append(f"    s.vertex({t.name!r}, tables[{t.name!r}])  # columns: {', '.join(own)}")
    for f in schema.types[schema.query_type].fields:
        given = "".join(f", {p.name}" for p in f.parameters)
        out.append(f"    s.root({f.name!r}" + (f", lambda raw{given}: raw)  # narrow by {given[2:]}" if given else ")"))
    for t in schema.vertex_types.values():
        inherited = {f.name for p in t.implements for f in schema.types[p].fields}
        for f in t.fields:
            if schema.is_edge(f) and f.name not in inherited:
                out.append(f"    s.edge_keys({t.name!r}, {f.name!r}, [('TODO', 'TODO')])  # to {f.type.name}")
    return "\n".join([*out, "    return s", ""])


def _scalar(kind: T.DataType) -> str | None:
    match kind:
        case T.ByteType() | T.ShortType() | T.IntegerType() | T.LongType():
            return "Int"
        case T.FloatType() | T.DoubleType():
            return "Float"
        case T.StringType():
            return "String"
        case T.BooleanType():
            return "Boolean"
        case T.ArrayType():
            inner = _scalar(kind.elementType)
            return inner and f"[{inner}{'' if kind.containsNull else '!'}]"
    return None


def infer_from_frames(**frames: DataFrame) -> str:
    """A schema with a type for each frame, its scalar columns as properties, and a starting edge of the same name."""
    types = []
    for name, df in frames.items():
        fields = [f"{f.name}: {s}{'' if f.nullable else '!'}" for f in df.schema.fields if (s := _scalar(f.dataType))]
        types.append(f"type {name} {{ {' '.join(fields)} }}")
    return schema_sdl(" ".join(f"{n}: [{n}!]!" for n in frames), *types)


def infer_from_query(text: str) -> str:
    """The least schema under which a query is well-formed: vertices where it has selections, properties elsewhere."""
    types: dict[str, dict[str, str]] = {}

    def scalar(node: Node) -> str:
        ops = {f.op for f in node.filters}
        if ops & {"contains", "not_contains"}:
            return "[String]"
        return "String" if any("prefix" in o or "suffix" in o or "substring" in o or "regex" in o for o in ops) else "Int" if ops & {"<", "<=", ">", ">="} else "String"

    def given(value) -> str:
        kinds = {bool: "Boolean", int: "Int", float: "Float", str: "String"}
        return f"[{given(value[0]) if value else 'String'}]" if isinstance(value, list) else kinds.get(type(value), "String")

    def visit(node: Node, owner: str) -> None:
        if not node.children and not node.fold and not node.recurse:
            if node.name != TYPENAME:
                types[owner][node.name] = f"{node.name}: {scalar(node)}"
            return
        target = owner if node.recurse else f"{owner}_{node.name}" if owner != "Query" else node.name
        parameters = ", ".join(f"{k}: {given(v)}" for k, v in node.arguments.items())
        types[owner][node.name] = f"{node.name}{f'({parameters})' if parameters else ''}: [{target}]"
        types.setdefault(target, {})
        if node.coerced_to:
            types.setdefault(node.coerced_to, {})
            below[node.coerced_to] = target
            target = node.coerced_to
        for child in node.children:
            visit(child, target)

    below: dict[str, str] = {}
    types["Query"] = {}
    visit(query_tree(parse_query(text)), "Query")
    roots = " ".join(types.pop("Query").values())
    out = []
    for name, fields in types.items():
        parent = below.get(name)
        own = {**types[parent], **fields} if parent else fields
        body = " ".join(own.values()) or "_unused: String"
        if parent and not types[parent]:
            body += " _unused: String"
        out.append(f"{'interface' if name in below.values() else 'type'} {name}{f' implements {parent}' if parent else ''} {{ {body} }}")
    return schema_sdl(roots, *out, query="Query")
