"""From parsed syntax to a tree of fields with their directives."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from vertexloom.errors import ParseError
from vertexloom.schema import plain_value
from vertexloom.syntax import Directive, Document, Field, FragmentSpread, InlineFragment

UNARY = ("is_null", "is_not_null")
EQUALITY = ("=", "!=")
ORDER = ("<", "<=", ">", ">=")
LISTED = ("contains", "not_contains")
MEMBER = ("one_of", "not_one_of")
TEXT = tuple(no + op for op in ("regex", "has_suffix", "has_prefix", "has_substring") for no in ("", "not_"))
OPERATORS = (*UNARY, *EQUALITY, *ORDER, *LISTED, *MEMBER, *TEXT)
_WRONG = re.compile(r"[^A-Za-z0-9_]")


@dataclass(frozen=True)
class Filter:
    op: str
    operand: str | None  # $variable or %tag


@dataclass(frozen=True)
class Named:
    """An @output or @tag, with its name if it has one."""

    name: str | None


@dataclass
class Transform:
    op: str
    outputs: list[Named] = field(default_factory=list)
    tags: list[Named] = field(default_factory=list)
    filters: list[Filter] = field(default_factory=list)
    again: Transform | None = None


@dataclass
class Node:
    """A field of the query: the way to it and what is done there."""

    name: str
    alias: str | None
    position: tuple[int, int]
    arguments: dict[str, object]
    optional: bool = False
    recurse: int | None = None
    fold: bool = False
    fold_transform: Transform | None = None
    coerced_to: str | None = None
    filters: list[Filter] = field(default_factory=list)
    outputs: list[Named] = field(default_factory=list)
    tags: list[Named] = field(default_factory=list)
    transform: Transform | None = None
    children: list[Node] = field(default_factory=list)


@dataclass(frozen=True)
class _Mark:
    kind: str
    value: object
    position: tuple[int, int]


def _arguments(d: Directive, known: tuple[str, ...]) -> dict[str, tuple[object, tuple[int, int]]]:
    out = {}
    for name, value, position in d.arguments:
        if name not in known:
            raise ParseError("UnrecognizedDirectiveArgument", f"@{d.name}", name, position=position)
        if name in out:
            raise ParseError("DuplicatedDirectiveArgument", f"@{d.name}", name, position=position)
        out[name] = (value, position)
    return out


def _required(d: Directive, given: dict, name: str, kind: type):
    if name not in given:
        raise ParseError("MissingRequiredDirectiveArgument", f"@{d.name}", name, position=d.position)
    value, position = given[name]
    if not isinstance(value, kind) or isinstance(value, bool):
        raise ParseError("InappropriateTypeForDirectiveArgument", f"@{d.name}", name, position=position)
    return value, position


def _name(d: Directive) -> Named:
    given = _arguments(d, ("name",))
    if "name" not in given:
        return Named(None)
    value, position = _required(d, given, "name", str)
    if bad := sorted(set(_WRONG.findall(value))):
        raise ParseError("InvalidOutputName" if d.name == "output" else "InvalidTagName", value, bad, position=position)
    return Named(value)


def _filter(d: Directive) -> Filter:
    given = _arguments(d, ("op", "value"))
    op, position = _required(d, given, "op", str)
    if op not in OPERATORS:
        raise ParseError("UnsupportedFilterOperator", op, position=position)
    operands = []
    if "value" in given:
        value, position = given["value"]
        if isinstance(value, str):
            raise ParseError("FilterExpectsListNotString", op, value, position=position)
        operands, position = _required(d, given, "value", list)
        if any(not isinstance(x, str) for x in operands):
            raise ParseError("InappropriateTypeForDirectiveArgument", "@filter", "value", position=position)
    elif op not in UNARY:
        raise ParseError("MissingRequiredDirectiveArgument", "@filter", "value", position=d.position)
    if len(operands) != (op not in UNARY):
        raise ParseError("OtherError", f"{op} takes {int(op not in UNARY)} operands, not {len(operands)}", position=position)
    for x in operands:
        if x[:1] not in ("$", "%"):
            raise ParseError("InvalidFilterOperandName", x, "operands begin with $ or %", position=position)
        if not x[1:]:
            raise ParseError("InvalidFilterOperandName", x, "nothing follows the prefix", position=position)
        if _WRONG.search(x[1:]) or x[1].isdigit():
            raise ParseError("InvalidFilterOperandName", x, "names are letters, digits and underscores, and don't begin with a digit", position=position)
    return Filter(op, operands[0] if operands else None)


def _mark(d: Directive) -> _Mark:
    match d.name:
        case "filter":
            value = _filter(d)
        case "output" | "tag":
            value = _name(d)
        case "optional" | "fold":
            value = _arguments(d, ()) or None
        case "recurse":
            value, position = _required(d, _arguments(d, ("depth",)), "depth", int)
            if value < 1:
                raise ParseError("InappropriateTypeForDirectiveArgument", "@recurse", "depth", position=position)
        case "transform":
            value, position = _required(d, _arguments(d, ("op",)), "op", str)
            if value != "count":
                raise ParseError("UnsupportedTransformOperator", value, position=position)
        case _:
            raise ParseError("UnrecognizedDirective", d.name, position=d.position)
    return _Mark(d.name, value, d.position)


def _transform(op: str, rest: list[_Mark]) -> Transform:
    out = Transform(op)
    for i, m in enumerate(rest):
        match m.kind:
            case "filter":
                out.filters.append(m.value)
            case "output":
                out.outputs.append(m.value)
            case "tag":
                out.tags.append(m.value)
            case "transform":
                out.again = _transform(m.value, rest[i + 1 :])
                return out
            case _:
                raise ParseError("UnsupportedDirectivePosition", f"@{m.kind}", "after @transform", position=m.position)
    return out


def _way(node: Node, marks: list[_Mark]) -> None:
    """The directives that say how an edge is followed."""
    for i, m in enumerate(marks):
        match m.kind:
            case "optional" | "recurse":
                if getattr(node, m.kind):
                    raise ParseError("UnsupportedDuplicatedDirective", f"@{m.kind}", position=m.position)
                setattr(node, m.kind, m.value or True)
            case "transform":
                raise ParseError("UnsupportedDirectivePosition", "@transform", "before @fold", position=m.position)
            case "fold":
                node.fold = True
                rest = marks[i + 1 :]
                if rest and rest[0].kind == "fold":
                    raise ParseError("UnsupportedDuplicatedDirective", "@fold", position=rest[0].position)
                if rest and rest[0].kind != "transform":
                    raise ParseError("UnsupportedDirectivePosition", f"@{rest[0].kind}", "after @fold", position=rest[0].position)
                if rest:
                    node.fold_transform = _transform(rest[0].value, rest[1:])
                return


def _values(node: Node, marks: list[_Mark]) -> None:
    """The directives that act on the value or vertex itself."""
    for i, m in enumerate(marks):
        match m.kind:
            case "filter":
                node.filters.append(m.value)
            case "output":
                node.outputs.append(m.value)
            case "tag":
                node.tags.append(m.value)
            case "transform":
                node.transform = _transform(m.value, marks[i + 1 :])
                return


def _node(f: Field) -> Node:
    arguments: dict[str, object] = {}
    for name, value, position in f.arguments:
        if not plain_value(value):
            raise ParseError("InvalidFieldArgument", f.name, name, value, position=position)
        if name in arguments:
            raise ParseError("DuplicatedEdgeParameter", name, f.name, position=position)
        arguments[name] = value
    node = Node(f.name, f.alias, f.position, arguments)
    marks = [_mark(d) for d in f.directives]
    _way(node, marks)
    selections = f.selections
    for s in selections:
        if isinstance(s, FragmentSpread):
            raise ParseError("UnsupportedSyntax", "fragment spread", position=s.position)
    inner = next((s for s in selections if isinstance(s, InlineFragment)), None)
    if inner:
        if len(selections) > 1:
            raise ParseError("TypeCoercionWithSiblingFields", position=selections[1].position)
        if inner.directives:
            raise ParseError("UnsupportedDirectivePosition", f"@{inner.directives[0].name}", "on a type coercion", position=inner.directives[0].position)
        node.coerced_to, selections = inner.type_name, inner.selections
    _values(node, marks)
    for s in selections:
        if isinstance(s, FragmentSpread):
            raise ParseError("UnsupportedSyntax", "fragment spread", position=s.position)
        if isinstance(s, InlineFragment):
            raise ParseError("NestedTypeCoercion", position=s.position)
        node.children.append(_node(s))
    return node


def query_tree(doc: Document) -> Node:
    """The root field of a document that holds one query."""
    if doc.fragments:
        raise ParseError("DocumentContainsNonInlineFragments", position=doc.fragments[0][1])
    if not doc.operations:
        raise ParseError("OtherError", "no query found")
    if len(doc.operations) > 1:
        raise ParseError("MultipleOperationsInDocument", position=doc.operations[1].position)
    op = doc.operations[0]
    if op.kind != "query":
        raise ParseError("DocumentNotAQuery", position=op.position)
    if op.variables:
        raise ParseError("VariableDefinitionInQuery", position=op.position)
    if op.directives:
        raise ParseError("DirectiveNotInsideQueryRoot", op.directives[0].name, position=op.directives[0].position)
    if len(op.selections) > 1:
        raise ParseError("MultipleQueryRoots", position=op.selections[1].position)
    root = op.selections[0]
    if not isinstance(root, Field):
        raise ParseError("UnsupportedQueryRoot", "a fragment", position=root.position)
    if root.directives:
        raise ParseError("DirectiveNotInsideQueryRoot", root.directives[0].name, position=root.directives[0].position)
    return _node(root)
