"""Bind arguments, and choose how folds are joined."""

from __future__ import annotations

from vertexloom.errors import ArgumentError, raise_all
from vertexloom.functions import regex
from vertexloom.plans import ir


def bind(query: ir.Query, arguments: dict[str, object]) -> dict[str, object]:
    """The arguments, once they are known to fit the variables."""
    errors: list[ArgumentError] = []
    if missing := sorted(query.variables.keys() - arguments):
        errors.append(ArgumentError("MissingArguments", missing))
    if unused := sorted(arguments.keys() - query.variables.keys()):
        errors.append(ArgumentError("UnusedArguments", unused))
    for name, kind in query.variables.items():
        if name in arguments and not kind.accepts(arguments[name]):
            errors.append(ArgumentError("ArgumentTypeError", name, kind, arguments[name]))
    raise_all(errors)
    for p in predicates(query.component):
        if p.op in ("regex", "not_regex") and isinstance(p.right, ir.VariableRef):
            try:
                regex.java(arguments[p.right.name])
            except ValueError as e:
                raise ArgumentError("InvalidPattern", p.right.name, arguments[p.right.name], e) from None
    return {n: list(v) if isinstance(v, tuple) else v for n, v in arguments.items()}


def predicates(component: ir.Component):
    for v in component.vertices.values():
        yield from v.filters
    for f in component.folds():
        yield from f.filters
        yield from predicates(f.component)


def counts_used(component: ir.Component) -> set[int]:
    """Folds whose count some tag carries elsewhere."""
    return {p.right.ref.eid for p in predicates(component) if isinstance(p.right, ir.TagRef) and isinstance(p.right.ref, ir.CountRef)}


def _bounds(fold: ir.Fold, arguments: dict[str, object]) -> tuple[bool, bool]:
    """Whether the count filters with constants demand an element, and whether they say just that or just the opposite."""
    some = none = False
    for p in fold.filters:
        if not isinstance(p.right, ir.VariableRef):
            continue
        v = arguments[p.right.name]
        some |= (p.op == ">=" and v >= 1) or (p.op == ">" and v >= 0) or (p.op == "=" and v is not None and v >= 1) or (p.op == "one_of" and all(x is not None and x >= 1 for x in v)) or (p.op == "!=" and v == 0)
        none |= (p.op == "=" and v == 0) or (p.op == "<" and v == 1) or (p.op == "<=" and v == 0)
    return some, none


def fold_join(fold: ir.Fold, arguments: dict[str, object], used: set[int], maybe_absent: bool) -> str:
    """``semi`` or ``anti`` where only existence matters, ``inner`` where a parent needs an element, else ``left``."""
    if maybe_absent:
        return "left"
    some, none = _bounds(fold, arguments)
    seen = fold.component.all_outputs() or fold.outputs or fold.eid in used
    if len(fold.filters) == 1 and not seen:
        p = fold.filters[0]
        v = arguments[p.right.name] if isinstance(p.right, ir.VariableRef) else None
        if none:
            return "anti"
        if (p.op, v) in ((">=", 1), (">", 0), ("!=", 0)):
            return "semi"
    return "inner" if some else "left"
