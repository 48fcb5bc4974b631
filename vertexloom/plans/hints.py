"""What a query will ask of a vertex, for sources that fetch rather than scan.

A starting point or edge function that takes a parameter ``hints`` gets these, and an
edge function that takes ``starts`` the keys and tagged values that it is asked for.
Tables need none of it: there the same facts reach the scan as pushed filters and
pruned columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from vertexloom.plans import ir


@dataclass(frozen=True)
class Candidates:
    """The values a property may have: some of a finite set, or those of a range; null only if ``nulls``.

    ``low`` and ``high`` are (value, whether it is included), or None where open.
    """

    values: tuple | None = None
    low: tuple[object, bool] | None = None
    high: tuple[object, bool] | None = None
    nulls: bool = True
    without: tuple = ()

    @property
    def impossible(self) -> bool:
        if self.values is not None:
            return not self.values
        if self.low and self.high and not self.nulls:
            a, b = self.low[0], self.high[0]
            return a > b or (a == b and not (self.low[1] and self.high[1]))
        return False

    @property
    def single(self):
        """The one possible value in a tuple, or None."""
        return self.values if self.values is not None and len(self.values) == 1 else None

    def allows(self, v) -> bool:
        if self.values is not None and v not in self.values:
            return False
        if v is None:
            return self.nulls and v not in self.without
        if v in self.without:
            return False
        return (self.low is None or v > self.low[0] or (self.low[1] and v == self.low[0])) and (self.high is None or v < self.high[0] or (self.high[1] and v == self.high[0]))

    def narrowed(self, op: str, value) -> Candidates:
        """With one more filter."""
        c = self
        match op:
            case "=":
                c = self._among((value,))
            case "one_of":
                c = self._among(tuple(dict.fromkeys(value)))
            case "is_null":
                c = self._among((None,))
            case "is_not_null":
                c = Candidates(self.values, self.low, self.high, False, self.without)
            case "!=":
                c = Candidates(self.values, self.low, self.high, self.nulls and value is not None, (*self.without, value))
            case "not_one_of":
                for v in value:
                    c = c.narrowed("!=", v)
            case ">" | ">=":
                bound = (value, op == ">=")
                tighter = self.low is None or value > self.low[0] or (value == self.low[0] and not bound[1])
                c = Candidates(self.values, bound if tighter else self.low, self.high, False, self.without)
            case "<" | "<=":
                bound = (value, op == "<=")
                tighter = self.high is None or value < self.high[0] or (value == self.high[0] and not bound[1])
                c = Candidates(self.values, self.low, bound if tighter else self.high, False, self.without)
        if c.values is not None:
            c = Candidates(tuple(v for v in c.values if c.allows(v)), c.low, c.high, c.nulls, c.without)
        return c

    def _among(self, values: tuple) -> Candidates:
        kept = values if self.values is None else tuple(v for v in self.values if v in values)
        return Candidates(kept, self.low, self.high, self.nulls, self.without)


@dataclass(frozen=True)
class Tagged:
    """A property is compared with a tag; ``name`` is the column that holds the tag's values where starts are handed over."""

    property: str
    op: str
    name: str
    ref: ir.Ref


@dataclass(frozen=True)
class EdgeHints:
    """An edge that the query follows, and what it asks of the vertices there."""

    name: str
    parameters: dict[str, object]
    optional: bool
    depth: int  # of a recursion, 0 if it is none
    fold: bool
    mandatory: bool  # every result follows it at least once
    far: VertexHints


@dataclass(frozen=True)
class VertexHints:
    """``required`` are the properties the query reads; ``candidates`` hold only filters that always apply, ``tags`` those with values that are known while it runs."""

    type_name: str
    coerced_from: str | None
    required: frozenset[str]
    candidates: dict[str, Candidates] = field(default_factory=dict)
    tags: tuple[Tagged, ...] = ()
    edges: tuple[EdgeHints, ...] = ()

    @property
    def mandatory_edges(self) -> tuple[str, ...]:
        return tuple(e.name for e in self.edges if e.mandatory)

    def edges_named(self, name: str) -> tuple[EdgeHints, ...]:
        return tuple(e for e in self.edges if e.name == name)

    def first_edge(self, name: str) -> EdgeHints | None:
        return next(iter(self.edges_named(name)), None)


def vertex_hints(v: ir.Vertex, component: ir.Component, needed: dict[int, set[str]], arguments: dict, binding: bool, needs_element) -> VertexHints:
    """``binding`` is false below optional or recursive edges, where a filter may not apply."""
    known: dict[str, Candidates] = {}
    tags: list[Tagged] = []
    for p in v.filters if binding else ():
        if not isinstance(p.left, ir.PropertyRef):
            continue
        if isinstance(p.right, ir.TagRef):
            tags.append(Tagged(p.left.name, p.op, f"tag{len(tags)}", p.right.ref))
        else:
            value = arguments[p.right.name] if p.right else None
            known[p.left.name] = known.get(p.left.name, Candidates()).narrowed(p.op, value)
    edges = []
    for s in component.steps:
        if s.from_vid != v.vid:
            continue
        fold = isinstance(s, ir.Fold)
        inside = s.component if fold else component
        plain = not fold and not s.optional and not s.recursion
        far = vertex_hints(inside.vertices[s.to_vid], inside, needed, arguments, fold or (binding and plain), needs_element)
        edges.append(EdgeHints(s.name, s.parameters, not fold and s.optional, s.recursion.depth if not fold and s.recursion else 0, fold, needs_element(s) if fold else plain, far))
    return VertexHints(v.type_name, v.coerced_from, frozenset(needed[v.vid]), known, tuple(tags), tuple(edges))
