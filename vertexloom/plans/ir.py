"""The checked form of a query."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from vertexloom.types import Type


@dataclass(frozen=True)
class PropertyRef:
    """A property of a visited vertex."""

    vid: int
    name: str
    type: Type

    @property
    def defined_at(self) -> int:
        return self.vid


@dataclass(frozen=True)
class CountRef:
    """The number of elements of a fold."""

    eid: int
    vid: int

    type = Type("Int", (False,))
    name = "count"

    @property
    def defined_at(self) -> int:
        return self.vid


Ref = PropertyRef | CountRef


@dataclass(frozen=True)
class VariableRef:
    name: str
    type: Type


@dataclass(frozen=True)
class TagRef:
    name: str
    ref: Ref


@dataclass(frozen=True)
class Predicate:
    op: str
    left: Ref
    right: VariableRef | TagRef | None


@dataclass
class Vertex:
    vid: int
    type_name: str
    coerced_from: str | None = None
    filters: list[Predicate] = field(default_factory=list)


@dataclass(frozen=True)
class Recursion:
    depth: int
    coerce_to: str | None


@dataclass
class Edge:
    eid: int
    from_vid: int
    to_vid: int
    name: str
    parameters: dict[str, object]
    optional: bool = False
    recursion: Recursion | None = None


@dataclass
class Fold:
    eid: int
    from_vid: int
    to_vid: int
    name: str
    parameters: dict[str, object]
    component: Component
    imported: list[Ref]
    filters: list[Predicate] = field(default_factory=list)
    outputs: list[str] = field(default_factory=list)  # of the count


@dataclass
class Component:
    root: int
    vertices: dict[int, Vertex] = field(default_factory=dict)
    steps: list[Edge | Fold] = field(default_factory=list)  # in order of eid
    outputs: dict[str, PropertyRef] = field(default_factory=dict)

    def folds(self) -> Iterator[Fold]:
        return (s for s in self.steps if isinstance(s, Fold))

    def all_outputs(self) -> list[str]:
        """Names put out here and in folds below."""
        out = list(self.outputs)
        for f in self.folds():
            out += f.outputs + f.component.all_outputs()
        return out


@dataclass
class Query:
    root_name: str
    root_parameters: dict[str, object]
    component: Component
    variables: dict[str, Type]
    output_types: dict[str, Type]
