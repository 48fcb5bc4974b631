"""Types of properties, parameters and variables: a name under list levels, each level nullable or not."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, replace

BUILTIN = ("Boolean", "Float", "ID", "Int", "String")
MAX_LISTS = 30
LOW, HIGH = -(1 << 63), (1 << 64) - 1
_TEXT = re.compile(r"(?P<open>\[*)(?P<name>[A-Za-z_][A-Za-z0-9_]*)(?P<close>[!\]]*)")


@dataclass(frozen=True)
class Type:
    """``nullable`` has one flag a level, the outermost first; the last is the name's own."""

    name: str
    nullable: tuple[bool, ...] = (True,)

    @staticmethod
    def parse(text: str) -> Type:
        m = _TEXT.fullmatch(text.replace(" ", ""))
        if not m:
            raise ValueError(f"not a type: {text}")
        levels, close = len(m["open"]), m["close"]
        parts = close.split("]")
        if len(parts) != levels + 1 or any(p not in ("", "!") for p in parts) or levels > MAX_LISTS:
            raise ValueError(f"not a type: {text}")
        return Type(m["name"], tuple(p == "" for p in reversed(parts)))

    def __str__(self) -> str:
        out = self.name + "!" * (not self.nullable[-1])
        for n in reversed(self.nullable[:-1]):
            out = f"[{out}]" + "!" * (not n)
        return out

    @property
    def is_list(self) -> bool:
        return len(self.nullable) > 1

    @property
    def is_nullable(self) -> bool:
        return self.nullable[0]

    def element(self) -> Type:
        return Type(self.name, self.nullable[1:])

    def listed(self, nullable: bool) -> Type:
        return Type(self.name, (nullable, *self.nullable))

    def with_nullable(self, nullable: bool) -> Type:
        return replace(self, nullable=(nullable, *self.nullable[1:]))

    def same_but_nulls(self, other: Type) -> bool:
        return self.name == other.name and len(self.nullable) == len(other.nullable)

    def intersect(self, other: Type) -> Type | None:
        """What is valid for both, if anything is."""
        if not self.same_but_nulls(other):
            return None
        return Type(self.name, tuple(a and b for a, b in zip(self.nullable, other.nullable)))

    @property
    def is_orderable(self) -> bool:
        return self.name in ("Int", "Float", "String")

    def narrows(self, other: Type) -> bool:
        """Whether every value of this scalar type is one of ``other``."""
        return self.same_but_nulls(other) and all(b or not a for a, b in zip(self.nullable, other.nullable))

    def accepts(self, value) -> bool:
        if value is None:
            return self.is_nullable
        if self.is_list:
            return isinstance(value, list | tuple) and all(map(self.element().accepts, value))
        match value:
            case bool():
                return self.name == "Boolean"
            case int():
                return self.name == "Int" and LOW <= value <= HIGH
            case float():
                return self.name == "Float" and math.isfinite(value)
            case str():
                return self.name == "String"
        return False

    def spark(self) -> str:
        """The Spark type that holds it."""
        out = {"Int": "bigint", "Float": "double", "Boolean": "boolean"}.get(self.name, "string")
        for _ in self.nullable[1:]:
            out = f"array<{out}>"
        return out
