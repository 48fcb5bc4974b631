"""Schemas: vertex types, their properties and edges, checked once."""

from __future__ import annotations

from functools import cached_property

from vertexloom.errors import SchemaError, raise_all
from vertexloom.syntax import FieldDef, Name, Parser, TypeDef, Variable
from vertexloom.types import BUILTIN, Type


def plain_value(value) -> bool:
    """Whether a literal is one of the values the language has."""
    if isinstance(value, list):
        return all(map(plain_value, value))
    return not isinstance(value, Name | Variable | dict)


class Schema:
    def __init__(self, text: str):
        doc = Parser(text, SchemaError).schema()
        errors: list[SchemaError] = []
        self.types: dict[str, TypeDef] = {}
        for t in doc.types:
            if t.name in self.types:
                errors.append(SchemaError("DuplicateTypeOrInterfaceDefinition", t.name))
            self.types.setdefault(t.name, t)
        if doc.query_type is None or doc.query_type not in self.types:
            raise SchemaError("MissingQueryType", doc.query_type)
        self.query_type = doc.query_type
        self.scalars = set(doc.scalars)
        self.fields: dict[tuple[str, str], FieldDef] = {}
        for t in self.types.values():
            for f in t.fields:
                if (t.name, f.name) in self.fields:
                    errors.append(SchemaError("DuplicateFieldDefinition", t.name, f.name))
                self.fields.setdefault((t.name, f.name), f)
        raise_all(errors)
        errors += self._implements() + self._required() + self._narrowing() + self._invariants()
        try:
            self.origins = self._origins()
            errors += [SchemaError("AmbiguousFieldOrigin", t, f, self.fields[t, f].type, sorted(o)) for (t, f), o in sorted(self.origins.items()) if len(o) > 1]
        except SchemaError as e:
            errors.append(e)
        raise_all(errors)

    # look-up

    @cached_property
    def vertex_types(self) -> dict[str, TypeDef]:
        return {n: t for n, t in self.types.items() if n != self.query_type}

    def field(self, type_name: str, name: str) -> FieldDef | None:
        return self.fields.get((type_name, name))

    def is_edge(self, f: FieldDef) -> bool:
        return f.type.name in self.types

    def is_subtype(self, parent: str, child: str) -> bool:
        return parent == child or (child in self.types and parent in self.types[child].implements)

    def concrete(self, name: str) -> list[str]:
        """Object types that are, or implement, ``name``."""
        return [t.name for t in self.vertex_types.values() if t.kind == "type" and self.is_subtype(name, t.name)]

    def subtypes(self, name: str) -> list[str]:
        return [t.name for t in self.types.values() if self.is_subtype(name, t.name)]

    # checks

    def _implements(self) -> list[SchemaError]:
        out = []
        for t in self.types.values():
            for p in t.implements:
                if p not in self.types:
                    out.append(SchemaError("ImplementingNonExistentType", t.name, p))
                elif self.types[p].kind != "interface":
                    out.append(SchemaError("ImplementingNonInterface", t.name, p))
                else:
                    missing = [g for g in self.types[p].implements if g not in t.implements and g != t.name]
                    out += [SchemaError("MissingTransitiveInterfaceImplementation", t.name, p, g) for g in missing]
        return out

    def _required(self) -> list[SchemaError]:
        out = []
        for t in self.types.values():
            for p in t.implements:
                for f in self.types[p].fields if p in self.types else ():
                    if (t.name, f.name) not in self.fields:
                        out.append(SchemaError("MissingRequiredField", t.name, p, f.name))
        return out

    def _covers(self, parent: Type, child: Type) -> bool:
        """Whether ``child`` is equal to or narrower than ``parent``, vertex types included."""
        return len(parent.nullable) == len(child.nullable) and all(a or not b for a, b in zip(parent.nullable, child.nullable)) and (parent.name == child.name or self.is_subtype(parent.name, child.name))

    def _narrowing(self) -> list[SchemaError]:
        out = []
        for t in self.types.values():
            for f in t.fields:
                for p in t.implements:
                    above = self.fields.get((p, f.name))
                    if above is None:
                        continue
                    if not self._covers(above.type, f.type):
                        out.append(SchemaError("InvalidTypeWideningOfInheritedField", f.name, t.name, p, f.type, above.type))
                    own, theirs = ({x.name: x.type for x in d.parameters} for d in (f, above))
                    if lost := sorted(theirs.keys() - own):
                        out.append(SchemaError("InheritedFieldMissingParameters", f.name, t.name, p, lost))
                    if new := sorted(own.keys() - theirs):
                        out.append(SchemaError("InheritedFieldUnexpectedParameters", f.name, t.name, p, new))
                    for name in own.keys() & theirs:
                        if not theirs[name].narrows(own[name]):
                            out.append(SchemaError("InvalidTypeNarrowingOfInheritedFieldParameter", f.name, t.name, p, name, own[name], theirs[name]))
        return out

    def _invariants(self) -> list[SchemaError]:
        out = []
        for t in self.types.values():
            if t.name.startswith("__"):
                out.append(SchemaError("ReservedTypeName", t.name))
            for f in t.fields:
                if f.name.startswith("__"):
                    out.append(SchemaError("ReservedFieldName", t.name, f.name))
                if f.type.name in BUILTIN:
                    if t.name == self.query_type:
                        out.append(SchemaError("PropertyFieldOnRootQueryType", t.name, f.name, f.type))
                    if f.parameters:
                        out.append(SchemaError("PropertyFieldWithParameters", t.name, f.name, f.type, [x.name for x in f.parameters]))
                elif f.type.name not in self.types:
                    out.append(SchemaError("UnknownPropertyOrEdgeType", f.name, f.type))
                else:
                    if f.type.name == self.query_type:
                        out.append(SchemaError("EdgePointsToRootQueryType", t.name, f.name, f.type))
                    if len(f.type.nullable) > 2:
                        out.append(SchemaError("InvalidEdgeType", t.name, f.name, f.type))
                    for x in f.parameters:
                        if x.has_default and not (plain_value(x.default) and x.type.accepts(x.default)):
                            out.append(SchemaError("InvalidDefaultValueForFieldParameter", t.name, f.name, x.name, x.type, x.default))
        return out

    def _origins(self) -> dict[tuple[str, str], frozenset[str]]:
        """The types that introduce each field."""
        out: dict[tuple[str, str], frozenset[str]] = {}
        waiting = {t.name: {p for p in t.implements if p in self.types} for t in self.types.values()}
        while ready := sorted(n for n, w in waiting.items() if not w):
            for n in ready:
                del waiting[n]
                for f in self.types[n].fields:
                    above = [out[p, f.name] for p in self.types[n].implements if (p, f.name) in out]
                    out[n, f.name] = frozenset().union(*above) if above else frozenset([n])
                for w in waiting.values():
                    w.discard(n)
        if waiting:
            raise SchemaError("CircularImplementsRelationships", sorted(waiting))
        return out
