"""A recursive-descent parser for the GraphQL syntax that queries and schemas use."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from vertexloom.errors import LoomError, ParseError
from vertexloom.types import Type

_TOKEN = re.compile(
    r'(?P<skip>[\s,﻿]+|\#[^\n\r]*)|(?P<block>"""(?:\\"""|(?!""")[\s\S])*""")|(?P<string>"(?:\\.|[^"\\\n\r])*")'
    r"|(?P<float>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+(?:[eE][+-]?[0-9]+)?|[eE][+-]?[0-9]+))|(?P<int>-?(?:0|[1-9][0-9]*)(?![0-9A-Za-z_.]))"
    r"|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<mark>\.\.\.|[!$&()\[\]{}:=@|])"
)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    position: tuple[int, int]


@dataclass(frozen=True)
class Name:
    """A bare word used as a value: an enum."""

    text: str


@dataclass(frozen=True)
class Variable:
    text: str


@dataclass
class Directive:
    name: str
    arguments: list[tuple[str, object, tuple[int, int]]]
    position: tuple[int, int]


@dataclass
class Field:
    name: str
    alias: str | None
    arguments: list[tuple[str, object, tuple[int, int]]]
    directives: list[Directive]
    selections: list
    position: tuple[int, int]


@dataclass
class InlineFragment:
    type_name: str | None
    directives: list[Directive]
    selections: list
    position: tuple[int, int]


@dataclass
class FragmentSpread:
    name: str
    position: tuple[int, int]


@dataclass
class Operation:
    kind: str
    name: str | None
    variables: list[str]
    directives: list[Directive]
    selections: list
    position: tuple[int, int]


@dataclass
class Document:
    operations: list[Operation] = field(default_factory=list)
    fragments: list[tuple[str, tuple[int, int]]] = field(default_factory=list)


@dataclass
class Parameter:
    name: str
    type: Type
    default: object
    has_default: bool
    description: str | None = None


@dataclass
class FieldDef:
    name: str
    type: Type
    parameters: list[Parameter]
    description: str | None = None


@dataclass
class TypeDef:
    name: str
    kind: str  # type or interface
    implements: list[str]
    fields: list[FieldDef]
    description: str | None = None


@dataclass
class SchemaDocument:
    query_type: str | None = None
    types: list[TypeDef] = field(default_factory=list)
    scalars: list[str] = field(default_factory=list)
    directives: list[str] = field(default_factory=list)


def tokens(text: str, error: type[LoomError]) -> list[Token]:
    out, at, line, start = [], 0, 1, 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        position = (line, at - start + 1)
        if not m:
            raise error("InvalidGraphQL", f"unexpected {text[at]!r}", position=position)
        if m.lastgroup != "skip":
            out.append(Token(m.lastgroup, m[0], position))
        if newlines := m[0].count("\n"):
            line, start = line + newlines, at + m[0].rindex("\n") + 1
        at = m.end()
    out.append(Token("end", "", (line, at - start + 1)))
    return out


def _block(text: str) -> str:
    lines = text[3:-3].replace('\\"""', '"""').splitlines()
    indent = min((len(x) - len(x.lstrip()) for x in lines[1:] if x.strip()), default=0)
    lines = lines[:1] + [x[indent:] for x in lines[1:]]
    while lines and not lines[0].strip():
        lines.pop(0)
    while lines and not lines[-1].strip():
        lines.pop()
    return "\n".join(lines)


class Parser:
    def __init__(self, text: str, error: type[LoomError] = ParseError):
        self.tokens, self.at, self.error = tokens(text, error), 0, error

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def fail(self, what: str):
        raise self.error("InvalidGraphQL", f"expected {what}, found {self.now.text or 'the end'!r}", position=self.now.position)

    def has(self, text: str) -> bool:
        return self.now.text == text and self.now.kind in ("mark", "name")

    def take(self, text: str) -> bool:
        if self.has(text):
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            self.fail(repr(text))

    def name(self) -> str:
        if self.now.kind != "name":
            self.fail("a name")
        self.at += 1
        return self.tokens[self.at - 1].text

    def value(self):
        t = self.now
        self.at += 1
        if t.kind == "int":
            return int(t.text)
        if t.kind == "float":
            return float(t.text)
        if t.kind == "string":
            return json.loads(t.text, strict=False)
        if t.kind == "block":
            return _block(t.text)
        if t.kind == "name":
            return {"true": True, "false": False, "null": None}.get(t.text, Name(t.text)) if t.text in ("true", "false", "null") else Name(t.text)
        if t.text == "$":
            return Variable(self.name())
        if t.text == "[":
            out = []
            while not self.take("]"):
                out.append(self.value())
            return out
        if t.text == "{":
            out = {}
            while not self.take("}"):
                key = self.name()
                self.need(":")
                out[key] = self.value()
            return out
        self.at -= 1
        self.fail("a value")

    def arguments(self) -> list[tuple[str, object, tuple[int, int]]]:
        out = []
        if self.take("("):
            while not self.take(")"):
                name = self.name()
                self.need(":")
                position = self.now.position
                out.append((name, self.value(), position))
            if not out:
                self.fail("an argument")
        return out

    def directives(self) -> list[Directive]:
        out = []
        while self.has("@"):
            position = self.now.position
            self.at += 1
            name = self.name()
            out.append(Directive(name, self.arguments(), position))
        return out

    # queries

    def selections(self) -> list:
        self.need("{")
        out = []
        while not self.take("}"):
            out.append(self.selection())
        if not out:
            self.at -= 1
            self.fail("a field")
        return out

    def selection(self):
        position = self.now.position
        if self.take("..."):
            if self.now.kind == "name" and not self.has("on"):
                spread = FragmentSpread(self.name(), position)
                self.directives()
                return spread
            type_name = self.name() if self.take("on") else None
            return InlineFragment(type_name, self.directives(), self.selections(), position)
        alias, name = None, self.name()
        if self.take(":"):
            alias, name = name, self.name()
        arguments, directives = self.arguments(), self.directives()
        return Field(name, alias, arguments, directives, self.selections() if self.has("{") else [], position)

    def document(self) -> Document:
        out = Document()
        while self.now.kind != "end":
            position = self.now.position
            if self.has("{"):
                out.operations.append(Operation("query", None, [], [], self.selections(), position))
            elif self.take("fragment"):
                name = self.name()
                self.need("on")
                self.name()
                self.directives()
                self.selections()
                out.fragments.append((name, position))
            elif self.now.text in ("query", "mutation", "subscription"):
                kind = self.name()
                name = self.name() if self.now.kind == "name" else None
                variables = []
                if self.take("("):
                    while not self.take(")"):
                        self.need("$")
                        variables.append(self.name())
                        self.need(":")
                        self.type()
                        if self.take("="):
                            self.value()
                        self.directives()
                out.operations.append(Operation(kind, name, variables, self.directives(), self.selections(), position))
            else:
                self.fail("a query")
        return out

    # schemas

    def type(self) -> Type:
        levels = 0
        while self.take("["):
            levels += 1
        name, nullable = self.name(), []
        nullable.append(not self.take("!"))
        for _ in range(levels):
            self.need("]")
            nullable.append(not self.take("!"))
        return Type(name, tuple(reversed(nullable)))

    def description(self) -> str | None:
        return self.value() if self.now.kind in ("string", "block") else None

    def parameters(self) -> list[Parameter]:
        out = []
        if self.take("("):
            while not self.take(")"):
                text, name = self.description(), self.name()
                self.need(":")
                kind = self.type()
                has = self.take("=")
                out.append(Parameter(name, kind, self.value() if has else None, has, text))
                self.directives()
        return out

    def schema(self) -> SchemaDocument:
        out = SchemaDocument()
        while self.now.kind != "end":
            text, word = self.description(), self.now.text
            if self.take("schema"):
                self.directives()
                self.need("{")
                while not self.take("}"):
                    kind = self.name()
                    self.need(":")
                    target = self.name()
                    if kind == "query":
                        out.query_type = target
            elif self.take("scalar"):
                out.scalars.append(self.name())
                self.directives()
            elif self.take("directive"):
                self.need("@")
                out.directives.append(self.name())
                self.parameters()
                self.take("repeatable")
                self.need("on")
                self.take("|")
                self.name()
                while self.take("|"):
                    self.name()
            elif word in ("type", "interface"):
                self.at += 1
                name, parents, fields = self.name(), [], []
                if self.take("implements"):
                    self.take("&")
                    parents.append(self.name())
                    while self.take("&"):
                        parents.append(self.name())
                self.directives()
                if self.take("{"):
                    while not self.take("}"):
                        about, field_name = self.description(), self.name()
                        parameters = self.parameters()
                        self.need(":")
                        fields.append(FieldDef(field_name, self.type(), parameters, about))
                        self.directives()
                out.types.append(TypeDef(name, word, parents, fields, text))
            elif word in ("extend", "enum", "union", "input"):
                raise self.error("UnsupportedDefinition", word, position=self.now.position)
            else:
                self.fail("a definition")
        return out


_SHORT = re.compile(r"\?\((\S+?)(?: (\S+?))?\)|&count\b")


def shorthand(text: str) -> str:
    """Write out ``?(op operand)`` as a filter and ``&count`` as the counting transform."""

    def long(m: re.Match) -> str:
        if m[1] is None:
            return '@transform(op: "count")'
        value = "" if m[2] is None else f', value: ["{m[2]}"]'
        return f'@filter(op: "{m[1]}"{value})'

    return _SHORT.sub(long, text)


def parse_query(text: str) -> Document:
    return Parser(text).document()
