"""Errors by family; ``code`` names what went wrong and ``details`` holds the names involved."""

from __future__ import annotations


class LoomError(Exception):
    """Base of all errors that a schema, query, argument or source can cause."""

    def __init__(self, code: str, *details, position: tuple[int, int] | None = None):
        self.code, self.details, self.position = code, details, position
        at = f" at line {position[0]}, column {position[1]}" if position else ""
        super().__init__(f"{code}{at}: {', '.join(map(str, details))}" if details else code + at)


class ParseError(LoomError):
    """The query text is not a query this language knows."""


class SchemaError(LoomError):
    """The schema text breaks a rule."""


class ValidationError(LoomError):
    """The query names what the schema doesn't have."""


class FrontendError(LoomError):
    """The query is well-formed but has no meaning under the schema."""


class FilterTypeError(FrontendError):
    """A filter compares what can't be compared."""


class ArgumentError(LoomError):
    """The arguments don't fit the query's variables."""


class SourceError(LoomError):
    """A source doesn't provide what its schema promises."""


class ErrorGroup(LoomError):
    """Several errors found in one go."""

    def __init__(self, errors: list[LoomError]):
        self.errors = errors
        super().__init__("MultipleErrors", *errors)

    @property
    def codes(self) -> list[str]:
        return [e.code for e in self.errors]


def raise_all(errors: list[LoomError]) -> None:
    flat: list[LoomError] = []
    for e in errors:
        flat += e.errors if isinstance(e, ErrorGroup) else [e]
    if len(flat) == 1:
        raise flat[0]
    if flat:
        raise ErrorGroup(flat)
