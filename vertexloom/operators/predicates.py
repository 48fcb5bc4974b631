"""Filter operators as columns under two-valued logic: never null."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from vertexloom.functions import regex
from vertexloom.types import Type

_LONG = 1 << 63


def literal(value, kind: Type) -> Column:
    """A constant of a declared type; whole numbers beyond 64 signed bits become decimals."""

    def large(v) -> bool:
        return any(map(large, v)) if isinstance(v, list | tuple) else isinstance(v, int) and not isinstance(v, bool) and v >= _LONG

    target = kind.spark().replace("bigint", "decimal(20,0)") if large(value) else kind.spark()

    def build(v) -> Column:
        return F.array(*map(build, v)) if isinstance(v, list | tuple) else F.lit(Decimal(v) if large(v) else v)

    return build(value).cast(target)


def predicate(op: str, left: Column, right: Column | None = None, constant=None, has_constant: bool = False, filtering: bool = False, never_null: bool = False) -> Column:
    """``left op right``; ``constant`` is the right side's value where it is known now.

    With ``filtering`` an outcome of false may be null instead: in a filter both drop
    the row, and the bare comparison reaches the scan.  With ``never_null`` one side is
    known to hold a value, so equality needs no regard for nulls.
    """
    if op.startswith("not_"):
        return ~predicate(op[4:], left, right, constant, has_constant)

    def _sure(c: Column) -> Column:
        return c if filtering else F.coalesce(c, F.lit(False))

    match op:
        case "is_null":
            return left.isNull()
        case "is_not_null":
            return left.isNotNull()
        case "=":
            return left == right if filtering and never_null else left.eqNullSafe(right)
        case "!=":
            return ~left.eqNullSafe(right)
        case "<":
            return _sure(left < right)
        case "<=":
            return _sure(left <= right)
        case ">":
            return _sure(left > right)
        case ">=":
            return _sure(left >= right)
        case "contains":
            return _sure(F.exists(left, lambda x: x.eqNullSafe(right)))
        case "one_of":
            if has_constant and constant is not None and not any(isinstance(v, list) for v in constant):
                plain = [Decimal(v) if isinstance(v, int) and v >= _LONG else v for v in constant if v is not None]
                hit = _sure(left.isin(plain)) if plain else F.lit(False)
                return hit | left.isNull() if len(plain) < len(constant) else hit
            return _sure(F.exists(right, lambda x: x.eqNullSafe(left)))
        case "has_prefix":
            return _sure(left.startswith(right))
        case "has_suffix":
            return _sure(left.endswith(right))
        case "has_substring":
            return _sure(left.contains(right))
        case "regex":
            return _sure(regex.matches_constant(left, constant) if has_constant else regex.matches_column(left, right))
    raise ValueError(f"no such operator: {op}")
