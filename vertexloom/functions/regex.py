"""Patterns of the query language (no look-around, no back-references) in the dialects of the engines that match them.

A constant pattern goes to Spark's own ``rlike``.  Two kinds go to Arrow's matcher instead, which
takes linear time whatever the pattern: constants that repeat what is itself repeated, on which an engine that
backtracks can take for ever, and patterns that differ by row, of which each distinct
one is compiled once a batch and run over all its texts.  What that matcher lacks
(Unicode word boundaries, set operations) goes to Python's.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from vertexloom.functions.shipping import ship

#: Named classes inside brackets; they are ASCII in the dialect.
_POSIX = {
    "alpha": "A-Za-z",
    "digit": "0-9",
    "alnum": "0-9A-Za-z",
    "upper": "A-Z",
    "lower": "a-z",
    "word": "0-9A-Za-z_",
    "xdigit": "0-9A-Fa-f",
    "blank": r"\t ",
    "space": r"\t\n\x0B\f\r ",
    "punct": r"!-/:-@\[-`{-~",
    "graph": "!-~",
    "print": " -~",
    "cntrl": r"\x00-\x1F\x7F",
    "ascii": r"\x00-\x7F",
}


@lru_cache(maxsize=32)
def _others(name: str) -> str:
    """The complement of a named class, as ranges."""
    own = re.compile(f"[{_POSIX[name]}]")
    edges = [c for c in range(1, 129) if bool(own.fullmatch(chr(c))) != bool(own.fullmatch(chr(c - 1)))]
    edges = [*([] if own.fullmatch("\0") else [0]), *edges]
    ends = [*edges[1:], 0x110000]
    return "".join(f"{_code(a)}-{_code(b - 1)}" for a, b in list(zip(edges, ends))[::2])


def _code(c: int) -> str:
    return f"\\x{c:02X}" if c < 256 else chr(c)


def _walk(pattern: str, end: str) -> str:
    """Replace what differs; raise ValueError at what the dialect doesn't have."""
    out, i, inside, multiline = [], 0, 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            nxt = pattern[i + 1 : i + 2]
            if not nxt or (nxt.isdigit() and nxt != "0") or nxt in "kGZ":
                raise ValueError(f"not supported: \\{nxt}")
            out.append({"z": end}.get(nxt, c + nxt) if not inside else c + nxt)
            i += 2
            continue
        if inside:
            if c == "[" and (m := re.match(r"\[:(\^?\w+):\]", pattern[i:])):
                if m[1].lstrip("^") not in _POSIX:
                    raise ValueError(f"not supported: {m[0]}")
                out.append(_others(m[1][1:]) if m[1][0] == "^" else _POSIX[m[1]])
                i += m.end()
                continue
            inside += (c == "[") - (c == "]" and pattern[i - 1] != "[" and pattern[i - 2 : i] != "[^")
        elif c == "[":
            inside = 1
        elif c == "(" and pattern[i + 1 : i + 2] == "?":
            rest = pattern[i + 2 :]
            if rest[:1] in "=!>" or (rest[:1] == "<" and rest[1:2] in "=!") or rest[:2] in ("P=", "P>"):
                raise ValueError("look-around and references aren't supported")
            flags = re.match(r"([a-zA-Z]*)(?:-[a-zA-Z]*)?[:)]", rest)
            if flags and set(flags[1]) - set("imsxu"):
                raise ValueError(f"flags not supported: {flags[1]}")
            multiline |= bool(flags and "m" in flags[1])
        elif c == "$" and not multiline:
            out.append(end)
            i += 1
            continue
        out.append(c)
        i += 1
    return "".join(out)


def java(pattern: str) -> str:
    """For ``rlike``: Unicode classes, a dot that stops at \\n only, an end that is the end."""
    text = _walk(pattern, r"\z").replace("(?P<", "(?<")
    try:
        python(pattern)
    except regex.error as e:
        raise ValueError(str(e)) from None
    return "(?Ud)" + text


@lru_cache(maxsize=4096)
def python(pattern: str) -> regex.Pattern:
    return regex.compile(_walk(pattern, r"\Z"))


_UNICODE = {"d": r"\p{Nd}", "w": r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}", "s": r"\t\n\x0B\f\r\x{85}\p{Z}"}
_NESTED = re.compile(r"\)[*+{][^)]*\)[*+{]|[*+}][^()|\\]*\)[*+{]")


@lru_cache(maxsize=4096)
def linear(pattern: str) -> str | None:
    """For Arrow's matcher; None for what it doesn't have."""
    text, out, i, inside = _walk(pattern, r"\z"), [], 0, False
    while i < len(text):
        c, nxt = text[i], text[i + 1 : i + 2]
        if c == "\\":
            if nxt in "bB" or (nxt in "pP" and not re.match(r"\\[pP](?:[A-Z]|\{(?:[A-Z][a-z]?)\})(?![\w{])", text[i:])) or (nxt in "DWS" and inside) or nxt in "uUNRXQE" + "h":
                return None
            if nxt in _UNICODE:
                out.append(_UNICODE[nxt] if inside else f"[{_UNICODE[nxt]}]")
            elif nxt in "DWS":
                out.append(f"[^{_UNICODE[nxt.lower()]}]")
            else:
                out.append(c + nxt)
            i += 2
            continue
        if inside and (c == "[" or text[i : i + 2] in ("&&", "--", "~~", "||")):
            return None
        if c == "(" and re.match(r"\(\?[a-z]*[xu]", text[i:]):
            return None
        inside = c != "]" if inside and text[i - 1 : i] not in ("[",) and text[i - 2 : i] != "[^" else inside or c == "["
        out.append(c)
        i += 1
    text = "".join(out)
    try:
        pc.match_substring_regex(pa.array([""]), text)
    except pa.ArrowInvalid:
        return None
    return text


def explosive(pattern: str) -> bool:
    """Whether something repeated is repeated, which an engine that backtracks may never finish."""
    return bool(_NESTED.search(re.sub(r"\\.|\[[^\]]*\]", "x", pattern)))


def _search(texts: pa.Array, pattern: str) -> pa.Array:
    """Which texts hold a match; a pattern that isn't one matches nothing."""
    try:
        python(pattern)
    except (ValueError, regex.error):
        return pa.array(np.zeros(len(texts), bool))
    if (other := linear(pattern)) is not None:
        return pc.fill_null(pc.match_substring_regex(texts, other), False)
    return pa.array([t is not None and python(pattern).search(t) is not None for t in texts.to_pylist()], pa.bool_())


def _matches(texts: pa.Array, patterns: pa.Array) -> pa.Array:
    kinds = patterns.dictionary_encode()
    codes = kinds.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    bounds = np.searchsorted(codes[order], np.arange(len(kinds.dictionary) + 1))
    out = np.zeros(len(texts), bool)
    for pattern, a, b in zip(kinds.dictionary.to_pylist(), bounds, bounds[1:]):
        rows = order[a:b]
        out[rows] = _search(texts.take(pa.array(rows)), pattern).to_numpy(zero_copy_only=False)
    return pa.array(out)


def matches_column(text: Column, pattern: Column) -> Column:
    """Search with a pattern that differs by row; ``rlike`` would fail at the first bad one."""
    ship(SparkSession.active())
    return F.arrow_udf(lambda t, p: _matches(t, p), "boolean")(text, pattern)


def matches_constant(text: Column, pattern: str) -> Column:
    if not explosive(pattern):
        return text.rlike(java(pattern))
    ship(SparkSession.active())
    return F.arrow_udf(lambda t: _search(t, pattern), "boolean")(text)
