"""Counts over whole texts that the quality operators share.

Everything is worked out per Arrow batch: character classes by one table look-up
a byte, repeated 3-word windows by sorting packed word numbers.  Null text counts
as empty, for which every count is 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vertexloom.llm.common import extend, flat, steps, text_of

LOWER, UPPER, DIGIT, SPACE, SYMBOL, SHOUT, STOP, PUNCT, CONTROL, LEAD, TAIL = range(11)
_TABLE = np.full(256, PUNCT, np.uint8)
_TABLE[:32] = _TABLE[127] = CONTROL
_TABLE[9:14] = _TABLE[32] = SPACE
_TABLE[48:58], _TABLE[65:91], _TABLE[97:123] = DIGIT, UPPER, LOWER
_TABLE[list(b"#*$%&|<>")], _TABLE[list(b"!?")], _TABLE[list(b".,;:")] = SYMBOL, SHOUT, STOP
_TABLE[0x80:0xC0], _TABLE[0xC0:] = TAIL, LEAD

FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_unique_words", "n_lower", "n_upper", "n_digits", "n_shouts", "n_stops", "n_puncts", "n_controls", "n_non_ascii")


def byte_classes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each class each text has."""
    n = len(offsets) - 1
    at = np.repeat(np.arange(n, dtype=np.int64) * 16, np.diff(offsets)) + _TABLE[data]
    return np.bincount(at, minlength=n * 16).reshape(n, 16)


def repeat_words(words: list[bytes]) -> tuple[int, int]:
    """Words in 3-word windows found twice or more, and distinct words."""
    number: dict[bytes, int] = {}
    at = [number.setdefault(w, len(number)) for w in words]
    n, kinds = len(words), len(number)
    if n < 4 or kinds == n:
        return 0, kinds
    w = np.array(at, np.int64)
    if kinds < 1 << 20:
        key = (w[:-2] << 40) | (w[1:-1] << 20) | w[2:]
    else:
        _, pair = np.unique(w[:-1] << 32 | w[1:], return_inverse=True)
        key = pair[:-1] << 32 | w[2:]
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0, kinds
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] = twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum()), kinds


def measure(texts: pa.Array) -> pa.StructArray:
    """One struct of FIELDS (all long) a text."""
    out = []
    for part in steps(texts):
        data, offsets = flat(part)
        by = byte_classes(data, offsets)
        raw, bounds = data.tobytes(), offsets.tolist()
        rows = np.zeros((len(part), len(FIELDS)), np.int64)
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            text = raw[a:b]
            words = text.split()
            lines = [x for x in text.split(b"\n") if x.strip()]
            again, kinds = repeat_words(words)
            rows[i, :7] = len(words), 0, 0, len(lines) - len(set(lines)), again, len(lines), kinds
        rows[:, 1] = np.diff(offsets) - by[:, SPACE] - by[:, TAIL]
        rows[:, 2] = by[:, SYMBOL]
        for k, c in enumerate((LOWER, UPPER, DIGIT, SHOUT, STOP, PUNCT, CONTROL, LEAD), 7):
            rows[:, k] = by[:, c]
        out.append(rows)
    rows = np.concatenate(out) if out else np.zeros((0, len(FIELDS)), np.int64)
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in range(len(FIELDS))], list(FIELDS))


def with_stats(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append FIELDS; columns of these names are replaced."""
    return extend(df, measure, f"struct<{','.join(f'{f}:bigint' for f in FIELDS)}>", text_of(df, text_col), keep)
