"""Operator 7, toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters, digits and non-ASCII bytes, ASCII letters lower-cased.
A word's hash is a polynomial of its bytes; pairs of neighbours and pairs with one
word between are hashed from their words' hashes.  All of it is array work over a
whole batch.  A feature counts once a document.  Training goes through the sampled
documents with a learning rate of its own for each weight and an L1 term that
leaves most weights at 0; the others are sent to the workers.

Training takes a sample of about ``BOUND`` labelled rows (a parameter).  Labels,
lang, source and doc_id are no features.

Cases: null, empty and wordless texts score by the bias alone.  Without labels, or
with one class only, the score is the smoothed share of label 1.  Texts are read
whole.  Repeated rows are scored each; an empty table gives an empty
table.  In the query a null doc_id is in neither fold (``held_out`` is null).
Input columns named as a result column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.llm.byte_bpe import lists
from vertexloom.llm.common import crc_mod, extend, flat, per_text, steps, struct, table, text_of
from vertexloom.llm.labelled import sample

#: Labelled rows that training looks at, about; buckets of the hash (2^BITS).
BOUND, BITS = 12_000, 20
ALPHA, BETA, L1, L2, ROUNDS = 1.0, 1.0, 5.0, 0.1, 5
#: A feature must occur in so many sampled documents.
LEAST = 4

_BYTES = np.zeros(256, np.uint64)
_BYTES[0x80:] = np.arange(0x80, 0x100)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _BYTES[_c] = _c
_BYTES[65:91] = np.arange(97, 123)
_WORD = _BYTES > 0
_P, _MIX, _NEXT, _SKIP = (np.uint64(k) for k in (0x100000001B3, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_POWERS = np.cumprod(np.append(np.uint64(1), np.full(4095, _P)), dtype=np.uint64)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of all texts, and where each text's words begin (n + 1 offsets)."""
    inside = _WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = inside[heads]
    bounds = np.concatenate([[0], np.cumsum(per_text(first, offsets))])
    own = np.flatnonzero(inside)
    at = np.flatnonzero(first[own])
    if not len(at):
        return np.zeros(0, np.uint64), bounds
    place = np.arange(len(own)) - np.repeat(at, np.diff(np.append(at, len(own))))
    return np.add.reduceat(_BYTES[data[own]] * _POWERS[place & 4095], at), bounds


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return ((h ^ (h >> np.uint64(32))) * _MIX >> np.uint64(64 - bits)).astype(np.int32)


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets of words, of neighbours and of skip pairs, each with the text they are in."""
    h, bounds = word_hashes(data, offsets)
    text = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(bounds))
    out = [(_bucket(h, bits), text)]
    for gap, key in ((1, _NEXT), (2, _SKIP)):
        same = text[gap:] == text[:-gap]
        out.append((_bucket(h[:-gap] * key + (h[gap:] ^ (h[gap:] >> np.uint64(31))), bits)[same], text[gap:][same]))
    return out


@dataclass(frozen=True)
class Weights:
    """A sparse linear model: at most 2^bits entries, in practice some hundreds."""

    bits: int
    bias: float
    at: np.ndarray
    weight: np.ndarray

    def scores(self, texts: pa.Array) -> np.ndarray:
        dense = np.zeros(1 << self.bits, np.float32)
        dense[self.at] = self.weight
        out = []
        for part in steps(texts):
            data, offsets = flat(part)
            keys = []
            for bucket, text in features(data, offsets, self.bits):
                hit = np.flatnonzero(dense[bucket])
                keys.append(text[hit].astype(np.int64) << self.bits | bucket[hit])
            keys = np.unique(np.concatenate(keys))
            logit = self.bias + np.bincount(keys >> self.bits, dense[keys & ((1 << self.bits) - 1)], len(part))
            out.append(1 / (1 + np.exp(-np.clip(logit, -30, 30))))
        return np.concatenate(out) if out else np.zeros(0)


def ftrl(rows: list[np.ndarray], y: np.ndarray, bits: int = BITS) -> Weights:
    """Train on the buckets of each document, in order."""
    share = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(share / (1 - share)))
    none = Weights(bits, bias, np.zeros(0, np.int64), np.zeros(0, np.float32))
    if len(np.unique(y)) < 2:
        return none
    often = np.flatnonzero(np.bincount(np.concatenate(rows), minlength=1 << bits) >= LEAST)
    number = np.full(1 << bits, -1, np.int32)
    number[often] = np.arange(len(often))
    rows = [(k := number[r])[k >= 0] for r in rows]
    z, n = np.zeros(len(often)), np.zeros(len(often))
    l1 = L1 * min(1.0, len(y) / BOUND) ** 0.5  # the evidence for a weight grows with the sample, so does the penalty
    zb = nb = 0.0

    def weight(z, n):
        return np.where(np.abs(z) <= l1, 0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(ROUNDS):
        for r, t in zip(rows, y):
            zr, nr = z[r], n[r]
            w = weight(zr, nr)
            wb = bias - zb / ((BETA + nb**0.5) / ALPHA)
            g = 1 / (1 + np.exp(-max(min(w.sum() + wb, 30.0), -30.0))) - t
            z[r], n[r] = zr + g - (np.sqrt(nr + g * g) - np.sqrt(nr)) / ALPHA * w, nr + g * g
            zb, nb = zb + g - ((nb + g * g) ** 0.5 - nb**0.5) / ALPHA * (wb - bias), nb + g * g
    w = weight(z, n)
    kept = np.flatnonzero(w)
    return Weights(bits, float(bias - zb / ((BETA + nb**0.5) / ALPHA)), often[kept], w[kept].astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, where: Column | None = None, label: str = "toxic", text_col: str = "text", bound: int = BOUND, bits: int = BITS) -> Weights:
    """Fit on about ``bound`` labelled rows for which ``where`` holds (a column over ``labels``)."""

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for part in steps(texts):
            data, offsets = flat(part)
            keys = np.unique(np.concatenate([t.astype(np.int64) << bits | b for b, t in features(data, offsets, bits)]))
            cut = np.searchsorted(keys, np.arange(len(part) + 1) << bits)
            out += [keys[a:b] & ((1 << bits) - 1) for a, b in zip(cut, cut[1:])]
        return struct(buckets=lists(out, pa.int32()))

    rows = sample(docs.select("doc_id", text_col), labels, label, bound, F.lit(True) if where is None else where)
    rows = extend(rows, run, "struct<buckets:array<int>>", text_of(rows, text_col), ["doc_id", "__label"])
    order = F.xxhash64(F.lit(11), "doc_id")
    got = rows.groupBy("doc_id").agg(F.min(F.struct("__label", "buckets")).alias("r")).select("doc_id", "r.*").orderBy(order, "doc_id").toArrow()
    rows = [x.values.to_numpy() for c in got.column("buckets").chunks for x in c]
    return ftrl(rows, got.column("__label").to_numpy().astype(int), bits)


def score(df: DataFrame, model: Weights, text_col: str = "text", keep: list[str] | None = None, cut: float = 0.3) -> DataFrame:
    """Append ``score`` (double, 0 to 1) and ``predicted`` (int)."""
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() != "predicted"]
    out = extend(df, lambda texts: struct(score=pa.array(model.scores(texts).astype(float))), "struct<score:double>", text_of(df, text_col), keep)
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels, crc_mod(labels, "doc_id", 4) != 2)
    out = score(docs, model, keep=["doc_id"])
    return out.select("doc_id", (crc_mod(out, "doc_id", 4) == 2).alias("held_out"), "score", "predicted")
