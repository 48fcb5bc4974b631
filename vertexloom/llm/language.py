"""Operator 1, language identification: nearest of several centroids a language.

A text becomes a vector of hashed byte 2- and 3-grams of its lower-cased letters,
weighted by the root of term frequency and by inverse document frequency, and
normalised.  Document frequency is the mean over languages, so that a language with
few documents doesn't outweigh the others in texts that mix them.
Each language has up to ``CENTROIDS`` centroids, found by spherical k-means; the
text gets the language of the centroid of largest cosine.  A text whose cosine is
lower than nearly all of that language's own training texts is rejected.

Document frequencies count every training text; centroids are fitted on a sample
of about ``BOUND`` different texts in all, or 20 a language if that is more, spread over the languages (a parameter).  Only text and
lang are learned from.  Any number of languages can be learned: ``LANGUAGES`` at a time, which
a text is then compared with one block after the other.

Cases: a null text, or one without a letter, is ``und`` with score 0; so is
every text if there is nothing to learn from.  Texts are read whole.  Repeated rows
are labelled each; an empty table gives an empty table.  In the query a null doc_id
is in neither fold: ``held_out`` is null, and nothing is learned from the row.  Input columns
named as a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.llm.byte_bpe import lists
from vertexloom.llm.common import Shared, crc_mod, extend, flat, fresh, ship, steps, struct, table, text_of
from vertexloom.llm.labelled import SPACE, hash_share

#: Sampled texts for the centroids in all; languages of a block; hashed dimensions; centroids a language.
BOUND, LANGUAGES, BITS, CENTROIDS = 3200, 1000, 13, 4
#: A text is rejected below this quantile of its language's training cosines, less a margin.
QUANTILE, MARGIN = 0.005, 0.02
#: Share of texts that an unseen gram counts as having.
RARE = 1e-3
#: Texts in a dense block.
ROWS = 64

_FOLD = np.zeros(256, np.uint32)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[_FOLD == 0] = 32
_ROOT = np.sqrt(np.arange(1 << 16)).astype(np.float32)


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often each text has each hashed gram, a row a text."""
    n, lens = len(offsets) - 1, np.diff(offsets)
    text = np.full(len(data) + n + 1, 32, np.uint32)  # a space before each text, and one at the end
    at = np.arange(len(data)) + np.repeat(np.arange(1, n + 1), lens)
    text[at] = _FOLD[data]
    row = np.repeat(np.arange(n, dtype=np.int64) << BITS, lens + 1)
    pair = text[:-1] << np.uint32(8) | text[1:]
    shift = np.uint32(32 - BITS)
    two = (pair * np.uint32(0x9E3779B1)) >> shift
    three = ((pair[:-1] << np.uint32(8) | text[2:]) * np.uint32(0x85EBCA77) + np.uint32(0x2545F491)) >> shift
    blank = pair == 0x2020
    two = (row + two)[~blank]
    inside = np.ones(len(three), bool)
    inside[(offsets[1:-1] + np.arange(1, n) - 1)[: max(n - 1, 0)]] = False  # would reach into the next text
    inside &= ~(blank[:-1] & blank[1:])
    three = (row[:-1] + three)[inside]
    size = n << BITS
    return (np.bincount(two, minlength=size) + np.bincount(three, minlength=size)).reshape(n, -1)


def blocks(texts: pa.Array) -> Iterator[np.ndarray]:
    for part in steps(texts):
        for at in range(0, len(part), ROWS):
            yield counts(*flat(part.slice(at, ROWS)))


def has_letter(texts: pa.Array) -> np.ndarray:
    return np.array([t is not None and any(map(str.isalpha, t)) for t in texts.to_pylist()], bool)


def vectors(grams: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = _ROOT[np.minimum(grams, len(_ROOT) - 1)] * idf
    return v / np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), 1e-9)[:, None]


@dataclass(frozen=True)
class Centroids:
    langs: tuple[str, ...]
    owner: np.ndarray  # language of each centroid
    centre: np.ndarray
    idf: np.ndarray
    least: np.ndarray  # cosine of rejection, by language

    def predict(self, texts: pa.Array) -> pa.StructArray:
        lang, cosine = np.zeros(len(texts), int), np.zeros(len(texts), np.float64)
        at = 0
        for grams in blocks(texts) if self.langs else ():
            near = vectors(grams, self.idf) @ self.centre.T
            best = near.argmax(axis=1)
            lang[at : at + len(near)], cosine[at : at + len(near)] = self.owner[best], near.max(axis=1)
            at += len(near)
        known = has_letter(texts) & bool(self.langs)
        cosine = np.where(known, np.clip(cosine, 0, 1), 0)
        names = np.array([*self.langs, "und"], object)[np.where(known, lang, len(self.langs))]
        rejected = ~known | (cosine < np.append(self.least, 0)[lang])
        return struct(lang_pred=pa.array(names.tolist(), pa.string()), score=pa.array(cosine), rejected=pa.array(rejected))


def k_means(v: np.ndarray, k: int, seed: int = 1, rounds: int = 15) -> np.ndarray:
    """Unit centroids of unit vectors; far-apart vectors come first."""
    rng = np.random.default_rng(seed)
    pick = [int(rng.integers(len(v)))]
    for _ in range(min(k, len(v)) - 1):
        gap = np.clip(1 - (v @ v[pick].T).max(axis=1), 1e-12, None)
        pick.append(int(rng.choice(len(v), p=gap / gap.sum())))
    centre = v[pick]
    for _ in range(rounds):
        own = (v @ centre.T).argmax(axis=1)
        centre = np.stack([v[own == c].mean(axis=0) if (own == c).any() else centre[c] for c in range(len(centre))])
        centre /= np.maximum(np.linalg.norm(centre, axis=1), 1e-9)[:, None]
    return centre


@dataclass(frozen=True)
class Blocks:
    """Centroids of more languages than one block has; the nearest of all blocks counts."""

    parts: tuple[Centroids, ...]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task, the weighted share of texts that have each gram, from rows (weight, text)."""
    total = np.zeros(1 << BITS)
    for b in batches:
        weight, at = b.column(0).to_numpy().astype(np.float32), 0
        for grams in blocks(b.column(1)):
            total += weight[at : at + len(grams)] @ (grams > 0)
            at += len(grams)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["g", "p"])


def train(df: DataFrame, where: Column | None = None, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", bound: int = BOUND, block: int = LANGUAGES) -> Centroids | Blocks:
    """Learn from the rows of ``df`` with a text and a language for which ``where`` holds."""
    ship(df.sparkSession)
    shared = Shared(df.sparkSession)
    known = df.where(F.lit(True) if where is None else where).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    known = known.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), text_of(known, text_col).alias("text"))
    sizes = shared.save(known.groupBy("lang").agg(F.count("*").alias("n")))
    many = sizes.count()
    if not many:
        return Centroids((), np.zeros(0, int), np.zeros((0, 1 << BITS), np.float32), np.ones(1 << BITS, np.float32), np.zeros(0))
    each = max(20, bound // many)
    weights = sizes.select("lang", (1 / (F.col("n") * many)).alias("w"), F.least(F.lit(SPACE), F.floor(F.lit(float(SPACE * each)) / F.col("n"))).alias("odds"))
    known = known.join(F.broadcast(weights) if many <= block else weights, "lang")  # a few bytes a language
    shares = known.select("w", "text").mapInArrow(_frequencies, "g bigint, p double").groupBy("g").agg(F.sum("p"))
    p = np.zeros(1 << BITS)
    for g, x in shares.collect():  # at most 2^BITS rows
        p[g] = x
    idf = (np.log((1 + RARE) / (RARE + p.round(9))) + 1).astype(np.float32)
    drawn = known.where(hash_share("id", F.xxhash64("text")) < F.col("odds")).groupBy("lang", F.xxhash64("text")).agg(F.first("text").alias("text"))  # copies count once
    if many <= block:
        return _centroids(drawn, idf)
    parts = -(-many // block)
    part = F.pmod(F.xxhash64("lang"), F.lit(parts))
    drawn = shared.save(drawn.select("lang", "text", part.alias("part")))
    return Blocks(tuple(_centroids(drawn.where(F.col("part") == i), idf) for i in range(parts)))


def _centroids(drawn: DataFrame, idf: np.ndarray) -> Centroids:
    """Of the languages of a block, from a bounded number of texts each."""

    def run(texts: pa.Array) -> pa.Array:
        grams = [g for block in blocks(texts) for g in block]
        at = [np.flatnonzero(g) for g in grams]
        return struct(at=lists(at, pa.int16()), n=lists([np.minimum(g[a], 32767) for g, a in zip(grams, at)], pa.int16()))

    got = extend(drawn, run, "struct<at:array<smallint>,n:array<smallint>>", F.col("text"), ["lang"]).toArrow()
    order = np.array(got.column("lang").to_pylist(), object)
    langs = tuple(sorted(set(order)))
    owner, centre, least = [], [], []
    for k, lang in enumerate(langs):
        part = got.filter(pa.array(order == lang)).combine_chunks()
        grams = np.zeros((part.num_rows, 1 << BITS), np.int32)
        for i, (a, m) in enumerate(zip(part.column("at"), part.column("n"))):
            grams[i, a.values.to_numpy()] = m.values.to_numpy()
        v = vectors(grams, idf)
        v = v[np.lexsort(v[:, :3].T)]  # whatever order the rows came in
        c = k_means(v, CENTROIDS)
        owner += [k] * len(c)
        centre.append(c)
        least.append(float(np.quantile((v @ c.T).max(axis=1), QUANTILE)) - MARGIN)
    centre = np.concatenate(centre).astype(np.float32) if centre else np.zeros((0, 1 << BITS), np.float32)
    return Centroids(langs, np.array(owner, int), centre, idf, np.array(least))


def identify(df: DataFrame, model: Centroids | Blocks, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``lang_pred`` (string), ``score`` (cosine, 0 to 1) and ``rejected`` (boolean)."""
    if isinstance(model, Centroids):
        return extend(df, model.predict, "struct<lang_pred:string,score:double,rejected:boolean>", df[text_col].cast("string"), keep)
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in ("lang_pred", "score", "rejected")]
    text = fresh(df, "__text")
    out, names = df.select(*keep, df[text_col].cast("string").alias(text)), []
    for part in model.parts:  # one after the other, so a worker holds one block
        names.append(fresh(out, "__near"))
        fields = ("lang_pred", "score", "rejected")
        run = lambda texts, part=part, fields=fields, name=names[-1]: struct(**{f"{name}{i}": part.predict(texts).field(f) for i, f in enumerate(fields)})
        out = extend(out, run, f"struct<{names[-1]}0:string,{names[-1]}1:double,{names[-1]}2:boolean>", F.col(text))
        out = out.withColumn(names[-1], F.struct(F.col(names[-1] + "1").alias("score"), F.lit(-len(names)).alias("at"), F.col(names[-1] + "0").alias("lang"), F.col(names[-1] + "2").alias("rejected"))).drop(*[names[-1] + i for i in "012"])
    best = F.greatest(*names)
    return out.select(*keep, best["lang"].alias("lang_pred"), best["score"].alias("score"), best["rejected"].alias("rejected"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, crc_mod(docs, "doc_id", 4) != 2)
    out = identify(docs, model, keep=["doc_id"])
    return out.select("doc_id", (crc_mod(out, "doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
