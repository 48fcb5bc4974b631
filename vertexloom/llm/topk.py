"""Operator 10, exact top-k search by multi-resolution segment statistics.

Components times ``scale`` are rounded down to whole numbers.  A vector is cut into segments, and of
each segment its mean and deviation are kept, at several resolutions.  By
Cauchy-Schwarz the inner product over a segment of length m is at most
m * (mean_x * mean_y + dev_x * dev_y); equivalently the squared distance is at
least m * ((mean_x - mean_y)^2 + (dev_x - dev_y)^2).  Rows are first put into tiles
of similar coarse statistics; a tile whose envelope (ranges of its means, largest deviations)
falls below the k-th best score known is dropped whole.  Its rows are then dropped one by
one by their own bounds, from coarse to fine; only survivors get an exact product.
Bounds are of unit vectors in single precision, with an allowance for rounding
that exceeds its error; exact products are of whole numbers, in doubles where these hold
them and in Python's integers elsewhere.

The stated queries are taken in blocks of ``BLOCK`` bytes, so large that reading the rows
once a block costs next to nothing beside the work on them.  The k-th best
score among a bounded sample of rows comes first, as a floor; then each task keeps
at most k rows a query of its part, none below the floor, and these are merged by a ranked
window that cuts to k before it shuffles.  No pair is written out.  Blocks are
written to the shared folder one after the other.

Cases: vectors that are null, empty, or hold a null or non-finite component, and
rows without id take no part.  Only vectors of equal length are compared.  Rows with
the query's id are the query's own and are no candidates; otherwise rows that
repeat are ranked each.  Equal scores go to the smaller id.  A query id that
repeats is answered once a distinct vector.  Scores beyond 64 bits are ranked by
their exact values and returned as the nearest long.  Other columns may have any
name.  Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vertexloom.llm.common import Shared, ship, table
from vertexloom.llm.labelled import hash_share, share

#: Bytes of queries in a block; queries that a task looks at together; rows of a tile.
BLOCK, TOGETHER, TILE = 64 << 20, 1024, 256
#: Rows sampled for the first floor: at most SEED, and one in THIN.
SEED, THIN = 65_536, 16
#: Beyond this a component's products aren't bounded in doubles: such vectors are never pruned.
VAST = 1e140
_LONG = (1 << 63) - 1


def usable(v: Column) -> Column:
    v = v.cast("array<double>")
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))


def resolutions(dim: int) -> list[int]:
    """Numbers of segments, coarse to fine."""
    return sorted({4**i for i in range(12) if 4**i * 2 < dim} | {p for p in (dim // 2, dim * 3 // 4) if 0 < p < dim})


def segments(x: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """sqrt(m) * mean and sqrt(m) * deviation of each segment, so that plain products are the bound."""
    dim = x.shape[1]
    cut = np.arange(parts) * dim // parts
    m = np.diff(np.append(cut, dim)).astype(float)
    mean = np.add.reduceat(x, cut, axis=1) / m
    dev = np.sqrt(np.maximum(np.add.reduceat(x * x, cut, axis=1) / m - mean * mean, 0))
    return mean * np.sqrt(m), dev * np.sqrt(m)


class Vectors:
    """Whole-number vectors of one length, their norms, and statistics of their directions."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray, scale: float):
        self.ids, self.raw, self.scale = ids, raw, scale
        with np.errstate(over="ignore", invalid="ignore"):
            self.x = np.floor(raw * scale)
            peak = np.abs(self.x).max(axis=1, initial=0)
            self.vast = ~(peak < VAST)
            some = (peak > 0) & ~self.vast
            unit = np.where(some[:, None], self.x / np.where(some, peak, 1)[:, None], 0)
            long = np.sqrt((unit * unit).sum(axis=1))
            self.norm, self.peak, self.total = peak * long, peak, np.abs(self.x).sum(axis=1)
        unit /= np.where(long > 0, long, 1)[:, None]
        self.levels = [segments(unit, p) for p in resolutions(raw.shape[1])]
        self.stats = [np.hstack(s).astype(np.float32) for s in self.levels]

    def whole(self, i: int) -> list[int]:
        """A vector as Python's integers."""
        return [int(v) if np.isfinite(v) else int(r) * int(self.scale) for v, r in zip(self.x[i].tolist(), self.raw[i].tolist())]


def slack(width: int) -> float:
    """More than single precision can be off in a product of two vectors of norm 1 and ``width`` entries."""
    return 4e-6 + 2.4e-7 * width


def tiles(stats: np.ndarray, most: int) -> list[np.ndarray]:
    """Rows in groups of at most ``most``, halved again and again where their statistics spread widest."""
    out, todo = [], [np.arange(len(stats))]
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            out.append(rows)
            continue
        part = stats[rows]
        order = np.argsort(part[:, np.ptp(part, axis=0).argmax()], kind="stable")
        half = len(rows) // 2
        todo += [rows[order[half:]], rows[order[:half]]]
    return out


class Block:
    """Queries of one length, with the best rows seen so far and scores that others are known to reach."""

    def __init__(self, no: np.ndarray, queries: Vectors, k: int, floor: np.ndarray | None = None):
        self.no, self.q, self.k = no, queries, k
        self.scores, self.found = np.full((len(no), k), -np.inf), np.full((len(no), k), _LONG)
        self.floor = np.full(len(no), -np.inf) if floor is None else floor
        self.looked = np.zeros(len(queries.stats) + 2, np.int64)  # pairs in all, in tiles that stayed, and after each resolution
        self.limit = self._limits(np.arange(len(no)))

    def _limits(self, at: np.ndarray) -> np.ndarray:
        """What a row's norm times its bound must reach, by query."""
        last = self.scores[at, -1]
        if last.dtype == object:
            last = np.array([float(v) if abs(v) < 1e300 else -np.inf for v in last])
        with np.errstate(divide="ignore", invalid="ignore"):
            out = np.maximum(last, self.floor[at]) / self.q.norm[at]
        out[np.isnan(out) | self.q.vast[at] | (self.q.norm[at] == 0)] = -np.inf
        return out

    def offer(self, rows: Vectors) -> None:
        if not len(rows.ids):
            return
        coarse = np.hstack(rows.levels[min(1, len(rows.levels) - 1)]) if rows.levels else np.zeros((len(rows.ids), 1))
        for tile in tiles(coarse, TILE):
            for at in range(0, len(self.no), TOGETHER):
                self._tile(np.arange(at, min(at + TOGETHER, len(self.no))), rows, tile)

    def _tile(self, q: np.ndarray, rows: Vectors, tile: np.ndarray) -> None:
        self.looked[0] += len(q) * len(tile)
        free = rows.vast[tile].any()
        if rows.levels and not free:
            mine, theirs = (v.levels[min(1, len(v.levels) - 1)] for v in (self.q, rows))
            mean, dev = (s[tile] for s in theirs)
            bound = np.maximum(mine[0][q], 0) @ mean.max(axis=0) + np.minimum(mine[0][q], 0) @ mean.min(axis=0) + mine[1][q] @ dev.max(axis=0) + 1e-6
            norm = rows.norm[tile]
            q = q[np.maximum(bound * norm.max(), bound * norm.min()) >= self.limit[q]]
        self.looked[1] += len(q) * len(tile)
        if not len(q):
            return
        mask = None
        if rows.levels and not free:
            top = max(rows.norm[tile].max(), 1e-300)
            need = np.clip(self.limit[q] / top, -1e30, 1e30).astype(np.float32)[:, None] * np.clip(top / np.maximum(rows.norm[tile], 1e-300), 1, 1e30).astype(np.float32)
            for n, (mine, theirs) in enumerate(zip(self.q.stats, rows.stats)):
                stay = mine[q] @ theirs[tile].T + np.float32(slack(mine.shape[1])) >= need
                mask = stay if mask is None else mask & stay
                own = mask.any(axis=1)
                if not own.all():
                    q, mask, need = q[own], mask[own], need[own]
                self.looked[2 + n] += int(mask.sum())
                if not len(q):
                    return
        row, col = np.nonzero(mask) if mask is not None else (np.repeat(np.arange(len(q)), len(tile)), np.tile(np.arange(len(tile)), len(q)))
        self._take(q[row], rows, tile[col])

    def _take(self, row: np.ndarray, rows: Vectors, col: np.ndarray) -> None:
        """Exact products of survivors, and the best of all."""
        other = self.q.ids[row] != rows.ids[col]
        row, col = row[other], col[other]
        plain = self.q.total[row] * rows.peak[col] < 2.0**53
        exact = np.full(len(row), -np.inf, float if plain.all() else object)
        exact[plain] = np.einsum("ij,ij->i", self.q.x[row[plain]], rows.x[col[plain]])
        if not plain.all():
            if self.scores.dtype != object:
                self.scores = self.scores.astype(object)
            mine, theirs = {i: self.q.whole(i) for i in np.unique(row[~plain])}, {i: rows.whole(i) for i in np.unique(col[~plain])}
            for i in np.flatnonzero(~plain):
                exact[i] = sum(a * b for a, b in zip(mine[row[i]], theirs[col[i]]))
        stay = (exact >= self.scores[row, -1]) & (exact >= self.floor[row])
        row, score, cand = row[stay.astype(bool)], exact[stay.astype(bool)], rows.ids[col[stay.astype(bool)]]
        if not len(row):
            return
        own, at = np.unique(row, return_inverse=True)
        at = np.append(np.repeat(np.arange(len(own)), self.k), at)
        score, cand = np.append(self.scores[own].ravel(), score), np.append(self.found[own].ravel(), cand)
        order = np.lexsort((cand, -(np.unique(score, return_inverse=True)[1] if score.dtype == object else score), at))
        at, score, cand = at[order], score[order], cand[order]
        top = np.arange(len(at)) - np.searchsorted(at, np.arange(len(own)))[at] < self.k
        self.scores[own], self.found[own] = score[top].reshape(-1, self.k), cand[top].reshape(-1, self.k)
        self.limit[own] = self._limits(own)

    def rows(self) -> pa.RecordBatch:
        q, r = np.nonzero(self.scores > -np.inf)
        score = self.scores[q, r]
        wide = [_key(v) for v in score] if score.dtype == object else [None] * len(score)
        near = [max(-_LONG - 1, min(_LONG, int(v))) for v in score] if score.dtype == object else score.astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(self.no[q], pa.int64()), pa.array(self.q.ids[q], pa.int64()), pa.array(self.found[q, r], pa.int64()), pa.array(near, pa.int64()), pa.array(wide, pa.string())], ["no", "query_id", "id", "score", "wide"])


_OTHER = str.maketrans("0123456789", "9876543210")


def _key(v: int) -> str | None:
    """Orders numbers beyond 64 bits as text; None for others."""
    v, digits = int(v), str(abs(int(v)))
    if abs(v) < _LONG:
        return None
    return f"{len(digits):05d}{digits}" if v > 0 else f"{99999 - len(digits):05d}{digits.translate(_OTHER)}"


_ROW = "no bigint, query_id bigint, id bigint, score bigint, wide string"


def _through(queries, k: int, scale: float, result):
    """A task: all its rows are offered to all queries of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = {dim: Block(no, Vectors(ids, x, scale), k, floor) for dim, (no, ids, x, floor) in queries.value.items()}
        for b in batches:
            dims = b.column("v").value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                if dim in blocks:
                    part = b.filter(pa.array(dims == dim))
                    blocks[dim].offer(Vectors(part.column("id").to_numpy(), _matrix(part.column("v"), dim), scale))
        yield from map(result, blocks.values())

    return run


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _report(block: Block) -> pa.RecordBatch:
    names = ["all", "tiles", *map(str, resolutions(block.q.x.shape[1]))]
    return pa.RecordBatch.from_arrays([pa.array(names), pa.array(block.looked)], ["step", "pairs"])


def _held(got: pa.Table, shift: int, floors: dict[int, float]) -> dict:
    """A block's queries by length: numbers, ids, vectors, floors."""
    ids, v = got.column("id").to_numpy(), got.column("v").combine_chunks()
    dims, out = v.value_lengths().to_numpy(zero_copy_only=False), {}
    for dim in np.unique(dims):
        own = np.flatnonzero(dims == dim)
        out[int(dim)] = (own + shift, ids[own], _matrix(v.take(pa.array(own)), dim), np.array([floors.get(i + shift, -np.inf) for i in own.tolist()]))
    return out


def _floors(got: pa.Table, k: int) -> dict[int, float]:
    """The k-th best score of each query in a sample of rows."""
    no, score = got.column("no").to_numpy(), got.column("score").to_numpy()
    wide = set(no[~got.column("wide").is_null().to_numpy()].tolist())
    order = np.lexsort((-score, no))
    no, score = no[order], score[order]
    at = np.searchsorted(no, np.unique(no)) + k - 1
    return {int(n): float(score[i]) for n, i in zip(np.unique(no), at) if i < len(no) and no[i] == n and int(n) not in wide}


def searched(df: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int, scale: float, block: int, result, schema: str) -> tuple[Shared, list[DataFrame]]:
    spark = df.sparkSession
    ship(spark)
    shared, out = Shared(spark), []
    take = lambda d: d.where(usable(d[vector_col]) & d[id_col].isNotNull()).select(d[id_col].cast("long").alias("id"), d[vector_col].cast("array<double>").alias("v"))
    rows, asked = shared.save(take(df)), shared.save(take(queries).distinct())
    size = asked.agg(F.sum(F.size("v"))).first()[0] or 0
    many, count = -(-size * 8 // block), rows.count()
    seeds = rows.where(hash_share(F.col("id")) < share(min(SEED, -(-count // THIN)), count))
    for b in range(many):
        part = asked if many == 1 else asked.where(F.pmod(F.xxhash64("id", "v"), F.lit(many)) == b)
        got, floors = part.toArrow(), {}  # about ``block`` bytes
        for stage in ("floor", "search"):
            sent = spark.sparkContext.broadcast(_held(got, b << 40, floors))
            if stage == "floor":
                best = seeds.mapInArrow(_through(sent, k, scale, Block.rows), _ROW)
                floors = _floors(_best(best, k).toArrow(), k)  # k rows a query
            else:
                out.append(shared.save(rows.mapInArrow(_through(sent, k, scale, result), schema)))
            sent.destroy()
    return shared, out


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("no").orderBy(F.desc("score"), F.desc("wide"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: float = 256.0, block: int = BLOCK) -> DataFrame:
    """For each row of ``queries`` the ``k`` rows of ``df`` of highest integer inner product: query_id, rank, id, score."""
    _, found = searched(df, queries, id_col, vector_col, k, scale, block, Block.rows, _ROW)
    every = df.sparkSession.read.schema(_ROW).parquet(*[f._loom_path for f in found]) if found else df.sparkSession.createDataFrame([], _ROW)
    return _best(every, k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def survivors(df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: float = 256.0, block: int = BLOCK) -> DataFrame:
    """How many pairs are left by step: all, those of tiles that stay, and those that stay at each resolution; the last get an exact product."""
    _, found = searched(df, queries, id_col, vector_col, k, scale, block, _report, "step string, pairs bigint")
    every = df.sparkSession.read.schema("step string, pairs bigint").parquet(*[f._loom_path for f in found])
    return every.groupBy("step").agg(F.sum("pairs").alias("pairs"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where(F.col("vec_id") % 50 == 0))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
