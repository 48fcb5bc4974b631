"""Operator 5, best-fit packing under conflicts.

Documents are packed into bins of ``capacity`` units, each followed by one
separator.  A document that doesn't fit is cut: full pieces take a bin each, the rest is
packed.  Rests are dealt evenly to groups of about ``GROUP`` rows by a hash of the
row, so a hot source or cluster is spread over all groups, and each group is packed
by one task, longest rest first.  Bins that are more than 1 / ``LOOSE`` empty are then taken
apart and their rests packed again, in as many fewer groups, and so on until one
group is left or a round no longer shrinks them: what groups leave half empty fills up across groups.

Open bins stand in order of what they have left, as a bitmap over residuals.  A
bin carries a bitmap of its sources and one of its duplicate clusters.  It may hold one
document of a cluster, and of a source as many as its share of all units calls for
times ``SLACK``, which is one for a rare source: a source that has a third of all units gets half
of a bin's places, so that it can be packed at all.  The successor search starts at the smallest residual that fits
and goes on until a bin without conflict is found, which is the tightest one; if
there is none, a bin is opened.  Copies of equal length follow one another, so a
search resumes where the last one ended: bins passed by still conflict.  For hot
sources (at least 1/16 of all units, so at most 16) a bitmap of their own lists the residuals with a bin still open to them.

Bins depend on what rows hold, not on how they are stored: a group and a place in it
come from a hash of id, length, source and cluster.  Rows equal in all four are
numbered, and which of them goes where makes no difference to the result.

Cases: null and empty texts take the separator alone.  A null source or cluster
conflicts with nothing.  Rows that repeat are packed each.  No row is dropped:
pieces of a document add up to it, however long.  Other columns may have any name.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.llm import simhash, token_count
from vertexloom.llm.common import Shared, ship, table, text_of

#: Units a bin holds, rows a group holds, and what share (one in so many units) makes a source hot, which is then indexed.
CAPACITY, GROUP, HOT = 4096, 16_384, 16
SLACK = 1.5
#: Bins are packed again if more than one in so many of their units is free, as long as a round leaves at most ``SHRINK`` of the rows it had.
LOOSE, SHRINK = 64, 0.5
#: Equal rows are numbered in runs of so many, so no array gets longer.
RUN = 1 << 16


class Bins:
    """Open bins of one group, by residual."""

    def __init__(self, capacity: int, quota: dict[int, int], hot: Sequence[int]):
        self.capacity, self.quota = capacity, quota
        self.left: list[int] = []
        self.sources: list[int] = []  # bitmap by bin
        self.clusters: list[int] = []
        self.at: dict[int, list[int]] = defaultdict(list)
        self.occupied = 0
        self.bits: dict[int, int] = {}  # bits of a source's places
        self.width = 0
        for s in hot:
            self._places(s)
        self.open = {s: [0, Counter()] for s in hot}
        self.resume = (None, 0, 0)

    def _places(self, source: int) -> int:
        """The bitmap of all places of ``source``; 0 if it has no limit."""
        if source < 0:
            return 0
        bits = self.bits.get(source)
        if bits is None:
            many = self.quota.get(source, 1)
            bits = self.bits[source] = ((1 << many) - 1) << self.width
            self.width += many
        return bits

    def _list(self, b: int) -> None:
        r = self.left[b]
        if not r:
            return
        self.at[r].append(b)
        self.occupied |= 1 << r
        for s, held in self.open.items():
            if self.sources[b] & self.bits[s] != self.bits[s]:
                held[1][r] += 1
                held[0] |= 1 << r

    def _unlist(self, r: int, i: int) -> int:
        b = self.at[r].pop(i)
        if not self.at[r]:
            self.occupied &= ~(1 << r)
        for s, held in self.open.items():
            if self.sources[b] & self.bits[s] != self.bits[s]:
                held[1][r] -= 1
                if not held[1][r]:
                    held[0] &= ~(1 << r)
        return b

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and offset of a piece; ``cluster`` is a bitmap of one bit, 0 for none."""
        places = self._places(source)
        key = (size, source, cluster)
        r, i = self.resume[1:] if cluster and self.resume[0] == key else (size, 0)
        held = self.open.get(source)
        b = None
        while True:
            up = (self.occupied if held is None else held[0]) >> r
            if not up:
                break
            step = (up & -up).bit_length() - 1
            r, i = r + step, i if step == 0 else 0
            bins = self.at[r]
            while i < len(bins):
                c = bins[i]
                if not self.clusters[c] & cluster and (not places or self.sources[c] & places != places):
                    b = c
                    break
                i += 1
            if b is not None:
                break
            r, i = r + 1, 0
        self.resume = (key, r, i)
        if b is None:
            b = len(self.left)
            self.left.append(self.capacity)
            self.sources.append(0)
            self.clusters.append(0)
        else:
            self._unlist(r, i)
        offset = self.capacity - self.left[b]
        self.left[b] -= size
        if places:
            free = places & ~self.sources[b]
            self.sources[b] |= free & -free
        self.clusters[b] |= cluster
        self._list(b)
        return b, offset


def pack(sizes: Sequence[int], sources: Sequence[int], clusters: Sequence[int], capacity: int, quota: dict[int, int], hot: Sequence[int] | None = None):
    """(bin, offset) of each rest, in the given order; a source or cluster below 0 is none.  ``hot`` sources, by default all with a quota, are indexed."""
    many = Counter(c for c in clusters if c >= 0)
    number: dict[int, int] = {}
    bins = Bins(capacity, quota, list(quota) if hot is None else hot)
    out = []
    for size, s, c in zip(sizes, sources, clusters):
        bit = 1 << number.setdefault(c, len(number)) if c >= 0 and many[c] > 1 else 0
        out.append(bins.place(size, s, bit))
    return out, len(bins.left)


def _pack_group(capacity: int, quota: dict[str, int], hot: list[str], first_turn: bool, last: bool):
    """Pack the rests of a group; ``done`` is false for those of bins to be taken apart."""

    def run(t: pa.Table) -> pa.Table:
        rest, group = t.column("rest").to_numpy(), t.column("group")[0].as_py() if t.num_rows else 0
        source, cluster = t.column("source").to_pylist(), t.column("cluster").to_pylist()
        names = {s: i for i, s in enumerate(dict.fromkeys([*quota, *sorted({s for s in source if s is not None})]))}
        code = np.array([-1 if s is None else names[s] for s in source], np.int64)
        kinds = {c: i for i, c in enumerate(sorted({c for c in cluster if c is not None}))}
        dup = np.array([-1 if c is None else kinds[c] for c in cluster], np.int64)
        order = np.lexsort((t.column("row").to_numpy(), code, dup, -rest))
        spots, used = pack(rest[order].tolist(), code[order].tolist(), dup[order].tolist(), capacity, {names[s]: q for s, q in quota.items()}, [names[s] for s in hot])
        spot = np.zeros((len(rest), 2), np.int64)
        spot[order] = np.array(spots, np.int64).reshape(-1, 2)
        held = np.bincount(spot[:, 0], rest, used)
        done = (capacity - held) * LOOSE <= capacity if not last else np.ones(used, bool)
        out = {n: t.column(n) for n in ("id", "n", "rest", "source", "cluster", "row", "copy")}
        first = t.column("first").to_numpy(zero_copy_only=False)
        if first_turn:  # bins of full pieces come after the others
            pieces = (t.column("n").to_numpy() + 1 - rest) // (capacity - 1)
            first = np.zeros(len(rest), np.int64)
            first[order] = (group << 32) + used + np.cumsum(pieces[order]) - pieces[order]
        return pa.table(out | {"first": pa.array(first), "bin": pa.array((group << 32) + spot[:, 0]), "at": pa.array(spot[:, 1]), "done": pa.array(done[spot[:, 0]])})

    return run


def pack_documents(df: DataFrame, units: Column, id_col: str = "doc_id", source: Column | None = None, cluster: Column | None = None, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """One row a piece: id, ``piece``, ``piece_start``, ``n_units``, ``bin_id`` and ``bin_offset``."""
    if capacity < 2:
        raise ValueError("a bin must hold a unit and a separator")
    ship(df.sparkSession)
    shared, none, body = Shared(df.sparkSession), F.lit(None), capacity - 1
    slim = df.select(df[id_col].alias("id"), F.coalesce(units, F.lit(0)).cast("long").alias("n"), (none if source is None else source).cast("string").alias("source"), (none if cluster is None else cluster).cast("long").alias("cluster"))
    key = ["id", "n", "source", "cluster"]
    slim = slim.groupBy(*key).agg((F.count("*") - 1).alias("last")).select(*key, "last", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"), F.lit(RUN))).alias("from"))
    slim = slim.select(*key, F.explode(F.sequence("from", F.least(F.col("from") + RUN - 1, "last"))).alias("copy"))
    full = F.floor(F.greatest(F.col("n") - 1, F.lit(0)) / body)  # pieces that fill a bin, before the rest
    slim = shared.save(slim.withColumns({"rest": (F.col("n") - full * body + 1).cast("long"), "row": F.xxhash64(F.col("id").cast("string"), "n", "source", "cluster", "copy"), "first": F.lit(0).cast("long")}))
    count, total = slim.agg(F.count("*"), F.coalesce(F.sum(F.col("n") + 1), F.lit(0))).first()
    by_source = slim.where("source IS NOT NULL").groupBy("source").agg(F.sum(F.col("n") + 1).alias("u"))
    in_a_bin = max(1.0, capacity * count / max(total, 1))
    large = by_source.where((F.col("u") * HOT >= total) | (F.col("u") * in_a_bin * SLACK > total)).collect()  # at most capacity * SLACK rows
    quota = {s: max(1, int(np.ceil(u / total * in_a_bin * SLACK))) for s, u in sorted(large, key=lambda x: x[0])}
    hot = sorted(s for s, u in large if u * HOT >= total)
    kind = slim.schema["id"].dataType.simpleString()
    placed, rows, left, turn = [], slim, count, 0
    while True:
        groups = max(1, -(-left // group))
        last = groups == 1
        dealt = rows.withColumn("group", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(groups)))
        done = shared.save(dealt.groupBy("group").applyInArrow(_pack_group(capacity, quota, hot, not turn, last), f"id {kind}, n long, rest long, source string, cluster long, row long, copy long, first long, bin long, at long, done boolean"))
        before, left = left, 0 if last else done.where("NOT done").count()
        end = not left or left > SHRINK * before  # a further round would do no better: its bins stay as they are
        placed.append((done if end else done.where("done")).select("id", "n", "rest", "first", (F.col("bin") + (turn << 56)).alias("bin"), "at"))
        if end:
            break
        rows, turn = done.where("NOT done").drop("bin", "at", "done"), turn + 1
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    pieces = F.floor((F.col("n") + 1 - F.col("rest")) / body)
    out = out.select("*", F.explode(F.sequence(F.lit(0).cast("long"), pieces)).alias("piece"), pieces.alias("pieces"))
    own = F.col("piece") == F.col("pieces")
    out = out.select("id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * body).alias("piece_start"), F.when(own, F.col("rest") - 1).otherwise(F.lit(body)).cast("long").alias("n_units"), F.when(own, F.col("bin")).otherwise(F.col("first") + F.col("piece")).alias("bin_id"), F.when(own, F.col("at")).otherwise(F.lit(0)).alias("bin_offset"))
    return out.withColumnRenamed("id", id_col)


def near_copies(df: DataFrame, shared: Shared, text_col: str = "text") -> DataFrame:
    """``df`` without its text, with ``cluster``: the least fingerprint of a text's near copies (operator 2, over lower-cased texts); null for texts without a word."""
    rows = shared.save(simhash.with_fingerprint(df.withColumn(text_col, F.lower(text_of(df, text_col))), text_col, [c for c in df.columns if c != text_col]))
    known = shared.save(simhash.linked(rows.select(F.col("fp").alias("id"), "fp"), shared).select("fp", "n", F.col("component_id").alias("cluster")))
    out = simhash.hub_join(rows, known, "fp", "n")
    return out.select(*[c for c in rows.columns if c != "fp"], F.when(F.col("fp") != 0, F.col("cluster")).alias("cluster"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths in tokens of operator 3, clusters of near copies by operator 2."""
    docs = token_count.count_tokens(table(spark, sf_dir, "documents")).select("doc_id", "source", "text", F.col("n_tokens").alias("units"))
    rows = near_copies(docs, Shared(spark))
    return pack_documents(rows, rows["units"], source=rows["source"], cluster=rows["cluster"])
