"""Operator 2, SimHash near-duplicates over a Gray-order hierarchical index.

Equal fingerprints are first folded into one class each, so that a group of
copies of any size is one entry.  All classes stand in Gray order.  That order is
cut into cells by the leading bits, as many as make a cell hold about ``CELL``
classes; a cell of more than ``HOT`` is cut again by the bits that follow.  A class
owns a place in its cell and visits the cells whose leading bits differ from its
own in at most two places; of two cells that are near each other only one is
visited, so a pair is met once.

In a cell the order puts fingerprints that share bits side by side.  Runs of
``FAN`` neighbours form a node that holds the bits they all share (mask and
pattern), runs of nodes form upper nodes, and each node keeps only the bits its
parent lacks.  A search carries the differences accumulated on the way down and
drops a whole group once they exceed two; ``GrayIndex.compared`` counts what it
looked at by level.

Cells put out one row a class (its links, and the root of its part of the
cell), never a row a pair: a class has at most 2080 neighbours within two bits.
Components over all cells come from alternating large and small stars, each round
written to the shared folder.  Where a key has more than ``HUB`` rows, what is known of it is
broadcast (there are at most rows / HUB such keys) and its rows stay where they are.

Cases: null or wordless text has fingerprint zero and is linked like any other.
Texts of any length are read whole.  Rows that repeat, ids included, count as
documents of their own.  A null id takes part in links; ``component_id`` is the
smallest non-null id reachable, null if there is none.  Only the named columns
are read, so others may have any name.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.llm.common import Shared, extend, flat, ship, steps, struct, table, text_of

BITS, REACH, FAN = 64, 2, 8
#: Classes that a cell holds, about, and beyond which it is cut again.
CELL, HOT = 32_768, 131_072
#: Rows of one key beyond which a join doesn't move them.
HUB = 1_000_000
#: Comparisons made at a time; text bytes that are hashed at a time; shingles whose bits are counted at a time.
WORK, STEP, VOTES = 1 << 20, 1 << 19, 1 << 15

_P1, _P2, _P3, _P4, _P5 = (np.uint64(k) for k in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_SEED = 42
_SPACE, _LOWER = np.zeros(256, bool), np.arange(256, dtype=np.uint8)
_SPACE[9:14] = _SPACE[32] = True
_LOWER[65:91] += 32


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return x << np.uint64(n) | x >> np.uint64(64 - n)


def xxh64(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """XXH64 of slices of ``data``, which has 8 bytes to spare at its end.  Slices of 32 bytes or more go to the library."""
    out = np.empty(len(begin), np.uint64)
    if (size >= 32).any():
        import xxhash

        raw, at = data.tobytes(), np.flatnonzero(size >= 32)
        out[at] = np.fromiter((xxhash.xxh64_intdigest(raw[b : b + n], _SEED) for b, n in zip(begin[at].tolist(), size[at].tolist())), np.uint64, len(at))
    short = np.flatnonzero(size < 32)
    begin, size = begin[short], size[short]
    h = size.astype(np.uint64) + _P5 + np.uint64(_SEED)
    eight, four = (np.ndarray((len(data) - 7,), kind, data, 0, (1,)) for kind in ("<u8", "<u4"))  # a number at every byte
    for lane in range(3):
        own = np.flatnonzero(size >= 8 * (lane + 1))
        h[own] = _turn(h[own] ^ (_turn(eight[begin[own] + 8 * lane] * _P2, 31) * _P1), 27) * _P1 + _P4
    at = begin + (size & ~7)
    own = np.flatnonzero(size & 4)
    h[own] = _turn(h[own] ^ (four[at[own]].astype(np.uint64) * _P1), 23) * _P2 + _P3
    at += size & 4
    for k in range(3):
        own = np.flatnonzero((size & 3) > k)
        h[own] = _turn(h[own] ^ (data[at[own] + k].astype(np.uint64) * _P5), 11) * _P1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    out[short] = h ^ (h >> np.uint64(32))
    return out


def fingerprints(texts: pa.Array) -> np.ndarray:
    """64-bit majority of the XXH64 of all 3-word shingles, a text each."""
    out = [np.zeros(0, np.uint64)]
    for part in steps(texts, STEP):
        data, offsets = flat(part)
        space, some = _SPACE[data], offsets[:-1] < offsets[1:]
        word = ~space
        first, last = word.copy(), word.copy()
        first[1:] &= space[:-1]
        last[:-1] &= space[1:]
        heads, tails = offsets[:-1][some], offsets[1:][some] - 1
        first[heads], last[tails] = word[heads], word[tails]
        begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        size = end - begin
        place = np.cumsum(size + 1) - (size + 1)  # words side by side, with a space after each
        text = np.full(int((size + 1).sum()) + 8, 32, np.uint8)
        text[np.flatnonzero(word) + np.repeat(place - begin, size)] = _LOWER[data[word]]
        words = np.diff(np.searchsorted(begin, offsets))
        many = np.where(words >= 3, words - 2, np.minimum(words, 1))
        bound = np.concatenate([[0], np.cumsum(many)])
        head = np.repeat(np.cumsum(words) - words - bound[:-1], many) + np.arange(bound[-1])
        tail = head + np.repeat(np.minimum(words, 3), many) - 1
        h = xxh64(text, place[head], place[tail] + size[tail] - place[head])
        votes = np.zeros((len(part), BITS), np.int64)
        for at in range(0, len(h), VOTES):
            bits = np.unpackbits(h[at : at + VOTES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            own = np.arange(np.searchsorted(bound, at, side="right") - 1, np.searchsorted(bound, at + len(bits)))
            own = own[many[own] > 0]
            votes[own] += np.add.reduceat(bits, np.maximum(bound[own] - at, 0), axis=0, dtype=np.int32)
        out.append(np.packbits(votes * 2 > many[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0])
    return np.concatenate(out)


def fingerprint(text: str | None) -> int:
    return int(fingerprints(pa.array([text], pa.string()))[0])


def with_fingerprint(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``fp`` (long, the 64 bits as a signed number)."""
    return extend(df, lambda texts: struct(fp=pa.array(fingerprints(texts).view(np.int64))), "struct<fp:bigint>", text_of(df, text_col), keep)


def _bits(x: int) -> Column:
    """64 bits as a long."""
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def leading(bits: int) -> int:
    """The mask of the first ``bits`` bits."""
    return (1 << BITS) - (1 << (BITS - bits))


def visits(rows: DataFrame, depth: int, more: int) -> DataFrame:
    """Rows (fp, n, cell, apart) of cells of ``depth`` bits, once for each cell of ``more`` further bits that they own or visit.

    ``apart`` is in how many bits a class differs from its cell, 0 in its own.  The
    first flipped bit must be clear, so a class visits only cells above its own.
    """
    places = range(BITS - depth - more, BITS - depth)
    flips = [sum(1 << b for b in c) for r in range(REACH + 1) for c in combinations(places, r)]
    flip = F.explode(F.array(*[F.struct(_bits(m).alias("m"), F.lit(m.bit_count()).alias("c"), _bits(1 << m.bit_length() >> 1).alias("t")) for m in flips]))
    spread = rows.select("fp", "n", "cell", "apart", flip.alias("f")).where((F.col("apart") + F.col("f.c") <= REACH) & ((F.col("apart") > 0) | (F.col("fp").bitwiseAND(F.col("f.t")) == 0)))
    cell = F.col("cell").bitwiseOR(F.col("fp").bitwiseAND(_bits(leading(depth + more) & ~leading(depth))).bitwiseXOR(F.col("f.m")))
    return spread.select("fp", "n", cell.alias("cell"), (F.col("apart") + F.col("f.c")).alias("apart"))


def gray_rank(fp: Column) -> Column:
    """Where a fingerprint stands in the Gray sequence; the top bit is flipped so that signed order is unsigned order."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def _ragged(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (count[0] of them), begin[1], ..."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - count), count)


class GrayIndex:
    """Hierarchical index over fingerprints sorted by cell, then Gray rank; ``begins`` has where cells begin."""

    def __init__(self, fps: np.ndarray, begins: np.ndarray):
        self.fps = fps
        own = np.diff(np.append(begins, len(fps)))
        self.cell = np.repeat(np.arange(len(own)), own)
        level = {"pattern": fps, "mask": np.full(len(fps), ~np.uint64(0)), "last": np.arange(len(fps))}
        self.levels = [level]
        while own.max(initial=1) > 1:
            up = -(-own // FAN)  # nodes above, by cell
            below = np.cumsum(own) - own
            begin = np.repeat(below, up) + (np.arange(up.sum()) - np.repeat(np.cumsum(up) - up, up)) * FAN
            end = np.minimum(begin + FAN, np.repeat(below + own, up))
            some, every = np.bitwise_or.reduceat(level["pattern"], begin), np.bitwise_and.reduceat(level["pattern"], begin)
            shared = np.bitwise_and.reduceat(level["mask"], begin) & ~(some ^ every)
            level["rest"] = level["mask"] & ~np.repeat(shared, end - begin)
            level = {"pattern": every & shared, "mask": shared, "last": level["last"][end - 1], "begin": begin, "count": end - begin}
            self.levels.append(level)
            own = up
        self.compared = [0] * len(self.levels)

    @property
    def depth(self) -> int:
        """Levels of nodes above the fingerprints."""
        return len(self.levels) - 1

    def near(self, fps: np.ndarray, cells: np.ndarray, after: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, leaf) of all leaves of a query's cell that differ from it in at most REACH bits, block by block; only leaves beyond ``after``."""
        top = self.levels[-1]
        diff = np.bitwise_count((fps ^ top["pattern"][cells]) & top["mask"][cells])
        self.compared[-1] += len(fps)
        query = np.flatnonzero(diff <= REACH)
        todo = [(self.depth, query, cells[query], diff[query])]
        while todo:
            k, query, node, diff = todo.pop()
            if not k:
                yield query, node
                continue
            level, below = self.levels[k], self.levels[k - 1]
            count = level["count"][node]
            total = np.cumsum(count)
            if len(query) > 1 and total[-1] > WORK:
                cut = np.unique(np.append(np.searchsorted(total, np.arange(WORK, total[-1], WORK)), len(query)))
                todo += [(k, query[a:b], node[a:b], diff[a:b]) for a, b in zip([0, *cut[:-1]], cut) if b > a]
                continue
            child = _ragged(level["begin"][node], count)
            query, diff = np.repeat(query, count), np.repeat(diff, count)
            self.compared[k - 1] += len(child)
            diff = diff + np.bitwise_count((fps[query] ^ below["pattern"][child]) & below["rest"][child])
            stay = diff <= REACH
            if after is not None:
                stay &= below["last"][child] > after[query]
            if stay.any():
                todo.append((k - 1, query[stay], child[stay], diff[stay]))


def joined(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """The smallest member of each node's component; ``root`` has what is known so far."""
    root = np.arange(n) if root is None else root
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up


def link_block(cell: np.ndarray, apart: np.ndarray, fp: np.ndarray, n: np.ndarray):
    """(fp, links, root) of the classes with links, of whole cells in order, a cell's owners before its visitors."""
    owner = np.flatnonzero(apart == 0)
    if not len(owner):
        return fp[:0], n[:0], fp[:0]
    fps, owned = fp.view(np.uint64), cell[owner]
    begins = np.flatnonzero(np.append(True, owned[1:] != owned[:-1]))
    index = GrayIndex(fps[owner], begins)
    held = cell[owner[begins]]
    guest = np.flatnonzero(apart)
    at = np.minimum(np.searchsorted(held, cell[guest]), len(held) - 1)
    guest, at = guest[held[at] == cell[guest]], at[held[at] == cell[guest]]  # cells that nobody owns hold nothing
    links, root, a, b = np.zeros(len(fp), np.int64), np.arange(len(fp)), [], []
    for rows, found in ((owner, index.near(fps[owner], index.cell, np.arange(len(owner)))), (guest, index.near(fps[guest], at))):
        for q, leaf in found:
            i, j = rows[q], owner[leaf]
            np.add.at(links, i, n[j])
            np.add.at(links, j, n[i])
            a.append(i)
            b.append(j)
            if sum(map(len, a)) > 4 * WORK:
                root, a, b = joined(len(fp), np.concatenate(a), np.concatenate(b), root), [], []
    if a:
        root = joined(len(fp), np.concatenate(a), np.concatenate(b), root)
    some = links > 0
    return fp[some], links[some], fp[root[some]]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Feed whole cells to ``link_block``; one that may go on in the next batch waits."""
    held: list[tuple[np.ndarray, ...]] = []

    def put(parts):
        fp, links, root = link_block(*map(np.concatenate, zip(*parts)))
        return pa.RecordBatch.from_arrays([pa.array(fp), pa.array(links), pa.array(root)], ["fp", "links", "root"])

    for b in batches:
        if not b.num_rows:
            continue
        rows = tuple(b.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "apart", "fp", "n"))
        done = np.flatnonzero(rows[0] != rows[0][-1])
        cut = int(done[-1]) + 1 if len(done) else 0
        if held and not cut and held[-1][0][-1] != rows[0][0]:
            yield put(held)
            held = []
        if cut:
            yield put([*held, tuple(x[:cut] for x in rows)])
            held = []
        held.append(tuple(x[cut:] for x in rows))
    if held:
        yield put(held)


def hub_join(rows: DataFrame, known: DataFrame, key: str, many: str, hub: int = HUB) -> DataFrame:
    """``rows`` with what the saved ``known`` has of each key, in one row.  Of keys with more than ``hub`` rows (column ``many``), at most rows / hub, that is broadcast."""
    hubs = known.where(F.col(many) > hub)
    if hubs.isEmpty():
        return rows.join(known, key)
    calm = rows.join(F.broadcast(hubs.select(key)), key, "left_anti").join(known.where(F.col(many) <= hub), key)
    return rows.join(F.broadcast(hubs), key).unionByName(calm)


def components(edges: DataFrame, shared: Shared, hub: int = HUB) -> DataFrame:
    """(a, b): each node of ``edges`` (a, b) but the smallest of its component, with that smallest."""
    edges = shared.save(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return edges
        state = now
        both, held = edges.union(edges.select("b", "a")), [edges]

        def save(df: DataFrame) -> DataFrame:
            """Written where a key may be a hub, which is then looked up."""
            if 2 * now[0] > hub:
                held.append(df := shared.save(df))
            return df

        def joined_by_a(rows: DataFrame, known: DataFrame) -> DataFrame:
            return hub_join(rows, known, "a", "d", hub) if 2 * now[0] > hub else rows.join(known, "a")

        low = save(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("d")).select("a", F.least("a", "m").alias("m"), "d"))
        large = save(joined_by_a(both.where("b > a"), low).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = save(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("d")))
        edges = shared.save(joined_by_a(large, least).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m")).distinct())
        for x in held:
            shared.drop(x)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", cell: int = CELL, hot: int = HOT, hub: int = HUB) -> DataFrame:
    """One row per row of ``df``: the id, ``fingerprint`` (16 hex digits), ``n_near`` and ``component_id``."""
    ship(df.sparkSession)
    shared = Shared(df.sparkSession)
    docs = shared.save(with_fingerprint(df.select(df[id_col].alias("id"), df[text_col].alias("text")), "text", ["id"]))
    found = shared.save(linked(docs, shared, cell, hot, hub))
    return hub_join(docs, found, "fp", "n", hub).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "n_near", "component_id")


def in_cells(classes: DataFrame, many: int, shared: Shared, cell: int = CELL, hot: int = HOT) -> DataFrame:
    """The ``many`` saved ``classes`` (fp, n) in every cell that they own or visit."""
    depth, done = 0, None
    more = max(0, many - 1).bit_length() - (cell - 1).bit_length()
    rows, own = classes.select("fp", "n", F.lit(0).cast("long").alias("cell"), F.lit(0).alias("apart")), classes.select("fp")
    while True:
        more = min(max(more, 0), BITS - 1 - depth)
        rows, depth = visits(rows, depth, more), depth + more
        own = own.select("fp", F.col("fp").bitwiseAND(_bits(leading(depth))).alias("cell"))
        full = shared.save(own.groupBy("cell").agg(F.count("*").alias("m")).where(F.col("m") > hot))  # at most classes / hot rows
        most = full.agg(F.max("m")).first()[0]
        if most is None or depth >= BITS - 1:
            return rows if done is None else done.unionByName(rows)
        calm = rows.join(full, "cell", "left_anti").select("fp", "n", "cell", "apart")
        done = calm if done is None else done.unionByName(calm)
        rows, own = rows.join(full, "cell", "left_semi"), own.join(full, "cell", "left_semi")
        more = max(6, (most - 1).bit_length() - (cell - 1).bit_length())


def linked(docs: DataFrame, shared: Shared, cell: int = CELL, hot: int = HOT, hub: int = HUB) -> DataFrame:
    """One row per ``fp`` of the saved ``docs`` (id, fp): ``fp``, ``n`` (rows), ``n_near`` and ``component_id``."""
    classes = shared.save(docs.groupBy("fp").agg(F.count("*").alias("n"), F.min("id").alias("least")))
    order = [F.col("cell"), F.col("apart") > 0, gray_rank(F.col("fp"))]
    many = classes.count()
    rows = in_cells(classes.select("fp", "n"), many, shared, cell, hot).repartition("cell").sortWithinPartitions(*order)
    found = shared.save(rows.select("cell", "apart", "fp", "n").mapInArrow(_cells, "fp bigint, links bigint, root bigint"))
    star = components(found.select(F.col("fp").alias("a"), F.col("root").alias("b")), shared, hub)
    links = found.groupBy("fp").agg(F.sum("links").alias("links"))
    about = classes.join(links, "fp", "left").join(star.withColumnRenamed("a", "fp"), "fp", "left")
    save = shared.save if many > hub else lambda df: df
    about = save(about.select("fp", "n", "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_near"), F.coalesce("b", "fp").alias("root")))
    smallest = save(about.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("d")))
    return (hub_join(about, smallest, "root", "d", hub) if many > hub else about.join(smallest, "root")).select("fp", "n", "n_near", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
