"""Operator 3, token counts: heap-and-linked-list byte-pair merging.

A text is cut into parts that no vocabulary piece can cross: before each run of spaces, and wherever
no piece has the two characters side by side.  Within a part
the adjacent pair of lowest rank is popped from a heap again and again and its
two symbols are joined in a doubly linked list.  The count is the number of
initial symbols less the merges, which are counted as they are made; token ids
are never put out.  A step's distinct parts are looked up in a bounded cache, since words
repeat, whatever mark or line end follows them; those not in it go through ``Forest``, which holds a heap (as a tree of
winners) and a linked list for each of thousands of parts in arrays and makes a merge in all of
them at once.  Parts of more than ``WIDEST`` symbols are merged one by one.

Null text counts as empty (0 bytes, 0 tokens).  A text of any length is handled
whole; merging takes n log n steps in the longest part.  Rows that repeat are
counted each.  Columns of the input stay, except that ``n_bytes``, ``n_tokens``
and ``over_limit`` are replaced if the input has them.  An empty table gives an
empty table.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.llm.common import extend, flat, steps, struct, table, text_of, tokenizer_file

MODEL = "piece_bpe_32k.model"
#: Distinct parts that a worker remembers before it starts afresh.
CACHE = 600_000
#: Symbols that a chunk of a forest has at most, and chunks in a forest.
WIDEST, TREES = 64, 1 << 14
#: Text bytes whose distinct parts are looked up at a time.
STEP = 4 << 20
#: Characters that are cut into parts at a time.
BLOCK = 1 << 17
#: No pair; above every rank.
NONE = np.int32(1 << 30)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def merges(chunk, ranks: dict) -> int:
    """How many merges byte-pair encoding makes in ``chunk`` (str or bytes)."""
    return len(chunk) - len(merged(chunk, ranks))


def merged(chunk, ranks: dict) -> list:
    """The symbols left after all merges, in order.

    The lowest rank goes first, the leftmost pair among equals.
    """
    n = len(chunk)
    symbols = [chunk[i : i + 1] for i in range(n)]
    heap = [r << 64 | i << 32 | 2 for i in range(n - 1) if (r := ranks.get(chunk[i : i + 2])) is not None]
    if not heap:
        return symbols
    heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n))
    get, low = ranks.get, 0xFFFFFFFF
    while heap:
        top = heappop(heap)
        i, size = top >> 32 & low, top & low
        left, j = symbols[i], after[i]
        if left is None or j >= n or len(left) + len(symbols[j]) != size:
            continue  # one of the two has been merged since
        symbols[i] = left = left + symbols[j]
        symbols[j] = None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := get(whole := left + symbols[k])) is not None:
                heappush(heap, r << 64 | i << 32 | len(whole))
        if (h := before[i]) >= 0 and (r := get(whole := symbols[h] + left)) is not None:
            heappush(heap, r << 64 | h << 32 | len(whole))
    return [s for s in symbols if s is not None]


def _fields(raw: bytes):
    """(number, value) of each field of a protocol-buffer message."""
    at, end = 0, len(raw)

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, raw[at : at + size]
            at += size


class Forest:
    """Chunks of at most ``width`` symbols (a power of two), each with a heap of its adjacent pairs and a linked list.

    A heap is a tree of winners: leaf i has the rank of the pair that begins at
    symbol i, and the place i, so that of equal ranks the leftmost goes first.
    """

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray, width: int, pair):
        self.width, self.pair, n = width, pair, len(symbols)
        self.symbols, self.merges, self.gone = symbols.ravel(), np.zeros(n, np.int64), np.zeros(n * width, bool)
        self.after = np.tile(np.arange(1, width + 1, dtype=np.int8), n)
        self.before = np.tile(np.arange(-1, width - 1, dtype=np.int8), n)
        self.sizes = sizes
        ranks = np.full((n, width), NONE, np.int32)
        inside = np.arange(1, width) < sizes[:, None]
        ranks[:, :-1][inside] = self.pair.rank(symbols[:, :-1][inside], symbols[:, 1:][inside])
        heap = np.full((n, 2 * width), NONE, np.int32)
        heap[:, width:] = np.where(ranks < NONE, ranks * width + np.arange(width, dtype=np.int32), NONE)
        at = width
        while at > 1:
            heap[:, at // 2 : at] = np.minimum(heap[:, at : 2 * at : 2], heap[:, at + 1 : 2 * at : 2])
            at //= 2
        self.heap = heap.ravel()

    def _set(self, row: np.ndarray, place: np.ndarray, rank: np.ndarray) -> None:
        """New leaves, and the winners above them."""
        heap, node, base = self.heap, place.astype(np.int64) + self.width, row * (2 * self.width)
        heap[base + node] = np.where(rank < NONE, rank * self.width + place, NONE)
        while node[0] > 1:
            node >>= 1
            heap[base + node] = np.minimum(heap[base + 2 * node], heap[base + 2 * node + 1])

    def run(self) -> np.ndarray:
        """How many merges each chunk takes."""
        width, live = self.width, np.arange(len(self.merges))
        while True:
            best = self.heap[live * (2 * width) + 1]
            live, best = live[best < NONE], best[best < NONE]
            if not len(live):
                return self.merges
            self.merges[live] += 1
            base, i = live * width, best % width
            j = self.after[base + i].astype(np.int64)
            whole = self.pair.whole(self.symbols[base + i], self.symbols[base + j])
            self.symbols[base + i], self.gone[base + j] = whole, True
            k = self.after[base + j].astype(np.int64)
            self.after[base + i] = k
            some = k < self.sizes[live]
            self.before[(base + k)[some]] = i[some]
            right = np.full(len(live), NONE, np.int32)
            right[some] = self.pair.rank(whole[some], self.symbols[(base + k)[some]])
            self._set(live, j, np.full(len(live), NONE, np.int32))
            self._set(live, i, right)
            h = self.before[base + i]
            some = h >= 0
            if some.any():
                self._set(live[some], h[some], self.pair.rank(self.symbols[(base + h)[some]], whole[some]))


    def left(self) -> np.ndarray:
        """The symbols left after ``run``, chunk by chunk in order."""
        inside = (np.arange(self.width) < self.sizes[:, None]).ravel()
        return self.symbols[inside & ~self.gone]


class Slots:
    """Places of different numbers from 0 on, by hash: those of one slot stand side by side."""

    def __init__(self, keys: np.ndarray):
        self.shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        slot = self._slot(keys)
        self.order = np.argsort(slot, kind="stable")
        slot = slot[self.order]
        self.keys = np.append(keys[self.order], -1)  # the last is none
        self.more = np.append(slot[1:] == slot[:-1], [False] * min(len(keys) + 1, 2))  # whether the next is of the same slot
        self.first = np.searchsorted(slot, np.arange(1 << (64 - int(self.shift)))).astype(np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * _ODD >> self.shift).astype(np.int64)

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        """Where ``wanted`` stand in ``order``, its length for those that don't."""
        at = self.first[self._slot(wanted)]
        todo = np.flatnonzero(self.keys[at] != wanted)
        while len(todo):
            on = self.more[at[todo]]
            at[todo[~on]] = len(self.order)
            todo = todo[on]
            at[todo] += 1
            todo = todo[self.keys[at[todo]] != wanted[todo]]
        return at


class Pairs:
    """Which neighbouring symbols merge: (left, right, rank, whole) by number of symbol."""

    def __init__(self, pairs: Iterable[tuple[int, int, int, int]], many: int):
        pairs = np.fromiter(chain.from_iterable(pairs), np.int32).reshape(-1, 4)
        self.many, self.slots = many, Slots(pairs[:, 0].astype(np.int64) * many + pairs[:, 1])
        self._rank, self._whole = (np.append(pairs[self.slots.order, k], none).astype(np.int32) for k, none in ((2, NONE), (3, 0)))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of two neighbouring symbols, NONE if they don't merge."""
        return self._rank[self.slots(left.astype(np.int64) * self.many + right)]

    def whole(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What two neighbouring symbols that merge become."""
        return self._whole[self.slots(left.astype(np.int64) * self.many + right)]


class PieceCounter:
    """Token counts by part of a text, see ``parts``."""

    def __init__(self, path: str, cache: int = CACHE):
        import sentencepiece

        self.most, self.new, self.old = cache // 2, {}, {}
        with open(path, "rb") as f:
            spec = dict(_fields(f.read()))
        trainer, norm = dict(_fields(spec[2])), dict(_fields(spec[3]))
        if trainer.get(3) != 2 or not trainer.get(35) or trainer.get(24):
            raise ValueError("expected a BPE model with byte fallback and leading word marks")
        if norm.get(2) or not norm.get(3, 1) or norm.get(4, 1):
            raise ValueError("expected a model that leaves the text as it is, but for a leading space")
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        order = {s: r for r, s in enumerate(sorted({-sp.get_score(i) for i in plain}))}
        self.ranks = {sp.id_to_piece(i).replace("▁", " "): order[-sp.get_score(i)] for i in plain}
        self.single = {p for p in self.ranks if len(p) == 1}
        if any(" " in p.lstrip(" ") for p in self.ranks) or any(c not in self.single for p in self.ranks for c in p):
            raise ValueError("expected pieces that don't span words, made of known characters")
        number = {p: i for i, p in enumerate(self.ranks)}
        self.of = np.full(sys.maxunicode + 1, -1, np.int32)  # number of a character's piece
        self.of[[ord(c) for c in self.single]] = [number[c] for c in self.single]
        self.many = len(number)
        self.pair = Pairs(((number[p[:k]], number[p[k:]], r, number[p]) for p, r in self.ranks.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number), self.many)
        inner = {(ord(a), ord(b)) for p in self.ranks for a, b in pairwise(p)}
        lefts, rights = (sorted({x[k] for x in inner}) for k in (0, 1))
        self.left, self.right = np.zeros(sys.maxunicode + 1, np.int32), np.zeros(sys.maxunicode + 1, np.int32)
        self.left[lefts], self.right[rights] = np.arange(1, len(lefts) + 1) * (len(rights) + 1), np.arange(1, len(rights) + 1)
        self.joined = np.zeros((len(lefts) + 1) * (len(rights) + 1), bool)  # by what is left and what is right, 0 for all that no piece has there
        self.joined[[self.left[a] + self.right[b] for a, b in inner]] = True

    def parts(self, codes: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Where parts begin, at ``begin`` among others: no piece has the two characters at a cut side by side, so merging stops there."""
        cut = np.empty(len(codes), bool)
        for at in range(0, len(codes), BLOCK):
            own = codes[max(at - 1, 0) : at + BLOCK]
            cut[max(at, 1) : at + BLOCK] = ~self.joined[self.left[own[:-1]] + self.right[own[1:]]]
        cut[begin] = True
        return np.flatnonzero(cut)

    def fresh(self, chunks: list[str]) -> np.ndarray:
        """Token counts of chunks that aren't remembered."""
        text = "".join(chunks)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        begin = np.cumsum([0, *map(len, chunks)])
        symbol = self.of[codes]
        part = self.parts(codes, begin[:-1])
        sizes = np.diff(np.append(part, len(codes)))
        tokens = np.where(symbol < 0, 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000), 1)
        tokens = np.add.reduceat(tokens, part)
        width = 2
        while width < WIDEST:
            width *= 2
            own = np.flatnonzero((sizes > (width // 2 if width > 4 else 1)) & (sizes <= width))
            for at in range(0, len(own), TREES):
                rows = own[at : at + TREES]
                places = np.minimum(part[rows, None] + np.arange(width), len(codes) - 1)
                tokens[rows] -= Forest(symbol[places], sizes[rows], width, self.pair).run()
        for i in np.flatnonzero(sizes > WIDEST):
            tokens[i] -= merges(text[part[i] : part[i] + sizes[i]], self.ranks)
        return np.add.reduceat(tokens, np.searchsorted(part, begin[:-1]))

    def known(self, parts: list[str]) -> np.ndarray:
        """Token counts of distinct parts."""
        new, old = self.new, self.old
        out = np.fromiter(map(new.get, parts, repeat(0)), np.int64, len(parts))
        miss = np.flatnonzero(out == 0)
        out[miss] = np.fromiter(map(old.get, [parts[i] for i in miss.tolist()], repeat(0)), np.int64, len(miss))
        miss = miss[out[miss] == 0]
        for at in range(0, len(miss), self.most):
            own = miss[at : at + self.most]
            names = [parts[i] for i in own.tolist()]
            out[own] = self.fresh(names)
            if len(self.new) + len(own) > self.most:
                self.old, self.new = self.new, {}
            self.new.update(zip(names, out[own].tolist()))
        return out

    def count(self, texts: pa.Array) -> np.ndarray:
        """Token counts of texts."""
        out = [np.zeros(0, np.int64)]
        for step in steps(texts, STEP):
            step = pc.replace_substring(step.cast(pa.large_string()), "▁", " ")
            some = pc.binary_length(step).to_numpy() > 0
            count = np.zeros(len(step), np.int64)
            if some.any():
                data, offsets = flat(pc.utf8_replace_slice(step.filter(pa.array(some)), 0, 0, " "))
                codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
                byte = None if len(codes) == len(data) else np.flatnonzero((data & 0xC0) != 0x80)  # where characters begin, unless each is a byte
                begin = offsets[:-1] if byte is None else np.searchsorted(byte, offsets[:-1])
                part = self.parts(codes, begin)
                ends = np.append(part if byte is None else byte[part], len(data))
                found = pa.LargeStringArray.from_buffers(len(part), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
                each = self.known(found.dictionary.to_numpy(zero_copy_only=False).tolist())[found.indices.to_numpy()]
                count[some] = np.add.reduceat(each, np.searchsorted(part, begin))
            out.append(count)
        return np.concatenate(out)


@lru_cache(maxsize=4)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(df: DataFrame, text_col: str = "text", model: str = MODEL, limit: int = 4096) -> DataFrame:
    """Append ``n_bytes``, ``n_tokens`` (long) and ``over_limit`` (more than ``limit`` tokens)."""

    def run(texts: pa.Array) -> pa.Array:
        c = counter(tokenizer_file(model))  # where this worker has it
        return struct(n_tokens=pa.array(c.count(texts)))

    out = extend(df.withColumn("n_bytes", F.octet_length(text_of(df, text_col)).cast("long")), run, "struct<n_tokens:bigint>", text_of(df, text_col))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
