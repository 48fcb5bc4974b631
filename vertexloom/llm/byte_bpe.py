"""Operator 4, byte-level BPE encoding and decoding.

Pre-tokenisation uses no regex.  Every code point of a block of texts gets a
class from an array (letter, number, space, apostrophe that starts a
contraction, ...), which already holds what the pattern looks ahead for.  A
class acts on the eight states of a small automaton as a transition function.
Functions compose associatively, so boundaries come from a two-level scan:
blocks are reduced to one composed function each, states are carried from block
to block, and all blocks are replayed side by side.  The distinct slices between
boundaries are merged pair by pair, through a bounded cache of known slices.
Where each slice begins, in bytes, is kept beside the ids.  Decoding lays slices out at
these offsets, and fails if ids and offsets don't belong together; a window of bytes is decoded
from the slices that reach into it alone.

Null text counts as empty: no ids, and empty bytes when decoded.  Texts of any
length are encoded whole.  Repeated rows are encoded each; an empty table gives
an empty table.  Input columns named as a result column are replaced.
"""

from __future__ import annotations

import base64
import sys
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.llm.common import extend, flat, steps, struct, table, text_of, tokenizer_file
from vertexloom.llm.token_count import TREES, WIDEST, Forest, Pairs, merged

RANKS = "byte_bpe_50k.tiktoken"
CACHE = 300_000
#: Texts are worked on in steps of about so many bytes, and ids of so many.
STEP, IDS = 1 << 19, 1 << 17

LETTER, NUMBER, OTHER, SHORT, LONG, BLANK, JOIN, ALONE = range(8)
IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_JOIN, IN_BLANK, FRESH, ONE_MORE, TWO_MORE = range(8)
FIRST, KEEP = 8, 16  # added to a class at the start of a text; the class of padding
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

#: Letters and numbers that Unicode 16 added, which Python 3.13 doesn't know.
_LETTERS_16 = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
_NUMBERS_16 = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """LETTER, NUMBER, OTHER or BLANK for each code point."""
    first = np.array([unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)])
    kinds = np.full(len(first), OTHER, np.uint8)
    kinds[first == "L"], kinds[first == "N"] = LETTER, NUMBER
    for kind, ranges in ((LETTER, _LETTERS_16), (NUMBER, _NUMBERS_16)):
        for a, b in ranges:
            kinds[a : b + 1] = kind
    kinds[_WHITE] = BLANK
    return kinds


@lru_cache(maxsize=1)
def _automaton():
    """State after a class, whether a token starts there, the composition table of all functions that arise, and each class's function."""
    move, start = np.zeros((17, 8), np.uint8), np.zeros((17, 8), bool)
    home = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHER, SHORT: ONE_MORE, LONG: TWO_MORE, BLANK: IN_BLANK, JOIN: AFTER_JOIN, ALONE: FRESH}
    run = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHER, SHORT: IN_OTHER, LONG: IN_OTHER, BLANK: IN_BLANK}
    for c in range(8):
        for q in range(8):
            if c in run and (q == run[c] or (q == AFTER_JOIN and c != BLANK)):
                move[c, q] = run[c]
            elif q in (ONE_MORE, TWO_MORE) and c == LETTER:
                move[c, q] = FRESH if q == ONE_MORE else ONE_MORE
            else:
                move[c, q], start[c, q] = home[c], True
        move[c + FIRST], start[c + FIRST] = home[c], True
    move[KEEP] = range(8)
    functions = {tuple(m): i for i, m in reversed(list(enumerate(move)))}
    functions = {m: i for i, m in enumerate(functions)}
    grown = list(functions)
    for f in grown:
        for g in [tuple(m) for m in move]:
            h = tuple(g[q] for q in f)
            if h not in functions:
                functions[h] = len(functions)
                grown.append(h)
    compose = np.array([[functions[tuple(g[q] for q in f)] for g in grown] for f in grown], np.uint16)
    return move, start, compose, np.array(grown, np.uint8), np.array([functions[tuple(m)] for m in move], np.uint16)


def classes(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The class of each code point, given where texts begin."""
    n = len(codes)
    kinds = _kinds()[codes]
    ends = np.append(first[1:], True)  # a text ends after this code point
    blank = kinds == BLANK
    followed = np.append(~blank[1:], False) & ~ends  # by something that isn't white space
    out = kinds
    out[blank & followed & (codes == 32)] = JOIN
    out[blank & followed & (codes != 32)] = ALONE
    for i in np.flatnonzero(codes == 39):
        if ends[i]:
            continue
        a = chr(codes[i + 1])
        if a in "stmd":
            out[i] = SHORT
        elif a in "rvl" and i + 2 < n and not ends[i + 1] and a + chr(codes[i + 2]) in ("re", "ve", "ll"):
            out[i] = LONG
    out[first] += FIRST
    return out


def starts(codes: np.ndarray, first: np.ndarray, width: int = 512) -> np.ndarray:
    """Where tokens begin: an associative scan over transition functions."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    move, start, compose, functions, of = _automaton()
    cls = np.full(-(-n // width) * width, KEEP, np.uint8)
    cls[:n] = classes(codes, first)
    cls = np.ascontiguousarray(cls.reshape(-1, width).T)
    fun, many = of[cls], len(functions)
    flat_compose = compose.ravel()
    whole = fun[0]
    for row in fun[1:]:  # each block becomes one function
        whole = flat_compose[whole.astype(np.int32) * many + row]
    state, entry = FRESH, np.empty(cls.shape[1], np.uint8)
    for b, f in enumerate(whole.tolist()):
        entry[b] = state
        state = int(functions[f, state])
    begins = np.empty(cls.shape, bool)
    flat_move, flat_start = move.ravel(), start.ravel()
    state = entry
    for row, out in zip(cls, begins):  # all blocks are replayed at once
        at = row.astype(np.int16) * 8 + state
        out[:] = flat_start[at]
        state = flat_move[at]
    return np.flatnonzero(begins.T.ravel()[:n])


class ByteBpe:
    """Ids by slice of text, packed as 32-bit numbers, so few objects are kept; a step looks up each distinct slice once."""

    def __init__(self, path: str, cache: int = CACHE):
        self.most, self.new, self.old = cache // 2, {}, {}
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.array([len(t) for t in tokens], np.int32)
        self.place = np.cumsum(self.size, dtype=np.int32) - self.size

        number = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.symbol, self.pair = number, Pairs(((self.ranks[t[:k]], self.ranks[t[k:]], r, r) for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks), len(tokens))

    def fresh(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of slices that aren't remembered: a vocabulary entry as it is, others merged pair by pair, thousands at once."""
        raw = [p.encode() for p in pieces]
        out = [self.ranks.get(r) for r in raw]
        size = np.array([len(r) if whole is None else 0 for r, whole in zip(raw, out)])
        out = [b"" if whole is None else np.int32(whole).tobytes() for whole in out]
        width = 1
        while width < WIDEST:
            width *= 2
            rows = np.flatnonzero((size > width // 2) & (size <= width))
            for at in range(0, len(rows), TREES):
                own = rows[at : at + TREES]
                text = np.frombuffer(b"".join(raw[i].ljust(width, b"\0") for i in own), np.uint8).reshape(-1, width)
                forest = Forest(self.symbol[text], size[own], width, self.pair)
                many = size[own] - forest.run()
                ids, ends = forest.left().astype(np.int32).tobytes(), (np.cumsum(many) * 4).tolist()
                for i, a, b in zip(own.tolist(), [0, *ends], ends):
                    out[i] = ids[a:b]
        for i in np.flatnonzero(size > WIDEST):
            out[i] = np.array([self.ranks[x] for x in merged(raw[i], self.ranks)], np.int32).tobytes()
        return out

    def known(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of distinct slices; two generations of ``most`` slices are remembered."""
        new, old = self.new, self.old
        out = [new.get(p) or old.get(p) for p in pieces]
        miss = [i for i, ids in enumerate(out) if ids is None]
        for at in range(0, len(miss), self.most):
            own = miss[at : at + self.most]
            names = [pieces[i] for i in own]
            for i, ids in zip(own, got := self.fresh(names)):
                out[i] = ids
            if len(self.new) + len(own) > self.most:
                self.old, self.new = self.new, {}
            self.new.update(zip(names, got))
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts and where each text's end; the byte of its text at which each slice begins, and where each text's slices end."""
        data, offsets = flat(texts)
        codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        byte = np.flatnonzero((data & 0xC0) != 0x80)  # where code points begin
        first = np.zeros(len(codes), bool)
        first[np.searchsorted(byte, offsets[:-1][offsets[:-1] < offsets[1:]])] = True
        begins = byte[starts(codes, first)]
        slices = pa.StringArray.from_buffers(len(begins), pa.py_buffer(np.append(begins, len(data)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        packed, kind = self.known(slices.dictionary.to_pylist()), slices.indices.to_numpy()
        ids, many = np.frombuffer(b"".join(packed), np.int32), np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        size, ends = many[kind], np.cumsum(many[kind])
        ids = ids[np.repeat((np.cumsum(many) - many)[kind] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        cut = np.searchsorted(begins, offsets)
        return ids, np.append(0, ends)[cut], (begins - np.repeat(offsets[:-1], np.diff(cut))).astype(np.int32), cut

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that ids stand for, one token after the other."""
        size = self.size[ids]
        return self.bytes[np.repeat(self.place[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())]

    def heads(self, ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The first id of each slice, given the byte at which it begins; ValueError where no token begins there."""
        before = np.cumsum(self.size[ids]) - self.size[ids]
        at = np.searchsorted(before, begins)
        if len(begins) and (at[-1] >= len(ids) or (before[at] != begins).any() or begins[0]) or (len(ids) and not len(begins)):
            raise ValueError("these offsets aren't those of these ids")
        return at

    def window(self, ids: np.ndarray, begins: np.ndarray, low: int, high: int) -> bytes:
        """Bytes ``low`` to ``high`` of a text, from the slices that reach into them."""
        heads = np.append(self.heads(ids, begins), len(ids))
        a, b = max(int(np.searchsorted(begins, low, side="right")) - 1, 0), int(np.searchsorted(begins, high))
        if b <= a:
            return b""
        return self.decode(ids[heads[a] : heads[b]]).tobytes()[low - int(begins[a]) : high - int(begins[a])]


@lru_cache(maxsize=4)
def encoder(path: str) -> ByteBpe:
    return ByteBpe(path)


def _lists(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.ListArray:
    """One array of lists from values and bounds of several."""
    values = np.concatenate([np.zeros(0, np.int32), *[v for v, _ in parts]])
    sizes = np.concatenate([np.zeros(0, np.int64), *[np.diff(b) for _, b in parts]])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values))


def lists(of: list, kind: pa.DataType) -> pa.Array:
    flat = np.fromiter(chain.from_iterable(of), kind.to_pandas_dtype(), sum(map(len, of)))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in of])]), pa.int32()), pa.array(flat, kind))


def encode(df: DataFrame, text_col: str = "text", ranks: str = RANKS, offsets: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Append ``ids`` (array<int>) and, on request, ``piece_starts`` (array<int>), the byte at which each pre-token begins."""

    def run(texts: pa.Array) -> pa.Array:
        e, parts = encoder(tokenizer_file(ranks)), []
        for part in steps(texts, STEP):
            parts.append(e.encode(part))
        lists = [_lists([p[i : i + 2] for p in parts]) for i in ((0, 2) if offsets else (0,))]
        return struct(**dict(zip(("ids", "piece_starts"), lists)))

    return extend(df, run, "struct<ids:array<int>" + ",piece_starts:array<int>" * offsets + ">", text_of(df, text_col), keep)


def decode(df: DataFrame, ids_col: str = "ids", starts_col: str | None = None, ranks: str = RANKS, keep: list[str] | None = None) -> DataFrame:
    """Append ``decoded`` (binary), the bytes that the ids stand for; null ids give empty bytes.

    With ``starts_col`` (as ``piece_starts`` of ``encode``) each slice must begin at its offset.
    """

    def run(rows: pa.Array) -> pa.Array:
        e, ids = encoder(tokenizer_file(ranks)), rows.field("ids")
        every = ids.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
        out, bounds, done = [], np.zeros(len(ids) + 1, np.int32), 0
        head = np.zeros(sum(int(e.size[every[at : at + IDS]].sum()) for at in range(0, len(every), IDS)) + 1, bool)  # where tokens begin
        for at in range(0, len(every), IDS):
            part = every[at : at + IDS]
            out.append(e.decode(part).tobytes())
            inside, after = np.flatnonzero((ends > at) & (ends <= at + len(part))), done + np.cumsum(e.size[part])
            head[after[:-1]] = head[done] = True
            bounds[1 + inside] = after[ends[inside] - at - 1]
            done += len(out[-1])
        bounds = np.maximum.accumulate(bounds)  # texts without ids end where the one before does
        if starts_col:
            starts, each = rows.field("starts"), rows.field("starts").value_lengths().to_numpy(zero_copy_only=False)
            begins = starts.flatten().to_numpy(zero_copy_only=False) + np.repeat(bounds[:-1], each)
            some = np.diff(bounds) > 0
            if not head[begins].all() or (some != (each > 0)).any() or (begins[(np.cumsum(each) - each)[some]] != bounds[:-1][some]).any():
                raise ValueError("these offsets aren't those of these ids")
        return struct(decoded=pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(bounds), pa.py_buffer(b"".join(out))]))

    some = lambda c: F.coalesce(df[c], F.array().cast("array<int>"))
    return extend(df, run, "struct<decoded:binary>", F.struct(some(ids_col).alias("ids"), *([some(starts_col).alias("starts")] if starts_col else [])), keep)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(table(spark, sf_dir, "documents"), offsets=True, keep=["doc_id"])
    coded = coded.select("doc_id", "ids", "piece_starts", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"))
    return decode(coded, starts_col="piece_starts", keep=["doc_id", "n_tokens", "ids_sha256"]).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
