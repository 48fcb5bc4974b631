"""Operators 3 and 4 against the libraries whose results they give."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vertexloom.llm import byte_bpe, token_count
from vertexloom.llm.common import public_path

public_tokenizers = pytest.importorskip("public_tokenizers")
ODD = ["", " ", "  ", "\n", "a ", " a", "a  b", "it's", "'s's", " 's", "\n's", "we'll've", "x" * 5000, "ab" * 2000 + "\n" * 50, "é漢🙂", "▁", "a▁b", "<s>", "<0x0A>", "\x00", "　a", "١٢٣ ²½", "ǅ'm", "\r\n \t"]


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_path(token_count.MODEL))


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(public_path(byte_bpe.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def fuzz(n: int = 2000) -> list[str]:
    rng = random.Random(5)
    letters = " \n\t'stmdrevlabZ19!?.,é漢🙂　\xa0▁\x00ßİ²½"
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_counts(pieces):
    counter = token_count.PieceCounter(public_path(token_count.MODEL), cache=500)
    texts = fuzz()
    want = [len(x) for x in pieces.encode(texts, num_threads=1)]
    assert counter.count(pa.array(texts)).tolist() == want == counter.count(pa.array(texts)).tolist()
    assert len(counter.new) <= 250 and len(counter.old) <= 250
    assert counter.count(pa.array([None, "a b"]).fill_null("")).tolist() == [0, 2]


def test_forest_counts_as_the_heap_does():
    counter, rng = token_count.PieceCounter(public_path(token_count.MODEL)), random.Random(2)
    chunks = [" " + "".join(rng.choice("thequickéñ.,AB1") for _ in range(rng.randint(0, 90))) for _ in range(3000)]
    assert counter.fresh(chunks).tolist() == [len(token_count.merged(c, counter.ranks)) for c in chunks]


def test_a_word_is_merged_once_whatever_follows_it(pieces, monkeypatch):
    counter, rng, merged = token_count.PieceCounter(public_path(token_count.MODEL)), random.Random(3), []
    fresh = counter.fresh
    monkeypatch.setattr(counter, "fresh", lambda parts: merged.extend(parts) or fresh(parts))
    words = ["".join(rng.choice("etaoinshr") for _ in range(8)) for _ in range(300)]
    texts = ["", *["".join(f" {w}{end}{w}" for w in words) for end in ("\n", ",\n", "\t", "漢", "\x00", "  ")], "▁", "🙂 " * 3]
    assert counter.count(pa.array(texts)).tolist() == [len(x) for x in pieces.encode(texts, num_threads=1)]
    assert len(set(merged)) == len(merged) < 4 * len(words)  # words with one space, two or none, and marks; not words by mark
    assert (counter.count(pa.array(texts)) > 0).sum() == len(texts) - 1 and len(set(merged)) == len(merged)  # none again


def test_parts_do_not_depend_on_blocks(monkeypatch):
    counter, text = token_count.PieceCounter(public_path(token_count.MODEL)), " " + " ".join(fuzz(200))
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    inner = {p[k : k + 2] for p in counter.ranks for k in range(len(p) - 1)}
    want = [i for i in range(len(text)) if not i or text[i - 1 : i + 1] not in inner]
    for block in (1, 2, 7, 1 << 17):
        monkeypatch.setattr(token_count, "BLOCK", block)
        assert counter.parts(codes, np.array([0])).tolist() == want


def test_slots_find_what_they_hold():
    rng = np.random.default_rng(4)
    for many, high in ((0, 9), (1, 9), (5, 9), (3000, 6000), (3000, 1 << 50)):
        keys = rng.permutation(np.unique(rng.integers(0, high, many)))
        slots = token_count.Slots(keys)
        place = {k: i for i, k in enumerate(keys[slots.order].tolist())}
        wanted = np.concatenate([keys, rng.integers(0, high, 5000)])
        assert slots(wanted).tolist() == [place.get(k, len(keys)) for k in wanted.tolist()]


def test_encode_and_round_trip(reference):
    e = byte_bpe.ByteBpe(public_path(byte_bpe.RANKS), cache=500)
    texts = fuzz()
    flat, ends, begins, cut = e.encode(pa.array(texts))
    ids = [flat[a:b] for a, b in zip(ends, ends[1:])]
    at = [begins[a:b] for a, b in zip(cut, cut[1:])]
    assert len(e.new) <= 250 and len(e.old) <= 250
    assert [i.tolist() for i in ids] == [reference.encode_ordinary(t) for t in texts]
    assert [e.decode(i).tobytes().decode() for i in ids] == texts
    assert all((np.diff(a) > 0).all() and (not len(a) or a[0] == 0) for a in at)
    rng = random.Random(1)
    for t, i, a in zip(texts, ids, at):
        raw = t.encode()
        low = rng.randint(0, len(raw))
        high = rng.randint(low, len(raw))
        assert e.window(i, a, low, high) == raw[low:high] and len(e.heads(i, a)) == len(a)
    with pytest.raises(ValueError):
        e.heads(ids[texts.index("we'll've")], at[texts.index("a  b")] + 1)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab 's\n1!é", max_size=12), max_size=5))
def test_scan_width_does_not_matter(texts):
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(int)
    first = np.zeros(len(codes), bool)
    first[[b for b, e in zip(bounds, bounds[1:]) if b < e]] = True
    wide = byte_bpe.starts(codes, first, 512)
    assert all((byte_bpe.starts(codes, first, w) == wide).all() for w in (1, 2, 3, 7))


def test_forest_merges_like_the_heap():
    e = byte_bpe.encoder(public_path(byte_bpe.RANKS))
    rng = random.Random(8)
    pieces = [" " + "".join(rng.choice("thequickéñ.,AB1漢") for _ in range(rng.randint(0, 70))) for _ in range(2000)]
    for p, ids in zip(pieces, e.fresh(pieces)):
        raw = p.encode()
        assert np.frombuffer(ids, np.int32).tolist() == ([e.ranks[raw]] if raw in e.ranks else [e.ranks[x] for x in token_count.merged(raw, e.ranks)])


def test_classes_follow_the_library():
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for kind, name in ((byte_bpe.LETTER, r"\p{L}"), (byte_bpe.NUMBER, r"\p{N}"), (byte_bpe.BLANK, r"\s")):
        e = tiktoken.Encoding("x", pat_str=name, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        theirs = set(map(ord, bytes(e.encode_ordinary(every)).decode()))
        assert set(np.flatnonzero(byte_bpe._kinds() == kind).tolist()) - set(range(0xD800, 0xE000)) == theirs


def test_frames(spark, pieces, reference):
    rows = [(1, "Hello world", "x", 0), (2, None, "x", 1), (3, "", None, 2), (3, "", None, 2), (None, "it's  fine " * 900, "y", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, extra int")
    got = token_count.count_tokens(df, limit=5).collect()
    assert [c for c in token_count.count_tokens(df).columns] == ["doc_id", "text", "extra", "n_bytes", "n_tokens", "over_limit"]
    for r in got:
        want = len(pieces.encode(r.text or ""))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (want, len((r.text or "").encode()), want > 5)
    coded = byte_bpe.decode(byte_bpe.encode(df, offsets=True), starts_col="piece_starts")
    for r in coded.collect():
        assert r.ids == reference.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
        assert len(r.piece_starts) <= len(r.ids)
    empty = spark.createDataFrame([], df.schema)
    assert token_count.count_tokens(empty).count() == 0 and byte_bpe.decode(byte_bpe.encode(empty)).count() == 0
    null_ids = spark.createDataFrame([(None,), ([],), ([0, 1],)], "ids array<int>")
    assert sorted(len(r.decoded) for r in byte_bpe.decode(null_ids).collect())[:2] == [0, 0]


def test_queries(spark, tiny, reference):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in byte_bpe.op4_byte_bpe(spark, tiny).collect():
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(texts[r.doc_id].encode()))


def test_token_count_query(spark, tiny, pieces):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    got = token_count.op3_token_counts(spark, tiny).collect()
    assert len(got) == len(texts)
    for r in got:
        want = len(pieces.encode(texts[r.doc_id] or ""))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[r.doc_id] or "").encode()), want, want > 4096)
