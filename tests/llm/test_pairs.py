"""Operators 2 and 10 against brute force."""

from __future__ import annotations

import numpy as np
import pytest
import xxhash

from vertexloom.llm import simhash, topk


def plain_fingerprint(text) -> int:
    words = [w for w in (text or "").encode().lower().split()]
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def plain_links(ids, texts):
    f = np.array([plain_fingerprint(t) for t in texts], np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None]) <= 2
    known = [{i} for i in range(len(f))]
    group = list(range(len(f)))
    for i, j in zip(*np.nonzero(near)):
        a, b = group[i], group[j]
        if a != b:
            known[a] |= known[b]
            for k in known[b]:
                group[k] = a
    least = [min((ids[k] for k in known[g] if ids[k] is not None), default=None) for g in group]
    return sorted(((i, f"{x:016x}", int(n) - 1, c) for i, x, n, c in zip(ids, f, near.sum(1), least)), key=str)


def test_fingerprints_agree_with_spark_hash(spark):
    assert spark.sql("select xxhash64('a b c') h").first().h % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("cell, hot, hub", [(simhash.CELL, simhash.HOT, simhash.HUB), (8, 3, 5)])
def test_near_duplicates(spark, cell, hot, hub):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(50)]
    texts = [None, "", " \n", "one", "one two", "ONE two", "É é x", "x" * 3000 + " y"]
    for _ in range(25):
        base = rng.choice(words, rng.integers(3, 60)).tolist()
        for _ in range(rng.integers(1, 5)):
            near = list(base)
            near[rng.integers(len(near))] = rng.choice(words)
            texts += [" ".join(near)]
    texts += ["copy of a text that is found many times"] * 60
    ids = [None, *range(7, len(texts) + 5), 7]
    df = spark.createDataFrame([(i, t, "e") for i, t in zip(ids, texts)], "doc_id long, text string, fingerprint string").repartition(3)
    got = simhash.near_duplicates(df, cell=cell, hot=hot, hub=hub).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.n_near, r.component_id) for r in got), key=str) == plain_links(ids, texts)


def test_fingerprints_over_many_steps(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(9)
    texts = ["".join(rng.choice(list("aB é\t\n \x1c漢z"), rng.integers(0, 90))) for _ in range(400)] + ["w " * 5000, "long" * 20 + " b c", None, "", "A"]
    monkeypatch.setattr(simhash, "STEP", 700)
    monkeypatch.setattr(simhash, "VOTES", 64)
    assert simhash.fingerprints(pa.array(texts)).tolist() == [plain_fingerprint(t) for t in texts]


def test_no_documents(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").collect()
    got = simhash.op2_simhash(spark, tiny).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.n_near, r.component_id) for r in got), key=str) == plain_links([r.doc_id for r in docs], [r.text for r in docs])


def gray(fps):
    rank = fps.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return fps[np.argsort(rank)]


def test_index_finds_every_pair(monkeypatch):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 20, dtype=np.uint64)
    flip = lambda n: np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)
    fps = gray(np.unique(np.concatenate([base[rng.integers(0, 20, 800)] ^ flip(800) ^ flip(800), rng.integers(0, 2**63, 500, dtype=np.uint64)])))
    monkeypatch.setattr(simhash, "WORK", 300)
    for begins in (np.array([0]), np.array([0, 1, 2, 400, 401, 1000])):
        cell = np.searchsorted(begins, np.arange(len(fps)), side="right")
        want = (np.bitwise_count(fps[:, None] ^ fps[None]) <= 2) & (cell[:, None] == cell[None])
        got = np.zeros_like(want)
        index = simhash.GrayIndex(fps, begins)
        for i, j in index.near(fps, index.cell, np.arange(len(fps))):
            assert not got[i, j].any() and (i < j).all()
            got[i, j] = True
        assert (got == np.triu(want, 1)).all()


def test_upper_nodes_prune_whole_groups():
    rng = np.random.default_rng(1)
    fps = gray(rng.integers(0, 2**64, 40_000, dtype=np.uint64))
    index = simhash.GrayIndex(fps, np.array([0]))
    assert index.depth >= 3
    for _ in index.near(fps, index.cell):
        pass
    assert index.compared[0] < 0.06 * len(fps) ** 2  # leaves looked at, of all
    share = [many / -(-len(fps) // simhash.FAN**k) / len(fps) for k, many in enumerate(index.compared)]
    assert share == sorted(share)  # of nodes looked at grows upwards: groups go as a whole


def test_visits_meet_each_pair_once(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    pick = lambda: np.uint64(1) << rng.integers(0, 64, 600, dtype=np.uint64)
    fps = np.unique(np.concatenate([base[rng.integers(0, 12, 600)] ^ pick() ^ pick(), np.arange(40, dtype=np.uint64)]))
    df = spark.createDataFrame([(int(x), 1) for x in fps.view(np.int64)], "fp long, n long")
    shared = simhash.Shared(spark)
    for cell, hot in ((64, 40), (1 << 20, 1 << 20)):
        rows = simhash.in_cells(df, len(fps), shared, cell, hot).collect()
        owner, met = {r.fp: r.cell for r in rows if r.apart == 0}, {}
        assert len(owner) == len(fps) == sum(r.apart == 0 for r in rows)
        for r in rows:
            met.setdefault(r.fp, []).append(r.cell)
        for k, x in enumerate(fps):
            for y in fps[k + 1 :][np.bitwise_count(fps[k + 1 :] ^ x) <= 2]:
                a, b = int(x.view(np.int64)), int(y.view(np.int64))
                assert (met[a].count(owner[b]) + met[b].count(owner[a]) if owner[a] != owner[b] else 1) == 1


def test_one_component_of_many_classes(spark):
    n = 100_000
    star = spark.range(1, n).selectExpr("id AS a", "CAST(IF(id % 2 = 0, 0, id - 1) AS BIGINT) AS b")
    got = simhash.components(star, simhash.Shared(spark), hub=1000)
    assert got.where("b = 0").count() == got.count() == n - 1


def plain_top(rows, asked, k=5):
    def usable(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)

    ints = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and usable(v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in ints if asked(i)}:
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ints if i != q and len(w) == len(v))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block", [topk.BLOCK, 300])
def test_top_k(spark, block):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=12).round(2) / (1 + i % 3)).tolist()) for i in range(300)]
    rows += [(300, rows[0][1]), (301, rows[0][1]), (302, None), (303, [float("nan")] * 12), (304, [None] * 12), (305, []), (350, [1.0, 2.0]), (351, [3.0, -1.0]), (400, [7.5])]
    rows += [(7, rows[7][1]), (None, rows[1][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = topk.top_k(df, df.where("vec_id % 50 = 0"), block=block).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == plain_top(rows, lambda i: i % 50 == 0)


def test_top_k_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(none, none).count() == 0


@pytest.mark.parametrize("big", [3e7, 4e7, 1e30, 1e200, 1.7e308])
def test_top_k_of_large_components(spark, big):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(-9, 9, 6) * (big / 10 if i % 3 else 1.0)).tolist()) for i in range(120)] + [(200, [big] * 6), (201, [big, -big, big, -big, 1.0, 0.0]), (50, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    ints = [(i, [int(np.floor(256 * x)) if abs(x) < 1e300 else int(x) * 256 for x in v]) for i, v in rows]
    want, low, high = [], -(2**63), 2**63 - 1
    for q, v in ints:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ints if i != q)[:5]
            want += [(q, n + 1, i, max(low, min(high, -s))) for n, (s, i) in enumerate(best)]
    got = topk.top_k(df, df.where("vec_id % 50 = 0")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x, y = (topk.Vectors(np.arange(n), rng.normal(size=(n, 30)), 256.0) for n in (40, 50))
    exact = x.x @ y.x.T / np.outer(x.norm, y.norm)
    for mine, theirs in zip(x.stats, y.stats):
        assert (mine @ theirs.T + topk.slack(mine.shape[1]) >= exact).all()
    assert sorted(np.concatenate(topk.tiles(y.stats[0], 8)).tolist()) == list(range(50))


def test_few_pairs_reach_the_exact_step(spark, tiny):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(20, 32)) * 3
    rows = [(i, (centre[rng.integers(20)] + rng.normal(size=32) * 0.3).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    left = {r.step: r.pairs for r in topk.survivors(df, df.where("vec_id % 50 = 0")).collect()}
    assert left["all"] == 60 * 3000 >= left["tiles"] and left["24"] < 0.1 * left["all"]
    assert left["1"] >= left["4"] >= left["16"] >= left["24"]
