"""Operators 1, 6 and 7: held-out accuracy, and what odd rows give."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vertexloom.llm import language, quality_model, toxicity
from vertexloom.llm.common import crc_mod

FR, EN = "le chat noir dort sur la chaise et la nuit", "the black cat sleeps on the chair at night"


@pytest.fixture(scope="module")
def docs(spark, tiny):
    return spark.read.parquet(f"{tiny}/documents.parquet")


@pytest.fixture(scope="module")
def medium():
    import os

    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    return path


def test_language_held_out(spark, medium):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "lang").collect()}
    got = language.op1_language_id(spark, medium).collect()
    assert len(got) == len(truth) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98


def test_language_is_the_nearest_centroid(spark, tiny, docs):
    """The query against cosines worked out text by text, gram by gram."""
    import pyarrow as pa

    model = language.train(docs, crc_mod(docs, "doc_id", 4) != 2)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in language.op1_language_id(spark, tiny).collect()}
    for i in sorted(texts)[::5]:
        letters = "".join(chr(c) if (c := b | 32 if 65 <= b <= 90 else b) >= 97 and c <= 122 or c >= 0x80 else " " for b in (texts[i] or "").encode())
        raw, grams = (" " + letters + " ").encode("latin-1"), {}
        for size, mix, add in ((2, 0x9E3779B1, 0), (3, 0x85EBCA77, 0x2545F491)):
            for k in range(len(raw) - size + 1):
                piece = raw[k : k + size]
                if not piece.strip(b" "):
                    continue
                h = (int.from_bytes(piece, "big") * mix + add) % 2**32 >> 32 - language.BITS
                grams[h] = grams.get(h, 0) + 1
        v = {h: n**0.5 * float(model.idf[h]) for h, n in grams.items()}
        norm = sum(x * x for x in v.values()) ** 0.5 or 1.0
        cosine = [sum(x * float(c[h]) for h, x in v.items()) / norm for c in model.centre]
        want = int(np.argmax(cosine))
        if any(ch.isalpha() for ch in texts[i] or ""):
            assert got[i].score == pytest.approx(cosine[want], abs=2e-3) and (got[i].lang_pred == model.langs[model.owner[want]] or sorted(cosine)[-2] > cosine[want] - 2e-3)
    assert isinstance(model.predict(pa.array(["x"])), pa.StructArray)


def test_many_languages_go_block_by_block(spark):
    import pyarrow as pa

    rng = np.random.default_rng(4)
    words = {f"l{k}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(12)] for k in range(30)}
    rows = [(i, " ".join(rng.choice(words[x], 30)), x) for i, x in enumerate(x for x in words for _ in range(8))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("old"))
    one, parts = language.train(df), language.train(df, block=9)
    assert isinstance(one, language.Centroids) and len(parts.parts) == 4
    got = language.identify(df, parts)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score", "rejected"]
    want = {r.doc_id: (r.lang_pred, round(r.score, 5), r.rejected) for r in language.identify(df, one).collect()}
    assert {r.doc_id: (r.lang_pred, round(r.score, 5), r.rejected) for r in got.collect()} == want
    assert np.mean([r.lang_pred == r.lang for r in got.collect()]) > 0.99
    assert language.identify(spark.createDataFrame([(1, None)], "doc_id long, text string"), parts).first()[2:] == ("und", 0.0, True)
    assert one.predict(pa.array([""])).to_pylist()[0]["lang_pred"] == "und"


def test_language_odd_rows(spark, docs):
    model = language.train(docs)
    rows = [(1, None), (2, ""), (3, " 12 !? €"), (4, "é"), (5, "漢字"), (6, "x" * 50_000), (7, EN), (7, EN)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("old")).withColumn("rejected", F.lit(1))
    got = language.identify(df, model)
    assert got.columns == ["doc_id", "text", "lang_pred", "score", "rejected"]
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert all(by[i][0].lang_pred == "und" and by[i][0].score == 0 and by[i][0].rejected for i in (1, 2, 3))
    assert all(by[i][0].lang_pred in model.langs for i in (4, 5, 6, 7)) and by[7][0] == by[7][1]
    assert by[5][0].rejected and by[6][0].rejected  # nothing of the kind was learned
    assert language.identify(df.limit(0), model).count() == 0


def test_language_of_mostly_null_texts(spark):
    import pyarrow as pa

    rows = [(i, f"the house and the garden {i}", "en") for i in range(40)] + [(100 + i, None, "fr") for i in range(3000)] + [(5000 + i, f"la maison est dans le jardin {i}", "fr") for i in range(20)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), bound=40)
    assert {model.langs[k] for k in model.owner} == {"en", "fr"}
    assert model.predict(pa.array(["la maison est dans le jardin"])).field("lang_pred").to_pylist() == ["fr"]


def test_language_without_lessons(spark):
    df = spark.createDataFrame([(1, EN, None), (2, None, "fr")], "doc_id long, text string, lang string")
    got = language.identify(df, language.train(df)).collect()
    assert {r.lang_pred for r in got} == {"und"}


def test_language_grams_stay_within_texts():
    import pyarrow as pa

    texts = [EN, "", "a", FR * 3, "é"]
    together = np.concatenate(list(language.blocks(pa.array(texts))))
    alone = np.concatenate([np.concatenate(list(language.blocks(pa.array([t])))) for t in texts])
    assert (together == alone).all()


@pytest.mark.parametrize("module,query,label", [(quality_model, "op6_quality_classifier", "quality"), (toxicity, "op7_toxicity", "toxic")])
def test_scores_held_out(spark, medium, module, query, label):
    got = getattr(module, query)(spark, medium)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == 1000
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{medium}/labels.parquet").collect()}
    rows = [r for r in got.collect() if r.held_out and r.doc_id in labels]
    good = np.array([r.score for r in rows if labels[r.doc_id] == 1])
    bad = np.array([r.score for r in rows if labels[r.doc_id] == 0])
    above = (good[:, None] > bad[None]).mean() + (good[:, None] == bad[None]).mean() / 2
    assert above > (0.98 if label == "quality" else 0.85)


@pytest.mark.parametrize("module,label", [(quality_model, "quality"), (toxicity, "toxic")])
def test_scores_of_odd_rows(spark, docs, tiny, module, label):
    labels = spark.read.parquet(f"{tiny}/labels.parquet")
    model = module.train(docs, labels.union(labels.limit(5)))
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "word " * 30_000), (5, EN), (5, EN)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("predicted", F.lit("old")).withColumn("n_words", F.lit(3))
    got = module.score(df, model)
    assert got.columns == ["doc_id", "text", "n_words", "score", "predicted"]
    by = {r.doc_id: r for r in got.collect()}
    assert all(0 <= r.score <= 1 for r in by.values()) and by[1].score == by[2].score and by[5].n_words == 3
    assert module.score(df.limit(0), model).count() == 0


@pytest.mark.parametrize("module,label", [(quality_model, "quality"), (toxicity, "toxic")])
def test_too_few_labels(spark, docs, module, label):
    for rows, want in (([], 0.5), ([(0, 1), (1, 1)], 0.75), ([(0, None), (None, 1)], 0.5)):
        model = module.train(docs, spark.createDataFrame(rows, f"doc_id long, {label} int"))
        assert module.score(docs.limit(3), model).first().score == pytest.approx(want)


def test_labels_of_the_other_fold_are_not_read(spark, docs, tiny):
    labels = spark.read.parquet(f"{tiny}/labels.parquet")
    turned = labels.withColumn("quality", F.when(crc_mod(labels, "doc_id", 3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, other = (quality_model.train(docs, t, crc_mod(t, "doc_id", 3) != 1) for t in (labels, turned))
    assert one == other


def test_rules_are_few_and_compile_to_columns(spark, docs, tiny):
    model = quality_model.train(docs, spark.read.parquet(f"{tiny}/labels.parquet"))
    assert 0 < len(model.rules) < 120
    plan = quality_model.score(docs, model)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1  # statistics once; the rules run in the JVM


def test_quality_query_applies_its_rules(spark, tiny, docs):
    """The query against its rules applied in Python to statistics counted in Python."""
    labels = spark.read.parquet(f"{tiny}/labels.parquet")
    model = quality_model.train(docs, labels, crc_mod(labels, "doc_id", 3) != 1)
    got = {r.doc_id: r for r in quality_model.op6_quality_classifier(spark, tiny).collect()}
    for r in docs.collect()[::4]:
        text = r.text or ""
        words, count = text.encode().split(), lambda chars: sum(text.count(c) for c in chars)  # noqa: B023
        lines = [x for x in text.encode().split(b"\n") if x.strip()]
        seen = {}
        for i in range(len(words) - 2):
            seen.setdefault(tuple(words[i : i + 3]), []).append(i)
        again = {i + k for places in seen.values() if len(places) > 1 for i in places for k in range(3)}
        n, lower, upper = max(len(words), 1), sum("a" <= c <= "z" for c in text), sum("A" <= c <= "Z" for c in text)
        plain = sum(33 <= ord(c) < 127 and not c.isalnum() for c in text) - count("#*$%&|<>!?.,;:")
        stats = {"log_words": np.log1p(len(words)), "word_length": sum(len(w.decode()) for w in words) / n, "symbols": count("#*$%&|<>") / n, "repeats": len(again) / n, "duplicate_lines": (len(lines) - len(set(lines))) / max(len(lines), 1), "words_a_line": len(words) / max(len(lines), 1), "distinct_words": len(set(words)) / n, "upper": upper / max(lower + upper, 1), "shouts": count("!?") / n, "stops": count(".,;:") / n, "punctuation": plain / n, "digits": sum("0" <= c <= "9" for c in text) / n, "controls": sum(ord(c) < 32 and not 9 <= ord(c) <= 13 or ord(c) == 127 for c in text) / n}
        logit = model.bias + sum(rule.weight for rule in model.rules if all((stats[f] > cut) == above for f, above, cut in rule.terms))
        assert got[r.doc_id].score == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-9)


def test_toxicity_query_sums_its_weights(spark, tiny, docs):
    """The query against weights summed word by word, and its training against a loop over dictionaries."""
    labels = spark.read.parquet(f"{tiny}/labels.parquet")
    model = toxicity.train(docs, labels, crc_mod(labels, "doc_id", 4) != 2)
    weight, got = dict(zip(model.at.tolist(), model.weight.tolist())), {r.doc_id: r for r in toxicity.op7_toxicity(spark, tiny).collect()}
    for r in docs.collect()[::4]:
        logit = model.bias + sum(weight.get(b, 0) for b in plain_buckets(r.text or "", model.bits))
        assert got[r.doc_id].score == pytest.approx(1 / (1 + np.exp(-max(min(logit, 30), -30))), abs=1e-5)


def plain_buckets(text, bits):
    top, words, word = 2**64, [], None
    for b in [*text.encode(), 32]:
        b = b | 32 if 65 <= b <= 90 else b
        if 97 <= b <= 122 or 48 <= b <= 57 or b >= 0x80:
            word = (0, 1) if word is None else word
            word = ((word[0] + b * word[1]) % top, word[1] * 0x100000001B3 % top)
        elif word is not None:
            words, word = [*words, word[0]], None

    def bucket(h):
        h = (h ^ h >> 29) * 0x9E3779B97F4A7C15 % top
        return (h ^ h >> 32) * 0x9E3779B97F4A7C15 % top >> 64 - bits

    pairs = [(a, b, 0xC2B2AE3D27D4EB4F) for a, b in zip(words, words[1:])] + [(a, b, 0x165667B19E3779F9) for a, b in zip(words, words[2:])]
    return {bucket(h) for h in words} | {bucket((a * key + (b ^ b >> 31)) % top) for a, b, key in pairs}


def test_ftrl_agrees_with_a_plain_loop():
    rng = np.random.default_rng(6)
    rows = [np.unique(rng.integers(0, 60, rng.integers(1, 15))) for _ in range(300)]
    y = np.array([int(3 in r or 7 in r and 9 not in r) for r in rows])
    got = toxicity.ftrl(rows, y, 8)
    l1, share = toxicity.L1 * (len(y) / toxicity.BOUND) ** 0.5, (y.sum() + 1) / (len(y) + 2)
    often = {b for b in range(60) if sum(b in r for r in rows) >= toxicity.LEAST}
    base = np.log(share / (1 - share))
    z, n, zb, nb = dict.fromkeys(often, 0.0), dict.fromkeys(often, 0.0), 0.0, 0.0
    w = lambda b: 0.0 if abs(z[b]) <= l1 else (np.sign(z[b]) * l1 - z[b]) / ((toxicity.BETA + n[b] ** 0.5) / toxicity.ALPHA + toxicity.L2)
    wb = lambda: base - zb / ((toxicity.BETA + nb**0.5) / toxicity.ALPHA)
    for _ in range(toxicity.ROUNDS):
        for r, t in zip(rows, y):
            own = [b for b in r.tolist() if b in often]
            now, bias = {b: w(b) for b in own}, wb()
            g = 1 / (1 + np.exp(-(sum(now.values()) + bias))) - t
            for b in own:
                z[b] += g - ((n[b] + g * g) ** 0.5 - n[b] ** 0.5) / toxicity.ALPHA * now[b]
                n[b] += g * g
            zb, nb = zb + g - ((nb + g * g) ** 0.5 - nb**0.5) / toxicity.ALPHA * (bias - base), nb + g * g
    assert dict(zip(got.at.tolist(), got.weight.round(4).tolist())) == pytest.approx({b: round(w(b), 4) for b in sorted(often) if w(b)}, abs=2e-4)
    assert got.bias == pytest.approx(wb())


def test_word_hashes():
    from vertexloom.llm.common import flat

    import pyarrow as pa

    texts = ["Idiot, idiot", "", "x", "the idiot", "idiot"]
    h, bounds = toxicity.word_hashes(*flat(pa.array(texts)))
    assert np.diff(bounds).tolist() == [2, 0, 1, 2, 1]
    assert h[0] == h[1] == h[4] == h[5] != h[2]
    pairs = toxicity.features(*flat(pa.array(texts)), 20)
    assert [len(p[0]) for p in pairs] == [6, 2, 0]
