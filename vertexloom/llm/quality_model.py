"""Operator 6, quality classifier: a sparse rule ensemble.

Boosted shallow trees are grown on statistics of texts.  Every path from the
root to a node is a conjunctive rule; a logistic model with an L1 penalty is
fitted over all rules, most of which get weight 0.  The rest is compiled into
one Spark column over the statistics, so scoring runs in the JVM once the
statistics are there.

Training takes a sample of about ``BOUND`` labelled rows (a parameter).  Labels,
lang, source and doc_id are no features.

Cases: null and empty texts have all-zero statistics and get a score like any
other; texts are read whole, however long.  Without labels, or with one class only, the score is the smoothed share of
label 1.  Repeated rows are scored each; an empty table gives an empty table.  In the query a
null doc_id is in neither fold (``held_out`` is null).
Input columns named as a result column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.llm.common import crc_mod, table
from vertexloom.llm.labelled import sample
from vertexloom.llm.text_stats import with_stats

#: Labelled rows that training looks at, about.
BOUND = 6000
TREES, DEPTH, CUTS, SHRINK = 40, 3, 16, 0.3
#: Weight of the L1 penalty, and steps of its solver.
PENALTY, STEPS = 2e-3, 400

_ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))


def features() -> dict[str, Column]:
    """Statistics by name, as columns over ``text_stats`` measurements."""
    letters = F.greatest(F.col("n_lower") + F.col("n_upper"), F.lit(1))
    return {
        "log_words": F.log1p(F.col("n_words")),
        "word_length": _ratio("word_chars", "n_words"),
        "symbols": _ratio("n_symbols", "n_words"),
        "repeats": _ratio("n_repeat_words", "n_words"),
        "duplicate_lines": _ratio("n_dup_lines", "n_lines"),
        "words_a_line": _ratio("n_words", "n_lines"),
        "distinct_words": _ratio("n_unique_words", "n_words"),
        "upper": F.col("n_upper") / letters,
        "shouts": _ratio("n_shouts", "n_words"),
        "stops": _ratio("n_stops", "n_words"),
        "punctuation": _ratio("n_puncts", "n_words"),
        "digits": _ratio("n_digits", "n_words"),
        "controls": _ratio("n_controls", "n_words"),
    }


@dataclass(frozen=True)
class Rule:
    """Conditions (feature, above, threshold) that all hold, and a weight."""

    terms: tuple[tuple[str, bool, float], ...]
    weight: float

    def column(self) -> Column:
        holds = F.lit(True)
        for name, above, cut in self.terms:
            holds = holds & ((F.col(name) > cut) if above else (F.col(name) <= cut))
        return F.when(holds, F.lit(self.weight)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class RuleEnsemble:
    bias: float
    rules: tuple[Rule, ...]

    def score(self) -> Column:
        logit = F.lit(self.bias)
        for r in self.rules:
            logit = logit + r.column()
        return 1 / (1 + F.exp(-logit))


def _tree(bins: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, path=()):
    """(path, rows' value) of every node below the root; a path holds (feature, above, bin)."""
    if depth == 0 or len(rows) < 20:
        return [(path, rows)]
    best = (1e-6, None)
    g, h = grad[rows], hess[rows]
    whole = g.sum() ** 2 / (h.sum() + 1)
    for f in range(bins.shape[1]):
        b = bins[rows, f]
        gl, hl = np.cumsum(np.bincount(b, g, CUTS + 1))[:-1], np.cumsum(np.bincount(b, h, CUTS + 1))[:-1]
        gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - whole
        small = np.cumsum(np.bincount(b, minlength=CUTS + 1))[:-1]
        gain[(small < 5) | (len(rows) - small < 5)] = 0
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], (f, k))
    if best[1] is None:
        return [(path, rows)]
    f, k = best[1]
    above = bins[rows, f] > k
    out = []
    for side in (False, True):
        out += _tree(bins, grad, hess, rows[above == side], depth - 1, (*path, (f, side, k)))
    return out


def fit(x: np.ndarray, y: np.ndarray, names: list[str], seed: int = 1) -> RuleEnsemble:
    """The ensemble for statistics ``x`` (a row each) and 0/1 labels ``y``."""
    share = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return RuleEnsemble(bias, ())
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, CUTS + 2)[1:-1])) for c in x.T]
    for y_side in (0, 1):  # cuts within each class, so a rare class is resolved too
        own = x[y == y_side]
        cuts = [np.unique(np.append(c, np.quantile(o, np.linspace(0, 1, CUTS + 2)[1:-1]))) for c, o in zip(cuts, own.T)]
    cuts = [c[np.unique(np.linspace(0, len(c) - 1, CUTS).round().astype(int))] for c in cuts]
    bins = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
    logit, paths = np.full(len(y), bias), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-logit))
        grad, hess = y - p, p * (1 - p)
        rows = np.sort(rng.choice(len(y), max(1, len(y) // 2), replace=False))
        for path, _own in _tree(bins, grad, hess, rows, DEPTH):
            hold = np.ones(len(y), bool)
            for f, above, k in path:
                hold &= (bins[:, f] > k) == above
            logit[hold] += SHRINK * grad[hold].sum() / (hess[hold].sum() + 1)
            for n in range(1, len(path) + 1):
                paths[path[:n]] = None
    columns, kept = {}, []
    for path in paths:
        hold = np.ones(len(y), bool)
        for f, above, k in path:
            hold &= (bins[:, f] > k) == above
        if 0 < hold.sum() < len(y) and hold.tobytes() not in columns:
            columns[hold.tobytes()] = hold
            kept.append(path)
    if not kept:
        return RuleEnsemble(bias, ())
    r = np.stack(list(columns.values()), axis=1).astype(float)
    weights, bias = lasso(r, y.astype(float), bias)
    rules = []
    for path, w in zip(kept, weights):
        if w:
            terms = tuple((names[f], above, float(cuts[f][k])) for f, above, k in path if k < len(cuts[f]))
            rules.append(Rule(terms, float(w)))
    return RuleEnsemble(float(bias), tuple(rules))


def lasso(r: np.ndarray, y: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
    """Logistic weights under an L1 penalty, by accelerated proximal gradient steps."""
    n, m = r.shape
    step = 4 / (np.linalg.norm(np.hstack([r, np.ones((n, 1))]), 2) ** 2 / n)
    w, v, t, b, c = np.zeros(m), np.zeros(m), 1.0, bias, bias
    for _ in range(STEPS):
        e = 1 / (1 + np.exp(-(r @ v + c))) - y
        new = v - step * (r.T @ e) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * PENALTY, 0)
        new_b, new_t = c - step * e.mean(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / new_t * (new - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new, new_b, new_t
    return w, b


def train(docs: DataFrame, labels: DataFrame, where: Column | None = None, label: str = "quality", text_col: str = "text", bound: int = BOUND) -> RuleEnsemble:
    """Fit on about ``bound`` labelled rows for which ``where`` holds (a column over ``labels``)."""
    names = list(features())
    rows = sample(docs.select("doc_id", text_col), labels, label, bound, F.lit(True) if where is None else where)
    rows = with_stats(rows, text_col, ["doc_id", "__label"]).select("doc_id", "__label", *[c.cast("double").alias(n) for n, c in features().items()])
    got = rows.groupBy("doc_id").agg(F.min(F.struct("__label", *names)).alias("r")).select("doc_id", "r.*").orderBy("doc_id").toArrow()
    x = np.stack([got.column(n).to_numpy() for n in names], axis=1) if got.num_rows else np.zeros((0, len(names)))
    return fit(x, got.column("__label").to_numpy().astype(int), names)


def score(df: DataFrame, model: RuleEnsemble, text_col: str = "text", keep: list[str] | None = None, cut: float = 0.5) -> DataFrame:
    """Append ``score`` (double, 0 to 1) and ``predicted`` (int)."""
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in ("score", "predicted")]
    own = {n: f"__f_{n}" for n in features()}
    stats = with_stats(df.select(*[df[c].alias(f"__in_{i}") for i, c in enumerate(keep)], df[text_col].alias("__text")), "__text", [f"__in_{i}" for i in range(len(keep))])
    stats = stats.select(*[F.col(f"__in_{i}") for i in range(len(keep))], *[c.alias(own[n]) for n, c in features().items()])
    rules = tuple(Rule(tuple((own[f], a, c) for f, a, c in r.terms), r.weight) for r in model.rules)
    out = stats.select(*[F.col(f"__in_{i}").alias(c) for i, c in enumerate(keep)], RuleEnsemble(model.bias, rules).score().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels, crc_mod(labels, "doc_id", 3) != 1)
    out = score(docs, model, keep=["doc_id"])
    return out.select("doc_id", (crc_mod(out, "doc_id", 3) == 1).alias("held_out"), "score", "predicted")
