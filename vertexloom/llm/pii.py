"""Operator 9, personal data: a skip-chain conditional random field over base patterns.

Base patterns find e-mail addresses, IPv4 addresses, card and phone numbers; what
they find always stays.  The field adds spans: its nodes are the words that hold a
digit or ``@`` or in which a secret ends (any other word can carry no label, which cuts
the chain exactly there), with potentials for a word's own features, for neighbouring nodes, and for
skip edges between occurrences of the same or a similar word anywhere in the
document.  An occurrence is linked to the next one, so a document has no more skip
edges than words.  Words under base spans and
under secret formats enter as evidence, and loopy message
passing carries it along skip edges, over any number of them until the messages
rest: a number that is a phone number in one place is one where it is written
without its country code too.

Weights are trained piecewise (own features by softmax regression, pairs by
pointwise mutual information) on a sample of about ``BOUND`` documents (a parameter)
that the base patterns and a few secret formats label.

Cases: null text counts as empty and has no spans.  Texts are read whole; all
patterns take linear time.  Repeated rows are read each; an empty table gives an
empty table.  Input columns named as a result column are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.llm.common import extend, struct, table, text_of
from vertexloom.llm.labelled import hash_share, share

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
#: Documents drawn for training, about; share of a label's probability from which a word is marked.
BOUND, SURE = 20_000, 0.9
DAMPING, EVIDENCE, SPREAD = 0.5, 60.0, 4.0
#: Distinct lessons that training looks at, the most frequent ones; runs of characters that a word's shape tells apart.
LESSONS, RUNS = 200_000, 12
#: Share of masked occurrences that a skip edge must reach, what it has to spare, and its strength where none was seen.
REACHED, SPARE, UNSEEN = 0.99, 1.0, 12.0
#: A message is at rest once a step moves it less than STILL; one that has moved ROUNDS times swings, and each further step shrinks by CALM.
STILL, ROUNDS, CALM = 5e-4, 64, 0.9

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SECRET = re.compile(r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key)\s?[=:]\s?)(\S{6,})|\"[0-9a-f]{32,64}\"")
_KEY = re.compile(r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key)[=:]$")
_NUMERIC = re.compile(r"[0-9+().,;-]*[0-9][0-9+().,;-]*")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MARKED = re.compile(r"[0-9@]")
#: The keys of secrets, for Spark: at least what ``_SECRET`` finds of them.
_KEYWORD = r"(?siu)(?:password|passwd|pwd|secret|token|api[_-]?key).?[=:]"
_RUNS = re.compile(r"[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]")
_EDGE = "\"'`,;:!?.()[]{}<>|*$%&"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(end, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the base patterns find, in order."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out)


def _size(n: int) -> str:
    return str(n) if n < 5 else "5+" if n < 9 else "9+" if n < 17 else "17+"


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _feature_names(word: str, before: str, after: str) -> list[str]:
    shape = "".join((r[0] if not r[0].isalnum() else "9" if r[0].isdigit() else "A" if r[0].isupper() else "a") + (_size(len(r)) if r[0].isalnum() else "") for r in islice(map(itemgetter(0), _RUNS.finditer(word)), RUNS))
    digits = _digits(word)
    out = ["bias", "shape " + shape, "size " + _size(len(word)), "digits " + _size(len(digits))]
    if "@" in word:
        out.append("at")
    if 14 <= len(digits) <= 19:
        out.append(f"luhn {luhn(digits)}")
    if word.count(".") == 3:
        out.append("quad")
    if _KEY.search(before):
        out.append("key")
    for name, other in (("before ", before), ("after ", after)):
        kind = "none" if not other else "marked" if _MARKED.search(other) else "ends " + other[-1] if other[-1] in ":=" else "plain"
        out.append(name + kind)
    return out


@dataclass
class Document:
    """The nodes of a text and how they hang together."""

    spans: list[tuple[int, int]]
    names: list[list[str]]
    near: list[tuple[int, int]]
    skip: list[tuple[int, int]]
    base: list[int]  # label of a node under a base span, 0 if none
    secret: list[bool]  # whether a secret format ends in the node
    keys: list[str | None]  # what occurrences of an entity have in common


def read(text: str, found: list[tuple[int, int, int]]) -> Document:
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    secrets, values = [], set()
    for m in _SECRET.finditer(text):
        secrets.append(m.end())
        values.add((m[1] or m[0]).strip(_EDGE).casefold())
    doc, last, previous, f, s, run = Document([], [], [], [], [], [], []), {}, -2, 0, 0, ""
    for i, (a, b) in enumerate(words):
        raw = text[a:b]
        while s < len(secrets) and secrets[s] <= a:
            s += 1
        secret = s < len(secrets) and secrets[s] <= b
        word = raw.strip(_EDGE)
        value = secret or (bool(values) and word.casefold() in values)
        before = text[slice(*words[i - 1])] if i else ""
        if not value and not _MARKED.search(raw) and not (before[-1:] in ("=", ":") and _KEY.search(before)):
            continue
        start = a + len(raw) - len(raw.lstrip(_EDGE))
        n = len(doc.spans)
        doc.spans.append((start, start + len(word)))
        doc.names.append(_feature_names(word, before, text[slice(*words[i + 1])] if i + 1 < len(words) else ""))
        while f < len(found) and found[f][2] <= a:
            f += 1
        under = [k for x, k, e in found[f : f + 5] if x < b and e > a]
        doc.base.append(under[0] + 1 if under else 0)
        doc.secret.append(secret and not under)
        if previous == i - 1:
            doc.near.append((n - 1, n))
        numeric = _NUMERIC.fullmatch(raw)
        run = (run if previous == i - 1 else "") + _digits(raw) if numeric else ""
        previous, own, key = i, _digits(word), None
        if len(own) >= 7:
            key = own[-7:]
        elif len(run) >= 7 and not (i + 1 < len(words) and _NUMERIC.fullmatch(text, *words[i + 1])):
            key = run[-7:]
        elif "@" in word or word.count(".") == 3:
            key = word.casefold()
        elif value:
            key = "=" + re.split("[=:]", word.casefold())[-1].strip(_EDGE)
        doc.keys.append(key)
        if key is not None:
            if key in last:
                doc.skip.append((last[key], n))
            last[key] = n
    return doc


@dataclass(frozen=True)
class Field:
    """Potentials: weights of a feature by label, and of label pairs of neighbours and of skip edges."""

    number: dict[str, int]
    weight: np.ndarray
    near: np.ndarray
    skip: np.ndarray

    def marginals(self, docs: list[Document]) -> np.ndarray:
        """Label probabilities of all nodes of ``docs``, by loopy message passing over all at once.

        A message is sent again as long as it, or one that it is made from, still
        moves, so evidence goes as far as it has an effect and a document's labels don't depend on
        the others.  Only messages that swing are calmed, each by how often it moved itself.
        """
        labels = len(KINDS) + 1
        sizes = [len(d.spans) for d in docs]
        own = np.zeros((sum(sizes), labels))
        ids = [(r, self.number[f]) for r, names in enumerate(x for d in docs for x in d.names) for f in names if f in self.number]
        if ids:
            r, f = np.array(ids).T
            np.add.at(own, r, self.weight[f])
        base = np.array([b for d in docs for b in d.base], int)
        own[np.flatnonzero(base), base[base > 0]] += EVIDENCE
        own[np.array([x for d in docs for x in d.secret], bool), KINDS.index("secret") + 1] += EVIDENCE
        shift = np.concatenate([[0], np.cumsum(sizes)])
        edges = [(a + s, b + s, t) for d, s in zip(docs, shift) for t, pairs in enumerate((d.near, d.skip)) for a, b in pairs]
        if not edges or not len(own):
            return _softmax(own)
        a, b, t = np.array(edges).T
        pair = np.stack([self.near, self.skip, self.near.T, self.skip.T])
        source, target, kind = np.append(a, b), np.append(b, a), np.append(t, t + 2)
        back = np.roll(np.arange(len(source)), len(a))
        message, belief = np.zeros((len(source), labels)), own.copy()
        times, active = np.zeros(len(source), int), np.arange(len(source))
        leaving = np.argsort(source, kind="stable")
        begin = np.searchsorted(source[leaving], np.arange(len(own) + 1))
        while len(active):
            out = (belief[source[active]] - message[back[active]])[:, :, None] + pair[kind[active]]
            top = out.max(axis=1)
            new = top + np.log(np.exp(out - top[:, None]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            step = (1 - DAMPING) * CALM ** np.maximum(times[active] - ROUNDS, 0)
            change = step[:, None] * (new - message[active])
            moved = np.abs(change).max(axis=1) >= STILL
            active, change = active[moved], change[moved]
            times[active] += 1
            message[active] += change
            np.add.at(belief, target[active], change)
            node = np.unique(target[active])
            many = begin[node + 1] - begin[node]
            at = np.repeat(begin[node] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            active = np.union1d(active, leaving[at])
        return _softmax(belief)

    def spans(self, texts: list[str | None]) -> list[tuple[list, list]]:
        """For each text its base spans and all spans, both sorted (start, kind, end)."""
        base = [base_spans(t) if t else [] for t in texts]
        at = [i for i, t in enumerate(texts) if t and (_MARKED.search(t) or _SECRET.search(t))]
        docs = [read(texts[i], base[i]) for i in at]
        chance = self.marginals(docs)
        out = [(b, b) for b in base]
        low = 0
        for i, d in zip(at, docs):
            p = chance[low : low + len(d.spans)]
            low += len(d.spans)
            label = np.where(p.max(axis=1, initial=0) >= SURE, p.argmax(axis=1), 0) if len(p) else []
            adjacent, more = {b for _, b in d.near}, []
            for n, (k, (a, b)) in enumerate(zip(label, d.spans)):
                if not k or d.base[n] or a == b:
                    continue
                if more and more[-1][3] == n - 1 and n in adjacent and more[-1][1] == k - 1 and k in (3, 4):
                    more[-1] = (more[-1][0], k - 1, b, n)
                else:
                    more.append((a, int(k) - 1, b, n))
            if more:
                out[i] = (base[i], sorted(base[i] + [m[:3] for m in more]))
        return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True, initial=-np.inf)) if len(x) else x
    return e / e.sum(axis=1, keepdims=True) if len(x) else x


def _lesson(text: str) -> tuple[list[str], list[int], list[str]]:
    """A text's nodes (label and feature names), the label pairs of its neighbours, and mentions of its entities in forms that no pattern finds."""
    found = base_spans(text)
    doc = read(text, found)
    spans = [(m.span(), m) for m in _SECRET.finditer(text)]
    labels, s = [], 0
    for (a, b), k in zip(doc.spans, doc.base):
        while s < len(spans) and spans[s][0][1] <= a:
            s += 1
        labels.append(k or (5 if s < len(spans) and spans[s][0][0] < b else 0))
    known = {key: k for key, k in zip(doc.keys, labels) if key is not None and k}
    labels = [k or known.get(key, 0) for key, k in zip(doc.keys, labels)]
    values = [(m[1] or m[0]).strip(_EDGE) for _, m in spans]
    masked = [(5, w) for v in values for w in (v, re.sub("[0-9]", "a", v).lower())]  # with and without digits
    for a, k, b in found:
        bare = _digits(text[a:b])
        masked += {2: [(3, bare), (3, bare[-12:]), (3, bare[-10:]), (3, bare[-8:])], 3: [(4, bare), (4, bare[-10:]), (4, bare[-7:]), (4, bare[-7:-4] + "-" + bare[-4:])]}.get(k, [])
    line = lambda k, names: "\t".join([str(k), *names])
    return [line(k, names) for k, names in zip(labels, doc.names)], [labels[a] * 8 + labels[b] for a, b in doc.near], [line(k, _feature_names(w, "a", after)) for k, w in masked if w for after in ("a", "")]


def _association(pairs: Counter, prior: float) -> np.ndarray:
    """Log of how much likelier labels meet than by chance, symmetric, kept within +-SPREAD."""
    n = len(KINDS) + 1
    m = np.eye(n) * prior + 0.5
    for code, times in pairs.items():
        m[code // 8, code % 8] += times / 2
        m[code % 8, code // 8] += times / 2
    p = m / m.sum()
    return np.clip(np.log(p / np.outer(p.sum(1), p.sum(0))), -SPREAD, SPREAD)


def _rows(nodes: Counter) -> list[tuple[int, list[str], int]]:
    return [(int(k), names, times) for node, times in sorted(nodes.items()) for k, *names in [node.split("\t")]]


def fit(nodes: Counter, near: Counter, masked: Counter, rounds: int = 300) -> Field:
    """Piecewise training from counted nodes, label pairs and masked occurrences."""
    labels = len(KINDS) + 1
    seen = Counter()
    rows = _rows(nodes)
    for _, names, times in rows:
        for f in names:
            seen[f] += times
    number = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= 2))}
    weight = np.zeros((len(number), labels))
    if rows and number:
        r, f = np.array([(i, number[f]) for i, (_, names, _) in enumerate(rows) for f in names if f in number]).T
        y, times = np.eye(labels)[[k for k, _, _ in rows]], np.array([t for _, _, t in rows], float)
        pull = np.zeros_like(weight)
        for _ in range(rounds):
            logit = np.zeros((len(rows), labels))
            np.add.at(logit, r, weight[f])
            error = (_softmax(logit) - y) * times[:, None]
            slope = np.zeros_like(weight)
            np.add.at(slope, f, error[r])
            slope += 0.1 * weight
            pull += slope**2
            weight -= 0.5 * slope / (np.sqrt(pull) + 1e-9)
    elif not number:
        number, weight = {"bias": 0}, np.zeros((1, labels))
        weight[0, 0] = 5
    need: dict[int, list[tuple[float, int]]] = {}
    for k, names, times in _rows(masked):
        own = weight[[number[f] for f in names if f in number]].sum(axis=0)
        need.setdefault(k, []).append((float(np.log(np.exp(np.delete(own, k) - own[k]).sum())), times))
    skip = np.zeros((labels, labels))
    for k in range(1, labels):
        gap, times = np.array(sorted(need.get(k, [(UNSEEN, 1)]))).T
        most = gap[np.searchsorted(np.cumsum(times), REACHED * times.sum())]
        strength = max(0.0, most) + np.log(SURE / (1 - SURE)) + SPARE
        skip[k] -= strength / 2
        skip[:, k] -= strength / 2
        skip[k, k] += 1.5 * strength
    return Field(number, weight, _association(near, 1.0), skip)


def train(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", bound: int = BOUND) -> Field:
    """Fit on the texts that can hold something among about ``bound`` rows drawn by hash."""

    def run(texts: pa.Array) -> pa.Array:
        lessons = [_lesson(t) for t in texts.to_pylist()]
        kinds = (pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.string()))
        return struct(**{n: pa.array([x[i] for x in lessons], k) for i, (n, k) in enumerate(zip(("nodes", "near", "masked"), kinds))})

    drawn = df.where(hash_share(F.col(id_col), F.xxhash64(df[text_col].cast("string"))) < share(bound, df.count())).where(_holds(df[text_col]))
    got = extend(drawn, run, "struct<nodes:array<string>,near:array<int>,masked:array<string>>", text_of(drawn, text_col), [])

    def tagged(c: str, kind: int) -> Column:
        return F.transform(c, lambda x: F.struct(F.lit(kind).alias("kind"), x.cast("string").alias("x")))

    kinds = [tagged(c, i) for i, c in enumerate(("nodes", "near", "masked"))]
    counted = got.select(F.explode(F.concat(*kinds)).alias("e")).groupBy("e.kind", "e.x").count().orderBy(F.desc("count"), "kind", "x").limit(LESSONS).collect()
    nodes, near, masked = (Counter({(int(x) if i == 1 else x): n for k, x, n in counted if k == i}) for i in range(3))
    return fit(nodes, near, masked)


def find(df: DataFrame, model: Field, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``base_spans`` and ``spans``, arrays of (kind, start, end) in code points, sorted."""

    def run(texts: pa.Array) -> pa.Array:
        out = {"base_spans": [], "spans": []}
        texts = texts.to_pylist()
        for at in range(0, len(texts), 256):
            for base, every in model.spans(texts[at : at + 256]):
                for name, spans in (("base_spans", base), ("spans", every)):
                    out[name].append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        return struct(**{n: pa.array(v, kind) for n, v in out.items()})

    one = "array<struct<kind:string,start:int,end:int>>"
    return extend(df, run, f"struct<base_spans:{one},spans:{one}>", _marked(df, text_col), keep)


def _marked(df: DataFrame, text_col: str) -> Column:
    """The text, or null if it can hold nothing: most texts then never leave the JVM."""
    text = df[text_col].cast("string")
    return F.when(_holds(text), text)


def _holds(text: Column) -> Column:
    """At least the texts in which something can be found; what is dear to look for comes after what it needs."""
    secret = (text.contains("=") | text.contains(":")) & text.rlike(_KEYWORD)
    token = text.contains("KIA") | text.contains("SIA") | (text.contains('"') & text.rlike('"[a-f]{32}'))
    return text.rlike("[0-9@]") | secret | token


def redact(df: DataFrame, model: Field, text_col: str = "text") -> DataFrame:
    """Replace every span of ``text_col`` by its kind in brackets."""

    def run(texts: pa.Array) -> pa.Array:
        texts, out = texts.to_pylist(), []
        for at in range(0, len(texts), 256):
            part = texts[at : at + 256]
            for text, (_, spans) in zip(part, model.spans(part)):
                if not spans:
                    out.append(None)
                    continue
                end, pieces = 0, []
                for a, k, b in spans:
                    if a >= end:
                        pieces += [text[end:a], f"[{KINDS[k].upper()}]"]
                    end = max(end, b)
                out.append("".join([*pieces, text[end:]]))
        return struct(__clean=pa.array(out, pa.string()))

    out = extend(df, run, "struct<__clean:string>", _marked(df, text_col))
    return out.select(*[F.coalesce("__clean", text_col).alias(c) if c == text_col else c for c in df.columns])


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = find(docs, train(docs), keep=["doc_id"])
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
