"""Random queries over the numbers graph, against a plain row-at-a-time interpreter."""

from __future__ import annotations

import json
import random

import pytest

from vertexloom.api import execute_query
from vertexloom.plans.frontend import compile_query
from vertexloom.sources.numbers import NAMES, numbers_source

OPS = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: None not in (a, b) and a < b,
    ">=": lambda a, b: None not in (a, b) and a >= b,
    "one_of": lambda a, b: b is not None and a in b,
    "not_one_of": lambda a, b: not (b is not None and a in b),
    "has_prefix": lambda a, b: None not in (a, b) and a.startswith(b),
    "not_has_substring": lambda a, b: not (None not in (a, b) and b in a),
    "contains": lambda a, b: a is not None and b in a,
    "not_contains": lambda a, b: not (a is not None and b in a),
    "is_null": lambda a, b: a is None,
    "is_not_null": lambda a, b: a is not None,
}


def prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, n))


def kind(n: int) -> str:
    return "Prime" if prime(n) else "Composite" if n > 3 else "Neither"


def prop(n: int, name: str):
    word = NAMES[n] if n < len(NAMES) else None
    return {"value": n, "name": word, "vowelsInName": None if word is None else [c for c in word if c in "aeiou"], "__typename": kind(n)}[name]


def neighbours(n: int, edge: str, limit: int | None) -> list[int]:
    if edge == "predecessor":
        return [n - 1] if n else []
    if edge == "successor":
        return [n + 1]
    if edge == "multiple":
        return [n * k for k in range(2 if prime(n) else 1, limit + 1)] if n > 1 else []
    divisors = [k for k in range(1, n) if n % k == 0]
    return divisors if edge == "divisor" else [k for k in divisors if prime(k)]


class Maker:
    """Writes a random query, and the same as a tree."""

    def __init__(self, seed: int):
        self.rng, self.args, self.names, self.tags = random.Random(seed), {}, 0, []

    def new(self, stem: str) -> str:
        self.names += 1
        return f"{stem}{self.names}"

    def variable(self, value) -> str:
        name = self.new("x")
        self.args[name] = value
        return name

    def vertex(self, depth: int, type_name: str, visible: list) -> dict:
        r = self.rng
        out = {"props": [], "steps": []}
        for _ in range(r.randint(1, 2)):
            name = r.choice(["value", "value", "name", "vowelsInName", "__typename"])
            p = {"name": name, "outputs": [self.new("o")], "filters": [], "tag": None}
            if r.random() < 0.3:
                p["filters"].append(self.filter(name, visible))
            if name in ("value", "name") and r.random() < 0.3:
                p["tag"] = (self.new("t"), name)
                visible.append(p["tag"])
            out["props"].append(p)
        for _ in range(r.randint(0, 2) if depth else 0):
            out["steps"].append(self.step(depth - 1, type_name, visible))
        return out

    def filter(self, name: str, visible: list):
        r = self.rng
        same = [t for t, k in visible if k == name]
        if same and r.random() < 0.5:
            return (r.choice(["=", "!=", "<", ">="]), "%", self.use(r.choice(same)))
        if name == "value":
            op = r.choice(["=", "!=", "<", ">=", "one_of", "not_one_of", "is_null", "is_not_null"])
            value = [r.randint(0, 9), None, 4] if "one_of" in op else r.randint(0, 9)
        elif name == "vowelsInName":
            op, value = r.choice(["contains", "not_contains"]), r.choice(["e", "o"])
        elif name == "name":
            op = r.choice(["=", "has_prefix", "not_has_substring", "is_null"])
            value = r.choice(["t", "one", "f"])
        else:
            op, value = r.choice(["=", "!="]), r.choice(["Prime", "Composite"])
        return (op, "$", None if op.startswith("is_") else self.variable(value))

    def use(self, tag: str) -> str:
        self.tags.append(tag)
        return tag

    def step(self, depth: int, type_name: str, visible: list) -> dict:
        r = self.rng
        edge = r.choice(["predecessor", "successor", "multiple"] + (["divisor", "primeFactor"] if type_name == "Composite" else []))
        target = {"multiple": "Composite", "primeFactor": "Prime"}.get(edge, "Number")
        mode = r.choice(["plain", "optional", "fold", "fold", "recurse"])
        if mode == "recurse" and (edge in ("multiple", "primeFactor", "divisor")):
            mode = "optional"
        s = {"edge": edge, "limit": r.randint(1, 3) if edge == "multiple" else None, "mode": mode, "alias": self.new("a"), "depth": r.randint(1, 2), "to": None, "count": None}
        if target == "Number" and r.random() < 0.3:
            s["to"] = r.choice(["Prime", "Composite", "Neither"])
        inner = list(visible) if mode == "fold" else visible
        s["vertex"] = self.vertex(depth, s["to"] or target, inner)
        if mode == "fold" and r.random() < 0.6:
            filters = [(r.choice(["=", ">=", "<", "!="]), "$", self.variable(r.randint(0, 2)))] if r.random() < 0.5 else []
            s["count"] = {"output": self.new("o"), "filters": filters, "tag": None}
            if r.random() < 0.4:
                s["count"]["tag"] = (self.new("t"), "value")
                visible.append(s["count"]["tag"])
            if r.random() < 0.2 and filters:
                s["count"]["output"] = None
        return s

    # text

    def filters_text(self, filters) -> str:
        return "".join(f' @filter(op: "{op}"' + (f', value: ["{mark}{name}"])' if name else ")") for op, mark, name in filters)

    def vertex_text(self, v: dict) -> str:
        out = []
        for p in v["props"]:
            tag = f' @tag(name: "{p["tag"][0]}")' if p["tag"] and p["tag"][0] in self.tags else ""
            out.append(p["name"] + tag + self.filters_text(p["filters"]) + "".join(f' @output(name: "{o}")' for o in p["outputs"]))
        for s in v["steps"]:
            t = f"{s['alias']}: {s['edge']}" + (f"(max: {s['limit']})" if s["limit"] else "")
            t += {"plain": "", "optional": " @optional", "fold": " @fold", "recurse": f" @recurse(depth: {s['depth']})"}[s["mode"]]
            if c := s["count"]:
                t += ' @transform(op: "count")' + (f' @output(name: "{c["output"]}")' if c["output"] else "") + self.filters_text(c["filters"])
                t += f' @tag(name: "{c["tag"][0]}")' if c["tag"] and c["tag"][0] in self.tags else ""
            body = self.vertex_text(s["vertex"])
            out.append(f"{t} {{ " + (f"... on {s['to']} {{ {body} }}" if s["to"] else body) + " }")
        return " ".join(out)


class Interpreter:
    """Contexts are (vertex or None, tags by name as (exists, value), outputs)."""

    def __init__(self, args: dict):
        self.args = args

    def passes(self, filters, value, exists: bool, tags: dict) -> bool:
        for op, mark, name in filters:
            there, right = tags[name] if mark == "%" else (True, self.args.get(name))
            if exists and there and not OPS[op](value, right):
                return False
        return True

    def vertex(self, contexts: list, v: dict, to: str | None) -> list:
        out = []
        for n, tags, outputs in contexts:
            if to and n is not None and kind(n) != to:
                continue
            tags, outputs = dict(tags), dict(outputs)
            for p in v["props"]:
                value = None if n is None else prop(n, p["name"])
                if p["tag"]:
                    tags[p["tag"][0]] = (n is not None, value)
                outputs |= dict.fromkeys(p["outputs"], value)
            if all(self.passes(p["filters"], None if n is None else prop(n, p["name"]), n is not None, tags) for p in v["props"]):
                out.append((n, tags, outputs))
        for s in v["steps"]:
            out = self.fold(out, s) if s["mode"] == "fold" else self.follow(out, s)
        return out

    def follow(self, contexts: list, s: dict) -> list:
        out = []
        for n, tags, outputs in contexts:
            if n is None:
                ends = [None]
            elif s["mode"] == "recurse":
                ends, level = [n], [n]
                for _ in range(s["depth"]):
                    level = [m for k in level for m in neighbours(k, s["edge"], s["limit"])]
                    ends += level
            else:
                ends = neighbours(n, s["edge"], s["limit"]) or ([None] if s["mode"] == "optional" else [])
            for m in ends:
                for _, t, o in self.vertex([(m, tags, outputs)], s["vertex"], s["to"]):
                    out.append((n, t, o))
        return out

    def names(self, v: dict) -> list[str]:
        out = [o for p in v["props"] for o in p["outputs"]]
        for s in v["steps"]:
            out += self.names(s["vertex"]) + ([s["count"]["output"]] if s["count"] and s["count"]["output"] else [])
        return out

    def fold(self, contexts: list, s: dict) -> list:
        out, names, c = [], self.names(s["vertex"]), s["count"] or {"filters": [], "output": None, "tag": None}
        for n, tags, outputs in contexts:
            tags, outputs = dict(tags), dict(outputs)
            if n is None:
                size, lists = None, dict.fromkeys(names)
            else:
                inner = [self.vertex([(m, tags, {})], s["vertex"], s["to"]) for m in neighbours(n, s["edge"], s["limit"])]
                inner = [o for rows in inner for _, _, o in rows]
                size, lists = len(inner), {k: [o[k] for o in inner] for k in names}
            if c["tag"]:
                tags[c["tag"][0]] = (n is not None, size)
            if c["output"]:
                outputs[c["output"]] = size
            if self.passes(c["filters"], size, n is not None, tags):
                out.append((n, tags, outputs | lists))
        return out


@pytest.fixture(scope="module")
def source(spark):
    return numbers_source(spark)


@pytest.mark.parametrize("seed", range(60))
def test_same_rows(source, seed):
    m = Maker(seed)
    tree = m.vertex(2, "Number", [])
    low, high = m.rng.randint(0, 3), m.rng.randint(3, 7)
    text = f"{{ Number(min: {low}, max: {high}) {{ {m.vertex_text(tree)} }} }}"
    used = compile_query(source.schema, text).variables
    args = {k: v for k, v in m.args.items() if k in used}
    want = [o for _, _, o in Interpreter(args).vertex([(n, {}, {}) for n in range(low, high + 1)], tree, None)]
    got = [r.asDict(recursive=True) for r in execute_query(source, text, args).collect()]
    canonical = lambda rows: sorted(json.dumps(r, sort_keys=True) for r in rows)
    assert canonical(got) == canonical(want), text
