"""What functions learn about the query, sources joined together, and library documentation."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from vertexloom import api
from vertexloom.plans.hints import Candidates
from vertexloom.schema import Schema
from vertexloom.sources.crates import crates_source
from vertexloom.sources.spec import Source, check_source
from vertexloom.syntax import shorthand


def execute_query(source, query, *arguments):
    return api.execute_query(source, shorthand(query), *arguments)


SDL = """
schema { query: Q }
type Q { Thing(kind: String): [Thing!]  Tag: [Tag!] }
type Thing { id: Int!  size: Int  name: String!  tag: [Tag!] }
type Tag { thing: Int!  word: String! }
"""


def test_candidates_against_filters():
    rng = random.Random(2)
    ops = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a is not None and a < b, "<=": lambda a, b: a is not None and a <= b, ">": lambda a, b: a is not None and a > b, ">=": lambda a, b: a is not None and a >= b, "one_of": lambda a, b: a in b, "not_one_of": lambda a, b: a not in b, "is_null": lambda a, b: a is None, "is_not_null": lambda a, b: a is not None}
    for _ in range(2000):
        c, checks = Candidates(), []
        for _ in range(rng.randint(1, 4)):
            op = rng.choice(list(ops))
            value = [rng.choice([None, 1, 2, 3]) for _ in range(3)] if "one_of" in op else rng.randint(0, 4)
            c = c.narrowed(op, value)
            checks.append((op, value))
        fits = [v for v in (None, 0, 1, 2, 3, 4) if all(ops[o](v, x) for o, x in checks)]
        assert [v for v in (None, 0, 1, 2, 3, 4) if c.allows(v)] == fits, checks
        if c.impossible:
            assert not fits
        if c.single:
            assert fits == list(c.single)


def make(spark, seen: list) -> Source:
    things = spark.createDataFrame([(1, 5, "a"), (2, None, "b"), (3, 9, "c")], "id long, size long, name string")
    tags = spark.createDataFrame([(1, "x"), (1, "y"), (3, "x")], "thing long, word string")

    def start(raw, kind, hints):
        seen.append(hints)
        return raw

    def words(spark, hints):
        seen.append(hints)
        return tags

    s = Source(spark, Schema(SDL)).vertex("Thing", things, order=["id"]).vertex("Tag", tags, order=["thing", "word"])
    return s.root("Thing", start).root("Tag").edge_table("Thing", "tag", words, [("id", "thing")])


def test_functions_get_hints(spark):
    seen = []
    s = make(spark, seen)
    text = '{ Thing { id @output size ?(> $a) ?(<= $b) tag { word @output ?(one_of $w) } } }'
    assert [r.id for r in execute_query(s, text, {"a": 4, "b": 8, "w": ["x", "q"]}).collect()] == [1]
    root, edge = seen
    assert root.required == {"id", "size"} and root.candidates["size"].low == (4, False) and root.candidates["size"].high == (8, True)
    assert root.mandatory_edges == ("tag",) and edge.candidates["word"].values == ("x", "q") and edge.required == {"word"}
    seen.clear()
    execute_query(s, '{ Thing { id @output tag @optional { word ?(= $w) } } }', {"w": "x"})
    assert seen[0].mandatory_edges == () and seen[1].candidates == {}
    seen.clear()
    execute_query(s, '{ Thing { id @output tag @fold &count ?(>= $n) { word @output } } }', {"n": 2})
    assert seen[0].mandatory_edges == ("tag",)
    edge = seen[0].first_edge("tag")
    assert edge.fold and edge.mandatory and edge.depth == 0 and edge.far.required == {"word"} and seen[0].edges_named("other") == ()


def test_functions_get_keys_and_tags(spark):
    seen = []
    s = make(spark, [])
    tags = s.tables["Tag"].raw

    def fetch(spark, starts, hints):
        seen.append((starts.columns, sorted(map(tuple, starts.collect())), hints.tags))
        return tags.join(starts.select("id").distinct(), tags["thing"] == starts["id"], "left_semi")

    s.edge_table("Thing", "tag", fetch, [("id", "thing")])
    text = '{ Thing { id @output ?(>= $a) name @tag tag { word @output ?(>= %name) } } }'
    assert sorted(r.word for r in execute_query(s, text, {"a": 2}).collect()) == ["x"]
    columns, rows, (tag,) = seen[0]
    assert columns == ["id", "tag0"] and rows == [(2, "b"), (3, "c")] and (tag.property, tag.op, tag.name) == ("word", ">=", "tag0")
    seen.clear()
    execute_query(s, '{ Thing { id @output tag @fold { word @output } } }').collect()
    assert seen[0][1] == [(1,), (2,), (3,)]


def test_joined_sources(spark):
    seen = []
    one = make(spark, seen)
    people = "schema { query: Q } type Q { Person: [Person!] } type Person { name: String!  likes: [Thing!] } type Thing { id: Int! }"
    other = Source(spark, Schema(people)).vertex("Person", spark.createDataFrame([("ann", 3), ("bob", 7)], "name string, liked long")).root("Person")
    whole = SDL.replace("type Q { ", "type Q { Person: [Person!] ") + "type Person { name: String!  likes: [Thing!] }"
    s = one.joined_with(Schema(whole), other).edge_keys("Person", "likes", [("liked", "id")])
    assert check_source(s) == []
    got = execute_query(s, "{ Person { name @output likes @fold { things: name @output tag @fold { words: word @output } } } }").collect()
    assert {r.name: (r.things, r.words) for r in got} == {"ann": (["c"], [["x"]]), "bob": ([], [])}


def test_library_documentation(spark, tmp_path):
    index = {
        "0": {"name": "lib", "docs": "Top.", "visibility": "public", "inner": {"module": {"items": ["1", "2"]}}},
        "1": {"name": "Point", "docs": None, "visibility": "public", "inner": {"struct": {"kind": "plain"}}},
        "2": {"name": "go", "docs": "Goes.", "visibility": "crate", "inner": {"function": {"sig": {}}}},
        "3": {"name": "x", "docs": None, "visibility": "default", "inner": {"struct_field": "f"}},
    }
    (tmp_path / "lib.json").write_text(json.dumps({"root": "0", "crate_version": "1.0", "index": index}))
    s = crates_source(spark, str(tmp_path))
    assert check_source(s) == []
    got = execute_query(s, '{ Crate { item { ... on Module { module: name @output item @fold { names: name @output kinds: __typename @output } } } } }').collect()
    assert [(r.module, r.names, r.kinds) for r in got] == [("lib", ["Point", "go"], ["Struct", "Function"])]
    public = execute_query(s, '{ Crate { crate_version @output item { name @output visibility ?(= $v) } } }', {"v": "public"})
    assert sorted(r.name for r in public.select(F.col("name")).collect()) == ["Point", "lib"]
