"""Types, predicates, plans, sources and sinks."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from vertexloom import api
from vertexloom.errors import SourceError
from vertexloom.functions import regex
from vertexloom.operators.predicates import literal, predicate
from vertexloom.queries import QUERIES
from vertexloom.schema import Schema
from vertexloom.sources import readers, sdl
from vertexloom.sources.introspection import introspection_source
from vertexloom.sources.numbers import numbers_source
from vertexloom.sources.spec import Source, check_source
from vertexloom.sources.warehouse import warehouse_source
from vertexloom.syntax import shorthand
from vertexloom.types import Type


def run(source, query, *arguments):
    return api.execute_query(source, shorthand(query), *arguments)


@pytest.mark.parametrize("text", ["Int", "Int!", "[Int]", "[Int!]!", "[[String]!]", "[[[Float!]]]!"])
def test_types_print_as_they_parse(text):
    assert str(Type.parse(text)) == text


def test_type_algebra():
    t = Type.parse
    assert t("[Int]!").intersect(t("[Int!]")) == t("[Int!]!") and t("Int").intersect(t("[Int]")) is None and t("Int").intersect(t("Float")) is None
    assert t("Int!").narrows(t("Int")) and not t("Int").narrows(t("Int!")) and t("[Int!]").narrows(t("[Int]"))
    assert t("[Int]").accepts([1, None]) and not t("[Int!]").accepts([None]) and not t("Float").accepts(1) and not t("Int").accepts(1 << 64) and t("Int").accepts((1 << 64) - 1)
    assert not t("Float").accepts(float("nan")) and not t("ID").accepts("x") and t("Boolean").accepts(True) and not t("Int").accepts(True)
    for bad in ("", "[Int", "Int]", "Int!!", "[" * 31 + "Int" + "]" * 31):
        with pytest.raises(ValueError):
            t(bad)


# predicates: every operator over nulls and values, against plain Python

TWO = {
    "=": lambda a, b: a == b,
    "<": lambda a, b: None not in (a, b) and a < b,
    "<=": lambda a, b: None not in (a, b) and a <= b,
    ">": lambda a, b: None not in (a, b) and a > b,
    ">=": lambda a, b: None not in (a, b) and a >= b,
    "has_prefix": lambda a, b: None not in (a, b) and a.startswith(b),
    "has_suffix": lambda a, b: None not in (a, b) and a.endswith(b),
    "has_substring": lambda a, b: None not in (a, b) and b in a,
    "regex": lambda a, b: None not in (a, b) and b != "(" and b in a,
}
LIST = {"contains": lambda a, b: a is not None and b in a, "one_of": lambda b, a: a is not None and b in a}


def test_two_valued_logic(spark):
    values, lists = [None, "a", "ab", "b", "("], [None, [], ["a"], [None], ["b", None]]
    rows = [(a, b, c) for a, b, c in itertools.product(values, values, lists)]
    df = spark.createDataFrame(rows, "a string, b string, c array<string>")
    checks = {}
    for op, want in TWO.items():
        checks[op] = (predicate(op, F.col("a"), F.col("b")), lambda r, w=want: w(r[0], r[1]))
        checks["!=" if op == "=" else f"not_{op}"] = (~predicate(op, F.col("a"), F.col("b")), lambda r, w=want: not w(r[0], r[1]))
    checks["!="] = (predicate("!=", F.col("a"), F.col("b")), lambda r: r[0] != r[1])
    checks["is_null"] = (predicate("is_null", F.col("a")), lambda r: r[0] is None)
    checks["is_not_null"] = (predicate("is_not_null", F.col("a")), lambda r: r[0] is not None)
    checks["contains"] = (predicate("contains", F.col("c"), F.col("a")), lambda r: LIST["contains"](r[2], r[0]))
    checks["not_contains"] = (predicate("not_contains", F.col("c"), F.col("a")), lambda r: not LIST["contains"](r[2], r[0]))
    checks["one_of"] = (predicate("one_of", F.col("a"), F.col("c")), lambda r: LIST["one_of"](r[0], r[2]))
    for i, constant in enumerate(lists[1:]):
        checks[f"not_one_of {i}"] = (predicate("not_one_of", F.col("a"), literal(constant, Type.parse("[String]")), constant, True), lambda r, c=constant: r[0] not in c)
    got = df.select("a", "b", "c", *[c.alias(f"p{i}") for i, (c, _) in enumerate(checks.values())]).collect()
    for r in got:
        for i, (name, (_, want)) in enumerate(checks.items()):
            assert r[f"p{i}"] is want(r), (name, r[:3])


def test_large_whole_numbers(spark):
    df = spark.createDataFrame([(1,), ((1 << 63) - 1,)], "n bigint")
    top = (1 << 64) - 1
    assert df.where(predicate("<", F.col("n"), literal(top, Type.parse("Int!")))).count() == 2
    assert df.where(predicate("one_of", F.col("n"), literal([top, 1], Type.parse("[Int]!")), [top, 1], True)).count() == 1


def test_regex_dialect(spark):
    df = spark.createDataFrame([("é1\n",), ("ab",), ("a\rb",), ("x]y",)], "t string")
    match = lambda p: [r.t for r in df.where(F.col("t").rlike(regex.java(p))).collect()]
    assert match(r"^\w\d") == ["é1\n"] and match(r"b$") == ["ab", "a\rb"] and match(r"1$") == [] and match("a.b") == ["a\rb"]
    assert match(r"[[:alpha:]]{2}") == ["ab"] and match(r"(?m)1$") == ["é1\n"] and match(r"(?P<n>x)[\]]y") == ["x]y"] and match("(?i)AB") == ["ab"]
    assert regex.python("[[:alpha:]]+").search("é1b")[0] == "b" and match("^[[:alpha:]]") == ["ab", "a\rb", "x]y"] and regex.python(r"b\z").search("ab")
    assert match(r"^\p{L}\p{N}") == ["é1\n"] and regex.python(r"\p{Lu}").search("aB")
    assert match(r"^[[:^alpha:]]") == ["é1\n"] and regex.python("[[:^alpha:]]").search("ab1")[0] == "1" and match(r"[^[:^alpha:]]\]") == ["x]y"]
    for bad in ("[[:^nothing:]]", "[[:nothing:]]", "(", "a(?=b)", "(?<!a)b", r"(a)\1", "(?U)a", r"\k<n>"):
        with pytest.raises(ValueError):
            regex.java(bad)


def test_both_engines_find_the_same():
    import pyarrow as pa

    texts = ["é1\n", "ab", "a\rb", "x]y", "", None, "٣ four_5", "A-b c", "aaaa!", "\u2003x"]
    patterns = [r"^\w\d", r"b$", r"\s\w+", "[[:alpha:]]{2}", "[[:^alpha:]]", r"\bfour", r"\p{L}\p{N}", r"\p{Alphabetic}", "(?i)a-B", r"[\w-]+ c", r"\S\D$", "(", "a(?=b)", r"[^\W\d]", "(?P<n>x).", r"(?m)1$", r"[a-c&&[b]]"]
    for p in patterns:
        try:
            want = [t is not None and regex.python(p).search(t) is not None for t in texts]
        except ValueError:
            want = [False] * len(texts)
        except regex.regex.error:
            want = [False] * len(texts)
        assert regex._search(pa.array(texts), p).to_pylist() == want, p
    many = regex._matches(pa.array([t for t in texts for _ in patterns]), pa.array(patterns * len(texts)))
    assert many.to_pylist() == [regex._search(pa.array([t], pa.string()), p).to_pylist()[0] for t in texts for p in patterns]
    assert regex.linear(r"\d+") and regex.linear(r"\bx") is None


def test_explosive_patterns_take_linear_time(spark):
    for p in ("(a+)+$", "(a*)*b", "(?:x|a+){2,}!", "((a|b)+c*)+d"):
        assert regex.explosive(p), p
    for p in ("a+b*", "(ab)+", "^(AUTO|MACH).*[YE]$", r"\(+\)+", "[(+]+[)]+"):
        assert not regex.explosive(p), p
    df = spark.createDataFrame([("a" * 5000 + "!",), ("aaa",)], "t string")
    assert [len(r.t) for r in df.where(predicate("regex", F.col("t"), None, "(a+)+$", True)).collect()] == [3]


# plans


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_existence_becomes_semi_and_anti_joins(spark, tiny):
    s = warehouse_source(spark, tiny)
    q = '{ Customer { key @output order @fold &count ?(%s $n) } }'
    for op, n, want in ((">=", 1, "LeftSemi"), (">", 0, "LeftSemi"), ("=", 0, "LeftAnti"), ("<", 1, "LeftAnti")):
        p = plan(run(s, q % op, {"n": n}))
        assert want in p and "HashAggregate" not in p
    inner = plan(run(s, q % ">=", {"n": 3}))
    assert "Inner" in inner or "BuildRight" in inner and "LeftOuter" not in inner


def test_columns_and_filters_reach_the_scan(spark, tiny):
    s = warehouse_source(spark, tiny)
    df = run(s, '{ Order { key @output totalprice ?(> $p) customer { name @output } } }', {"p": 1000.5})
    p = api.explain(df)
    assert "GreaterThan(o_totalprice,1000.5)" in p
    scans = [x for x in p.split("\n") if x.startswith("ReadSchema")]
    assert any(x.count(":") == 4 and "o_custkey" in x for x in scans) and not any("o_orderdate" in x or "c_acctbal" in x for x in scans)


def test_time_ranges_reach_the_scan(spark, tiny):
    s = warehouse_source(spark, tiny)
    for text in ('{ Order { key @output orderdate ?(>= $a) ?(< $b) } }', '{ Customer { key @output order { orderdate ?(>= $a) ?(< $b) } } }'):
        p = api.explain(run(s, text, {"a": 788918400000000, "b": 796694400000000}))
        assert "GreaterThanOrEqual(o_orderdate,1995-01-01T00:00)" in p and "LessThanOrEqual(o_orderdate,1995-04-01T00:00)" in p
    one = run(s, "{ Order { orderdate @output } }").first().orderdate
    assert "EqualTo(o_orderdate" in api.explain(run(s, "{ Order { key @output orderdate ?(= $x) } }", {"x": one}))
    assert run(s, "{ Order { key @output orderdate ?(= $x) } }", {"x": one}).count() > 0
    assert run(s, "{ Order { key @output orderdate ?(< $x) } }", {"x": (1 << 63) - 1}).count() == run(s, "{ Order { key @output } }").count()
    assert "GreaterThan" not in api.explain(run(s, '{ Customer { key @output order @optional { orderdate ?(>= $a) } } }', {"a": 1}))


def test_recursion_joins_once_a_hop(spark, tiny):
    s = warehouse_source(spark, tiny)
    for depth in (1, 3, 6):
        p = plan(run(s, f"{{ Message {{ turn @output next @recurse(depth: {depth}) {{ to: turn @output }} }} }}"))
        assert p.count("Join ") == depth and p.count("FileScan") == depth + 1


def test_trace_counts_rows(spark, tiny):
    s = warehouse_source(spark, tiny)
    steps = api.trace(run(s, '{ Region { name ?(= $r) nation { n: name @output } } }', {"r": "ASIA"}))
    rows = [n for _, _, n in steps if n is not None]
    assert steps[0][0] == 0 and 5 in rows and 1 in rows and max(d for d, _, _ in steps) >= 3


def test_filters_stay_above_optional_edges(spark, tiny):
    s = warehouse_source(spark, tiny)
    q = '{ Customer { key @output order(minPrice: 400000.0) @optional { totalprice ?(< $p) } } }'
    everyone = run(s, "{ Customer { key @output } }").count()
    with_order = run(s, '{ Customer { key @output order(minPrice: 400000.0) @fold &count ?(> $n) } }', {"n": 0}).count()
    assert 0 < with_order < everyone and run(s, q, {"p": 0.5}).count() == everyone - with_order


# sources and sinks


def test_sources_hold_what_they_promise(spark, tiny):
    assert check_source(warehouse_source(spark, tiny)) == []
    numbers = numbers_source(spark)
    assert check_source(numbers) == []
    assert check_source(introspection_source(spark, numbers.schema)) == []
    broken = Source(spark, numbers.schema).vertex("Number", spark.range(1).select(F.col("id").cast("string").alias("value")))
    found = {e.code for e in check_source(broken)}
    assert {"PropertyDoesNotResolve", "UnknownEdge", "UnknownStartingEdge", "UnknownVertexType"} <= found
    with pytest.raises(SourceError):
        run(broken, "{ One { value @output } }")


def test_introspection(spark, tiny):
    schema = warehouse_source(spark, tiny).schema
    s = introspection_source(spark, schema)
    got = run(s, '{ Entrypoint { name @output to_many @output parameter @fold { p: name @output kinds: type @output } target { target: name @output } } }').collect()
    assert {r.name: (r.to_many, r.p, r.kinds, r.target) for r in got}["CustomerByKey"] == (False, ["key"], ["Int!"], "Customer")
    docs = run(s, '{ VertexType { name @output docs ?(is_not_null) @output implementer @fold { below: name @output } } }').collect()
    assert [(r.name, r.docs, sorted(r.below)) for r in docs] == [("Party", "Whoever buys or sells.", ["Customer", "Supplier"])]
    assert run(s, "{ Schema { vertex_type { name @output } } }").count() == len(schema.vertex_types)


def test_sinks(spark):
    s = numbers_source(spark)
    df = run(s, "{ Number(max: 21, min: 20) { value @output name @output } }")

    @dataclass
    class Row:
        name: str | None
        value: int

    assert sorted(api.as_structs(df, Row), key=lambda r: r.value) == [Row("twenty", 20), Row(None, 21)]
    assert sorted(r["value"] for r in api.rows(df)) == [20, 21]
    assert sorted(r.json for r in api.as_json(df).collect()) == ['{"name":"twenty","value":20}', '{"name":null,"value":21}']
    with pytest.raises(ValueError):
        list(api.as_structs(df.select("value"), Row))
    assert {k: str(t) for k, t in api.output_types(s, shorthand('{ One { value @output predecessor @optional { multiple(max: 2) @fold &count @output(name: "n") { m: value @output } } } }')).items()} == {"value": "Int", "n": "Int", "m": "[Int]"}


def test_partitioning_does_not_matter(spark, tiny):
    """The same rows, lists included, however the tables are split."""
    text = "{ Region { name @output nation @fold { nations: name @output customer @fold { c: name @output } } } }"
    s = warehouse_source(spark, tiny)
    want = sorted(run(s, text).collect())
    for n in (1, 7):
        for t in s.tables.values():
            t.rows = t.raw.repartition(n)
        assert sorted(run(s, text).collect()) == want


def test_recursion_expands_only_what_has_the_edge(spark):
    """Places lead to things; only some things are places, and only those lead on."""
    schema = Schema("""
        schema { query: Q }
        type Q { Place: [Place!] }
        type Rock implements Thing { id: Int! }
        type Town implements Place & Thing { id: Int!  road: [Thing!] }
        interface Place implements Thing { id: Int!  road: [Thing!] }
        interface Thing { id: Int! }
    """)
    roads = spark.createDataFrame([(1, 2), (2, 3), (2, 10), (3, 1), (10, 1)], "a long, b long")
    things = spark.createDataFrame([(1, "Town"), (2, "Town"), (3, "Town"), (10, "Rock")], "id long, kind string")
    s = Source(spark, schema).vertex("Thing", things, typename=lambda get: get("kind"), order=["id"]).root("Place")
    s.edge_table("Place", "road", lambda spark: roads.join(things, roads["b"] == things["id"]).select("a", "id", "kind"), [("id", "a")])
    got = run(s, "{ Place { start: id @output road @recurse(depth: 3) { id @output kind: __typename @output } } }").collect()
    assert sorted((r.id, r.kind) for r in got if r.start == 1) == [(1, "Town"), (1, "Town"), (2, "Town"), (3, "Town"), (10, "Rock")]
    assert {r.start for r in got} == {1, 2, 3}


def test_skeletons_and_inferred_schemas(spark, tiny):
    schema = warehouse_source(spark, tiny).schema
    text = sdl.skeleton(schema)
    compile(text, "skeleton", "exec")
    assert "s.root('TopOrders', lambda raw, max: raw)" in text and "s.edge_keys('Party', 'nation'" in text
    made = Schema(sdl.infer_from_frames(Nation=spark.read.parquet(f"{tiny}/nation.parquet"), Vec=spark.read.parquet(f"{tiny}/embeddings.parquet")))
    assert str(made.field("Vec", "embedding").type) == "[Float]" and str(made.field("Nation", "n_name").type) == "String"
    query = '{ Shop(city: "X") { name @output item @fold { ... on Book { title @output } } } }'
    from vertexloom.plans.frontend import compile_query

    assert str(compile_query(Schema(sdl.infer_from_query(shorthand(query))), shorthand(query)).output_types["title"]) == "[String]!"
    deep = '{ Node(id: 1) { next @recurse(depth: 3) { id @output ?(> $p) } } }'
    assert compile_query(Schema(sdl.infer_from_query(shorthand(deep))), shorthand(deep))


def test_weather(spark, tmp_path):
    blank = dict.fromkeys(range(len(readers.METAR_COLUMNS)), "")
    at = {c: i for i, c in enumerate(readers.METAR_COLUMNS)}

    def line(**given):
        row = blank | {at[k]: v for k, v in given.items()}
        return ",".join(row[i] for i in range(len(row)))

    lines = [
        ",".join(readers._HEADER),
        line(raw_text="KBOS 251154Z 31008KT 10SM FEW050 03/M04", station_id="KBOS", observation_time="2024-01-25T11:54:00Z", wind_dir_degrees="310", wind_speed_kt="8", temp_c="2.8", sky_cover_1="FEW", cloud_base_ft_agl_1="5000", sky_cover_2="OVC"),
        line(raw_text="KBOS 251054Z VRB03KT 1 1/2SM OVC010 03/M04", station_id="KBOS", observation_time="2024-01-25T10:54:00Z", wind_dir_degrees="VRB"),
        line(raw_text="EGLL 251150Z AUTO 24010KT 9999 BKN020", station_id="EGLL", observation_time="2024-01-25T11:50:00Z"),
        line(raw_text="XXXX 251150Z AUTO NIL", station_id="XXXX", observation_time="2024-01-25T11:50:00Z"),
    ]
    path = tmp_path / "metar.csv"
    path.write_text("\n".join(lines) + "\n")
    s = readers.weather_source(spark, str(path))
    assert check_source(s) == []
    got = run(s, "{ MetarReport { station_id @output wind_direction @output wind_direction_variable @output visibility_statute_mi @output visibility_unlimited @output cloud_cover @fold { base_altitude @output sky_cover @output } } }").collect()
    by = {(r.station_id, r.wind_direction): r for r in got}
    assert len(got) == 3 and by["KBOS", 310].sky_cover == ["FEW", "OVC"] and by["KBOS", 310].base_altitude == [5000, None] and by["KBOS", 310].visibility_statute_mi == 10.0
    assert by["KBOS", None].wind_direction_variable is True and by["KBOS", None].visibility_statute_mi == 1.5 and by["EGLL", None].visibility_unlimited is True
    latest = run(s, '{ LatestMetarReportForAirport(airport_code: "KBOS") { temperature @output } }').collect()
    assert [r.temperature for r in latest] == [2.8]
    path.write_text("a,b\n1,2\n")
    with pytest.raises(SourceError):
        readers.weather_source(spark, str(path))


def test_feeds(spark, tmp_path):
    atom = tmp_path / "a.xml"
    atom.write_text('<feed xml:lang="en"><id>f1</id><title type="text">News</title><link href="http://x/" rel="self"/><entry><id>e1</id><title>One</title><summary>S</summary><content type="html">Hé</content><link href="http://x/1"/></entry><entry><id>e2</id><title>Two</title></entry></feed>')
    rss = tmp_path / "b.xml"
    rss.write_text("<rss><channel><title>Blog</title><link>http://b/</link><ttl>60</ttl><image><url>http://b/i.png</url></image><item><guid>g1</guid><title>Post</title><description>D</description></item></channel></rss>")
    s = readers.feeds_source(spark, str(atom), str(rss))
    assert check_source(s) == []
    got = run(s, "{ Feed { feed_type @output id @output ttl @output title { content @output } entries @fold { entry: id @output } } }").collect()
    assert sorted((r.feed_type, r.id, r.ttl, r.content, r.entry) for r in got) == [("Atom", "f1", None, "News", ["e1", "e2"]), ("RSS", "http://b/", 60, "Blog", ["g1"])]
    inner = run(s, "{ Feed { entries { id @output summary @optional { s: content @output } content @optional { body @output length @output } links @fold { href @output } } } }").collect()
    assert {r.id: (r.s, r.body, r.length, r.href) for r in inner} == {"e1": ("S", "Hé", 3, ["http://x/1"]), "e2": (None, None, None, []), "g1": ("D", None, None, [])}
    assert [r.uri for r in run(s, "{ Feed { logo { uri @output } } }").collect()] == ["http://b/i.png"]


def test_news(spark):
    items = spark.createDataFrame(
        [(1, "story", 10, "ann", "T1", None, "http://a", 5, 2, [2, 3], None, 2, None, None), (2, "comment", 11, "bob", None, "hi", None, None, None, [4], 1, None, None, None), (3, "comment", 12, "ann", None, "yo", None, None, None, None, 1, None, None, None), (4, "comment", 13, "ann", None, "re", None, None, None, None, 2, None, None, None), (5, "job", 9, None, "J", None, None, 1, None, None, None, 1, None, None), (6, "story", 1, "bob", "gone", None, None, 1, 0, None, None, 3, True, None)],
        readers._ITEM_COLUMNS,
    )
    users = spark.createDataFrame([("ann", 7, None, 1, None, [1, 3, 4]), ("bob", 1, "b", 2, None, [2, 6])], readers._USER_COLUMNS)
    s = readers.news_source(spark, items, users)
    assert check_source(s) == []
    assert sorted((r.id, r.t) for r in run(s, "{ FrontPage { id @output t: __typename @output } }").collect()) == [(1, "Story"), (5, "Job")]
    assert [r.id for r in run(s, "{ Top(max: 1) { id @output } }").collect()] == [5]
    story = run(s, "{ Latest(max: 5) { id @output commentsCount @output byUser { karma @output } comment { c: id @output reply @recurse(depth: 2) { r: id @output } } } }").collect()
    assert sorted((r.c, r.r) for r in story) == [(2, 2), (2, 4), (3, 3)] and {r.karma for r in story} == {7}
    sent = run(s, '{ User(name: "ann") { submitted { ... on Comment { text @output parent { up: id @output __typename @output } } } } }').collect()
    assert sorted((r.text, r.up, r.__typename) if False else (r.text, r.up, r["__typename"]) for r in sent) == [("re", 2, "Comment"), ("yo", 1, "Story")]


def test_files(spark, tmp_path):
    for name, body in {"a.txt": "one\n two \n", "sub/b.bin": "x", "sub/deep/c.md": "# hi", ".git/config": "no", "target/x.txt": "no"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    (tmp_path / "sub/none").mkdir()
    s = readers.files_source(spark, str(tmp_path))
    assert check_source(s) == []
    got = run(s, "{ OriginDirectory { out_Directory_Subdirectory @recurse(depth: 3) { path @output out_Directory_ContainsFile @fold { files: name @output size @output } } } }").collect()
    assert {r.path: r.files for r in got} == {"": ["a.txt"], "sub": ["b.bin"], "sub/deep": ["c.md"], "sub/none": []}
    lines = run(s, "{ OriginDirectory { out_Directory_ContainsFile { ... on TextFile { out_TextFile_HasLine { line_number @output trimmed_contents @output } } } } }").collect()
    assert sorted((r.line_number, r.trimmed_contents) for r in lines) == [(1, "one"), (2, "two")]


def test_tables_of_parts_are_files(spark, tmp_path):
    for name in ("a.parquet", "b.parquet/part-0.parquet", "b.parquet/part-1.parquet", "c.parquet/lang=en/part-0.parquet", "sub/d.parquet/part-0.parquet", "e.txt/part-0.parquet"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("12345")
    s = readers.files_source(spark, str(tmp_path), whole=("parquet",))
    assert check_source(s) == []
    got = run(s, "{ OriginDirectory { out_Directory_Subdirectory @recurse(depth: 3) { path @output out_Directory_ContainsFile @fold { files: name @output sizes: size @output } } } }").collect()
    assert {r.path: (r.files, r.sizes) for r in got} == {"": (["a.parquet", "b.parquet", "c.parquet"], [5, 10, 5]), "sub": (["d.parquet"], [5]), "e.txt": (["part-0.parquet"], [5])}
    assert sorted(QUERIES["folder_files"](spark, str(tmp_path)).collect()) == [("BinaryFile", n) for n in "abc"]


def test_paged_service(spark):
    import http.server
    import json
    import threading

    class Pages(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            n = int(self.path.rsplit("=", 1)[1])
            self.send_response(200 if n < 3 else 500)
            self.end_headers()
            self.wfile.write(json.dumps({"rows": [{"id": 10 * n + i} for i in range(2)]}).encode())

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    from vertexloom.sources.paged import read_pages

    df = read_pages(spark, f"http://127.0.0.1:{server.server_port}/x?page={{page}}", "id bigint", pages=3, field="rows", lenient=True)
    assert sorted(r.id for r in df.collect()) == [10, 11, 20, 21]
    base = f"http://127.0.0.1:{server.server_port}/x?page="
    every = read_pages(spark, base + "{page}", "id bigint", field="rows", lenient=True)
    assert sorted(r.id for r in every.collect()) == [10, 11, 20, 21]
    with pytest.raises(Exception, match="500"):
        read_pages(spark, base + "{page}", "id bigint", field="rows").collect()
    from vertexloom.sources.paged import read_each

    keys = spark.createDataFrame([(1,), (2,), (5,), (2,), (None,)], "k long")
    got = read_each(keys, base + "{key}", "rows array<struct<id:bigint>>").collect()
    assert sorted((r.key, [x.id for x in r.rows]) for r in got) == [(1, [10, 11]), (2, [20, 21])]
    server.shutdown()


def test_streams(spark, tiny, tmp_path):
    from vertexloom.streaming.live import each_batch, stream_query

    s = warehouse_source(spark, tiny)
    raw = s.tables["Order"].raw
    raw.repartition(3).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(raw.schema).parquet(str(tmp_path / "in"))
    text = '{ Order { key @output totalprice ?(> $p) customer @optional { name @output } } }'
    out = stream_query(s, "Order", live, shorthand(text), {"p": 100000.0})
    q = out.writeStream.format("memory").queryName("live_orders").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(spark.table("live_orders").collect()) == sorted(run(s, text, {"p": 100000.0}).collect())
    seen = []
    folded = '{ Order { key @output lineitem @fold &count @output(name: "n") } }'
    with pytest.raises(ValueError):
        stream_query(s, "Order", live, shorthand(folded))
    q = live.writeStream.foreachBatch(each_batch(s, "Order", shorthand(folded), None, lambda df, _: seen.extend(df.collect()))).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(seen) == sorted(run(s, folded).collect())
