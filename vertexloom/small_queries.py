"""Queries over sources of their own, over what is refused and over what sources are told, with the rows that must come out."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.api import as_structs, execute_query, explain, output_types, prepare, trace
from vertexloom.errors import ErrorGroup, LoomError
from vertexloom.schema import Schema
from vertexloom.sources import numbers, readers
from vertexloom.sources.crates import crates_source
from vertexloom.sources.numbers import numbers_source
from vertexloom.sources.spec import Source, check_source
from vertexloom.sources.warehouse import warehouse_source
from vertexloom.syntax import shorthand

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str]] = {}


def _rows(columns: str, *rows: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(f'({r})' for r in rows)}) t({columns})"


def _add(name: str, sql: str) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = (f, sql)
        return f

    return put


# what is refused

REFUSED = {
    "refused_outputs": {
        "{ Region { name @output @output } }": "MultipleOutputsWithSameName",
        "{ Region { name @output nation { name @output } } }": "MultipleOutputsWithSameName",
        '{ Region { name @output nation @fold &count @output(name: "name") } }': "MultipleOutputsWithSameName",
        "{ Region { name } }": "OtherError",
    },
    "refused_coercions": {
        "{ Region { ... on Nation { name @output } } }": "CannotCoerceNonInterfaceType",
        "{ Party { ... on Nothing { name @output } } }": "NonExistentType",
        "{ Party { ... on Region { name @output } } }": "CannotCoerceToUnrelatedType",
        "{ Party { ... on Customer { ... on Customer { name @output } } } }": "NestedTypeCoercion",
        "{ Party { ... on Customer { name @output } key @output } }": "TypeCoercionWithSiblingFields",
        "{ Party { ... on Customer @optional { name @output } } }": "UnsupportedDirectivePosition",
        "{ Party { ... { name @output } } }": "accepted",
    },
    "refused_recursions": {
        "{ Region { nation @recurse(depth: 2) { name @output } } }": "RecursingNonRecursableEdge",
        "{ Message { next @recurse(depth: 0) { turn @output } } }": "InappropriateTypeForDirectiveArgument",
        "{ Message { next @fold @recurse(depth: 2) { turn @output } } }": "UnsupportedDirectivePosition",
        "{ Message { next @recurse(depth: 2) @fold { turn @output } } }": "UnsupportedDirectiveOnFoldedEdge",
        "{ Message { next @recurse(depth: 1) @recurse(depth: 2) { turn @output } } }": "UnsupportedDuplicatedDirective",
    },
    "refused_folds": {
        '{ Region { nation @fold &count &count @output { name } } }': "OtherError",
        "{ Region { nation &count @fold } }": "UnsupportedDirectivePosition",
        "{ Region { nation @fold @output } }": "UnsupportedDirectivePosition",
        "{ Region { nation @fold @fold { name @output } } }": "UnsupportedDuplicatedDirective",
        "{ Region { nation @optional @fold { name @output } } }": "UnsupportedDirectiveOnFoldedEdge",
        '{ Region { nation @fold @transform(op: "sum") } }': "UnsupportedTransformOperator",
    },
    "refused_tags": {
        "{ Region { name @tag key @output } }": "UnusedTags",
        "{ Region { key @output name ?(= %no) } }": "UndefinedTagInFilter",
        '{ Region { key @output ?(= %t) nation { key @tag(name: "t") } } }': "TagUsedBeforeDefinition",
        '{ Region { nation @fold { key @tag(name: "t") name @output } key ?(= %t) } }': "TagUsedOutsideItsFoldedSubquery",
    },
}


def _code(schema: Schema, text: str) -> str:
    from vertexloom.plans.frontend import compile_query

    try:
        compile_query(schema, shorthand(text))
    except ErrorGroup as e:
        return ",".join(e.codes)
    except LoomError as e:
        return e.code
    return "accepted"


def _refused(texts: dict[str, str]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        schema = warehouse_source(spark, sf_dir).schema
        return spark.createDataFrame([(i, _code(schema, t)) for i, t in enumerate(texts)], "place int, code string")

    return run


# sources of their own


@_add("empty_source", "SELECT CAST(NULL AS BIGINT) AS n, CAST(NULL AS VARCHAR[]) AS words, CAST(NULL AS BIGINT) AS count WHERE FALSE")
def _empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices that there are none of: types hold, rows don't come."""
    s = Source(spark, Schema("schema { query: Q } type Q { Thing: [Thing] } type Thing { n: Int  words: [String]  other: [Thing] }"))
    s.vertex("Thing", spark.createDataFrame([], "n long, words array<string>")).root("Thing").edge_keys("Thing", "other", [("n", "n")])
    return execute_query(s, shorthand('{ Thing { n @output words @output ?(contains $w) other @fold &count @output(name: "count") } }'), {"w": "x"})


def _listed(spark: SparkSession) -> Source:
    s = Source(spark, Schema("schema { query: Q } type Q { Thing: [Thing] } type Thing { id: Int!  words: [String]  word: String }"))
    rows = [(1, ["a", "b"], "a"), (2, None, "a"), (3, [None, "b"], None), (4, [], "a"), (5, [None], "b"), (6, ["b"], "b")]
    return s.vertex("Thing", spark.createDataFrame(rows, "id long, words array<string>, word string"), order=["id"]).root("Thing")


@_add("contains_null", _rows("id", "3::BIGINT", "5"))
def _contains_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return execute_query(_listed(spark), shorthand("{ Thing { id @output words ?(contains $w) } }"), {"w": None})


@_add("not_contains_tag", _rows("id", "2::BIGINT", "4", "5"))
def _not_contains_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return execute_query(_listed(spark), shorthand('{ Thing { id @output word @tag(name: "w") words ?(not_contains %w) } }'))


@_add("recurse_coercion", _rows("start, id, kind", *[f"{a}::BIGINT, {b}::BIGINT, '{'Rock' if b == 10 else 'Town'}'" for a, ids in {1: (1, 2, 3, 10, 1), 2: (2, 3, 10, 1, 2), 3: (3, 1, 2, 3, 10)}.items() for b in ids]))
def _coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places lead to things; only those things that are places lead on."""
    schema = Schema("""schema { query: Q } type Q { Place: [Place!] } interface Thing { id: Int! } interface Place implements Thing { id: Int!  road: [Thing!] }
        type Rock implements Thing { id: Int! } type Town implements Place & Thing { id: Int!  road: [Thing!] }""")
    roads = spark.createDataFrame([(1, 2), (2, 3), (2, 10), (3, 1), (10, 1)], "a long, b long")
    things = spark.createDataFrame([(1, "Town"), (2, "Town"), (3, "Town"), (10, "Rock")], "id long, kind string")
    s = Source(spark, schema).vertex("Thing", things, typename=lambda get: get("kind"), order=["id"]).root("Place")
    s.edge_table("Place", "road", lambda spark: roads.join(things, roads["b"] == things["id"]).select("a", "id", "kind"), [("id", "a")])
    return execute_query(s, "{ Place { start: id @output road @recurse(depth: 3) { id @output kind: __typename @output } } }")


@_add("fold_recurse_branching", "SELECT CAST(4 AS BIGINT) AS value, [4, 4, 4, 8, 8, 8, 16, 8, 8, 8, 16, 16, 16, 32]::BIGINT[] AS along")
def _branching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return execute_query(numbers_source(spark), "{ Four { value @output multiple(max: 2) @fold { multiple(max: 2) @recurse(depth: 2) { along: value @output } } } }")


@_add("joined_sources", "SELECT r_name AS region, ['zero', 'one', 'two', 'three', 'four'][r_regionkey + 1] AS name, CAST(r_regionkey + 1 AS BIGINT) AS next FROM region")
def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of the warehouse, and the numbers that their keys are."""
    house = warehouse_source(spark, sf_dir)
    whole = numbers.SDL.replace("type RootSchemaQuery {", "type RootSchemaQuery { Region: [Region!]!") + "type Region { key: Int!  name: String!  number: Number! }"
    s = numbers_source(spark).joined_with(Schema(whole), house)
    s.edge_array("Region", "number", lambda get: F.array(F.struct(get("key").cast("long").alias("value"))), ["key"])
    return execute_query(s, "{ Region { region: name @output number { name @output successor { next: value @output } } } }")


_METARS = [
    dict(raw_text="KBOS 251154Z 31008KT 10SM FEW050 03/M04", station_id="KBOS", observation_time="2024-01-25T11:54:00Z", wind_dir_degrees="310", sky_cover_1="FEW", cloud_base_ft_agl_1="5000", sky_cover_2="OVC"),
    dict(raw_text="KBOS 251054Z VRB03KT 1 1/2SM OVC010 03/M04", station_id="KBOS", observation_time="2024-01-25T10:54:00Z", wind_dir_degrees="VRB"),
    dict(raw_text="EGLL 251150Z AUTO 24010KT 9999 BKN020", station_id="EGLL", observation_time="2024-01-25T11:50:00Z"),
    dict(raw_text="XXXX 251150Z AUTO NIL", station_id="XXXX", observation_time="2024-01-25T11:50:00Z"),
]


@_add("weather_reports", _rows("station_id, wind_direction, variable, miles, unlimited, bases, covers", "'KBOS', 310::BIGINT, FALSE, 10.0::DOUBLE, FALSE, [5000, NULL]::BIGINT[], ['FEW', 'OVC']::VARCHAR[]", "'KBOS', NULL, TRUE, 1.5, FALSE, []::BIGINT[], []::VARCHAR[]", "'EGLL', NULL, NULL, NULL, TRUE, []::BIGINT[], []::VARCHAR[]"))
def _weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = [[m.get(c) for c in readers.METAR_COLUMNS] for m in _METARS]
    s = readers.weather_source(spark, spark.createDataFrame(lines, ", ".join(f"{c} string" for c in readers.METAR_COLUMNS)))
    text = "{ MetarReport { station_id @output wind_direction @output variable: wind_direction_variable @output miles: visibility_statute_mi @output unlimited: visibility_unlimited @output cloud_cover @fold { bases: base_altitude @output covers: sky_cover @output } } }"
    return execute_query(s, text)


_FEEDS = [
    ("a", '<feed><id>f1</id><title type="text">News</title><link href="http://x/" rel="self"/><entry><id>e1</id><title>One</title><content type="html">Hé</content></entry><entry><id>e2</id><title>Two</title></entry></feed>'),
    ("b", "<rss><channel><title>Blog</title><link>http://b/</link><ttl>60</ttl><item><guid>g1</guid><title>Post</title><description>D</description></item></channel></rss>"),
]


@_add("feed_entries", _rows("feed_type, id, ttl, title, entries, titles", "'Atom', 'f1', NULL::BIGINT, 'News', ['e1', 'e2'], [['One'], ['Two']]", "'RSS', 'http://b/', 60, 'Blog', ['g1'], [['Post']]"))
def _feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = readers.feeds_source(spark, documents=spark.createDataFrame(_FEEDS, "url string, xml string"))
    return execute_query(s, "{ Feed { feed_type @output id @output ttl @output title { title: content @output } entries @fold { entries: id @output title @fold { titles: content @output } } } }")


@_add("news_threads", _rows("id, author, comment, reply", "1::BIGINT, 'ann', 2::BIGINT, 2::BIGINT", "1, 'ann', 2, 4", "1, 'ann', 3, 3"))
def _news(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [(1, "story", 10, "ann", None), (2, "comment", 11, "bob", 1), (3, "comment", 12, "ann", 1), (4, "comment", 13, "ann", 2), (5, "job", 9, None, None)]
    items = spark.createDataFrame([(i, k, t, by, None, None, None, None, None, None, up, None, None, None) for i, k, t, by, up in kinds], readers._ITEM_COLUMNS)
    users = spark.createDataFrame([("ann", 7, None, 1, None, [1, 3, 4]), ("bob", 1, "b", 2, None, [2])], readers._USER_COLUMNS)
    return execute_query(readers.news_source(spark, items, users), "{ Latest(max: 5) { id @output byUser { author: id @output } comment { comment: id @output reply @recurse(depth: 2) { reply: id @output } } } }")


@_add("library_items", _rows("module, names, kinds", "'lib', ['Point', 'go'], ['Struct', 'Function']"))
def _library(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = {"0": {"module": {"items": ["1", "2"]}}, "1": {"struct": {}}, "2": {"function": {}}, "3": {"struct_field": "f"}}
    index = {k: {"name": n, "docs": None, "visibility": "public", "inner": inner[k]} for k, n in zip("0123", ("lib", "Point", "go", "x"))}
    files = spark.createDataFrame([("lib.json", json.dumps({"root": "0", "crate_version": "1.0", "index": index}))], "file string, value string")
    return execute_query(crates_source(spark, files), "{ Crate { item { ... on Module { module: name @output item @fold { names: name @output kinds: __typename @output } } } } }")


_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@_add("folder_files", _rows("name, kind", *[f"'{t}', 'BinaryFile'" for t in _TABLES]))
def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of the folder itself, those kept as a folder of parts too."""
    text = "{ OriginDirectory { out_Directory_ContainsFile { name @output kind: __typename @output extension ?(= $e) } } }"
    found = execute_query(readers.files_source(spark, sf_dir, whole=("parquet",)), shorthand(text), {"e": "parquet"})
    return found.withColumn("name", F.regexp_replace("name", "[.]parquet$", ""))


# sinks and what is known of a query


@dataclass
class Place:
    name: str
    nations: list[str]


@_add("typed_structs", "SELECT r_name AS name, list(n_name ORDER BY n_nationkey) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def _structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as instances of a class, and back."""
    df = execute_query(warehouse_source(spark, sf_dir), "{ Region { name @output nation @fold { nations: name @output } } }")
    return spark.createDataFrame([(p.name, p.nations) for p in as_structs(df, Place)], "name string, nations array<string>")


@_add("output_types", _rows("name, type", "'n', 'Int!'", "'premium', 'Float'", "'price', '[Float!]!'", "'region', 'String'"))
def _types(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = '{ Customer { premium @output order @fold &count @output(name: "n") { price: totalprice @output } nation @optional { region { region: name @output } } } }'
    return spark.createDataFrame([(n, str(t)) for n, t in output_types(warehouse_source(spark, sf_dir), shorthand(text)).items()], "name string, type string")


@_add("scanned_columns", _rows("name", "'c_custkey'", "'c_name'", "'o_custkey'", "'o_totalprice'"))
def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that the scans of a query read."""
    df = execute_query(warehouse_source(spark, sf_dir), "{ Customer { name @output order { totalprice @output } } }")
    read = [x.split("<")[1].rstrip(">").split(",") for x in explain(df).split("\n") if x.startswith("ReadSchema")]
    return spark.createDataFrame([(c.split(":")[0],) for columns in read for c in columns], "name string")


@_add("traced_rows", "SELECT count(*) AS rows FROM region UNION ALL SELECT count(*) FROM nation")
def _traced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each scan of a query put out when it ran."""
    steps = trace(execute_query(warehouse_source(spark, sf_dir), "{ Region { name @output nation { n: name @output } } }"))
    return spark.createDataFrame([(n,) for _, name, n in steps if name.startswith("Scan")], "rows long")


@_add("early_stop", "SELECT CAST(3 AS BIGINT) AS rows")
def _stopped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No more rows are worked out than are taken."""
    return execute_query(warehouse_source(spark, sf_dir), "{ LineItem { quantity @output } }").limit(3).agg(F.count("*").alias("rows"))


@_add("prepared_twice", "SELECT CAST(count(*) FILTER (WHERE o_totalprice > 100000) AS BIGINT) AS a, CAST(count(*) FILTER (WHERE o_totalprice > 200000) AS BIGINT) AS b FROM orders")
def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One checked query, run with two sets of arguments."""
    s = warehouse_source(spark, sf_dir)
    checked = prepare(s, shorthand("{ Order { key @output totalprice ?(> $low) } }"))
    a, b = (execute_query(s, checked, {"low": x}).agg(F.count("*").alias(n)) for n, x in (("a", 100_000.0), ("b", 200_000.0)))
    return a.join(b, F.lit(True))


@_add("conformance", _rows("source, code", "'broken', 'PropertyDoesNotResolve'", "'broken', 'UnknownEdge'", "'broken', 'UnknownStartingEdge'"))
def _conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = Schema("schema { query: Q } type Q { Thing: [Thing!] Other: Thing } type Thing { id: Int!  name: String  size: Int  next: Thing }")
    broken = Source(spark, schema).vertex("Thing", spark.createDataFrame([], "id string, name string")).root("Thing")
    found = {(n, e.code) for n, s in (("broken", broken), ("warehouse", warehouse_source(spark, sf_dir))) for e in check_source(s)}
    return spark.createDataFrame(sorted(found), "source string, code string")


# what sources are told


def _told(spark: SparkSession, text: str, arguments: dict) -> tuple[list, list]:
    """The hints that a starting point and an edge function get, and the keys that the latter is asked for."""
    schema = Schema("schema { query: Q } type Q { Thing: [Any!] } interface Any { id: Int!  size: Int } type Thing implements Any { id: Int!  size: Int  name: String!  tag(kind: Int): [Tag!] } type Tag { thing: Int!  word: String! }")
    things = spark.createDataFrame([(1, 5, "a"), (2, None, "b"), (3, 9, "c")], "id long, size long, name string")
    words = spark.createDataFrame([(1, "x"), (1, "y"), (3, "x")], "thing long, word string")
    hints, asked = [], []

    def start(raw, hints_=hints, *, hints):
        hints_.append(hints)
        return raw

    def tags(spark, kind, starts, hints_=hints, *, hints):
        hints_.append(hints)
        asked.append(starts)
        return words

    s = Source(spark, schema).vertex("Any", things, typename=lambda get: F.lit("Thing"), order=["id"]).vertex("Tag", words, order=["thing", "word"]).root("Thing", start)
    s.edge_table("Thing", "tag", tags, [("id", "thing")])
    execute_query(s, shorthand(text), arguments)
    return hints, asked


@_add("hints_of_vertices", _rows("place, fact", "0, 'type Thing from Any'", "0, 'needs id'", "0, 'needs size'", "0, 'size > 4'", "0, 'size <= 8'", "1, 'needs word'", "1, 'word in q, x'"))
def _vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "{ Thing { ... on Thing { id @output size ?(> $a) ?(<= $b) tag { word @output ?(one_of $w) } } } }"
    hints, _ = _told(spark, text, {"a": 4, "b": 8, "w": ["x", "q"]})
    facts = []
    for i, h in enumerate(hints):
        facts += [(i, f"type {h.type_name} from {h.coerced_from}")] if h.coerced_from else []
        facts += [(i, f"needs {n}") for n in h.required if n != "__typename"]
        for name, c in h.candidates.items():
            facts += [(i, f"{name} in {', '.join(sorted(c.values))}")] if c.values else []
            facts += [(i, f"{name} {'>=' if c.low[1] else '>'} {c.low[0]}")] if c.low else []
            facts += [(i, f"{name} {'<=' if c.high[1] else '<'} {c.high[0]}")] if c.high else []
    return spark.createDataFrame(facts, "place int, fact string")


@_add("hints_of_edges", _rows("name, kind, mandatory, fold, optional, word", "'tag', 1::BIGINT, TRUE, TRUE, FALSE, NULL", "'tag', 2, TRUE, FALSE, FALSE, 'x'", "'tag', NULL, FALSE, FALSE, TRUE, NULL"))
def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = """{ Thing { ... on Thing { id @output tag(kind: 1) @fold &count ?(>= $n) { words: word @output }
        tag(kind: 2) { w: word @output ?(= $x) } tag @optional { word ?(= $x) } } } }"""
    hints, _ = _told(spark, text, {"n": 1, "x": "x"})
    single = lambda e: (c.single or (None,))[0] if (c := e.far.candidates.get("word")) else None
    return spark.createDataFrame([(e.name, e.parameters.get("kind"), e.mandatory, e.fold, e.optional, single(e)) for e in hints[0].edges], "name string, kind long, mandatory boolean, fold boolean, optional boolean, word string")


@_add("hints_of_tags", _rows("id, tag0, compared", "1::BIGINT, 'a', 'word >='", "3, 'c', 'word >='"))
def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys that an edge is asked for, each with the tagged value that its vertices are compared with."""
    hints, asked = _told(spark, '{ Thing { ... on Thing { id @output size ?(is_not_null) name @tag(name: "n") tag { word @output ?(>= %n) } } } }', {})
    (tag,) = hints[1].tags
    return asked[0].withColumn("compared", F.lit(f"{tag.property} {tag.op}"))


for _name, _texts in REFUSED.items():
    QUERIES[_name] = (_refused(_texts), _rows("place, code", *[f"{i}, '{c}'" for i, c in enumerate(_texts.values())]))
