"""Named queries over the warehouse graph, an operator each, with the SQL that says the same."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vertexloom import small_queries as small
from vertexloom.api import as_json, execute_query
from vertexloom.sources.introspection import introspection_source
from vertexloom.sources.numbers import numbers_source
from vertexloom.sources.warehouse import SDL, warehouse_source
from vertexloom.syntax import shorthand

#: Query text, arguments and SQL by name; texts are given in the shorthand of ``syntax.shorthand``.
CASES: dict[str, tuple[str, dict, str]] = {}


def _case(name: str, text: str, sql: str, **arguments) -> None:
    CASES[name] = (shorthand(text), arguments, sql)


_case(
    "flagship",
    """{ Region { name ?(= $region)
         nation { nation: name @output
           customer @fold &count @output(name: "customers") { customer_names: name @output } } } }""",
    """SELECT n_name AS nation, count(c_custkey) AS customers,
         coalesce(list(c_name ORDER BY c_custkey, c_name) FILTER (WHERE c_custkey IS NOT NULL), []) AS customer_names
       FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey
       WHERE r_name = 'EUROPE' GROUP BY n_nationkey, n_name""",
    region="EUROPE",
)
_case("scan_output", "{ Region { key @output name @output } }", "SELECT CAST(r_regionkey AS BIGINT) AS key, r_name AS name FROM region")
_case("param_scan", "{ CustomerByKey(key: 7) { name @output acctbal @output } }", "SELECT c_name AS name, c_acctbal AS acctbal FROM customer WHERE c_custkey = 7")
_case(
    "prefix_names",
    "{ Region { area: name @output of_: nation { name @output code: key @output @output(name: \"plain\") } } }",
    "SELECT r_name AS area, n_name AS of_name, CAST(n_nationkey AS BIGINT) AS of_code, CAST(n_nationkey AS BIGINT) AS plain FROM region JOIN nation ON n_regionkey = r_regionkey",
)
_case(
    "typename_output",
    "{ Party { __typename @output key @output } }",
    "SELECT 'Customer' AS __typename, c_custkey AS key FROM customer UNION ALL SELECT 'Supplier', s_suppkey FROM supplier",
)
_case("typename_filter", '{ Party { __typename ?(= $t) name @output } }', "SELECT s_name AS name FROM supplier", t="Supplier")

_CUSTOMER = "SELECT c_custkey AS key FROM customer WHERE "


def _customers(name: str, prop: str, op: str, where: str, **arguments) -> None:
    _case(name, f'{{ Customer {{ key @output {prop} ?({op} $x) }} }}', _CUSTOMER + where, **arguments)


_customers("filter_eq", "mktsegment", "=", "c_mktsegment = 'BUILDING'", x="BUILDING")
_customers("filter_ne", "premium", "!=", "(CASE WHEN c_acctbal > 5000 THEN c_acctbal END) IS DISTINCT FROM 9000.5", x=9000.5)
_customers("filter_eq_null", "premium", "=", "c_acctbal <= 5000", x=None)
_customers("filter_lt", "acctbal", "<", "c_acctbal < 1000", x=1000.0)
_customers("filter_le", "acctbal", "<=", "c_acctbal <= 4500.25", x=4500.25)
_customers("filter_gt", "premium", ">", "c_acctbal > 7000", x=7000.0)
_customers("filter_ge", "name", ">=", "c_name >= 'Customer#000000100'", x="Customer#000000100")
_customers("filter_one_of", "mktsegment", "one_of", "c_mktsegment IN ('BUILDING', 'MACHINERY')", x=["BUILDING", "MACHINERY"])
_customers("filter_one_of_null", "premium", "one_of", "c_acctbal <= 5000", x=[None, -1.5])
_customers("filter_not_one_of", "premium", "not_one_of", "c_acctbal > 5000", x=[None])
_customers("filter_has_prefix", "mktsegment", "has_prefix", "starts_with(c_mktsegment, 'B')", x="B")
_customers("filter_not_has_prefix", "mktsegment", "not_has_prefix", "NOT starts_with(c_mktsegment, 'B')", x="B")
_customers("filter_has_suffix", "name", "has_suffix", "suffix(c_name, '7')", x="7")
_customers("filter_not_has_suffix", "name", "not_has_suffix", "NOT suffix(c_name, '7')", x="7")
_customers("filter_has_substring", "mktsegment", "has_substring", "contains(c_mktsegment, 'IL')", x="IL")
_customers("filter_not_has_substring", "mktsegment", "not_has_substring", "NOT contains(c_mktsegment, 'IL')", x="IL")
_customers("filter_regex", "mktsegment", "regex", "regexp_matches(c_mktsegment, '^(AUTO|MACH).*[YE]$')", x="^(AUTO|MACH).*[YE]$")
_customers("filter_regex_nested", "name", "regex", "regexp_matches(c_name, '[1-3]+#*0*7$')", x="([1-3]+#*)+0*7$")
_customers("filter_not_regex", "mktsegment", "not_regex", "NOT regexp_matches(c_mktsegment, '[AO]U')", x="[AO]U")
_case("filter_is_null", '{ Customer { key @output premium ?(is_null) } }', _CUSTOMER + "c_acctbal <= 5000")
_case("filter_is_not_null", '{ Customer { key @output premium ?(is_not_null) @output } }', "SELECT c_custkey AS key, c_acctbal AS premium FROM customer WHERE c_acctbal > 5000")
_case("filter_contains", '{ Part { key @output words ?(contains $w) } }', "SELECT p_partkey AS key FROM part WHERE list_contains(string_split(p_name, ' '), 'red')", w="red")
_case("filter_not_contains", '{ Part { key @output words ?(not_contains $w) } }', "SELECT p_partkey AS key FROM part WHERE NOT list_contains(string_split(p_name, ' '), 'red')", w="red")
_case(
    "filter_multiple",
    '{ Order { key @output totalprice ?(> $low) ?(< $high) status ?(= $s) } }',
    "SELECT o_orderkey AS key FROM orders WHERE o_totalprice > 100000 AND o_totalprice < 200000 AND o_orderstatus = 'F'",
    low=100000.0,
    high=200000.0,
    s="F",
)
_case(
    "filter_regex_tag",
    '{ Nation { name @tag(name: "pattern") @output customer { key @output name ?(not_regex %pattern) } } }',
    "SELECT n_name AS name, c_custkey AS key FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE NOT contains(c_name, n_name)",
)
_case(
    "filter_regex_tag_match",
    '{ Document { id @output lang @tag(name: "code") text ?(regex %code) } }',
    "SELECT doc_id AS id FROM documents WHERE contains(text, lang)",
)
_case(
    "edge_inner",
    "{ LineItem { linenumber @output order { order: key @output customer { name @output } } } }",
    "SELECT CAST(l_linenumber AS BIGINT) AS linenumber, o_orderkey AS \"order\", c_name AS name FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey",
)
_case(
    "edge_optional",
    "{ Document { id @output label @optional { quality @output toxic @output } } }",
    "SELECT d.doc_id AS id, CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
)
_case(
    "optional_nested_required",
    "{ Message { id: turn @output conv: convId @output next @optional { next { later: turn @output } } } }",
    """SELECT a.turn AS id, a.conv_id AS conv, c.turn AS later FROM conversations a
       LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
       LEFT JOIN conversations c ON c.conv_id = b.conv_id AND c.turn = b.turn + 1
       WHERE b.turn IS NULL OR c.turn IS NOT NULL""",
)
_case(
    "optional_then_filter",
    '{ Document { id @output label @optional { toxic ?(= $one) @output } } }',
    "SELECT d.doc_id AS id, CAST(toxic AS BIGINT) AS toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL OR toxic = 1",
    one=1,
)
_case(
    "edge_param",
    "{ Customer { key @output order(minPrice: 200000.0) { price: totalprice @output } } }",
    "SELECT c_custkey AS key, o_totalprice AS price FROM customer JOIN orders ON o_custkey = c_custkey AND o_totalprice >= 200000",
)
_case(
    "edge_param_optional",
    "{ Customer { key @output order(minPrice: 200000.0) @optional { price: totalprice @output } } }",
    "SELECT c_custkey AS key, o_totalprice AS price FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice >= 200000",
)
_case(
    "duplicate_edge",
    '{ Region { key @output nation { a: name @output } nation { b: name @output } } }',
    "SELECT CAST(r_regionkey AS BIGINT) AS key, x.n_name AS a, y.n_name AS b FROM region JOIN nation x ON x.n_regionkey = r_regionkey JOIN nation y ON y.n_regionkey = r_regionkey",
)
_case(
    "sibling_edges",
    "{ Nation { name @output region { region: name @output } supplier { supplier: name @output } } }",
    "SELECT n_name AS name, r_name AS region, s_name AS supplier FROM nation JOIN region ON r_regionkey = n_regionkey JOIN supplier ON s_nationkey = n_nationkey",
)
_case(
    "tag_theta",
    '{ Supplier { name @output acctbal @tag(name: "mine") nation { customer { customer: key @output acctbal ?(> %mine) } } } }',
    "SELECT s_name AS name, c_custkey AS customer FROM supplier JOIN customer ON c_nationkey = s_nationkey WHERE c_acctbal > s_acctbal",
)
_case(
    "tag_equi",
    '{ Order { key @output customer { nation { key @tag(name: "home") } } lineitem { linenumber @output supplier { nation { key ?(= %home) } } } } }',
    """SELECT o_orderkey AS key, CAST(l_linenumber AS BIGINT) AS linenumber FROM orders JOIN customer ON c_custkey = o_custkey
       JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey = c_nationkey""",
)
_case(
    "tag_from_absent_optional",
    '{ Message { convId @output turn @output next @optional { turn @tag(name: "n") } previous { back: turn @output ?(> %n) } } }',
    """SELECT a.conv_id AS convId, a.turn AS turn, p.turn AS back FROM conversations a
       LEFT JOIN conversations n ON n.conv_id = a.conv_id AND n.turn = a.turn + 1
       JOIN conversations p ON p.conv_id = a.conv_id AND p.turn = a.turn - 1 WHERE n.turn IS NULL OR p.turn > n.turn""",
)
_case(
    "semi_join",
    '{ Customer { key @output order(minPrice: 250000.0) @fold &count ?(>= $one) } }',
    "SELECT c_custkey AS key FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice >= 250000)",
    one=1,
)
_case(
    "anti_join",
    '{ Customer { key @output order(minPrice: 400000.0) @fold &count ?(= $none) } }',
    "SELECT c_custkey AS key FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice >= 400000)",
    none=0,
)
_case("coerce_root", "{ Party { ... on Customer { key @output mktsegment @output } } }", "SELECT c_custkey AS key, c_mktsegment AS mktsegment FROM customer")
_case(
    "coerce_edge",
    "{ Nation { name @output party { ... on Supplier { supplier: name @output } } } }",
    "SELECT n_name AS name, s_name AS supplier FROM nation JOIN supplier ON s_nationkey = n_nationkey",
)
_case(
    "coerce_optional",
    "{ Nation { name @output party @optional { ... on Supplier { supplier: name @output } } } }",
    """SELECT n_name AS name, s_name AS supplier FROM nation JOIN supplier ON s_nationkey = n_nationkey
       UNION ALL SELECT n_name, NULL FROM nation WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey)
       AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey)""",
)
_case(
    "interface_edge",
    "{ Party { __typename @output key @output nation { region { region: name @output } } } }",
    """WITH p AS (SELECT 'Customer' AS t, c_custkey AS k, c_nationkey AS n FROM customer UNION ALL SELECT 'Supplier', s_suppkey, s_nationkey FROM supplier)
       SELECT t AS __typename, k AS key, r_name AS region FROM p JOIN nation ON n_nationkey = n JOIN region ON r_regionkey = n_regionkey""",
)
_HOPS = """a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn >= a.turn AND b.turn <= a.turn + {}"""
_case(
    "recurse",
    "{ Message { convId @output turn @output next @recurse(depth: 3) { to: turn @output role @output } } }",
    f"SELECT a.conv_id AS convId, a.turn AS turn, b.turn AS \"to\", b.role AS role FROM conversations {_HOPS.format(3)}",
)
_case(
    "recurse_filter",
    '{ Message { convId @output turn @output next @recurse(depth: 3) { to: turn @output role ?(= $r) } } }',
    f"SELECT a.conv_id AS convId, a.turn AS turn, b.turn AS \"to\" FROM conversations {_HOPS.format(3)} WHERE b.role = 'assistant'",
    r="assistant",
)
_case(
    "recurse_optional",
    "{ Message { convId @output turn @output next @optional @recurse(depth: 2) { to: turn @output } } }",
    f"SELECT a.conv_id AS convId, a.turn AS turn, b.turn AS \"to\" FROM conversations {_HOPS.format(2)}",
)
_case(
    "recurse_from_absent",
    "{ Message { convId @output turn @output next @optional { via: turn @output next @recurse(depth: 2) { to: turn @output role @output } } } }",
    """SELECT a.conv_id AS convId, a.turn AS turn, b.turn AS via, c.turn AS "to", c.role AS role FROM conversations a
       LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
       LEFT JOIN conversations c ON c.conv_id = b.conv_id AND c.turn >= b.turn AND c.turn <= b.turn + 2""",
)
_case(
    "fold_list",
    "{ Nation { name @output supplier @fold { suppliers: name @output balances: acctbal @output } } }",
    """SELECT n_name AS name, coalesce(list(s_name ORDER BY s_suppkey) FILTER (WHERE s_suppkey IS NOT NULL), []) AS suppliers,
         coalesce(list(s_acctbal ORDER BY s_suppkey) FILTER (WHERE s_suppkey IS NOT NULL), []) AS balances
       FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name""",
)
_case(
    "fold_count",
    '{ Customer { key @output order @fold &count @output } }',
    "SELECT c_custkey AS key, count(o_orderkey) AS ordercount FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
)
_case(
    "fold_count_filter",
    '{ Customer { key @output order @fold &count ?(>= $n) @output(name: "n") { totalprice ?(> $p) } } }',
    "SELECT c_custkey AS key, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 150000 GROUP BY c_custkey HAVING count(*) >= 5",
    n=5,
    p=150000.0,
)
_case(
    "fold_count_tag",
    '{ Nation { name @output customer @fold &count @tag(name: "n") @output(name: "n") supplier { sup: key @output ?(< %n) } } }',
    """SELECT n_name AS name, coalesce(n, 0) AS n, s_suppkey AS sup FROM nation
       LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) ON c_nationkey = n_nationkey
       JOIN supplier ON s_nationkey = n_nationkey WHERE s_suppkey < coalesce(n, 0)""",
)
_case(
    "fold_empty",
    '{ Region { name @output nation @fold &count @output(name: "n") { name ?(= $none) list: key @output } } }',
    "SELECT r_name AS name, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS list FROM region",
    none="Atlantis",
)
_case(
    "fold_absent_optional",
    '{ Message { convId @output turn @output next @optional { previous @fold &count @output(name: "n") { back: turn @output } } } }',
    """SELECT a.conv_id AS convId, a.turn AS turn, CASE WHEN b.turn IS NOT NULL THEN CAST(1 AS BIGINT) END AS n,
         CASE WHEN b.turn IS NOT NULL THEN [a.turn] END AS back
       FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""",
)
_case(
    "fold_nested",
    '{ Region { name @output nation @fold { nations: name @output supplier @fold &count @output(name: "counts") { keys: key @output } } } }',
    """WITH n AS (SELECT n_regionkey, n_nationkey, n_name, count(s_suppkey) AS c, coalesce(list(s_suppkey ORDER BY s_suppkey) FILTER (WHERE s_suppkey IS NOT NULL), []) AS k
         FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2, 3)
       SELECT r_name AS name, list(n_name ORDER BY n_nationkey) AS nations, list(c ORDER BY n_nationkey) AS counts, list(k ORDER BY n_nationkey) AS keys
       FROM region JOIN n ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name""",
)
_case(
    "fold_imported_tag",
    '{ Supplier { name @output acctbal @tag(name: "mine") nation { customer @fold &count @output(name: "richer") { acctbal ?(> %mine) } } } }',
    """SELECT s_name AS name, count(c_custkey) AS richer FROM supplier LEFT JOIN customer ON c_nationkey = s_nationkey AND c_acctbal > s_acctbal GROUP BY s_suppkey, s_name""",
)
_case(
    "fold_inner_edges",
    '{ Nation { name @output customer @fold { mktsegment ?(= $s) order(minPrice: 200000.0) { orders: key @output } } } }',
    """SELECT n_name AS name, coalesce(list(o_orderkey ORDER BY c_custkey, o_orderkey) FILTER (WHERE o_orderkey IS NOT NULL), []) AS orders FROM nation
       LEFT JOIN (customer JOIN orders ON o_custkey = c_custkey AND o_totalprice >= 200000) ON c_nationkey = n_nationkey AND c_mktsegment = 'BUILDING'
       GROUP BY n_nationkey, n_name""",
    s="BUILDING",
)
_case(
    "fold_recurse",
    "{ Message { convId @output turn @output next @fold { next @recurse(depth: 2) { ahead: turn @output } } } }",
    """SELECT a.conv_id AS convId, a.turn AS turn, coalesce(list(c.turn ORDER BY c.turn) FILTER (WHERE c.turn IS NOT NULL), []) AS ahead FROM conversations a
       LEFT JOIN (conversations b JOIN conversations c ON c.conv_id = b.conv_id AND c.turn BETWEEN b.turn AND b.turn + 2) ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
       GROUP BY a.conv_id, a.turn""",
)
_case("top_orders", "{ TopOrders(max: 10) { key @output totalprice @output } }", "SELECT o_orderkey AS key, o_totalprice AS totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
_case(
    "time_range",
    '{ Order { key @output orderdate ?(>= $from) ?(< $to) @output } }',
    "SELECT o_orderkey AS key, epoch_us(o_orderdate) AS orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-04-01'",
    **{"from": 788918400000000, "to": 796694400000000},
)
_case("events_scan", '{ Event { id @output ts @output eventType ?(= $t) value @output } }', "SELECT event_id AS id, epoch_us(ts) AS ts, value FROM events WHERE event_type = 'purchase'", t="purchase")
_case("pages_scan", '{ Page { id @output url @output html ?(has_substring $s) } }', "SELECT page_id AS id, url FROM pages WHERE contains(html, '<p>')", s="<p>")
_case("benchmark_scan", "{ BenchmarkItem { id @output text @output } }", "SELECT item_id AS id, text FROM benchmark")
_case("label_document", "{ Label { docId @output quality @output document { lang @output nChars @output } } }", "SELECT l.doc_id AS docId, CAST(quality AS BIGINT) AS quality, lang, n_chars AS nChars FROM labels l JOIN documents d ON d.doc_id = l.doc_id")
_case(
    "list_property",
    '{ Vector { id @output embedding @output label ?(= $l) } }',
    "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings WHERE label = 3",
    l=3,
)
_case(
    "pricing",
    '{ Part { brand @output size ?(<= $small) lineitem { quantity @output ?(>= $q) order { priority @output status ?(!= $s) } } } }',
    """SELECT p_brand AS brand, l_quantity AS quantity, o_orderpriority AS priority FROM part JOIN lineitem ON l_partkey = p_partkey
       JOIN orders ON o_orderkey = l_orderkey WHERE p_size <= 10 AND l_quantity >= 40 AND o_orderstatus <> 'O'""",
    small=10,
    q=40.0,
    s="O",
)


def _run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    text, arguments, _ = CASES[name]
    return lambda spark, sf_dir: execute_query(warehouse_source(spark, sf_dir), text, arguments)


def _introspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = warehouse_source(spark, sf_dir).schema
    text = """{ VertexType { type: name @output is_interface @output implements @fold { parents: name @output }
        property @fold { properties: name @output kinds: type @output }
        edge @fold { edges: name @output to_many @output target { targets: name @output } parameter @fold { parameters: name @output } } } }"""
    return execute_query(introspection_source(spark, schema), text)


def _introspected() -> str:
    """The rows of ``introspect_types``, from the schema's text."""
    kinds = re.findall(r"(interface|type) (\w+)(?: implements (\w+))? \{(.*?)\}", re.sub(r'".*?"', "", SDL.split("type Query")[1].split("}", 1)[1]), re.S)
    names, rows = {k[1] for k in kinds}, []
    quoted = lambda items, kind="VARCHAR": f"[{', '.join(items)}]::{kind}[]"
    for kind, name, above, body in kinds:
        fields = re.findall(r"(\w+)(?:\((\w+): \S+\))?: (\S+)", body)
        own, edges = [f for f in fields if f[2].strip("[]!") not in names], [f for f in fields if f[2].strip("[]!") in names]
        text = lambda part: [f"'{x}'" for x in part]
        lists = [quoted(text([above] if above else [])), quoted(text(f[0] for f in own)), quoted(text(f[2] for f in own)), quoted(text(f[0] for f in edges)), quoted([str(f[2][0] == "[").upper() for f in edges], "BOOLEAN"), quoted(text(f[2].strip("[]!") for f in edges)), quoted([quoted(text([f[1]] if f[1] else [])) for f in edges], "VARCHAR[]")]
        rows.append(f"('{name}', {str(kind == 'interface').upper()}, {', '.join(lists)})")
    return f"SELECT * FROM (VALUES {', '.join(rows)}) t(type, is_interface, parents, properties, kinds, edges, to_many, targets, parameters)"


def _primes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return execute_query(numbers_source(spark), "{ Number(min: 2, max: 60) { ... on Composite { value @output primeFactor @fold { factors: value @output } } } }")


def _json_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_json(_run("scan_output")(spark, sf_dir))


EXTRA: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "introspect_types": (_introspect, _introspected()),
    "numbers_prime_factors": (
        _primes,
        """WITH n AS (SELECT unnest(range(2, 61)) AS v), d AS (SELECT a.v, b.v AS f FROM n a JOIN n b ON b.v < a.v AND a.v % b.v = 0),
             p AS (SELECT v FROM n WHERE v NOT IN (SELECT v FROM d))
           SELECT v AS value, list(f ORDER BY f) AS factors FROM d WHERE f IN (SELECT v FROM p) GROUP BY v""",
    ),
    "recurse_param": (
        lambda spark, sf_dir: execute_query(numbers_source(spark), "{ Four { multiple(max: 2) @recurse(depth: 2) { to: value @output } value @output } }"),
        "SELECT CAST(4 AS BIGINT) AS value, CAST(v AS BIGINT) AS \"to\" FROM (VALUES (4), (4), (8), (4), (8), (8), (16)) t(v)",
    ),
    "json_sink": (_json_sink, "SELECT '{\"key\":' || r_regionkey || ',\"name\":\"' || r_name || '\"}' AS json FROM region"),
}

EXTRA |= small.QUERIES
QUERIES = {n: _run(n) for n in CASES} | {n: f for n, (f, _) in EXTRA.items()}
SQL = {n: sql for n, (_, _, sql) in CASES.items()} | {n: sql for n, (_, sql) in EXTRA.items() if sql}
