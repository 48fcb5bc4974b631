"""The sales, event, message and document tables as a graph."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vertexloom.schema import Schema
from vertexloom.sources.spec import Mapped, Source

SDL = f"""
schema {{ query: Query }}
type Query {{
  Region: [Region!]!
  Nation: [Nation!]!
  Party: [Party!]!
  Customer: [Customer!]!
  CustomerByKey(key: Int!): Customer
  Supplier: [Supplier!]!
  Part: [Part!]!
  Order: [Order!]!
  TopOrders(max: Int!): [Order!]!
  LineItem: [LineItem!]!
  Event: [Event!]!
  Message: [Message!]!
  Document: [Document!]!
  Label: [Label!]!
  Page: [Page!]!
  Vector: [Vector!]!
  BenchmarkItem: [BenchmarkItem!]!
}}
type Region {{ key: Int!  name: String!  nation: [Nation!] }}
type Nation {{ key: Int!  name: String!  region: Region!  customer: [Customer!]  supplier: [Supplier!]  party: [Party!] }}
"Whoever buys or sells."
interface Party {{ key: Int!  name: String!  acctbal: Float!  nation: Nation! }}
type Customer implements Party {{
  key: Int!  name: String!  acctbal: Float!  nation: Nation!  mktsegment: String!
  "The balance where it is above 5000."
  premium: Float
  order(minPrice: Float): [Order!]
}}
type Supplier implements Party {{ key: Int!  name: String!  acctbal: Float!  nation: Nation!  lineitem: [LineItem!] }}
type Part {{ key: Int!  name: String!  brand: String!  type: String!  size: Int!  retailprice: Float!  words: [String!]!  lineitem: [LineItem!] }}
type Order {{ key: Int!  status: String!  priority: String!  totalprice: Float!  orderdate: Int!  customer: Customer!  lineitem: [LineItem!] }}
type LineItem {{
  linenumber: Int!  quantity: Float!  extendedprice: Float!  discount: Float!  tax: Float!
  returnflag: String!  linestatus: String!  shipdate: Int!  order: Order  part: Part  supplier: Supplier
}}
type Event {{ id: Int!  ts: Int!  userId: Int!  eventType: String!  value: Float!  props: String! }}
type Message {{ convId: Int!  turn: Int!  role: String!  text: String!  next: Message  previous: Message }}
type Document {{ id: Int!  text: String!  lang: String!  source: String!  nChars: Int!  label: Label }}
type Label {{ docId: Int!  quality: Int!  toxic: Int!  document: Document! }}
type Page {{ id: Int!  url: String!  html: String! }}
type Vector {{ id: Int!  embedding: [Float!]!  label: Int! }}
type BenchmarkItem {{ id: Int!  text: String! }}
"""


_schemas: dict[tuple[str, int], StructType] = {}


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table; its schema is looked up once as long as the file or folder stays as it is."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    status = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place)
    key = (path, status.getModificationTime())
    if key not in _schemas:
        _schemas[key] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[key]).parquet(path)


def _when(micros: object, kind: str) -> Column | None:
    try:
        return F.lit(str(datetime(1970, 1, 1) + timedelta(microseconds=micros))).cast("timestamp_ntz") if kind == "timestamp_ntz" else None
    except (OverflowError, TypeError):
        return None


def _micros(column: str) -> Mapped:
    """Microseconds since 1970, whatever the session's time zone."""
    return Mapped(column, lambda c: F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz")), _when)


def warehouse_source(spark: SparkSession, sf_dir: str) -> Source:
    """Vertices over the parquet tables of a folder."""

    def read(name: str, prefix: str = "", made: tuple[str, ...] = (), **renamed: str) -> Callable[[], DataFrame]:
        def rows() -> DataFrame:
            df = read_table(spark, f"{sf_dir}/{name}.parquet")
            df = df.toDF(*[renamed.get(c, c.removeprefix(prefix)) for c in df.columns])
            return df.selectExpr("*", *made) if made else df

        return rows

    s = Source(spark, Schema(SDL))
    s.vertex("Region", read("region", "r_", r_regionkey="key"), order=["key"])
    s.vertex("Nation", read("nation", "n_", n_nationkey="key"), order=["key"])
    s.vertex("Customer", read("customer", "c_", c_custkey="key"), {"premium": lambda get: F.when(get("acctbal") > 5000, get("acctbal"))}, order=["key"])
    s.vertex("Supplier", read("supplier", "s_", s_suppkey="key"), order=["key"])
    s.vertex("Part", read("part", "p_", p_partkey="key"), {"words": lambda get: F.split(get("name"), " ")}, order=["key"])
    orders = read("orders", "o_", o_orderkey="key", o_orderstatus="status", o_orderpriority="priority")
    s.vertex("Order", orders, {"orderdate": _micros("orderdate")}, order=["key"])
    s.vertex("LineItem", read("lineitem", "l_"), {"shipdate": _micros("shipdate")}, order=["orderkey", "linenumber"])
    s.vertex("Event", read("events", event_id="id", user_id="userId", event_type="eventType"), {"ts": _micros("ts")}, order=["id"])
    messages = read("conversations", "", ("turn + 1 AS after", "turn - 1 AS before"), conv_id="convId")
    s.vertex("Message", messages, order=["convId", "turn"])
    s.vertex("Document", read("documents", doc_id="id", n_chars="nChars"), order=["id"])
    s.vertex("Label", read("labels", doc_id="docId"), order=["docId"])
    s.vertex("Page", read("pages", page_id="id"), order=["id"])
    s.vertex("Vector", read("embeddings", vec_id="id"), order=["id"])
    s.vertex("BenchmarkItem", read("benchmark", item_id="id"), order=["id"])

    for name in ("Region", "Nation", "Party", "Customer", "Supplier", "Part", "Order", "LineItem", "Event", "Message", "Document", "Label", "Page", "Vector", "BenchmarkItem"):
        s.root(name)
    s.root("CustomerByKey", lambda raw, key: raw.where(raw["key"] == key))
    s.root("TopOrders", lambda raw, max: raw.orderBy(F.desc("totalprice"), "key").limit(max))

    s.edge_keys("Region", "nation", [("key", "regionkey")])
    s.edge_keys("Nation", "region", [("regionkey", "key")])
    s.edge_keys("Nation", "customer", [("key", "nationkey")])
    s.edge_keys("Nation", "supplier", [("key", "nationkey")])
    s.edge_keys("Nation", "party", [("key", "nationkey")], order=["key"])
    s.edge_keys(["Customer", "Supplier"], "nation", [("nationkey", "key")])
    s.edge_keys("Customer", "order", [("key", "custkey")], where=lambda get, minPrice: F.lit(True) if minPrice is None else get("totalprice") >= minPrice)
    s.edge_keys("Supplier", "lineitem", [("key", "suppkey")])
    s.edge_keys("Part", "lineitem", [("key", "partkey")])
    s.edge_keys("Order", "customer", [("custkey", "key")])
    s.edge_keys("Order", "lineitem", [("key", "orderkey")])
    s.edge_keys("LineItem", "order", [("orderkey", "key")])
    s.edge_keys("LineItem", "part", [("partkey", "key")])
    s.edge_keys("LineItem", "supplier", [("suppkey", "key")])
    s.edge_keys("Message", "next", [("convId", "convId"), ("after", "turn")])
    s.edge_keys("Message", "previous", [("convId", "convId"), ("before", "turn")])
    s.edge_keys("Document", "label", [("id", "docId")])
    s.edge_keys("Label", "document", [("docId", "id")])
    return s
