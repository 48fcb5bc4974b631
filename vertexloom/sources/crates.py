"""Documentation of program libraries, as JSON with an index of items by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.schema import Schema
from vertexloom.sources.sdl import schema_sdl, vertex_sdl
from vertexloom.sources.spec import Get, Source

_KINDS = {"module": "Module", "struct": "Struct", "enum": "Enum", "trait": "Trait", "function": "Function"}
_OWN = "visibility docs? id name?"
SDL = schema_sdl(
    "Crate: [Crate!]!",
    vertex_sdl("Crate", String="crate_version? root", edges="item: [Item!]"),
    vertex_sdl("Item", String=_OWN, interface=True),
    *[vertex_sdl(k, "Item", String=_OWN, edges="item: [Item!]" if k == "Module" else "") for k in _KINDS.values()],
)
_ITEM = "struct<name:string,docs:string,visibility:string,inner:map<string,string>>"
_FILE = f"struct<root:string,crate_version:string,index:map<string,{_ITEM}>>"


def crates_source(spark: SparkSession, path: str | DataFrame) -> Source:
    """One file, or row (file, value), a library; ``Module.item`` are the items a module lists."""
    texts = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file")) if isinstance(path, str) else path
    files = texts.select(F.from_json("value", _FILE).alias("c"), "file")
    crates = files.select("file", "c.root", "c.crate_version")
    items = files.select("file", F.explode("c.index").alias("id", "i")).select("file", "id", "i.name", "i.docs", "i.visibility", "i.inner")
    items = items.withColumn("kind", F.element_at(F.map_keys("inner"), 1))
    items = items.withColumn("members", F.from_json(F.get_json_object(F.element_at(F.map_values("inner"), 1), "$.items"), "array<string>"))
    items = items.drop("inner").where(F.col("kind").isin(*_KINDS))

    def typename(get: Get) -> Column:
        out = F.lit(None)
        for kind, name in _KINDS.items():
            out = F.when(get("kind") == kind, name).otherwise(out)
        return out

    s = Source(spark, Schema(SDL))
    s.vertex("Crate", crates, order=["file"])
    s.vertex("Item", items, typename=typename, order=["id"])
    s.root("Crate")
    s.edge_keys("Crate", "item", [("file", "file")])
    members = lambda spark: items.select("file", F.col("id").alias("holder"), F.explode("members").alias("id")).join(items.drop("members"), ["file", "id"])
    s.edge_table("Module", "item", members, [("file", "file"), ("id", "holder")])
    return s
