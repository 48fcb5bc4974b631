"""A schema as a graph of its own: types, properties, edges and their parameters."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from vertexloom.schema import Schema
from vertexloom.sources.spec import Source

SDL = f"""
schema {{ query: Query }}
type Query {{ VertexType: [VertexType!]!  Entrypoint: [Edge!]!  Schema: Schema! }}
type Schema {{ vertex_type: [VertexType!]  entrypoint: [Edge!] }}
type VertexType {{
  name: String!  docs: String  is_interface: Boolean!
  implements: [VertexType!]  implementer: [VertexType!]  property: [Property!]  edge: [Edge!]
}}
type Property {{ name: String!  docs: String  type: String! }}
type Edge {{ name: String!  docs: String  to_many: Boolean!  at_least_one: Boolean!  target: VertexType!  parameter: [EdgeParameter!] }}
type EdgeParameter {{ name: String!  docs: String  type: String!  default: String }}
"""


def introspection_source(spark: SparkSession, schema: Schema) -> Source:
    types, properties, edges, parameters, implements = [], [], [], [], []
    for i, t in enumerate(schema.types.values()):
        if t.name != schema.query_type:
            types.append((i, t.name, t.description, t.kind == "interface", 0))
            implements += [(t.name, p) for p in t.implements]
        for j, f in enumerate(t.fields):
            if not schema.is_edge(f):
                properties.append((j, t.name, f.name, f.description, str(f.type)))
                continue
            edges.append((j, t.name, f.name, f.description, f.type.is_list, not f.type.is_nullable and not (f.type.is_list and f.type.element().is_nullable), f.type.name))
            for k, p in enumerate(f.parameters):
                parameters.append((k, t.name, f.name, p.name, p.description, str(p.type), json.dumps(p.default) if p.has_default else None))
    make = spark.createDataFrame
    pairs = make(implements, "child string, parent string")
    vertex = make(types, "at int, name string, docs string, is_interface boolean, one int")
    s = Source(spark, Schema(SDL))
    s.vertex("Schema", make([(0,)], "one int"))
    s.vertex("VertexType", vertex, order=["at"])
    s.vertex("Property", make(properties, "at int, owner string, name string, docs string, type string"), order=["at"])
    edge = "at int, owner string, name string, docs string, to_many boolean, at_least_one boolean, target_name string"
    s.vertex("Edge", make(edges, edge).selectExpr("*", f"int(owner = '{schema.query_type}') - 1 AS one"), order=["at"])
    s.vertex("EdgeParameter", make(parameters, "at int, owner string, edge string, name string, docs string, type string, default string"), order=["at"])
    s.root("VertexType")
    s.root("Schema")
    s.root("Entrypoint", lambda raw: raw.where(raw["owner"] == schema.query_type))
    s.edge_keys("Schema", "vertex_type", [("one", "one")])
    s.edge_keys("Schema", "entrypoint", [("one", "one")])
    s.edge_keys("VertexType", "property", [("name", "owner")])
    s.edge_keys("VertexType", "edge", [("name", "owner")])
    s.edge_keys("Edge", "target", [("target_name", "name")])
    s.edge_keys("Edge", "parameter", [("owner", "owner"), ("name", "edge")])
    s.edge_table("VertexType", "implements", lambda spark: vertex.join(pairs, vertex["name"] == pairs["parent"]), [("name", "child")])
    s.edge_table("VertexType", "implementer", lambda spark: vertex.join(pairs, vertex["name"] == pairs["child"]), [("name", "parent")])
    return s
