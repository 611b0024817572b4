"""Exports: records as JSON lines, GraphML, DOT and HTML; selections of a graph to export."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators.traverse import bfs, turned


MOST_IN_PAGE = 5_000


def _records(tables: dict[str, DataFrame], fixed: dict[str, str], kind: str, name_as: str, root: str | None) -> DataFrame:
    out = None
    for name in sorted(tables):
        df = tables[name]
        props = sorted(c for c in df.columns if c not in (*fixed, "rel_id"))
        body = F.to_json(F.struct(*[F.col(p) for p in props])) if props else F.lit("{}")
        d = df.select(F.lit(kind).alias("kind"), *[F.col(a).alias(b) for a, b in fixed.items()], F.lit(name).alias(name_as), body.alias("properties"))
        if root:
            d = d.select(*[F.replace(F.col(c), F.lit(root), F.lit("<root>")).alias(c) for c in d.columns])
        out = d if out is None else out.unionByName(d)
    return out


def node_records(graph: Graph, root: str | None = None) -> DataFrame:
    """kind, id, label, properties (JSON with sorted keys, unset ones left out)."""
    return _records(graph.nodes, {"id": "id"}, "node", "label", root)


def rel_records(graph: Graph, root: str | None = None) -> DataFrame:
    return _records(graph.rels, {"src": "from", "dst": "to"}, "rel", "type", root)


def normalized(graph: Graph, root: str | None = None) -> DataFrame:
    """(line): all records in one order that doesn't depend on how the graph was made."""
    n = node_records(graph, root).select(F.lit(0).alias("k"), F.col("id").alias("a"), F.lit("").alias("b"), F.lit("").alias("c"), F.to_json(F.struct("kind", "id", "label", "properties")).alias("line"))
    r = rel_records(graph, root)
    r = r.select(F.lit(1).alias("k"), F.col("from").alias("a"), F.col("type").alias("b"), F.col("to").alias("c"), F.to_json(F.struct("kind", "from", "type", "to", "properties")).alias("line"))
    return n.unionByName(r).orderBy("k", "a", "b", "c", "line").select("line")


def write_jsonl(graph: Graph, path: str, root: str | None = None) -> None:
    """Folders nodes and relationships, summary (counts) and manifest (tables, properties, schema)."""
    node_records(graph, root).write.mode("overwrite").json(f"{path}/nodes")
    rel_records(graph, root).write.mode("overwrite").json(f"{path}/relationships")
    graph.stats().write.mode("overwrite").json(f"{path}/summary")
    kinds = [("node", n, list(t.properties)) for n, t in graph.schema.nodes.items()] + [("rel", n, list(t.properties)) for n, t in graph.schema.rels.items()]
    told = graph.spark.createDataFrame(kinds, "kind string, name string, properties array<string>").withColumn("schema", F.lit(graph.schema.fingerprint()))
    told.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def _xml(c: Column) -> Column:
    out = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(out, F.lit('"'), F.lit("&quot;"))


XML_TYPES = {"STRING": "string", "INT64": "long", "BOOLEAN": "boolean", "FLOAT": "double", "TIMESTAMP": "string"}


def graphml(graph: Graph) -> DataFrame:
    """(part, line): a GraphML document in four parts in order; keys carry the schema's types."""
    spark = graph.spark
    keys, declared = {}, []
    for scope, tables in (("node", {k: graph.schema.nodes[k].properties for k in graph.nodes}), ("edge", {k: graph.schema.rels[k].properties for k in graph.rels})):
        for props in tables.values():
            for p, t in props.items():
                now = keys.get((scope, p))
                keys[scope, p] = t if now in (None, t) else "STRING"
    for (scope, p), t in sorted(keys.items()):
        declared.append(f'<key id="{scope}_{html.escape(p)}" for="{scope}" attr.name="{html.escape(p)}" attr.type="{XML_TYPES[t]}"/>')
    top = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '<key id="kind" for="all" attr.name="kind" attr.type="string"/>', *declared, '<graph edgedefault="directed">']
    out = spark.createDataFrame([(0, "\n".join(top)), (3, "</graph>\n</graphml>")], "part int, line string")

    def data(scope: str, df: DataFrame, props) -> Column:
        return F.concat_ws("", *[F.when(F.col(p).isNotNull(), F.concat(F.lit(f'<data key="{scope}_{html.escape(p)}">'), _xml(F.col(p).cast("string")), F.lit("</data>"))) for p in props])

    for name, df in sorted(graph.nodes.items()):
        props = sorted(graph.schema.nodes[name].properties)
        out = out.unionByName(df.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), _xml(F.col("id")), F.lit(f'"><data key="kind">{name}</data>'), data("node", df, props), F.lit("</node>")).alias("line")))
    for name, df in sorted(graph.rels.items()):
        props = sorted(graph.schema.rels[name].properties)
        out = out.unionByName(df.select(F.lit(2).alias("part"), F.concat(F.lit('<edge source="'), _xml(F.col("src")), F.lit('" target="'), _xml(F.col("dst")), F.lit(f'"><data key="kind">{name}</data>'), data("edge", df, props), F.lit("</edge>")).alias("line")))
    return out


def dot(graph: Graph) -> DataFrame:
    """(part, line): a DOT document."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    out = graph.spark.createDataFrame([(0, "digraph g {"), (3, "}")], "part int, line string")
    for name, df in sorted(graph.nodes.items()):
        out = out.unionByName(df.select(F.lit(1).alias("part"), F.concat(quoted("id"), F.lit(f' [kind="{name}"];')).alias("line")))
    for name, df in sorted(graph.rels.items()):
        out = out.unionByName(df.select(F.lit(2).alias("part"), F.concat(quoted("src"), F.lit(" -> "), quoted("dst"), F.lit(f' [label="{name}"];')).alias("line")))
    return out


def page(graph: Graph, most: int = MOST_IN_PAGE) -> str:
    """One HTML page with a graph's records, for graphs of up to ``most`` nodes."""
    n = sum(df.count() for df in graph.nodes.values())
    if n > most:
        raise ValueError(f"{n} nodes; a page holds {most}")
    data = {"nodes": [r.asDict() for r in node_records(graph).collect()], "relationships": [r.asDict() for r in rel_records(graph).collect()]}
    told = json.dumps(data).replace("<", "\\u003c")
    return f'<!doctype html><meta charset="utf-8"><title>Graph</title><pre id="g"></pre><script>const g={told};document.getElementById("g").textContent=JSON.stringify(g,null,1)</script>'


def neighbourhood(graph: Graph, ids: DataFrame, depth: int) -> Graph:
    """The part of a graph within ``depth`` steps of ids, either way."""
    e = graph.edges().select("src", "dst")
    near = bfs(e.unionByName(turned(e)), ids, depth).select("id")
    nodes = {k: df.join(near, "id", "left_semi") for k, df in graph.nodes.items()}
    src, dst = near.select(F.col("id").alias("src")), near.select(F.col("id").alias("dst"))
    rels = {k: df.join(src, "src", "left_semi").join(dst, "dst", "left_semi").select(*df.columns) for k, df in graph.rels.items()}
    return Graph(graph.spark, graph.schema, nodes, rels)


def rolled_up(edges: DataFrame, group: DataFrame) -> DataFrame:
    """(src, dst, kind) and (id, folder) -> (from, to, kind, n) between folders."""
    a = group.select(F.col("id").alias("src"), F.col("folder").alias("from"))
    b = group.select(F.col("id").alias("dst"), F.col("folder").alias("to"))
    return edges.join(a, "src").join(b, "dst").groupBy("from", "to", "kind").agg(F.count(F.lit(1)).alias("n"))


