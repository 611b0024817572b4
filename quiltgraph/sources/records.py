"""Graphs from JSON-lines records: {kind: node, id, label, properties} and {kind: rel, from, type, to, properties}."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators.storage import written
from ..schema import GraphSchema, NodeTable, RelTable

RECORD = "kind string, id string, label string, `from` string, `type` string, `to` string, properties string"
JSON_TYPES = {"BIGINT": "INT64", "BOOLEAN": "BOOLEAN", "DOUBLE": "FLOAT"}
#: Logical types whose table depends on the source's label, and the suffix of each label (others: FILE).
BY_SOURCE = ("USES_ENV", "CONSUMES_CONFIG", "DECLARES_CONFIG", "ACCESSES_DATA", "READS", "WRITES")
SUFFIX = {"Repo": "REPO", "Route": "ROUTE", "EntryPoint": "ENTRYPOINT", "Function": "FUNCTION"}


def records(spark: SparkSession, path: str) -> DataFrame:
    """One row a record; other kinds of lines are left out."""
    lines = spark.read.text(path).select(F.from_json("value", RECORD).alias("r")).select("r.*")
    return lines.filter(F.col("kind").isin("node", "rel"))


def _properties(df: DataFrame, by: list[str]) -> dict[tuple, dict[str, str]]:
    """Property types of each table, from one aggregate over its JSON objects."""
    told = df.groupBy(*by).agg(F.schema_of_variant_agg(F.parse_json(F.coalesce("properties", F.lit("{}")))).alias("s")).collect()
    out = {}
    for r in told:
        inner = re.match(r"OBJECT<(.*)>$", r.s, re.S)
        fields: dict[str, str] = {}
        depth, start, parts = 0, 0, []
        text = inner[1] if inner else ""
        for i, c in enumerate(text + ","):
            depth += (c in "<(") - (c in ">)")
            if c == "," and depth == 0:
                parts.append(text[start:i])
                start = i + 1
        for p in filter(None, map(str.strip, parts)):
            name, kind = p.split(":", 1)
            if name.strip("` ") != "id":
                fields[name.strip("` ")] = JSON_TYPES.get(kind.strip(), "STRING")
        out[tuple(r[b] for b in by)] = fields
    return out


def _table(df: DataFrame, fixed: list, props: dict[str, str]) -> DataFrame:
    ddl = {"INT64": "bigint", "BOOLEAN": "boolean", "FLOAT": "double", "STRING": "string"}
    if not props:
        return df.select(*fixed)
    p = F.from_json("properties", ", ".join(f"`{n}` {ddl[t]}" for n, t in props.items()))
    return df.withColumn("__p", p).select(*fixed, *[F.col(f"__p.`{n}`").alias(n) for n in props])


def graph_of(spark: SparkSession, rows: DataFrame, base: GraphSchema | None = None) -> Graph:
    """A graph whose schema is that of the records, with ``base``'s tables there even if empty.

    Relationships whose type goes with several labels are split into a table each; ones with an end
    that isn't there are dropped; of nodes with one id the least record stays.
    """
    rows = written(rows)
    nodes = rows.filter("kind = 'node'").groupBy("id").agg(F.min(F.struct("label", "properties")).alias("n")).select("id", "n.*")
    nodes = written(nodes)
    ends = nodes.select("id", "label")
    rels = rows.filter("kind = 'rel'").select("from", "type", "to", "properties").distinct()
    rels = rels.join(ends.select(F.col("id").alias("from"), F.col("label").alias("source")), "from").join(ends.select(F.col("id").alias("to"), F.col("label").alias("target")), "to")
    split = F.col("type")
    suffix = F.lit("FILE")
    for label, s in SUFFIX.items():
        suffix = F.when(F.col("source") == label, s).otherwise(suffix)
    split = F.when(split.isin(*BY_SOURCE), F.concat_ws("_", split, suffix)).when(split == "RUNS", F.when(F.col("target") == "EntryPoint", "RUNS_ENTRYPOINT").otherwise("RUNS_FILE")).otherwise(split)
    rels = written(rels.withColumn("type", split))
    pairs = sorted((r["type"], r.source, r.target) for r in rels.select("type", "source", "target").distinct().collect())
    props = _properties(rels, ["type", "source", "target"])
    several = {t for t, _, _ in pairs if sum(x[0] == t for x in pairs) > 1}
    node_props = {k[0]: v for k, v in _properties(nodes, ["label"]).items()}
    for n in base.nodes.values() if base else ():
        node_props[n.label] = {**n.properties, **{k: v for k, v in node_props.get(n.label, {}).items() if k not in n.properties}}
    for t, a, b in pairs if base else ():
        if t in base.rels:
            told = base.rels[t].properties
            props[t, a, b] = {**told, **{k: v for k, v in props[t, a, b].items() if k not in told}}
    rel_tables = [RelTable(t if t not in several else f"{t}_{s}_{d}".upper(), s, d, props[t, s, d]) for t, s, d in pairs]
    known = {r.type for r in rel_tables}
    rel_tables += [r for r in base.rels.values() if r.type not in known] if base else []
    schema = GraphSchema([NodeTable(k, v) for k, v in sorted(node_props.items())], rel_tables)
    g = Graph(spark, schema)
    for label, p in node_props.items():
        g.nodes[label] = _table(nodes.filter(F.col("label") == label), ["id"], p)
    for (t, s, d), table in zip(pairs, rel_tables, strict=False):
        one = rels.filter((F.col("type") == t) & (F.col("source") == s) & (F.col("target") == d))
        key = F.concat_ws("|", F.lit(table.type), "from", "to", F.sha2(F.coalesce("properties", F.lit("")), 256)).alias("rel_id")
        g.rels[table.type] = _table(one, [key, F.col("from").alias("src"), F.col("to").alias("dst")], table.properties)
    return g


def read_graph(spark: SparkSession, path: str, base: GraphSchema | None = None) -> Graph:
    return graph_of(spark, records(spark, path), base)


def write_records(graph: Graph, path: str) -> None:
    """The records of a graph as JSON lines, one folder named uniquely below ``path``."""
    from .export import node_records, rel_records

    n = node_records(graph).select("kind", "id", "label", "properties")
    r = rel_records(graph).select("kind", "from", "type", "to", "properties")
    both = n.unionByName(r, allowMissingColumns=True)
    body = F.concat(F.lit('{"kind":"'), "kind", F.lit('",'), F.expr("substring(to_json(struct(id, label, `from`, `type`, `to`)), 2, 2147483647)"))
    line = F.concat(F.regexp_replace(body, r"\}$", ""), F.lit(',"properties":'), "properties", F.lit("}"))
    both.select(line.alias("value")).write.text(f"{path}/{uuid.uuid4().hex}")
