"""The property graph that is derived from the synthetic tables; every table is lazy and prunable."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import Graph, Tables
from ..schema import GraphSchema, NodeTable, RelTable

S, I, B, D, TS = "STRING", "INT64", "BOOLEAN", "FLOAT", "TIMESTAMP"

NODES = [
    NodeTable("Region", {"name": S}),
    NodeTable("Nation", {"name": S}),
    NodeTable("Customer", {"name": S, "mktsegment": S, "acctbal": D}),
    NodeTable("Supplier", {"name": S, "acctbal": D}),
    NodeTable("Part", {"name": S, "brand": S, "type": S, "size": I, "retailprice": D}),
    NodeTable("Order", {"status": S, "priority": S, "totalprice": D, "orderdate": TS}),
    NodeTable("User", {"name": S}),
    NodeTable("EventType", {"name": S}),
    NodeTable("Event", {"ts": TS, "value": D, "k": I}),
    NodeTable("Document", {"lang": S, "source": S, "n_chars": I}),
    NodeTable("Label", {"quality": I, "toxic": I}),
    NodeTable("Page", {"url": S, "path": S}),
    NodeTable("Host", {"name": S}),
    NodeTable("Conversation", {}),
    NodeTable("Message", {"role": S, "turn": I}),
]
LINE = {"linenumber": I, "quantity": D, "extendedprice": D, "discount": D, "tax": D, "returnflag": S, "linestatus": S, "shipdate": TS, "suppkey": I}
RELS = [
    RelTable("IN_REGION", "Nation", "Region"),
    RelTable("CUSTOMER_IN_NATION", "Customer", "Nation"),
    RelTable("SUPPLIER_IN_NATION", "Supplier", "Nation"),
    RelTable("PLACED", "Customer", "Order"),
    RelTable("LINE", "Order", "Part", LINE),
    RelTable("SUPPLIES", "Supplier", "Part"),
    RelTable("PART_FLOW", "Part", "Part"),
    RelTable("TRADES", "Nation", "Nation"),
    RelTable("DID", "User", "Event"),
    RelTable("HAS_TYPE", "Event", "EventType"),
    RelTable("NEXT_EVENT", "Event", "Event"),
    RelTable("TRANSITION", "EventType", "EventType", {"count": I}),
    RelTable("LABELLED", "Document", "Label"),
    RelTable("ON_HOST", "Page", "Host"),
    RelTable("SAYS", "Conversation", "Message"),
    RelTable("NEXT_MESSAGE", "Message", "Message"),
]
SCHEMA = GraphSchema(NODES, RELS)


def _id(label: str, *keys: Column | str) -> Column:
    return F.concat_ws(":", F.lit(label.lower()), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys])


def _edge(df: DataFrame, kind: str, src: Column, dst: Column, rel: Column | None = None, **props: Column) -> DataFrame:
    d = df.select(src.alias("src"), dst.alias("dst"), *[c.alias(p) for p, c in props.items()], *([rel.alias("rel_id")] if rel is not None else []))
    if rel is None:
        d = d.withColumn("rel_id", F.concat_ws("|", F.lit(kind), "src", "dst"))
    return d.select("rel_id", "src", "dst", *props)


def part_flow(lineitem: DataFrame) -> DataFrame:
    """(a, b): the next part in the same order, distinct, without loops."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    pairs = lineitem.select(F.col("l_partkey").alias("a"), F.lead("l_partkey").over(w).alias("b"))
    return pairs.filter("b is not null and a <> b").distinct()


def derived_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph over a folder of tables. A table is opened when a query first asks for it."""
    t = functools.cache(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    host = lambda: F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1)
    path = lambda: F.regexp_extract("url", r"^[a-z]+://[^/]+(.*)$", 1)

    def nexts() -> DataFrame:
        in_order = Window.partitionBy("user_id").orderBy("ts", "event_id")
        e = t("events").select("event_id", "event_type", F.lead("event_id").over(in_order).alias("n_id"), F.lead("event_type").over(in_order).alias("n_type"))
        return e.filter("n_id is not null")

    def transitions() -> DataFrame:
        return nexts().groupBy("event_type", "n_type").agg(F.count(F.lit(1)).alias("n"))

    def trades() -> DataFrame:
        d = t("lineitem").select("l_orderkey", "l_suppkey").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        d = d.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        return d.join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).select("s_nationkey", "c_nationkey").distinct()

    nodes = {
        "Region": lambda: t("region").select(_id("region", "r_regionkey").alias("id"), F.col("r_name").alias("name")),
        "Nation": lambda: t("nation").select(_id("nation", "n_nationkey").alias("id"), F.col("n_name").alias("name")),
        "Customer": lambda: t("customer").select(_id("customer", "c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("mktsegment"), F.col("c_acctbal").alias("acctbal")),
        "Supplier": lambda: t("supplier").select(_id("supplier", "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal")),
        "Part": lambda: t("part").select(_id("part", "p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").cast("long").alias("size"), F.col("p_retailprice").alias("retailprice")),
        "Order": lambda: t("orders").select(_id("order", "o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("totalprice"), F.col("o_orderdate").alias("orderdate")),
        "User": lambda: t("events").select(_id("user", "user_id").alias("id"), F.col("user_id").cast("string").alias("name")).distinct(),
        "EventType": lambda: t("events").select(_id("eventtype", "event_type").alias("id"), F.col("event_type").alias("name")).distinct(),
        "Event": lambda: t("events").select(_id("event", "event_id").alias("id"), "ts", "value", F.get_json_object("props", "$.k").cast("long").alias("k")),
        "Document": lambda: t("documents").select(_id("document", "doc_id").alias("id"), "lang", "source", F.col("n_chars").cast("long").alias("n_chars")),
        "Label": lambda: t("labels").select(_id("label", "doc_id").alias("id"), F.col("quality").cast("long").alias("quality"), F.col("toxic").cast("long").alias("toxic")),
        "Page": lambda: t("pages").select(_id("page", "page_id").alias("id"), "url", path().alias("path")),
        "Host": lambda: t("pages").select(_id("host", host()).alias("id"), host().alias("name")).distinct(),
        "Conversation": lambda: t("conversations").select(_id("conversation", "conv_id").alias("id")).distinct(),
        "Message": lambda: t("conversations").select(_id("message", "conv_id", "turn").alias("id"), "role", F.col("turn").cast("long").alias("turn")),
    }
    rels = {
        "IN_REGION": lambda: _edge(t("nation"), "IN_REGION", _id("nation", "n_nationkey"), _id("region", "n_regionkey")),
        "CUSTOMER_IN_NATION": lambda: _edge(t("customer"), "CUSTOMER_IN_NATION", _id("customer", "c_custkey"), _id("nation", "c_nationkey")),
        "SUPPLIER_IN_NATION": lambda: _edge(t("supplier"), "SUPPLIER_IN_NATION", _id("supplier", "s_suppkey"), _id("nation", "s_nationkey")),
        "PLACED": lambda: _edge(t("orders"), "PLACED", _id("customer", "o_custkey"), _id("order", "o_orderkey")),
        "LINE": lambda: _edge(
            t("lineitem"), "LINE", _id("order", "l_orderkey"), _id("part", "l_partkey"), F.concat_ws("|", F.lit("LINE"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in t("lineitem").columns]),
            linenumber=F.col("l_linenumber").cast("long"), quantity=F.col("l_quantity"), extendedprice=F.col("l_extendedprice"), discount=F.col("l_discount"), tax=F.col("l_tax"),
            returnflag=F.col("l_returnflag"), linestatus=F.col("l_linestatus"), shipdate=F.col("l_shipdate"), suppkey=F.col("l_suppkey"),
        ),
        "SUPPLIES": lambda: _edge(t("lineitem").select("l_suppkey", "l_partkey").distinct(), "SUPPLIES", _id("supplier", "l_suppkey"), _id("part", "l_partkey")),
        "PART_FLOW": lambda: _edge(part_flow(t("lineitem")), "PART_FLOW", _id("part", "a"), _id("part", "b")),
        "TRADES": lambda: _edge(trades(), "TRADES", _id("nation", "s_nationkey"), _id("nation", "c_nationkey")),
        "DID": lambda: _edge(t("events"), "DID", _id("user", "user_id"), _id("event", "event_id")),
        "HAS_TYPE": lambda: _edge(t("events"), "HAS_TYPE", _id("event", "event_id"), _id("eventtype", "event_type")),
        "NEXT_EVENT": lambda: _edge(nexts(), "NEXT_EVENT", _id("event", "event_id"), _id("event", "n_id")),
        "TRANSITION": lambda: _edge(transitions(), "TRANSITION", _id("eventtype", "event_type"), _id("eventtype", "n_type"), count=F.col("n")),
        "LABELLED": lambda: _edge(t("labels"), "LABELLED", _id("document", "doc_id"), _id("label", "doc_id")),
        "ON_HOST": lambda: _edge(t("pages"), "ON_HOST", _id("page", "page_id"), _id("host", host())),
        "SAYS": lambda: _edge(t("conversations"), "SAYS", _id("conversation", "conv_id"), _id("message", "conv_id", "turn")),
        "NEXT_MESSAGE": lambda: _edge(t("conversations").select("conv_id", "turn").join(t("conversations").select(F.col("conv_id").alias("c2"), F.col("turn").alias("t2")), (F.col("conv_id") == F.col("c2")) & (F.col("turn") + 1 == F.col("t2"))), "NEXT_MESSAGE", _id("message", "conv_id", "turn"), _id("message", "c2", "t2")),
    }
    return Graph(spark, SCHEMA, Tables(nodes), Tables(rels))


#: The part flow as DuckDB SQL, for oracles: (a, b) part keys.
FLOW_SQL = """flow AS (SELECT DISTINCT a, b FROM (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b FROM lineitem)
  WHERE b IS NOT NULL AND a <> b)"""
