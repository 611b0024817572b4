"""A code graph that is derived from the synthetic tables, for the tools of ``codegraph`` and ``codeimpact``.

Suppliers stand for files, parts for functions (of the least supplier that ships them), the part flow for
calls and imports, customers for routes, events for requests and environment reads, nations for tables.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..codegraph import CODE
from ..graph import Graph, Tables
from .derived import FLOW_SQL, part_flow


def _rel(df: DataFrame, src, dst, **props) -> DataFrame:
    d = df.select(src.alias("src"), dst.alias("dst"), *[c.alias(p) for p, c in props.items()]).distinct()
    return d.select(F.concat_ws("|", "src", "dst", *props).alias("rel_id"), "src", "dst", *props)


def _id(label: str, *keys: str):
    return F.concat_ws(":", F.lit(label), *[F.col(k).cast("string") for k in keys])


def derived_code(spark: SparkSession, sf_dir: str) -> Graph:
    t = functools.cache(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    null = lambda kind: F.lit(None).cast(kind)

    @functools.cache
    def owner() -> DataFrame:
        return t("lineitem").groupBy(F.col("l_partkey").alias("p")).agg(F.min("l_suppkey").alias("f"))

    @functools.cache
    def calls() -> DataFrame:
        return part_flow(t("lineitem"))

    def imports() -> DataFrame:
        e = calls().join(owner().select(F.col("p").alias("a"), F.col("f").alias("s")), "a").join(owner().select(F.col("p").alias("b"), F.col("f").alias("d")), "b")
        return e.filter("s <> d").select("s", "d").distinct()

    def handled() -> DataFrame:
        d = t("orders").select("o_orderkey", F.col("o_custkey").alias("c")).join(t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey"), "o_orderkey")
        return d.groupBy("c").agg(F.min("l_partkey").alias("p"))

    def requests() -> DataFrame:
        e = t("events").select("event_id", F.col("user_id").alias("c"), "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
        return e.join(t("customer").select(F.col("c_custkey").alias("c")), "c")

    def env() -> DataFrame:
        e = t("events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("p"))
        return e.join(t("part").select(F.col("p_partkey").alias("p")), "p", "left_semi").distinct()

    def shipped(flag: str) -> DataFrame:
        d = t("lineitem").filter(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s_suppkey")).distinct()
        return d.join(t("supplier").select("s_suppkey", F.col("s_nationkey").alias("n")), "s_suppkey").select("p", "n")

    request_calls = lambda: requests().select(_id("req", "event_id").alias("id"), null("string").alias("name"), null("string").alias("callee"), F.col("event_id").alias("line"), F.lit("GET").alias("httpMethod"), F.concat(F.lit("/api/c/"), F.col("c").cast("string")).alias("httpUrl"))
    function_calls = lambda: calls().select(_id("call", "a", "b").alias("id"), null("string").alias("name"), _id("fn", "b").alias("callee"), F.col("a").alias("line"), null("string").alias("httpMethod"), null("string").alias("httpUrl"))
    nodes = {
        "File": lambda: t("supplier").select(_id("file", "s_suppkey").alias("id"), F.concat(F.lit("src/n"), F.col("s_nationkey").cast("string"), F.lit("/"), F.col("s_suppkey").cast("string"), F.lit(".ts")).alias("relativePath"), F.lit("typescript").alias("language"), (F.col("s_suppkey") % 10 == 0).alias("isTest"), null("string").alias("unresolvedCalls")),
        "Function": lambda: t("part").select(_id("fn", "p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_partkey").alias("line"), (F.col("p_partkey") + F.col("p_size")).cast("long").alias("endLine"), (F.col("p_size") % 2 == 0).alias("isExported"), null("string").alias("className"), null("string").alias("kind")),
        "Call": lambda: function_calls().unionByName(request_calls()),
        "Import": lambda: imports().select(_id("imp", "s", "d").alias("id"), _id("file", "d").alias("source"), F.col("s").alias("line"), ((F.col("s") + F.col("d")) % 4 == 0).alias("isTypeOnly")),
        "Route": lambda: t("customer").select(_id("route", "c_custkey").alias("id"), F.col("c_mktsegment").alias("method"), F.concat(F.lit("/c/"), F.col("c_custkey").cast("string")).alias("path"), F.concat(F.lit("/api/c/"), F.col("c_custkey").cast("string")).alias("fullPath"), null("string").alias("framework"), F.col("c_custkey").alias("line")),
        "EnvVar": lambda: t("events").select(_id("env", "event_type").alias("id"), F.col("event_type").alias("name")).distinct(),
        "Table": lambda: t("nation").select(_id("table", "n_nationkey").alias("id"), F.col("n_name").alias("name"), null("string").alias("library")),
    }
    rels = {
        "DEFINES_FUNCTION": lambda: _rel(owner(), _id("file", "f"), _id("fn", "p")),
        "CALLS": lambda: _rel(calls(), _id("fn", "a"), _id("call", "a", "b")).unionByName(_rel(requests().join(t("part").select(F.col("p_partkey").alias("k")), "k", "left_semi"), _id("fn", "k"), _id("req", "event_id"))),
        "CALL_RESOLVES_TO": lambda: _rel(calls(), _id("call", "a", "b"), _id("fn", "b"), via=null("string"), provenance=F.when((F.col("a") + F.col("b")) % 3 == 0, "by-name").when((F.col("a") + F.col("b")) % 3 == 1, "inferred").otherwise("exact")),
        "IMPORTS": lambda: _rel(imports(), _id("file", "s"), _id("imp", "s", "d")),
        "RESOLVES_TO": lambda: _rel(imports(), _id("imp", "s", "d"), _id("file", "d")),
        "DECLARES_ROUTE": lambda: _rel(handled().join(owner(), "p"), _id("file", "f"), _id("route", "c")),
        "ROUTE_HANDLED_BY": lambda: _rel(handled(), _id("route", "c"), _id("fn", "p")),
        "REQUESTS": lambda: _rel(requests(), _id("req", "event_id"), _id("route", "c"), method=F.lit("GET"), url=F.concat(F.lit("/api/c/"), F.col("c").cast("string")), match=F.lit("exact")),
        "USES_ENV_FUNCTION": lambda: _rel(env(), _id("fn", "p"), _id("env", "event_type")),
        "READS_FUNCTION": lambda: _rel(shipped("R"), _id("fn", "p"), _id("table", "n")),
        "WRITES_FUNCTION": lambda: _rel(shipped("A"), _id("fn", "p"), _id("table", "n")),
    }
    return Graph(spark, CODE, Tables(nodes), Tables(rels))


#: The same graph as DuckDB SQL, for oracles.
CODE_SQL = f"""{FLOW_SQL}, own AS (SELECT l_partkey AS p, min(l_suppkey) AS f FROM lineitem GROUP BY l_partkey),
  file AS (SELECT s_suppkey AS k, 'file:' || s_suppkey AS id, 'src/n' || s_nationkey || '/' || s_suppkey || '.ts' AS path, s_suppkey % 10 = 0 AS test FROM supplier),
  fn AS (SELECT p_partkey AS p, 'fn:' || p_partkey AS id, p_name AS name, p_partkey AS line, p_partkey + p_size AS end_line, p_size % 2 = 0 AS exported, f, path AS file FROM part JOIN own ON p = p_partkey JOIN file ON k = f),
  imp AS (SELECT DISTINCT x.f AS s, y.f AS d FROM flow JOIN own x ON a = x.p JOIN own y ON b = y.p WHERE x.f <> y.f),
  handled AS (SELECT o_custkey AS c, min(l_partkey) AS p FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey),
  req AS (SELECT event_id AS e, user_id AS c, event_type, (props->>'$.k')::BIGINT AS k FROM events JOIN customer ON user_id = c_custkey),
  env AS (SELECT DISTINCT event_type, (props->>'$.k')::BIGINT AS p FROM events JOIN part ON (props->>'$.k')::BIGINT = p_partkey),
  io AS (SELECT DISTINCT l_partkey AS p, s_nationkey AS n, l_returnflag = 'R' AS reads FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag IN ('R', 'A'))"""
