"""Registered code-graph tools over the derived code graph, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codegraph, codeimpact
from .sources.derived_code import CODE_SQL, derived_code

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NAME = "cold widget"
#: Lines of a unified diff: changed lines of two files, one new file's lines and a file that isn't in the graph.
DIFF = ["--- a/src/n{0}/1.ts", "+++ b/src/n{0}/1.ts", "@@ -20,2 +20,31 @@", "@@ -90 +119,0 @@", "--- a/lib/other.ts", "+++ b/lib/other.ts", "@@ -1 +1 @@"]


def registered(oracle: str | None = None, recursive: str = ""):
    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{CODE_SQL}{', ' + recursive if recursive else ''} {oracle}"
        return f

    return put


def _listed(lists: dict[str, DataFrame]) -> DataFrame:
    """(list, id, depth) of an impact's lists."""
    return reduce(DataFrame.unionByName, [d.select(F.lit(k).alias("list"), "id", "depth") for k, d in lists.items()])


UP = """up(v, d) AS (SELECT p, 0 FROM seed UNION SELECT a, d + 1 FROM up JOIN flow ON v = b WHERE d < 2), r AS (SELECT v AS p, min(d) AS d FROM up GROUP BY v)"""
IMPACT = """SELECT 'callers' AS list, 'fn:' || p AS id, d::INT AS depth FROM r WHERE d > 0
  UNION ALL SELECT 'routes', 'route:' || c, d::INT FROM handled JOIN r USING (p)
  UNION ALL SELECT 'apiConsumers', 'req:' || e, min(d)::INT FROM req JOIN handled USING (c) JOIN r USING (p) GROUP BY e
  UNION ALL SELECT DISTINCT 'tables', 'table:' || n, 0 FROM io JOIN seed USING (p)
  UNION ALL SELECT DISTINCT 'envVars', 'env:' || event_type, 0 FROM env JOIN seed USING (p)"""


@registered(f"SELECT id, 'function' AS kind, name, file, line, exported FROM fn WHERE name = '{NAME}'")
def code_find_definitions(spark, sf):
    return codegraph.find_definitions(derived_code(spark, sf), NAME)


@registered(f"SELECT 'fn:' || a AS caller, 'function' AS kind, 'fn:' || b AS target, a AS line FROM flow JOIN part ON b = p_partkey WHERE p_name = '{NAME}'")
def code_find_callers(spark, sf):
    return codegraph.find_callers(derived_code(spark, sf), NAME)


@registered("SELECT id, 'function' AS kind, name, file, line, exported FROM fn WHERE exported AND file LIKE 'src/n1/%'")
def code_list_exports(spark, sf):
    return codegraph.list_exports(derived_code(spark, sf), "src/n1")


@registered("SELECT 'route:' || c AS id, c_mktsegment AS method, '/api/c/' || c AS path, NULL::VARCHAR AS framework, file.path AS file, count(e)::BIGINT AS consumers FROM handled JOIN customer ON c = c_custkey JOIN own USING (p) JOIN file ON f = k LEFT JOIN (SELECT c, e FROM req) USING (c) GROUP BY ALL")
def code_list_routes(spark, sf):
    return codegraph.list_routes(derived_code(spark, sf))


@registered("SELECT 'route:' || c AS route, 'req:' || e AS call, '/api/c/' || c AS url, 'exact' AS match, 'fn:' || p_partkey AS function FROM req LEFT JOIN part ON k = p_partkey")
def code_api_consumers(spark, sf):
    return codegraph.api_consumers(derived_code(spark, sf))


@registered("SELECT event_type AS name, count(DISTINCT env.p)::BIGINT AS readers, false AS declared FROM (SELECT DISTINCT event_type FROM events) LEFT JOIN env USING (event_type) GROUP BY event_type")
def code_list_env(spark, sf):
    return codegraph.list_env(derived_code(spark, sf))


@registered("SELECT n_name AS name, count(DISTINCT p) FILTER (reads)::BIGINT AS readers, count(DISTINCT p) FILTER (NOT reads)::BIGINT AS writers FROM nation LEFT JOIN io ON n = n_nationkey GROUP BY n_nationkey, n_name")
def code_list_tables(spark, sf):
    return codegraph.list_tables(derived_code(spark, sf))


@registered(f"""SELECT DISTINCT 'call' AS kind, 'fn:' || a AS id, fn.id AS ref, a AS line FROM flow JOIN fn ON b = p WHERE name = '{NAME}'
  UNION ALL SELECT 'route', 'route:' || c, id, NULL FROM handled JOIN fn USING (p) WHERE name = '{NAME}'
  UNION ALL SELECT 'import', 'file:' || s, id, s FROM imp JOIN fn ON d = f WHERE name = '{NAME}' AND exported""")
def code_find_references(spark, sf):
    return codeimpact.find_references(derived_code(spark, sf), NAME)


@registered(IMPACT, f"seed AS (SELECT p FROM fn WHERE name = '{NAME}'), {UP}")
def code_impact(spark, sf):
    return _listed(codeimpact.impact_of(derived_code(spark, sf), NAME, depth=2))


@registered(
    "SELECT 'changedSymbols' AS list, 'fn:' || p AS id, NULL::INT AS depth FROM seed UNION ALL SELECT 'affectedTests', id, d::INT FROM tests JOIN file ON v = k WHERE test"
    " UNION ALL SELECT 'unscannedFiles', 'lib/other.ts', NULL UNION ALL " + IMPACT,
    f"""seed AS (SELECT p FROM fn WHERE file LIKE '%/1.ts' AND f = 1 AND (line <= 50 AND end_line >= 20 OR line <= 119 AND end_line >= 119)), {UP},
  t(v, d) AS (SELECT 1::BIGINT, 0 UNION SELECT s, t.d + 1 FROM t JOIN imp ON v = imp.d WHERE t.d < 20), tests AS (SELECT v, min(d) AS d FROM t GROUP BY v)""",
)
def code_detect_changes(spark, sf):
    g = derived_code(spark, sf)
    # The folder of file 1 differs with the tables; its path is read where the diff is made.
    at = g.node_table("File").filter("id = 'file:1'").select(F.regexp_extract("relativePath", r"^src/n(\d+)/", 1).alias("n0"))
    lines = at.select("n0", F.posexplode(F.array(*map(F.lit, DIFF))).alias("n", "l")).select(F.lit("working tree").alias("diff"), "n", F.replace("l", F.lit("{0}"), "n0").alias("line"))
    out = codeimpact.detect_changes(g, lines, depth=2)
    none = F.lit(None).cast("int")
    lists = {k: d for k, d in out.items() if k not in ("changedFiles", "unscannedFiles", "changedSymbols", "affectedTests")}
    lists |= {"changedSymbols": out["changedSymbols"].select("id", none.alias("depth")), "affectedTests": out["affectedTests"].select("id", "depth"), "unscannedFiles": out["unscannedFiles"].select(F.col("file").alias("id"), none.alias("depth"))}
    return _listed(lists)


@registered("SELECT file, 'function' AS kind, name, line, NULL::VARCHAR AS owner FROM fn WHERE file LIKE 'src/n1/%' UNION ALL SELECT path, 'import', 'file:' || d, s, NULL FROM imp JOIN file ON s = k WHERE path LIKE 'src/n1/%'")
def code_file_outline(spark, sf):
    return codeimpact.file_outline(derived_code(spark, sf), "src/n1")


@registered(r"SELECT doc_id, doc_id % 5 + 1 AS line, doc_id % 5 + 1 + quality AS end_line, CASE WHEN text IS NOT NULL THEN coalesce(array_to_string(list_slice(regexp_split_to_array(text, '\r?\n'), (doc_id % 5 + 1)::INT, (doc_id % 5 + 1 + quality)::INT), chr(10)), '') END AS source FROM labels LEFT JOIN documents USING (doc_id)")
def code_symbol_source(spark, sf):
    """Documents as files, and for each label a declaration of one line or two in its document."""
    t = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    line = F.col("doc_id") % 5 + 1
    spans = t("labels").select(F.col("doc_id").alias("file"), line.alias("line"), (line + F.col("quality")).alias("end_line"))
    return codeimpact.symbol_source(spans, t("documents").select(F.col("doc_id").alias("file"), "text")).withColumnRenamed("file", "doc_id")


@registered("SELECT fn.id, name, 'file:' || f AS file FROM fn JOIN file ON f = k WHERE exported AND NOT test AND p NOT IN (SELECT b FROM flow) AND p NOT IN (SELECT p FROM handled) AND f NOT IN (SELECT d FROM imp)")
def code_unused_exports(spark, sf):
    return codegraph.unused_exports(derived_code(spark, sf))


@registered("SELECT x.folder AS \"from\", y.folder AS \"to\", count(*)::BIGINT AS imports FROM imp JOIN (SELECT k, string_split(path, '/')[2] AS folder FROM file) x ON s = x.k JOIN (SELECT k, string_split(path, '/')[2] AS folder FROM file) y ON d = y.k GROUP BY ALL")
def code_architecture(spark, sf):
    return codegraph.architecture(derived_code(spark, sf), 2)[1].select(F.element_at(F.split("from", "/"), -1).alias("from"), F.element_at(F.split("to", "/"), -1).alias("to"), "imports")


@registered(f"SELECT id, 'function' AS kind, name, file, line, (SELECT count(DISTINCT a) FROM flow WHERE b = p)::BIGINT AS callers, (SELECT count(DISTINCT b) FROM flow WHERE a = p)::BIGINT AS callees FROM fn WHERE name = '{NAME}'")
def code_explore(spark, sf):
    return codeimpact.explore(derived_code(spark, sf), [NAME], 2)["symbols"]


@registered(
    "SELECT 'route:' || c AS route, 'fn:' || v AS id, min(d)::INT AS depth FROM t GROUP BY c, v",
    "t(c, v, d) AS (SELECT c, p, 0 FROM handled UNION SELECT c, b, d + 1 FROM t JOIN flow ON v = a WHERE d < 1)",
)
def code_route_chains(spark, sf):
    return codeimpact.routes_in_detail(derived_code(spark, sf), 1)["chain"]
