"""Registered algorithm, analysis and function queries over the derived graph, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import diffs, names, paths, routes, sqltext
from .graph import first_by_id
from .operators import components, tools, traverse
from .sources import export
from .sources.derived import FLOW_SQL, derived_graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def registered(oracle: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


def flow(spark: SparkSession, sf: str) -> DataFrame:
    return derived_graph(spark, sf).rel_table("PART_FLOW").select("src", "dst")


def brand(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return derived_graph(spark, sf).node_table("Part").filter(F.col("brand") == name).select("id")


def hops(n: int, a: str, b: str, first: str) -> str:
    """Recursive SQL: distinct (node, depth) up to n steps along flow a -> b from ``first``."""
    return f"WITH RECURSIVE {FLOW_SQL}, w(v, d) AS (SELECT p_partkey, 0 FROM part WHERE {first} UNION SELECT {b}, d + 1 FROM w JOIN flow ON v = {a} WHERE d < {n})"


@registered(hops(4, "a", "b", "p_brand = 'Brand#11'") + " SELECT 'part:' || v AS id, min(d)::INT AS depth FROM w GROUP BY v")
def bfs_down_depth(spark, sf):
    return traverse.bfs(flow(spark, sf), brand(spark, sf, "Brand#11"), 4)


@registered(hops(4, "b", "a", "p_brand = 'Brand#12'") + " SELECT 'part:' || v AS id, min(d)::INT AS depth FROM w GROUP BY v")
def bfs_up_depth(spark, sf):
    return traverse.bfs(flow(spark, sf), brand(spark, sf, "Brand#12"), 4, up=True)


@registered(
    hops(5, "a", "b", "p_brand = 'Brand#13'")
    + """, m AS (SELECT v, min(d) AS d FROM w GROUP BY v) SELECT 'part:' || m.v AS id, m.d::INT AS depth, min('part:' || a) FILTER (x.d = m.d - 1) AS via
    FROM m LEFT JOIN flow ON m.v = b LEFT JOIN m x ON x.v = a GROUP BY m.v, m.d"""
)
def multi_source_min_depth_via(spark, sf):
    return traverse.bfs_with_via(flow(spark, sf), brand(spark, sf, "Brand#13"), 5)


def _strong(spark, sf):
    key = lambda c: F.regexp_extract(c, r"(\d+)$", 1).cast("long")
    return flow(spark, sf).withColumn("strength", (key("src") + key("dst")) % 7)


CHAINS = f"""WITH RECURSIVE {FLOW_SQL}, e AS (SELECT 'part:' || a AS a, 'part:' || b AS b, (a + b) % 7 AS s FROM flow),
  w(seed, v, d, path, weak) AS (SELECT 'part:' || p_partkey, 'part:' || p_partkey, 0, ['part:' || p_partkey], NULL::BIGINT FROM part WHERE p_brand = 'Brand#14'
  UNION ALL SELECT seed, b, d + 1, list_append(path, b), least(weak, s) FROM w JOIN e ON v = a WHERE d < 3 AND NOT list_contains(path, b)),
  m AS (SELECT seed, v, min(d) AS d FROM w GROUP BY ALL)"""


@registered(CHAINS + " SELECT seed, w.v AS id, w.d::INT AS depth, min(path) AS path FROM w JOIN m USING (seed, v, d) GROUP BY ALL")
def shortest_chain(spark, sf):
    return traverse.shortest_chains(_strong(spark, sf), brand(spark, sf, "Brand#14"), 3).select("seed", "id", "depth", "path")


@registered(CHAINS + " SELECT seed, w.v AS id, min(struct_pack(p := path, k := weak)).k::BIGINT AS weakest FROM w JOIN m USING (seed, v, d) WHERE w.d > 0 GROUP BY seed, w.v")
def weakest_link(spark, sf):
    return traverse.shortest_chains(_strong(spark, sf), brand(spark, sf, "Brand#14"), 3, paths=False).filter("depth > 0").select("seed", "id", "weakest")


@registered(f"WITH RECURSIVE {FLOW_SQL}, r AS (SELECT a, b FROM flow JOIN part ON a = p_partkey WHERE p_size = 1 UNION SELECT r.a, flow.b FROM r JOIN flow ON r.b = flow.a) SELECT 'part:' || a AS seed, 'part:' || b AS id FROM r")
def reachability(spark, sf):
    seeds = derived_graph(spark, sf).node_table("Part").filter("size = 1").select("id")
    return traverse.reachable(flow(spark, sf), seeds)


SCC_SQL = f"WITH RECURSIVE {FLOW_SQL}, r AS (SELECT a, b FROM flow UNION SELECT r.a, flow.b FROM r JOIN flow ON r.b = flow.a), s AS (SELECT x.a AS v, x.b AS u FROM r x JOIN r y ON x.a = y.b AND x.b = y.a)"


@registered(SCC_SQL + ", k AS (SELECT v, min('part:' || u) AS c, count(DISTINCT u) AS n FROM s GROUP BY v) SELECT 'part:' || v AS id, c AS component FROM k WHERE n > 1")
def scc(spark, sf):
    return components.scc(flow(spark, sf))


@registered()
def scc_shortest_cycle(spark, sf):
    e = flow(spark, sf)
    return components.shortest_cycles(e, components.scc(e))


@registered(f"WITH RECURSIVE {FLOW_SQL}, f AS (SELECT p_partkey AS v, p_type AS fact FROM part WHERE p_size >= 49 UNION SELECT a, fact FROM f JOIN flow ON v = b) SELECT 'part:' || v AS id, fact FROM f")
def propagate_fixpoint(spark, sf):
    facts = derived_graph(spark, sf).node_table("Part").filter("size >= 49").select("id", F.col("type").alias("fact"))
    return traverse.propagated(flow(spark, sf), facts).select("id", "fact")


@registered(
    f"""WITH {FLOW_SQL}, x AS (SELECT a AS v, b AS u, 1 AS o FROM flow UNION ALL SELECT b, a, 0 FROM flow), n AS (SELECT 'part:' || v AS id, (count(*) FILTER (o = 0))::BIGINT AS n_in, (count(*) FILTER (o = 1))::BIGINT AS n_out, count(DISTINCT u)::BIGINT AS neighbours FROM x GROUP BY v)
    SELECT * FROM n ORDER BY neighbours DESC, id LIMIT 25"""
)
def hubs_symbols(spark, sf):
    return traverse.degrees(flow(spark, sf)).orderBy(F.col("neighbours").desc(), "id").limit(25)


@registered(
    f"""WITH {FLOW_SQL}, g AS (SELECT x.p_brand AS a, y.p_brand AS b FROM flow JOIN part x ON a = x.p_partkey JOIN part y ON b = y.p_partkey WHERE x.p_brand <> y.p_brand),
    u AS (SELECT a AS v, b AS u FROM g UNION SELECT b, a FROM g) SELECT v AS id, count(DISTINCT u)::BIGINT AS neighbours FROM u GROUP BY v"""
)
def hubs_files(spark, sf):
    return traverse.degrees(_brands(spark, sf)).select("id", "neighbours")


def _brands(spark, sf):
    p = derived_graph(spark, sf).node_table("Part")
    e = flow(spark, sf).join(p.select(F.col("id").alias("src"), F.col("brand").alias("a")), "src").join(p.select(F.col("id").alias("dst"), F.col("brand").alias("b")), "dst")
    return e.select(F.col("a").alias("src"), F.col("b").alias("dst"))


@registered(f"WITH {FLOW_SQL} SELECT least(x.p_brand, y.p_brand) AS a, greatest(x.p_brand, y.p_brand) AS b, count(*)::BIGINT AS weight FROM flow JOIN part x ON flow.a = x.p_partkey JOIN part y ON flow.b = y.p_partkey WHERE x.p_brand <> y.p_brand GROUP BY 1, 2")
def weighted_pairs(spark, sf):
    return traverse.weighted_pairs(_brands(spark, sf))


@registered()
def louvain(spark, sf):
    return components.louvain(traverse.weighted_pairs(_brands(spark, sf)))


@registered()
def subsystem_stats(spark, sf):
    pairs = traverse.weighted_pairs(_brands(spark, sf))
    return components.communities_summary(components.louvain(pairs), pairs)


@registered(
    """WITH c AS (SELECT n_regionkey AS k, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), s AS (SELECT n_regionkey AS k, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1),
    o AS (SELECT n_regionkey AS k, count(*) AS n, sum((o_orderstatus = 'F')::INT) AS f FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
    SELECT r_name AS region, coalesce(c.n, 0)::BIGINT AS customers, coalesce(s.n, 0)::BIGINT AS suppliers, coalesce(o.n, 0)::BIGINT AS orders, coalesce(o.f, 0)::BIGINT AS finished FROM region LEFT JOIN c ON c.k = r_regionkey LEFT JOIN s ON s.k = r_regionkey LEFT JOIN o ON o.k = r_regionkey"""
)
def architecture_rollup(spark, sf):
    g = derived_graph(spark, sf)
    region = g.rel_table("IN_REGION").select(F.col("src").alias("nation"), F.col("dst").alias("region"))
    members = {"customers": "CUSTOMER_IN_NATION", "suppliers": "SUPPLIER_IN_NATION"}
    out = g.node_table("Region").select(F.col("id").alias("region"), F.col("name"))
    for name, kind in members.items():
        n = g.rel_table(kind).groupBy(F.col("dst").alias("nation")).agg(F.count(F.lit(1)).alias("k")).join(region, "nation").groupBy("region").agg(F.sum("k").alias(name))
        out = out.join(n, "region", "left")
    orders = g.rel_table("PLACED").join(g.node_table("Order").select(F.col("id").alias("dst"), "status"), "dst").groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "F").alias("f"))
    home = g.rel_table("CUSTOMER_IN_NATION").select("src", F.col("dst").alias("nation")).join(region, "nation")
    out = out.join(orders.join(home, "src").groupBy("region").agg(F.sum("n").alias("orders"), F.sum("f").alias("finished")), "region", "left")
    return out.select(F.col("name").alias("region"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("customers", "suppliers", "orders", "finished")])


#: What each table of the graph holds, as SQL.
COUNTED = {
    "node": {"Region": "region", "Nation": "nation", "Customer": "customer", "Supplier": "supplier", "Part": "part", "Order": "orders", "User": "(SELECT DISTINCT user_id FROM events)", "EventType": "(SELECT DISTINCT event_type FROM events)",
             "Event": "events", "Document": "documents", "Label": "labels", "Page": "pages", "Host": "(SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/]+)', 1) FROM pages)", "Conversation": "(SELECT DISTINCT conv_id FROM conversations)", "Message": "conversations"},
    "rel": {"IN_REGION": "nation", "CUSTOMER_IN_NATION": "customer", "SUPPLIER_IN_NATION": "supplier", "PLACED": "orders", "LINE": "lineitem", "SUPPLIES": "(SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)", "PART_FLOW": "flow",
            "TRADES": "(SELECT DISTINCT s_nationkey, c_nationkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)", "DID": "events", "HAS_TYPE": "events",
            "NEXT_EVENT": "(SELECT lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n IS NOT NULL", "TRANSITION": "(SELECT DISTINCT * FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n IS NOT NULL)",
            "LABELLED": "labels", "ON_HOST": "pages", "SAYS": "conversations", "NEXT_MESSAGE": "conversations x JOIN conversations y ON x.conv_id = y.conv_id AND x.turn + 1 = y.turn"},
}


@registered(f"WITH {FLOW_SQL} " + " UNION ALL ".join(f"SELECT '{kind}' AS kind, '{name}' AS name, count(*)::BIGINT AS n FROM {table}" for kind, tables in COUNTED.items() for name, table in tables.items()))
def stats_by_label(spark, sf):
    return derived_graph(spark, sf).stats()


@registered("SELECT lang, source, list_sort(list(DISTINCT quality || '/' || toxic)) AS variants FROM documents JOIN labels USING (doc_id) GROUP BY lang, source")
def merge_rows(spark, sf):
    g = derived_graph(spark, sf)
    d = g.node_table("Document").join(g.rel_table("LABELLED"), F.col("id") == F.col("src")).join(g.node_table("Label").select(F.col("id").alias("dst"), "quality", "toxic"), "dst")
    return tools.merged(d.withColumn("marks", F.concat_ws("/", "quality", "toxic")), ["lang", "source"], ["marks"], "variants")


@registered("SELECT event_type AS type, list_sort(list(DISTINCT user_id::VARCHAR) FILTER (value < 50)) AS readers, list_sort(list(DISTINCT user_id::VARCHAR) FILTER (NOT value < 50)) AS writers FROM events GROUP BY event_type")
def summarize_rw(spark, sf):
    g = derived_graph(spark, sf)
    e = g.node_table("Event").select(F.col("id").alias("event"), F.col("value") < 50).toDF("event", "reads").join(g.rel_table("HAS_TYPE").select(F.col("src").alias("event"), F.col("dst").alias("t")), "event").join(g.rel_table("DID").select(F.col("dst").alias("event"), F.col("src").alias("u")), "event")
    some = lambda c: F.when(F.size(c) > 0, F.array_sort(c))
    user = F.regexp_replace("u", "^user:", "")
    return e.groupBy(F.regexp_replace("t", "^eventtype:", "").alias("type")).agg(some(F.collect_set(F.when(F.col("reads"), user))).alias("readers"), some(F.collect_set(F.when(~F.col("reads"), user))).alias("writers"))


@registered("SELECT user_id::VARCHAR AS id, arg_min(event_type, event_id) AS type FROM events GROUP BY user_id")
def first_seen_wins(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("type"), "event_id")
    return first_by_id(e, "event_id")


@registered("SELECT brand, name FROM (SELECT p_brand AS brand, p_name AS name, p_size, max(p_size) OVER (PARTITION BY p_brand) AS m, count(*) OVER (PARTITION BY p_brand, p_size) AS n FROM part) WHERE p_size = m AND n = 1")
def best_match_tie(spark, sf):
    p = derived_graph(spark, sf).node_table("Part")
    return tools.best_without_tie(p.select("brand", "name", "size"), ["brand"], F.col("size")).select("brand", "name")


PATHS = "SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+(.*)$', 1)[2:] AS path FROM pages"


def _paths(spark, sf):
    return derived_graph(spark, sf).node_table("Page").select("id", F.expr("substring(path, 2)").alias("path"))


@registered(
    f"""WITH p AS (SELECT DISTINCT path FROM ({PATHS})), o AS (SELECT DISTINCT split_part(path, '/', 1) AS owner FROM p WHERE contains(path, '/') AND length(split_part(path, '/', 1)) % 2 = 0)
    SELECT path, max(owner) AS owner FROM p LEFT JOIN o ON starts_with(path, owner || '/') GROUP BY path"""
)
def longest_prefix_owner(spark, sf):
    p = _paths(spark, sf).select("path").distinct()
    top = p.filter(F.col("path").contains("/")).select(F.substring_index("path", "/", 1).alias("owner")).filter(F.char_length("owner") % 2 == 0).distinct()
    return paths.longest_owner(p, top)


@registered("SELECT DISTINCT 'order:' || o_orderkey AS id FROM orders JOIN (VALUES ('F', 10, 40), ('O', 100, 100), ('O', 35, 60)) r(s, a, b) ON o_orderstatus = s AND a <= o_orderkey % 97 + 5 AND o_orderkey % 97 <= b")
def range_overlap(spark, sf):
    o = derived_graph(spark, sf).node_table("Order")
    n = F.regexp_extract("id", r"(\d+)$", 1).cast("long") % 97
    symbols = o.select("id", F.col("status").alias("file"), n.alias("line"), (n + 5).alias("end_line"))
    r = spark.createDataFrame([("F", 10, 40), ("O", 100, 100), ("O", 35, 60)], "file string, start long, end long")
    return diffs.touched(symbols, r).select("id")


@registered(f"SELECT 'page:' || page_id AS id, (path = 'en' OR ends_with(path, '/en')) AS file, (path = 'en' OR ends_with(path, '/en') OR starts_with(path, 'en/') OR contains(path, '/en/')) AS folder FROM ({PATHS})")
def path_suffix_match(spark, sf):
    p = _paths(spark, sf)
    return p.select("id", paths.matches_file(F.col("path"), "./en").alias("file"), paths.matches_file_or_directory(F.col("path"), "en/").alias("folder"))


@registered(f"SELECT 'page:' || page_id AS id, regexp_matches(path, '^[^/]*/[^/]*[02468]$') AS even, regexp_matches(path, '^(en|de)/.*$') AS lang, regexp_matches(path, '^([^/]*/)*[^/]*1[^/]$') AS deep FROM ({PATHS})")
def glob_match(spark, sf):
    p, c = _paths(spark, sf), F.col("path")
    return p.select("id", paths.matches_glob(c, "*/*[02468]").alias("even"), paths.matches_glob(c, "{en,de}/**").alias("lang"), paths.matches_glob(c, "**/*1?").alias("deep"))


@registered(
    """WITH p AS (SELECT 'part:' || p_partkey AS id, p_name AS name, lower(p_name) AS low, length(p_name) AS n FROM part)
    SELECT id, CASE WHEN name = 'part_1' THEN 'exact' WHEN low = 'part_1' THEN 'exact-ignore-case' WHEN starts_with(low, 'part_1') THEN 'prefix' END AS match,
    CASE WHEN low = 'part_1' AND name = 'part_1' THEN 6999 WHEN low = 'part_1' THEN 5999 ELSE 4000 + greatest(0, least(999, 999 - (n - 6) * 10)) END::BIGINT AS score FROM p WHERE starts_with(low, 'part_1')"""
)
def match_tier_score(spark, sf):
    p = derived_graph(spark, sf).node_table("Part")
    return p.select("id", names.match_score(F.col("name"), "part_1").alias("m")).select("id", "m.*").filter(F.col("match").isin("exact", "exact-ignore-case", "prefix"))


@registered("SELECT 'part:' || p_partkey AS id, regexp_extract_all(p_brand || p_type, '[A-Z]+|[A-Z]?[a-z]+|[0-9]+') AS words FROM (SELECT p_partkey, lower(p_brand) AS p_brand, '_' || lower(p_type) AS p_type FROM part)")
def identifier_words(spark, sf):
    p = derived_graph(spark, sf).node_table("Part")
    return p.select("id", names.identifier_words(F.concat(F.lower("brand"), F.lit("_"), F.lower("type"))).alias("words"))


@registered()
def question_rank(spark, sf):
    n = derived_graph(spark, sf).node_table("Nation").select("id", "name")
    return names.ranked(n, ["nation", "NATION_01", "1"])


@registered(f"SELECT DISTINCT array_to_string(list_slice(parts, 1, k), '/') AS folder FROM (SELECT string_split(path, '/') AS parts, unnest(generate_series(1, len(string_split(path, '/')) - 1)) AS k FROM ({PATHS}))")
def directory_chain(spark, sf):
    return _paths(spark, sf).select(F.explode(paths.directory_chain(F.col("path"))).alias("folder")).distinct()


PATTERNS = [("r1", "GET", "/:lang/:id"), ("r2", "GET", "/en/*"), ("r3", "GET", "/[[...rest]]"), ("r4", "GET", "/de/:id/"), ("r5", "POST", "/en/:id"), ("r6", "GET", "/{a}/{b}")]


@registered(
    f"""WITH p AS (SELECT 'page:' || page_id AS request, [x FOR x IN string_split(path, '/') IF x <> ''] AS s FROM ({PATHS})),
    m AS (SELECT request, 'r2' AS route, 4 AS score, 'catch-all' AS match FROM p WHERE s[1] = 'en' AND len(s) >= 2 UNION ALL SELECT request, 'r3', 1, 'catch-all' FROM p
    UNION ALL SELECT request, 'r1', 4, 'parameter' FROM p WHERE len(s) = 2 UNION ALL SELECT request, 'r6', 4, 'parameter' FROM p WHERE len(s) = 2 UNION ALL SELECT request, 'r4', 5, 'parameter' FROM p WHERE len(s) = 2 AND s[1] = 'de'),
    t AS (SELECT *, max(score) OVER (PARTITION BY request) AS top FROM m) SELECT request, any_value(route) AS route, any_value(score)::INT AS score, any_value(match) AS match FROM t WHERE score = top GROUP BY request HAVING count(*) = 1"""
)
def url_route_match(spark, sf):
    p = derived_graph(spark, sf).node_table("Page").select(F.col("id").alias("request"), F.lit("get").alias("method"), "url")
    return routes.best_routes(p, spark.createDataFrame(PATTERNS, "route string, method string, pattern string"))


@registered("SELECT 'event:' || event_id AS id, (props->>'$.k')::BIGINT AS k FROM events")
def json_column_decode(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select(F.concat(F.lit("event:"), "event_id").alias("id"), F.from_json("props", "k bigint")["k"].alias("k"))


@registered()
def sql_text_tables(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    text = F.concat(F.lit("WITH x AS (SELECT 1) INSERT INTO app."), F.col("event_type"), F.lit("_log SELECT * FROM x JOIN users_"), F.col("user_id") % 3, F.lit(" u ON true -- FROM nowhere"))
    return e.select(F.concat(F.lit("event:"), "event_id").alias("id"), sqltext.table_accesses(text).alias("a")).select("id", F.explode("a").alias("a")).select("id", "a.table", "a.access")


def _small(spark, sf):
    from .graph import Graph

    g = derived_graph(spark, sf)
    keep = ("Nation", "Region", "IN_REGION")
    return Graph(spark, g.schema, g.nodes.only(keep), g.rels.only(keep))


@registered(
    """SELECT '{"kind":"node","id":"nation:' || n_nationkey || '","label":"Nation","properties":"{\\"name\\":\\"' || n_name || '\\"}"}' AS line FROM nation
    UNION ALL SELECT '{"kind":"node","id":"region:' || r_regionkey || '","label":"Region","properties":"{\\"name\\":\\"' || r_name || '\\"}"}' FROM region
    UNION ALL SELECT '{"kind":"rel","from":"nation:' || n_nationkey || '","type":"IN_REGION","to":"region:' || n_regionkey || '","properties":"{}"}' FROM nation"""
)
def normalized_export(spark, sf):
    return export.normalized(_small(spark, sf))


@registered()
def graphml_export(spark, sf):
    return export.graphml(_small(spark, sf))


@registered("SELECT 'part:' || p_partkey AS id, p_name AS name FROM part ORDER BY id LIMIT 26 OFFSET 50")
def paging_window(spark, sf):
    p = derived_graph(spark, sf).node_table("Part").select("id", "name")
    return tools.window(p, ["id"], tools.Page(50, 25))


@registered("SELECT 'customer' AS kind, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_name, NULL FROM supplier")
def union_all_host(spark, sf):
    g = derived_graph(spark, sf)
    a = g.node_table("Customer").select(F.lit("customer").alias("kind"), "name", F.col("mktsegment").alias("segment"))
    b = g.node_table("Supplier").select(F.lit("supplier").alias("kind"), "name")
    return a.unionByName(b, allowMissingColumns=True)


@registered(f"WITH {FLOW_SQL} SELECT ['part:' || x.a, 'part:' || y.a] AS sources, 'part:' || y.b AS last FROM flow x JOIN flow y ON x.b = y.a JOIN part ON x.a = p_partkey WHERE p_brand = 'Brand#14'")
def walk_rel_list(spark, sf):
    d = derived_graph(spark, sf).query("MATCH (a:Part {brand: 'Brand#14'})-[w:PART_FLOW*2]->(b:Part) RETURN w, id(b) AS last")
    return d.select(F.transform("w", lambda r: r["src"]).alias("sources"), "last")


@registered(
    hops(3, "b", "a", "p_brand = 'Brand#15' AND p_size < 10")
    + """, m AS (SELECT v, min(d) AS d FROM w GROUP BY v) SELECT 'order:' || l_orderkey AS id, min(d)::INT AS depth FROM lineitem JOIN m ON l_partkey = v GROUP BY l_orderkey"""
)
def impact(spark, sf):
    g = derived_graph(spark, sf)
    seeds = g.node_table("Part").filter("brand = 'Brand#15' and size < 10").select("id")
    lists = tools.impact(g.rel_table("PART_FLOW").select("src", "dst"), seeds, 3, {"orders": g.rel_table("LINE")})
    return lists["orders"]


@registered("SELECT 'document:' || doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unused_nodes(spark, sf):
    g = derived_graph(spark, sf)
    return tools.unused(g.node_table("Document").select("id"), [g.rel_table("LABELLED")])


@registered("WITH t AS (SELECT 'supplier' AS kind, 'supplier:' || l_suppkey AS id, 'part:' || l_partkey AS ref FROM lineitem UNION SELECT 'order', 'order:' || l_orderkey, 'part:' || l_partkey FROM lineitem) SELECT kind, id, ref FROM t WHERE ref IN ('part:1', 'part:7')")
def references(spark, sf):
    g = derived_graph(spark, sf)
    wanted = g.node_table("Part").filter(F.col("id").isin("part:1", "part:7")).select("id")
    return tools.references(wanted, {"supplier": g.rel_table("SUPPLIES"), "order": g.rel_table("LINE")})


@registered("SELECT * FROM (SELECT 'customer:' || o_custkey AS customer, 'order:' || o_orderkey AS id, o_totalprice AS price, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM orders) WHERE rank <= 2")
def top_per_group(spark, sf):
    g = derived_graph(spark, sf)
    o = g.rel_table("PLACED").select(F.col("src").alias("customer"), F.col("dst").alias("id")).join(g.node_table("Order").select("id", F.col("totalprice").alias("price")), "id")
    number = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    return traverse.top_per_group(o.select("customer", "id", "price"), ["customer"], [F.col("price").desc(), number], 2)


@registered("SELECT name, name || CASE WHEN k = 1 THEN '' ELSE '#' || k END AS unique_name, id FROM (SELECT lang AS name, 'document:' || doc_id AS id, row_number() OVER (PARTITION BY lang ORDER BY 'document:' || doc_id) AS k FROM documents)")
def unique_names(spark, sf):
    d = derived_graph(spark, sf).node_table("Document").select(F.col("lang").alias("name"), "id")
    return tools.unique_names(d, "name", "id")


@registered("SELECT x.n_name AS a, y.n_name AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey")
def nearest_in_region(spark, sf):
    w = Window.partitionBy("dst").orderBy(F.regexp_extract("src", r"(\d+)$", 1).cast("long"))
    g = derived_graph(spark, sf)
    e = g.rel_table("IN_REGION").withColumn("k", F.row_number().over(w)).select("src", "dst", "k")
    n = g.node_table("Nation")
    pairs = e.join(e.select(F.col("src").alias("other"), "dst", F.col("k").alias("k2")), "dst").filter("k < k2")
    return pairs.join(n.select(F.col("id").alias("src"), F.col("name").alias("a")), "src").join(n.select(F.col("id").alias("other"), F.col("name").alias("b")), "other").select("a", "b")
