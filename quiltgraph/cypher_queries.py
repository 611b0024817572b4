"""Registered graph queries: text, parameters and the SQL that gives the same rows."""

from __future__ import annotations

from .sources.derived import FLOW_SQL

#: name -> (query, parameters, oracle)
QUERIES: dict[str, tuple[str, dict, str]] = {
    "region_customers": (
        "MATCH (c:Customer)-[:CUSTOMER_IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) WHERE r.name = $region RETURN n.name AS nation, count(c) AS customers ORDER BY customers DESC, nation LIMIT 5",
        {"region": "ASIA"},
        "SELECT n_name AS nation, count(*)::BIGINT AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name ORDER BY customers DESC, nation LIMIT 5",
    ),
    "label_scan": ("MATCH (s:Supplier) RETURN id(s) AS id, s.name AS name, s.acctbal AS acctbal", {}, "SELECT 'supplier:' || s_suppkey AS id, s_name AS name, s_acctbal AS acctbal FROM supplier"),
    "index_equality": ("MATCH (n:Nation {name: $n}) RETURN id(n) AS id, n.name AS name", {"n": "NATION_03"}, "SELECT 'nation:' || n_nationkey AS id, n_name AS name FROM nation WHERE n_name = 'NATION_03'"),
    "property_filter": ("MATCH (p:Part) WHERE p.size > 20 AND p.size <= 40 AND NOT p.brand = 'Brand#11' RETURN id(p) AS id, p.size AS size", {}, "SELECT 'part:' || p_partkey AS id, p_size::BIGINT AS size FROM part WHERE p_size > 20 AND p_size <= 40 AND p_brand <> 'Brand#11'"),
    "label_union": (
        "MATCH (x:Customer|Supplier) WHERE x.acctbal > 5000 RETURN label(x) AS label, x.name AS name, x.mktsegment AS segment",
        {},
        "SELECT 'Customer' AS label, c_name AS name, c_mktsegment AS segment FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT 'Supplier', s_name, NULL FROM supplier WHERE s_acctbal > 5000",
    ),
    "string_predicates": (
        "MATCH (c:Customer) WHERE c.name ENDS WITH '7' AND c.name STARTS WITH 'C' AND c.name CONTAINS '1' AND upper(c.mktsegment) = c.mktsegment RETURN lower(c.name) AS name",
        {},
        "SELECT lower(c_name) AS name FROM customer WHERE c_name LIKE '%7' AND c_name LIKE 'C%' AND c_name LIKE '%1%' AND upper(c_mktsegment) = c_mktsegment",
    ),
    "in_list_3vl": (
        "MATCH (d:Document) OPTIONAL MATCH (d)-[:LABELLED]->(l:Label) RETURN id(d) AS id, l.quality IN [0, 5] AS a, l.toxic IN [1, null] AS b, NOT l.quality IN [] AS c",
        {},
        "SELECT 'document:' || d.doc_id AS id, quality IN (0, 5) AS a, toxic IN (1, NULL) AS b, CASE WHEN l.doc_id IS NULL THEN true ELSE true END AS c FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    ),
    "null_logic_xor": (
        "MATCH (d:Document) OPTIONAL MATCH (d)-[:LABELLED]->(l:Label) RETURN id(d) AS id, l.quality = 1 XOR l.toxic = 1 AS x, l.quality = 1 OR d.lang = 'en' AS o, l.quality = 1 AND d.lang = 'en' AS a, NOT l.quality = 1 AS n, l.quality = d.lang AS mixed",
        {},
        "SELECT 'document:' || d.doc_id AS id, (quality = 1) <> (toxic = 1) AS x, quality = 1 OR lang = 'en' AS o, quality = 1 AND lang = 'en' AS a, NOT quality = 1 AS n, NULL::BOOLEAN AS mixed FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    ),
    "case_searched": (
        "MATCH (p:Part) RETURN id(p) AS id, CASE WHEN p.size < 10 THEN 'small' WHEN p.size < 30 THEN 'medium' ELSE 'large' END AS kind",
        {},
        "SELECT 'part:' || p_partkey AS id, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS kind FROM part",
    ),
    "case_simple": (
        "MATCH (o:Order) RETURN o.status AS status, CASE o.status WHEN 'F' THEN 1 WHEN 'O' THEN 2 WHEN null THEN 3 END AS code, count(*) AS n",
        {},
        "SELECT o_orderstatus AS status, (CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END)::BIGINT AS code, count(*)::BIGINT AS n FROM orders GROUP BY ALL",
    ),
    "int_division": (
        "MATCH (p:Part) RETURN id(p) AS id, p.size / 7 AS q, (0 - p.size) / 7 AS nq, (0 - p.size) % 7 AS nr, p.size * 2 - 1 AS t, p.size / 4.0 AS f, 1.0 / (p.size - p.size) > 1e300 AS inf",
        {},
        "SELECT 'part:' || p_partkey AS id, (p_size // 7)::BIGINT AS q, (-(p_size // 7))::BIGINT AS nq, (-(p_size % 7))::BIGINT AS nr, (p_size * 2 - 1)::BIGINT AS t, p_size / 4.0::DOUBLE AS f, true AS inf FROM part",
    ),
    "string_concat_null": (
        "MATCH (d:Document) OPTIONAL MATCH (d)-[:LABELLED]->(l:Label {quality: 0}) RETURN id(d) AS id, d.lang + '/' + d.source AS a, 'x' + CASE WHEN l IS NULL THEN null ELSE 'y' END AS b",
        {},
        "SELECT 'document:' || d.doc_id AS id, coalesce(lang, '') || '/' || coalesce(source, '') AS a, 'x' || CASE WHEN l.doc_id IS NULL THEN '' ELSE 'y' END AS b FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND quality = 0",
    ),
    "size_coalesce_label_id": (
        "MATCH (x:Region|Nation) RETURN id(x) AS id, label(x) AS label, labels(x) AS labels, size(x.name) AS n, coalesce(null, x.name, 'none') AS name, size([1, 2, 3]) AS three",
        {},
        "SELECT 'region:' || r_regionkey AS id, 'Region' AS label, ['Region'] AS labels, length(r_name) AS n, r_name AS name, 3::BIGINT AS three FROM region UNION ALL SELECT 'nation:' || n_nationkey, 'Nation', ['Nation'], length(n_name), n_name, 3 FROM nation",
    ),
    "expand_out": ("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.name AS nation, r.name AS region", {}, "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "expand_in": ("MATCH (r:Region {name: 'EUROPE'})<-[:IN_REGION]-(n) RETURN n.name AS nation", {}, "SELECT n_name AS nation FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'"),
    "expand_undirected": (
        "MATCH (a:Nation)-[t:TRADES]-(b:Nation) RETURN a.name AS name, count(t) AS n, count(DISTINCT b) AS partners",
        {},
        """WITH e AS (SELECT DISTINCT s_nationkey AS a, c_nationkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
        u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) SELECT n_name AS name, count(*)::BIGINT AS n, count(DISTINCT b)::BIGINT AS partners FROM u JOIN nation ON a = n_nationkey GROUP BY n_name""",
    ),
    "expand_two_hop": (
        "MATCH (c:Customer)-[:PLACED]->(o:Order)-[l:LINE]->(p:Part) WHERE p.brand = 'Brand#12' AND l.quantity > 45 RETURN id(c) AS customer, id(p) AS part, l.quantity AS quantity",
        {},
        "SELECT 'customer:' || o_custkey AS customer, 'part:' || p_partkey AS part, l_quantity AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#12' AND l_quantity > 45",
    ),
    "rel_type_union": (
        "MATCH (x)-[r:CUSTOMER_IN_NATION|SUPPLIER_IN_NATION]->(n:Nation) RETURN n.name AS nation, label(r) AS type, count(*) AS n",
        {},
        "SELECT n_name AS nation, 'CUSTOMER_IN_NATION' AS type, count(*)::BIGINT AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL UNION ALL SELECT n_name, 'SUPPLIER_IN_NATION', count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL",
    ),
    "rel_property_filter": ("MATCH (:Order)-[l:LINE {returnflag: 'R'}]->() WHERE l.discount >= 0.05 RETURN l.linestatus AS status, count(l) AS n", {}, "SELECT l_linestatus AS status, count(*)::BIGINT AS n FROM lineitem WHERE l_returnflag = 'R' AND l_discount >= 0.05 GROUP BY ALL"),
    "cycle_close": (
        "MATCH (a:Part)-[:PART_FLOW]->(b)-[:PART_FLOW]->(a) RETURN id(a) AS a, id(b) AS b",
        {},
        f"WITH {FLOW_SQL} SELECT 'part:' || x.a AS a, 'part:' || x.b AS b FROM flow x JOIN flow y ON x.b = y.a AND y.b = x.a",
    ),
    "comma_join": (
        "MATCH (u:User)-[:DID]->(e:Event), (e)-[:HAS_TYPE]->(t:EventType {name: 'click'}) WHERE e.k > 5 RETURN u.name AS user, count(e) AS n",
        {},
        "SELECT user_id::VARCHAR AS user, count(*)::BIGINT AS n FROM events WHERE event_type = 'click' AND (props->>'$.k')::INT > 5 GROUP BY ALL",
    ),
    "comma_cross": ("MATCH (a:Region), (b:EventType) RETURN a.name AS a, b.name AS b", {}, "SELECT r_name AS a, event_type AS b FROM region, (SELECT DISTINCT event_type FROM events)"),
    "theta_where": ("MATCH (a:Nation)-[:IN_REGION]->(r), (b:Nation)-[:IN_REGION]->(r) WHERE a.name < b.name RETURN a.name AS a, b.name AS b", {}, "SELECT x.n_name AS a, y.n_name AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_name < y.n_name"),
    "optional_match": (
        "MATCH (d:Document) OPTIONAL MATCH (d)-[:LABELLED]->(l:Label) RETURN d.lang AS lang, count(d) AS docs, count(l) AS labelled, sum(l.quality) AS good",
        {},
        "SELECT lang, count(*)::BIGINT AS docs, count(l.doc_id)::BIGINT AS labelled, sum(quality)::BIGINT AS good FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang",
    ),
    "optional_match_where": (
        "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 400000 AND c.acctbal > 0 RETURN id(c) AS id, count(o) AS n",
        {},
        "SELECT 'customer:' || c_custkey AS id, count(o_orderkey)::BIGINT AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000 AND c_acctbal > 0 GROUP BY c_custkey",
    ),
    "optional_chain": (
        "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order {status: 'P'}) OPTIONAL MATCH (o)-[l:LINE]->(p:Part {brand: 'Brand#13'}) RETURN c.mktsegment AS segment, count(DISTINCT o) AS orders, count(p) AS parts",
        {},
        "SELECT c_mktsegment AS segment, count(DISTINCT o_orderkey)::BIGINT AS orders, count(p_partkey)::BIGINT AS parts FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' LEFT JOIN (lineitem JOIN part ON l_partkey = p_partkey AND p_brand = 'Brand#13') ON l_orderkey = o_orderkey GROUP BY c_mktsegment",
    ),
    "label_inference": (
        "MATCH (x)-[r]->(n:Region) RETURN label(x) AS label, label(r) AS type, count(*) AS n",
        {},
        "SELECT 'Nation' AS label, 'IN_REGION' AS type, count(*)::BIGINT AS n FROM nation",
    ),
    "impossible_labels": ("MATCH (x:Region)-[:PLACED]->(o) RETURN id(x) AS id, o.status AS status", {}, "SELECT NULL::VARCHAR AS id, NULL::VARCHAR AS status WHERE false"),
    "walk_fixed": ("MATCH (a:Part)-[:PART_FLOW*2]->(b:Part) RETURN id(a) AS a, id(b) AS b", {}, f"WITH {FLOW_SQL} SELECT 'part:' || x.a AS a, 'part:' || y.b AS b FROM flow x JOIN flow y ON x.b = y.a"),
    "walk_range": (
        "MATCH (a:Part)-[w:PART_FLOW*1..3]->(b:Part) RETURN size(w) AS hops, count(*) AS n, count(DISTINCT b) AS ends",
        {},
        f"WITH {FLOW_SQL}, w AS (SELECT 1 AS h, b FROM flow UNION ALL SELECT 2, y.b FROM flow x JOIN flow y ON x.b = y.a UNION ALL SELECT 3, z.b FROM flow x JOIN flow y ON x.b = y.a JOIN flow z ON y.b = z.a) SELECT h::BIGINT AS hops, count(*)::BIGINT AS n, count(DISTINCT b)::BIGINT AS ends FROM w GROUP BY h",
    ),
    "walk_zero_hop": (
        "MATCH (a:Part {brand: 'Brand#11'})-[:PART_FLOW*0..1]->(b:Part) RETURN id(a) AS a, id(b) AS b",
        {},
        f"WITH {FLOW_SQL} SELECT 'part:' || p_partkey AS a, 'part:' || p_partkey AS b FROM part WHERE p_brand = 'Brand#11' UNION ALL SELECT 'part:' || a, 'part:' || b FROM flow JOIN part ON a = p_partkey WHERE p_brand = 'Brand#11'",
    ),
    "walk_into": (
        "MATCH (a:Part)<-[w:PART_FLOW*2..2]-(b:Part {brand: 'Brand#12'}) RETURN id(a) AS a, id(b) AS b, size(w) AS hops",
        {},
        f"WITH {FLOW_SQL} SELECT 'part:' || y.b AS a, 'part:' || x.a AS b, 2::BIGINT AS hops FROM flow x JOIN flow y ON x.b = y.a JOIN part ON x.a = p_partkey WHERE p_brand = 'Brand#12'",
    ),
    "count_star": ("MATCH (o:Order) RETURN count(*) AS n, count(o.priority) AS p", {}, "SELECT count(*)::BIGINT AS n, count(o_orderpriority)::BIGINT AS p FROM orders"),
    "count_distinct": ("MATCH (s:Supplier)-[:SUPPLIES]->(p:Part) RETURN s.name AS name, count(DISTINCT p.brand) AS brands, count(p) AS parts", {}, "SELECT s_name AS name, count(DISTINCT p_brand)::BIGINT AS brands, count(DISTINCT p_partkey)::BIGINT AS parts FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY s_name"),
    "collect": ("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN r.name AS region, collect(n.name) AS nations", {}, "SELECT r_name AS region, list_sort(list(n_name)) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"),
    "collect_distinct": ("MATCH (d:Document) RETURN d.source AS source, collect(DISTINCT d.lang) AS langs", {}, "SELECT source, list_sort(list(DISTINCT lang)) AS langs FROM documents GROUP BY source"),
    "collect_empty_null": (
        "MATCH (d:Document) OPTIONAL MATCH (d)-[:LABELLED]->(l:Label {toxic: 1}) RETURN d.source AS source, d.lang AS lang, collect(l.quality) AS q",
        {},
        "SELECT source, lang, list_sort(list(quality::BIGINT) FILTER (quality IS NOT NULL)) AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND toxic = 1 GROUP BY source, lang",
    ),
    "min_max_sum_avg": (
        "MATCH (p:Part) RETURN p.brand AS brand, min(p.size) AS lo, max(p.name) AS hi, sum(p.size) AS total, avg(p.size) AS mean",
        {},
        "SELECT p_brand AS brand, min(p_size)::BIGINT AS lo, max(p_name) AS hi, sum(p_size)::BIGINT AS total, avg(p_size) AS mean FROM part GROUP BY p_brand",
    ),
    "agg_in_expression": ("MATCH (p:Part) RETURN p.brand AS brand, count(*) * 10 + max(p.size) AS x ORDER BY sum(p.size) DESC, brand", {}, "SELECT p_brand AS brand, (count(*) * 10 + max(p_size))::BIGINT AS x FROM part GROUP BY p_brand"),
    "group_by_node": ("MATCH (n:Nation)<-[:CUSTOMER_IN_NATION]-(c) WITH n, count(c) AS k RETURN n.name AS name, id(n) AS id, k", {}, "SELECT n_name AS name, 'nation:' || n_nationkey AS id, count(*)::BIGINT AS k FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey"),
    "with_having": ("MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c.name AS name, count(o) AS n WHERE n > 12 RETURN name, n", {}, "SELECT c_name AS name, count(*)::BIGINT AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_name HAVING count(*) > 12"),
    "with_order_limit": (
        "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(o) AS n ORDER BY n DESC, c.name LIMIT 20 MATCH (c)-[:CUSTOMER_IN_NATION]->(k:Nation) RETURN k.name AS nation, sum(n) AS orders",
        {},
        "SELECT n_name AS nation, sum(n)::BIGINT AS orders FROM (SELECT c_custkey, any_value(c_nationkey) AS nk, count(*) AS n, any_value(c_name) AS nm FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey ORDER BY n DESC, nm LIMIT 20) JOIN nation ON nk = n_nationkey GROUP BY n_name",
    ),
    "distinct_rows": ("MATCH (d:Document) RETURN DISTINCT d.lang AS lang, d.source AS source", {}, "SELECT DISTINCT lang, source FROM documents"),
    "order_nulls_last": (
        "MATCH (d:Document) OPTIONAL MATCH (d)-[:LABELLED]->(l:Label) RETURN id(d) AS id, l.quality AS quality ORDER BY quality DESC, id LIMIT 30",
        {},
        "SELECT 'document:' || d.doc_id AS id, quality::BIGINT AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY quality DESC NULLS FIRST, id LIMIT 30",
    ),
    "skip_limit": ("MATCH (p:Part) RETURN id(p) AS id, p.size AS size ORDER BY size, id SKIP 7 LIMIT 11", {}, "SELECT 'part:' || p_partkey AS id, p_size::BIGINT AS size FROM part ORDER BY size, id LIMIT 11 OFFSET 7"),
    "topk": ("MATCH (o:Order) RETURN id(o) AS id, o.totalprice AS price ORDER BY price DESC, id LIMIT 10", {}, "SELECT 'order:' || o_orderkey AS id, o_totalprice AS price FROM orders ORDER BY price DESC, id LIMIT 10"),
    "semi_join_ids": ("MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE id(c) IN $ids RETURN id(c) AS c, id(o) AS o", {"ids": ["customer:1", "customer:7", "customer:11"]}, "SELECT 'customer:' || o_custkey AS c, 'order:' || o_orderkey AS o FROM orders WHERE o_custkey IN (1, 7, 11)"),
    "anti_join_unconsumed": (
        "MATCH (p:Part) OPTIONAL MATCH (p)-[f:PART_FLOW]->(q:Part) WITH p, count(f) AS n WHERE n = 0 RETURN id(p) AS id",
        {},
        f"WITH {FLOW_SQL} SELECT 'part:' || p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT a FROM flow)",
    ),
    "message_chain": (
        "MATCH (c:Conversation)-[:SAYS]->(m:Message)-[:NEXT_MESSAGE]->(k:Message) WHERE m.role = 'user' RETURN k.role AS next, count(*) AS n",
        {},
        "SELECT y.role AS next, count(*)::BIGINT AS n FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND x.turn + 1 = y.turn WHERE x.role = 'user' GROUP BY y.role",
    ),
    "transition_weights": (
        "MATCH (a:EventType)-[t:TRANSITION]->(b:EventType) RETURN a.name AS a, b.name AS b, t.count AS n",
        {},
        "SELECT a, b, count(*)::BIGINT AS n FROM (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NOT NULL GROUP BY a, b",
    ),
}
