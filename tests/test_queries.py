"""Every registered query against its SQL on the small tables, and what has no SQL by other means."""

import pytest
from compare import same

from quiltgraph import cypher_queries, graph_queries
from quiltgraph.sources.derived import derived_graph

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(cypher_queries.QUERIES))
def test_graph_query(spark, name):
    text, params, sql = cypher_queries.QUERIES[name]
    same(derived_graph(spark, SF).query(text, **params), SF, sql)


@pytest.mark.parametrize("name", sorted(graph_queries.ORACLES))
def test_algorithm(spark, name):
    same(graph_queries.QUERIES[name](spark, SF), SF, graph_queries.ORACLES[name])


def test_whole_nodes_and_relationships(spark):
    g = derived_graph(spark, SF)
    r = g.query("MATCH (n:Nation)-[r:IN_REGION]->(k:Region {name: 'ASIA'}) RETURN n, r ORDER BY n.name LIMIT 1").first()
    assert r.n._label == "Nation" and r.n.id.startswith("nation:") and r.r._src == r.n.id and r.r._label == "IN_REGION"
    g.query("MATCH (d:Document) OPTIONAL MATCH (d)-[:LABELLED]->(l) RETURN l").filter("l is null").first()


def test_runtime_error_and_infinities(spark):
    g = derived_graph(spark, SF)
    with pytest.raises(Exception, match="Divide by zero"):
        g.query("MATCH (p:Part) RETURN 1 / (p.size - p.size) AS x").collect()
    r = g.query("MATCH (r:Region {name: 'ASIA'}) RETURN 1.0 / 0 AS a, -1.0 / 0 AS b, 0.0 / 0 AS c, 7 / 2 AS d, -7 / 2 AS e, -7 % 2 AS f, [1, null] = [1, null] AS g, [1, 2] = [1, 3] AS h, 1 = '1' AS i, null IN [] AS j, [1] + 2 AS k").first()
    assert (r.a, r.b, r.d, r.e, r.f, r.g, r.h, r.i, r.j, list(r.k)) == (float("inf"), float("-inf"), 3, -3, -1, None, False, None, False, [1, 2])
    assert r.c != r.c


def test_components_local_and_distributed(spark):
    from quiltgraph.operators import components

    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (7, 8), (8, 9), (9, 7), (9, 10), (10, 7), (5, 11)]
    e = spark.createDataFrame(edges, "src long, dst long")
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 7: 7, 8: 7, 9: 7, 10: 7}
    for most in (1000, 0):
        assert {r.id: r.component for r in components.scc(e, local_edges=most).collect()} == want
    cycles = {r.component: (r.length, list(r.cycle)) for r in components.shortest_cycles(e, components.scc(e)).collect()}
    assert cycles == {1: (3, [1, 2, 3]), 4: (2, [4, 5]), 7: (3, [7, 8, 9])}


def test_louvain(spark):
    from quiltgraph.operators import components

    two = [(a, b, 1) for a in "abcd" for b in "abcd" if a < b] + [(a, b, 1) for a in "wxyz" for b in "wxyz" if a < b] + [("d", "w", 1)]
    p = spark.createDataFrame(two, "a string, b string, weight long")
    got = {r.id: r.community for r in components.louvain(p).collect()}
    assert got == {**dict.fromkeys("abcd", "a"), **dict.fromkeys("wxyz", "w")}
    s = {r.community: (r.members, r.inside, r.outside) for r in components.communities_summary(components.louvain(p), p).collect()}
    assert s == {"a": (4, 6, 1), "w": (4, 6, 1)}


def test_long_cycles_and_limits(spark):
    from quiltgraph.operators import components, traverse

    ring = [(k, (k + 1) % 40) for k in range(40)] + [(50, 51), (51, 50)]
    e = spark.createDataFrame(ring, "src long, dst long")
    got = {r.component: (r.length, list(r.cycle)) for r in components.shortest_cycles(e, components.scc(e)).collect()}
    assert got == {0: (40, list(range(40))), 50: (2, [50, 51])}
    seed, fact = spark.createDataFrame([(0,)], "id long"), spark.createDataFrame([(0, "f")], "id long, fact string")
    for call in (lambda: traverse.reachable(e, seed, 3), lambda: traverse.propagated(e, fact, 3), lambda: traverse.min_labels(e, e.select(e.src.alias("id"), e.src.alias("label")), 3)):
        with pytest.raises(RuntimeError, match="not done after 3 rounds"):
            call()
