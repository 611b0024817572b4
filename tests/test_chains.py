"""Shortest chains against a search by hand, by groups and by levels, and what is written on the way."""

import random
from pathlib import Path

import pytest

from quiltgraph.operators import components, traverse


def by_hand(edges, seeds, depth):
    """{(seed, id): (depth, path, weakest)} by all paths of a level."""
    out = {}
    for s in seeds:
        level = {s: ((s,), None)}
        seen = {}
        for k in range(depth + 1):
            seen |= {v: (k, *x) for v, x in level.items()}
            step = {}
            for v, (path, weak) in level.items():
                for b, w in edges.get(v, {}).items():
                    if b not in seen:
                        new = ((*path, b), min((x for x in (weak, w) if x is not None), default=None))
                        step[b] = min(step.get(b, new), new, key=lambda x: x[0])
            level = step
        out |= {(s, v): x for v, x in seen.items()}
    return out


def graph(nodes, degree, key):
    random.seed(11)
    out = {}
    for a in range(nodes):
        for b in random.sample(range(nodes), degree if a else nodes // 2):
            out.setdefault(key(a), {})[key(b)] = random.choice([None, 1, 5, -2, 9])
    out.pop(key(3))  # no way out
    return out


@pytest.mark.parametrize("key", [int, "part:{}".format])
def test_chains_by_groups_and_by_levels(spark, monkeypatch, key):
    edges = graph(120, 5, key)
    seeds = [key(k) for k in (0, 3, 5, 17, 40, 41, 200)]
    kind = "long" if key is int else "string"
    e = spark.createDataFrame([(a, b, w) for a, out in edges.items() for b, w in out.items()], f"src {kind}, dst {kind}, strength long")
    s = spark.createDataFrame([(x,) for x in seeds], f"id {kind}")
    monkeypatch.setattr(traverse, "LIST", 20)  # the first node's list is in parts
    monkeypatch.setattr(traverse, "BATCH", 50)
    want = by_hand(edges, seeds, 3)
    for group, most in ((3, 1_000_000), (100, 1_000_000), (1, 300), (3, 0)):
        rows = traverse.shortest_chains(e, s, 3, group=group, most=most).collect()
        assert len(rows) == len(want)
        assert {(r.seed, r.id): (r.depth, tuple(r.path), r.weakest) for r in rows} == want, (group, most)
    rows = traverse.shortest_chains(e, s, 3, paths=False).collect()
    assert {(r.seed, r.id): (r.depth, r.weakest) for r in rows} == {k: (d, w) for k, (d, _, w) in want.items()}
    assert traverse.shortest_chains(e, s.filter("false"), 3).count() == 0


def test_rows_of_the_result_are_not_written_on_the_way(spark, monkeypatch):
    edges = graph(250, 8, int)
    e = spark.createDataFrame([(a, b) for a, out in edges.items() for b in out], "src long, dst long")
    seeds = e.select(e.src.alias("id")).distinct()
    sizes, put = [], traverse.written

    def counted(df):
        out = put(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(traverse, "written", counted)
    assert traverse.shortest_chains(e, seeds, 3, paths=False).count() > 5 * sum(sizes)


def test_reach_through_components(spark):
    random.seed(3)
    pairs = {(a, b) for a, b in ((random.randrange(60), random.randrange(60)) for _ in range(75))} | {(70, 70), (70, 71), (71, 1), (80, 81), (81, 80)}
    e = spark.createDataFrame(sorted(pairs), "src long, dst long")
    seeds = [*range(0, 60, 4), 70, 71, 81, 99]
    want = set()
    for s in seeds:
        level = {b for a, b in pairs if a == s}
        seen = set()
        while level:
            seen |= level
            level = {b for a, b in pairs if a in level} - seen
        want |= {(s, v) for v in seen}
    s = spark.createDataFrame([(x,) for x in seeds], "id long")
    for few in (50_000, 0):
        rows = traverse.reachable(e, s, few=few).collect()
        assert len(rows) == len(want) and {tuple(r) for r in rows} == want, few


def test_reach_of_a_large_component_takes_few_rows(spark, monkeypatch):
    """All pairs of a component are in the result, not among the rows that are written on the way."""
    ring = [(k, (k + d) % 400) for k in range(400) for d in (1, 7)]
    e = spark.createDataFrame(ring, "src long, dst long")
    sizes, put = [], traverse.written

    def counted(df):
        out = put(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(traverse, "written", counted)
    found = traverse.reachable(e, e.select(e.src.alias("id")).distinct(), few=500)
    assert found.count() == 400 * 400 > 10 * sum(sizes)


def test_paths_are_not_written_on_the_way(spark, monkeypatch):
    kinds, put = [], traverse.written
    monkeypatch.setattr(traverse, "written", lambda df: kinds.append(df.columns) or put(df))
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 4), (4, 3), (3, 1)], "src long, dst long")
    got = {r.id: list(r.path) for r in traverse.shortest_chains(e, spark.createDataFrame([(1,)], "id long"), 3).collect()}
    assert got == {1: [1], 2: [1, 2], 4: [1, 4], 3: [1, 2, 3]} and not any("path" in c for c in kinds)


def test_groups_follow_the_graph_not_the_order_of_ids(spark, monkeypatch):
    """Eight parts of a graph whose ids take turns: lists go to about one group each, not to every group."""
    random.seed(5)
    e = spark.createDataFrame([(8 * a + c, 8 * b + c) for c in range(8) for a in range(60) for b in random.sample(range(60), 4)], "src long, dst long")
    needed, put = [], traverse.written

    def counted(df):
        out = put(df)
        if df.columns == ["g", "id", "seed"]:
            needed.append(out.count())
        return out

    monkeypatch.setattr(traverse, "written", counted)
    seeds = e.select(e.src.alias("id")).distinct()
    got = traverse.shortest_chains(e, seeds, 3, group=60)
    assert sum(needed) < 3 * 480 and got.count() == got.select("seed", "id").distinct().count()


def test_heavy_groups_are_split_before_rows_of_paths_are_written(spark, monkeypatch):
    random.seed(7)
    edges = {a: {b: random.choice([None, 1, 5]) for b in random.sample(range(800), 4)} for a in range(800)}
    e = spark.createDataFrame([(a, b, w) for a, out in edges.items() for b, w in out.items()], "src long, dst long, strength long")
    seeds = [*range(1, 60)]  # each alone reads some 84 edges
    kinds, put = [], traverse.written
    monkeypatch.setattr(traverse, "written", lambda df: kinds.append(df.columns) or put(df))
    rows = traverse.shortest_chains(e, spark.createDataFrame([(x,) for x in seeds], "id long"), 3, group=30, most=300).collect()
    assert len(rows) == len({(r.seed, r.id) for r in rows})
    assert {(r.seed, r.id): (r.depth, tuple(r.path), r.weakest) for r in rows} == by_hand(edges, seeds, 3)
    assert not any("path" in c for c in kinds)


@pytest.mark.parametrize("local", [100, 40, 10_000])
def test_reach_of_a_graph_too_large_for_a_task(spark, local):
    """Contraction by groups of nodes, by a thinned graph, and one task alone give what a search by hand gives."""
    random.seed(9)
    dense_part = {(3 * a + c, 3 * b + c) for c in range(2) for a in range(40) for b in random.sample(range(40), 9 if c else 4)}
    pairs = dense_part | {(4, 200), (200, 201), (201, 200), (201, 202), (203, 203), (203, 0), (204, 204), (150, 9), (202, 205)}
    e = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in sorted(pairs)] * 2, "src string, dst string")  # edges may be repeated
    seeds = [0, 1, 4, 30, 150, 200, 202, 203, 204, 205, 999]
    want = set()
    for s in seeds:
        level, seen = {b for a, b in pairs if a == s}, set()
        while level:
            seen |= level
            level = {b for a, b in pairs if a in level} - seen
        want |= {(f"n{s}", f"n{v}") for v in seen}
    rows = traverse.reachable(e, spark.createDataFrame([(f"n{s}",) for s in seeds], "id string"), few=0, local_edges=local).collect()
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want
    got = {tuple(r) for r in components.scc(e, local).collect()}
    alone = {tuple(r) for r in components.scc(e, 10_000).collect()}
    assert got == alone and len(got) > 60


def test_reach_leaves_no_copies_of_the_edges(spark, monkeypatch):
    """Of all tables that are written on the way, those that are still there when the result is read are small."""
    e = spark.createDataFrame([(k, (k + d) % 400) for k in range(400) for d in (1, 7, 30, 90)], "src long, dst long")
    tables, put = [], traverse.written
    for m in (traverse, components):
        monkeypatch.setattr(m, "written", lambda df: tables.append(put(df)) or tables[-1])
    found = traverse.reachable(e, e.select(e.src.alias("id")).distinct(), few=500)
    left = [spark.read.parquet(t._table_path).count() for t in tables if list(Path(t._table_path.removeprefix("file:")).glob("*.parquet"))]
    assert sum(left) < 1600 and found.count() == 400 * 400
