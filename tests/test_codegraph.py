"""Code graph tools over a small graph written as records."""

import json

import pytest

from quiltgraph import codegraph as C
from quiltgraph import codeimpact
from quiltgraph.sources import records


def node(id, label, **p):
    return {"kind": "node", "id": id, "label": label, "properties": p}


def rel(a, t, b, **p):
    return {"kind": "rel", "from": a, "type": t, "to": b, "properties": p}


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    rows = [{"kind": "report", "status": "success"}]
    for f in ("src/a.ts", "src/b.ts", "src/c.ts", "test/a.test.ts"):
        rows.append(node(f"file:{f}", "File", relativePath=f, language="typescript", isTest=f.startswith("test")))
    for f, n, line in (("src/a.ts", "alpha", 1), ("src/b.ts", "betaGamma", 2), ("src/c.ts", "gone", 3)):
        rows += [node(f"fn:{n}", "Function", name=n, line=line, isExported=True), rel(f"file:{f}", "DEFINES_FUNCTION", f"fn:{n}")]
    rows += [node("call:1", "Call", name="betaGamma", line=5), rel("fn:alpha", "CALLS", "call:1"), rel("call:1", "CALL_RESOLVES_TO", "fn:betaGamma", provenance="inferred")]
    for k, (a, b) in enumerate([("src/a.ts", "src/b.ts"), ("src/b.ts", "src/a.ts"), ("test/a.test.ts", "src/a.ts")]):
        rows += [node(f"imp:{k}", "Import", source="x", line=1), rel(f"file:{a}", "IMPORTS", f"imp:{k}"), rel(f"imp:{k}", "RESOLVES_TO", f"file:{b}")]
    rows += [node("route:1", "Route", method="GET", fullPath="/x", framework="express"), rel("file:src/a.ts", "DECLARES_ROUTE", "route:1"), rel("route:1", "ROUTE_HANDLED_BY", "fn:alpha")]
    rows += [node("env:A", "EnvVar", name="A"), node("env:B", "EnvVar", name="B"), rel("file:src/a.ts", "USES_ENV", "env:A"), rel("fn:alpha", "USES_ENV", "env:A"), rel("fn:alpha", "CALLS", "missing")]
    path = tmp_path_factory.mktemp("g") / "g.jsonl"
    path.write_text("\n".join(map(json.dumps, rows)))
    return records.read_graph(spark, str(path), C.CODE)


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())


def test_reading(graph):
    assert graph.schema.nodes["Function"].properties["line"] == "INT64" and graph.schema.nodes["File"].properties["isTest"] == "BOOLEAN"
    assert graph.rels["USES_ENV_FILE"].count() == 1 and graph.rels["USES_ENV_FUNCTION"].count() == 1 and graph.rels["CALLS"].count() == 1


def test_symbols_and_calls(graph):
    assert ids(C.find_definitions(graph, "alpha")) == ["fn:alpha"]
    assert [r.name for r in C.search_symbols(graph, "bg").collect()] == ["betaGamma"]
    assert ids(C.find_callers(graph, "betaGamma"), "caller") == ["fn:alpha"]
    t = {r.id: (r.depth, r.weakest) for r in C.trace_calls(graph, "alpha").collect()}
    assert t == {"fn:alpha": (0, None), "fn:betaGamma": (1, 1)}
    out = codeimpact.impact_of(graph, "betaGamma")
    assert ids(out["callers"]) == ["fn:alpha"] and ids(out["routes"]) == ["route:1"] and ids(out["apiConsumers"]) == []
    assert ids(C.list_exports(graph, "src/a.ts")) == ["fn:alpha"]


def test_routes_env_imports(spark, graph):
    assert ids(C.list_routes(graph, unconsumed=True)) == ["route:1"] and ids(C.list_entrypoints(graph)) == [] and ids(C.list_pages(graph)) == [] and ids(C.list_stores(graph)) == []
    assert {r.name: r.readers for r in C.list_env(graph).collect()} == {"A": 2, "B": 0}
    c = C.import_cycles(graph).first()
    assert c.length == 2 and list(c.cycle) == ["file:src/a.ts", "file:src/b.ts"]
    assert C.import_chain(graph, "test/a.test.ts", "src/b.ts").first().depth == 2
    assert ids(C.affected_tests(graph, spark.createDataFrame([("file:src/b.ts",)], "id string"))) == ["file:test/a.test.ts"]
    assert ids(C.unused_exports(graph)) == ["fn:gone"]
    folders, edges = C.architecture(graph)
    assert {r.folder: (r.files, r.tests) for r in folders.collect()} == {"src": (3, 0), "test": (1, 1)} and edges.count() == 2


def test_round_trip(spark, graph, tmp_path):
    records.write_records(graph.without_dangling(), str(tmp_path))
    again = records.read_graph(spark, f"{tmp_path}/*", C.CODE)
    assert again.rels["CALLS"].count() == 1 and again.nodes["Function"].count() == 3
