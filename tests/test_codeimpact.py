"""Impact across components, pages and stores, runners, RPCs and sources, over a small graph by hand."""

import json

import pytest
from test_codegraph import ids, node, rel

from quiltgraph import codegraph as C
from quiltgraph import codeimpact
from quiltgraph.sources import records


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    rows = [node(f"file:{f}", "File", relativePath=f) for f in ("a.ts", "b.ts", "run.sh")]
    rows += [node(f"fn:{n}", "Function", name=n, line=2, endLine=3, isExported=True) for n in ("load", "view", "derive")]
    rows += [rel("file:a.ts", "DEFINES_FUNCTION", "fn:load"), rel("file:b.ts", "DEFINES_FUNCTION", "fn:view"), rel("file:b.ts", "DEFINES_FUNCTION", "fn:derive")]
    rows += [node("call:1", "Call", name="load", line=2), node("call:2", "Call", name="gone", line=3), rel("fn:view", "CALLS", "call:1"), rel("call:1", "CALL_RESOLVES_TO", "fn:load"), rel("fn:view", "CALLS", "call:2")]
    rows += [node("cmp:V", "Component", name="V"), node("cmp:P", "Component", name="P"), node("page:1", "Page", fullPath="/p"), rel("cmp:V", "COMPONENT_DEFINED_BY_FUNCTION", "fn:view"), rel("cmp:P", "RENDERS", "cmp:V"), rel("page:1", "PAGE_RENDERS", "cmp:P")]
    rows += [node("store:s", "Store", name="s"), node("store:d", "Store", name="d"), rel("fn:load", "WRITES_STORE", "store:s"), rel("fn:derive", "READS_STORE", "store:s"), rel("store:d", "STORE_DEFINED_BY_FUNCTION", "fn:derive")]
    rows += [node("ep:1", "EntryPoint", kind="script", trigger="go"), node("ep:2", "EntryPoint", kind="job", trigger="ci"), rel("file:run.sh", "DECLARES_ENTRYPOINT", "ep:1"), rel("ep:1", "RUNS", "file:a.ts"), rel("ep:2", "RUNS", "ep:1")]
    rows += [node("svc:1", "Service", name="S"), node("rpc:1", "Rpc", name="Get"), node("msg:1", "Message", name="Req"), rel("file:a.ts", "DECLARES_SERVICE", "svc:1"), rel("svc:1", "HAS_RPC", "rpc:1"), rel("rpc:1", "RPC_REQUEST", "msg:1"), rel("rpc:1", "RPC_IMPLEMENTED_BY", "fn:load")]
    path = tmp_path_factory.mktemp("g") / "g.jsonl"
    path.write_text("\n".join(map(json.dumps, rows)))
    return records.read_graph(spark, str(path), C.CODE)


def test_impact_lists(graph):
    out = codeimpact.impact_of(graph, "load")
    depths = {k: {r.id: r.depth for r in out[k].collect()} for k in ("callers", "components", "pages", "stores", "storeReaders", "routes", "envVars")}
    assert depths == {"callers": {"fn:view": 1}, "components": {"cmp:V": 0, "cmp:P": 1}, "pages": {"page:1": 1}, "stores": {"store:s": 0, "store:d": 1}, "storeReaders": {"fn:derive": 0}, "routes": {}, "envVars": {}}


def test_runners_rpcs_sources(spark, graph):
    assert {r.id: r.depth for r in codeimpact.runners(graph, "a.ts").collect()} == {"ep:1": 1, "ep:2": 2}
    r = codeimpact.list_rpcs(graph).first()
    assert (r.service, r.name, list(r.request), list(r.response), list(r.implemented_by)) == ("S", "Get", ["Req"], [], ["load"])
    texts = spark.createDataFrame([("a.ts", "one\r\ntwo\nthree\nfour")], "file string, text string")
    assert codeimpact.get_symbol_source(graph, "load", texts).first().source == "two\nthree"
    assert codeimpact.get_symbol_source(graph, "view", texts).first().source is None
    assert ids(codeimpact.component_usages(graph, "P")) == ["page:1"] and ids(codeimpact.unresolved_calls(graph), "call") == ["call:2"]
