"""Schemas, stores, exports, files, streams, paging."""

import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from quiltgraph.functions import names, routes
from quiltgraph.graph import Graph, deduplicated
from quiltgraph.operators import tools
from quiltgraph.schema import Extension, GraphSchema, NodeTable, RelTable
from quiltgraph.sources import export, files
from quiltgraph.sources.store import GraphStore
from quiltgraph.streaming import watch

SCHEMA = GraphSchema([NodeTable("A", {"x": "INT64", "s": "STRING"}), NodeTable("B", {"s": "STRING"})], [RelTable("R", "A", "B", {"w": "INT64"})])


@pytest.fixture
def graph(spark):
    a = spark.createDataFrame([("a1", 1, 'q"<&'), ("a2", None, None)], "id string, x long, s string")
    b = spark.createDataFrame([("b1", "t")], "id string, s string")
    r = spark.createDataFrame([("r1", "a1", "b1", 5), ("r2", "a1", "b1", 5), ("r3", "a2", "zz", 1)], "rel_id string, src string, dst string, w long")
    return Graph(spark, SCHEMA, {"A": a, "B": b}, {"R": r})


def test_schema_merge():
    m = SCHEMA.merged(Extension(nodes=(NodeTable("C"),), rels=(RelTable("Q", "C", "A"),), properties={"A": ("x", {"y": "BOOLEAN"})}))
    assert list(m.nodes["A"].properties) == ["x", "y", "s"] and m.fingerprint() != SCHEMA.fingerprint() and SCHEMA.merged().fingerprint() == SCHEMA.fingerprint()
    for bad in (Extension(properties={"A": (None, {"x": "STRING"})}), Extension(properties={"Z": (None, {"x": "STRING"})}), Extension(rels=(RelTable("Q", "A", "Z"),)), Extension(properties={"A": (None, {"id": "STRING"})})):
        with pytest.raises(ValueError):
            SCHEMA.merged(bad)


def test_validation_and_dangling(spark, graph):
    with pytest.raises(ValueError, match="no property"):
        SCHEMA.validated("B", spark.createDataFrame([("1", 2)], "id string, z long"))
    with pytest.raises(ValueError, match="not string"):
        SCHEMA.validated("A", spark.createDataFrame([("1", "2")], "id string, x string"))
    assert graph.without_dangling().rels["R"].count() == 2
    assert deduplicated(graph.rels["R"]).count() == 2


def test_store(spark, graph, tmp_path):
    store = GraphStore(spark, f"{tmp_path}/g", SCHEMA)
    with pytest.raises(FileNotFoundError):
        store.read()
    one = store.write(graph.without_dangling())
    two = store.write(graph.without_dangling())
    assert two["generation"] == 2 and one["tables"] == two["tables"]
    assert store.read().query("MATCH (a:A)-[r:R]->(b:B) RETURN count(r) AS n").first().n == 2
    more = Graph(spark, SCHEMA, {"B": spark.createDataFrame([("b2", "u")], "id string, s string")}, {})
    three = store.write(more, mode="append")
    assert store.read().nodes["B"].count() == 2 and three["tables"]["A"] == one["tables"]["A"] and store.read().nodes["A"].count() == 2
    with pytest.raises(ValueError, match="2 times"):
        store.write(more, mode="append")
    assert store.collect_garbage(grace=-10) == [one["tables"]["B"]]
    with pytest.raises(ValueError, match="another schema"):
        GraphStore(spark, f"{tmp_path}/g", SCHEMA.merged(Extension(nodes=(NodeTable("Z"),)))).read()


def test_exports(graph, tmp_path):
    g = graph.without_dangling()
    text = "\n".join(r.line for r in export.graphml(g).orderBy("part", "line").collect())
    root = ET.fromstring(text.split("?>", 1)[1])
    ns = "{http://graphml.graphdrawing.org/xmlns}"
    assert len(root.findall(f".//{ns}node")) == 3 and len(root.findall(f".//{ns}edge")) == 2
    assert {d.text for d in root.findall(f".//{ns}data")} >= {'q"<&', "5"}
    lines = [r.line for r in export.dot(g).orderBy("part", "line").collect()]
    assert lines[0] == "digraph g {" and lines[-1] == "}" and '"a1" -> "b1" [label="R"];' in lines
    norm = [json.loads(r.line) for r in export.normalized(g, root="a").collect()]
    assert [n["kind"] for n in norm] == ["node"] * 3 + ["rel"] * 2 and norm[0]["id"] == "<root>1"
    assert "u003c" in export.page(g)
    with pytest.raises(ValueError):
        export.page(g, most=1)
    export.write_jsonl(g, f"{tmp_path}/x")
    near = export.neighbourhood(g, g.nodes["B"].select("id"), 1)
    assert near.nodes["A"].count() == 1
    groups = g.nodes["A"].select("id", F.lit("fa").alias("folder")).unionByName(g.nodes["B"].select("id", F.lit("fb").alias("folder")))
    assert [tuple(r) for r in export.rolled_up(g.edges("R"), groups).collect()] == [("fa", "fb", "R", 2)]


def test_files(spark, tmp_path):
    def imports(path, content):
        import re

        for m in re.finditer(r"import '([^']+)'", content.decode()):
            yield path, m[1]

    (tmp_path / "src" / "lib").mkdir(parents=True)
    for name, text in {"src/a.ts": "import './lib/b'", "src/lib/b.ts": "x", "src/lib/index.ts": "y", "src/a.test.ts": "t", "Dockerfile": "FROM x", "skip.log": "z"}.items():
        (tmp_path / name).write_text(text)
    f = files.discovered(spark, str(tmp_path), exclude=["**/*.log"])
    m = {r.path: (r.language, r.kind) for r in files.manifest(f).collect()}
    assert m == {"src/a.ts": ("typescript", "source"), "src/lib/b.ts": ("typescript", "source"), "src/lib/index.ts": ("typescript", "source"), "src/a.test.ts": ("typescript", "test"), "Dockerfile": ("dockerfile", "source")}
    dirs, inside = files.directories(f)
    assert {r.path for r in dirs.collect()} == {".", "src", "src/lib"} and inside.count() == 2 + 5
    cached = files.manifest(f).filter("path <> 'src/a.ts'")
    assert [r.path for r in files.changed(files.manifest(f), cached).collect()] == ["src/a.ts"]
    found = files.facts(f, imports, "path string, source string")
    got = {(r.source, r.target) for r in files.resolved_imports(found, f.select("path"), ["ts"]).collect()}
    assert got == {("./lib/b", "src/lib/b.ts")}
    i = spark.createDataFrame([("src/x.ts", "./lib"), ("src/lib/q.ts", "../a"), ("src/x.ts", "pkg")], "path string, source string")
    assert {(r.source, r.target) for r in files.resolved_imports(i, f.select("path"), ["ts"]).collect()} == {("./lib", "src/lib/index.ts"), ("../a", "src/a.ts")}
    env = spark.createDataFrame([(".env", 1, "A=1 # c"), (".env", 2, "export B='x y'"), (".env", 3, "# no")], "path string, n long, line string")
    assert [(r.name, r.value) for r in files.env_variables(env).orderBy("n").collect()] == [("A", "1"), ("B", "x y")]


def test_names_resolve(spark):
    uses = spark.createDataFrame([(1, "a", "f"), (2, "b", "g"), (3, "b", "h"), (4, "b", "nope")], "use long, path string, name string")
    decl = spark.createDataFrame([("a.f", "a", "f", True), ("a.h", "a", "h", False), ("c.f", "c", "f", True)], "decl string, path string, name string, exported boolean")
    imp = spark.createDataFrame([("b", "g", "f", "a"), ("b", "h", "h", "a")], "path string, local string, imported string, target string")
    assert {(r.use, r.decl, r.via) for r in files.resolved_names(uses, decl, imp).collect()} == {(1, "a.f", "same-file"), (2, "a.f", "import")}


def test_watch(spark, tmp_path):
    store = GraphStore(spark, f"{tmp_path}/g", SCHEMA)
    (tmp_path / "in").mkdir()
    schema = SCHEMA.node_struct("B")

    def build(batch):
        return Graph(spark, SCHEMA, {"B": batch}, {})

    for k in range(2):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"id": f"b{k}", "s": "x"}) + "\n")
        watch.watched(spark, f"{tmp_path}/in", schema, watch.appending(store, build), f"{tmp_path}/cp").awaitTermination()
    assert {r.id for r in store.read().nodes["B"].collect()} == {"b0", "b1"}


def test_paging(spark):
    df = spark.range(7).withColumnRenamed("id", "k")
    args: dict = {"q": 1}
    seen = []
    while True:
        r = tools.paged("t", args, df, ["k"], limit=3)
        seen += [x["k"] for x in r["rows"]]
        if not r["nextCursor"]:
            break
        args = {"q": 1, "cursor": r["nextCursor"]}
    assert seen == list(range(7))
    with pytest.raises(ValueError):
        tools.paged("t", args | {"q": 2}, df, ["k"])
    cut = tools.within_budget({"a": list(range(10_000)), "b": [1]})
    assert len(json.dumps(cut)) <= tools.BUDGET_CHARS and cut["truncated"]
    assert tools.raw_rows(df, 5)["truncated"] and tools.verdict(df, 3) == {"count": 4, "max": 3, "ok": False}


def test_one_writer_at_a_time(spark, graph, tmp_path):
    store, other = GraphStore(spark, f"{tmp_path}/g", SCHEMA), GraphStore(spark, f"{tmp_path}/g", SCHEMA)
    with store.locked():
        with pytest.raises(TimeoutError), other.locked(wait=0):
            pass
        with store.locked(stale=-1):
            pass
    with other.locked(wait=0):
        pass
    head = store.write(graph.without_dangling(), told={"batch": 3})
    assert other.head()["batch"] == 3 and other.head() == head and other.collect_garbage(grace=-10) == []


def test_manifest_and_forms(spark, graph, tmp_path):
    export.write_jsonl(graph, str(tmp_path))
    told = {(r.kind, r.name): list(r.properties) for r in spark.read.json(f"{tmp_path}/manifest").collect()}
    assert told == {("node", "A"): ["x", "s"], ("node", "B"): ["s"], ("rel", "R"): ["w"]}
    d = spark.createDataFrame([("a,b", None, [1]), ("c", 2, None)], "s string, n int, l array<int>")
    assert tools.rendered(d, "csv") == 's,n,l\n"a,b",,[1]\nc,2,\n'
    assert tools.rendered(d, "table") == "s    n  l\na,b     [1]\nc    2"
    assert tools.rendered(d) == '[{"s": "a,b", "n": null, "l": [1]}, {"s": "c", "n": 2, "l": null}]'
    assert tools.parameters(["k=1", "s=x", 'l=["a"]']) == {"k": 1, "s": "x", "l": ["a"]}
    with pytest.raises(ValueError):
        tools.parameters(["k"])


def test_paths_and_names(spark):
    d = spark.createDataFrame([("/api/", "users//", None, "FooBar")], "a string, b string, c string, n string")
    r = d.select(routes.joined_path(F.col("a"), F.col("b"), F.col("c")).alias("p"), routes.joined_path(F.lit("")).alias("e"), names.name_contains(F.col("n"), "oB").alias("x"), names.name_contains(F.col("n"), "z").alias("y"), names.name_contains(F.col("n"), None).alias("z")).first()
    assert tuple(r) == ("/api/users", "/", True, False, True)
