"""Tools over a code graph: files, declarations, calls, routes, data access, stores, pages.

Each tool takes a ``Graph`` in the shape of ``CODE`` (tables may be empty) and gives a DataFrame.
``sources.records.read_graph(spark, path, base=CODE)`` reads one from JSON lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.names import match_score
from .functions.paths import folder_at, matches_file_or_directory
from .graph import Graph
from .operators import components, traverse
from .schema import GraphSchema, NodeTable, RelTable

S, I, B = "STRING", "INT64", "BOOLEAN"
DECLARED = {"name": S, "line": I, "endLine": I, "isExported": B}

# Labels, relationship types and the properties that the tools read.
CODE = GraphSchema(
    [
        NodeTable("Repo", {"path": S, "name": S}), NodeTable("Package", {"name": S, "relativePath": S}), NodeTable("Directory", {"relativePath": S}),
        NodeTable("File", {"relativePath": S, "language": S, "isTest": B, "unresolvedCalls": S}), NodeTable("Import", {"source": S, "line": I, "isTypeOnly": B}),
        NodeTable("Function", {**DECLARED, "className": S, "kind": S}), NodeTable("Class", DECLARED), NodeTable("Interface", DECLARED), NodeTable("TypeAlias", DECLARED), NodeTable("Enum", DECLARED),
        NodeTable("Variable", {"name": S, "line": I, "isExported": B}), NodeTable("Call", {"name": S, "callee": S, "line": I, "httpMethod": S, "httpUrl": S}),
        NodeTable("Route", {"method": S, "path": S, "fullPath": S, "framework": S, "line": I}), NodeTable("EntryPoint", {"kind": S, "trigger": S, "line": I}), NodeTable("EnvVar", {"name": S}),
        NodeTable("Page", {"fullPath": S, "framework": S}), NodeTable("Component", {"name": S, "framework": S, "line": I}), NodeTable("Store", {"name": S, "library": S}),
        NodeTable("ConfigValue", {"name": S, "value": S}), NodeTable("DataModel", {"name": S, "library": S}), NodeTable("Table", {"name": S, "library": S}),
        NodeTable("Field", {"name": S, "typeName": S, "line": I}), NodeTable("Service", {"name": S, "line": I}), NodeTable("Rpc", {"name": S, "line": I}), NodeTable("Message", {"name": S, "line": I}),
    ],
    [
        RelTable("CONTAINS_FILE", "Directory", "File"), RelTable("IMPORTS", "File", "Import"), RelTable("RESOLVES_TO", "Import", "File"), RelTable("DEFINES_FUNCTION", "File", "Function"),
        RelTable("DEFINES_CLASS", "File", "Class"), RelTable("DEFINES_INTERFACE", "File", "Interface"), RelTable("DEFINES_TYPE_ALIAS", "File", "TypeAlias"), RelTable("DEFINES_ENUM", "File", "Enum"),
        RelTable("DEFINES_VARIABLE", "File", "Variable"), RelTable("DEFINES_METHOD", "Class", "Function"), RelTable("EXTENDS", "Class", "Class"), RelTable("IMPLEMENTS", "Class", "Interface"),
        RelTable("CALLS", "Function", "Call"), RelTable("CALL_RESOLVES_TO", "Call", "Function", {"via": S, "provenance": S}), RelTable("MODULE_CALLS", "File", "Call"),
        RelTable("DECLARES_ROUTE", "File", "Route"), RelTable("ROUTE_HANDLED_BY", "Route", "Function"), RelTable("DECLARES_ENTRYPOINT", "File", "EntryPoint"), RelTable("ENTRYPOINT_HANDLED_BY", "EntryPoint", "Function"),
        RelTable("REQUESTS", "Call", "Route", {"method": S, "url": S, "match": S}), RelTable("USES_ENV_FILE", "File", "EnvVar"), RelTable("USES_ENV_FUNCTION", "Function", "EnvVar"), RelTable("DECLARES_ENV", "Repo", "EnvVar"),
        RelTable("ACCESSES_DATA_FUNCTION", "Function", "DataModel", {"operation": S, "line": I}), RelTable("MAPS_TO_TABLE", "DataModel", "Table"), RelTable("READS_FUNCTION", "Function", "Table"), RelTable("WRITES_FUNCTION", "Function", "Table"),
        RelTable("DECLARES_COMPONENT", "File", "Component"), RelTable("RENDERS", "Component", "Component"), RelTable("DECLARES_PAGE", "File", "Page"), RelTable("PAGE_RENDERS", "Page", "Component"),
        RelTable("DECLARES_STORE", "File", "Store"), RelTable("READS_STORE", "Function", "Store"), RelTable("WRITES_STORE", "Function", "Store"),
        RelTable("STORE_ACTION", "Store", "Function"), RelTable("STORE_DEFINED_BY_FUNCTION", "Store", "Function"), RelTable("DEFINES_FIELD", "Class", "Field"), RelTable("PASSED_TO", "Function", "Call"),
        RelTable("ROUTE_LIFECYCLE_STEP", "Route", "Function", {"role": S}), RelTable("INJECTS", "Class", "Class"), RelTable("CONSUMES_CONFIG_FUNCTION", "Function", "ConfigValue"),
        RelTable("COMPONENT_DEFINED_BY_FUNCTION", "Component", "Function"), RelTable("COMPONENT_DEFINED_BY", "Component", "Class"), RelTable("PAGE_LOADS", "Page", "Function"),
        RelTable("RUNS_ENTRYPOINT", "EntryPoint", "EntryPoint", {"command": S}), RelTable("RUNS_FILE", "EntryPoint", "File", {"command": S}),
        RelTable("DECLARES_SERVICE", "File", "Service"), RelTable("HAS_RPC", "Service", "Rpc"), RelTable("RPC_REQUEST", "Rpc", "Message"), RelTable("RPC_RESPONSE", "Rpc", "Message"),
        RelTable("RPC_SERVED_BY", "Rpc", "Interface"), RelTable("RPC_IMPLEMENTED_BY", "Rpc", "Function"),
    ],
)
KINDS = {"function": "DEFINES_FUNCTION", "class": "DEFINES_CLASS", "interface": "DEFINES_INTERFACE", "type": "DEFINES_TYPE_ALIAS", "enum": "DEFINES_ENUM", "variable": "DEFINES_VARIABLE"}


def symbols(g: Graph) -> DataFrame:
    """(id, kind, name, file, line, exported): declarations of files, and methods by their class's file."""
    out = None
    for kind, rel in KINDS.items():
        d = g.query(f"MATCH (f:File)-[:{rel}]->(s) RETURN id(s) AS id, '{kind}' AS kind, s.name AS name, f.relativePath AS file, s.line AS line, s.isExported AS exported")
        out = d if out is None else out.unionByName(d)
    m = g.query("MATCH (f:File)-[:DEFINES_CLASS]->(c:Class)-[:DEFINES_METHOD]->(s:Function) RETURN id(s) AS id, 'method' AS kind, c.name + '.' + s.name AS name, f.relativePath AS file, s.line AS line, s.isExported AS exported")
    return out.unionByName(m).dropDuplicates(["id"])


def find_definitions(g: Graph, name: str) -> DataFrame:
    return symbols(g).filter((F.col("name") == name) | F.col("name").endswith("." + name))


def search_symbols(g: Graph, text: str, limit: int = 50) -> DataFrame:
    d = symbols(g).select("*", match_score(F.element_at(F.split("name", r"\."), -1), text).alias("m")).filter("m is not null")
    return d.select("id", "kind", "name", "file", "line", "m.*").orderBy(F.col("score").desc(), F.char_length("name"), "file", "line").limit(limit)


def call_edges(g: Graph) -> DataFrame:
    """(src, dst, provenance): function to function, over resolved calls."""
    return g.query("MATCH (a:Function)-[:CALLS]->(c:Call)-[r:CALL_RESOLVES_TO]->(b:Function) RETURN DISTINCT id(a) AS src, id(b) AS dst, coalesce(r.provenance, 'exact') AS provenance")


def find_callers(g: Graph, name: str) -> DataFrame:
    """(caller, kind, target, line): functions and files that call functions of a name."""
    a = g.query("MATCH (a:Function)-[:CALLS]->(c:Call)-[:CALL_RESOLVES_TO]->(b:Function) WHERE b.name = $n RETURN id(a) AS caller, 'function' AS kind, id(b) AS target, c.line AS line", n=name)
    b = g.query("MATCH (a:File)-[:MODULE_CALLS]->(c:Call)-[:CALL_RESOLVES_TO]->(b:Function) WHERE b.name = $n RETURN id(a) AS caller, 'file' AS kind, id(b) AS target, c.line AS line", n=name)
    return a.unionByName(b)


def trace_calls(g: Graph, name: str, depth: int = 6, up: bool = False) -> DataFrame:
    """(seed, id, depth, path, weakest): shortest call chains from functions of a name; weakest 2 exact, 1 inferred, 0 by name."""
    e = call_edges(g).select("src", "dst", F.when(F.col("provenance") == "by-name", 0).when(F.col("provenance") == "inferred", 1).otherwise(2).cast("long").alias("strength"))
    seeds = g.node_table("Function").filter(F.col("name") == name).select("id")
    return traverse.shortest_chains(traverse.turned(e) if up else e, seeds, depth)


def list_exports(g: Graph, file: str) -> DataFrame:
    return symbols(g).filter(F.col("exported") & matches_file_or_directory(F.col("file"), file))


def list_routes(g: Graph, unconsumed: bool = False) -> DataFrame:
    r = g.query("MATCH (f:File)-[:DECLARES_ROUTE]->(r:Route) OPTIONAL MATCH (c:Call)-[:REQUESTS]->(r) WITH f, r, count(c) AS consumers RETURN id(r) AS id, r.method AS method, coalesce(r.fullPath, r.path) AS path, r.framework AS framework, f.relativePath AS file, consumers")
    return r.filter("consumers = 0") if unconsumed else r


def route_handlers(g: Graph) -> DataFrame:
    return g.query("MATCH (r:Route) OPTIONAL MATCH (r)-[:ROUTE_HANDLED_BY]->(h:Function) RETURN id(r) AS route, id(h) AS handler, h.name AS name")


def api_consumers(g: Graph) -> DataFrame:
    return g.query("MATCH (c:Call)-[q:REQUESTS]->(r:Route) OPTIONAL MATCH (f:Function)-[:CALLS]->(c) RETURN id(r) AS route, id(c) AS call, q.url AS url, q.match AS match, id(f) AS function")


def list_entrypoints(g: Graph) -> DataFrame:
    return g.query("MATCH (f:File)-[:DECLARES_ENTRYPOINT]->(e:EntryPoint) OPTIONAL MATCH (e)-[:ENTRYPOINT_HANDLED_BY]->(h:Function) RETURN id(e) AS id, e.kind AS kind, e.trigger AS trigger, f.relativePath AS file, h.name AS handler")


def list_env(g: Graph) -> DataFrame:
    """(name, readers, declared): variables with their number of readers; unread ones have 0."""
    files = g.rel_table("USES_ENV_FILE").select("dst", "src").unionByName(g.rel_table("USES_ENV_FUNCTION").select("dst", "src"))
    read = files.groupBy("dst").agg(F.count_distinct("src").alias("readers"))
    told = g.rel_table("DECLARES_ENV").select("dst").distinct().withColumn("declared", F.lit(True))
    e = g.node_table("EnvVar").select(F.col("id").alias("dst"), "name")
    return e.join(read, "dst", "left").join(told, "dst", "left").select("name", F.coalesce("readers", F.lit(0)).alias("readers"), F.coalesce("declared", F.lit(False)).alias("declared"))


def list_data_access(g: Graph) -> DataFrame:
    return g.query("MATCH (f:Function)-[a:ACCESSES_DATA_FUNCTION]->(m:DataModel) RETURN id(f) AS function, m.name AS model, m.library AS library, a.operation AS operation, a.line AS line")


def list_tables(g: Graph) -> DataFrame:
    """(name, readers, writers): functions that read and write each table."""
    r = g.rel_table("READS_FUNCTION").select("dst", "src", F.lit(True).alias("reads")).unionByName(g.rel_table("WRITES_FUNCTION").select("dst", "src", F.lit(False).alias("reads")))
    by = r.groupBy("dst").agg(F.count_distinct(F.when(F.col("reads"), F.col("src"))).alias("readers"), F.count_distinct(F.when(~F.col("reads"), F.col("src"))).alias("writers"))
    t = g.node_table("Table").select(F.col("id").alias("dst"), "name")
    return t.join(by, "dst", "left").select("name", F.coalesce("readers", F.lit(0)).alias("readers"), F.coalesce("writers", F.lit(0)).alias("writers"))


def list_pages(g: Graph) -> DataFrame:
    return g.query("MATCH (f:File)-[:DECLARES_PAGE]->(p:Page) OPTIONAL MATCH (p)-[:PAGE_RENDERS]->(c:Component) RETURN id(p) AS id, p.fullPath AS path, f.relativePath AS file, c.name AS component")


def list_stores(g: Graph) -> DataFrame:
    return g.query("MATCH (s:Store) OPTIONAL MATCH (r:Function)-[:READS_STORE]->(s) OPTIONAL MATCH (w:Function)-[:WRITES_STORE]->(s) RETURN id(s) AS id, s.name AS name, count(DISTINCT r) AS readers, count(DISTINCT w) AS writers")


def component_tree(g: Graph, name: str, depth: int = 10, up: bool = False) -> DataFrame:
    seeds = g.node_table("Component").filter(F.col("name") == name).select("id")
    return traverse.bfs(g.rel_table("RENDERS").select("src", "dst"), seeds, depth, up)


def file_imports(g: Graph, types_too: bool = True) -> DataFrame:
    """(src, dst) between files."""
    where = "" if types_too else "WHERE coalesce(i.isTypeOnly, false) = false"
    return g.query(f"MATCH (a:File)-[:IMPORTS]->(i:Import)-[:RESOLVES_TO]->(b:File) {where} RETURN DISTINCT id(a) AS src, id(b) AS dst")


def import_cycles(g: Graph, types_too: bool = False) -> DataFrame:
    e = file_imports(g, types_too)
    return components.shortest_cycles(e, components.scc(e))


def import_chain(g: Graph, source: str, target: str, depth: int = 6) -> DataFrame:
    at = lambda p: g.node_table("File").filter(F.col("relativePath") == p).select("id")
    return traverse.shortest_chains(file_imports(g), at(source), depth).join(at(target), "id", "left_semi").select("depth", "path")


def affected_tests(g: Graph, changed: DataFrame, depth: int = 20) -> DataFrame:
    """(id, depth, via): test files that import changed files (id), directly or not."""
    hit = traverse.bfs_with_via(file_imports(g), changed, depth, up=True)
    return hit.join(g.node_table("File").filter("isTest").select("id"), "id", "left_semi")


def unused_exports(g: Graph) -> DataFrame:
    """Exported functions of files that nothing calls, handles or imports the file of."""
    f = g.query("MATCH (f:File)-[:DEFINES_FUNCTION]->(s:Function) WHERE s.isExported = true AND coalesce(f.isTest, false) = false RETURN id(s) AS id, s.name AS name, id(f) AS file")
    used = [g.rel_table("CALL_RESOLVES_TO").select(F.col("dst").alias("id")), g.rel_table("ROUTE_HANDLED_BY").select(F.col("dst").alias("id")), g.rel_table("ENTRYPOINT_HANDLED_BY").select(F.col("dst").alias("id"))]
    for u in used:
        f = f.join(u, "id", "left_anti")
    return f.join(file_imports(g).select(F.col("dst").alias("file")), "file", "left_anti").select("id", "name", "file")


def architecture(g: Graph, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """(folder, files, tests) and (from, to, imports) at a folder depth."""
    f = g.node_table("File").select("id", folder_at(F.col("relativePath"), depth).alias("folder"), F.coalesce("isTest", F.lit(False)).alias("test"))
    e = file_imports(g).join(f.select(F.col("id").alias("src"), F.col("folder").alias("from")), "src").join(f.select(F.col("id").alias("dst"), F.col("folder").alias("to")), "dst")
    return f.groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.count_if("test").alias("tests")), e.groupBy("from", "to").agg(F.count(F.lit(1)).alias("imports"))


def subsystems(g: Graph) -> DataFrame:
    pairs = traverse.weighted_pairs(file_imports(g))
    return components.communities_summary(components.louvain(pairs), pairs)
