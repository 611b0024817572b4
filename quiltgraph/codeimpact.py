"""What a change reaches in a code graph, where a declaration is used, and what a file holds.

Tools take a ``Graph`` in the shape of ``codegraph.CODE`` and give DataFrames, in dictionaries where
there are several lists. Depths count calls from the change; a list's row has its least depth.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .codegraph import affected_tests, call_edges, file_imports, symbols
from .functions.diffs import changed_ranges, touched
from .functions.paths import matches_file_or_directory
from .graph import Graph
from .operators import tools, traverse
from .operators.storage import written


def _named(name: str, column: Column | str = "name") -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return (c == name) | c.endswith("." + name)


def _pairs(g: Graph, *kinds: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [g.rel_table(k).select("src", "dst") for k in kinds])


def _least(hits: DataFrame) -> DataFrame:
    return hits.groupBy("id").agg(F.min("depth").alias("depth"))


def _users(edges: DataFrame, at: DataFrame) -> DataFrame:
    """(id, depth): sources of edges whose targets are in ``at``."""
    return _least(edges.select(F.col("src").alias("id"), "dst").join(at.select(F.col("id").alias("dst"), "depth"), "dst"))


def _used(edges: DataFrame, by: DataFrame) -> DataFrame:
    return _users(traverse.turned(edges), by)


def component_impact(g: Graph, functions: DataFrame, depth: int) -> dict[str, DataFrame]:
    """Components that functions (id) define, what renders those, and the pages that show or load any."""
    methods = _pairs(g, "COMPONENT_DEFINED_BY").join(g.rel_table("DEFINES_METHOD").select(F.col("src").alias("dst"), F.col("dst").alias("method")), "dst")
    defined = _pairs(g, "COMPONENT_DEFINED_BY_FUNCTION").unionByName(methods.select("src", F.col("method").alias("dst")))
    start = defined.join(functions.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"))
    shown = traverse.bfs(_pairs(g, "RENDERS"), start, depth, up=True)
    loaded = _users(_pairs(g, "PAGE_LOADS"), functions.select("id", F.lit(0).alias("depth")))
    return {"components": shown, "pages": _least(_users(_pairs(g, "PAGE_RENDERS"), shown).unionByName(loaded))}


def store_impact(g: Graph, functions: DataFrame, rounds: int, stores: DataFrame | None = None) -> DataFrame:
    """(id, depth): stores that functions (id) write, act for or define, and ``stores`` themselves, at 0;
    then stores whose definitions read one of them, and so on, to ``rounds``."""
    own = _used(_pairs(g, "WRITES_STORE"), functions.select("id", F.lit(0).alias("depth"))).select("id")
    own = own.unionByName(_users(_pairs(g, "STORE_ACTION", "STORE_DEFINED_BY_FUNCTION"), functions.select("id", F.lit(0).alias("depth"))).select("id"))
    if stores is not None:
        own = own.unionByName(stores.select("id"))
    reads = g.rel_table("READS_STORE").select(F.col("src").alias("f"), F.col("dst").alias("src"))
    derived = reads.join(g.rel_table("STORE_DEFINED_BY_FUNCTION").select(F.col("dst").alias("f"), F.col("src").alias("dst")), "f").select("src", "dst")
    return traverse.bfs(derived, own, rounds)


def impact_lists(g: Graph, seeds: DataFrame, depth: int = 10, stores: DataFrame | None = None) -> dict[str, DataFrame]:
    """What a change of functions (id) reaches, each list as (id, depth) by least depth.

    callers; moduleCallers (files); routes (handled, or with a step, by any); entrypoints; components and pages;
    apiConsumers (calls that request such a route), with consumerComponents and consumerPages; stores with
    storeReaders, storeComponents and storePages; and what the changed functions themselves use: dataAccess,
    tables, envVars, config (depth 0). Names that match nothing give empty lists.
    """
    seeds = written(seeds.select("id").distinct())
    reached = traverse.bfs(call_edges(g), seeds, depth, up=True)
    at_module = g.query("MATCH (a:File)-[:MODULE_CALLS]->(c:Call)-[:CALL_RESOLVES_TO]->(b:Function) RETURN id(a) AS src, id(b) AS dst")
    routes = _users(_pairs(g, "ROUTE_HANDLED_BY", "ROUTE_LIFECYCLE_STEP"), reached)
    requests = _users(_pairs(g, "REQUESTS"), routes)
    asking = traverse.bfs(call_edges(g), _users(_pairs(g, "CALLS"), requests).select("id"), depth, up=True)
    changed = store_impact(g, reached, depth, stores)
    readers = _users(_pairs(g, "READS_STORE"), changed)
    reading = traverse.bfs(call_edges(g), readers.select("id"), depth, up=True)
    now = seeds.select("id", F.lit(0).alias("depth"))
    out = {"callers": reached.filter("depth > 0"), "moduleCallers": _users(at_module, reached), "routes": routes, "entrypoints": _users(_pairs(g, "ENTRYPOINT_HANDLED_BY"), reached)}
    out |= component_impact(g, reached, depth)
    across = component_impact(g, asking, depth)
    out |= {"apiConsumers": requests, "consumerComponents": across["components"], "consumerPages": across["pages"]}
    across = component_impact(g, reading, depth)
    out |= {"stores": changed, "storeReaders": readers, "storeComponents": across["components"], "storePages": across["pages"]}
    uses = {"dataAccess": ("ACCESSES_DATA_FUNCTION",), "tables": ("READS_FUNCTION", "WRITES_FUNCTION"), "envVars": ("USES_ENV_FUNCTION",), "config": ("CONSUMES_CONFIG_FUNCTION",)}
    return out | {name: _used(_pairs(g, *kinds), now) for name, kinds in uses.items()}


def impact_of(g: Graph, name: str | None = None, file: str | None = None, store: str | None = None, depth: int = 10) -> dict[str, DataFrame]:
    """``impact_lists`` of the functions of a name, of a file or folder, of both, or of a store's name."""
    f = symbols(g).filter(F.col("kind").isin("function", "method"))
    f = f.filter(_named(name)) if name is not None else f
    f = f.filter(matches_file_or_directory(F.col("file"), file)) if file is not None else f
    if name is None and file is None:
        f = f.limit(0)
    s = None if store is None else g.node_table("Store").filter(F.col("name") == store).select("id")
    return impact_lists(g, f.select("id"), depth, s)


def detect_changes(g: Graph, diff: DataFrame, depth: int = 10) -> dict[str, DataFrame]:
    """A unified diff's lines (diff, n, line) -> changedFiles (file, start, end), unscannedFiles (file),
    changedSymbols (declarations with a changed line), affectedTests (id, depth, via) and the impact of
    changed functions. Paths of the diff are those of the graph's files."""
    ranges = written(changed_ranges(diff).select("file", "start", "end").distinct())
    files = g.node_table("File").select("id", F.col("relativePath").alias("file"))
    spans = symbols(g).join(_spans(g), "id", "left").withColumnRenamed("endLine", "end_line")
    hit = written(touched(spans, ranges))
    changed = files.join(ranges.select("file"), "file", "left_semi")
    out = {"changedFiles": ranges.join(files.select("file"), "file", "left_semi"), "unscannedFiles": ranges.select("file").distinct().join(files.select("file"), "file", "left_anti")}
    out |= {"changedSymbols": hit.select("id", "kind", "name", "file", "line", "end_line"), "affectedTests": affected_tests(g, changed.select("id"))}
    return out | impact_lists(g, hit.filter(F.col("kind").isin("function", "method")).select("id"), depth)


def _spans(g: Graph) -> DataFrame:
    return reduce(DataFrame.unionByName, [g.node_table(x).select("id", "endLine") for x in ("Function", "Class", "Interface", "TypeAlias", "Enum")])


def find_references(g: Graph, name: str, file: str | None = None) -> DataFrame:
    """(kind, id, ref, line): everything that refers to declarations of a name, each once.

    call, module-call and callback name the caller and the call's line; route, lifecycle and entrypoint what
    the function handles; extends, implements and injection the class; renders the parent; import the file
    that imports the declaration's file (line of the import), as far as the declaration is exported.
    """
    wanted = symbols(g).filter(_named(name))
    wanted = wanted.filter(matches_file_or_directory(F.col("file"), file)) if file is not None else wanted
    wanted = written(wanted.select("id", "kind", "file", "exported"))
    none = F.lit(None).cast("long")
    made = [
        g.query("MATCH (a:Function)-[:CALLS]->(c:Call)-[:CALL_RESOLVES_TO]->(b:Function) RETURN 'call' AS kind, id(a) AS id, id(b) AS ref, c.line AS line"),
        g.query("MATCH (a:File)-[:MODULE_CALLS]->(c:Call)-[:CALL_RESOLVES_TO]->(b:Function) RETURN 'module-call' AS kind, id(a) AS id, id(b) AS ref, c.line AS line"),
        g.query("MATCH (b:Function)-[:PASSED_TO]->(c:Call) RETURN 'callback' AS kind, id(c) AS id, id(b) AS ref, c.line AS line"),
    ]
    whole = {"route": "ROUTE_HANDLED_BY", "lifecycle": "ROUTE_LIFECYCLE_STEP", "entrypoint": "ENTRYPOINT_HANDLED_BY", "extends": "EXTENDS", "implements": "IMPLEMENTS", "injection": "INJECTS"}
    made += [g.rel_table(rel).select(F.lit(kind).alias("kind"), F.col("src").alias("id"), F.col("dst").alias("ref"), none.alias("line")) for kind, rel in whole.items()]
    found = reduce(DataFrame.unionByName, made).join(wanted.select(F.col("id").alias("ref")), "ref", "left_semi")
    of = wanted.filter("exported and kind <> 'method'").select(F.col("id").alias("ref"), F.col("file").alias("path"))
    imports = g.query("MATCH (a:File)-[:IMPORTS]->(i:Import)-[:RESOLVES_TO]->(b:File) RETURN id(a) AS id, b.relativePath AS path, i.line AS line")
    imports = imports.join(of, "path").select(F.lit("import").alias("kind"), "id", "ref", "line")
    return found.select("kind", "id", "ref", "line").unionByName(imports).distinct()


def symbol_source(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """Declarations (file, line, end_line, ...) with ``source``: those lines of their file's whole text (file, text).

    Lines end with \\n or \\r\\n. A null line is the first, a null end the line itself; lines beyond the
    text give an empty source, a file without a text null.
    """
    lines = F.split("text", "\r?\n", -1)
    start = F.greatest(F.coalesce("line", F.lit(1)), F.lit(1)).cast("int")
    n = F.greatest(F.coalesce("end_line", "line", F.lit(1)).cast("int") - start + 1, F.lit(0))
    t = spans.join(texts.select("file", "text"), "file", "left")
    return t.withColumn("source", F.array_join(F.slice(lines, start, n), "\n")).drop("text")


def get_symbol_source(g: Graph, name: str, texts: DataFrame) -> DataFrame:
    s = symbols(g).filter(_named(name)).join(_spans(g), "id", "left").withColumnRenamed("endLine", "end_line")
    return symbol_source(s.select("id", "kind", "name", "file", "line", "end_line"), texts)


def file_outline(g: Graph, file: str) -> DataFrame:
    """(file, kind, name, line, owner) of a file or folder: declarations, methods and fields under their class,
    imports by source and entry points by trigger."""
    own = symbols(g).select("file", "kind", "name", "line", F.when(F.col("kind") == "method", F.substring_index("name", ".", 1)).alias("owner"))
    made = [
        own,
        g.query("MATCH (f:File)-[:DEFINES_CLASS]->(c:Class)-[:DEFINES_FIELD]->(d:Field) RETURN f.relativePath AS file, 'field' AS kind, d.name AS name, d.line AS line, c.name AS owner"),
        g.query("MATCH (f:File)-[:IMPORTS]->(i:Import) RETURN f.relativePath AS file, 'import' AS kind, i.source AS name, i.line AS line").withColumn("owner", F.lit(None).cast("string")),
        g.query("MATCH (f:File)-[:DECLARES_ENTRYPOINT]->(e:EntryPoint) RETURN f.relativePath AS file, 'entrypoint:' + e.kind AS kind, e.trigger AS name, e.line AS line").withColumn("owner", F.lit(None).cast("string")),
    ]
    return reduce(DataFrame.unionByName, made).filter(matches_file_or_directory(F.col("file"), file))


def runners(g: Graph, file: str, depth: int = 10) -> DataFrame:
    """(id, depth): entry points that start a file, or an entry point it declares, directly or through others.

    Who runs a file also runs the entry points that it declares.
    """
    declared = g.query("MATCH (f:File)-[:DECLARES_ENTRYPOINT]->(e:EntryPoint) RETURN id(f) AS src, id(e) AS dst")
    asked = g.node_table("File").filter(matches_file_or_directory(F.col("relativePath"), file)).select("id")
    by_file = g.rel_table("RUNS_FILE").select(F.col("src").alias("runner"), F.col("dst").alias("src")).join(declared, "src").select(F.col("runner").alias("src"), "dst")
    starts = written(_pairs(g, "RUNS_ENTRYPOINT").unionByName(by_file).distinct())
    own = declared.join(asked.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
    direct = _pairs(g, "RUNS_FILE").join(asked.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"))
    first = direct.unionByName(starts.join(own.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"))).distinct()
    return traverse.bfs(starts, first, depth - 1, up=True).select("id", (F.col("depth") + 1).alias("depth"))


def list_rpcs(g: Graph) -> DataFrame:
    """(id, service, name, file, request, response, served_by, implemented_by): lists sorted, empty ones empty."""
    base = g.query("MATCH (f:File)-[:DECLARES_SERVICE]->(s:Service)-[:HAS_RPC]->(r:Rpc) RETURN id(r) AS id, s.name AS service, r.name AS name, f.relativePath AS file")
    for name, rel, label in (("request", "RPC_REQUEST", "Message"), ("response", "RPC_RESPONSE", "Message"), ("served_by", "RPC_SERVED_BY", "Interface"), ("implemented_by", "RPC_IMPLEMENTED_BY", "Function")):
        t = g.rel_table(rel).select(F.col("src").alias("id"), F.col("dst").alias("t")).join(g.node_table(label).select(F.col("id").alias("t"), F.col("name").alias("n")), "t")
        base = base.join(t.groupBy("id").agg(F.array_sort(F.collect_set("n")).alias(name)), "id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return base


def component_usages(g: Graph, name: str) -> DataFrame:
    """(kind, id, ref): components that render those of a name, and pages that show them."""
    wanted = g.node_table("Component").filter(F.col("name") == name).select("id")
    return tools.references(wanted, {"component": _pairs(g, "RENDERS"), "page": _pairs(g, "PAGE_RENDERS")})


def unresolved_calls(g: Graph) -> DataFrame:
    """(owner, call, name, line): calls of functions and files that resolve to no function and request no route."""
    c = g.query("MATCH (a)-[:CALLS|MODULE_CALLS]->(c:Call) RETURN id(a) AS owner, id(c) AS call, c.name AS name, c.line AS line")
    for done in ("CALL_RESOLVES_TO", "REQUESTS"):
        c = c.join(g.rel_table(done).select(F.col("src").alias("call")), "call", "left_anti")
    return c.select("owner", "call", "name", "line")


def explore(g: Graph, names: list[str], depth: int = 6) -> dict[str, DataFrame]:
    """Declarations of some names with their callers and callees, and the shortest call chains among them."""
    chosen = written(symbols(g).filter(F.split_part("name", F.lit("."), F.lit(-1)).isin(names)))
    e = written(call_edges(g).select("src", "dst").distinct())
    sizes = chosen.select("id", "kind", "name", "file", "line").join(traverse.degrees(e), "id", "left")
    sizes = sizes.select("id", "kind", "name", "file", "line", F.coalesce("n_in", F.lit(0)).alias("callers"), F.coalesce("n_out", F.lit(0)).alias("callees"))
    chains = traverse.shortest_chains(e, chosen.select("id"), depth).filter("depth > 0").join(chosen.select("id"), "id", "left_semi")
    return {"symbols": sizes, "chains": chains.select("seed", "id", "depth", "path")}


def routes_in_detail(g: Graph, depth: int = 4) -> dict[str, DataFrame]:
    """steps (route, role, function, name): handlers and lifecycle steps; chain (route, id, depth): what those
    call, to ``depth``; consumers (route, call)."""
    a = g.query("MATCH (r:Route)-[:ROUTE_HANDLED_BY]->(h:Function) RETURN id(r) AS route, 'handler' AS role, id(h) AS function, h.name AS name")
    b = g.query("MATCH (r:Route)-[s:ROUTE_LIFECYCLE_STEP]->(h:Function) RETURN id(r) AS route, coalesce(s.role, 'lifecycle') AS role, id(h) AS function, h.name AS name")
    steps = written(a.unionByName(b).distinct())
    e = written(call_edges(g).select("src", "dst").distinct())
    level = written(steps.select("route", F.col("function").alias("id"), F.lit(0).alias("depth")).distinct())
    seen = [level]
    for k in range(1, depth + 1):
        step = seen[-1].join(e, F.col("id") == F.col("src")).select("route", F.col("dst").alias("id")).distinct()
        level = written(step.join(reduce(DataFrame.unionByName, seen).select("route", "id"), ["route", "id"], "left_anti").withColumn("depth", F.lit(k)))
        if level.isEmpty():
            break
        seen.append(level)
    return {"steps": steps, "chain": reduce(DataFrame.unionByName, seen), "consumers": g.rel_table("REQUESTS").select(F.col("dst").alias("route"), F.col("src").alias("call"))}


def imported_files(g: Graph, file: str, depth: int = 20) -> DataFrame:
    """(id, depth): files that a file imports, directly or not."""
    at = g.node_table("File").filter(matches_file_or_directory(F.col("relativePath"), file)).select("id")
    return traverse.bfs(file_imports(g), at, depth)
