"""Names, globs, ignore rules, routes, diffs, SQL texts: table-driven."""

import re

import pytest
from pyspark.sql import functions as F

from quiltgraph.functions import diffs, names, paths, routes, sqltext

GLOBS = [
    ("*.ts", "a.ts", True), ("*.ts", "x/a.ts", False), ("**/*.ts", "a.ts", True), ("**/*.ts", "x/y/a.ts", True), ("src/**", "src/x/y", True), ("src/**", "src", False), ("a?c", "abc", True), ("a?c", "a/c", False),
    ("[ab].c", "a.c", True), ("[!ab].c", "a.c", False), ("[!ab].c", "x.c", True), ("{a,b}/*.x", "b/q.x", True), ("{a,b}/*.x", "c/q.x", False), ("a.b", "axb", False), ("\\*.md", "*.md", True), ("\\*.md", "x.md", False), ("a**b", "axxb", True), ("a**b", "ax/xb", False),
]


@pytest.mark.parametrize(("pattern", "path", "want"), GLOBS)
def test_glob(pattern, path, want):
    assert bool(re.search(paths.glob_regex(pattern), path)) is want


def test_globs_in_spark(spark):
    d = spark.createDataFrame([(p, w) for _, p, w in GLOBS], "path string, want boolean")
    row = d.select(*[F.first(paths.matches_glob(F.lit(p), g)).alias(f"c{i}") for i, (g, p, _) in enumerate(GLOBS)]).first()
    assert list(row) == [w for _, _, w in GLOBS]


def test_ignore_rules(spark):
    rules = paths.ignore_rules("# all logs\n*.log\n!keep.log\nbuild/\n/top.txt\ndocs/*.md\n") + paths.ignore_rules("*.log\n", "sub")
    want = {"a.log": True, "x/b.log": True, "keep.log": False, "x/keep.log": False, "sub/keep.log": True, "build/x": True, "a/build/x/y": True, "build": False, "top.txt": True, "a/top.txt": False, "docs/a.md": True, "docs/x/a.md": False, "src/a.c": False}
    d = spark.createDataFrame([(p,) for p in want], "path string")
    assert {r.path: r.i for r in d.select("path", paths.ignored(F.col("path"), rules).alias("i")).collect()} == want


def test_paths(spark):
    d = spark.createDataFrame([("src/users/service.ts",), ("a",)], "path string")
    r = d.select(paths.matches_file(F.col("path"), "./users/service.ts").alias("f"), paths.matches_file_or_directory(F.col("path"), "users/").alias("g"), paths.directory_chain(F.col("path")).alias("c"), paths.folder_at(F.col("path"), 1).alias("t")).collect()
    assert [tuple(x) for x in r] == [(True, True, ["src", "src/users"], "src"), (False, False, [], "a")]
    o = paths.longest_owner(spark.createDataFrame([("a/b/c.x",), ("a/d.x",), ("z.x",)], "path string"), spark.createDataFrame([("a",), ("a/b",)], "owner string"))
    assert {r.path: r.owner for r in o.collect()} == {"a/b/c.x": "a/b", "a/d.x": "a", "z.x": None}


def test_names(spark):
    d = spark.createDataFrame([(n,) for n in ["getUserName", "getusername", "GetUserNameFast", "g_u_n", "xgetUserName", "goodUnitsNoise", "HTTPServer2x", "none"]], "name string")
    got = {r["name"]: r.m and (r.m["match"], r.m["score"]) for r in d.select("name", names.match_score(F.col("name"), "getUserName").alias("m")).collect()}
    assert got["getUserName"] == ("exact", 6999) and got["getusername"] == ("exact-ignore-case", 5999) and got["GetUserNameFast"] == ("prefix", 4959) and got["xgetUserName"][0] == "substring" and got["none"] is None
    got = {r["name"]: r.m and r.m["match"] for r in d.select("name", names.match_score(F.col("name"), "gun").alias("m")).collect()}
    assert got["getUserName"] == "initials" and got["g_u_n"] == "initials" and got["goodUnitsNoise"] == "initials" and got["none"] is None
    w = d.filter("name = 'HTTPServer2x'").select(names.identifier_words(F.col("name")).alias("w"), names.in_order(F.col("name"), "hs2").alias("s"), names.in_order(F.col("name"), "2h").alias("n")).first()
    assert list(w.w) == ["HTTP", "Server", "2", "x"] and w.s is not None and w.n is None
    t = spark.range(1).select(names.question_terms(F.lit("How does Service.find handle the ids?"), ["how", "does", "the"]).alias("t")).first().t
    assert list(t) == ["Service.find", "find", "handle", "ids"]


def test_routes(spark):
    r = [("a", "GET", "/users/:id"), ("b", "GET", "/users/me"), ("c", "ALL", "/files/*"), ("d", "GET", "/:x/:y"), ("e", "GET", "/{p}/{q}"), ("f", "GET", "/"), ("g", "POST", "/users/[id]"), ("h", "GET", "/opt/[[...rest]]")]
    q = [(1, "get", "/users/7"), (2, "GET", "/users/me?x=1"), (3, "GET", "http://h/files/a/b"), (4, "GET", "/other/thing"), (5, "GET", "/"), (6, "POST", "/users/9"), (7, "GET", "/opt"), (8, "GET", "/files"), (9, "GET", "/caf%C3%A9")]
    got = {x.request: (x.route, x.score, x["match"]) for x in routes.best_routes(spark.createDataFrame(q, "request long, method string, url string"), spark.createDataFrame(r, "route string, method string, pattern string")).collect()}
    assert got == {1: ("a", 5, "parameter"), 2: ("b", 6, "exact"), 3: ("c", 4, "catch-all"), 5: ("f", 0, "exact"), 6: ("g", 5, "parameter"), 7: ("h", 4, "catch-all")}


DIFF = """diff --git a/x.py b/x.py
--- a/x.py
+++ b/x.py
@@ -1,2 +3,4 @@ def f
@@ -9 +12 @@
@@ -20,3 +0,0 @@
--- a/gone.py
+++ /dev/null
@@ -1,5 +0,0 @@
--- /dev/null
+++ b/new.py
@@ -0,0 +1,7 @@"""


def test_diff(spark):
    lines = spark.createDataFrame([(1, n, x) for n, x in enumerate(DIFF.split("\n"))], "diff long, n long, line string")
    got = sorted((r.file, r.start, r.end) for r in diffs.changed_ranges(lines).collect())
    assert got == [("gone.py", 1, diffs.END), ("new.py", 1, 7), ("x.py", 1, 1), ("x.py", 3, 6), ("x.py", 12, 12)]
    s = spark.createDataFrame([("s", "x.py", 6, 9), ("t", "x.py", 7, 11), ("u", "gone.py", 99, None), ("v", "new.py", 8, 8)], "id string, file string, line long, end_line long")
    assert sorted(r.id for r in diffs.touched(s, diffs.changed_ranges(lines)).collect()) == ["s", "u"]


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("SELECT * FROM a JOIN b.c ON 1 -- FROM x", [("a", "read"), ("b.c", "read")]), ("INSERT INTO \"t\" SELECT 1 FROM u", [("t", "write"), ("u", "read")]), ("UPDATE t SET x = 'FROM z'", [("t", "write")]),
        ("DELETE FROM t WHERE id IN (SELECT id FROM s)", [("s", "read"), ("t", "write")]), ("WITH q AS (SELECT 1 FROM r) SELECT * FROM q", [("r", "read")]), ("", []),
    ],
)
def test_sql_text(sql, want):
    assert sqltext.accesses(sql) == want
