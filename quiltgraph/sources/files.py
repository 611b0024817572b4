"""Files as a source: discovery, manifest, languages, folders, packages, parse caches, env files, facts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import directory_chain, ignored, longest_owner, matches_glob
from ..operators.storage import shipped

# File extensions of the languages that are told apart.
LANGUAGES = {
    "typescript": ["ts", "mts", "cts"], "tsx": ["tsx"], "javascript": ["js", "mjs", "cjs"], "jsx": ["jsx"], "python": ["py", "pyi"], "go": ["go"], "rust": ["rs"],
    "c": ["c"], "cpp": ["cc", "cpp", "cxx", "hpp", "hh", "hxx", "h"], "java": ["java"], "html": ["html", "htm"], "vue": ["vue"], "svelte": ["svelte"], "astro": ["astro"],
    "css": ["css"], "scss": ["scss"], "less": ["less"], "proto": ["proto"], "sql": ["sql"], "prisma": ["prisma"], "json": ["json"], "yaml": ["yml", "yaml"], "toml": ["toml"],
}
FILE = T.StructType([T.StructField("path", T.StringType()), T.StructField("content", T.BinaryType())])


def discovered(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, rules: list[tuple[str, bool, bool]] | None = None) -> DataFrame:
    """(path, size, mtime, content) of files below root: included globs (``!`` takes back), minus excluded and ignored ones."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    d = d.select(F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), f"^{base}/", "").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")
    keep = F.lit(not include or all(g.startswith("!") for g in include))
    for g in include or []:
        keep = F.when(matches_glob(F.col("path"), g.removeprefix("!")), F.lit(not g.startswith("!"))).otherwise(keep)
    for g in exclude or []:
        keep = keep & ~matches_glob(F.col("path"), g)
    if rules:
        keep = keep & ~ignored(F.col("path"), rules)
    return d.filter(keep)


def language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    name = F.element_at(F.split(path, "/"), -1)
    out = F.when(name.rlike("^Dockerfile(\\..*)?$"), "dockerfile").when(name.isin("Makefile", "makefile", "GNUmakefile"), "make").when(name == "CMakeLists.txt", "cmake")
    for lang, exts in LANGUAGES.items():
        out = out.when(ext.isin(exts), lang)
    return out


def classified(path: Column) -> Column:
    """test, fixture, generated, docs or source, by names along the path."""
    parts = F.split(F.lower(path), "/")
    folder = lambda *names: F.arrays_overlap(parts, F.array(*[F.lit(n) for n in names]))
    name = F.element_at(parts, -1)
    return (
        F.when(folder("fixtures", "__fixtures__", "testdata"), "fixture")
        .when(folder("test", "tests", "__tests__", "spec") | name.rlike(r"([._-](test|spec)\.[^.]+$)|^test_|_test\.[^.]+$"), "test")
        .when(folder("dist", "build", "generated", "__generated__") | name.rlike(r"\.(min|generated|pb)\.[^.]+$"), "generated")
        .when(folder("docs", "doc") | name.rlike(r"\.(md|rst|txt)$"), "docs").otherwise("source")
    )


def manifest(files: DataFrame) -> DataFrame:
    """path, language, kind, size, mtime, sha256."""
    p = F.col("path")
    return files.select("path", language(p).alias("language"), classified(p).alias("kind"), "size", "mtime", F.sha2("content", 256).alias("sha256"))


def changed(files: DataFrame, cached: DataFrame) -> DataFrame:
    """Files whose (path, sha256) a cache of parsed files doesn't have."""
    return files.join(cached.select("path", "sha256"), ["path", "sha256"], "left_anti")


def directories(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, path) of every folder and (src, dst) containment, folder to folder and folder to file."""
    chain = files.select("path", F.explode(directory_chain(F.col("path"))).alias("folder"))
    folders = chain.select(F.concat(F.lit("dir:"), "folder").alias("id"), F.col("folder").alias("path")).distinct()
    folders = folders.unionByName(files.groupBy().agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(F.lit("dir:.").alias("id"), F.lit(".").alias("path")))
    parent = F.when(F.col("path").contains("/"), F.concat(F.lit("dir:"), F.regexp_replace("path", "/[^/]*$", ""))).otherwise("dir:.")
    inner = folders.filter("path <> '.'").select(parent.alias("src"), F.col("id").alias("dst"))
    return folders, inner.unionByName(files.select(parent.alias("src"), F.concat(F.lit("file:"), "path").alias("dst")))


def packaged(files: DataFrame, packages: DataFrame) -> DataFrame:
    """(path, owner): the package folder each file is in."""
    return longest_owner(files, packages)


def env_variables(lines: DataFrame) -> DataFrame:
    """(path, n, line) of env files -> (path, n, name, value)."""
    form = r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_.]*)\s*=\s*(.*?)\s*$"
    value = F.regexp_extract("line", form, 2)
    bare = F.when(value.rlike(r"""^(["']).*\1$"""), F.expr("substring(value, 2, char_length(value) - 2)")).otherwise(F.regexp_replace("value", r"\s+#.*$", ""))
    return lines.filter(F.col("line").rlike(form)).withColumn("value", value).select("path", "n", F.regexp_extract("line", form, 1).alias("name"), bare.alias("value"))


def facts(files: DataFrame, extract: Callable[[str, bytes], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows that a per-file extractor finds: the way in for language and framework fact extractors."""
    shipped(files.sparkSession)
    struct = T.StructType.fromDDL(schema) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(schema)
    names = struct.fieldNames()

    def run(batches):
        for b in batches:
            rows = [dict(zip(names, r, strict=True)) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in extract(p, c)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows)

    return files.select("path", "content").mapInArrow(run, struct)


def resolved_imports(imports: DataFrame, files: DataFrame, extensions: list[str]) -> DataFrame:
    """(path, source) relative imports -> (path, source, target): the first candidate path that is a file.

    Candidates are the path itself, with each extension, then its index file with each extension.
    """
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    raw = F.filter(F.split(F.concat_ws("/", folder, F.col("source")), "/"), lambda p: (p != "") & (p != "."))
    flat = F.aggregate(raw, F.array().cast("array<string>"), lambda a, p: F.when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, p)))
    base = F.array_join(flat, "/")
    tails = ["", *[f".{e}" for e in extensions], *[f"/index.{e}" for e in extensions]]
    c = imports.filter(F.col("source").rlike(r"^\.\.?(/|$)")).withColumn("base", base)
    c = c.select("path", "source", F.posexplode(F.array(*[F.concat("base", F.lit(t)) for t in tails])).alias("at", "target"))
    hit = c.join(files.select(F.col("path").alias("target")), "target")
    return hit.groupBy("path", "source").agg(F.min_by("target", "at").alias("target"))


def resolved_names(uses: DataFrame, declared: DataFrame, imports: DataFrame) -> DataFrame:
    """(use, path, name), (decl, path, name, exported), (path, local, imported, target) -> (use, decl, via).

    A name is the file's own declaration, else what an import of that local name names in its target;
    several of the better way are no answer.
    """
    own = uses.join(declared.select("decl", "path", "name"), ["path", "name"]).select("use", "decl", F.lit(0).alias("rank"), F.lit("same-file").alias("via"))
    over = uses.join(imports, (uses["path"] == imports["path"]) & (uses["name"] == imports["local"])).select("use", F.col("target").alias("path"), F.col("imported").alias("name"))
    over = over.join(declared.filter("exported").select("decl", "path", "name"), ["path", "name"]).select("use", "decl", F.lit(1).alias("rank"), F.lit("import").alias("via"))
    both = own.unionByName(over).distinct()
    best = both.groupBy("use").agg(F.min("rank").alias("rank"))
    one = both.join(best, ["use", "rank"]).groupBy("use").agg(F.count(F.lit(1)).alias("n"), F.first("decl").alias("decl"), F.first("via").alias("via"))
    return one.filter("n = 1").select("use", "decl", "via")
