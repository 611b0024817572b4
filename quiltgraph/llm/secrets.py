"""Secret scans: strong patterns, and weak parts that are reported only beside complementary parts.

Each kind's matches and their code point spans come from regular expressions over the whole text;
the parts of a text are then linked in order of position. A text's scopes are its paragraphs (cut at
blank lines). Within a scope, a weak candidate is joined to the nearest parts of the complementary
roles before and after it, which is the interval join: if any part lies within REACH code points,
the nearest does. Weak candidates without all the roles they need are dropped.

Kinds, base first: assign, access, hex (always reported); then weak: ident (other access
identifiers; needs a secret), key (40 characters of base 64, mixed; needs an identifier), endpoint
(a URL; needs an identifier and a secret).

Defined results: null texts are empty; texts without spans give counts 0, the digest of the empty
string and empty spans; rows with equal doc_id each give a row; parts that start at one place follow by
kind; very long texts are one row (the parts of one text meet in one task); an empty table gives no
rows; only doc_id and text are read. REACH is what a scope's interval is: parts further apart than that
aren't complementary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: kind -> pattern, group 1 is what counts for LEAST (the whole match where there is none).
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {
    "assign": ASSIGN,
    "access": r"(AKIA[A-Z0-9]+)",
    "hex": r"([0-9a-f]{32,})",
    "ident": r"((?<![A-Za-z0-9])(?:ASIA|AROA|AIDA|AGPA|ANPA)[A-Z0-9]{12,})",
    "key": r"((?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[0-9])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-]))",
    "endpoint": r"(https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[A-Za-z0-9._~/%-]*)?)",
    "break": r"(\n[\x20\x09-\x0D]*\n)",
}
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = list(PATTERNS)[:-1]
BASE = 3
IDENTIFIERS, SECRETS = ("access", "ident"), ("assign", "key", "hex")
REACH = 400


def matches(text: Column, kind: str) -> Column:
    """array<struct<kind, gap, size, counted>> of all leftmost matches: code points skipped and taken."""
    k = list(PATTERNS).index(kind)
    p = F.lit(rf"(?s)\G(.*?)({PATTERNS[kind]})")  # \G: what follows the last match is read once, not from every place
    parts = F.arrays_zip(*[F.regexp_extract_all(text, p, F.lit(g)).alias(n) for g, n in ((1, "a"), (2, "b"), (3, "c"))])
    made = F.transform(parts, lambda x: F.struct(F.lit(k).alias("kind"), F.char_length(x["a"]).alias("gap"), F.char_length(x["b"]).alias("size"), F.char_length(x["c"]).alias("counted")))
    none = F.array().cast("array<struct<kind:int,gap:int,size:int,counted:int>>")
    return F.when(text.rlike(PATTERNS[kind]), made).otherwise(none)


def parts(docs: DataFrame) -> DataFrame:
    """row_id, doc_id and one row for each match: kind, start, end, counted; one with null kind for texts without any."""
    t = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = t.select("row_id", "doc_id", *[matches(F.col("text"), k).alias(k) for k in KINDS], F.col("text"))
    some = F.greatest(*[F.size(k) for k in KINDS]) > 0
    weak = F.greatest(*[F.size(k) for k in KINDS[BASE:]]) > 0
    breaks = F.when(weak, matches(F.col("text"), "break")).otherwise(F.array().cast("array<struct<kind:int,gap:int,size:int,counted:int>>"))
    all_parts = F.when(some, F.concat(*[F.col(k) for k in KINDS], breaks)).otherwise(F.array().cast("array<struct<kind:int,gap:int,size:int,counted:int>>"))
    rows = found.select("row_id", "doc_id", F.posexplode_outer(all_parts).alias("n", "p")).select("row_id", "doc_id", "n", "p.*")
    upto = Window.partitionBy("row_id", "kind").orderBy("n")
    end = F.sum(F.col("gap").cast("long") + F.col("size")).over(upto)
    return rows.select("row_id", "doc_id", "kind", "counted", (end - F.col("size")).alias("start"), end.alias("end"))


def _of(kinds: tuple[str, ...]) -> Column:
    return F.col("kind").isin([list(PATTERNS).index(k) for k in kinds])


def linked(found: DataFrame, reach: int = REACH) -> DataFrame:
    """``found`` without failing matches and without weak candidates that lack a complementary part in scope."""
    enough = F.col("counted") >= F.coalesce(*[F.when(F.col("kind") == i, LEAST.get(k, 0)) for i, k in enumerate(PATTERNS)])
    d = found.filter(F.col("kind").isNull() | enough)
    order = Window.partitionBy("row_id").orderBy("start", "kind")
    d = d.withColumn("scope", F.count_if(F.col("kind") == list(PATTERNS).index("break")).over(order))
    scope = Window.partitionBy("row_id", "scope").orderBy("start", "kind")
    before, after = scope.rowsBetween(Window.unboundedPreceding, -1), scope.rowsBetween(1, Window.unboundedFollowing)
    for role, kinds in (("id", IDENTIFIERS), ("secret", SECRETS)):
        d = d.withColumn(f"{role}_before", F.max(F.when(_of(kinds), F.col("end"))).over(before))
        d = d.withColumn(f"{role}_after", F.min(F.when(_of(kinds), F.col("start"))).over(after))
    near = {r: F.coalesce((F.col("start") - F.col(f"{r}_before") <= reach) | F.lit(False), F.lit(False)) | F.coalesce(F.col(f"{r}_after") - F.col("end") <= reach, F.lit(False)) for r in ("id", "secret")}
    at = {k: i for i, k in enumerate(PATTERNS)}
    kept = (F.col("kind") < BASE) | ((F.col("kind") == at["ident"]) & near["secret"]) | ((F.col("kind") == at["key"]) & near["id"]) | ((F.col("kind") == at["endpoint"]) & near["id"] & near["secret"])
    return d.withColumn("kept", F.coalesce(kept, F.lit(False)))


def secret_spans(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, spans array<struct<start, kind, end>> in order: what is reported of each row's text."""
    span = F.when(F.col("kept"), F.struct("start", "kind", "end"))
    out = linked(parts(docs), reach).groupBy("row_id").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(span)).alias("spans"))
    return out.select("doc_id", "spans")


def _text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in PATTERNS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    d = secret_spans(docs)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = _text(F.filter("spans", lambda s: s["kind"] < BASE))
    return d.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(base, 256).alias("base_sha256"), _text(F.col("spans")).alias("spans"))
