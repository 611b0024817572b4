"""Routes: segments of patterns, scores of URLs against them, the most specific match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Points of a literal segment, a parameter and an open end, and the names of kinds of match.
LITERAL, PARAMETER, OPEN = 3, 2, 1
KINDS = ("catch-all", "parameter", "exact")


def joined_path(*parts: Column) -> Column:
    """One path of parts: single slashes between and before them, none at the end; null parts are empty."""
    whole = F.concat_ws("/", *parts)
    return F.concat(F.lit("/"), F.array_join(F.filter(F.split(whole, "/"), lambda s: s != ""), "/"))


def url_segments(url: Column) -> Column:
    path = F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]+", ""), r"[?#].*$", "")
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.coalesce(F.try_url_decode(s), s))


def route_segments(pattern: Column) -> Column:
    """array<struct<kind, value>>: literal, param, rest (one or more), rest-or-none."""

    def one(s: Column) -> Column:
        optional = s.rlike(r"^\[\[\.\.\..+\]\]$") | (s.endswith("*") & (s != "*") & s.rlike(r"^:[^/]+\*$"))
        rest = s.rlike(r"^\[\.\.\..+\]$") | (s == "*") | s.rlike(r"^:[^/]+[*+]$") | (s == "(.*)") | s.rlike(r"^<path:[^/>]+>$")
        param = s.rlike(r"^(?::[^/]+|\[[^/]+\]|\{[^/]+\}|<[^/]+>)$")
        kind = F.when(optional, "rest-or-none").when(rest, "rest").when(param, "param").otherwise("literal")
        return F.struct(kind.alias("kind"), F.coalesce(F.try_url_decode(s), s).alias("value"))

    return F.transform(F.filter(F.split(pattern, "/"), lambda s: s != ""), one)


def match_score(url: Column, route: Column) -> Column:
    """struct<score, match> of URL segments against route segments: points of each; null for no match."""
    n = F.size(route)
    open_end = (n > 0) & F.coalesce(F.try_element_at(route, n)["kind"].isin("rest", "rest-or-none"), F.lit(False))
    fixed = F.when(open_end, n - 1).otherwise(n)
    enough = F.when(open_end, (F.size(url) > fixed) | ((F.size(url) == fixed) & (F.try_element_at(route, n)["kind"] == "rest-or-none"))).otherwise(F.size(url) == n)
    head = F.slice(route, F.lit(1), fixed)
    points = F.aggregate(
        F.zip_with(head, F.slice(url, F.lit(1), F.greatest(fixed, F.lit(0))), lambda r, u: F.when(r["kind"] == "param", F.when(u.isNotNull(), PARAMETER)).when(r["kind"] == "literal", F.when(r["value"] == u, LITERAL))),
        F.lit(0), lambda a, x: a + x,
    )
    score = points + F.when(open_end, OPEN).otherwise(0)
    kind = F.when(open_end, KINDS[0]).when(F.exists(route, lambda r: r["kind"] == "param"), KINDS[1]).otherwise(KINDS[2])
    return F.when(enough & score.isNotNull(), F.struct(score.alias("score"), kind.alias("match")))


def best_routes(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """(request, method, url), (route, method, pattern) -> (request, route, score, match).

    The most specific route of the method (or ALL); a tie between several is no match. Requests and
    routes meet on the method and the first segment where the pattern begins with a literal, so URLs
    aren't tried against every pattern.
    """
    q = requests.select("request", F.upper("method").alias("q_method"), url_segments(F.col("url")).alias("u"))
    q = q.withColumn("first", F.coalesce(F.get("u", F.lit(0)), F.lit("")))
    r = routes.select("route", F.upper("method").alias("r_method"), route_segments(F.col("pattern")).alias("r"))
    head = F.get("r", F.lit(0))
    r = r.withColumn("r_first", F.when(F.size("r") == 0, "").when(head["kind"] == "literal", head["value"]).otherwise(F.lit(None)))
    keyed = q.select("*", F.explode(F.array(F.struct(F.col("q_method").alias("m"), F.col("first").alias("f")), F.struct(F.lit("ALL").alias("m"), F.col("first").alias("f")), F.struct(F.col("q_method").alias("m"), F.lit(None).cast("string").alias("f")), F.struct(F.lit("ALL").alias("m"), F.lit(None).cast("string").alias("f")))).alias("k")).dropDuplicates(["request", "q_method", "u", "k"])
    hit = keyed.join(r, (F.col("k.m") == F.col("r_method")) & F.col("k.f").eqNullSafe(F.col("r_first"))).withColumn("s", match_score(F.col("u"), F.col("r"))).filter("s is not null")
    w = Window.partitionBy("request")
    top = hit.withColumn("top", F.max("s.score").over(w)).filter("s.score = top")
    return top.withColumn("n", F.count(F.lit(1)).over(w)).filter("n = 1").select("request", "route", "s.score", "s.match")
