"""Quality rules: robust multivariate outliers by minimum-covariance-determinant estimates.

Each text's base statistics are taken over its whole text; per language and source, the centre and
covariance of transformed statistic vectors are those of the h-subset of smallest Mahalanobis
distances with the least determinant: concentration steps from two starts (medians and median
deviations; spatial signs about the medians) run until no step lowers a determinant, and the lower
one stays. Documents beyond a chi-square quantile are rejected. Documents that fail the base rule
take no part in the estimates.

Vectors are fixed-point integers, so sums are exact and every run gives the same estimates. A step is
one aggregation: sums by group and log-binned distance, whose nearest bins make the subset. One
document's repeats are counted in its row. Repeated windows are compared by 64-bit hashes.

Defined results: null and empty texts have statistics 0 and fail the base rule; null languages and
sources form groups of their own; a group of fewer than LEAST members is judged by the estimate of
all rows of its language, and where that has too few by that of all rows; with fewer than LEAST rows
in all, nothing is rejected beyond the base rule; variances have a floor, so constant statistics
don't make a matrix singular; very long texts are one row's work; equal distances fall in one bin and
stay together; repeated rows count each; an empty table gives no rows; only text, lang, source and
the columns asked for are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, joined_small, written

#: Vector: log mean word length, log symbols a word, log repeated lines a line, share of words in repeated windows.
P = 4
#: Floors are standard deviations; that of repeated words keeps the base rule's own limit (one half) within the cut.
FLOORS = (0.03, 0.05, 0.05, 0.1)
UNIT = 4096
#: Share of a group in the h-subset; what makes its covariance consistent at the normal (4 dimensions, 3/4).
SUBSET, CONSISTENT = 0.75, 1.6
#: A step counts if it lowers the log determinant by more; products of signs are in 1 / SIGNS.
GAIN, SIGNS = 1e-6, 1 << 20
#: Chi-square quantile, 4 degrees of freedom, 1 - 1e-6.
CUT = 33.38
LEAST = 50
BIN = 16.0


def with_statistics(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """``keep`` and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_distinct (long).

    The columns come out of a generator of one row: filters on them aren't pushed into the expressions,
    where they would be evaluated again inside each other's lambdas.
    """
    names = [f"__k{i}" for i in range(len(keep))]
    d = docs.select(*[k.alias(n) for k, n in zip(keep, names, strict=True)], F.coalesce("text", F.lit("")).alias("__t"))
    d = d.withColumn("__words", F.regexp_extract_all("__t", F.lit(f"({WORD})"), 1))
    d = d.withColumn("__lines", F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.withColumn("__grams", F.expr("if(size(__words) < 3, cast(array() as array<bigint>), transform(sequence(0, size(__words) - 3), i -> xxhash64(__words[i], __words[i + 1], __words[i + 2])))"))
    d = d.select(
        *names,
        F.size("__words").cast("long").alias("n_words"),
        F.char_length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count("__t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("__words")).cast("long").alias("n_distinct"),
        F.expr("if(size(array_distinct(__grams)) = size(__grams), cast(array() as array<struct<h: bigint, i: int>>), array_sort(transform(__grams, (h, i) -> struct(h, i))))").alias("__sorted"),
    )
    repeated = "(j > 0 and __sorted[j - 1].h = s.h) or (j < size(__sorted) - 1 and __sorted[j + 1].h = s.h)"
    d = d.withColumn("__at", F.expr(f"array_sort(filter(transform(__sorted, (s, j) -> if({repeated}, s.i, null)), x -> x is not null))"))
    covered = F.expr("if(size(__at) = 0, 0, 3 + aggregate(transform(__at, (x, j) -> if(j = 0, 0, least(3, x - __at[j - 1]))), 0, (a, x) -> a + x))")
    counted = F.struct("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", covered.cast("long").alias("n_repeat_words"), "n_distinct")
    out = docs.select(*keep).columns
    return d.select(*[F.col(n).alias(o) for n, o in zip(names, out, strict=True)], F.inline(F.array(counted)))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vector() -> list[Column]:
    """The transformed statistics as integers in 1 / UNIT."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    share = lambda c, of: F.col(c) / of
    raw = [
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        F.log1p(share("n_symbols", n)),
        F.log1p(share("n_dup_lines", F.greatest(F.col("n_lines"), F.lit(1)))),
        share("n_repeat_words", n),
    ]
    return [F.round(x * UNIT).cast("long").alias(f"x{k}") for k, x in enumerate(raw)]


def _distance() -> Column:
    """Squared Mahalanobis distance of x0.. from m0.. by forward substitution in the Cholesky factor c00.."""
    y: list[Column] = []
    for i in range(P):
        r = F.col(f"x{i}") / float(UNIT) - F.col(f"m{i}")
        for k in range(i):
            r = r - F.col(f"c{i}{k}") * y[k]
        y.append(r / F.col(f"c{i}{i}"))
    return reduce(lambda a, b: a + b, [v * v for v in y])


def _binned(d2: Column) -> Column:
    return F.floor(F.log(d2 + 1e-6) * BIN).cast("int")


def _factored(d: DataFrame) -> DataFrame:
    """Rows with m0.. and covariances v00.. -> their keys, m0.., the Cholesky factor c00.. and logdet."""
    for j in range(P):
        dot = lambda i, j=j: reduce(lambda a, b: a + b, [F.col(f"c{i}{k}") * F.col(f"c{j}{k}") for k in range(j)], F.lit(0.0))
        d = d.withColumn(f"c{j}{j}", F.sqrt(F.greatest(F.col(f"v{j}{j}") - dot(j), F.lit(1e-6))))
        d = d.select("*", *[((F.col(f"v{i}{j}") - dot(i)) / F.col(f"c{j}{j}")).alias(f"c{i}{j}") for i in range(j + 1, P)])
    logdet = reduce(lambda a, b: a + b, [2 * F.log(f"c{i}{i}") for i in range(P)])
    return d.select("g_key", "start", *[f"m{i}" for i in range(P)], *[f"c{i}{j}" for i in range(P) for j in range(i + 1)], logdet.alias("logdet"))


def _step(x: DataFrame, now: DataFrame) -> DataFrame:
    """One concentration step for each (g_key, start) of ``now``: mean and covariance of the nearest rows."""
    far = joined_small(x, now, [("key", "g_key")]).filter("g_key is not null").withColumn("bin", _binned(_distance()))
    bins = far.groupBy("g_key", "start", "bin").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(f"x{i}").alias(f"s{i}") for i in range(P)],
        *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i in range(P) for j in range(i + 1)],
    )
    group = Window.partitionBy("g_key", "start")  # over a few hundred bins
    before = F.coalesce(F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = bins.select("*", before.alias("before"), F.sum("n").over(group).alias("of")).filter(F.col("before") < F.lit(SUBSET) * F.col("of"))
    sums = near.groupBy("g_key", "start").agg(F.sum("n").cast("double").alias("n"), *[F.sum(c).alias(c) for c in (*(f"s{i}" for i in range(P)), *(f"q{i}{j}" for i in range(P) for j in range(i + 1)))])
    d = sums.select("*", *[(F.col(f"s{i}") / F.col("n") / UNIT).alias(f"m{i}") for i in range(P)])
    cov = {}
    for i in range(P):
        for j in range(i + 1):
            c = (F.col(f"q{i}{j}") / F.col("n") / float(UNIT * UNIT) - F.col(f"m{i}") * F.col(f"m{j}")) * CONSISTENT
            cov[i, j] = c + FLOORS[i] ** 2 if i == j else c
    return _factored(d.select("*", *[c.alias(f"v{i}{j}") for (i, j), c in cov.items()]))


def _starts(x: DataFrame) -> DataFrame:
    """(g_key, start, m0.., c00.., logdet) of the two starts: median deviations, and spatial signs about the medians."""
    med = written(x.groupBy("key").agg(*[F.percentile(f"x{i}", F.lit(0.5)).alias(f"med{i}") for i in range(P)]).withColumnRenamed("key", "g_key"))
    off = joined_small(x, med, [("key", "g_key")])
    mad = off.groupBy("g_key").agg(*[F.first(f"med{i}").alias(f"med{i}") for i in range(P)], *[F.percentile(F.abs(F.col(f"x{i}") - F.round(F.col(f"med{i}"))), F.lit(0.5)).alias(f"mad{i}") for i in range(P)])
    scale = written(mad.select("g_key", *[(F.col(f"med{i}") / UNIT).alias(f"m{i}") for i in range(P)], *[F.sqrt((1.4826 * F.col(f"mad{i}") / UNIT) ** 2 + FLOORS[i] ** 2).alias(f"d{i}") for i in range(P)]))
    z = joined_small(x, scale, [("key", "g_key")]).select("g_key", *[((F.col(f"x{i}") / float(UNIT) - F.col(f"m{i}")) / F.col(f"d{i}")).alias(f"z{i}") for i in range(P)])
    size = F.greatest(reduce(lambda a, b: a + b, [F.col(f"z{i}") ** 2 for i in range(P)]), F.lit(1e-12))
    signs = z.groupBy("g_key").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.round(F.col(f"z{i}") * F.col(f"z{j}") / size * SIGNS).cast("long")).alias(f"u{i}{j}") for i in range(P) for j in range(i + 1)])
    spread = lambda i, j: F.col(f"d{i}") * F.col(f"d{j}")
    own = [(F.lit(0.0) if i != j else spread(i, i)).alias(f"v{i}{j}") for i in range(P) for j in range(i + 1)]
    by_sign = [(P * F.col(f"u{i}{j}") / F.col("n") / float(SIGNS) * spread(i, j) + (FLOORS[i] ** 2 if i == j else 0.0)).alias(f"v{i}{j}") for i in range(P) for j in range(i + 1)]
    means = [f"m{i}" for i in range(P)]
    first = scale.select("g_key", F.lit(0).alias("start"), *means, *own)
    second = scale.join(signs, "g_key").select("g_key", F.lit(1).alias("start"), *means, *by_sign)
    return _factored(first.unionByName(second))


def concentrated(x: DataFrame) -> DataFrame:
    """(key, x0..) -> (g_key, m0.., c00..): each key's estimate of least determinant, a written table.

    A step that doesn't lower its determinant ends that start; determinants fall and subsets are
    finite, so all end. The first step is always taken: a start's own determinant is of no subset.
    """
    now = written(_step(x, written(_starts(x))))
    done: list[DataFrame] = []
    while not now.isEmpty():
        new = _step(x, now.drop("logdet")).withColumnRenamed("logdet", "to")
        both = now.select("*", F.struct(*[c for c in now.columns if c not in ("g_key", "start")]).alias("was")).select("g_key", "start", "was")
        both = written(both.join(new, ["g_key", "start"]).withColumn("less", F.col("to") < F.col("was.logdet") - GAIN))
        done.append(both.filter("not less").select("g_key", "start", "was.*"))
        now = both.filter("less").select("g_key", "start", *[c for c in new.columns if c not in ("g_key", "start", "to")], F.col("to").alias("logdet"))
    if not done:
        return now.drop("start", "logdet")
    best = reduce(DataFrame.unionByName, done).groupBy("g_key").agg(F.min_by(F.struct("*"), F.struct("logdet", "start")).alias("b"))
    return written(best.select("b.*").drop("start", "logdet"))


def _hashed(kind: str, *names: str) -> Column:
    return F.xxhash64(F.lit(kind), *[c for n in names for c in (F.coalesce(F.col(n), F.lit("")), F.col(n).isNull())])


def fit(stats: DataFrame) -> DataFrame:
    """lang, source and statistics of all documents -> (g_lang, g_source, m0.., c00..), a written table.

    One row for each language and source. A row of ``stats`` counts in the estimate of its own group,
    and in those of its language and of all rows where a group needs them.
    """
    good = stats.filter(~base_failed())
    sizes = written(stats.groupBy("lang", "source").agg(F.count_if(~base_failed()).alias("n")))
    by_lang = written(sizes.groupBy(F.col("lang").alias("b_lang")).agg(F.sum("n").alias("n_lang"), F.min("n").alias("least")))
    whole = by_lang.agg(F.coalesce(F.sum("n_lang"), F.lit(0)).alias("n"), F.coalesce(F.min("n_lang"), F.lit(0)).alias("least")).first()
    own, lang, every = _hashed("own", "lang", "source"), _hashed("lang", "lang"), F.lit(0).cast("long")
    has_own, has_lang, has_all = F.col("n") >= LEAST, F.col("n_lang") >= LEAST, F.lit(whole.n >= LEAST)
    groups = sizes.join(by_lang, F.col("lang").eqNullSafe(F.col("b_lang"))).select(
        F.col("lang").alias("g_lang"), F.col("source").alias("g_source"),
        F.when(has_own, own).when(has_lang, lang).when(has_all, every).alias("judge"),
        F.array_compact(F.array(F.when(has_own, own), F.when(has_lang & (F.col("least") < LEAST), lang), F.when(has_all & F.lit(whole.least < LEAST), every))).alias("keys"),
    )
    groups = written(groups)
    x = joined_small(good.select("lang", "source", *vector()), groups, [("lang", "g_lang"), ("source", "g_source")])
    x = written(x.select(F.explode("keys").alias("key"), *[f"x{i}" for i in range(P)]))
    return written(groups.join(concentrated(x), F.col("judge") == F.col("g_key"), "left").drop("judge", "keys", "g_key"))


def judged(stats: DataFrame, estimates: DataFrame) -> DataFrame:
    """``stats`` with base_failed, distance (squared; null where there is no estimate) and kept."""
    d = joined_small(stats.select("*", *vector()), estimates, [("lang", "g_lang"), ("source", "g_source")])
    d = d.withColumn("distance", _distance()).withColumn("base_failed", base_failed())
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUT)
    return d.withColumn("kept", kept).select(*stats.columns, "base_failed", "distance", "kept")


def quality_report(docs: DataFrame) -> DataFrame:
    stats = written(with_statistics(docs, [F.col("doc_id"), F.col("lang"), F.col("source")]))
    out = judged(stats, fit(stats))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept")


def kept_documents(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that the base rule or the estimates reject.

    Statistics are the costly part, so rows are written once with theirs, and read again to be judged.
    """
    row = F.struct(*docs.columns).alias("__row")
    stats = written(with_statistics(docs, [row, F.col("lang"), F.col("source")]))
    return judged(stats, fit(stats.drop("__row"))).filter("kept").select("__row.*")
