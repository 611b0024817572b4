"""Mixing sources to target weights.

Words are summed per source, targets are water-filled under a repetition cap, and each document is
emitted floor(rate) times plus once more if a hash-seeded Bernoulli draw falls below the fraction.

Defined results: null text counts 0 words; null sources form one source that sorts last; a source
without words has target 0 and rate 0; documents with equal doc_id (null included) share one draw, so
repeated rows are taken alike; sources whose caps are reached at equal levels follow by name; very long
texts are only counted; an empty table gives an empty mix. Columns besides doc_id, source and text are
carried untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import joined_small, word_count, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, size) -> (m_source, source_size, target).

    The level of the water-filling is found without a loop: with sources in order of cap/weight, it
    is (total - caps before) / (weights from here on) at the first source where that doesn't exceed
    cap/weight. The windows run over one row a source.
    """
    per = sizes.groupBy(F.col("source").alias("m_source")).agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("m_source").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.select("*", w.alias("w"), (F.col("source_size") * most).alias("cap"), F.sum("source_size").over(Window.partitionBy()).alias("total"))
    per = per.withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", F.col("m_source").asc_nulls_last())
    per = per.select(
        "*",
        F.row_number().over(order).alias("pos"),
        F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"),
        F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("rest"),
    ).withColumn("left", F.col("total") * share - F.col("before"))
    level = F.min(F.when(F.col("left") / F.col("rest") <= F.col("ratio"), F.struct("pos", "left", "rest"))).over(Window.partitionBy())
    per = per.withColumn("level", level)
    filled = F.when(F.col("level").isNull() | (F.col("pos") < F.col("level.pos")), F.col("cap")).otherwise(F.col("w") * F.col("level.left") / F.col("level.rest"))
    return per.select("m_source", "source_size", filled.cast("double").alias("target"))


def draw(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from 52 bits of the key's MD5; the same on every run."""
    h = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / float(1 << 52)


def with_copies(docs: DataFrame, targets: DataFrame, seed: str = SEED) -> DataFrame:
    """Adds m_source, source_size, target and copies to rows that have doc_id and source."""
    out = joined_small(docs, targets, [("source", "m_source")])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    return out.withColumn("copies", whole + F.when(draw(F.col("doc_id"), seed) < rate - whole, 1).otherwise(0))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """The mixed corpus: rows of ``docs``, each as many times as the mix takes it."""
    sizes = docs.select(F.col("source"), word_count(F.col("text")).alias("size"))
    targets = written(source_targets(sizes, weights, share, most))
    plan = with_copies(docs.select(F.struct(*docs.columns).alias("__row"), "doc_id", "source"), targets, seed)
    return plan.filter("copies > 0").select("__row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("__row.*")


def mixing_report(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of each document; texts are read once."""
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    targets = written(source_targets(sized, weights, share, most))
    out = with_copies(sized, targets, seed)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies")


ORACLE = rf"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM {{docs}}),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
r AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w,
      source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER ()::BIGINT AS total FROM per),
o AS (SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS pos,
      total * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
      sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM r),
l AS (SELECT pos AS lpos, lft AS llft, rest AS lrest FROM o WHERE lft / rest <= cap / w ORDER BY pos LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN lpos IS NULL OR pos < lpos THEN cap ELSE w * llft / lrest END AS target FROM o LEFT JOIN l ON true),
c AS (SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
      ('0x' || substr(md5('{SEED}:' || coalesce(s.doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken,
  (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies
FROM c"""
