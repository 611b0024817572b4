"""The corpus pipeline: quality rules, line dedup, near duplicates, source mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns all that it keeps, as rows of documents; the last
one returns token ids. Stages are written as Parquet in the shared folder and read again. A stage's
rows must be written before another stage is called with other rows: it then deletes the tables that
earlier stages made on their way and that its own rows don't come from.

Defined results, beyond the operators' own: null, empty and short texts go in the first stage; rows
with equal doc_id and text are one document to line dedup and one row after near dedup; other columns,
of any name, pass through the first four stages; an empty table gives no rows in any stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltgraph.llm import byte_bpe, line_dedup, mixing, quality_rules, simhash
from quiltgraph.llm.common import documents, dropped_unread, recorded, written

_made: list[str] = []


def _stage(f: Callable) -> Callable:
    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        dropped_unread(docs, _made)
        with recorded(_made):
            return f(spark, docs, sf_dir)

    return run


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.kept_documents(docs)


@_stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go, and documents of such lines alone."""
    return line_dedup.deduplicated(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return simhash.kept_documents(docs)


@_stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's target takes it."""
    return mixing.mix(docs)


@_stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids, offsets (bytes) and intact (whether the ids decode to the text) of each document."""
    out = byte_bpe.encode(docs.select("doc_id", "source", "text"), intact=True)
    return out.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "offsets", "intact")


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("mix_sources", mixture),
    ("byte_bpe", tokens),
]

#: Robust estimates, edit joins and merges can't be written in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
