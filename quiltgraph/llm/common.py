"""Helpers that the training-data operators share: storage, bounded broadcasts, word counts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterable
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Tables of at most this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 10_000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); one of our own only where it is unset."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if named:
        if current.isEmpty():
            sc.setCheckpointDir(named)
        return named
    if current.isEmpty():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        current = sc._jsc.sc().getCheckpointDir()
    return current.get()


_shipped: set[str] = set()


def shipped(spark: SparkSession) -> None:
    """Sends this package to the executors, once a context, so that their Python workers can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="package-")) / f"{root.name}.zip"
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(to))
    _shipped.add(sc.applicationId)


#: Removes a query's shuffle files when the query has ended, not when the driver's memory is next cleared.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_recorded: list[list[str]] = []


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    for paths in _recorded:
        paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def _removed(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made, once nothing that is still to run reads them."""
    for t in tables:
        _removed(t.sparkSession, [t._table_path])


@contextmanager
def recorded(paths: list[str]):
    """Adds the paths of tables that are written inside to ``paths``."""
    _recorded.append(paths)
    try:
        yield paths
    finally:
        _recorded.remove(paths)


def dropped_unread(df: DataFrame, paths: list[str]) -> None:
    """Deletes the tables at ``paths`` that the plan of ``df`` doesn't read; the others stay listed."""
    read = ""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            read += leaf.relation().location().rootPaths().mkString(" ") + " "
    gone = [p for p in paths if p.rsplit("/", 1)[-1] not in read]
    _removed(df.sparkSession, gone)
    paths[:] = [p for p in paths if p not in gone]


def joined_small(big: DataFrame, small: DataFrame, on: list[tuple[str, str]], salt: int = 32) -> DataFrame:
    """Left join of ``big`` to a written table ``small`` that has one row a key (null keys meet).

    ``small`` is counted: up to BROADCAST_ROWS it is broadcast, beyond that both sides are
    shuffled by key and salt, so that a key with a third of all rows spreads over tasks.
    """
    cond = None
    for a, b in on:
        c = F.col(a).eqNullSafe(F.col(b))
        cond = c if cond is None else cond & c
    if small.count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), cond, "left")
    big = big.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salt)))
    small = small.withColumn("__salt2", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salt - 1).cast("long"))))
    return big.join(small, cond & (F.col("__salt") == F.col("__salt2")), "left").drop("__salt", "__salt2")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


