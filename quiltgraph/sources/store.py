"""Snapshots of a graph: Parquet generations behind a pointer, with unchanged tables carried over.

A generation is a manifest that names a folder for each table. Folders are named by a fingerprint of
the table's rows, so a table that didn't change isn't written again. Publishing is one rename over the
pointer; readers look at it before every read and so see whole generations only. One writer works at a
time: it holds a lock file that it keeps fresh, and a lock that nobody has kept fresh is taken over. All
file access goes through Hadoop's file system, so a store can be anywhere that Spark can write.
"""

from __future__ import annotations

import contextlib
import json
import threading
import time
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from ..schema import GraphSchema

GRACE_SECONDS = 60
LOCK = "LOCK.json"
STALE_SECONDS = 120
WAIT_SECONDS = 600


class GraphStore:
    def __init__(self, spark: SparkSession, path: str, schema: GraphSchema):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        jvm = spark.sparkContext._jvm
        self._jpath = jvm.org.apache.hadoop.fs.Path
        self._fs = self._jpath(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # files
    def _read(self, name: str) -> dict | None:
        p = self._jpath(f"{self.path}/{name}")
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _write(self, name: str, what: dict) -> None:
        """Whole or not at all: a new file is renamed over the old one."""
        tmp = self._jpath(f"{self.path}/.{name}-{uuid.uuid4().hex}")
        stream = self._fs.create(tmp, True)
        try:
            stream.write(bytearray(json.dumps(what).encode()))
        finally:
            stream.close()
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        how = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        how[0] = getattr(hadoop, "Options$Rename").OVERWRITE
        where = hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        where.rename(self._fs.makeQualified(tmp), self._fs.makeQualified(self._jpath(f"{self.path}/{name}")), how)

    # one writer at a time
    def _lock_age(self) -> float | None:
        try:
            return time.time() - self._fs.getFileStatus(self._jpath(f"{self.path}/{LOCK}")).getModificationTime() / 1000
        except Py4JJavaError as e:
            if "FileNotFoundException" in str(e):
                return None
            raise

    def _try_lock(self, owner: str) -> bool:
        p = self._jpath(f"{self.path}/{LOCK}")
        try:
            stream = self._fs.create(p, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        try:
            stream.write(bytearray(json.dumps({"owner": owner}).encode()))
        finally:
            stream.close()
        return True

    def _holds(self, owner: str) -> bool:
        try:
            told = self._read(LOCK)
        except ValueError:  # another writer is just taking it
            return False
        return told is not None and told["owner"] == owner

    @contextlib.contextmanager
    def locked(self, wait: float = WAIT_SECONDS, stale: float = STALE_SECONDS) -> Iterator[None]:
        """Holds the store's lock. Waits for another writer up to ``wait`` seconds, then raises TimeoutError;
        a lock not kept fresh for ``stale`` seconds is moved away (one rename, so by one writer only)."""
        until = time.time() + wait
        owner = uuid.uuid4().hex
        p = self._jpath(f"{self.path}/{LOCK}")
        while not self._try_lock(owner):
            age = self._lock_age()
            if age is not None and age > stale:
                gone = self._jpath(f"{self.path}/.{LOCK}-{uuid.uuid4().hex}")
                if self._fs.rename(p, gone):
                    self._fs.delete(gone, False)
                continue
            if time.time() > until:
                raise TimeoutError(f"another writer holds {self.path}")
            time.sleep(min(0.2, wait))
        done = threading.Event()

        def fresh() -> None:
            while not done.wait(max(stale / 4, 1)) and self._holds(owner):
                self._fs.setTimes(p, int(time.time() * 1000), -1)

        keeper = threading.Thread(target=fresh, daemon=True)
        keeper.start()
        try:
            yield
        finally:
            done.set()
            keeper.join()
            if self._holds(owner):
                self._fs.delete(p, False)

    # generations
    def head(self) -> dict | None:
        return self._read("HEAD.json")

    def read(self) -> Graph:
        """The graph of the generation that the pointer names now."""
        h = self.head()
        if h is None:
            raise FileNotFoundError(f"no graph at {self.path}")
        if h["schema"] != self.schema.fingerprint():
            raise ValueError("the snapshot has another schema; write it anew")
        nodes, rels = {}, {}
        for name, folder in h["tables"].items():
            struct = self.schema.node_struct(name) if name in self.schema.nodes else self.schema.rel_struct(name)
            (nodes if name in self.schema.nodes else rels)[name] = self.spark.read.schema(struct).parquet(f"{self.path}/{folder}")
        return Graph(self.spark, self.schema, nodes, rels)

    @staticmethod
    def fingerprint(df: DataFrame) -> str:
        """Count and order-free sum of row hashes."""
        cols = df.columns
        r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).alias("a"), F.sum(F.xxhash64(F.lit(1), *cols).cast("decimal(38,0)")).alias("b")).first()
        return f"{r.n:x}-{int(r.a or 0) % (1 << 64):016x}{int(r.b or 0) % (1 << 64):016x}"

    def write(self, graph: Graph, mode: str = "replace", told: dict | None = None) -> dict:
        """replace: all tables; append: adds rows to the tables given. ``told`` is published with the new
        pointer, which is returned."""
        with self.locked():
            return self._publish(graph, mode, told or {})

    def _publish(self, graph: Graph, mode: str, told: dict) -> dict:
        old = self.head()
        same = old is not None and old["schema"] == self.schema.fingerprint()
        tables = dict(old["tables"]) if same and mode == "append" else {}
        known = set(old["tables"].values()) if same else set()
        given = {**graph.nodes, **graph.rels}
        if mode == "append" and tables:
            now = self.read()
            for name, df in given.items():
                before = now.nodes.get(name, now.rels.get(name))
                if before is not None:
                    given[name] = before.unionByName(self.schema.validated(name, df))
        for name, df in given.items():
            df = self.schema.validated(name, df)
            self.check_ids(name, df)
            folder = f"{name}-{self.fingerprint(df)}"
            if folder not in known:
                df.write.mode("overwrite").parquet(f"{self.path}/{folder}")
            tables[name] = folder
        if mode == "append" and old and "batch" in old:
            told = {"batch": old["batch"]} | told
        head = {"generation": (old["generation"] if old else 0) + 1, "schema": self.schema.fingerprint(), "tables": tables, "at": time.time()} | told
        self._write("HEAD.json", head)
        return head

    def check_ids(self, name: str, df: DataFrame) -> None:
        key = "id" if name in self.schema.nodes else "rel_id"
        twice = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect()
        if twice:
            raise ValueError(f"{name}: {twice[0][0]} is there {twice[0].n} times")

    def collect_garbage(self, grace: float = GRACE_SECONDS) -> list[str]:
        """Removes table folders that the pointer doesn't name and that are older than the grace time."""
        head = self.head()
        live = set(head["tables"].values()) if head else set()
        gone = []
        for s in self._fs.listStatus(self._jpath(self.path)):
            name = s.getPath().getName()
            if s.isDirectory() and name not in live and time.time() - s.getModificationTime() / 1000 > grace:
                self._fs.delete(s.getPath(), True)
                gone.append(name)
        return gone

    def reset(self) -> None:
        self._fs.delete(self._jpath(self.path), True)
