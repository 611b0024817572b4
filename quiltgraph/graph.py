"""A property graph: a schema and one DataFrame for each node and relationship table."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import GraphSchema


class Tables(Mapping):
    """name -> DataFrame, each made when it is first asked for."""

    def __init__(self, makers: Mapping[str, Callable[[], DataFrame]]):
        self._makers, self._made = dict(makers), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self):
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)

    def __contains__(self, name: object) -> bool:
        return name in self._makers

    def only(self, names) -> Tables:
        return Tables({n: self._makers[n] for n in names if n in self._makers})


@dataclass
class Graph:
    """Node tables have id and properties; relationship tables rel_id, src, dst and properties."""

    spark: SparkSession
    schema: GraphSchema
    nodes: Mapping[str, DataFrame] = field(default_factory=dict)
    rels: Mapping[str, DataFrame] = field(default_factory=dict)

    def node_table(self, label: str) -> DataFrame:
        if label in self.nodes:
            return self.nodes[label]
        return self.spark.createDataFrame([], self.schema.node_struct(label))

    def rel_table(self, kind: str) -> DataFrame:
        if kind in self.rels:
            return self.rels[kind]
        return self.spark.createDataFrame([], self.schema.rel_struct(kind))

    def query(self, text: str, **params) -> DataFrame:
        """Compiles a graph query to one DataFrame; nothing runs until it is read."""
        from .plans.compiler import compiled

        return compiled(self, text, params)

    def edges(self, *kinds: str) -> DataFrame:
        """(src, dst, kind) of relationship tables."""
        out = None
        for k in kinds or self.schema.rels:
            e = self.rel_table(k).select("src", "dst", F.lit(k).alias("kind"))
            out = e if out is None else out.unionByName(e)
        return out

    def without_dangling(self) -> Graph:
        """Relationships whose endpoints are both there, under the right labels."""
        rels = {}
        for k, e in self.rels.items():
            t = self.schema.rels[k]
            s = self.node_table(t.source).select(F.col("id").alias("src"))
            d = self.node_table(t.target).select(F.col("id").alias("dst"))
            rels[k] = e.join(s, "src", "left_semi").join(d, "dst", "left_semi").select(*e.columns)
        return Graph(self.spark, self.schema, dict(self.nodes), rels)

    def stats(self) -> DataFrame:
        """(kind, name, n) of all tables."""
        parts = [self.node_table(x).groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("kind"), F.lit(x).alias("name"), "n") for x in self.schema.nodes]
        parts += [self.rel_table(x).groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit("rel").alias("kind"), F.lit(x).alias("name"), "n") for x in self.schema.rels]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def deduplicated(rels: DataFrame) -> DataFrame:
    """Relationships equal in ends and properties count once; the smallest rel_id stays."""
    rest = [c for c in rels.columns if c != "rel_id"]
    return rels.groupBy(*rest).agg(F.min("rel_id").alias("rel_id")).select(*rels.columns)


def first_by_id(nodes: DataFrame, order: str) -> DataFrame:
    """Of node rows with one id, the first by ``order`` (which goes)."""
    rest = [c for c in nodes.columns if c not in ("id", order)]
    return nodes.groupBy("id").agg(F.min_by(F.struct(*rest), order).alias("r")).select("id", "r.*") if rest else nodes.select("id").distinct()
