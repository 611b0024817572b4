"""Graph schemas as data: node and relationship tables, merging, fingerprint, write validation."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stored property types; TIMESTAMP and FLOAT are there for tables that have them.
TYPES: dict[str, T.DataType] = {"STRING": T.StringType(), "INT64": T.LongType(), "BOOLEAN": T.BooleanType(), "FLOAT": T.DoubleType(), "TIMESTAMP": T.TimestampNTZType()}


@dataclass(frozen=True)
class NodeTable:
    label: str
    properties: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class RelTable:
    type: str
    source: str
    target: str
    properties: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Extension:
    """Tables to add, and properties to add to tables: {table: (after, {property: type})}."""

    nodes: tuple[NodeTable, ...] = ()
    rels: tuple[RelTable, ...] = ()
    properties: Mapping[str, tuple[str | None, Mapping[str, str]]] = field(default_factory=dict)


class GraphSchema:
    def __init__(self, nodes: Iterable[NodeTable], rels: Iterable[RelTable]):
        self.nodes: dict[str, NodeTable] = {}
        self.rels: dict[str, RelTable] = {}
        for n in nodes:
            if n.label in self.nodes:
                raise ValueError(f"node table {n.label} is there twice")
            self._checked(n.label, n.properties)
            self.nodes[n.label] = n
        for r in rels:
            if r.type in self.rels or r.type in self.nodes:
                raise ValueError(f"relationship table {r.type} is there twice")
            self._checked(r.type, r.properties)
            for end in (r.source, r.target):
                if end not in self.nodes:
                    raise ValueError(f"{r.type}: unknown endpoint {end}")
            self.rels[r.type] = r

    @staticmethod
    def _checked(name: str, properties: Mapping[str, str]) -> None:
        for p, t in properties.items():
            if p == "id":
                raise ValueError(f"{name}: a property can't be named id")
            if t not in TYPES:
                raise ValueError(f"{name}.{p}: unknown type {t}")

    def merged(self, *extensions: Extension) -> GraphSchema:
        """A schema with the extensions' tables appended and their properties put behind their anchors."""
        nodes = {k: dict(v.properties) for k, v in self.nodes.items()}
        rels = {k: (v.source, v.target, dict(v.properties)) for k, v in self.rels.items()}
        for e in extensions:
            for n in e.nodes:
                if nodes.setdefault(n.label, dict(n.properties)) != dict(n.properties):
                    raise ValueError(f"node table {n.label} is declared differently")
            for r in e.rels:
                if rels.setdefault(r.type, (r.source, r.target, dict(r.properties))) != (r.source, r.target, dict(r.properties)):
                    raise ValueError(f"relationship table {r.type} is declared differently")
            for table, (after, more) in e.properties.items():
                if table not in nodes and table not in rels:
                    raise ValueError(f"unknown table {table}")
                now = nodes[table] if table in nodes else rels[table][2]
                for p, t in more.items():
                    if now.get(p, t) != t:
                        raise ValueError(f"{table}.{p} has another type")
                if after is not None and after not in now:
                    raise ValueError(f"{table} has no property {after}")
                new = [(p, t) for p, t in more.items() if p not in now]
                items = list(now.items())
                at = len(items) if after is None else [p for p, _ in items].index(after) + 1
                now.clear()
                now.update(items[:at] + new + items[at:])
        return GraphSchema([NodeTable(k, v) for k, v in nodes.items()], [RelTable(k, a, b, p) for k, (a, b, p) in rels.items()])

    def fingerprint(self) -> str:
        """SHA-256 over tables, properties and their order."""
        told = [[n.label, *map(list, n.properties.items())] for n in self.nodes.values()] + [[r.type, r.source, r.target, *map(list, r.properties.items())] for r in self.rels.values()]
        return hashlib.sha256(json.dumps(told).encode()).hexdigest()

    def node_struct(self, label: str) -> T.StructType:
        return T.StructType([T.StructField("id", T.StringType(), False)] + [T.StructField(p, TYPES[t]) for p, t in self.nodes[label].properties.items()])

    def rel_struct(self, kind: str) -> T.StructType:
        ends = [T.StructField(c, T.StringType(), False) for c in ("rel_id", "src", "dst")]
        return T.StructType(ends + [T.StructField(p, TYPES[t]) for p, t in self.rels[kind].properties.items()])

    def validated(self, name: str, df: DataFrame) -> DataFrame:
        """``df`` in the table's column order; unknown or ill-typed columns raise, absent ones are null."""
        want = self.node_struct(name) if name in self.nodes else self.rel_struct(name)
        have = {f.name: f.dataType for f in df.schema.fields}
        for c, t in have.items():
            if c not in want.fieldNames():
                raise ValueError(f"{name} has no property {c}")
            if t != want[c].dataType and not isinstance(t, T.NullType):
                raise ValueError(f"{name}.{c} is {want[c].dataType.simpleString()}, not {t.simpleString()}")
        return df.select(*[F.col(f"`{f.name}`") if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in want.fields])
