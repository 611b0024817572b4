"""From syntax to one DataFrame: names are bound and types checked while the plan is built.

A node variable is a set of columns with a prefix of its own (id, label and properties), a
relationship likewise (rel id, type, ends and properties), so Catalyst prunes what isn't read. A
variable-length relationship is an array of structs. Structs of whole nodes and relationships are
made only where a query returns them.

Deviations, on purpose: a property whose type differs between the tables of a variable can't be
read; variables that are neither grouped by nor inside an aggregate can't be mixed with one; lists
made by collect are sorted; a LIMIT without a total order breaks ties by the projected columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import BinderError, UnsupportedError
from . import syntax as S

NUMERIC = ("INT", "FLOAT")
STORED = {"STRING": "STRING", "INT64": "INT", "BOOLEAN": "BOOL", "FLOAT": "FLOAT", "TIMESTAMP": "TIMESTAMP"}
SQL_TYPES = {"STRING": "string", "INT": "bigint", "BOOL": "boolean", "FLOAT": "double", "TIMESTAMP": "timestamp_ntz", "NULL": "string"}
AGGREGATES = ("count", "collect", "min", "max", "sum", "avg")


def list_type(of: str) -> str:
    return f"LIST<{of}>"


def is_list(t: str) -> bool:
    return t.startswith("LIST")


def element(t: str) -> str:
    return t[5:-1] if is_list(t) and len(t) > 6 else "NULL"


@dataclass(frozen=True)
class Value:
    """A scalar variable: its column and static type."""

    col: str
    type: str


@dataclass(frozen=True)
class Element:
    """A node or relationship variable: prefix of its columns, its tables and property types."""

    kind: str  # NODE, REL
    prefix: str
    tables: tuple[str, ...]
    props: dict[str, str] = field(hash=False, compare=False)

    @property
    def fixed(self) -> tuple[str, ...]:
        return ("id", "label") if self.kind == "NODE" else ("id", "label", "src", "dst")

    def names(self) -> list[str]:
        return [f"{self.prefix}_{c}" for c in self.fixed] + [f"{self.prefix}_p_{p}" for p, t in self.props.items() if t != "CONFLICT"]

    def id(self) -> Column:
        return F.col(f"{self.prefix}_id")


Binding = Value | Element


@dataclass(frozen=True)
class Typed:
    col: Column
    type: str


def null(t: str = "NULL") -> Typed:
    return Typed(F.lit(None).cast(SQL_TYPES.get(t, "string")), "NULL" if t == "NULL" else t)


def walk(e: Any):
    """An expression and everything in it."""
    yield e
    if isinstance(e, S.Prop):
        yield from walk(e.of)
    elif isinstance(e, S.ListOf):
        for x in e.items:
            yield from walk(x)
    elif isinstance(e, S.Call):
        for x in e.args:
            yield from walk(x)
    elif isinstance(e, S.Unary):
        yield from walk(e.of)
    elif isinstance(e, S.Binary):
        yield from walk(e.left)
        yield from walk(e.right)
    elif isinstance(e, S.Case):
        for x in (e.subject, e.other, *(y for w in e.whens for y in w)):
            if x is not None:
                yield from walk(x)


def has_aggregate(e: Any) -> bool:
    return any(isinstance(x, S.Call) and x.name in AGGREGATES for x in walk(e))


def variables(e: Any) -> set[str]:
    return {x.name for x in walk(e) if isinstance(x, S.Var)} if e is not None else set()


class Compiler:
    def __init__(self, graph, params: dict[str, Any]):
        self.graph, self.schema, self.params = graph, graph.schema, params
        self.scope: dict[str, Binding] = {}
        self.df: DataFrame | None = None
        self.made = 0
        self.reads: set[str] = set()
        self.listed: set[str] = set()

    def fresh(self, kind: str) -> str:
        self.made += 1
        return f"{kind}{self.made}"

    # ---- clauses
    def run(self, clauses: list) -> DataFrame:
        for c in clauses:  # variables of which more than the id is read
            for e in self._expressions(c):
                inner = {id(x.of) for x in walk(e) if isinstance(x, S.Prop)} | {id(a) for x in walk(e) if isinstance(x, S.Call) and x.name in ("id", "label", "labels", "count") for a in x.args}
                self.reads |= {x.of.name for x in walk(e) if isinstance(x, S.Prop) and isinstance(x.of, S.Var)}
                self.reads |= {x.name for x in walk(e) if isinstance(x, S.Var) and id(x) not in inner}
                sizes = {id(a) for x in walk(e) if isinstance(x, S.Call) and x.name in ("size", "count") and not x.distinct for a in x.args}
                self.listed |= {x.name for x in walk(e) if isinstance(x, S.Var) and id(x) not in sizes}
        for c in clauses:
            if isinstance(c, S.Match):
                self.match(c)
            else:
                self.project(c)
        return self.df

    @staticmethod
    def _expressions(c):
        if isinstance(c, S.Match):
            return [e for e in [c.where] if e is not None] + [e for p in c.paths for x in p for _, e in x.props]
        return [i.expr for i in c.items] + [e for e, _ in c.order] + [e for e in (c.where,) if e is not None]

    def match(self, m: S.Match) -> None:
        nodes, rels = self.inferred(m)
        if not m.optional:
            df, scope = self.matched(self.df, dict(self.scope), m, nodes, rels)
            self.df, self.scope = df, scope
            return
        used = set().union(*[{x.var for p in m.paths for x in p}, variables(m.where), *(variables(e) for p in m.paths for x in p for _, e in x.props)])
        shared = {v: b for v, b in self.scope.items() if v in used}
        names = [n for b in shared.values() for n in ([b.col] if isinstance(b, Value) else b.names())]
        left = self.df
        base = left.select(*names).distinct() if names else None
        right, scope = self.matched(base, dict(shared), m, nodes, rels)
        keys = [b.col if isinstance(b, Value) else f"{b.prefix}_id" for b in shared.values()]
        new = [n for v, b in scope.items() if v not in self.scope for n in ([b.col] if isinstance(b, Value) else b.names())]
        right = right.select(*[F.col(k).alias(f"{k}_o") for k in keys], *new, F.lit(1).alias("matched"))
        self.scope |= {v: b for v, b in scope.items() if v not in self.scope}
        if left is None:
            left = self.graph.spark.range(1).select()
        cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_o")) for k in keys], F.lit(True))
        if len(keys) == 1 and isinstance(next(iter(shared.values())), Element):
            cond = F.col(keys[0]) == F.col(f"{keys[0]}_o")
        self.df = left.join(right, cond, "left").drop("matched", *[f"{k}_o" for k in keys])

    # ---- patterns
    def inferred(self, m: S.Match) -> tuple[dict[str, set[str]], dict[int, set[str]]]:
        """Labels that each node variable, and types that each relationship, can have."""
        nodes: dict[str, set[str]] = {}
        rels: dict[int, set[str]] = {}
        for p in m.paths:
            for x in p:
                if isinstance(x, S.Node):
                    for t in x.labels:
                        if t not in self.schema.nodes:
                            raise BinderError(f"Table {t} does not exist")
                    own = set(x.labels) or set(self.schema.nodes)
                    b = self.scope.get(x.var)
                    if b is not None:
                        if not isinstance(b, Element) or b.kind != "NODE":
                            raise BinderError(f"{x.var} is not a node")
                        own &= set(b.tables)
                    nodes[x.var] = nodes.get(x.var, own) & own
                else:
                    for t in x.types:
                        if t not in self.schema.rels:
                            raise BinderError(f"Table {t} does not exist")
                    if x.var in self.scope:
                        raise BinderError(f"{x.var} is already bound")
                    rels[id(x)] = set(x.types) or set(self.schema.rels)
        changed = True
        while changed:
            changed = False
            for p in m.paths:
                for k in range(1, len(p), 2):
                    a, r, b = p[k - 1 : k + 2]
                    if r.hops is not None:
                        continue
                    ends = [(t.type, s, d) for t in (self.schema.rels[x] for x in rels[id(r)]) for s, d in ([(t.source, t.target)] if r.direction == "out" else [(t.target, t.source)] if r.direction == "in" else [(t.source, t.target), (t.target, t.source)]) if s in nodes[a.var] and d in nodes[b.var]]
                    keep = (
                        (rels, id(r), {t for t, _, _ in ends}),
                        (nodes, a.var, {s for _, s, _ in ends}),
                        (nodes, b.var, {d for _, _, d in ends}),
                    )
                    for held, key, new in keep:
                        if held[key] - new:
                            held[key] = held[key] & new
                            changed = True
        return nodes, rels

    def union(self, kind: str, tables: list[str]) -> tuple[list[str], dict[str, str], DataFrame]:
        """All rows of node or relationship tables: fixed columns and the properties of any of them."""
        declared = self.schema.nodes if kind == "NODE" else self.schema.rels
        props: dict[str, str] = {}
        for t in tables:
            for p, s in declared[t].properties.items():
                s = STORED[s]
                props[p] = s if props.get(p, s) == s else "CONFLICT"
        out = None
        for t in tables:
            d = self.graph.node_table(t) if kind == "NODE" else self.graph.rel_table(t)
            fixed = [F.col("id"), F.lit(t).alias("label")] if kind == "NODE" else [F.col("rel_id").alias("id"), F.lit(t).alias("label"), F.col("src"), F.col("dst")]
            own = [F.col(p).cast(SQL_TYPES[s]).alias(f"p_{p}") if p in declared[t].properties else F.lit(None).cast(SQL_TYPES[s]).alias(f"p_{p}") for p, s in props.items() if s != "CONFLICT"]
            d = d.select(*fixed, *own)
            out = d if out is None else out.unionByName(d)
        return tables, props, out

    def scan(self, kind: str, tables: set[str]) -> tuple[Element, DataFrame]:
        order = [t for t in (self.schema.nodes if kind == "NODE" else self.schema.rels) if t in tables]
        prefix = self.fresh("n" if kind == "NODE" else "r")
        if not order:  # labels that can't meet: no rows
            any_table = next(iter(self.schema.nodes if kind == "NODE" else self.schema.rels))
            _, props, d = self.union(kind, [any_table])
            d = d.filter(F.lit(False))
        else:
            _, props, d = self.union(kind, order)
        b = Element(kind, prefix, tuple(order), props)
        return b, d.select(*[F.col(c).alias(f"{prefix}_{c}") for c in d.columns])

    def matched(self, df, scope, m: S.Match, nodes, rels) -> tuple[DataFrame, dict[str, Binding]]:
        outer, self.scope = self.scope, scope
        try:
            hidden: set[str] = set()
            for p in m.paths:
                df = self.path(df, p, nodes, rels, m.where, hidden)
            if m.where is not None:
                df = df.filter(self.condition(m.where))
            bound = {x.var for p in m.paths for x in p if not x.named}
            return df, {v: b for v, b in self.scope.items() if v not in bound}
        finally:
            self.scope = outer

    def path(self, df, p, nodes, rels, where, hidden) -> DataFrame:
        start = self.start(p, nodes, where)
        df = self.place(df, p[start], nodes)
        for k in range(start, len(p) - 1, 2):
            df = self.expand(df, p[k], p[k + 1], p[k + 2], False, nodes, rels)
        for k in range(start, 0, -2):
            df = self.expand(df, p[k], p[k - 1], p[k - 2], True, nodes, rels)
        return df

    def start(self, p, nodes, where) -> int:
        """Where to begin: a bound variable, else a node that is fixed by an equality, else the fewest tables."""
        fixed = {x.left.of.name for x in walk(where) if isinstance(x, S.Binary) and x.op == "=" and isinstance(x.left, S.Prop) and isinstance(x.left.of, S.Var) and isinstance(x.right, (S.Lit, S.Param))} if where is not None else set()
        cost = [(0 if x.var in self.scope else 1 if x.props or x.var in fixed else 2 + len(nodes[x.var]), k) for k, x in enumerate(p) if isinstance(x, S.Node)]
        return min(cost)[1]

    def props_filter(self, df, props, b: Element) -> DataFrame:
        for k, e in props:
            left = self.prop_of(b, k)
            df = df.filter(self.equal(left, self.expr(e)).col)
        return df

    def place(self, df, n: S.Node, nodes) -> DataFrame:
        b = self.scope.get(n.var)
        if b is None:
            b, d = self.scan("NODE", nodes[n.var])
            df = d if df is None else df.crossJoin(d)
            self.scope[n.var] = b
        elif set(b.tables) - nodes[n.var]:
            df = df.filter(F.col(f"{b.prefix}_label").isin(*sorted(nodes[n.var])) if nodes[n.var] else F.lit(False))
        return self.props_filter(df, n.props, b)

    def expand(self, df, a: S.Node, r: S.Rel, b: S.Node, backwards: bool, nodes, rels) -> DataFrame:
        near = self.scope[a.var]
        direction = {"out": "in", "in": "out", "both": "both"}[r.direction] if backwards else r.direction
        e, edges = self.scan("REL", rels[id(r)])
        ends = self.endpoint_labels(e)
        edges = edges.withColumns({f"{e.prefix}_sl": ends[0], f"{e.prefix}_dl": ends[1]})
        edges = self.props_filter(edges, r.props, e)
        one = edges.withColumns({f"{e.prefix}_from": F.col(f"{e.prefix}_src"), f"{e.prefix}_to": F.col(f"{e.prefix}_dst"), f"{e.prefix}_fl": F.col(f"{e.prefix}_sl"), f"{e.prefix}_tl": F.col(f"{e.prefix}_dl")})
        two = edges.withColumns({f"{e.prefix}_from": F.col(f"{e.prefix}_dst"), f"{e.prefix}_to": F.col(f"{e.prefix}_src"), f"{e.prefix}_fl": F.col(f"{e.prefix}_dl"), f"{e.prefix}_tl": F.col(f"{e.prefix}_sl")})
        steps = {"out": one, "in": two, "both": None}[direction]
        if steps is None:
            steps = one.unionByName(two)
        to, to_label = f"{e.prefix}_to", f"{e.prefix}_tl"
        if r.hops is None:
            df = df.join(steps, F.col(f"{near.prefix}_id") == F.col(f"{e.prefix}_from"))
            self.scope[r.var] = e
        else:
            df = self.walked(df, near, steps, e, r, backwards)
            self.scope[r.var] = Value(f"{e.prefix}_walk", list_type("REL") if r.var in self.listed else "WALK")
        known = self.scope.get(b.var)
        if known is not None:
            df = df.filter(F.col(to) == known.id())
            return self.place(df, b, nodes)
        fixed_labels = nodes[b.var]
        if not b.props and b.var not in self.reads and r.hops is None:
            # only the id is read, and every relationship's ends are there: no join with the nodes
            prefix = self.fresh("n")
            self.scope[b.var] = Element("NODE", prefix, tuple(t for t in self.schema.nodes if t in fixed_labels), {})
            df = df.filter(F.col(to_label).isin(*sorted(fixed_labels)) if fixed_labels else F.lit(False))
            return df.withColumns({f"{prefix}_id": F.col(to), f"{prefix}_label": F.col(to_label)})
        t, d = self.scan("NODE", fixed_labels)
        d = self.props_filter(d, b.props, t)
        self.scope[b.var] = t
        return df.join(d, F.col(to) == t.id())

    def endpoint_labels(self, e: Element) -> tuple[Column, Column]:
        label = F.col(f"{e.prefix}_label")
        out = []
        for side in ("source", "target"):
            c = F.lit(None).cast("string")
            for t in e.tables:
                c = F.when(label == t, F.lit(getattr(self.schema.rels[t], side))).otherwise(c)
            out.append(c)
        return out[0], out[1]

    def walked(self, df, near, steps, e: Element, r: S.Rel, backwards: bool) -> DataFrame:
        """Walks of lo to hi relationships: one join a level; the lineage is cut and emptiness tested each few levels.

        A walk is the list of its relationships, or only their number where nothing else of it is read.
        """
        lo, hi = r.hops
        whole = r.var in self.listed
        p = e.prefix
        props = [f for f, t in e.props.items() if t != "CONFLICT"]
        one = F.struct(F.col(f"{p}_id").alias("id"), F.col(f"{p}_label").alias("label"), F.col(f"{p}_src").alias("src"), F.col(f"{p}_dst").alias("dst"), *[F.col(f"{p}_p_{f}").alias(f"p_{f}") for f in props])
        edges = steps.select(F.col(f"{p}_from").alias("w_from"), F.col(f"{p}_to").alias("w_to"), F.col(f"{p}_tl").alias("w_label"), *([one.alias("w_edge")] if whole else []))
        empty = F.array().cast(edges.select(F.array("w_edge")).schema[0].dataType) if whole else F.lit(0)
        names = df.columns
        level = df.select(*names, near.id().alias(f"{p}_to"), F.col(f"{near.prefix}_label").alias(f"{p}_tl"), empty.alias(f"{p}_walk"))
        found = [level] if lo == 0 else []
        for k in range(1, hi + 1):
            level = level.join(edges, F.col(f"{p}_to") == F.col("w_from")).select(*names, F.col("w_to").alias(f"{p}_to"), F.col("w_label").alias(f"{p}_tl"), (F.array_append(f"{p}_walk", F.col("w_edge")) if whole else F.lit(k)).alias(f"{p}_walk"))
            if k % 4 == 0 and hi > 6:
                from ..operators.storage import written

                level = written(level)
                if level.isEmpty():
                    break
            if k >= lo:
                found.append(level)
        out = reduce(lambda a, b: a.unionByName(b), found) if found else level.filter(F.lit(False))
        return out.withColumn(f"{p}_walk", F.reverse(f"{p}_walk")) if backwards and whole else out

    # ---- projections
    def project(self, c: S.Project) -> None:
        if not c.last:
            for i in c.items:
                if not i.aliased and not isinstance(i.expr, S.Var):
                    raise BinderError(f"{i.name} needs an alias")
            if c.order and c.skip is None and c.limit is None:
                raise BinderError("ORDER BY in WITH needs SKIP or LIMIT")
        names = [i.name for i in c.items]
        if len(set(names)) < len(names):
            raise BinderError("two columns have one name")
        skip, limit = self.count_of(c.skip, "SKIP"), self.count_of(c.limit, "LIMIT")
        df = self.df if self.df is not None else self.graph.spark.range(1).select()
        grouped = any(has_aggregate(i.expr) for i in c.items)
        sort: list[tuple[Column, bool]] = []
        new: dict[str, Binding] = {}
        if grouped:
            df, new, sort = self.aggregated(df, c)
        else:
            cols = []
            for i in c.items:
                own, b = self.item(i)
                cols += own
                new[i.name] = b
            incoming = self.scope
            own_names = [n for b in new.values() for n in ([b.col] if isinstance(b, Value) else b.names())]
            if c.distinct:
                df = df.select(*cols).dropDuplicates([b.col if isinstance(b, Value) else f"{b.prefix}_id" for b in new.values()])
                self.scope = new
            else:
                df = df.select("*", *cols)
                self.scope = {**new, **incoming}
            sort = [(self.sortable(e), down) for e, down in c.order]
            self.scope = new
            if not c.distinct and not sort and skip is None and limit is None:
                df = df.select(*own_names)
        own_names = [n for b in new.values() for n in ([b.col] if isinstance(b, Value) else b.names())]
        if grouped and c.distinct:
            df = df.dropDuplicates([b.col if isinstance(b, Value) else f"{b.prefix}_id" for b in new.values()])
        if sort or skip is not None or limit is not None:
            keys = [s.desc_nulls_first() if down else s.asc_nulls_last() for s, down in sort]
            if skip is not None or limit is not None:
                keys += [F.col(b.col if isinstance(b, Value) else f"{b.prefix}_id").asc_nulls_last() for b in new.values()]
            df = df.orderBy(*keys)
            if skip:
                df = df.offset(skip)
            if limit is not None:
                df = df.limit(limit)
        df = df.select(*own_names)
        self.df, self.scope = df, new
        if c.where is not None:
            self.df = self.df.filter(self.condition(c.where))
        if c.last:
            self.df = self.df.select(*[self.returned(b).alias(n) for n, b in new.items()])

    def count_of(self, e, what: str) -> int | None:
        if e is None:
            return None
        v = e.value if isinstance(e, S.Lit) else self.param(e.name) if isinstance(e, S.Param) else None
        if variables(e):
            raise BinderError(f"{what} can't use variables")
        if type(v) is not int or v < 0:
            raise BinderError(f"{what} takes a whole number, 0 or more")
        return v

    def item(self, i: S.Item) -> tuple[list[Column], Binding]:
        if isinstance(i.expr, S.Var):
            b = self.lookup(i.expr.name)
            if isinstance(b, Element):
                new = replace(b, prefix=self.fresh("n" if b.kind == "NODE" else "r"))
                return [F.col(o).alias(n) for o, n in zip(b.names(), new.names(), strict=True)], new
        t = self.expr(i.expr)
        v = Value(self.fresh("v"), t.type)
        return [t.col.alias(v.col)], v

    def returned(self, b: Binding) -> Column:
        if isinstance(b, Value):
            return F.col(b.col)
        return self.whole(b)

    def whole(self, b: Element) -> Column:
        """A node or relationship as a struct; null where an optional match found none."""
        p = b.prefix
        props = [F.col(f"{p}_p_{f}").alias(f) for f, t in b.props.items() if t != "CONFLICT"]
        if b.kind == "NODE":
            s = F.struct(F.col(f"{p}_label").alias("_label"), F.col(f"{p}_id").alias("id"), *props)
        else:
            s = F.struct(F.col(f"{p}_label").alias("_label"), F.col(f"{p}_src").alias("_src"), F.col(f"{p}_dst").alias("_dst"), *props)
        return F.when(b.id().isNotNull(), s)

    def aggregated(self, df, c: S.Project):
        keys = [i for i in c.items if not has_aggregate(i.expr)]
        group, rest, new = [], [], {}
        replaced: dict[Any, Typed] = {}
        for i in keys:
            cols, b = self.item(i)
            df = df.select("*", *cols)
            if isinstance(b, Value):
                group.append(b.col)
                replaced[i.expr] = Typed(F.col(b.col), b.type)
            else:
                group += [f"{b.prefix}_{x}" for x in b.fixed]
                rest += [F.first(n).alias(n) for n in b.names() if n not in group]
                for p, t in b.props.items():
                    if t != "CONFLICT":
                        replaced[S.Prop(i.expr, p)] = Typed(F.first(f"{b.prefix}_p_{p}"), t)
                replaced[S.Call("id", (i.expr,))] = Typed(F.col(f"{b.prefix}_id"), "STRING")
            new[i.name] = b
        made: list[Column] = []
        self.inside = replaced
        try:
            for i in c.items:
                if i not in keys:
                    t = self.over(i.expr)
                    v = Value(self.fresh("v"), t.type)
                    made.append(t.col.alias(v.col))
                    new[i.name] = v
            sort = []
            for e, down in c.order:
                match = next((i for i in c.items if i.expr == e or (isinstance(e, S.Var) and e.name == i.name)), None)
                if match is not None:
                    b = new[match.name]
                    sort.append((F.col(b.col) if isinstance(b, Value) else b.id(), down))
                else:
                    t = self.over(e, {n: b for n, b in new.items() if isinstance(b, Value) and b.col in group})
                    v = self.fresh("o")
                    made.append(t.col.alias(v))
                    sort.append((F.col(v), down))
        finally:
            self.inside = {}
        order = {n: new[n] for n in [i.name for i in c.items]}
        return df.groupBy(*group).agg(*made, *rest) if made or rest else df.groupBy(*group).agg(F.count(F.lit(1)).alias("unused")), order, sort

    inside: dict = {}

    def over(self, e, extra: dict | None = None) -> Typed:
        """An expression with aggregates: what is outside them must be a key."""
        if extra:
            self.scope = {**self.scope, **extra}

        def check(x) -> None:
            if x in self.inside or (isinstance(x, S.Call) and x.name in AGGREGATES) or x is None:
                return
            if isinstance(x, S.Var) and not (extra and x.name in extra):
                raise UnsupportedError(f"{x.name} is neither aggregated nor a key of the group")
            for y in children(x):
                check(y)

        check(e)
        return self.expr(e)

    def sortable(self, e) -> Column:
        t = self.expr(e)
        if t.type in ("NODE", "REL"):
            return self.lookup(e.name).id() if isinstance(e, S.Var) else t.col
        return t.col

    # ---- expressions
    def lookup(self, name: str) -> Binding:
        if name not in self.scope:
            raise BinderError(f"Variable {name} is not in scope")
        return self.scope[name]

    def param(self, name: str):
        if name not in self.params:
            raise BinderError(f"Parameter {name} not found")
        return self.params[name]

    def condition(self, e) -> Column:
        if has_aggregate(e):
            raise BinderError("aggregates can't stand in WHERE")
        return self.boolean(self.expr(e)).col

    @staticmethod
    def boolean(t: Typed) -> Typed:
        if t.type == "NULL":
            return Typed(F.lit(None).cast("boolean"), "BOOL")
        if t.type != "BOOL":
            raise BinderError(f"expected BOOL, found {t.type}")
        return t

    def literal(self, v) -> Typed:
        if v is None:
            return null()
        if isinstance(v, bool):
            return Typed(F.lit(v), "BOOL")
        if isinstance(v, int):
            return Typed(F.lit(v).cast("bigint"), "INT")
        if isinstance(v, float):
            return Typed(F.lit(v), "FLOAT")
        if isinstance(v, str):
            return Typed(F.lit(v), "STRING")
        if isinstance(v, (list, tuple)):
            return self.list_of([self.literal(x) for x in v])
        raise BinderError(f"{type(v).__name__} can't be a parameter")

    @staticmethod
    def list_of(items: list[Typed]) -> Typed:
        kinds = {t.type for t in items} - {"NULL"}
        if kinds == {"INT", "FLOAT"}:
            items, kinds = [Typed(t.col.cast("double"), "FLOAT") for t in items], {"FLOAT"}
        if len(kinds) > 1:
            raise UnsupportedError("a list has elements of one type")
        kind = next(iter(kinds), "NULL")
        if not items:
            return Typed(F.array().cast("array<string>"), list_type("NULL"))
        sql = SQL_TYPES.get(kind)
        return Typed(F.array(*[t.col.cast(sql) if sql and t.type == "NULL" else t.col for t in items]), list_type(kind))

    def prop_of(self, b: Element, name: str) -> Typed:
        if name == "id":
            return Typed(b.id(), "STRING")
        if name not in b.props:
            if b.tables:
                raise BinderError(f"Cannot find property {name}")
            return null()
        if b.props[name] == "CONFLICT":
            raise UnsupportedError(f"{name} has different types in {', '.join(b.tables)}")
        return Typed(F.col(f"{b.prefix}_p_{name}"), b.props[name])

    def expr(self, e) -> Typed:
        if e in self.inside:
            return self.inside[e]
        if isinstance(e, S.Lit):
            return self.literal(e.value)
        if isinstance(e, S.Param):
            return self.literal(self.param(e.name))
        if isinstance(e, S.Var):
            b = self.lookup(e.name)
            return Typed(F.col(b.col), b.type) if isinstance(b, Value) else Typed(self.whole(b), b.kind)
        if isinstance(e, S.Prop):
            if isinstance(e.of, S.Var):
                b = self.lookup(e.of.name)
                if isinstance(b, Element):
                    return self.prop_of(b, e.name)
            self.expr(e.of)
            return null()
        if isinstance(e, S.ListOf):
            return self.list_of([self.expr(x) for x in e.items])
        if isinstance(e, S.Unary):
            return self.unary(e)
        if isinstance(e, S.Binary):
            return self.binary(e)
        if isinstance(e, S.Case):
            return self.case(e)
        return self.call(e)

    def unary(self, e: S.Unary) -> Typed:
        t = self.expr(e.of)
        if e.op in ("IS NULL", "IS NOT NULL"):
            return Typed(t.col.isNull() if e.op == "IS NULL" else t.col.isNotNull(), "BOOL")
        if e.op == "NOT":
            return Typed(~self.boolean(t).col, "BOOL")
        if t.type == "NULL":
            return t
        if t.type not in NUMERIC:
            raise BinderError(f"{e.op} takes a number, found {t.type}")
        return Typed(-t.col, t.type) if e.op == "-" else t

    def equal(self, a: Typed, b: Typed) -> Typed:
        none = Typed(F.lit(None).cast("boolean"), "BOOL")
        if "NULL" in (a.type, b.type):
            return none
        if is_list(a.type) and is_list(b.type):
            if "NULL" in (element(a.type), element(b.type)) and element(a.type) != element(b.type):
                return Typed(F.when(F.size(a.col) != F.size(b.col), F.lit(False)).otherwise(F.when(F.size(a.col) == 0, True)), "BOOL")
            if element(a.type) != element(b.type) and not {element(a.type), element(b.type)} <= set(NUMERIC):
                return none
            each = F.aggregate(F.zip_with(a.col, b.col, lambda x, y: x == y), F.lit(True), lambda s, x: s & x)
            return Typed(F.when(F.size(a.col) != F.size(b.col), F.lit(False)).otherwise(each), "BOOL")
        if a.type in ("NODE", "REL"):
            return Typed(a.col == b.col, "BOOL") if a.type == b.type else none
        if a.type == b.type or {a.type, b.type} <= set(NUMERIC) or {a.type, b.type} == {"TIMESTAMP", "STRING"}:
            return Typed(a.col == b.col, "BOOL")
        return none

    def binary(self, e: S.Binary) -> Typed:
        op = e.op
        if op in ("=", "<>") and isinstance(e.left, S.Var) and isinstance(e.right, S.Var):
            x, y = self.lookup(e.left.name), self.lookup(e.right.name)
            if isinstance(x, Element) and isinstance(y, Element) and x.kind == y.kind:  # by identity
                return Typed(x.id() == y.id() if op == "=" else x.id() != y.id(), "BOOL")
        a, b = self.expr(e.left), self.expr(e.right)
        if op in ("AND", "OR", "XOR"):
            x, y = self.boolean(a).col, self.boolean(b).col
            return Typed(x & y if op == "AND" else x | y if op == "OR" else x != y, "BOOL")
        if op == "=":
            return self.equal(a, b)
        if op == "<>":
            return Typed(~self.equal(a, b).col, "BOOL")
        if op in ("<", "<=", ">", ">="):
            ok = a.type == b.type and a.type in ("STRING", "BOOL", "INT", "FLOAT", "TIMESTAMP") or {a.type, b.type} <= set(NUMERIC) or {a.type, b.type} == {"TIMESTAMP", "STRING"}
            if not ok:
                return Typed(F.lit(None).cast("boolean"), "BOOL")
            return Typed({"<": a.col < b.col, "<=": a.col <= b.col, ">": a.col > b.col, ">=": a.col >= b.col}[op], "BOOL")
        if op == "IN":
            return self.within(a, b)
        if op in ("STARTS WITH", "ENDS WITH", "CONTAINS"):
            return self.text_test({"STARTS WITH": "starts_with", "ENDS WITH": "ends_with", "CONTAINS": "contains"}[op], a, b)
        return self.arithmetic(op, a, b)

    def within(self, a: Typed, b: Typed) -> Typed:
        if b.type == "NULL":
            return Typed(F.lit(None).cast("boolean"), "BOOL")
        if not is_list(b.type):
            raise BinderError(f"IN takes a list, found {b.type}")
        kind = element(b.type)
        empty = F.size(b.col) == 0
        if a.type == "NULL" or kind == "NULL" or (kind != a.type and not {kind, a.type} <= set(NUMERIC)):
            return Typed(F.when(empty, F.lit(False)).otherwise(F.lit(None).cast("boolean")), "BOOL")
        if kind != a.type:
            a, b = Typed(a.col.cast("double"), "FLOAT"), Typed(b.col.cast("array<double>"), list_type("FLOAT"))
        return Typed(F.when(empty, F.lit(False)).otherwise(F.array_contains(b.col, a.col)), "BOOL")

    @staticmethod
    def text_test(name: str, a: Typed, b: Typed) -> Typed:
        for t in (a, b):
            if t.type not in ("STRING", "NULL"):
                raise BinderError(f"{name} takes STRING, found {t.type}")
        if "NULL" in (a.type, b.type):
            return Typed(F.lit(None).cast("boolean"), "BOOL")
        return Typed({"starts_with": F.startswith, "ends_with": F.endswith, "contains": F.contains}[name](a.col, b.col), "BOOL")

    @staticmethod
    def arithmetic(op: str, a: Typed, b: Typed) -> Typed:
        kinds = {a.type, b.type}
        if op == "+":
            if is_list(a.type) and is_list(b.type):
                return Typed(F.concat(a.col, b.col), a.type if element(a.type) != "NULL" else b.type)
            if is_list(a.type):
                return Typed(F.array_append(a.col, b.col), a.type)
            if is_list(b.type):
                return Typed(F.array_prepend(b.col, a.col), b.type)
            if "STRING" in kinds:
                if not kinds <= {"STRING", "NULL"}:
                    raise BinderError(f"+ can't take {a.type} and {b.type}")
                return Typed(F.concat(F.coalesce(a.col, F.lit("")), F.coalesce(b.col, F.lit(""))), "STRING")
        if not kinds <= {*NUMERIC, "NULL"}:
            raise BinderError(f"{op} can't take {a.type} and {b.type}")
        if "NULL" in kinds:
            other = next(iter(kinds - {"NULL"}), "INT")
            return Typed(F.lit(None).cast(SQL_TYPES[other]), other)
        whole = kinds == {"INT"}
        x, y = (a.col, b.col) if whole else (a.col.cast("double"), b.col.cast("double"))
        if op in "+-*":
            return Typed({"+": x + y, "-": x - y, "*": x * y}[op], "INT" if whole else "FLOAT")
        if whole:
            zero = F.raise_error(F.lit("Divide by zero.")).cast("bigint")
            safe = F.when(y == 0, F.lit(1).cast("bigint")).otherwise(y)
            out = F.when(y == 0, zero).otherwise(F.call_function("div", x, safe) if op == "/" else x % safe)
            return Typed(F.when(x.isNull() | y.isNull(), F.lit(None).cast("bigint")).otherwise(out), "INT")
        nan, inf = F.lit(float("nan")), F.lit(float("inf"))
        safe = F.when(y == 0, F.lit(1.0)).otherwise(y)
        if op == "/":
            return Typed(F.when(y == 0, F.when((x == 0) | F.isnan(x), nan).when(x > 0, inf).when(x < 0, -inf)).otherwise(x / safe), "FLOAT")
        return Typed(F.when(y == 0, F.when(x.isNotNull(), nan)).otherwise(x % safe), "FLOAT")

    def common(self, items: list[Typed]) -> tuple[list[Typed], str]:
        kinds = {t.type for t in items} - {"NULL"}
        if kinds == {"INT", "FLOAT"}:
            return [Typed(t.col.cast("double"), "FLOAT") for t in items], "FLOAT"
        if len(kinds) > 1:
            raise UnsupportedError(f"branches have types {', '.join(sorted(kinds))}")
        kind = next(iter(kinds), "NULL")
        sql = SQL_TYPES.get(kind)
        return [Typed(t.col.cast(sql), kind) if sql and t.type == "NULL" else t for t in items], kind

    def case(self, e: S.Case) -> Typed:
        subject = self.expr(e.subject) if e.subject is not None else None
        results, kind = self.common([*(self.expr(r) for _, r in e.whens), self.expr(e.other)])
        out = results[-1].col
        for (c, _), r in zip(reversed(e.whens), reversed(results[:-1]), strict=True):
            test = self.boolean(self.expr(c)).col if subject is None else self.equal(subject, self.expr(c)).col
            out = F.when(test, r.col).otherwise(out)
        return Typed(out, kind)

    def call(self, e: S.Call) -> Typed:
        if e.name in AGGREGATES:
            return self.aggregate(e)
        if e.star:
            raise BinderError(f"{e.name}(*) is not a function")
        least, most = {"lower": (1, 1), "tolower": (1, 1), "upper": (1, 1), "toupper": (1, 1), "contains": (2, 2), "starts_with": (2, 2), "ends_with": (2, 2), "size": (1, 1), "coalesce": (1, 99), "label": (1, 1), "labels": (1, 1), "id": (1, 1)}.get(e.name, (None, None))
        if least is None:
            raise BinderError(f"Function {e.name} does not exist")
        if not least <= len(e.args) <= most:
            raise BinderError(f"{e.name} takes {least}{'' if most == least else ' or more'} arguments")
        if e.name in ("label", "labels", "id"):
            b = self.scope.get(e.args[0].name) if isinstance(e.args[0], S.Var) else None
            if isinstance(b, Element):
                if e.name == "id":
                    if b.kind == "REL":
                        raise BinderError("id takes a node")
                    return Typed(b.id(), "STRING")
                name = F.col(f"{b.prefix}_label")
                return Typed(name, "STRING") if e.name == "label" else Typed(F.when(name.isNotNull(), F.array(name)), list_type("STRING"))
            t = self.expr(e.args[0])
            if t.type == "NULL":
                return null("STRING") if e.name != "labels" else Typed(F.lit(None).cast("array<string>"), list_type("STRING"))
            raise BinderError(f"{e.name} takes a node, found {t.type}")
        args = [self.expr(a) for a in e.args]
        if e.name == "coalesce":
            args, kind = self.common(args)
            return Typed(F.coalesce(*[a.col for a in args]), kind)
        if e.name in ("contains", "starts_with", "ends_with"):
            return self.text_test(e.name, *args)
        t = args[0]
        if e.name == "size":
            if t.type == "NULL":
                return null("INT")
            if t.type == "WALK":
                return Typed(t.col.cast("bigint"), "INT")
            if t.type != "STRING" and not is_list(t.type):
                raise BinderError(f"size takes STRING or LIST, found {t.type}")
            return Typed((F.char_length(t.col) if t.type == "STRING" else F.size(t.col)).cast("bigint"), "INT")
        if t.type not in ("STRING", "NULL"):
            raise BinderError(f"{e.name} takes STRING, found {t.type}")
        return Typed(F.lower(t.col) if "lower" in e.name else F.upper(t.col), "STRING")

    def aggregate(self, e: S.Call) -> Typed:
        if e.star:
            if e.name != "count":
                raise BinderError(f"{e.name}(*) is not a function")
            return Typed(F.count(F.lit(1)), "INT")
        if len(e.args) != 1:
            raise BinderError(f"{e.name} takes 1 argument")
        arg = e.args[0]
        if has_aggregate(arg):
            raise BinderError("aggregates can't be nested")
        outside, self.inside = self.inside, {}
        try:
            b = self.scope.get(arg.name) if isinstance(arg, S.Var) else None
            if isinstance(b, Element) and e.name == "count":
                return Typed(F.count_distinct(b.id()) if e.distinct else F.count(b.id()), "INT")
            t = self.expr(arg)
        finally:
            self.inside = outside
        if e.name == "count":
            return Typed(F.count_distinct(t.col) if e.distinct else F.count(t.col), "INT")
        if e.name == "collect":
            got = F.collect_set(t.col) if e.distinct else F.collect_list(t.col)
            return Typed(F.when(F.size(got) > 0, F.array_sort(got)), list_type(t.type))
        if e.name in ("min", "max"):
            return Typed((F.min if e.name == "min" else F.max)(t.col), t.type)
        if t.type not in (*NUMERIC, "NULL"):
            raise BinderError(f"{e.name} takes a number, found {t.type}")
        x = t.col.cast("double") if e.name == "avg" or t.type == "NULL" else t.col
        if e.name == "avg":
            return Typed(F.avg(x) if not e.distinct else F.sum_distinct(x) / F.count_distinct(x), "FLOAT")
        return Typed(F.sum_distinct(x) if e.distinct else F.sum(x), t.type if t.type != "NULL" else "FLOAT")


def children(e) -> list:
    if isinstance(e, S.Prop):
        return [e.of]
    if isinstance(e, S.ListOf):
        return list(e.items)
    if isinstance(e, S.Call):
        return list(e.args)
    if isinstance(e, S.Unary):
        return [e.of]
    if isinstance(e, S.Binary):
        return [e.left, e.right]
    if isinstance(e, S.Case):
        return [x for x in (e.subject, e.other, *(y for w in e.whens for y in w)) if x is not None]
    return []


def compiled(graph, text: str, params: dict[str, Any]) -> DataFrame:
    return Compiler(graph, params).run(S.parsed(text))
