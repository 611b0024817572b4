"""Bounded traversals as set-at-a-time loops: one join a level, each level written to the shared folder.

Edges are (src, dst); seeds are (id). A hot node's edges are split by adaptive skew joins, and what
reaches a node in one level is summed before the shuffle. Only emptiness comes to the driver.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import dropped, shipped, written

#: Edges of one adjacency list, tables that are broadcast, and values in a batch that a search hands out, at most or about.
LIST, BROADCAST_ROWS, BATCH = 10_000, 10_000, 100_000
#: Members of a component that one row of its parts stands for, and rows of a result that one task makes, about.
MEMBERS, TASK_ROWS = 1_000, 4_000_000


def turned(edges: DataFrame) -> DataFrame:
    others = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *others)


def bfs(edges: DataFrame, seeds: DataFrame, depth: int, up: bool = False) -> DataFrame:
    """(id, depth): nodes within ``depth`` steps of any seed, seeds at 0, each at its least depth."""
    e = written((turned(edges) if up else edges).select("src", "dst").distinct())
    levels = [written(seeds.select("id").distinct().withColumn("depth", F.lit(0)))]
    for k in range(1, depth + 1):
        seen = reduce(DataFrame.unionByName, levels).select("id")
        step = e.join(levels[-1].select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        level = written(step.join(seen, "id", "left_anti").withColumn("depth", F.lit(k)))
        if level.isEmpty():
            break
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def bfs_with_via(edges: DataFrame, seeds: DataFrame, depth: int, up: bool = False) -> DataFrame:
    """(id, depth, via): as ``bfs``, with the least neighbour of the level before (null for seeds)."""
    e = written((turned(edges) if up else edges).select("src", "dst").distinct())
    kind = edges.schema["src"].dataType
    levels = [written(seeds.select("id").distinct().select("id", F.lit(0).alias("depth"), F.lit(None).cast(kind).alias("via")))]
    for k in range(1, depth + 1):
        seen = reduce(DataFrame.unionByName, levels).select("id")
        step = e.join(levels[-1].select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("via"))
        level = written(step.join(seen, "id", "left_anti").select("id", F.lit(k).alias("depth"), "via"))
        if level.isEmpty():
            break
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def _start(seeds: DataFrame) -> DataFrame:
    return seeds.select(F.col("id").alias("seed")).distinct()


def _chains_by_levels(e: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """As ``shortest_chains``, by a join a level over rows of (seed, node, path)."""
    levels = [written(start.select("seed", F.col("seed").alias("id"), F.lit(0).alias("depth"), F.array("seed").alias("path"), F.lit(None).cast(e.schema["strength"].dataType).alias("weakest")))]
    for k in range(1, depth + 1):
        seen = reduce(DataFrame.unionByName, levels).select("seed", "id")
        step = levels[-1].join(e, F.col("id") == F.col("src")).select("seed", F.col("dst").alias("id"), F.array_append("path", F.col("dst")).alias("path"), F.least("weakest", "strength").alias("weakest"))
        best = step.groupBy("seed", "id").agg(F.min(F.struct("path", "weakest")).alias("b"))
        level = written(best.join(seen, ["seed", "id"], "left_anti").select("seed", "id", F.lit(k).alias("depth"), "b.path", "b.weakest"))
        if level.isEmpty():
            break
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def _within_hubs(e: DataFrame, most: int) -> DataFrame:
    """(src, dsts, strengths): adjacency lists of about ``most`` edges at most, more than one of a node with more; a written table."""
    hubs = written(e.groupBy("src").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most))
    n = hubs.count()
    if n:
        hubs = hubs.select(F.col("src").alias("hub"), F.ceil(F.col("n") / most).cast("long").alias("parts"))
        e = e.join(F.broadcast(hubs) if n <= BROADCAST_ROWS else hubs, F.col("src") == F.col("hub"), "left").withColumn("part", F.pmod(F.xxhash64("dst"), F.coalesce("parts", F.lit(1))))
    lists = e.groupBy("src", *["part"] * bool(n)).agg(F.collect_list(F.struct("dst", "strength")).alias("out"))
    return written(lists.select("src", F.col("out.dst").alias("dsts"), F.col("out.strength").alias("strengths")))


def _ordered_bfs(rows: pa.Table, depth: int, paths: bool) -> Iterator[pa.RecordBatch]:
    """Shortest chains of one group's seeds from rows (id, seed, dsts, strengths).

    Nodes are numbered in their order. A level is kept in the order of its paths and lists are in the
    order of nodes, so the first edge that meets a node ends the least of its shortest paths.
    """
    rows = rows.combine_chunks()
    lists, held = rows["dsts"].combine_chunks(), rows["strengths"].combine_chunks()
    from_row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    coded = pc.dictionary_encode(pa.concat_arrays([rows["id"].combine_chunks(), pc.list_flatten(lists)]))
    order = pc.sort_indices(coded.dictionary).to_numpy()
    names = coded.dictionary.take(pa.array(order))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    code = rank[coded.indices.to_numpy()]
    # strengths by their place among the distinct ones; null, which no least takes, is past the end
    marks = pc.dictionary_encode(pc.list_flatten(held))
    by_size = pc.sort_indices(marks.dictionary).to_numpy()
    values = pa.concat_arrays([marks.dictionary.take(pa.array(by_size)), pa.nulls(1, marks.dictionary.type)])
    place = np.empty(len(by_size) + 1, np.int64)
    place[by_size] = np.arange(len(by_size))
    place[-1] = len(by_size)
    strength = place[pc.fill_null(marks.indices.cast(pa.int64()), len(by_size)).to_numpy(zero_copy_only=False)]

    src, dst = code[: rows.num_rows][from_row], code[rows.num_rows :]
    way = np.lexsort((dst, src))
    dst, strength = dst[way], strength[way]
    first = np.searchsorted(src[way], np.arange(len(names) + 1))
    many = np.diff(first)
    seen, met = np.zeros(len(names), bool), np.empty(len(names), np.int64)

    def batch(found: list) -> pa.RecordBatch:
        seed, node, at, weak = (np.concatenate([f[k] for f in found]) for k in range(4))
        out = [names.take(pa.array(seed)), names.take(pa.array(node)), pa.array(at)]
        if paths:
            ends = np.concatenate([[0], np.cumsum(at + 1)]).astype(np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(ends), names.take(pa.array(np.concatenate([f[4].ravel() for f in found])))))
        return pa.RecordBatch.from_arrays([*out, values.take(pa.array(weak))], names=["seed", "id", "depth", *["path"] * paths, "weakest"])

    found, n = [], 0
    for s in np.unique(code[: rows.num_rows][rows["seed"].to_numpy()]):
        node, weak, path = np.array([s]), np.array([len(by_size)]), np.array([[s]])
        levels = []
        seen[s] = True
        for k in range(depth + 1):
            levels.append(node)
            found.append((np.full(len(node), s), node, np.full(len(node), k, np.int32), weak, path))
            n += len(node) * (1 + paths * k)
            if n > BATCH:
                yield batch(found)
                found, n = [], 0
            if k == depth:
                break
            count = many[node]
            parent = np.repeat(np.arange(len(node)), count)
            edge = np.arange(len(parent)) + np.repeat(first[node] - np.cumsum(count) + count, count)
            new = ~seen[dst[edge]]
            edge, parent = edge[new], parent[new]
            met[dst[edge][::-1]] = np.arange(len(edge))[::-1]
            new = met[dst[edge]] == np.arange(len(edge))
            edge, parent = edge[new], parent[new]
            if not len(edge):
                break
            node, weak = dst[edge], np.minimum(weak[parent], strength[edge])
            path = np.column_stack([path[parent], node]) if paths else path
            seen[node] = True
        for x in levels:
            seen[x] = False
    if found:
        yield batch(found)


def _labelled(start: DataFrame, lists: DataFrame, rounds: int = 3) -> DataFrame:
    """(seed, label): seeds with a common neighbour get the least seed among them as label, as far as the rounds carry it.

    The label only tells which seeds are likely to share lists; it isn't the name of a whole component.
    """
    links = written(start.join(lists, F.col("seed") == F.col("src")).select("seed", F.explode("dsts").alias("via")))
    now = written(start.select("seed", F.col("seed").alias("label")))
    for _ in range(rounds):
        least = links.join(now, "seed").groupBy("via").agg(F.min("label").alias("sent"))
        sent = links.join(least, "via").groupBy("seed").agg(F.min("sent").alias("sent"))
        before, now = now, written(now.join(sent, "seed", "left").select("seed", F.least("label", "sent").alias("label")))
        dropped(before)
    dropped(links)
    return now


def _grouped(start: DataFrame, lists: DataFrame, n: int, size: int) -> DataFrame:
    """(g, seed): groups of about ``size`` seeds that are near each other in the graph, whatever the order of their ids; a written table."""
    if n <= size:
        return written(start.select(F.lit(0).cast("long").alias("g"), "seed"))
    now = _labelled(start, lists)
    large = now.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > size).select("label", F.lit(True).alias("large"))
    now_large = now.join(F.broadcast(large), "label", "left")  # n / size rows at most; other labels are not cut
    out = written(now_large.repartitionByRange(-(-n // size), "label", F.when(F.col("large"), F.col("seed"))).select(F.spark_partition_id().cast("long").alias("g"), "seed"))
    dropped(now)
    return out


def _before_last(start: DataFrame, sizes: DataFrame, depth: int) -> list[DataFrame]:
    """(g, id, seed): the nodes that a group reaches before its last step, a written table a level."""
    levels = [written(start.select("g", F.col("seed").alias("id"), F.lit(True).alias("seed")))]
    for _ in range(1, depth):
        seen = reduce(DataFrame.unionByName, levels)
        step = levels[-1].join(sizes, F.col("id") == F.col("src")).select("g", F.explode("dsts").alias("id")).distinct()
        level = written(step.join(seen.select("g", "id"), ["g", "id"], "left_anti").withColumn("seed", F.lit(False)))
        if level.isEmpty():
            break
        levels.append(level)
    return levels


def shortest_chains(edges: DataFrame, seeds: DataFrame, depth: int, paths: bool = True, group: int = 256, most: int = 4_000_000) -> DataFrame:
    """(seed, id, depth, path, weakest): for each seed and reached node, the least of the shortest paths.

    edges may have ``strength``; weakest is the least along the path. ``paths`` False leaves the paths out.

    Seeds go in groups of about ``group`` that share neighbours (up to four times as many if there are seeds enough for
    all cores). The nodes that a group reaches before its last step are found by a join a level over (group, node); these
    nodes' adjacency lists then meet in one task a group, where each seed has an ordered search of its own. So the rows
    of the result, by far the most, are never joined, shuffled or written on the way. Groups whose lists hold more than
    ``most`` edges are split, again and again; only a seed that alone has more goes by joins of (seed, node, path) rows.
    """
    spark = edges.sparkSession
    shipped(spark)
    if "strength" not in edges.columns:
        edges = edges.withColumn("strength", F.lit(None).cast("long"))
    whole = written(edges.select("src", "dst", "strength"))
    e = written(whole.groupBy("src", "dst").agg(F.max("strength").alias("strength")))
    dropped(whole)
    lists = _within_hubs(e, LIST)
    start = written(_start(seeds))
    n = start.count()
    size = max(group, min(4 * group, n // (8 * spark.sparkContext.defaultParallelism)))
    groups = _grouped(start, lists, n, size)
    sizes = lists.select("src", F.size("dsts").alias("edges"), "dsts")
    needs, rest = [], None
    for k in itertools.count(1):
        levels = _before_last(groups, sizes, depth)
        need = reduce(DataFrame.unionByName, levels)
        weight = need.join(sizes.select("src", "edges"), F.col("id") == F.col("src")).groupBy("g").agg(F.sum("edges").alias("edges"))
        heavy = written(weight.filter(F.col("edges") > most).select("g"))
        if heavy.isEmpty():
            needs.append(need)
            break
        needs.append(written(need.join(F.broadcast(heavy), "g", "left_anti")))
        dropped(*levels)
        seeds_of = written(groups.join(F.broadcast(heavy), "g", "left_semi"))
        alone = seeds_of.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("g")
        single = written(seeds_of.join(alone, "g", "left_semi").select("seed"))
        if not single.isEmpty():
            rest = single if rest is None else rest.unionByName(single)
        in_order = Window.partitionBy("g").orderBy("seed")
        fourth = F.lit(k << 40) + F.col("g").bitwiseAND(F.lit((1 << 40) - 1)) * 4 + F.ntile(4).over(in_order) - 1  # no group of an earlier round
        groups = written(seeds_of.join(alone, "g", "left_anti").select(fourth.alias("g"), "seed"))
        if groups.isEmpty():
            break
    met = reduce(DataFrame.unionByName, needs).join(lists, F.col("id") == F.col("src"), "left").filter("seed or src is not null")
    met = met.select("g", "id", "seed", "dsts", "strengths")
    kind, held = (edges.schema[c].dataType.simpleString() for c in ("src", "strength"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _ordered_bfs(pa.Table.from_batches(batches), depth, paths)

    columns = f"seed {kind}, id {kind}, depth int, " + f"path array<{kind}>, " * paths + f"weakest {held}"
    out = met.groupBy("g").applyInArrow(run, columns)
    if rest is not None:
        rest = _chains_by_levels(e, rest, depth)
        out = out.unionByName(rest if paths else rest.drop("path"))
    dropped(e)
    return out


def reachable(edges: DataFrame, seeds: DataFrame, most: int = 10_000, few: int = 50_000, local_edges: int | None = None) -> DataFrame:
    """(seed, id): every node that each seed reaches in one step or more.

    Round by round while a round finds ``few`` pairs or less; beyond that strongly connected components, which
    are reached as wholes, take the place of nodes (``local_edges``: as in ``components.condensed``).
    """
    e = written(edges.select("src", "dst"))
    starts = written(_start(seeds))
    near = F.broadcast(starts) if starts.count() <= few else starts
    levels = [written(near.join(e, F.col("seed") == F.col("src")).select("seed", F.col("dst").alias("id")).distinct())]
    for _ in range(most):
        if levels[-1].count() > few:
            dropped(*levels)
            return _through_components(e, starts, most, local_edges)
        seen = reduce(DataFrame.unionByName, levels)
        level = written(levels[-1].join(e, F.col("id") == F.col("src")).select("seed", F.col("dst").alias("id")).distinct().join(seen, ["seed", "id"], "left_anti"))
        if level.isEmpty():
            break
        levels.append(level)
        if len(levels) % 16 == 0:
            whole = written(reduce(DataFrame.unionByName, levels[:-1]))
            dropped(*levels[:-1])
            levels = [whole, levels[-1]]
    else:
        raise RuntimeError(f"reachable: not done after {most} rounds")
    dropped(e)
    return reduce(DataFrame.unionByName, levels)


def _closure(e: DataFrame, starts: DataFrame, most: int) -> list[DataFrame]:
    """(start, id): nodes that each start reaches in one step or more, round by round; written tables."""
    levels = [written(starts.join(e, F.col("start") == F.col("src")).select("start", F.col("dst").alias("id")).distinct())]
    for _ in range(most):
        if levels[-1].isEmpty():
            break
        seen = reduce(DataFrame.unionByName, levels)
        levels.append(written(levels[-1].join(e, F.col("id") == F.col("src")).select("start", F.col("dst").alias("id")).distinct().join(seen, ["start", "id"], "left_anti")))
        if len(levels) % 16 == 0:
            whole = written(reduce(DataFrame.unionByName, levels[:-1]))
            dropped(*levels[:-1])
            levels = [whole, levels[-1]]
    else:
        raise RuntimeError(f"reachable: not done after {most} rounds")
    return levels


def _through_components(e: DataFrame, starts: DataFrame, most: int, local_edges: int | None) -> DataFrame:
    """As ``reachable``, over the graph of strongly connected components, each named after its least node."""
    from .components import condensed

    in_cycle, between = condensed(e.filter("src <> dst"), local_edges)
    # a loop of a node that is in no other cycle is its own way to itself
    loops = written(e.filter("src = dst").select(F.col("src").alias("id")).distinct().join(in_cycle, "id", "left_anti"))
    dropped(e)
    ends = reduce(DataFrame.unionByName, [between.select(F.col(c).alias("id")) for c in ("src", "dst")] + [loops]).distinct()
    whole = in_cycle.unionByName(ends.join(in_cycle, "id", "left_anti").select("id", F.col("id").alias("component")))
    to_itself = in_cycle.select("component").distinct().unionByName(loops.select(F.col("id").alias("component")))
    ways = written(between.unionByName(to_itself.select(F.col("component").alias("src"), F.col("component").alias("dst"))))
    seeds = written(starts.join(whole, F.col("seed") == F.col("id")).select("seed", "component"))
    reach = _closure(ways, seeds.select(F.col("component").alias("start")).distinct(), most)
    pairs = written(seeds.join(reduce(DataFrame.unionByName, reach), F.col("component") == F.col("start")).select("seed", F.col("id").alias("to")))
    sizes = written(in_cycle.groupBy("component").agg(F.count(F.lit(1)).alias("n")))
    dropped(between, loops, ways, starts, seeds, *reach)
    # a component can hold most nodes and be reached by all seeds, so its members are dealt out in parts
    parts = F.ceil(F.col("n") / MEMBERS).cast("long")
    inside = pairs.join(sizes, F.col("to") == F.col("component"))
    tasks = min(10_000, max(1, -(-(inside.agg(F.sum("n")).first()[0] or 0) // TASK_ROWS)))
    members = in_cycle.join(sizes, "component").select("id", "component", F.pmod(F.xxhash64("id"), parts).alias("part"))
    inside = inside.select("seed", "to", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part_to"))
    found = inside.repartition(tasks, "to", "part_to").join(members.repartition(tasks, "component", "part"), (F.col("to") == F.col("component")) & (F.col("part_to") == F.col("part")))
    alone = pairs.join(sizes, F.col("to") == F.col("component"), "left_anti")
    return found.select("seed", "id").unionByName(alone.select("seed", F.col("to").alias("id")))


def propagated(edges: DataFrame, facts: DataFrame, most: int = 10_000) -> DataFrame:
    """(id, fact, depth): facts flow from dst to src (callee to caller) until nothing is new.

    Semi-naive: only the last round's facts are joined; a fact is known by (id, fact), so cycles end.
    """
    e = written(edges.select("src", "dst").distinct())
    known = [written(facts.select("id", "fact").distinct().withColumn("depth", F.lit(0)))]
    for k in range(1, most + 1):
        seen = reduce(DataFrame.unionByName, known).select("id", "fact")
        new = known[-1].join(e, F.col("id") == F.col("dst")).select(F.col("src").alias("id"), "fact").distinct().join(seen, ["id", "fact"], "left_anti")
        level = written(new.withColumn("depth", F.lit(k)))
        if level.isEmpty():
            break
        known.append(level)
        if len(known) % 16 == 0:
            known = [written(reduce(DataFrame.unionByName, known[:-1])), known[-1]]
    else:
        raise RuntimeError(f"propagated: not done after {most} rounds")
    return reduce(DataFrame.unionByName, known)


def min_labels(edges: DataFrame, labels: DataFrame, most: int = 10_000) -> DataFrame:
    """(id, label): the least label among a node and all nodes with a path to it."""
    e = written(edges.select("src", "dst").distinct())
    table = written(labels.select("id", "label"))
    now = changed = table
    for _ in range(most):
        sent = changed.join(e, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("sent"))
        out = written(now.join(sent, "id", "left").select("id", F.least("label", "sent").alias("label"), F.coalesce(F.col("sent") < F.col("label"), F.lit(False)).alias("new")))
        dropped(table)
        table, now, changed = out, out.select("id", "label"), out.filter("new").select("id", "label")
        if changed.isEmpty():
            break
    else:
        raise RuntimeError(f"min_labels: not done after {most} rounds")
    dropped(e)
    return now


def degrees(edges: DataFrame) -> DataFrame:
    """(id, n_in, n_out, neighbours): distinct neighbours, loops aside."""
    e = edges.select("src", "dst").filter("src <> dst").distinct()
    both = e.select(F.col("src").alias("id"), F.col("dst").alias("other"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(turned(e).select(F.col("src").alias("id"), F.col("dst").alias("other"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"), F.count_distinct("other").alias("neighbours"))


def weighted_pairs(edges: DataFrame) -> DataFrame:
    """(a, b, weight), a < b: undirected pairs with the number of edges between them."""
    e = edges.filter("src <> dst")
    return e.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count(F.lit(1)).alias("weight"))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= n)
