"""SimHash near-duplicates by multi-index hashing.

A document's fingerprint is the bitwise majority of the XXH64 values (seed 42) of its 3-word
shingles. Fingerprints link at 2 or fewer differing bits.

The 64 bits are two segments of 32, a table each, which holds every fingerprint under its segment. If
two fingerprints differ in 2 bits or less, either the first segments differ in at most 1, or in 2, and
then the second segments are equal. So the first table is probed with the radius-1 ball of a
fingerprint's first segment, the second one with its second segment alone. As a pair one flip apart is
found from its lower side, only flips of zero bits are probed: 18 probes and 2 entries a fingerprint on
average. What a probe meets is a candidate, and its complete distance is verified.

A bucket of over HOT fingerprints (near copies by the thousand share half their bits) is split by the
other segment: its entries stand under each point of the radius-1 ball of the other segment, and what
probes it goes to the points that it can share with an entry. All that meets in such a part is within
2 bits, so each part links to its least entry: no part is paired out, no link between groups is lost.
Buckets and links are over distinct fingerprints.

Defined results: null and empty texts have fingerprint 0 and link like any other; fewer than 3 words
are one shingle; rows with equal doc_id each give a row; null doc_ids are never a component's id
unless it has no other; an empty table gives no rows.

``kept_documents`` (the pipeline's stage) takes near copies, of Jaccard similarity 0.8 or more of 5-word
shingle sets. Fingerprints of these shingles fetch the nearest ones by the same tables and distance, and
exact similarity follows (two bits may be less, where a text repeats itself). Most pairs at 0.8 they can't
fetch: those differ in 10 of 64 bits on average, and up to 17 were seen. So what fingerprints have
not joined goes on to a complete join: under any one order of all shingles,
two sets that similar share one of the first floor(n / 5) + 1 of each, so those prefixes are the keys
under which documents meet. The order puts frequent shingles last. Bounds that lose no pair come
before any set is read: sizes; places under the first shared key; and parity sketches, in which every
shingle of the symmetric difference flips one bit, so that differing bits bound it from below. Sets
are made again from the texts of the few documents that are left, not stored.

A key that more than HOT_SETS sets have is not paired out: sets whose place allows no partner leave it; the
others are held against a few of them (pivots), what is similar to a pivot leaves the key, and only
pairs that the triangle inequality of Jaccard distance allows are tried between what leaves and what
else the key has. Sets are of 64-bit hashes; equal sets are one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, shipped, written

SHINGLE, SEED, DISTANCE = 3, 42, 2
COPY_SHINGLE, TENTHS = 5, 8
#: The second segment's bits, and what marks keys of its table.
SECOND, TABLE = (1 << 32) - 1, 1 << 32
#: Buckets of more fingerprints are split, keys of more sets are taken by pivots; so many pivots a key and round,
#: and a quarter of them where a key has more than MANY sets, so that what is tried stays in proportion to the sets.
HOT, HOT_SETS, PIVOTS, MANY = 64, 160, 8, 1_000
#: Frequent shingles (of one set in SHARE) that are put last in the order, and ids that are broadcast, at most.
FREQUENT, SHARE, BROADCAST_IDS = 100_000, 16, 200_000


def shingle_hashes(text: str | None, width: int, seed: int) -> np.ndarray:
    words = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    shingles = [b" ".join(words)] if len(words) <= width else map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(x, seed) for x in shingles), np.uint64, max(1, len(words) - width + 1))


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    return majority(shingle_hashes(text, width, seed))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half the hashes have, repeats counted."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, text_hash, fp (the fingerprint's bits as a long)."""
    shipped(docs.sparkSession)

    def run(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), width, seed) for t in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, f"doc_id {kind}, text_hash long, fp long")


def probes(fps: DataFrame) -> DataFrame:
    """(key, fp, flips): the buckets that a fingerprint is looked up in; flips is 1 where the first segment has one bit more."""
    first, second = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(SECOND))
    ball = "filter(transform(sequence(0, 31), i -> shiftleft(1L, i)), b -> (shiftrightunsigned(fp, 32) & b) = 0)"
    own = F.array(F.struct(first.alias("key"), F.lit(0).alias("flips")), F.struct(second.bitwiseOR(F.lit(TABLE)).alias("key"), F.lit(0).alias("flips")))
    near = F.expr(f"transform({ball}, b -> struct((shiftrightunsigned(fp, 32) | b) as key, 1 as flips))")
    return fps.select("fp", F.explode(F.concat(own, near)).alias("p")).select("p.key", "fp", "p.flips")


def entries(fps: DataFrame) -> DataFrame:
    """(key, fp): the two tables; keys of the second one have a bit of their own."""
    first, second = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(SECOND))
    return fps.select(F.explode(F.array(first, second.bitwiseOR(F.lit(TABLE)))).alias("key"), "fp")


def _other(key: str = "key") -> str:
    """The segment that isn't the bucket's, as an SQL expression."""
    return f"if({key} >= {TABLE}L, shiftrightunsigned(fp, 32), fp & {SECOND}L)"


def _marked(rows: DataFrame, hot: DataFrame, few: bool) -> DataFrame:
    return rows.join(F.broadcast(hot) if few else hot, "key", "left")


def candidates(probed: DataFrame, table: DataFrame) -> DataFrame:
    """(a, b, distance): what probes meet in the table, a pair once."""
    met = probed.join(table.select("key", F.col("fp").alias("other")), "key").filter("flips = 1 or fp < other")
    return met.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"), F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))).alias("distance"))


def links(fps: DataFrame, distance: int = DISTANCE, hot: int = HOT) -> DataFrame:
    """(a, b), a < b: links between distinct fingerprints that connect all within ``distance``."""
    if distance != 2:
        raise ValueError("two segments and a radius of 1 are laid out for 2 bits")
    table, probed = entries(fps), probes(fps)
    crowded = written(table.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("key", F.lit(True).alias("hot")))
    n = crowded.count()
    if not n:
        return candidates(probed, table).filter(F.col("distance") <= distance).select("a", "b").distinct()
    table, probed = _marked(table, crowded, n <= BROADCAST_IDS), _marked(probed, crowded, n <= BROADCAST_IDS)
    found = candidates(probed.filter("hot is null"), table.filter("hot is null").drop("hot")).filter(F.col("distance") <= distance).select("a", "b")
    point = f"concat(array({_other()}), transform(sequence(0, 31), i -> {_other()} ^ shiftleft(1L, i)))"
    parts = table.filter("hot").select("key", "fp", F.explode(F.expr(point)).alias("point"))
    # an entry of the bucket meets others at the points of its ball; one flip off, at its other segment as it is
    near = probed.filter("hot and flips = 1").select("key", "fp", F.expr(_other()).alias("point"))
    least = parts.groupBy("key", "point").agg(F.min("fp").alias("least"))
    met = parts.unionByName(near).join(least, ["key", "point"]).filter("fp <> least")
    return found.unionByName(met.select(F.least("fp", "least").alias("a"), F.greatest("fp", "least").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of nodes with a link; root: the component's smallest node.

    Alternates large-star and small-star steps until nothing changes. Each step is a join and a
    sum over links; a step's links are written to the shared folder.
    """
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        e = written(small.filter("u > v").distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = e.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame, width: int = SHINGLE, seed: int = SEED, distance: int = DISTANCE) -> DataFrame:
    """doc_id, text_hash, fp, component_id (the smallest doc_id that can be reached over links) and stays
    (whether this row, or one equal to it, is the one that represents the component)."""
    marked = written(fingerprints(docs, width, seed))
    return _represented(marked, lambda fps: links(fps, distance))


def _represented(marked: DataFrame, linked) -> DataFrame:
    """``marked`` (doc_id, text_hash, fp) with component_id and stays; linked: distinct fps -> links (a, b)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    firsts = written(marked.groupBy("fp").agg(first))
    roots = components(linked(firsts.select("fp")))
    ids = firsts.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = written(ids)
    low = ids.groupBy("root").agg(F.min("first").alias("low"))
    named = ids.join(low, "root").select(F.col("fp").alias("n_fp"), "low")
    stays = F.col("doc_id").eqNullSafe(F.col("low.doc_id")) & (F.col("text_hash") == F.col("low.text_hash"))
    return marked.join(named, F.col("fp") == F.col("n_fp"), "left").select("doc_id", "text_hash", "fp", F.col("low.doc_id").alias("component_id"), stays.alias("stays"))


def _set(text: str | None, width: int, seed: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, width, seed).view(np.int64))


def _name(x: np.ndarray, seed: int) -> int:
    h = xxhash.xxh64_intdigest(x.tobytes(), seed)
    return h - (1 << 64) if h >> 63 else h


def parity_sketch(x: np.ndarray) -> np.ndarray:
    """Longs of bits: whether an odd number of hashes has the bit's place as low bits; two bits or more a hash."""
    words = 8
    while words * 32 < len(x):
        words *= 2
    odd = np.bincount((x.view(np.uint64) & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def shingle_sets(docs: DataFrame, width: int = COPY_SHINGLE, seed: int = SEED) -> DataFrame:
    """fp (a hash of the set) and shingles (distinct hashes in order) of each text."""
    shipped(docs.sparkSession)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                sets = [_set(t.as_py(), width, seed) for t in b.column(0)]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([_name(x, seed) for x in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], names=["fp", "shingles"])

    return docs.select("text").mapInArrow(run, "fp long, shingles array<long>")


def frequent_shingles(docs: DataFrame, width: int, hot: int) -> np.ndarray:
    """Ids of shingles that come last in the order. The order is only a matter of speed, so a share of the texts tells."""
    part = shingle_sets(docs.filter(F.pmod(F.xxhash64("text"), F.lit(SHARE)) == 0), width).select(F.explode("shingles").alias("key"))
    often = part.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * SHARE > hot // 3).orderBy(F.col("n").desc(), "key").limit(FREQUENT).collect()
    return np.array(sorted(r.key for r in often), np.int64)


def signatures(docs: DataFrame, last: np.ndarray, width: int = COPY_SHINGLE, tenths: int = TENTHS, seed: int = SEED) -> DataFrame:
    """doc_id, text_hash, fp, bits (the fingerprint), n, sketch and prefix (the shingles of which similar sets share one; ``last`` come last)."""
    shipped(docs.sparkSession)

    def row(text):
        hashes = shingle_hashes(text, width, seed)
        x = order = np.unique(hashes.view(np.int64))
        if len(last) and len(x):
            late = last[np.minimum(np.searchsorted(last, x), len(last) - 1)] == x
            order = np.concatenate([x[~late], x[late]])
        return _name(x, seed), majority(hashes), len(x), parity_sketch(x), order[: len(x) - -(-tenths * len(x) // 10) + 1]

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                fp, bits, n, sketch, prefix = zip(*(row(t.as_py()) for t in b.column(2)), strict=True)
                lists = [pa.array(c, pa.list_(pa.int64())) for c in (sketch, prefix)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp, pa.int64()), pa.array(np.array(bits, np.uint64).view(np.int64)), pa.array(n, pa.int32()), *lists], names=["doc_id", "text_hash", "fp", "bits", "n", "sketch", "prefix"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, f"doc_id {kind}, text_hash long, fp long, bits long, n int, sketch array<long>, prefix array<long>")


def _within_ids(big: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Left semi join that broadcasts ``ids`` (a written table of one column) only up to BROADCAST_IDS rows."""
    return big.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, on, "left_semi")


class Similarity:
    """Similarities of pairs of sets, from sketches and, where those can't rule a pair out, from the texts."""

    def __init__(self, docs: DataFrame, signed: DataFrame, width: int, tenths: int):
        self.docs, self.width, self.tenths = docs, width, tenths
        self.signed = signed.select("fp", "text_hash", "n", "sketch")

    def _of(self, pairs: DataFrame, cols: list[str]) -> DataFrame:
        ids = written(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct())
        out = written(_within_ids(self.signed, ids, "fp").groupBy("fp").agg(*[F.first(c).alias(c) for c in cols]))
        dropped(ids)
        return out

    @staticmethod
    def most_shared(a: str = "a", b: str = "b"):
        """An upper bound of the intersection, from columns n_a, s_a (sketch) and n_b, s_b."""
        x, y = f"s_{a}", f"s_{b}"
        w = f"least(size({x}), size({y}))"
        bits = f"aggregate(sequence(0, {w} - 1), 0, (t, i) -> t + bit_count({{}} ^ {{}}))".format(*(f"if(size({k}) > {w}, {k}[i] ^ {k}[i + {w}], {k}[i])" for k in (x, y)))
        fits = F.expr(f"greatest(size({x}), size({y})) <= 2 * {w}")
        n, m = F.col(f"n_{a}"), F.col(f"n_{b}")
        return F.least(n, m, F.when(fits, F.floor((n + m - F.expr(bits)) / 2)).otherwise(n)).cast("int")

    def sketches(self, d: DataFrame, k: str) -> DataFrame:
        return d.select(F.col("fp").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"s_{k}"))

    def bounded(self, pairs: DataFrame) -> DataFrame:
        """(a, b, same, whole): no pair has a larger intersection and a smaller union; a written table."""
        pairs = written(pairs)
        d = self._of(pairs, ["n", "sketch"])
        both = pairs.join(self.sketches(d, "a"), "a").join(self.sketches(d, "b"), "b").select("a", "b", "n_a", "n_b", self.most_shared().alias("same"))
        out = written(both.select("a", "b", "same", (F.col("n_a") + F.col("n_b") - F.col("same")).alias("whole")))
        dropped(pairs, d)
        return out

    def across(self, taken: DataFrame, edge: DataFrame, salt: int = 8) -> DataFrame:
        """(a, b) that may be similar of taken (p, a, near, s) and edge (p, b, off, s), by the distances to their pivot,
        places, sizes and sketches, all of them conditions of the join: pairs that can't be are not made."""
        taken, edge = written(taken), written(edge)
        ids = written(taken.select(F.col("a").alias("fp")).unionByName(edge.select(F.col("b").alias("fp"))).distinct())
        d = written(_within_ids(self.signed, ids, "fp").groupBy("fp").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")))
        x = taken.join(self.sketches(d, "a"), "a").withColumn("part", F.pmod("a", F.lit(salt)))
        y = edge.join(self.sketches(d, "b"), "b").withColumnRenamed("s", "s2").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salt - 1).cast("long")))).withColumnRenamed("p", "p2").withColumnRenamed("part", "part2")
        same, n, m = self.most_shared(), F.col("n_a"), F.col("n_b")
        cond = (F.col("p") == F.col("p2")) & (F.col("part") == F.col("part2")) & (F.col("a") != F.col("b"))
        cond &= (F.col("near") - F.col("off") <= 1 - self.tenths / 10 + 1e-9) & (F.col("s") + F.col("s2") <= 0)
        cond &= (10 * F.least(n, m) >= self.tenths * F.greatest(n, m)) & (same * 10 >= (n + m - same) * self.tenths)
        out = written(x.join(y, cond).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), n.alias("n"), m.alias("m"), same.alias("same")).groupBy("a", "b").agg(F.first("same").alias("same"), F.first(F.col("n") + F.col("m") - F.col("same")).alias("whole")))
        dropped(taken, edge, ids, d)
        return out

    def good(self, same: str = "same", whole: str = "whole"):
        return F.col(same) * 10 >= F.col(whole) * self.tenths

    def exact(self, bounded: DataFrame) -> DataFrame:
        """``bounded`` with the true same and whole of the pairs that may be similar, and known: whether they are true; a written table."""
        pairs = written(bounded.filter(self.good()).select("a", "b"))
        held = self._of(pairs, ["text_hash"])
        texts = written(held.select("text_hash").distinct())
        docs = _within_ids(self.docs.select("text", F.xxhash64("text").alias("text_hash")), texts, "text_hash").groupBy("text_hash").agg(F.min("text").alias("text"))
        sets = written(shingle_sets(docs, self.width))
        x, y = (sets.select(F.col("fp").alias(k), F.col("shingles").alias(f"x_{k}")) for k in "ab")
        same = F.size(F.array_intersect("x_a", "x_b"))
        true = pairs.join(x, "a").join(y, "b").select("a", "b", same.alias("t_same"), (F.size("x_a") + F.size("x_b") - same).alias("t_whole"))
        out = bounded.join(true, ["a", "b"], "left")
        out = written(out.select("a", "b", F.coalesce("t_same", "same").alias("same"), F.coalesce("t_whole", "whole").alias("whole")))
        dropped(pairs, held, texts, sets)
        return out

    def similar(self, pairs: DataFrame) -> DataFrame:
        """(a, b) of the pairs that are similar."""
        bounded = self.bounded(pairs)
        out = self.exact(bounded.filter(self.good()))
        dropped(bounded)
        return out.filter(self.good()).select("a", "b")


def fingerprint_pairs(signed: DataFrame) -> DataFrame:
    """(a, b), a < b: sets whose fingerprints link, by one set of each fingerprint, and sets of one fingerprint with that one."""
    sets = written(signed.select("bits", "fp").distinct())
    least = written(sets.groupBy("bits").agg(F.min("fp").alias("least")))
    near = links(least.select(F.col("bits").alias("fp")))
    x, y = (least.select(F.col("bits").alias(k), F.col("least").alias(f"fp_{k}")) for k in "ab")
    near = near.join(x, "a").join(y, "b").select(F.least("fp_a", "fp_b").alias("a"), F.greatest("fp_a", "fp_b").alias("b"))
    same = sets.join(least, "bits").filter("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    return near.unionByName(same).filter("a <> b").distinct()


def _apart(pairs: DataFrame, roots: DataFrame, n: int) -> DataFrame:
    """Pairs that ``roots`` (node, root; a written table of n rows) doesn't have in one component."""
    x, y = (roots.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}")) for k in "ab")
    x, y = (F.broadcast(d) if n <= BROADCAST_IDS else d for d in (x, y))
    return pairs.join(x, "a", "left").join(y, "b", "left").filter("root_a is null or root_b is null or root_a <> root_b").select("a", "b")


def _all_pairs(keys: DataFrame, tenths: int) -> DataFrame:
    """(a, b): pairs that meet under a key and can be similar if it is the first in order that they share."""
    other = keys.select("key", F.col("fp").alias("b"), F.col("n").alias("m"), F.col("at").alias("bt"))
    met = keys.select("key", F.col("fp").alias("a"), "n", "at").join(other, "key").filter("a < b")
    return met.filter((10 + tenths) * F.least(F.col("n") - F.col("at"), F.col("m") - F.col("bt")) >= tenths * (F.col("n") + F.col("m"))).select("a", "b").distinct()


def _several(keys: DataFrame) -> DataFrame:
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("sets"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo <> hi").select("key", "sets")


def similar_sets(docs: DataFrame, signed: DataFrame, width: int = COPY_SHINGLE, tenths: int = TENTHS, hot: int = HOT_SETS, pivots: int = PIVOTS) -> DataFrame:
    """(a, b), a < b: links that connect all sets of Jaccard similarity tenths / 10 or more.

    signed: a written table of signatures, one row or more a set. Links that fingerprints fetch come first;
    pairs that these have joined aren't tried again.
    """
    if not 5 < tenths <= 10:
        raise ValueError("similarity must be over 0.5")
    sim = Similarity(docs, signed, width, tenths)
    keys = signed.select("fp", "n", F.posexplode("prefix").alias("at", "key"))
    sizes = written(_several(keys))
    keys = written(keys.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_IDS else sizes, "key").distinct())
    near = written(sim.similar(fingerprint_pairs(signed)))
    roots = written(components(near))
    n_roots = roots.count()
    apart = lambda pairs: _apart(pairs, roots, n_roots) if n_roots else pairs
    found = [near, sim.similar(apart(_all_pairs(keys.filter(F.col("sets") <= hot), tenths)))]
    # the places at_a and at_b of a pair's first shared key allow (10 + t)(at_a + at_b) <= (10 - t)(n_a + n_b) only
    slack = (10 + tenths) * F.col("at") - (10 - tenths) * F.col("n")
    rest = written(keys.filter(F.col("sets") > hot).select("key", "fp", "n", "at", slack.alias("s"), "sets"))
    dropped(keys, sizes)
    far = 2 * tenths - 10  # a set farther from a pivot is linked to nothing that the pivot takes: distances add up
    while not rest.isEmpty():
        least = written(rest.groupBy("key").agg(F.min(F.struct("s", "fp")).alias("least")))
        rest = written(rest.join(least, "key").filter((F.col("s") + F.col("least.s") <= 0) | (F.col("fp") == F.col("least.fp"))).drop("least"))
        left = written(_several(rest))
        few = rest.join(left.filter(F.col("sets") <= hot).select("key"), "key", "left_semi").drop("sets")
        found.append(sim.similar(apart(_all_pairs(few, tenths))))
        rest = written(rest.drop("sets").join(left.filter(F.col("sets") > hot), "key"))
        if rest.isEmpty():
            break
        order = F.row_number().over(Window.partitionBy("key").orderBy("s", "fp"))
        chosen = written(rest.withColumn("r", order).filter(F.col("r") <= F.when(F.col("sets") > MANY, max(1, pivots // 4)).otherwise(pivots)).select("key", F.col("fp").alias("p")))
        tried = rest.join(chosen, "key").filter("fp <> p").select(F.col("p").alias("a"), F.col("fp").alias("b")).distinct()
        s = sim.exact(sim.bounded(tried))
        link = written(s.filter(sim.good()).select("a", "b", (F.col("same") / F.col("whole")).alias("near")))
        found.append(link.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        # what a pivot takes leaves only the keys that they share
        mine = rest.join(chosen, "key").join(link.select(F.col("a").alias("p"), F.col("b").alias("fp"), "near"), ["p", "fp"])
        mine = written(mine.groupBy("key", "fp").agg(F.min(F.struct("p", "near")).alias("t"), F.first("s").alias("s")))
        gone = mine.select("key", "fp").unionByName(chosen.select("key", F.col("p").alias("fp"))).distinct()
        edge = s.filter(~sim.good() & (F.col("same") * 10 >= F.col("whole") * far)).select(F.col("a").alias("p"), F.col("b").alias("y"), (F.col("same") / F.col("whole")).alias("off"))
        tied = link.select(F.col("a").alias("p"), F.col("b").alias("m")).join(link.select(F.col("a").alias("m"), F.col("b").alias("y")), "m").select("p", "y").distinct()
        edge = rest.select("key", F.col("fp").alias("y"), "s").join(chosen, "key").join(edge.join(tied, ["p", "y"], "left_anti"), ["p", "y"])
        # pairs of one pivot are looked at once for all keys, with the places that allow most
        edge = edge.groupBy("p", F.col("y").alias("b")).agg(F.first("off").alias("off"), F.min("s").alias("s"))
        taken = mine.groupBy(F.col("t.p").alias("p"), F.col("fp").alias("a")).agg(F.first("t.near").alias("near"), F.min("s").alias("s"))
        found.append(sim.exact(sim.across(taken, edge)).filter(sim.good()).select("a", "b"))
        rest = written(rest.join(gone, ["key", "fp"], "left_anti"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def near_copies(docs: DataFrame, width: int = COPY_SHINGLE, tenths: int = TENTHS, hot: int = HOT_SETS, pivots: int = PIVOTS) -> DataFrame:
    """As ``near_duplicates``, linked by Jaccard similarity of shingle sets; fp is the set's hash."""
    signed = written(signatures(docs, frequent_shingles(docs, width, hot), width, tenths))
    return _represented(signed.select("doc_id", "text_hash", "fp"), lambda _: similar_sets(docs, signed, width, tenths, hot, pivots))


def kept_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component of near copies: the smallest doc_id (then text hash), its repeats dropped."""
    ids = near_copies(docs).filter("stays").select(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash")).distinct()
    held = docs.select(F.struct(*docs.columns).alias("__row"), F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__hash"))
    alive = held.join(ids, F.col("__hash").eqNullSafe(F.col("k_hash")) & F.col("__id").eqNullSafe(F.col("k_id")), "left_semi")
    at = F.row_number().over(Window.partitionBy("__hash", "__id").orderBy("__hash"))
    return alive.withColumn("__at", at).filter("__at = 1").select("__row.*")


def simhash_report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
