"""Exact top-k search by inner product, with multi-resolution segment bounds.

A vector's segments are described by their means and deviations. For one segment of length l,
q.x <= l * mean(q) * mean(x) + |q - mean(q)| * |x - mean(x)|, so the sum over segments bounds the
score from above (as it bounds the distance |q|^2 + |x|^2 - 2 q.x from below); finer segments tighten
it. Pairs are ruled out one by one, coarse to fine: a pair stays alive while its bound reaches the
query's k-th best score so far, a level looks only at queries and candidates that have a pair alive,
and only pairs alive after the finest level are scored. The k-th best score starts from a seed: the
scores against SEEDS vectors (those of smallest hashed ids), which any final score must reach, so
tasks prune from their first row. ``survivors`` tells how many pairs each level leaves.

Queries come to the driver in blocks of at most BLOCK_BYTES, one block at a time; a block is one pass
over the candidates, in which each vector read meets all of the block's queries, so that a pass is
bound by arithmetic and not by reading. A task keeps k rows a query; (score, vec_id) ranks them.

Sums are exact in double precision for vectors of norms up to LIMIT; pairs with a longer one are
scored in whole numbers of any size, and a score beyond the range of a long is ranked by its exact
value and returned as the nearest long.

Defined results: vectors that are null, empty, or hold null or non-finite components (after scaling)
take no part, nor do rows without vec_id; only vectors of equal length meet; ties go to the smaller
vec_id; rows that repeat a vec_id are candidates one by one, and a query's own id never is; repeated
query rows that are equal count once; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shipped, written

#: Bytes of a block of queries, vectors that seed the scores, and rows of candidates that are looked at together.
BLOCK_BYTES, SEEDS, ROWS = 8 << 20, 4096, 512
#: Segments of a level; the finest has segments of two components.
LEVELS = (1, 4, 16)
#: Products of vectors up to this norm are sums below 2**52.
LIMIT = float(1 << 26)
LONG = (1 << 63) - 1
#: Pairs are scored one by one if at most this share of a block's is alive.
SPARSE = 0.1


def levels(size: int) -> list[int]:
    """Numbers of segments, coarse to fine."""
    return [p for p in dict.fromkeys((*LEVELS, size // 2)) if 0 < p < size]


def segments(x: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Means times sqrt(length), and norms of what is left, of each segment of each row."""
    cuts = np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1).astype(int)
    size = np.diff(cuts)
    sums = np.add.reduceat(x, cuts[:-1], axis=1)
    squares = np.add.reduceat(x * x, cuts[:-1], axis=1)
    mean = sums / np.sqrt(size)
    return mean, np.sqrt(np.maximum(squares - mean * mean, 0))


def _long(x: np.ndarray) -> np.ndarray:
    """Which rows are too long for exact sums in double precision."""
    with np.errstate(over="ignore"):
        return ~(np.sqrt((x * x).sum(1)) <= LIMIT)


class Search:
    """The k best of each query among the candidates seen so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, least: np.ndarray | None = None):
        big = _long(vectors)
        self.ids, self.q, self.k = ids[~big], vectors[~big], k
        self.levels = levels(vectors.shape[1])
        self.bounds = [np.hstack(segments(self.q, p)) for p in self.levels]
        self.score = np.full((len(self.ids), k), -np.inf)
        self.found = np.zeros((len(self.ids), k), np.int64)
        self.seed = np.full(len(self.ids), -np.inf) if least is None else least[~big]
        self.alive = np.zeros(2 + len(self.levels), np.int64)  # pairs met, alive after each level, reaching the best
        #: queries in whole numbers, and what is best of pairs with a long vector: (score, -id)
        self.whole = [(int(i), [int(c) for c in v]) for i, v in zip(ids[big], vectors[big], strict=True)]
        self.far: dict[tuple, list] = {}

    def least(self) -> np.ndarray:
        return np.maximum(self.score[:, -1], self.seed)

    def _exactly(self, queries: list, key: str, ids: np.ndarray, x: np.ndarray) -> None:
        for i, v in zip(ids.tolist(), x.tolist(), strict=True):
            v = [int(c) for c in v]
            for at, (own, q) in enumerate(queries):
                if own != i:
                    held = self.far.setdefault((key, at), [])
                    new = (sum(a * b for a, b in zip(q, v, strict=True)), -i)
                    if len(held) < self.k:
                        heapq.heappush(held, new)
                    elif new > held[0]:
                        heapq.heapreplace(held, new)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        big = _long(x)
        if self.whole:
            self._exactly(self.whole, "whole", ids, x)
        if big.any():
            self._exactly([(int(i), [int(c) for c in v]) for i, v in zip(self.ids, self.q, strict=True)], "near", ids[big], x[big])
            ids, x = ids[~big], x[~big]
        if not len(ids) or not len(self.ids):
            return
        alive = self.ids[:, None] != ids
        self.alive[0] += alive.sum()
        least = self.least()
        rows, cols = np.arange(len(self.ids)), np.arange(len(ids))
        for k, (p, q) in enumerate(zip(self.levels, self.bounds, strict=True), 1):
            bound = q[rows] @ np.hstack(segments(x[cols], p)).T
            alive = alive & (bound * (1 + 1e-9) + 1 >= least[rows, None])
            self.alive[k] += alive.sum()
            some, one = alive.any(1), alive.any(0)
            rows, cols, alive = rows[some], cols[one], alive[some][:, one]
            if not len(rows):
                return
        if alive.mean() > SPARSE:
            score = np.where(alive, self.q[rows] @ x[cols].T, -np.inf)
        else:
            i, j = np.nonzero(alive)
            score = np.full(alive.shape, -np.inf)
            for at in range(0, len(i), 1 << 14):
                a, b = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
                score[a, b] = np.einsum("ij,ij->i", self.q[rows[a]], x[cols[b]])
        good = score >= least[rows, None]
        self.alive[-1] += good.sum()
        some = good.any(1)
        one = good.any(0)
        rows, score, new = rows[some], np.where(good, score, -np.inf)[some][:, one], ids[cols[one]]
        score = np.hstack([self.score[rows], score])
        found = np.hstack([self.found[rows], np.broadcast_to(new, (len(rows), len(new)))])
        order = np.lexsort((found, -score), axis=1)[:, : self.k]
        self.score[rows] = np.take_along_axis(score, order, 1)
        self.found[rows] = np.take_along_axis(found, order, 1)

    def rows(self):
        """(query_id, vec_id, exact score)."""
        for i, q in enumerate(self.ids.tolist()):
            for s, v in zip(self.score[i], self.found[i].tolist(), strict=True):
                if s > -np.inf:
                    yield q, v, int(s)
        for (key, at), held in self.far.items():
            q = int(self.ids[at]) if key == "near" else self.whole[at][0]
            for s, v in held:
                yield q, -v, s


def _beyond(score: int) -> str | None:
    """A text that orders scores beyond a long, among those of one sign."""
    if -LONG < score < LONG:
        return None
    digits = str(abs(score))
    text = f"{len(digits):06d}{digits}"
    return text if score > 0 else text.translate(str.maketrans("0123456789", "9876543210"))


def whole_vectors(table: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """id, v array<double> of whole numbers floor(scale * x); rows that take no part are left out."""

    def whole(c):
        y = c.cast("double") * scale
        return F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)  # larger doubles are whole

    ok = F.forall(vector_col, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double") * scale) < float("inf")))
    good = F.when(F.col(id_col).isNotNull() & (F.size(vector_col) > 0) & ok, True).otherwise(False)
    return table.filter(good).select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col), whole).alias("v"))


def _by_size(rows: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    held: dict[int, list] = {}
    for r in rows:
        held.setdefault(len(r.v), []).append(r)
    return {d: (np.array([r.id for r in g]), np.array([r.v for r in g], float)) for d, g in held.items()}


def _seeded(queries: dict, seeds: dict, k: int) -> dict:
    """size -> (ids, vectors, the k-th best score of each query among the seeds)."""
    out = {}
    for d, (ids, v) in queries.items():
        s = Search(ids, v, k)
        least = np.full(len(ids), -np.inf)
        if d in seeds and len(s.ids):
            for lo in range(0, len(seeds[d][0]), ROWS):
                x = seeds[d][1][lo : lo + ROWS]
                near = ~_long(x)
                s.add(seeds[d][0][lo : lo + ROWS][near], x[near])
            least[~_long(v)] = s.score[:, -1]
        out[d] = (ids, v, least)
    return out


def _blocks(rows, limit: int):
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 8 * len(r.v) + 8
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def _searched(vectors: DataFrame, block: list, seeds: dict, k: int, survivors: bool):
    """The block's broadcast and its pass: rows of the best, or counts of pairs alive by level."""
    held = vectors.sparkSession.sparkContext.broadcast(_seeded(_by_size(block), seeds, k))

    def run(parts):
        search = {d: Search(i, v, k, least) for d, (i, v, least) in held.value.items()}
        for b in parts:
            ids, v = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            flat, off = v.flatten().to_numpy(zero_copy_only=False), v.offsets.to_numpy()
            off = off - off[0]
            sizes = np.diff(off)
            for d in np.unique(sizes):
                if d not in search:
                    continue
                at = np.flatnonzero(sizes == d)
                for lo in range(0, len(at), ROWS):
                    some = at[lo : lo + ROWS]
                    search[d].add(ids[some], flat[(off[some][:, None] + np.arange(d)).ravel()].reshape(len(some), d))
        if survivors:
            rows = [(d, k, int(n)) for d, s in search.items() for k, n in enumerate(s.alive)]
            cols, names, kinds = list(zip(*rows, strict=True)) or [()] * 3, ["size", "level", "pairs"], [pa.int32(), pa.int32(), pa.int64()]
        else:
            rows = [(q, i, max(-LONG, min(LONG, n)), _beyond(n)) for s in search.values() for q, i, n in s.rows()]
            cols, names, kinds = list(zip(*rows, strict=True)) or [()] * 4, ["query_id", "vec_id", "score", "beyond"], [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return held, vectors.mapInArrow(run, "size int, level int, pairs long" if survivors else "query_id long, vec_id long, score long, beyond string")


def _passes(vectors: DataFrame, queries: DataFrame, k: int, block_bytes: int, survivors: bool, fold):
    """All blocks' rows, folded 16 passes at a time into written tables, whose broadcasts are dropped then."""
    shipped(vectors.sparkSession)
    seeds = _by_size(vectors.orderBy(F.xxhash64("id"), "id").limit(SEEDS).collect())
    found, held = [], []
    for block in _blocks(queries.distinct().toLocalIterator(), block_bytes):
        b, rows = _searched(vectors, block, seeds, k, survivors)
        held.append(b)
        found.append(rows)
        if len(held) == 16:
            found = [written(fold(found))]
            for b in held:
                b.destroy()
            held = []
    return found


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score for each query (id, v) over all of vectors (id, v)."""
    found = _passes(vectors, queries, k, block_bytes, False, lambda f: _best(f, k).drop("rank"))
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return _best(found, k).select("query_id", "rank", "vec_id", "score")


def survivors(vectors: DataFrame, queries: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """size, level, pairs: (query, candidate) pairs met (level 0), alive after each level, and of scores that reach the best so far (last)."""
    total = lambda f: _union(f).groupBy("size", "level").agg(F.sum("pairs").alias("pairs"))
    found = _passes(vectors, queries, k, block_bytes, True, total)
    return total(found) if found else vectors.sparkSession.createDataFrame([], "size int, level int, pairs long")


def _union(found: list[DataFrame]) -> DataFrame:
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _best(found: list[DataFrame], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("beyond").desc_nulls_last(), "vec_id"))
    return _union(found).withColumn("rank", rank).filter(F.col("rank") <= k)


def topk_report(embeddings: DataFrame, every: int = 100, k: int = 10, scale: float = 1024.0) -> DataFrame:
    v = whole_vectors(embeddings, "vec_id", "embedding", scale)
    return top_k(v, v.filter(F.col("id") % every == 0), k)


ORACLE = """
WITH e AS (SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s) WHERE rank <= 10"""
