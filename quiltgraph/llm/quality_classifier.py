"""Quality classifier: a sparse rule ensemble over text statistics.

Small trees are grown on bootstrap samples of the labelled rows; every path from a root to a node is
a conjunctive rule over the statistics. The rules' weights are a lasso logistic regression, fitted by
proximal gradient steps, and the rules with a weight are compiled into one Spark column expression.

Labels are learnt from a bounded sample, never from held-out rows: of the labels, the MOST_ROWS of
smallest hashed ids, and of the pairs of those labels and texts, the MOST_ROWS of smallest hashed id
and text (the same, unless ids repeat). That is what comes to the driver. Statistics are of whole texts. lang, source,
doc_id and labels are not inputs.

Defined results: null texts score as empty ones; documents without a doc_id are not held out; where
several labels or texts share a doc_id each pair of them is a row; null labels are left out; equal hashes
are taken in order of id, label and text hash; repeated rows score alike; very long texts are one row's
work; without any label every score is 0.5; an empty document table gives no rows; other columns, of any
name, aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_rules import with_statistics

MOST_ROWS = 8_000
TREES, DEPTH, LEAF, LASSO, STEPS = 40, 3, 12, 0.002, 1500
THRESHOLD = 0.3
HOLD_OUT = 5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % HOLD_OUT == 0, F.lit(False))


def features() -> dict[str, Column]:
    """The statistics that rules are about, from the columns of with_statistics."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("n_lines"), F.lit(1)).cast("double")
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": F.col("word_chars") / n,
        "symbols": F.col("n_symbols") / n,
        "repeated_lines": F.col("n_dup_lines") / lines,
        "repeated_words": F.col("n_repeat_words") / n,
        "distinct_words": F.col("n_distinct") / n,
        "words_a_line": F.col("n_words") / lines,
    }


@dataclass(frozen=True)
class Rule:
    """All of (feature, is_above, bound) hold."""

    terms: tuple[tuple[int, bool, float], ...]

    def covers(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, above, bound in self.terms:
            out &= x[:, f] > bound if above else x[:, f] <= bound
        return out

    def column(self, names: list[str]) -> Column:
        out = F.lit(True)
        for f, above, bound in self.terms:
            c = F.col(names[f])
            out = out & (c > bound if above else c <= bound)
        return out


def grown(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> list[Rule]:
    """The rules of one tree: a path for every node but the root."""
    rules: list[Rule] = []
    some = rng.choice(x.shape[1], max(1, (2 * x.shape[1] + 2) // 3), replace=False)

    def split(rows: np.ndarray, terms: tuple) -> None:
        if len(terms) >= DEPTH or len(rows) < 2 * LEAF or y[rows].min() == y[rows].max():
            return
        best = None
        for f in some:
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, t = x[order, f], np.cumsum(y[order])
            k = np.arange(1, len(v))
            ok = (v[1:] > v[:-1]) & (k >= LEAF) & (len(v) - k >= LEAF)
            if not ok.any():
                continue
            p, q = t[:-1] / k, (t[-1] - t[:-1]) / (len(v) - k)
            loss = np.where(ok, k * p * (1 - p) + (len(v) - k) * q * (1 - q), np.inf)
            at = int(loss.argmin())
            if best is None or loss[at] < best[0]:
                best = (loss[at], int(f), float((v[at] + v[at + 1]) / 2))
        if best is None:
            return
        _, f, bound = best
        for above in (False, True):
            side = rows[(x[rows, f] > bound) == above]
            own = (*terms, (f, above, bound))
            rules.append(Rule(own))
            split(side, own)

    split(np.sort(rng.choice(len(x), len(x))), ())
    return rules


@dataclass(frozen=True)
class RuleModel:
    names: tuple[str, ...]
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    bias: float

    def score(self) -> Column:
        """The probability of label 1 as an expression over the feature columns."""
        z = F.lit(self.bias)
        for r, w in zip(self.rules, self.weights, strict=True):
            z = z + F.when(r.column(list(self.names)), F.lit(w)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-z))


def fitted(names: list[str], x: np.ndarray, y: np.ndarray, seed: int = 7) -> RuleModel:
    if not len(y):
        return RuleModel(tuple(names), (), (), 0.0)
    rng = np.random.default_rng(seed)
    rules = list(dict.fromkeys(r for _ in range(TREES) for r in grown(x, y, rng)))
    covers = np.array([r.covers(x) for r in rules], float).T if rules else np.zeros((len(y), 0))
    mean = covers.mean(0)
    a = covers - mean  # centred, so the bias is not shrunk
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w, b = np.zeros(len(rules)), float(np.log(p / (1 - p)))
    rate = 4 / max(1e-9, np.linalg.norm(a, 2) ** 2 / len(y)) if rules else 1.0
    z, t = w.copy(), 1.0
    for _ in range(STEPS if rules else 0):  # accelerated proximal gradient
        g = 1 / (1 + np.exp(-(a @ z + b))) - y
        new = z - rate * (a.T @ g) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * LASSO, 0)
        b -= float(g.mean())
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    on = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleModel(tuple(names), tuple(rules[i] for i in on), tuple(float(w[i]) for i in on), b - float(mean[on] @ w[on]))


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", most: int = MOST_ROWS) -> RuleModel:
    """Learns from labelled rows that aren't held out, ``most`` at most."""
    k = labels.filter(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1) & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("l_id"), F.col(target).cast("int").alias("y"))
    k = k.orderBy(F.md5(F.col("l_id").cast("string")), "l_id", "y").limit(most)
    d = docs.select(F.col("doc_id").alias("d_id"), "text")
    both = d.join(F.broadcast(k), F.col("d_id") == F.col("l_id")).select("text", F.col("d_id").alias("doc_id"), "y")
    f = features()
    stats = with_statistics(both, [F.col("doc_id"), F.col("y"), F.xxhash64("text").alias("text_hash")])
    rows = stats.select("doc_id", "y", "text_hash", *[c.alias(n) for n, c in f.items()])
    rows = rows.orderBy(F.xxhash64("doc_id", "text_hash"), "doc_id", "y", "text_hash").limit(most).toPandas()
    rows = rows.sort_values(["doc_id", "y", "text_hash"], kind="stable")
    return fitted(list(f), rows[list(f)].to_numpy(float), rows["y"].to_numpy(float))


def scored(docs: DataFrame, model: RuleModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    d = with_statistics(docs, [F.col("doc_id")]).select("doc_id", *[c.alias(n) for n, c in features().items()])
    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score")).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def classifier_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, train(docs, labels))
