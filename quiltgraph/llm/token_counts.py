"""Token counts under a unigram model: trie-shared dynamic programming.

Distinct pre-tokens are inserted in a trie. A node carries the best forward score of its prefix
(best segmentation into vocabulary pieces) and that segmentation's number of tokens, computed once
for all pre-tokens below it; terminal nodes thus hold the counts. A text's count is the sum over
its pre-tokens.

The unigram model is a Zipf-Mandelbrot law over a public vocabulary in order of rank: a piece of rank r
has probability 1 / ((r + 2) Z), where Z makes all of them sum to 1. Nothing is trained, as tokenizers
aren't. Scores are log probabilities in integers of 2**-16; every single byte is a piece, so every
pre-token has a segmentation. Equal scores go to fewer tokens.

Defined results: null and empty texts have 0 pre-tokens and 0 tokens; repeated rows each give a row;
pre-tokens over LONG bytes, and so very long unbroken texts, are scored on their own, along prefixes of
pieces; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import functools
import math

import pyarrow as pa
from pyspark.sql import DataFrame

from . import pretokens
from .byte_bpe import ranks, vocabulary_path
from .common import shipped

#: Nodes of a worker's trie before it starts again, and pre-tokens in each of two generations of counts.
NODES, KEPT = 1_500_000, 600_000
#: Longer pre-tokens are scored on their own, so that one text can't fill the trie.
LONG = 256


#: A value is a score and a number of tokens in one integer: score * 2**32 - tokens.
TOKEN_BITS = 32


@functools.cache
def scores(path: str) -> tuple[dict[bytes, int], int]:
    whole = math.log(math.fsum(1 / (r + 2) for r in ranks(path).values()))
    s = {t: (-round(65536 * (math.log(r + 2) + whole)) << TOKEN_BITS) - 1 for t, r in ranks(path).items()}
    return s, max(map(len, s))


@functools.cache
def beginnings(path: str) -> frozenset[bytes]:
    """All prefixes of pieces."""
    return frozenset(t[:k] for t in ranks(path) for k in range(1, len(t) + 1))


def whole_value(word: bytes, path: str) -> int:
    """The value of a long pre-token: from each place, pieces are followed as far as any begins so."""
    score, prefixes = scores(path)[0], beginnings(path)
    none = -1 << 200
    values = [0] + [none] * len(word)
    for i, value in enumerate(values):
        for j in range(i + 1, len(word) + 1):
            piece = word[i:j]
            if piece not in prefixes:
                break
            s = score.get(piece)
            if s is not None and value + s > values[j]:
                values[j] = value + s
    return values[-1]


def best_value(word: bytes, j: int, values: list[int], score: dict[bytes, int], longest: int) -> int:
    """The value of word[:j] from the values of its shorter prefixes."""
    get = score.get
    return max([values[i] + s for i in range(j - longest if j > longest else 0, j) if (s := get(word[i:j])) is not None])


class Trie:
    """Nodes are indices; node 0 is the empty prefix. children: (node << 8 | byte) -> node."""

    def __init__(self, path: str):
        self.path = path
        self.score, self.longest = scores(path)
        self.counts: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.children: dict[int, int] = {}
        self.values = [0]

    def count(self, piece: str) -> int:
        """Tokens of a pre-token: from its terminal node, found or inserted."""
        known = self.counts.get(piece)
        if known is not None:
            return known
        n = self.old.get(piece)
        if n is None:
            n = -self.insert(piece.encode()) & ((1 << TOKEN_BITS) - 1)
        if len(piece) <= LONG:
            if len(self.counts) >= KEPT:
                self.old, self.counts = self.counts, {}
            self.counts[piece] = n
        return n

    def insert(self, word: bytes) -> int:
        if len(word) > LONG:
            return whole_value(word, self.path)
        score, longest, path = self.score, self.longest, [0]
        if len(self.values) > NODES:
            self.clear()
        node, children, values = 0, self.children, self.values
        for j, byte in enumerate(word, 1):
            key = node << 8 | byte
            node = children.get(key)
            if node is None:
                node = children[key] = len(values)
                values.append(best_value(word, j, path, score, longest))
            path.append(values[node])
        return path[-1]


@functools.cache
def trie(path: str) -> Trie:
    return Trie(path)


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_pretokens, n_tokens of each row's whole text."""
    shipped(docs.sparkSession)
    path = path or vocabulary_path()

    def run(batches):
        t = trie(path)
        for batch in batches:
            n, k = [], []
            for group in pretokens.groups(x or "" for x in batch.column(1).to_pylist()):
                cut = pretokens.pieces(group)
                for piece in sorted({p for ps in cut for p in ps}.difference(t.counts)):  # neighbours share prefixes
                    t.count(piece)
                for ps in cut:
                    n.append(len(ps))
                    k.append(sum(map(t.count, ps)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(k, pa.int64())], names=["doc_id", "n_pretokens", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_pretokens long, n_tokens long")
