"""Byte-level BPE encoding and decoding over a public rank file.

Texts are cut by the vectorised scan of ``pretokens``; each distinct piece is merged once per worker
(by lowest rank, leftmost first) and kept in a cache of bounded size; a text's ids are its pieces'
ids in order. Token byte offsets are kept, and decoding puts each id's bytes at its offset: ids and
offsets that don't belong together raise an error.

Defined results: null text encodes as the empty text; empty texts have no ids; repeated rows each
give a row; very long texts are one row; of pairs of equal rank the leftmost merges first; an empty table
gives no rows; other columns pass through (an operator's own columns replace any of their name).
"""

from __future__ import annotations

import base64
import functools
import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pretokens
from .common import shipped

RANKS = "byte_bpe_50k.tiktoken"
#: Pieces in each of a worker's two cache generations, and the longest piece that is kept.
CACHE_PIECES, CACHE_CHARS = 300_000, 64
#: Bytes up to which all pairs are looked through for each merge; longer pieces use a heap.
SHORT = 48
NONE = 1 << 40


def vocabulary_path(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merged_short(piece: bytes, rank: dict[bytes, int]) -> tuple[int, ...]:
    """As ``merged``, by looking through all pairs each time."""
    at = list(range(len(piece) + 1))
    pairs = [rank.get(piece[i : i + 2], NONE) for i in range(len(piece) - 1)]
    while pairs and (low := min(pairs)) != NONE:
        i = pairs.index(low)
        del at[i + 1], pairs[i]
        if i:
            pairs[i - 1] = rank.get(piece[at[i - 1] : at[i + 1]], NONE)
        if i < len(pairs):
            pairs[i] = rank.get(piece[at[i] : at[i + 2]], NONE)
    return tuple([rank[piece[a:b]] for a, b in zip(at, at[1:], strict=False)])


def merged(piece: bytes, rank: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one piece: the adjacent pair of lowest rank merges first, the leftmost of equals."""
    whole = rank.get(piece)
    if whole is not None:
        return (whole,)
    n = len(piece)
    if n <= SHORT:
        return merged_short(piece, rank)
    end = list(range(1, n + 1))  # of the part that starts here; 0: no part starts here
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, upto = heapq.heappop(heap)
        mid = end[i]
        if not mid or mid >= n or end[mid] != upto:
            continue
        end[i], end[mid] = upto, 0
        if upto < n:
            before[upto] = i
            r = rank.get(piece[i : end[upto]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[upto]))
        if before[i] >= 0:
            r = rank.get(piece[before[i] : upto])
            if r is not None:
                heapq.heappush(heap, (r, before[i], upto))
    out, i = [], 0
    while i < n:
        out.append(rank[piece[i : end[i]]])
        i = end[i]
    return tuple(out)


class Vocabulary:
    """The bytes of ids: all that decoding needs."""

    def __init__(self, path: str):
        rank = ranks(path)
        self.bytes_of: list[bytes] = [b""] * (max(rank.values()) + 1)
        for token, i in rank.items():
            self.bytes_of[i] = token
        self.sizes = np.array(list(map(len, self.bytes_of)), np.int32)

    def offsets(self, ids) -> np.ndarray:
        """Byte offset of each token's start in the encoded text."""
        ends = np.cumsum(self.sizes[ids], dtype=np.int32)
        return np.concatenate([np.zeros(1, np.int32), ends[:-1]]) if len(ids) else ends

    def decode(self, ids, offsets=None) -> bytes:
        """The text's bytes: each token's at its offset, which must be where the token before ends."""
        if offsets is not None and not np.array_equal(self.offsets(ids), offsets):
            raise ValueError("the offsets are not those of the ids")
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))


class Codec(dict):
    """piece -> ids, filled on first use; a full generation becomes the old one, which replaces the one before."""

    def __init__(self, path: str):
        super().__init__()
        self.old: dict[str, tuple[int, ...]] = {}
        self.rank = ranks(path)

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.old.get(piece)
        if ids is None:
            ids = merged(piece.encode(), self.rank)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [list(chain.from_iterable(map(self.__getitem__, p))) for p in pretokens.pieces(texts)]


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


def _encoder(path: str, text_at: int, names: list[str], own: list[str]):
    def run(batches):
        c, v = codec(path), vocabulary(path)
        for batch in batches:
            at = 0
            for group in pretokens.groups(x.as_py() or "" for x in batch.column(text_at)):  # a batch a group: ids are far larger than texts in memory
                ids = c.encode(group)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.fromiter(chain.from_iterable(ids), np.int32, ends[-1])
                lists = lambda a, ends=ends: pa.ListArray.from_arrays(pa.array(ends), pa.array(a))
                found = {"ids": lists(flat)}
                if len(own) > 1:
                    places = np.concatenate([[0], np.cumsum(v.sizes[flat])]).astype(np.int32)  # of tokens in all of the group's bytes
                    found["offsets"] = lists(places[:-1] - np.repeat(places[ends[:-1]], np.diff(ends)))
                if len(own) > 2:
                    whole = b"".join(map(v.bytes_of.__getitem__, chain.from_iterable(ids)))
                    cuts = places[ends]  # each text's bytes lie between the offsets of its first token and the next text's
                    if "decoded" in own:
                        found["decoded"] = pa.Array.from_buffers(pa.binary(), len(group), [None, pa.py_buffer(cuts), pa.py_buffer(whole)])
                    if "intact" in own:
                        found["intact"] = pa.array([whole[i:j] == t.encode() for i, j, t in zip(cuts[:-1], cuts[1:], group, strict=True)], pa.bool_())
                rows = batch.slice(at, len(group))
                at += len(group)
                yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in range(rows.num_columns)), *(found[o] for o in own)], names=[*names, *own])

    return run


def encode(docs: DataFrame, path: str | None = None, offsets: bool = True, decoded: bool = False, intact: bool = False) -> DataFrame:
    """``docs`` with ids array<int> and, if wanted, offsets array<int> (bytes), decoded (binary: the ids decoded
    by their offsets, in the same pass) and intact (whether that is the text)."""
    shipped(docs.sparkSession)
    types = {"ids": T.ArrayType(T.IntegerType()), "offsets": T.ArrayType(T.IntegerType()), "decoded": T.BinaryType(), "intact": T.BooleanType()}
    own = [n for n, on in (("ids", True), ("offsets", offsets or decoded or intact), ("decoded", decoded), ("intact", intact)) if on]
    docs = docs.drop(*types)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, types[n]) for n in own)])
    return docs.mapInArrow(_encoder(path or vocabulary_path(), docs.columns.index("text"), docs.columns, own), schema)


def _numbers(x: pa.ListScalar) -> np.ndarray:
    return x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0, np.int32)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Rows with ids, and offsets where they are kept -> the same rows with ``decoded`` (binary)."""
    shipped(encoded.sparkSession)
    path = path or vocabulary_path()
    encoded = encoded.drop("decoded")
    at, names = encoded.columns.index("ids"), encoded.columns
    offsets_at = names.index("offsets") if "offsets" in names else None

    def run(batches):
        v = vocabulary(path)
        for whole in batches:
            for lo in range(0, whole.num_rows, 64):
                batch = whole.slice(lo, 64)
                ids = [_numbers(x) for x in batch.column(at)]
                offsets = map(_numbers, batch.column(offsets_at)) if offsets_at is not None else [None] * len(ids)
                out = [v.decode(x, o) for x, o in zip(ids, offsets, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(batch.num_columns)), pa.array(out, pa.binary())], names=[*names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes: encodes with offsets, and decodes by them."""
    d = encode(docs.select("doc_id", "text"), path, decoded=True)
    return d.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.octet_length("decoded").cast("long").alias("n_bytes"),
    )
