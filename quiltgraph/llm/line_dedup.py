"""Line dedup: a segment-partition edit join over the distinct lines of all documents.

Lines of at least LEAST_WORDS words or LEAST_CHARS characters are compared. Two lines of LEAST_CHARS or
more link when their edit distance is 1 or less; shorter ones only if they are equal. A line is split in threshold + 1 = 2 segments; lines that link have one segment in common,
at the same place or one off, so each line is looked up under its own two segments and under the
one that a line shorter by one would have (the other such probe equals one of its own). Lookups are
by segment number and substring, whose length is fixed by the line's; lengths are checked again when
a pair is verified by banded bit-parallel edit distance.

A segment shared by more than HOT lines is not paired out: what is left of those lines must be
within one edit, so they meet again under the hashes of the rest without one character (or whole),
where groups stay as small as the links themselves. No pair is lost either way.

With ``share``, lines of 2 * share characters or more link at one edit for each ``share`` characters of the
shorter. Segments at fixed places would have to be probed at all shifts, some k^3 rows a line for k edits. So
the segments are chosen by content: k edits leave a run in common that is at least as long as a window of
grams, and the gram of least hash in that window is chosen in both lines, wherever it stands. Grams of more
than HOT lines meet again by length class and place, two of each, which differ by k at most. Exact, too.
The keys are looked up in passes, each of about PASS_CHARS characters' rows, so that disk is bounded.

Of each line, all occurrences but the first go; so do all occurrences of a line that links to one
whose first occurrence is earlier. First is by doc_id (nulls last), then text hash, then line number.

A line that many documents share is one row among the marks; the occurrences of lines of more than
COMMON are not dealt out by line, but meet their marks by broadcast, or by salted keys where those are many.

Defined results: null text stays null; lines of fewer words and characters, empty ones included, always
stay; very long texts are one row; a document that loses all its lines has the empty text
(``deduplicated`` leaves it out); rows that repeat a doc_id and text are one document and keep the same
lines; an empty table gives no rows; other columns, of any name, pass through.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, dropped, joined_small, shipped, written

THRESHOLD, LEAST_CHARS, LEAST_WORDS, HOT = 1, 30, 3, 48
#: Sets of hashes up to this size are broadcast.
BROADCAST_IDS = 200_000
#: Occurrences of lines that have more are joined to their marks without a shuffle by line.
COMMON = 2_000
#: One edit for so many characters, where the threshold follows length, and characters of distinct lines whose grams make a pass.
SHARE, PASS_CHARS = 32, 60_000_000


def within(a: str, b: str, k: int) -> bool:
    """Whether the edit distance is at most k: a band of 2k+1 diagonals, as bits of one integer per error."""
    if abs(len(a) - len(b)) > k:
        return False
    lo, most = 0, min(len(a), len(b))
    step = 64
    while lo < most and a[lo : lo + step] == b[lo : lo + step]:
        lo += step
    lo = min(lo, most)
    while lo < most and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < most - lo and a[-1 - hi : len(a) - hi] == b[-1 - hi : len(b) - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if max(len(a), len(b)) <= k:
        return True
    places: dict[str, int] = {}
    for i, c in enumerate(a, 1):
        places[c] = places.get(c, 0) | 1 << i
    now = [(2 << e) - 1 for e in range(k + 1)]  # bit i: a[:i] is within e edits of what was read of b
    for j, c in enumerate(b, 1):
        band = ((1 << (2 * k + 1)) - 1) << j - k if j >= k else (1 << (j + k + 1)) - 1
        eq = places.get(c, 0)
        last = 0
        new = []
        for e in range(k + 1):
            x = (now[e] << 1) & eq
            if e:
                x |= now[e - 1] | now[e - 1] << 1 | last << 1
            if e >= j:
                x |= 1
            last = x & band
            new.append(last)
        now = new
        if not now[k]:
            return False
    return bool(now[k] >> len(a) & 1)


def _identity(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("second"), line).alias("h2")]


def _lines(docs: DataFrame) -> DataFrame:
    d = docs.select("doc_id", "text").filter("text is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return d.filter(compared(F.col("line")))


def compared(line: Column) -> Column:
    return (F.char_length(line) >= LEAST_CHARS) | (F.regexp_count(line, F.lit(WORD)) >= LEAST_WORDS)


def _spans(n: Column) -> list[tuple[Column, Column, int]]:
    """(start from 1, length, segment number) of what a line of n characters is looked up under."""
    half = F.floor(n / 2).cast("int")
    even = n % 2 == 0
    one = F.lit(1)
    return [
        (one, half, 1),  # own segments
        (half + 1, n - half, 2),
        (F.when(even, one).otherwise(half + 2), F.when(even, half - 1).otherwise(n - half - 1), 0),  # as for n - 1
    ]


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, line_no, h1, h2 and the lookup keys k0, k1, k2 (null for short lines) of every compared line."""
    n = F.char_length("line")
    keys = []
    for i, (start, size, number) in enumerate(_spans(n)):
        number = F.lit(number) if number else F.when(n % 2 == 0, 1).otherwise(2)
        keys.append(F.when(n >= LEAST_CHARS, F.xxhash64(number, F.substring(F.col("line"), start, size))).alias(f"k{i}"))
    return _lines(docs).select("doc_id", "text_hash", F.col("line_no").cast("long").alias("line_no"), *_identity(F.col("line")), *keys)


def _within_ids(big: DataFrame, ids: DataFrame, on: str, known: int | None = None) -> DataFrame:
    """Left semi join that broadcasts ``ids`` (a written table of one column) only up to BROADCAST_IDS rows."""
    n = ids.count() if known is None else known
    return big.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, on, "left_semi")


def _several(rows: DataFrame, key: str) -> DataFrame:
    """Distinct (key, ...) rows whose key has two ids or more; sums meet before the shuffle."""
    keys = written(rows.groupBy(key).agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).filter("lo <> hi").select(key))
    return _within_ids(rows, keys, key).distinct()


def _variants(rows: DataFrame) -> DataFrame:
    """(key, start, size, h1, line) of hot keys -> (key, h1): the rest of the line whole and without each character."""
    shipped(rows.sparkSession)

    def run(batches):
        r = np.uint64(0x9E3779B97F4A7C15)
        back = np.uint64(pow(int(r), -1, 1 << 64))
        with np.errstate(over="ignore"):
            for b in batches:
                for key, start, size, h1, line in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                    rest = line[: start - 1] + line[start - 1 + size :]
                    c = np.frombuffer(rest.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
                    power = np.cumprod(np.full(len(c) + 1, r, np.uint64))
                    h = np.concatenate([np.zeros(1, np.uint64), np.cumsum(c * power[:-1], dtype=np.uint64)])
                    less = h[:-1] + (h[-1] - h[1:]) * back
                    all_h = np.unique(np.concatenate([less, h[-1:]])) ^ np.uint64(key & ((1 << 64) - 1)) * r
                    for at in range(0, len(all_h), 1 << 16):
                        part = all_h[at : at + (1 << 16)].view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), h1, np.int64))], names=["key", "h1"])

    return rows.mapInArrow(run, "key long, h1 long")


def _pairs(members: DataFrame) -> DataFrame:
    other = members.select(F.col("key"), F.col("h1").alias("b1"))
    return members.select("key", F.col("h1").alias("a1")).join(other, "key").filter("a1 < b1").select("a1", "b1")


def _verified(pairs: DataFrame, k: int, share: int | None = None) -> DataFrame:
    shipped(pairs.sparkSession)

    def run(batches):
        for b in batches:
            good = [within(x, y, min(len(x), len(y)) // share if share else k) for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)]
            yield b.select([0, 1, 2, 3]).filter(pa.array(good, pa.bool_()))

    return pairs.mapInArrow(run, "a1 long, a2 long, b1 long, b2 long")


def _slid(op, x: np.ndarray, width: int) -> np.ndarray:
    """op over x[i : i + width] for each i."""
    size = 1
    while size < width:
        step = min(size, width - size)
        x, size = op(x[:-step], x[step:]), size + step
    return x


def _grams(lines: DataFrame, gram: int, window: int, part: int, parts: int) -> DataFrame:
    """(h1, line) -> (key, h1, n, place): each window's gram of least hash, those keys that are ``part`` modulo ``parts``.

    Lines must have gram + window - 1 characters or more.
    """
    shipped(lines.sparkSession)

    def run(batches):
        r = np.uint64(0x9E3779B97F4A7C15)
        back = np.uint64(pow(int(r), -1, 1 << 64))
        with np.errstate(over="ignore"):
            for b in batches:
                if not b.num_rows:
                    continue
                c = np.frombuffer("".join(b.column(1).to_pylist()).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
                n = pc.utf8_length(b.column(1)).to_numpy().astype(np.int64)
                line = np.repeat(np.arange(len(n)), n)
                place = np.arange(len(c)) - np.repeat(np.cumsum(n) - n, n)
                power = np.cumprod(np.full(len(c), r, np.uint64))
                h = np.concatenate([np.zeros(1, np.uint64), np.cumsum(c * power, dtype=np.uint64)])
                h = (h[gram:] - h[:-gram]) * np.cumprod(np.full(len(h) - gram, back, np.uint64))
                h ^= h >> np.uint64(29)
                h *= np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ h >> np.uint64(32)) | np.uint64(1)
                least = _slid(np.minimum, h, window)
                least[place[: len(least)] + gram + window - 1 > n[line[: len(least)]]] = 0  # a window of two lines
                edge = np.zeros(window - 1, np.uint64)
                at = np.flatnonzero((_slid(np.maximum, np.concatenate([edge, least, edge]), window) == h) & ((h >> np.uint64(1)) % np.uint64(parts) == part))
                own = line[at]
                out = [pa.array(h[at].view(np.int64)), b.column(0).take(pa.array(own)), pa.array(n[own].astype(np.int32)), pa.array(place[at].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(out, names=["key", "h1", "n", "place"])

    return lines.select("h1", "line").mapInArrow(run, "key long, h1 long, n int, place int")


def _met(members: DataFrame, share: int) -> DataFrame:
    """(a1, b1) of lines with a key in common whose lengths, and the key's places, differ by no more than they may."""
    a, b = (members.select("key", *[F.col(c).alias(x + c) for c in ("h1", "n", "place")]) for x in "ab")
    k = F.floor(F.least("an", "bn") / share)
    near = (F.abs(F.col("an") - F.col("bn")) <= k) & (F.abs(F.col("aplace") - F.col("bplace")) <= k)
    return a.join(b, "key").filter((F.col("ah1") < F.col("bh1")) & near).select(F.col("ah1").alias("a1"), F.col("bh1").alias("b1"))


def _by_length_and_place(members: DataFrame, share: int) -> DataFrame:
    """Rows under the keys of two length classes and, in each, two places; lines that may link have one in common."""
    base = math.log1p(1 / share) * 1.001  # wider than a class need be, for rounding
    both = lambda c: F.explode(F.array(c, c + 1))
    d = members.select("*", both(F.floor(F.log("n") / base)).alias("size"))
    width = F.floor(F.exp((F.col("size") + 1) * base) / share) + 2
    d = d.select("*", both(F.floor(F.col("place") / width)).alias("cell"))
    return d.select(F.xxhash64("key", "size", "cell").alias("key"), "h1", "n", "place")


def _long_links(docs: DataFrame, share: int) -> DataFrame:
    """As ``line_links``, of lines of 2 * share characters or more at one edit for each ``share`` characters of the shorter."""
    run = -(-2 * (share - 1) // 3)  # least run that two lines have in common: 2 edits in 2 * share characters; more for longer lines
    gram = -(-2 * run // 3)
    window = run - gram + 1
    lines = _lines(docs).filter(F.char_length("line") >= 2 * share).select(*_identity(F.col("line")), "line")
    texts = written(lines.groupBy("h1", "h2").agg(F.min("line").alias("line")))
    parts = 1 + (texts.agg(F.sum(F.char_length("line"))).first()[0] or 0) // PASS_CHARS
    found = []
    for part in range(parts):
        rows = _grams(texts, gram, window, part, parts)
        keys = written(rows.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi"), F.count(F.lit(1)).alias("m")).filter("lo <> hi").select("key", "m"))
        members = written(_within_ids(rows, keys.select("key"), "key"))
        hot = written(keys.filter(F.col("m") > HOT).select("key"))
        n_hot = hot.count()
        pairs = _met(members.join(F.broadcast(hot) if n_hot <= BROADCAST_IDS else hot, "key", "left_anti"), share)
        if n_hot:
            pairs = pairs.unionByName(_met(_by_length_and_place(_within_ids(members, hot, "key", n_hot), share), share))
        found.append(written(pairs.distinct()))
        dropped(keys, members, hot)
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    a = texts.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("line").alias("a"))
    b = texts.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("line").alias("b"))
    out = written(_verified(pairs.distinct().join(a, "a1").join(b, "b1").select("a1", "a2", "b1", "b2", "a", "b"), 0, share))
    dropped(texts, *found)
    return out


def line_links(docs: DataFrame, occ: DataFrame, threshold: int = THRESHOLD, share: int | None = None) -> DataFrame:
    """(a1, a2, b1, b2): pairs of different lines, by their two hashes, within the edit threshold; a written table.

    With ``share`` also those within one edit for each ``share`` characters of the shorter line.
    """
    if threshold != 1:
        raise ValueError("the lookups are laid out for a threshold of 1")
    rows = occ.select("h1", F.explode(F.array(*[F.struct(F.lit(i).alias("which"), F.col(f"k{i}").alias("key")) for i in range(3)])).alias("s")).select("h1", "s.key", "s.which").filter("key is not null")
    members = written(_several(rows, "key"))
    sizes = members.groupBy("key").agg(F.count_distinct("h1").alias("n"))
    hot = written(sizes.filter(F.col("n") > HOT).select("key"))
    n_hot = hot.count()
    ids = written(members.select("h1").distinct())
    lines = _lines(docs).select(*_identity(F.col("line")), "line")
    texts = written(_within_ids(lines, ids, "h1").groupBy("h1", "h2").agg(F.min("line").alias("line")))
    cold = members.join(F.broadcast(hot) if n_hot <= BROADCAST_IDS else hot, "key", "left_anti")
    pairs = _pairs(cold.select("key", "h1").distinct())
    if n_hot:
        n = F.char_length("line")
        spans = _spans(n)
        pick = lambda part: F.when(F.col("which") == 0, spans[0][part]).when(F.col("which") == 1, spans[1][part]).otherwise(spans[2][part])
        many = _within_ids(members, hot, "key", n_hot).join(texts.select("h1", "line"), "h1")
        again = written(_variants(many.select("key", pick(0).cast("int").alias("start"), pick(1).cast("int").alias("size"), "h1", "line")))
        pairs = pairs.unionByName(_pairs(_several(again, "key")))
    pairs = pairs.distinct()
    a = texts.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("line").alias("a"))
    b = texts.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("line").alias("b"))
    out = written(_verified(pairs.join(a, "a1").join(b, "b1").select("a1", "a2", "b1", "b2", "a", "b"), threshold))
    dropped(members, hot, ids, texts)
    return out if share is None else written(out.unionByName(_long_links(docs, share)).distinct())


def _to_marks(occ: DataFrame, marks: DataFrame) -> DataFrame:
    """Left join of occurrences to the marks of their lines; common lines are kept apart from the shuffle."""
    on = (F.col("h1") == F.col("m1")) & (F.col("h2") == F.col("m2"))
    common = written(marks.filter(F.col("n") > COMMON))
    n = common.count()
    if not n:
        return occ.join(marks, on, "left")
    if n <= BROADCAST_IDS:
        often, rest = occ.join(F.broadcast(common), on), occ.join(F.broadcast(common), on, "left_anti")
    else:
        both = joined_small(occ, common, [("h1", "m1"), ("h2", "m2")])
        often, rest = both.filter("m1 is not null"), both.filter("m1 is null").select(*occ.columns)
    return often.unionByName(rest.join(marks.filter(F.col("n") <= COMMON), on, "left"))


def removals(docs: DataFrame, threshold: int = THRESHOLD, share: int | None = None) -> DataFrame:
    """doc_id, text_hash, n_compared, n_links, removed (line numbers) of documents with compared lines; a written table."""
    occ = written(occurrences(docs))
    links = line_links(docs, occ, threshold, share)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "line_no")
    classes = written(occ.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")))
    both = links.unionByName(links.select(F.col("b1").alias("a1"), F.col("b2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2")))
    own = classes.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("first").alias("a_first"))
    their = classes.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("first").alias("b_first"))
    linked = both.join(own, ["a1", "a2"]).join(their, ["b1", "b2"]).groupBy("a1", "a2").agg(F.count(F.lit(1)).alias("links"), F.max(F.col("b_first") < F.col("a_first")).alias("late"))
    marks = classes.join(linked, (F.col("h1") == F.col("a1")) & (F.col("h2") == F.col("a2")), "left").filter("n > 1 or links is not null")
    marks = written(marks.select(F.col("h1").alias("m1"), F.col("h2").alias("m2"), "first", "links", "late", "n"))
    d = _to_marks(occ.select("doc_id", "text_hash", "line_no", "h1", "h2"), marks)
    gone = F.col("m1").isNotNull() & (F.coalesce("late", F.lit(False)) | (place != F.col("first")))
    d = d.groupBy("doc_id", "text_hash").agg(
        F.count_distinct("line_no").alias("n_compared"),
        F.sum(F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        F.collect_set(F.when(gone, F.col("line_no"))).alias("removed"),
    )
    out = written(d)
    dropped(occ, links, classes, marks)
    return out


def with_kept_text(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` as struct ``row``, n_compared, n_links, n_removed and kept_text of each row, by ``removals``; rows that are ``lost`` there go."""
    shipped(docs.sparkSession)
    lost = F.col("lost") if "lost" in gone.columns else F.lit(False)
    gone = gone.select(F.col("doc_id").alias("r_id"), F.col("text_hash").alias("r_hash"), "n_compared", "n_links", "removed", lost.alias("lost"))
    d = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("d_id"), F.xxhash64("text").alias("d_hash"))
    d = d.join(gone, F.col("d_hash").eqNullSafe(F.col("r_hash")) & F.col("d_id").eqNullSafe(F.col("r_id")), "left").filter(~F.coalesce("lost", F.lit(False)))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    d = d.select("row", zero("n_compared"), zero("n_links"), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), "removed")
    text_at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            out = []
            texts = pc.struct_field(b.column(0), text_at)
            for text, removed in zip(texts.to_pylist(), b.column(4).to_pylist(), strict=True):
                if removed:
                    removed = set(removed)
                    text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in removed)
                out.append(text)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(out, pa.string())], names=["row", "n_compared", "n_links", "n_removed", "kept_text"])

    return d.mapInArrow(run, T.StructType([*d.schema.fields[:4], T.StructField("kept_text", T.StringType())]))


def _repeats_only(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """(doc_id, text_hash) of documents of which nothing of their own is left: white space, and lines of any
    length that an earlier document has too; a written table."""
    bare = written(gone.filter((F.size("removed") > 0) & (F.size("removed") == F.col("n_compared"))).select("doc_id", "text_hash"))
    texts = written(bare.select("text_hash").distinct())
    d = docs.filter("text is not null").select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    short = lambda x: x.select("doc_id", "text_hash", F.explode(F.split("text", "\n")).alias("line")).filter(~compared(F.col("line")))
    left = short(_within_ids(d, texts, "text_hash")).filter(F.col("line").rlike(r"\S")).select("doc_id", "text_hash", *_identity(F.col("line"))).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("text_hash") == F.col("b_hash"))
    left = written(left.join(bare.select(F.col("doc_id").alias("b_id"), F.col("text_hash").alias("b_hash")), same, "left_semi"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    ids = written(left.select("h1").distinct())
    firsts = _within_ids(short(d).select("doc_id", "text_hash", *_identity(F.col("line"))), ids, "h1").groupBy("h1", "h2").agg(F.min(place).alias("first"))
    own = left.join(firsts, ["h1", "h2"]).filter(F.col("first") == place).select(F.col("doc_id").alias("b_id"), F.col("text_hash").alias("b_hash")).distinct()
    return written(bare.join(own, same, "left_anti"))


def deduplicated(docs: DataFrame, threshold: int = THRESHOLD, share: int | None = None) -> DataFrame:
    """``docs`` with only the lines that stay (n_chars, if there, follows).

    A document goes if it loses lines and nothing of its own is left: white space, and lines of any
    length that an earlier document has too.
    """
    gone = removals(docs, threshold, share)
    lost = _repeats_only(docs, gone).select(F.col("doc_id").alias("l_id"), F.col("text_hash").alias("l_hash"))
    none = F.col("doc_id").eqNullSafe(F.col("l_id")) & (F.col("text_hash") == F.col("l_hash"))
    d = with_kept_text(docs, gone.join(lost, none, "left").select(*gone.columns, F.col("l_hash").isNotNull().alias("lost")))
    kinds = dict(docs.dtypes)
    new = {"text": F.col("kept_text")}
    if "n_chars" in kinds:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("kept_text")).otherwise(F.col("row.n_chars")).cast(kinds["n_chars"])
    return d.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def line_report(docs: DataFrame, share: int | None = None) -> DataFrame:
    docs = docs.select("doc_id", "text")
    d = with_kept_text(docs, removals(docs, share=share))
    return d.select("row.doc_id", "n_compared", "n_removed", "n_links", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))
