"""The edit join whose threshold follows the lines' length, against all pairs."""

import random
from collections import Counter

import pytest

from quiltgraph.llm import line_dedup
from quiltgraph.llm import queries as Q


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def linked(a, b, share):
    n = min(len(a), len(b))
    k = max(1, n // share)
    return n >= 30 and abs(len(a) - len(b)) <= k and distance(a, b) <= k


def by_hand(docs, share):
    """docs of distinct ids -> {doc_id: (n_removed, n_links)}, all lines being long enough to be compared."""
    first = {}
    for d, t in sorted(docs):
        for k, x in enumerate(t.split("\n")):
            first.setdefault(x, (d, k))
    near = {x: [y for y in first if y != x and linked(x, y, share)] for x in first}
    out = {}
    for d, t in docs:
        lines = list(enumerate(t.split("\n")))
        gone = sum(first[x] != (d, k) or any(first[y] < first[x] for y in near[x]) for k, x in lines)
        out[d] = (gone, sum(len(near[x]) for _, x in lines))
    return out


def edited(line, n):
    for _ in range(n):
        k = random.randrange(len(line))
        line = random.choice([line[:k] + line[k + 1 :], line[:k] + random.choice("xyé") + line[k:], line[:k] + random.choice("xyé") + line[k + 1 :]])
    return line


def spread(line, n):
    """n letters replaced at even distances, which leaves the shortest runs."""
    return "".join("Z" if k % (len(line) // n) == len(line) // n // 2 and k // (len(line) // n) < n else c for k, c in enumerate(line))


@pytest.mark.parametrize(("hot", "per_pass"), [(48, 60_000_000), (4, 3_000), (0, 60_000_000)])
def test_threshold_by_length(spark, monkeypatch, hot, per_pass):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    monkeypatch.setattr(line_dedup, "PASS_CHARS", per_pass)
    random.seed(8)
    lines = []
    for n in (34, 63, 64, 65, 95, 96, 130, 200, 333):
        base = "".join(random.choices("abcdefgh ", k=n))
        k = n // 32
        lines += [base, *[edited(base, e) for e in (1, 2, k, k, k + 1, k + 2)], spread(base, max(1, k)), base[k:], base[k + 1 :], "w" * k + base, base + "w" * (k + 1)]
    passage = "these words stand in very many of the lines, at the same place or not"
    lines += [passage + "".join(random.choices("pqrstuv ", k=40)) for _ in range(15)] + ["".join(random.choices("pqrs", k=9 * k)) + passage for k in range(1, 9)] + ["m" * k for k in (70, 71, 73, 100, 103, 104)]
    random.shuffle(lines)
    docs = [(k, "\n".join(lines[k::9])) for k in range(9)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_links) for r in line_dedup.line_report(df, 32).collect()}
    assert got == by_hand(docs, 32)
    assert sum(x[1] for x in got.values()) > line_dedup.line_report(df).groupBy().sum("n_links").first()[0]


def test_changed_words_of_long_lines_link(spark, tmp_path):
    line = "the quick brown fox jumps over the lazy dog while a very patient reader counts each letter of this long line of words, " * 2
    docs = [(1, line), (2, line.replace("quick", "quack").replace("lazy", "hazy")), (3, line.upper())]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_removed, r.n_links) for r in Q.op2_line_dedup_by_length(spark, str(tmp_path)).collect()}
    assert got == {1: (0, 1), 2: (1, 1), 3: (0, 0)}


def test_links_of_the_whole_table(spark):
    """All distinct lines of the table, pair by pair."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names = sorted({x for r in docs.collect() for x in (r.text or "").split("\n") if len(x) >= 64})
    want = Counter(k for i, a in enumerate(names) for b in names[:i] if abs(len(a) - len(b)) <= (k := min(len(a), len(b)) // 32) and line_dedup.within(a, b, k))
    found = line_dedup._long_links(docs, 32)
    assert found.count() == found.distinct().count() == want.total() > 10
