"""The edit join against all pairs, and the pipeline against its stages done by hand."""

import hashlib
import random
import re
from collections import Counter

from quiltgraph.llm import queries as Q


def close(a, b):
    """Edit distance 1 or less: common prefix and suffix leave at most one character of the longer."""
    if abs(len(a) - len(b)) > 1:
        return False
    n, m = min(len(a), len(b)), max(len(a), len(b))
    p = next((i for i in range(n) if a[i] != b[i]), n)
    s = next((i for i in range(n - p) if a[-1 - i] != b[-1 - i]), n - p)
    return m - p - s <= 1


def compared(x):
    return len(x) >= 30 or len(re.findall(r"[^\x20\x09-\x0D]+", x)) >= 3


def by_hand(docs):
    """docs: distinct (doc_id, text) -> (doc_id, n_compared, n_removed, n_links, kept_text)."""
    lines = [(d, k, x) for d, t in docs for k, x in enumerate((t or "").split("\n")) if compared(x)]
    order = sorted(lines)
    first = {}
    for d, k, x in order:
        first.setdefault(x, (d, k))
    names = sorted(first)
    near = {x: [] for x in names}
    for i, a in enumerate(names):
        for b in names[:i]:
            if min(len(a), len(b)) >= 30 and close(a, b):
                near[a].append(b)
                near[b].append(a)
    out = []
    for d, t in docs:
        n = gone = links = 0
        kept = []
        for k, x in enumerate((t or "").split("\n")):
            drop = False
            if compared(x):
                n += 1
                links += len(near[x])
                drop = first[x] != (d, k) or any(first[y] < first[x] for y in near[x])
            gone += drop
            if not drop:
                kept.append(x)
        out.append((d, n, gone, links, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def planted():
    random.seed(4)
    base = "".join(random.choices("abcdefgh ", k=60))
    lines = [base, base[:-1], base[1:], "x" + base, base[:30] + "é" + base[30:], base[:20] + "y" + base[21:], base[:20] + "zz" + base[22:], "short", "", base]
    hot = ["".join(random.choices("pq", k=8)) + "m" * 40 for _ in range(200)] + ["m" * 40 + "".join(random.choices("rs", k=7)) for _ in range(200)]
    lines += hot
    return [(k, "\n".join(lines[k::37])) for k in range(37)] + [(100, None), (101, ""), (102, lines[0] + "\n" + lines[0]), (103, lines[0]), (104, "All rights reserved.\nred rose\nAll rights reserve."), (105, "red rose\nAll rights reserved.\n a  b\tc"), (106, " a  b\tc\n")]


def test_links_and_removals(spark, tmp_path):
    docs = planted()
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert Counter(map(tuple, Q.op2_line_dedup(spark, str(tmp_path)).collect())) == Counter(by_hand(docs))


def test_common_lines_and_clashing_columns(spark, tmp_path, monkeypatch):
    from quiltgraph.llm import line_dedup

    monkeypatch.setattr(line_dedup, "COMMON", 3)
    docs = planted() + [(200 + k, "one line that is in very many documents\n" * 2 + "an own line of a document: " + 9 * chr(97 + k % 10) + 9 * chr(110 + k // 10)) for k in range(30)]
    rows = [(d, t, 1, 2, "x", "y") for d, t in docs]
    df = spark.createDataFrame(rows, "doc_id long, text string, h1 int, n int, `row` string, first string")
    want = Counter(by_hand(docs))
    assert Counter(map(tuple, line_dedup.line_report(df).collect())) == want
    out = line_dedup.deduplicated(df)
    assert out.columns == df.columns and out.filter("doc_id = 229").first().text == "an own line of a document: jjjjjjjjjppppppppp"
    monkeypatch.setattr(line_dedup, "BROADCAST_IDS", 0)
    assert Counter(map(tuple, line_dedup.line_report(df).collect())) == want


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(map(tuple, Q.op2_line_dedup(spark, sf).collect())) == Counter(by_hand(docs))


def test_distance_in_a_band():
    from quiltgraph.llm.line_dedup import within

    def distance(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    random.seed(5)
    for _ in range(5000):
        a, b = ("".join(random.choices("ab", k=random.randint(0, 9))) for _ in range(2))
        k = random.randint(0, 4)
        assert within(a, b, k) == (distance(a, b) <= k)


def mixed_by_hand(rows):
    """Each row as often as the mix takes it: targets by filling up round by round, one hash draw a document."""
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    sizes = Counter()
    for r in rows:
        sizes[r.source] += size(r)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        for s in full or open_:
            target[s] = 2.0 * sizes[s] if full else weight[s] * level
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    out = Counter()
    for r in rows:
        rate = target[r.source] / sizes[r.source] if sizes[r.source] else 0.0
        u = int(hashlib.md5(f"mix-1:{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        n = int(rate) + (u < rate - int(rate))
        if n:
            out[tuple(r)] = n
    return out


def test_pipeline(spark, tmp_path):
    """Each stage on the table the one before left: columns, counts and effects."""
    import itertools

    import corpus_pipeline as C
    import public_tokenizers
    import tiktoken

    from quiltgraph.llm import byte_bpe

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = []
    for k, (name, stage) in enumerate(C.STAGES):
        before = docs
        docs = stage(spark, docs, sf)
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(C.STAGES) - 1:
            assert docs.columns == columns and dict(docs.dtypes) == dict(before.dtypes), name
        seen.append((before.count(), docs.count()))
        if name == "quality_rules":
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in Q.op4_quality_rules(spark, sf).filter("kept").collect()}
        if name == "line_dedup":
            kept = {d: h for d, _, _, _, h in by_hand([(r.doc_id, r.text) for r in before.collect()])}
            assert all(hashlib.sha256(r.text.encode()).hexdigest() == kept[r.doc_id] for r in docs.collect())
        if name == "simhash_near_dedup":
            from test_near_copies import by_hand as near_copies

            rows = [(r.doc_id, r.text) for r in before.orderBy("doc_id").collect()]
            root = near_copies([(k, t) for k, (_, t) in enumerate(rows)])
            assert sorted(r.doc_id for r in docs.collect()) == [rows[k][0] for k in sorted(set(root.values()))]
        if name == "mix_sources":
            assert Counter(tuple(r) for r in docs.collect()) == mixed_by_hand(before.collect())
        if name == "byte_bpe":
            enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(byte_bpe.vocabulary_path()), special_tokens={})
            text = {r.doc_id: r.text for r in before.collect()}
            for r in docs.collect():
                assert r.intact and r.ids == enc.encode_ordinary(text[r.doc_id]) and r.n_tokens == len(r.ids)
                assert r.offsets == [0, *itertools.accumulate(len(enc.decode_single_token_bytes(i)) for i in r.ids)][: len(r.ids)]
    assert seen[0][1] < seen[0][0] and seen[2][1] <= seen[2][0] and seen[4][0] == seen[4][1]
    empty = spark.read.parquet(f"{sf}/documents.parquet").filter("false")
    for _, stage in C.STAGES:
        out = stage(spark, empty, sf)
        assert out.count() == 0
    key = lambda d: Counter((r.doc_id, r.source, tuple(r.ids)) for r in d.collect())
    assert key(C.run(spark, sf)) == key(spark.read.parquet(f"{tmp_path}/4"))


def test_which_documents_go(spark):
    from quiltgraph.llm.line_dedup import deduplicated

    long = "this passage of many words is in all documents and is long, " * 2
    docs = [(1, f"{long}\nshared short"), (2, f"{long}\nmy own rose"), (3, f"{long}\nshared short\n \n"), (4, long), (5, f"{long}\nmy own rose\nshared short\n"), (6, "shared short"), (7, None), (8, f"{long}\ntwice\ntwice"), (None, f"{long}\ntwice")]
    out = deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in out} == {1: docs[0][1], 2: "my own rose", 6: "shared short", 7: None, 8: "twice\ntwice"}
