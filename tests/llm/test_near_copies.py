"""Near copies of the pipeline's stage against all pairs of shingle sets."""

import random

import corpus_pipeline as C
from pyspark.sql import functions as F

from quiltgraph.llm import simhash


def planted():
    random.seed(7)
    word = lambda: "".join(random.choices("abcdefghij", k=6))
    out = [None, "", " ", "one two", "One  two", "one two three"]
    for n, copies, edits in ((100, 12, 1), (80, 40, 3), (60, 30, 2), (300, 3, 5)):
        last = first = [word() for _ in range(n)]
        for k in range(copies):
            new = list(last if k % 3 else first)
            for _ in range(random.randint(1, edits)):
                new[random.randrange(n)] = word()
            out.append(" ".join(new))
            last = new
    boiler = " ".join(word() for _ in range(40))
    out += [" ".join(word() for _ in range(5)) + " " + boiler for _ in range(6)] + [" ".join(word() for _ in range(30)) + " " + boiler for _ in range(6)]
    return list(enumerate(out))


def by_hand(docs):
    sets = []
    for _, t in docs:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(docs)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(docs)):
        for b in range(a):
            if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i, _ in docs}


def test_stage_keeps_one_of_near_copies(spark):
    docs = planted()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = by_hand(docs)
    assert {r.doc_id for r in C.near_duplicates(spark, df, "").collect()} == set(want.values())
    for hot, pivots in ((6, 2),):
        got = {}
        for r in simhash.near_copies(df, hot=hot, pivots=pivots).collect():
            got.setdefault(r.component_id, set()).add(r.doc_id)
        assert got == {k: {i for i in want if want[i] == k} for k in set(want.values())}


def test_sketches_bound_similarity(spark):
    """No pair's bound is below its true similarity, at any sizes; disjoint sets are ruled out."""
    docs = [(i, t) for i, t in planted() if t and len(t.split()) > 5]
    docs += [(1000 + k, " ".join(f"w{(7 * k + j) % 5003}" for j in range(300 + 90 * k))) for k in range(12)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    signed = simhash.signatures(df, simhash.np.zeros(0, simhash.np.int64)).cache()
    fps = signed.select("fp").distinct()
    pairs = fps.select(F.col("fp").alias("a")).join(fps.select(F.col("fp").alias("b")), F.col("a") < F.col("b"))
    sim = simhash.Similarity(df, signed, 5, 8)
    bounds = {(r.a, r.b): r for r in sim.bounded(pairs).collect()}
    sets = {r.fp: set(r.shingles) for r in simhash.shingle_sets(df).collect()}
    out = 0
    for (a, b), r in bounds.items():
        same = len(sets[a] & sets[b])
        assert r.same >= same and r.same + r.whole == len(sets[a]) + len(sets[b])
        out += same == 0 and r.same * 10 < r.whole * 8
    assert out > 0.9 * sum(not sets[a] & sets[b] for a, b in bounds)


def test_a_group_around_a_passage(spark, monkeypatch):
    """Documents of one shared passage and own texts of many lengths: links through a hot key."""
    random.seed(9)
    monkeypatch.setattr(simhash, "SHARE", 1)
    word = lambda: "".join(random.choices("abcdefghij", k=6))
    passage = " ".join(word() for _ in range(200))
    docs = [(k, passage + " " + " ".join(word() for _ in range(random.randint(0, 60)))) for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = by_hand(docs)
    for hot, pivots in ((5, 1),):
        got = {r.doc_id: r.component_id for r in simhash.near_copies(df, hot=hot, pivots=pivots).collect()}
        assert got == want


def test_fingerprints_fetch_and_similarity_decides(spark, monkeypatch):
    """Pairs come from the fingerprint tables first; one that is near by its bits alone is not a copy; joined pairs aren't tried again."""
    random.seed(12)
    word = lambda: "".join(random.choices("abcdefghij", k=6))
    chant = " ".join([word() for _ in range(7)] * 300)
    long = [word() for _ in range(3000)]
    docs = [(k, " ".join(word() for _ in range(25)) + " " + chant) for k in range(2)]
    docs += [(10 + k, " ".join([*long[: 300 * k], word(), *long[300 * k + 1 :]])) for k in range(4)] + [(20, " ".join(word() for _ in range(50)))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    signed = simhash.written(simhash.signatures(df, simhash.np.zeros(0, simhash.np.int64)))
    names = {r.fp: r.doc_id for r in signed.collect()}
    got = {tuple(sorted((names[r.a], names[r.b]))) for r in simhash.fingerprint_pairs(signed).collect()}
    bits = {r.doc_id: r.bits & (1 << 64) - 1 for r in signed.collect()}
    assert all(bits[d] == simhash.fingerprint(t, 5) for d, t in docs)
    near = {(a, b) for a in bits for b in bits if a < b and (bits[a] ^ bits[b]).bit_count() <= 2}
    assert got and got <= near and (0, 1) in got and any(a >= 10 for a, _ in got)
    tried, similar = [], simhash.Similarity.similar
    monkeypatch.setattr(simhash.Similarity, "similar", lambda self, pairs: tried.append({tuple(sorted((names[r.a], names[r.b]))) for r in pairs.collect()}) or similar(self, pairs))
    want = by_hand([(k, t) for k, (_, t) in enumerate(docs)])
    assert {r.doc_id: r.component_id for r in simhash.near_copies(df).collect()} == {docs[k][0]: docs[root][0] for k, root in want.items()}
    assert want[0] != want[1] and tried[0] == got and not (got - {(0, 1)}) & tried[1]
