"""Operators against their SQL or a brute-force version, and the odd inputs they define."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import pytest
from compare import same
from pyspark.sql import functions as F

from quiltgraph.llm import queries as Q

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(sf, name):
    return duckdb.sql(f"SELECT * FROM '{sf}/{name}.parquet'").fetchall()


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Null, empty, repeated and very long texts, and columns whose names clash with the operators' own."""
    long = " ".join(f"w{k % 7919}" for k in range(60_000))
    rows = [
        (1, None, "en", "a", 1), (2, "", "en", "a", 1), (3, "one", None, None, None), (None, "x y", "en", None, 3), (None, None, None, None, None),
        (4, "a b c d e f " * 20, "en", "b", 1), (4, "a b c d e f " * 20, "en", "b", 1), (5, long, "de", "b", 9), (6, long + " tail", "de", "c", 9), (7, "\x1c 　é's 12345 don't\n\n\n x", "fr", "c", 1),
    ]
    path = tmp_path_factory.mktemp("odd")
    extra = "size long, fp long, n_words long, ids string, target string, copies int, `key` long, kept string, `row` string"
    full = [(*r, 1, 2, 3, "x", "y", 4, 5, "z", "r") for r in rows]
    spark.createDataFrame(full, f"{DOCS}, {extra}").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], DOCS).write.parquet(f"{path}/empty/documents.parquet")
    return str(path), rows


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_oracle(spark, name):
    same(Q.queries()[name](spark, SF), SF, Q.oracle_sql()[name])


@pytest.mark.parametrize("name", [n for n in sorted(Q.queries()) if n.split("_")[0] in ("op1", "op2", "op3", "op4", "op5", "op6", "op8")])
def test_odd_and_empty_tables(spark, odd, name):
    path, rows = odd
    got = Q.queries()[name](spark, path).collect()
    assert len(got) == len(rows)
    assert Q.queries()[name](spark, f"{path}/empty").collect() == []


def test_mix_takes_what_it_reports(spark, odd):
    from quiltgraph.llm import mixing

    docs = spark.read.parquet(f"{odd[0]}/documents.parquet")
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    report = mixing.mixing_report(docs).groupBy().sum("copies").first()[0]
    assert mixed.count() == report


def test_byte_bpe_is_tiktoken(spark, odd):
    import public_tokenizers
    import tiktoken

    from quiltgraph.llm import byte_bpe

    ranks = byte_bpe.ranks(byte_bpe.vocabulary_path())
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for sf in (SF, odd[0]):
        got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in Q.op6_byte_bpe(spark, sf).collect()}
        want = set()
        for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
            ids = enc.encode_ordinary(r.text or "")
            want.add((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
        assert got == want
    back = byte_bpe.decode(byte_bpe.encode(spark.read.parquet(f"{odd[0]}/documents.parquet"))).collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") and len(r.offsets) == len(r.ids) for r in back)
    c = byte_bpe.vocabulary(byte_bpe.vocabulary_path())
    for r in back:
        ends = [*r.offsets[1:], len(r.decoded)]
        assert all(bytes(r.decoded)[a:b] == c.bytes_of[i] for i, a, b in zip(r.ids, r.offsets, ends, strict=False))
    with pytest.raises(ValueError):
        c.decode([5, 6], [0, 9])


def test_pieces_are_the_patterns():
    import public_tokenizers
    import regex

    from quiltgraph.llm import pretokens

    random.seed(1)
    texts = ["".join(random.choices("aé1'stmdrevl  \n\t　 ,!3", k=random.randint(0, 40))) for _ in range(4000)]
    assert pretokens.pieces(texts) == [regex.findall(public_tokenizers.PATTERN, t) for t in texts]


def test_heap_and_scan_merges_agree():
    from quiltgraph.llm import byte_bpe

    ranks = byte_bpe.ranks(byte_bpe.vocabulary_path())
    random.seed(2)
    for _ in range(300):
        p = bytes(random.choices(b"thequickbrown ", k=random.randint(49, 120)))
        assert byte_bpe.merged(p, ranks) == byte_bpe.merged_short(p, ranks)


def test_token_counts_against_dynamic_programming(spark):
    import public_tokenizers
    import regex

    from quiltgraph.llm import byte_bpe, token_counts

    score, _ = token_counts.scores(byte_bpe.vocabulary_path())

    def count(piece):
        b = piece.encode()
        best = [0]
        for j in range(1, len(b) + 1):
            best.append(max(best[i] + score[b[i:j]] for i in range(j) if b[i:j] in score))
        return -best[-1] & 0xFFFFFFFF

    docs = table(SF, "documents")[:40]
    want = {d[0]: (len(p), sum(map(count, p))) for d in docs for p in [regex.findall(public_tokenizers.PATTERN, d[1])]}
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in Q.op3_token_counts(spark, SF).collect()}
    assert {k: got[k] for k in want} == want


def test_trie_of_long_words_and_small_bounds(monkeypatch):
    """Resets of the trie, generations of counts and words scored on their own change nothing."""
    import math

    from quiltgraph.llm import byte_bpe, token_counts

    path = byte_bpe.vocabulary_path()
    score, _ = token_counts.scores(path)
    assert abs(math.fsum(math.exp((s >> 32) / 65536) for s in score.values()) - 1) < 1e-3
    random.seed(12)
    words = ["".join(random.choices(["the", "ing", "q", "é", "ation", "zz", "😀", "a"], k=random.randint(1, 30))) for _ in range(300)] * 2

    def plain(b):
        best = [0]
        for j in range(1, len(b) + 1):
            best.append(max(best[i] + score[b[i:j]] for i in range(j) if b[i:j] in score))
        return -best[-1] & 0xFFFFFFFF

    want = [plain(w.encode()) for w in words]
    assert list(map(token_counts.Trie(path).count, words)) == want
    for name, value in (("NODES", 60), ("KEPT", 7), ("LONG", 12)):
        monkeypatch.setattr(token_counts, name, value)
        assert list(map(token_counts.Trie(path).count, words)) == want
    assert token_counts.Trie(path).count("ab" * 100_000) > 1000


def statistics(t):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    twice = Counter(grams)
    covered = {k + j for k, g in enumerate(grams) if twice[g] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(covered)


def test_quality_statistics(spark, odd):
    for sf in (SF, odd[0]):
        got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in Q.op4_quality_rules(spark, sf).collect())
        want = Counter()
        for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
            s = statistics(r.text)
            want[(r.doc_id, *s, s[0] < 50 or 100 * s[4] > 50 * s[0])] += 1
        assert got == want


def least_determinant(x):
    """(mean, Cholesky factor) of the least determinant that concentration steps reach from the two starts, in numpy."""
    import numpy as np

    from quiltgraph.llm import quality_rules as R

    floors = np.diag(np.array(R.FLOORS) ** 2)
    n = len(x)
    med = np.median(x, 0)
    mad = np.median(np.abs(x - np.floor(med + 0.5)), 0)
    scale = np.sqrt((1.4826 * mad / R.UNIT) ** 2 + np.diag(floors))
    z = (x / R.UNIT - med / R.UNIT) / scale
    size = np.maximum((z * z).sum(1), 1e-12)
    signs = np.array([[np.trunc(z[:, i] * z[:, j] / size * R.SIGNS + np.copysign(0.5, z[:, i] * z[:, j])).sum() for j in range(R.P)] for i in range(R.P)]) / n / R.SIGNS
    best = None
    for cov in (np.diag(scale**2), R.P * signs * np.outer(scale, scale) + floors):
        mean, was = med / R.UNIT, None
        while True:
            y = np.linalg.solve(np.linalg.cholesky(cov), (x / R.UNIT - mean).T)
            bins = np.floor(np.log((y * y).sum(0) + 1e-6) * R.BIN)
            k = np.sort(bins)[int(np.ceil(R.SUBSET * n)) - 1]
            near = x[bins <= k] / R.UNIT
            new = np.cov(near.T, bias=True) * R.CONSISTENT + floors
            to = np.linalg.slogdet(new)[1]
            if was is not None and not to < was[0] - R.GAIN:
                break
            mean, cov = near.mean(0), new
            was = (to, mean, np.linalg.cholesky(cov))
        if best is None or was[0] < best[0]:
            best = was
    return best[1:]


def check_quality(spark, docs):
    """Estimates and verdicts of every document against numpy."""
    import numpy as np

    from quiltgraph.llm import quality_rules as R

    stats = R.with_statistics(docs, [F.col(c) for c in ("doc_id", "lang", "source")]).cache()
    rows = stats.select("*", *R.vector(), R.base_failed().alias("bad")).collect()
    est = {(r.g_lang, r.g_source): r for r in R.fit(stats).collect()}
    kept = {r.doc_id: (r.kept, r.distance) for r in R.quality_report(docs).collect()}
    by = {"own": defaultdict(list), "lang": defaultdict(list), "all": defaultdict(list)}
    for r in rows:
        for kind, key in (("own", (r.lang, r.source)), ("lang", r.lang), ("all", None)):
            if not r.bad:
                by[kind][key].append([r[f"x{i}"] for i in range(R.P)])
    found, used = {}, Counter()
    for r in rows:
        key = next((k for k in (("own", (r.lang, r.source)), ("lang", r.lang), ("all", None)) if len(by[k[0]][k[1]]) >= R.LEAST), None)
        if key is None:
            assert kept[r.doc_id] == (not r.bad, None)
            continue
        if key not in found:
            found[key] = least_determinant(np.array(by[key[0]][key[1]], float))
        mean, c = found[key]
        e = est[r.lang, r.source]
        assert np.allclose([e[f"m{i}"] for i in range(R.P)], mean, atol=1e-9)
        assert np.allclose([e[f"c{i}{j}"] for i in range(R.P) for j in range(i + 1)], [c[i, j] for i in range(R.P) for j in range(i + 1)], atol=1e-9)
        y = np.linalg.solve(c, np.array([r[f"x{i}"] for i in range(R.P)]) / R.UNIT - mean)
        d2 = float(y @ y)
        assert abs(kept[r.doc_id][1] - d2) < 1e-6 * (1 + d2)
        assert kept[r.doc_id][0] == (not r.bad and d2 <= R.CUT)
        used[key[0]] += 1
    return used, kept


def test_quality_estimates_and_verdicts_against_numpy(spark):
    docs = Q.documents(spark, "/root/testdata/sf0.01")
    used, kept = check_quality(spark, docs)
    assert used["lang"] > 500 and not all(k for k, _ in kept.values())
    big = docs.withColumn("source", F.when(F.col("doc_id") % 11 == 0, "tiny").when(F.col("doc_id") % 2 == 0, "even").otherwise(None))
    big = big.withColumn("lang", F.when(F.col("doc_id") % 97 == 0, "rare").otherwise(F.col("lang")))
    used, _ = check_quality(spark, big)
    assert used["own"] > 300 and used["lang"] > 20 and used["all"] > 5
    assert check_quality(spark, docs.limit(40))[0] == {}


def test_quality_judges_small_sources(spark):
    from quiltgraph.llm import quality_rules as R

    random.seed(8)
    text = lambda: " ".join("".join(random.choices("abcdefgh", k=random.randint(3, 9))) for _ in range(random.randint(80, 200)))
    junk = lambda: " ".join("".join(random.choices("#$%&*", k=6)) for _ in range(100))
    rows = [(k, text(), "en", "web") for k in range(200)] + [(1000 + k, junk(), "en", "tiny") for k in range(5)] + [(2000 + k, junk(), "xx", "other") for k in range(3)] + [(3000, text(), "yy", None)]
    kept = {r.doc_id: r.kept for r in R.quality_report(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(kept[k] for k in (*range(1000, 1005), *range(2000, 2003)))
    assert kept[3000] and sum(kept[k] for k in range(200)) >= 198


def test_simhash_against_all_pairs(spark, odd):
    import xxhash

    for sf in (SF, odd[0]):
        docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]

        def fp(t):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
            for c in "\t\n\v\f\r":
                w = w.replace(c, " ")
            w = [x for x in w.split(" ") if x]
            if not w:
                return 0
            s = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))]
            h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
            return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

        f = [fp(t) for _, t in docs]
        root = list(range(len(f)))

        def find(a):
            while root[a] != a:
                a = root[a]
            return a

        for a in range(len(f)):
            for b in range(a):
                if (f[a] ^ f[b]).bit_count() <= 2:
                    root[find(a)] = find(b)
        low = {}
        for k, (i, _) in enumerate(docs):
            if i is not None:
                low[find(k)] = min(low.get(find(k), i), i)
        want = Counter((i, f"{f[k]:016x}", low.get(find(k))) for k, (i, _) in enumerate(docs))
        assert Counter(tuple(r) for r in Q.op8_simhash(spark, sf).collect()) == want


def test_links_against_all_pairs(spark):
    """Candidates are rejected by their distance; split buckets connect what all pairs connect."""
    from quiltgraph.llm import simhash

    random.seed(6)
    flip = lambda x, n: x ^ sum(1 << b for b in random.sample(range(64), n))
    base = [random.getrandbits(64) for _ in range(6)]
    fps = {0, (1 << 64) - 1, *base}
    for b in base[:3]:
        fps |= {flip(b, random.randint(1, 4)) for _ in range(120)}
    fps |= {base[3] ^ (random.getrandbits(32) << 32) for _ in range(60)} | {base[4] ^ random.getrandbits(32) for _ in range(60)}
    fps |= {base[5] ^ random.choice([1 << 32, 1 << 40, 0]) ^ sum(1 << k for k in random.sample(range(32), random.randint(0, 3))) for _ in range(200)}
    fps = sorted(fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    root = {x: x for x in fps}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    want = {frozenset(signed(y) for y in fps if find(y) == x) for x in {find(x) for x in fps}}
    for hot in (3, 20, 1000):
        found = simhash.components(simhash.links(df, hot=hot)).collect()
        got: dict = {}
        for r in found:
            got.setdefault(r.root, set()).add(r.node)
        assert {frozenset(x) for x in got.values()} == {x for x in want if len(x) > 1}
        assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2 for r in simhash.links(df, hot=hot).collect())
    met = simhash.candidates(simhash.probes(df), simhash.entries(df))
    assert met.filter("distance > 2").count() > 0 and met.filter("distance <= 2").count() > 0
    rows = simhash.probes(df).count() + 2 * len(fps)
    assert rows < 36 * len(fps)


def test_components_on_long_chains(spark):
    from quiltgraph.llm import simhash

    edges = [(k, k + 1) for k in range(60)] + [(100, 200), (200, 300), (101, 300), (7, 500)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys([*range(61), 500], 0), **dict.fromkeys([100, 101, 200, 300], 100)}


def test_simhash_keeps_one_of_each(spark, odd):
    from quiltgraph.llm import simhash

    docs = spark.read.parquet(f"{odd[0]}/documents.parquet")
    kept = simhash.kept_documents(docs)
    n = len({(r.fingerprint, r.component_id) for r in simhash.simhash_report(docs).collect()})
    assert kept.columns == docs.columns and kept.count() <= n


def test_chat_examples(spark):
    from quiltgraph.llm import chat

    rows = [(1, 0, "user", "hi ~0<|im_end|>"), (1, 1, "assistant", "a<|"), (1, 2, "user", None), (1, 3, "assistant", "b"), (2, 0, "user", "x"), (None, None, None, None), (3, 0, "a\nb~2", "~1<~1|")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    f = chat.format_conversations(conv)
    e = chat.prefix_examples(f).orderBy("turn_no").collect()
    assert [(r.conv_id, r.turn_no, r.target) for r in e] == [(1, 2, "a<~1|"), (1, 4, "b")]
    whole = {r.conv_id: r[1] for r in f.select("conv_id", chat.formatted_text()).collect()}
    assert all(whole[1].startswith(r.context + r.target) for r in e)
    back = {r.conv_id: [tuple(t) for t in r.t] for r in f.select("conv_id", chat.read_turns(chat.formatted_text()).alias("t")).collect()}
    assert back == {1: [("user", "hi ~0<|im_end|>"), ("assistant", "a<|"), ("user", ""), ("assistant", "b")], 2: [("user", "x")], None: [("", "")], 3: [("a\nb~2", "~1<~1|")]}
    assert chat.chat_digest(conv.filter("false")).collect() == []


def test_chat_digest_of_odd_rows(spark, tmp_path):
    """Null turns, ties, repeated rows, very long texts and clashing columns, against the SQL."""
    from quiltgraph.llm import chat

    long = "word ~ <|im_end|> " * 20_000
    rows = [(1, None, "assistant", "first"), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", "tie"), (1, 1, "assistant", "same"), (1, 1, "assistant", "same"), (2, 0, "user", long), (2, 1, "assistant", long + "x"), (2, 2, "assistant", None), (2, 3, None, "~"), (None, 3, "assistant", "n"), (None, 1, "x\ny<|", ""), (4, 0, "assistant", "")]
    rows += [(5, k, ("user", "assistant")[k % 2], f"turn {k} é\n") for k in range(400)]
    table = spark.createDataFrame([(*r, "x", 1, "t", 0) for r in rows], "conv_id long, turn long, role string, text string, segments string, at int, turns string, example int")
    table.coalesce(1).write.parquet(f"{tmp_path}/c")
    (file,) = tmp_path.glob("c/*.parquet")
    sql = f"WITH conversations AS (SELECT conv_id, turn, role, text FROM '{file}'), " + chat.ORACLE.strip().removeprefix("WITH ")
    same(chat.chat_digest(chat.with_hostile(spark.read.parquet(f"{tmp_path}/c"))), SF, sql)
    contexts = chat.prefix_examples(chat.format_conversations(table.filter("conv_id = 5"))).select(F.char_length("context").alias("n")).collect()
    assert len(contexts) == 200 and len({r.n for r in contexts}) == 200


def test_chat_plan_builds_contexts(spark):
    from quiltgraph.llm import chat

    d = chat.chat_digest(spark.read.parquet(f"{SF}/conversations.parquet"))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "slice(segments" in plan and plan.count("Exchange") == 1 and "Python" not in plan
