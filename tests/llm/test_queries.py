"""Queries over the small tables against SQL or plain versions, and operators on awkward tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.compare import check
from tidegrid.llm import bpe, decontam, graph, kdshard, lm, packing, secrets, semdedup, simhash, substring, toxicity
from tidegrid.llm import queries as Q

SF = "/root/testdata/sf0.001"
AWKWARD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, "Password: hunter2hunter2 é"), (7, "w " * 3000), (8, "w " * 3000), (8, "w " * 3000), (None, "no id"),
    (9, " ".join(f"t{i}" for i in range(400))), (10, "x " + " ".join(f"t{i}" for i in range(60, 300)) + " y"), (11, "\u0001  日本 a" * 40),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty, long, equal and repeated rows, and columns named like the operators' own."""
    df = spark.createDataFrame(AWKWARD, "doc_id long, text string")
    for c in ("id", "name", "key", "n", "fp", "node", "size", "spans", "base", "tests", "row", "group", "t", "lang", "source"):
        df = df.withColumn(c, F.lit("clash"))
    return df.withColumn("n_chars", F.char_length("text").cast("long"))


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.where("false")


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_agrees_with_sql(spark, name):
    assert check(spark, SF, Q.QUERIES[name], Q.ORACLE_SQL[name]) == ""


def components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in (p for p in pairs if p[0] != p[1]):
        a, b = sorted((find(a), find(b)))
        root[b] = a
    out = defaultdict(list)
    for n in nodes:
        out[find(n)].append(n)
    return {n: min(v) for v in out.values() for n in v}


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2100)]
    want = components(edges, {x for a, b in edges if a != b for x in (a, b)})
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def plain_lm(train, texts, order=3):
    """Interpolated absolute discounting with dictionaries."""
    tok = lambda t: (t or "").encode().lower().split() + [None]
    c, bi, tri, fol, fol3, all3 = Counter(), Counter(), Counter(), Counter(), Counter(), Counter()
    for t in train:
        w = tok(t)
        c.update(w)
        pairs = list(zip([None, *w[:-1]], w))
        bi.update(pairs)
        tri.update(zip(pairs, w[1:]))
    n, v = sum(c.values()), len(c)

    def discount(counts):
        n1, n2 = (sum(x == k for x in counts.values()) for k in (1, 2))
        return n1 / (n1 + 2 * n2) if n1 and n2 else 0.5

    d, d3 = discount(bi), discount(tri)
    fol.update(a for a, _ in bi)
    fol3.update(a for a, _ in tri)
    for (a, _), k in tri.items():
        all3[a] += k
    for t in texts:
        w = tok(t)
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        score, before = 0.0, None
        for pair in zip([None, *w[:-1]], w):
            a, b = pair
            p = (c[b] + 1) / (n + v + 1)
            if c[a]:
                p = max(bi[pair] - d, 0) / c[a] + d * fol[a] / c[a] * p
            if order > 2 and before and all3[before]:
                p = max(tri[before, b] - d3, 0) / all3[before] + d3 * fol3[before] / all3[before] * p
            score, before = score + math.log10(p), pair
        yield len(w), sum(c[x] > 0 for x in w), base, score, n


@pytest.mark.parametrize("shard", [2_000_000, 5_000])
def test_lm_scores(spark, docs, monkeypatch, shard):
    monkeypatch.setattr(lm, "SHARD_TOKENS", shard)
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = {zlib.crc32(str(i).encode()) % 7 == 2: 0 for i in texts}
    got = {r.doc_id: r for r in Q.op1_lm_score(spark, SF).collect()}
    want = plain_lm([t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2], texts.values())
    gain = []
    for i, (n, known, base, score, total) in zip(texts, want):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert r.base_score == pytest.approx(base, rel=1e-9) and abs(r.score - score) <= 0.0003 * n
        if r.held_out:
            gain.append((score - base) / n)
    assert len(got) == len(texts) and np.mean(gain) > 0 and out
    two = {r.id: r.score for r in lm.score(docs, lm.train(docs, order=2)).collect()}
    assert all(abs(two[i] - x[3]) <= 0.0003 * x[0] for i, x in zip(texts, plain_lm(texts.values(), texts.values(), order=2)))


def test_lm_on_awkward_tables(spark, awkward, empty):
    trie = lm.train(awkward)
    rows = lm.score(awkward, trie).collect()
    assert len(rows) == len(AWKWARD) and all(r.score <= 0 and math.isfinite(r.score) for r in rows)
    nothing = lm.train(empty)
    assert nothing.n_tokens == 0 and lm.score(empty, nothing).count() == 0 and lm.score(awkward, nothing).count() == len(AWKWARD)


def plain_secrets(t):
    t = t or ""
    assign = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)


def test_secrets(spark, docs, awkward, empty):
    rng = random.Random(2)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(60)]
    more = [(1000, "token=token=abcdefgh token=secret:abcdefghij"), (1001, "😀 Api_Key : 'ABCDEFGH1' " * 300), (1002, "AKIA" * 3 + "AKIAABCDEFGHIJKL" + " " + "0f" * 16)] + [(2000 + i, f"é key {k} end v1a1a1a1a1a1a1a1a1a1a1a1a1a") for i, k in enumerate(keys)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string")).unionByName(awkward.select("doc_id", "text"))
    texts = df.collect()
    got = secrets.find(df)
    base = Counter((r.id, r.base_sha256) for r in got.collect())
    spelled = lambda s: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in s)
    assert base == Counter((r.doc_id, hashlib.sha256(spelled(plain_secrets(r.text)).encode()).hexdigest()) for r in texts)
    spans = {r.id: r.spans for r in got.where("id >= 2000").collect()}
    assert sum("random:6:46" in s for s in spans.values()) >= 54 and not any("random:51" in s for s in spans.values())
    assert secrets.find(empty).count() == 0
    clean = {r.doc_id: r.text for r in secrets.redact(awkward).collect()}
    assert clean[6] == "[SECRET] é" and clean[1] is None and clean[7] == "w " * 3000
    assert secrets.redact(awkward).columns == awkward.columns and secrets.redact(empty).count() == 0


def test_battery_accepts_random_and_rejects_text(spark):
    rng = random.Random(4)
    random_ = ["".join(rng.choice("0123456789abcdefghijklmnopqrstuvwxyz") for _ in range(40)) for _ in range(400)]
    text = ["".join(rng.choice(["the", "and", "ing", "er", "1", "2"]) for _ in range(20)) for _ in range(400)]
    p = lambda xs: [r.p for r in spark.createDataFrame([(x,) for x in xs], "t string").select(secrets.battery(F.col("t")).p.alias("p")).collect()]
    assert 0.3 < np.mean(p(random_)) < 0.7 and np.mean(np.array(p(random_)) < 0.05) < 0.12 and np.mean(np.array(p(text)) < 0.05) > 0.8


def test_long_tokens_are_tested(spark):
    rng = random.Random(5)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    rows = [(i, "key " + "".join(rng.choice(alphabet) for _ in range(513 + 37 * i)) + " end") for i in range(40)]
    rows += [(100 + i, "key " + "the1And2ing3er" * (40 + i) + " end") for i in range(10)]
    spans = {r.id: r.spans for r in secrets.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(f"random:4:{517 + 37 * i}" in spans[i] for i in range(40)) >= 36 and not any("random" in spans[100 + i] for i in range(10))


def vocabulary():
    public = pytest.importorskip("public_tokenizers")
    return public.path(Q.VOCABULARY), public.PATTERN


def test_packing_loses_nothing(spark, docs, awkward, empty):
    import tiktoken

    path, pattern = vocabulary()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    for df in (docs, awkward):
        rows = packing.pack(df, path, pattern, 50256, length=128, group_bytes=100_000).collect()
        pieces = defaultdict(list)
        for r in rows:
            assert len(r.input_ids) == len(r.position_ids) == 128 and r.cu_seqlens[-1] == r.n_tokens and set(r.input_ids[r.n_tokens :]) <= {50256}
            for d, part, a, b in zip(r.doc_ids, r.parts, r.cu_seqlens, r.cu_seqlens[1:]):
                assert r.position_ids[a:b] == list(range(b - a))
                pieces[d].append((part, r.input_ids[a:b]))
        want = defaultdict(list)
        for r in df.collect():
            ids = enc.encode_ordinary(r.text or "") + [50256]
            want[r.doc_id] += [(k // 128, ids[k : k + 128]) for k in range(0, len(ids), 128)]
        assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    assert packing.pack(empty, path, pattern, 50256).count() == 0


def test_packing_of_the_whole_table(spark, docs):
    """Whatever the size of a task's block and the partitions, rows are those of best fit over all segments; the query has the ids themselves."""
    import tiktoken

    path, pattern = vocabulary()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    sizes = {}
    for length in (128, 2048):
        texts = [len(enc.encode_ordinary(r.text or "")) + 1 for r in docs.collect()]
        own = [min(length, n - k) for n in texts for k in range(0, n, length)]
        sizes[length] = sorted(sum(own[i] for i in r) for r in packing.best_fit(own, length))
    for df in (docs, docs.repartition(7)):
        rows = packing.pack(df, path, pattern, 50256, length=128, group_bytes=20_000).collect()
        assert sorted(r.n_tokens for r in rows) == sizes[128] and sorted(r.row for r in rows) == list(range(len(rows)))
    rows = Q.op3_packing(spark, SF).collect()
    assert sorted(r.n_tokens for r in rows) == sizes[2048]
    for r in rows:
        assert r.row_sha256 == hashlib.sha256(np.array(r.input_ids + r.position_ids, "<i4").tobytes()).hexdigest() and len(r.input_ids) == 2048
    assert sum(r.n_tokens for r in rows) == sum(texts)


def test_sharding(spark, awkward, empty):
    rows = Q.op4_kdtree_sharding(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    by = defaultdict(list)
    for r in rows:
        t = (texts[r.doc_id] or "").encode()
        assert r["size"] == len(t) + 1 and r.text_crc32 == zlib.crc32(t) and r.law == "bytes"
        by[r.shard].append(r)
    assert sorted(by) == list(range(16)) and all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    assert all(abs(sum(r["size"] for r in v) - total / 16) <= 2 * largest for v in by.values())
    assert len(kdshard.shard(awkward, ["lang", "n_chars"], shards=4).collect()) == len(AWKWARD)
    same = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit(1).alias("c"))
    assert all(abs(r["count"] - 125) <= 3 for r in kdshard.shard(same, ["c"], shards=8).groupBy("shard").count().collect())
    assert max(r["sum(size)"] for r in kdshard.shard(same, ["c"], target_bytes=300).groupBy("shard").sum("size").collect()) <= 300
    assert kdshard.shard(empty, ["lang"], shards=4).count() == 0


def test_bpe(spark, docs, awkward, empty):
    path, pattern = vocabulary()
    got = {(r.id, r.decoded) for r in bpe.encode(awkward, path, pattern).collect()}
    assert got == {(i, t or "") for i, t in AWKWARD}
    for r, s in zip(bpe.digests(docs, path, pattern).orderBy("id").collect(), docs.orderBy("doc_id").collect()):
        assert r.decoded_sha256 == hashlib.sha256((s.text or "").encode()).hexdigest()
    assert bpe.encode(empty, path, pattern).count() == 0


def test_simhash_groups(spark, docs, awkward, empty):
    near = [(5000 + i, f"a{i} " + " ".join(f"w{k}" for k in range(900))) for i in range(40)]
    for df in (docs.select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id long, text string")), awkward):
        rows = [(r.doc_id, r.text) for r in df.collect() if r.doc_id is not None]
        f = np.array([simhash.fingerprint((t or "").encode()) for _, t in rows], np.uint64)
        links = [(rows[i][0], rows[j][0]) for i in range(len(f)) for j in np.flatnonzero(np.bitwise_count(f[i] ^ f[:i]) <= 2)]
        want = components(links, [i for i, _ in rows])
        got = simhash.groups(df).collect()
        assert Counter((r.id, r.fp % 2**64, r.component_id) for r in got) == Counter((i, int(x), want[i]) for (i, _), x in zip(rows, f))
    assert simhash.groups(empty).count() == 0 and simhash.near_copies(empty).count() == 0


def test_near_copies(spark, docs, awkward):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for k in range(60):
        w = [word() for _ in range(300)]
        rows.append((k, " ".join(w)))
        for i in rng.sample(range(300), 4):
            w[i] = word()
        rows.append((1000 + k, " ".join(w)))
    rows += [(2000 + k, " ".join(word() for _ in range(200))) for k in range(60)]
    got = {r.id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[1000 + k] == k for k in range(60)) >= 57 and all(got[i] == i for i in range(2000, 2060))
    kept = [r.doc_id for r in simhash.drop_near_copies(awkward).collect()]
    assert kept.count(None) == 1 and sorted(i for i in kept if i is not None) == [1, 4, 6, 7, 9, 10, 11] and simhash.drop_near_copies(awkward).columns == awkward.columns


def shingle_set(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def plain_near(rows, limit=0.8):
    s = {i: shingle_set(t) for i, t in rows}
    ids = sorted(s)
    alike = lambda a, b: not (a | b) or len(a & b) >= limit * len(a | b)
    return components([(i, j) for i in ids for j in ids if i < j and alike(s[i], s[j])], ids)


def near(spark, rows):
    return {r.id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_near_copies_of_a_base_with_a_middle_id(spark):
    """The copies are like the base and not like each other, and the base is neither end of a bucket."""
    rng = random.Random(7)
    base = [f"b{rng.randrange(10**6)}" for _ in range(240)]
    rows = [(500, " ".join(base))]
    for i in range(200):
        w = list(base)
        for k in rng.sample(range(5, 235), 4):
            w[k] = f"c{rng.randrange(10**9)}"
        rows.append((400 + i if i < 100 else 401 + i, " ".join(w)))
    got = near(spark, rows)
    assert got == plain_near(rows) and set(got.values()) == {400}


def replaced(rng, words, k, at):
    return words[:at] + [f"r{rng.randrange(10**9)}" for _ in range(k)] + words[at + k :]


def test_near_copies_by_block_and_cut(spark):
    """Pairs at 0.80 to 0.81 by one replaced block or by truncation, whose fingerprints differ most."""
    rng = random.Random(8)
    rows = []
    for k in range(40):
        w = [f"w{rng.randrange(10**9)}" for _ in range(300)]
        rows += [(10 * k, " ".join(w)), (10 * k + 1, " ".join(replaced(rng, w, 28, rng.randrange(4, 260)))), (10 * k + 2, " ".join(w[:241]))]
    got = near(spark, rows)
    assert got == plain_near(rows) and all(got[10 * k + i] == 10 * k for k in range(40) for i in (1, 2))


def test_near_copies_on_whole_sets(spark):
    """Texts of many shingles just above and just below the limit."""
    rng = random.Random(9)
    rows = []
    for k in range(30):
        w = [f"w{rng.randrange(10**9)}" for _ in range(604)]
        rows += [(10 * k, " ".join(w)), (10 * k + 1, " ".join(replaced(rng, w, 62 if k % 2 else 63, 100)))]
    got = near(spark, rows)
    assert got == plain_near(rows) and all(got[10 * k + 1] == 10 * k + 1 - k % 2 for k in range(30))


def test_near_copies_by_fingerprint(spark, docs):
    """Texts whose fingerprints are within 2 bits are near copies even if their sets of shingles are not alike; the rest is as before."""
    body = [f"w{k % 40}" for k in range(4000)]  # the few shingles of the middle are most of the text, yet under 0.8 of the set
    rows = [(7000 + i, " ".join([*(f"a{i}x{k}" for k in range(8)), *body])) for i in range(12)]
    rng = random.Random(11)
    w = [f"v{rng.randrange(10**9)}" for _ in range(300)]
    rows += [(8000, " ".join(w)), (8001, " ".join(replaced(rng, w, 28, 100)))]  # similar, with fingerprints far apart
    rows += [(r.doc_id, r.text or "") for r in docs.collect()]
    sets = {i: shingle_set(t) for i, t in rows}
    f = {i: simhash.fingerprint(t.encode()) for i, t in rows}
    by_bits = {(i, j) for i in f for j in f if i < j and (f[i] ^ f[j]).bit_count() <= 2}
    by_sets = {(i, j) for i in f for j in f if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert any(p[0] >= 7000 for p in by_bits - by_sets) and (8000, 8001) in by_sets - by_bits
    got = near(spark, rows)
    assert got == components(by_bits | by_sets, list(f))
    kept = {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(got.values())
    own = {r.id: r.component_id for r in simhash.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert max(Counter(own[i] for i in kept).values()) == 1  # no two of a group of op6 stay


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 16))
    x = np.concatenate([base, base[:80] + rng.normal(size=(80, 16)) * 0.08, np.repeat(base[:3], 40, 0), base[:5] * 3])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (9003, [1.0, None] * 8), (9004, [float("inf")] * 16), (9005, []), (9006, [1.0, 2.0]), (9007, [2.0, 4.0]), (None, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = u @ u.T >= 0.95
    np.fill_diagonal(hit, False)
    want = components(list(zip(*(a.tolist() for a in np.nonzero(hit)))) + [(9006, 9007)], [r[0] for r in rows if r[0] is not None])
    for cell, block in ((8192, 8192), (40, 16)):
        got = {r.id: r for r in semdedup.near_duplicates(df, per_cell=cell, block=block).collect()}
        assert {i: r.component_id for i, r in got.items()} == want
        assert all(got[i].n_links == n for i, n in enumerate(hit.sum(1))) and got[9006].n_links == 1 and got[9001].n_links == 0
        assert all(r.kept == (r.id == r.component_id) for r in got.values())
    assert semdedup.near_duplicates(df.where("false")).count() == 0


def plain_repeats(rows, window=50):
    first, words = {}, [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    for i, w in words:
        keep = [True] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                keep[k : k + window] = [False] * window
        kept = [x for x, q in zip(w, keep) if q]
        yield i, len(w), len(w) - len(kept), b" ".join(kept).decode()


@pytest.mark.parametrize("rounds,cap", [(7, 12), (2, 30)])
def test_repeats(spark, awkward, empty, rounds, cap):
    rng = random.Random(8)
    passage = [f"p{rng.randrange(30)}" for _ in range(130)]
    rows = [(100 + k, " ".join([f"q{rng.randrange(9)}" for _ in range(rng.randint(0, 80))] + passage[rng.randint(0, 60) : rng.randint(60, 130)] + ["z"] * rng.randint(0, 120))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(awkward.select("doc_id", "text"))
    got = Counter((r.id, r.n_words, r.n_removed, r.kept) for r in substring.drop_repeats(df, rounds=rounds, cap=cap).collect())
    assert got == Counter(plain_repeats([(r.doc_id, r.text) for r in df.collect() if r.doc_id is not None]))
    assert substring.drop_repeats(empty).count() == 0


def test_toxicity(spark, awkward, empty):
    sf = "/root/testdata/sf0.1"
    scored = Q.op9_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    n = Counter((r.toxic, r.predicted) for r in scored.collect())
    assert n[1, 1] / (n[1, 1] + n[1, 0]) > 0.85 and n[0, 1] / (n[0, 1] + n[0, 0]) < 0.05
    assert toxicity.fit([], ["a"], 0.1).score("a", {}) == pytest.approx(0.1, abs=0.01)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(empty, labels, F.lit(True))
    assert toxicity.score(awkward, model, out="s").where("s >= 0.3").count() == 0 and toxicity.score(empty, model, out="s").count() == 0


def test_overlaps(spark, docs, awkward, empty):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    norm = lambda t: " " + " ".join(re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", t.lower())) + " "
    texts = {r.doc_id: norm(r.text) for r in docs.collect()}
    exact = {(i, b.item_id) for i, t in texts.items() for b in bench.collect() if norm(b.text) in t}
    found = decontam.overlaps(docs, bench).collect()
    assert exact <= {(r.id, r.item) for r in found} and all(r.n_equal >= 0.8 * (r.stop - r.begin) and r.stop - r.begin >= min(13, r.item_words) for r in found)
    rng = random.Random(9)
    probe = [f"b{i}" for i in range(40)]
    changed = []
    for k in range(100):
        w = list(probe)
        for i in rng.sample(range(40), 5):
            w[i] = f"c{rng.randrange(10**6)}"
        changed.append((k, " ".join([f"d{rng.randrange(10**6)}" for _ in range(30)] + w)))
    df = spark.createDataFrame(changed, "doc_id long, text string")
    one = spark.createDataFrame([(1, " ".join(probe)), (2, None), (3, ""), (None, "x")], "item_id long, text string")
    assert len({r.id for r in decontam.overlaps(df, one).collect()}) >= 97
    assert decontam.overlaps(awkward, one).count() == 0 and decontam.overlaps(empty, one).count() == 0 and decontam.overlaps(df, one.where("false")).count() == 0


def test_pipeline_batches(spark):
    """Stages hand texts to Python in batches of at most 512 rows; what the caller set lower stays."""
    import corpus_pipeline as C

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    def run(batches):
        yield from (pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int32())}) for b in batches)

    try:
        for own, most in ((10_000, 512), (0, 512), (100, 100)):
            spark.conf.set(key, own)
            C.encode(spark, spark.range(1).selectExpr("id AS doc_id", "'a' AS text"), SF)
            sizes = [r.n for r in spark.range(0, 3000, 1, 1).mapInArrow(run, "n int").collect()]
            assert sum(sizes) == 3000 and max(sizes) == most
    finally:
        spark.conf.set(key, before)


def test_pipeline(spark):
    import corpus_pipeline as C

    documents = spark.read.parquet(f"{SF}/documents.parquet")
    docs = documents
    for name, stage in C.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF).cache()
        assert docs.columns == documents.columns
        a, b = ({r.doc_id: r.text for r in x.collect()} for x in (before, docs))
        assert set(b) <= set(a)
        if name == "secrets":
            assert set(a) == set(b) and not any(plain_secrets(t) for t in b.values())
        if name == "decontamination":
            gone = {r.id for r in decontam.overlaps(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            assert set(a) - set(b) == gone
        if name == "simhash_dedup":
            assert len(set(b.values())) == len(b)
    out = C.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id: r.decoded_sha256 for r in out} == {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in docs.collect()}
    assert sorted(r.doc_id for r in C.run(spark, SF).collect()) == sorted(r.doc_id for r in out)
