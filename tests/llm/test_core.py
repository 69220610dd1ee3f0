"""Building blocks against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegrid.llm import bpe, decontam, packing, recompress, semdedup, simhash, toxicity
from tidegrid.llm.eliasfano import EliasFano
from tidegrid.llm.tokens import split_words

TEXTS = st.lists(st.text(alphabet="aB \t\n é1!.", max_size=40), max_size=12)


@given(TEXTS, st.integers(1, 50))
@settings(max_examples=60, deadline=None)
def test_words_are_those_of_split(texts, step):
    hashes, got = {}, []
    for w in split_words(pa.array(texts, pa.string()), lower=True, step=step):
        raw, h = w.data.tobytes(), w.hashes()
        for i in range(w.rows.stop - w.rows.start):
            words = [raw[s:e] for s, e in zip(w.starts[w.first[i] : w.first[i + 1]], w.ends[w.first[i] : w.first[i + 1]])]
            got.append(words)
            for k, x in zip(h[w.first[i] : w.first[i + 1]], words):
                assert hashes.setdefault(x, k) == k
    assert got == [t.encode().lower().split() for t in texts] and len(set(hashes.values())) == len(hashes)


@given(st.lists(st.integers(0, 3), max_size=300), st.integers(1, 9), st.integers(2, 9))
@settings(max_examples=60, deadline=None)
def test_equal_windows_share_an_anchor(words, rounds, cap):
    """Two rows with a common stretch of a window's length name it alike, whatever stands around it."""
    window = 20
    rng = random.Random(len(words))
    shared = [rng.randrange(4) for _ in range(window)]
    rows = [words[:97] + shared + words[50:], words[11:40] + shared, shared]
    flat = np.array([x for r in rows for x in r], np.uint64)
    first = np.cumsum([0] + [len(r) for r in rows])
    a = recompress.anchors(flat, first, window, rounds, cap)
    at = [len(words[:97]), first[1] + len(words[11:40]), first[2]]
    names = [{n for n, lo, hi in zip(a.name, a.lo, a.hi) if lo <= w <= hi} for w in at]
    assert names[0] & names[1] & names[2]


@given(st.lists(st.integers(0, 10_000), min_size=1, max_size=400), st.integers(0, 10**6))
@settings(max_examples=60, deadline=None)
def test_elias_fano(values, more):
    v = np.unique(np.array(values, np.uint64))
    e = EliasFano.build(v, 10_000 + more)
    q = np.arange(0, 10_000, 37, dtype=np.uint64)
    assert (e.values() == v).all() and (e.get(np.arange(len(v))) == v).all()
    lo, hi = np.full(len(q), len(v) // 3), np.full(len(q), len(v) - len(v) // 4)
    assert (e.successor(q, lo, hi) == np.clip(np.searchsorted(v, q), lo, hi)).all()
    assert ((e.find(q, lo, hi) >= 0) == np.isin(q, v[len(v) // 3 : len(v) - len(v) // 4])).all()
    assert (e.successor(q) == np.searchsorted(v, q)).all()
    assert (e.find(q) >= 0).tolist() == np.isin(q, v).tolist()
    assert (e.find(v) == np.arange(len(v))).all()


def test_elias_fano_of_equal_and_no_values():
    assert EliasFano.build(np.zeros(0, np.uint64), 5).find(np.array([3], np.uint64)).tolist() == [-1]
    e = EliasFano.build(np.array([2, 2, 2, 7], np.uint64), 9)
    assert e.successor(np.array([0, 2, 3, 8], np.uint64)).tolist() == [0, 0, 3, 4] and e.get(np.arange(4)).tolist() == [2, 2, 2, 7]


def test_bpe_is_merging():
    ranks = {bytes([i]): i for i in range(256)}
    for k, t in enumerate((b"ab", b"bc", b"abc", b"cd", b"aa", b"aaaa", b"bcd", b"zq", b"qzq")):
        ranks[t] = 256 + k
    b = bpe.Bpe(ranks, r"\S+|\s+")
    rng = random.Random(3)
    for _ in range(2000):
        piece = bytes(rng.choice(b"abcdzq") for _ in range(rng.randint(1, 12)))
        want = [ranks[piece]] if piece in ranks else b.merge(piece)
        assert b.encode_piece(piece) == want, piece


def test_bpe_is_tiktoken():
    public = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = public.path("byte_bpe_multi_50k.tiktoken")
    b = bpe.loaded(path, public.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=b.ranks, special_tokens={})
    rng = random.Random(1)
    texts = ["", " ", "a" * 4000, " " * 999, "x\x1c y", "it's  \n\n 12,5 日本語 ſ😀"] + ["".join(rng.choice("ab  \n\t\x85é'sıλ12.!日ſ😀") for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    for t in texts:
        ids = b.encode(t)
        assert list(memoryview(ids).cast("I")) == enc.encode_ordinary(t), repr(t)
        assert b.decode(ids) == t.encode()
    small = bpe.Bpe(b.ranks, public.PATTERN)
    small.piece.most = small.chunk.most = small.fits.most = 3  # memo tables that start anew change nothing
    assert all(small.encode(t) == b.encode(t) for t in texts[:300])


@given(st.lists(st.integers(1, 16), max_size=80))
@settings(max_examples=80, deadline=None)
def test_best_fit(sizes):
    rows = packing.best_fit(sizes, 16)
    assert sorted(i for r in rows for i in r) == list(range(len(sizes))) and all(sum(sizes[i] for i in r) <= 16 for r in rows)
    plain: list[int] = []
    for n in sorted(sizes, reverse=True):
        fits = [(16 - s, k) for k, s in enumerate(plain) if s + n <= 16]
        if fits:
            plain[min(fits)[1]] += n
        else:
            plain.append(n)
    assert sorted(plain) == sorted(sum(sizes[i] for i in r) for r in rows)


@given(st.lists(st.integers(1, 16), max_size=200))
@settings(max_examples=150, deadline=None)
def test_plan_is_best_fit(sizes):
    """Runs of rows take what best fit gives to rows one by one; every segment has a place of its own."""
    from collections import Counter, defaultdict

    rows = defaultdict(dict)
    for n, k, row, per, slot, stop in packing.plan(dict(Counter(sizes)), 16).tolist():
        for i in range(k, stop):
            r, place = row + (i - k) // per, slot + (i - k) % per
            assert place not in rows[r]
            rows[r][place] = (n, i)
    assert sorted(x for r in rows.values() for x in r.values()) == sorted((n, i) for n, c in Counter(sizes).items() for i in range(c))
    assert sorted(rows) == list(range(len(rows))) and all(sorted(r) == list(range(len(r))) for r in rows.values())
    plain = packing.best_fit(sizes, 16)
    assert sorted(sum(n for n, _ in r.values()) for r in rows.values()) == sorted(sum(sizes[i] for i in r) for r in plain)


def test_fingerprint_by_hand():
    import xxhash

    t = "One two  THREE four\ttwo three four five"
    w = t.lower().split()
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(len(w) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint(t.encode()) == want
    assert simhash.fingerprint(b" \n") == 0 and simhash.fingerprint(b"A b") == xxhash.xxh64_intdigest(b"a b", 42)


def test_sketches_keep_similar_sets():
    """Sets at the limit of similarity share far more of their sketches than the least that is asked for; far sets share less."""
    rng = np.random.default_rng(0)
    shared = []
    for common, own in ((1600, 200), (300, 1500)):
        for _ in range(200):
            x = rng.integers(0, 2**63, common + 2 * own, dtype=np.uint64)
            a, b = np.sort(x[: common + own]), np.sort(np.concatenate([x[:common], x[common + own :]]))
            shared.append(len(np.intersect1d(a[: simhash.SKETCH], b[: simhash.SKETCH])))
    least = (0.8 - simhash.MARGIN) * simhash.SKETCH
    assert min(shared[:200]) >= least and max(shared[200:]) < least


def test_risk_is_the_class_risk():
    rng = np.random.default_rng(1)
    pos, neg = rng.normal(2, 1, 4000), rng.normal(-2, 1, 36000)
    positive, negative, _, _ = toxicity.risk(pos, np.concatenate([pos, neg]), 0.1)
    loss = lambda z: np.logaddexp(0, -z).mean()
    assert positive == pytest.approx(0.1 * loss(pos)) and negative == pytest.approx(0.9 * loss(-neg), rel=1e-6)


def test_local_roots():
    i, j = np.array([1, 2, 5, 4]), np.array([2, 3, 6, 5])
    assert semdedup.local_roots(i, j, 8).tolist() == [0, 1, 1, 1, 4, 4, 4, 7]


def test_longest_overlap():
    run = decontam._verify(5, 0.8)
    words = "a b c d e f g h i j k l".split()
    changed = "x x a b c d e f z h i j k l y".split()
    b = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([[2, -3]]), pa.array([" ".join(changed).encode()]), pa.array([" ".join(words).encode()])], ["id", "item", "shifts", "text", "probe"])
    out = next(run([b])).to_pylist()
    assert out == [{"id": 1, "item": 2, "begin": 2, "stop": 14, "n_equal": 11, "item_words": 12}]
