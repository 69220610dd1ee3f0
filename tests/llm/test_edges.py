"""Cases that tables seldom hold: repeated ids with different texts, ids of other types, hot keys, tokens and pieces without end."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.test_queries import plain_repeats
from tidegrid.llm import decontam, kdshard, semdedup, simhash, substring

A, B, C = (" ".join(f"{x}{i}" for i in range(n)) for x, n in (("a", 60), ("b", 60), ("c", 70)))


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize(
    "rows",
    [
        [(1, A), (2, A), (2, B)],
        [(1, "x " + A), (2, "y " + A + " z"), (2, C)],
        [(1, A), (2, A.replace(" ", "\n "))],
        [(1, A + " " + B), (2, B), (2, B), (2, "q " + B), (3, None), (3, "")],
        [(k, f"u{k} " + A + f" v{k}") for k in range(300)],
    ],
)
def test_repeats_by_row(spark, rows, kind):
    """Rows of one id are judged each by its own text; equal words in other white space are equal; one passage in all rows."""
    rows = [(f"{i:05d}" if kind == "string" else i, t) for i, t in rows]
    got = substring.drop_repeats(spark.createDataFrame(rows, f"doc_id {kind}, text string"))
    assert Counter((r.id, r.n_words, r.n_removed, r.kept) for r in got.collect()) == Counter(plain_repeats(rows))


def plain_tree(rows, dims, shards):
    """{row: shard} of rows (key, size, tie, c0, c1, ...): each list halved at its weighted median along its widest dimension."""
    if shards == 1 or not rows:
        return {r[0]: 0 for r in rows}
    spread = [max(r[3 + i] for r in rows) - min(r[3 + i] for r in rows) for i in range(dims)]
    axis = spread.index(max(spread))
    rows = sorted(rows, key=lambda r: (r[3 + axis], r[2]))
    left = -(-shards // 2)
    want, total = sum(r[1] for r in rows) * (left / shards), 0
    for k, r in enumerate(rows):
        if total + r[1] >= want:
            k += 0 if total > 0 and want - total < total + r[1] - want else 1
            break
        total += r[1]
    right = plain_tree(rows[k:], dims, shards - left)
    return plain_tree(rows[:k], dims, left) | {r: left + s for r, s in right.items()}


@pytest.mark.parametrize("shards", [1, 5, 8, 12])
def test_tree_equals_a_plain_one(spark, monkeypatch, shards):
    monkeypatch.setattr(kdshard, "_COPIES", 16)
    monkeypatch.setattr(kdshard, "_BUCKETS", 64)
    docs = spark.createDataFrame([(i % 400, "t" * (i * 7919 % 300), i * 31 % 17, float(i % 5) if i % 9 else None) for i in range(900)] + [(1, "same", 3, 2.0)] * 100, "doc_id long, text string, a int, b double")
    dims = ["a", "b"]
    rows = [tuple(r) for r in kdshard._rows(docs, dims, "doc_id", "text").select("id", "text_crc32", "tie", "size", "c0", "c1").collect()]
    want = plain_tree([((i, crc, n), size, tie, *c) for n, (i, crc, tie, size, *c) in enumerate(rows)], 2, shards)
    got = kdshard.shard(docs, dims, shards=shards).collect()
    assert Counter((r.id, r.text_crc32, r.shard) for r in got) == Counter((i, crc, s) for (i, crc, _), s in want.items())
    assert all(sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got))) for k in range(shards))


def test_repeated_rows_are_split(spark):
    """700 of 1,000 rows are one row; the law holds all the same."""
    rows = [(1, "same text", "en")] * 700 + [(i, "other text", "de") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sums = [r[1] for r in kdshard.shard(docs, ["lang"], shards=16).groupBy("shard").sum("size").collect()]
    assert len(sums) == 16 and max(sums) - min(sums) <= 4 * 11
    with pytest.raises(ValueError):
        kdshard.shard(docs, ["lang"])


def test_one_row_of_a_group_stays(spark):
    """Repeated rows, two texts under one id, a copy under another id, a null id."""
    near = A.replace("a7 ", "changed ")
    rows = [(5, A), (5, A), (5, B), (6, near), (7, B), (8, C), (8, A), (None, A), (None, A), (9, None), (9, "")]
    for kind in ("long", "string"):
        docs = spark.createDataFrame([(i if i is None or kind == "long" else str(i), t, "x") for i, t in rows], f"doc_id {kind}, text string, first string")
        got = [(r.doc_id and int(r.doc_id), r.text or "") for r in simhash.drop_near_copies(docs).collect()]
        assert sorted(got, key=str) == sorted([(5, A), (5, B), (8, C), (None, A), (None, A), (9, "")], key=str)


def fits(stretch, mask):
    return sum(all(stretch[i + j] for j, c in enumerate(mask) if c == "1") for i in range(len(stretch) - len(mask) + 1))


def test_masks_miss_no_passage():
    """Every way to change words of a short item or of a passage: a mask fits, and for passages masks fit as often as is asked for."""
    for n in range(1, 19):
        least = math.ceil(0.8 * n - 1e-9)
        for changed in (c for k in range(n - least + 1) for c in itertools.combinations(range(n), k)):
            same = [i not in changed for i in range(n)]
            hits = sum(fits(same, m) for m in decontam.MASKS)
            if n < 13:
                assert hits or any(fits(same, m) for m in decontam.SHORT.get(n, ()))
            else:
                assert hits >= decontam.SUPPORT


def plain_overlaps(texts, probes):
    """{(id, item): most equal words of a passage} by all alignments and all stretches."""
    words = lambda t: re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", (t or "").lower())
    out = {}
    for (i, t), (k, q) in itertools.product(texts, probes):
        w, p = words(t), words(q)
        need = min(13, len(p))
        for shift in range(1 - len(p), len(w)) if p else ():
            same = np.cumsum([0] + [w[shift + j] == p[j] for j in range(len(p)) if 0 <= shift + j < len(w)])
            size = np.arange(len(same))
            equal, length = same[None] - same[:, None], size[None] - size[:, None]
            good = equal[(length >= need) & (equal >= 0.8 * length - 1e-9) & (equal > 0)]
            if len(good):
                out[i, k] = max(out.get((i, k), 0), int(good.max()))
    return out


def test_overlaps_equal_all_alignments(spark):
    """Probes of 1 to 40 words, changed words anywhere, ends too; repetitive texts; a text of one word."""
    rng = random.Random(11)
    probes = [(n, " ".join(f"p{n}x{rng.randrange(6 if n % 5 == 0 else 10**6)}" for _ in range(n))) for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 20, 25, 30, 40)]
    texts = []
    for n, q in probes:
        for k in range(12):
            w = q.split()
            for i in rng.sample(range(n), min(n, rng.randint(0, math.ceil(0.3 * n)))):
                w[i] = f"c{rng.randrange(10**6)}"
            texts.append((100 * n + k, " ".join([f"d{rng.randrange(10**6)}" for _ in range(rng.randint(0, 9))] + w + [f"d{rng.randrange(10**6)}" for _ in range(rng.randint(0, 9))])))
    texts += [(9000, probes[4][1].split()[0] + " " + probes[9][1] * 30), (9001, "P1x0 p1X0"), (9002, probes[0][1])]
    got = decontam.overlaps(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(probes, "item_id long, text string")).collect()
    assert {(r.id, r.item): r.n_equal for r in got} == plain_overlaps(texts, probes)
    lengths = {n: len(q.split()) for n, q in probes}
    assert len(got) > 100 and all(r.n_equal >= 0.8 * (r.stop - r.begin) - 1e-9 and r.stop - r.begin >= min(13, lengths[r.item]) == min(13, r.item_words) for r in got)


def test_links_count_for_both(spark):
    """With a bounded number of cells looked into, a link found from one side counts for both, and nearly all are found."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 24))
    x = np.concatenate([x, x[:700] + rng.normal(size=(700, 24)) * 0.2])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = u @ u.T >= 0.95
    np.fill_diagonal(hit, False)
    for probes, share in ((40, 1.0), (8, 0.98), (3, 0.9)):
        got = {r.id: r.n_links for r in semdedup.near_duplicates(df, per_cell=60, block=30, probes=probes).collect()}
        n = np.array([got[i] for i in range(len(x))])
        assert (n <= hit.sum(1)).all() and n.sum() >= share * hit.sum() and n.sum() % 2 == 0
