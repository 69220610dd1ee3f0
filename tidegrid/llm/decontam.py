"""Benchmark decontamination by spaced seeds."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.store import cut, drop, id_filter
from tidegrid.llm.tokens import keep_only, mix, split_words

#: Token positions that count (1) and that are ignored (0). An aligned stretch of 13 words or more of which 80 % are equal has
#: four equal words in a row, or else all its equal words in runs of three between single others, so one of these masks
#: always fits; together they fit it in two places or more.
MASKS = ("1111", "1110111")
SUPPORT = 2
#: Masks of items of so many words, all of which must be aligned; what these lack the masks above find.
SHORT = {1: ("1",), 2: ("11",), 3: ("111",), 5: ("11011", "11101", "10111"), 6: ("111011", "110111"), 10: ("1110110111",)}

#: A word, as split_words(alnum=True) has it.
_WORDS = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_P = np.uint64(0x9E3779B97F4A7C15)


def _seed_rows(masks: tuple[str, ...], table: np.ndarray | None, short: dict[int, tuple[str, ...]]):
    """Rows (seed, id, at, words): the masked hashes of a text's words and how many words it has. With a table, those whose slot in it is
    set, for all masks; without, those of ``short`` masks for texts of just so many words only."""
    small = {m: n for n, ms in short.items() for m in ms if m not in masks}

    def run(batches):
        keep_only("decontam", lambda: None)
        for b in batches:
            ids = b.column(0)
            for w in split_words(b.column(1), lower=False, alnum=True):
                h, row = w.hashes(), w.row_of_word()
                words = np.diff(w.first)
                for mask in (*masks, *small):
                    n = len(h) - len(mask) + 1
                    if n <= 0:
                        continue
                    x = np.full(n, mix(np.full(1, int("1" + mask, 2), np.uint64))[0])
                    for j, c in enumerate(mask):
                        if c == "1":
                            x = (x ^ h[j : j + n]) * _P
                            x ^= x >> np.uint64(29)
                    ok = row[:n] == row[len(mask) - 1 :]
                    if table is not None:
                        slot = x >> np.uint64(40)
                        ok &= (table[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                    elif mask in small:
                        ok &= words[row[:n]] == small[mask]
                    at = np.flatnonzero(ok)
                    if len(at):
                        of = ids.slice(w.rows.start, w.rows.stop - w.rows.start).take(pa.array(row[at]))
                        yield pa.RecordBatch.from_arrays([pa.array(x[at].view(np.int64)), of, pa.array((at - w.first[row[at]]).astype(np.int32)), pa.array(words[row[at]].astype(np.int32))], ["seed", "id", "at", "words"])

    return run


def _seeds(rows: DataFrame, masks: tuple[str, ...], short: dict[int, tuple[str, ...]], table: np.ndarray | None = None) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_seed_rows(masks, table, short), f"seed long, id {kind}, at int, words int")


def slot_table(seeds: DataFrame) -> np.ndarray:
    """2^24 bits, one set for the upper bits of each seed: 2 MB, however many seeds there are."""
    slot = F.shiftrightunsigned("seed", 40)
    rows = seeds.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftrightunsigned(seed, 40) & 63 as int))")).alias("m")).collect()
    words = np.zeros(1 << 18, np.int64)
    for r in rows:
        words[r["w"]] = r["m"]
    return words.view(np.uint8)


def _verify(min_words: int, share: float):
    """Columns id, item, shift, text, probe: aligned words of text and probe around the seeds, mismatches allowed."""

    def best(same: np.ndarray) -> tuple[int, int, int]:
        """(agreeing words, begin, end) of the longest stretch that begins and ends with agreement and agrees in ``share`` of its words."""
        at = np.flatnonzero(same)
        top = (0, 0, 0)
        if len(at):
            # A stretch from agreement i to j has j-i+1 agreeing of at[j]-at[i]+1 words: with v = k+1 - share*at the first
            # must not exceed the last's. Prefix minima of v make the widest pair a two-pointer walk.
            v = np.arange(len(at)) - share * at
            left = np.minimum.accumulate(v)
            slack = 1 - share
            for j in range(len(at) - 1, -1, -1):
                if j + 1 <= top[0]:
                    break
                i = int(np.searchsorted(-left, -(v[j] + slack + 1e-9), "left"))
                if i <= j and j - i + 1 > top[0]:
                    top = (j - i + 1, int(at[i]), int(at[j]) + 1)
        return top

    def run(batches):
        for b in batches:
            out = []
            for id_, item, shifts, text, probe in zip(*(b.column(k).to_pylist() for k in range(5))):
                w, p = _WORDS.findall(text), _WORDS.findall(probe)
                top, need = (0, 0, 0), min(min_words, len(p))
                for s in shifts:
                    lo, hi = max(0, -s), min(len(p), len(w) - s)
                    if hi - lo <= top[0]:
                        continue
                    n, x, y = best(np.fromiter((w[s + i] == p[i] for i in range(lo, hi)), bool, hi - lo))
                    # Past its last agreeing words a stretch goes on while the share holds, if that makes it long enough.
                    if n > top[0] and n >= max(1, share * need - 1e-9) and hi - lo >= need and int(n / share + 1e-9) >= need:
                        y = max(y, min(hi - lo, x + need))
                        top = (n, s + lo + min(x, y - need), s + lo + y)
                if top[0]:
                    out.append((id_, item, top[1], top[2], top[0], len(p)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, (b.schema.field(0).type, b.schema.field(1).type, pa.int32(), pa.int32(), pa.int32(), pa.int32()))], ["id", "item", "begin", "stop", "n_equal", "item_words"])

    return run


def overlaps(
    docs: DataFrame, probes: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", probe_col: str = "text",
    masks: tuple[str, ...] = MASKS, support: int = SUPPORT, min_words: int = 13, share: float = 0.8,
) -> DataFrame:
    """(id, item, begin, stop, n_equal, item_words): texts that hold a passage of a probe, and the longest such passage.

    A passage is an aligned stretch of ``min_words`` words (the whole probe if shorter) or more of which ``share`` or more
    are equal; words are runs of letters and digits (of any alphabet) in lower case. Empty and null texts and probes
    match nothing; rows with a null id are dropped; repeated ids count as one text each, a repeated probe as one.

    Fixed masks choose the words that are hashed, so a substituted word between them does not hide a passage. With the default
    masks, min_words and share none is missed, of probes of any length. A bit map of 2 MB (its size does not depend on the
    probes) drops most training hashes where they arise; the rest join the probes' hashes by an ordinary equi-join, of
    which adaptive execution can split a frequent hash; alignments with ``support`` hits (one for probes shorter than
    min_words) are verified word by word on the texts.
    """
    d = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(F.lower(text_col), F.lit("")).cast("binary").alias("text"))
    p = probes.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("id"), F.coalesce(F.lower(probe_col), F.lit("")).cast("binary").alias("text")).distinct()
    seeds = cut(_seeds(p, masks, SHORT), "seeds")
    table = slot_table(seeds)
    present = {r.words for r in seeds.where(F.col("words") < min_words).select("words").distinct().collect()}  # at most min_words - 1 numbers
    keys = seeds.select("seed", F.col("id").alias("item"), F.col("at").alias("from"), F.when(F.col("words") < min_words, 1).otherwise(support).alias("support")).distinct()
    hits = _seeds(d, masks, {n: m for n, m in SHORT.items() if n in present}, table).join(keys, "seed").groupBy("id", "item", (F.col("at") - F.col("from")).alias("shift"))
    hits = hits.agg(F.count("*").alias("n"), F.min("support").alias("support")).where("n >= support")
    hits = cut(hits.groupBy("id", "item").agg(F.collect_list("shift").alias("shifts")), "hits")
    drop(seeds)
    pairs = d.where(id_filter(hits, "id")).join(hits, "id").join(p.select(F.col("id").alias("item"), F.col("text").alias("probe")), "item")
    kinds = (d.schema["id"].dataType.simpleString(), p.schema["id"].dataType.simpleString())
    return pairs.select("id", "item", "shifts", "text", "probe").mapInArrow(
        _verify(min_words, share), f"id {kinds[0]}, item {kinds[1]}, begin int, stop int, n_equal int, item_words int"
    )
