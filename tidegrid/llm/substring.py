"""Removal of long word sequences that an earlier document already has."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.recompress import anchors
from tidegrid.llm.store import cut, drop, id_filter
from tidegrid.llm.tokens import mix, split_words

_P = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))


def _powers(p: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, p, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def window_hashes(h: np.ndarray, first: np.ndarray, rows: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for the windows that start at words ``rows``: two polynomials of the words' hashes."""
    out = []
    for k, p in enumerate(_P):
        inverse = np.uint64(pow(int(p), -1, 1 << 64))
        x = h if k == 0 else mix(h ^ p)
        c = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(x * _powers(p, len(h))[:-1], out=c[1:])
        out.append((c[rows + window] - c[rows]) * _powers(inverse, len(h))[rows])
    return out[0], out[1]


def _anchor_rows(window: int, rounds: int, cap: int):
    def run(batches):
        for b in batches:
            for w in split_words(b.column(2), lower=False):
                if not len(w.starts):
                    continue
                a = anchors(w.hashes(), w.first, window, rounds, cap)
                of = pa.array(a.row + w.rows.start)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.name.view(np.int64)), b.column(0).take(of), b.column(1).take(of), pa.array((a.lo - w.first[a.row]).astype(np.int32)), pa.array((a.hi - w.first[a.row]).astype(np.int32))],
                    ["name", "id", "mark", "a", "b"],
                )

    return run


def _window_rows(window: int):
    def run(batches):
        for b in batches:
            spans = b.column(3)
            for w in split_words(b.column(2), lower=False):
                h = w.hashes()
                n = len(h)
                mark = np.zeros(n + 1, np.int64)
                part = spans.slice(w.rows.start, w.rows.stop - w.rows.start)
                of = np.repeat(w.first[:-1], np.diff(part.offsets.to_numpy()))
                flat = part.flatten()
                np.add.at(mark, flat.field("a").to_numpy() + of, 1)
                np.add.at(mark, flat.field("b").to_numpy() + of + 1, -1)
                at = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
                row = w.row_of_word()[at]
                of = pa.array(row + w.rows.start)
                x, y = window_hashes(h, w.first, at, window)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.view(np.int64)), pa.array(y.view(np.int64)), b.column(0).take(of), b.column(1).take(of), pa.array((at - w.first[row]).astype(np.int32))],
                    ["x", "y", "id", "mark", "at"],
                )

    return run


def _kept(b: pa.RecordBatch, window: int, texts: bool) -> pa.RecordBatch:
    """Columns id, text, whole (all of a text of ``window`` or more words goes), gone (packed first words of windows that go)."""
    n_words, n_removed, out = [], [], []
    for w in split_words(b.column(1), lower=False):
        raw = w.data.tobytes()
        for i in range(w.rows.stop - w.rows.start):
            r = w.rows.start + i
            s, e = w.starts[w.first[i] : w.first[i + 1]], w.ends[w.first[i] : w.first[i + 1]]
            keep = np.ones(len(s), bool)
            if b.column(2)[r].as_py() and len(s) >= window:
                keep[:] = False
            gone = b.column(3)[r].as_py()
            if gone:
                mark = np.zeros(len(s) + 1, np.int64)
                np.add.at(mark, gone, 1)
                np.add.at(mark, np.add(gone, window), -1)
                keep &= np.cumsum(mark[:-1]) == 0
            n_words.append(len(s))
            n_removed.append(int((~keep).sum()))
            k = np.flatnonzero(keep)
            out.append(b" ".join([raw[x:y] for x, y in zip(s[k].tolist(), e[k].tolist())]))
    last = pa.array(out, pa.binary()).cast(pa.string()) if texts else pa.array([hashlib.sha256(x).hexdigest() for x in out], pa.string())
    return pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), last], ["id", "n_words", "n_removed", "kept"])


def drop_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, rounds: int = 7, cap: int = 12, texts: bool = True
) -> DataFrame:
    """(id, n_words, n_removed, kept): texts without the words of windows that also start in a text with a smaller id.

    Words are runs of bytes other than space and \\x09-\\x0D. ``kept`` is the remaining words joined by one space, or its
    SHA-256 in hex with texts=False. Null and empty texts have no words. Rows with a null id are dropped. Rows that
    share an id are one document's: none of them removes words of another, and each is judged by its own text (a row is
    known by its id and a hash of its text). An empty table gives no rows.

    1. Recompression (see recompress) names each text's symbols and picks one for every window, alike for equal windows.
    2. Names that occur in two different texts are found by aggregation; the windows that hold them are candidates.
    3. Candidates are verified by 128 bits over all their words; the smallest id of each is found by aggregation.
    Equal texts are one candidate, the first; the rest go whole if long enough. ``rounds`` and ``cap`` (words in a
    symbol) decide the cost only: any values give the same result.

    What an aggregation finds about a name or a window is written before it is joined back: both sides then come from exchanges
    of their own, and adaptive execution can split one that a very common passage fills.
    """
    text = F.col(text_col).cast("binary")
    d = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text, F.lit(b""))).alias("mark"), text.alias("text"))
    kind = d.schema["id"].dataType.simpleString()
    row = ["id", "mark"]
    named = cut(d.mapInArrow(_anchor_rows(window, rounds, cap), f"name long, id {kind}, mark long, a int, b int"), "anchors")
    shared = cut(named.groupBy("name").agg(F.min("mark").alias("lo"), F.max("mark").alias("hi")).where("lo <> hi").select("name"), "shared")
    whole = d.select(*row, F.sha2(F.coalesce("text", F.lit(b"")), 256).alias("sha"))
    first = cut(whole.groupBy("sha").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("sha", "first"), "first")
    copies = cut(whole.join(first, "sha").where("id <> first").select(*row).distinct(), "copies")
    spans = named.join(shared, "name").select(*row, "a", "b").join(copies, row, "left_anti")
    spans = cut(spans.groupBy(*row).agg(F.collect_set(F.struct("a", "b")).alias("spans")), "spans")
    look = d.where(id_filter(spans, *row)).join(spans, row).select(*row, "text", "spans")
    wins = cut(look.mapInArrow(_window_rows(window), f"x long, y long, id {kind}, mark long, at int"), "windows")
    least = cut(wins.groupBy("x", "y").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("x", "y", "lo"), "least")
    gone = wins.join(least, ["x", "y"]).where("id > lo").groupBy(*row).agg(F.collect_set("at").alias("gone"))
    gone = gone.select(*row, F.lit(False).alias("whole"), "gone")
    gone = cut(gone.unionByName(copies.select(*row, F.lit(True).alias("whole"), F.lit(None).cast("array<int>").alias("gone"))), "gone")
    for done in (named, shared, first, copies, spans, wins, least):
        drop(done)
    schema = f"id {kind}, n_words long, n_removed long, kept string"
    run = lambda batches: (_kept(b, window, texts) for b in batches)
    plain = d.where(~id_filter(gone, *row)).select("id", "text", F.lit(False).alias("whole"), F.lit(None).cast("array<int>").alias("gone"))
    hit = d.where(id_filter(gone, *row)).join(gone, row, "left").select("id", "text", "whole", "gone")
    return plain.mapInArrow(run, schema).unionByName(hit.mapInArrow(run, schema))
