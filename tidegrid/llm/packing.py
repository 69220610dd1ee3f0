"""Packing of token ids into rows of fixed length by best-fit decreasing."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.bpe import read_ranks
from tidegrid.llm.store import cut
from tidegrid.llm.tokens import slices


class Capacities:
    """Free space of open rows as a segment tree over the amounts 0..most: which is the least amount of at least n that some row has?"""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.tree = bytearray(2 * self.leaves)
        self.rows: list[list] = [[] for _ in range(most + 1)]

    def put(self, amount: int, row) -> None:
        self.rows[amount].append(row)
        i = amount + self.leaves
        while i and not self.tree[i]:
            self.tree[i] = 1
            i >>= 1

    def least(self, n: int) -> int:
        """The amount, or -1."""
        tree, i = self.tree, n + self.leaves
        while not tree[i]:
            while i & 1:  # a right child: go up until there is something to the right
                i >>= 1
            if i == 0:
                return -1
            i += 1
            if i & (i - 1) == 0:  # past the last leaf of this level
                return -1
        while i < self.leaves:
            i = 2 * i if tree[2 * i] else 2 * i + 1
        return i - self.leaves

    def take(self, amount: int):
        row = self.rows[amount].pop()
        if not self.rows[amount]:
            i = amount + self.leaves
            self.tree[i] = 0
            i >>= 1
            while i and not (self.tree[2 * i] or self.tree[2 * i + 1]):
                self.tree[i] = 0
                i >>= 1
        return row


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of indices: by falling size, each into the row that it leaves the least space in; sizes are 1..length."""
    rows: list[list[int]] = []
    free = Capacities(length)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        n = sizes[i]
        amount = free.least(n)
        if amount < 0:
            rows.append([i])
            row, amount = len(rows) - 1, length
        else:
            row = free.take(amount)
            rows[row].append(i)
        if amount > n:
            free.put(amount - n, row)
    return rows


def plan(counts: dict[int, int], length: int) -> np.ndarray:
    """best_fit() of ``counts[n]`` segments of each size n, worked out for runs of equal rows: steps (n, k, row, per, slot, stop).

    Segments k..stop-1 of size n go to the rows from ``row`` on, ``per`` to each, as its segments slot, slot+1, ... A row that takes
    one is then the fullest that can take another, so rows are filled one after the other and all but the last of a run stay equal.
    Steps are bounded by ``length``, whatever the number of segments.
    """
    free = Capacities(length)
    steps: list[tuple[int, ...]] = []
    rows = 0
    for n in sorted(counts, reverse=True):
        k, end = 0, counts[n]
        while k < end:
            amount = free.least(n)
            if amount < 0:
                amount, first, slot = length, rows, 0
                many = -(-(end - k) // (length // n))
                rows += many
            else:
                first, many, slot = free.take(amount)
            per = amount // n
            full = min(many, (end - k) // per)
            rest = end - k - full * per if full < many else 0  # of the one row that is not filled
            for m, of in ((full, per), (min(rest, 1), rest)):
                if m:
                    steps.append((n, k, first, of, slot, k + m * of))
                    if amount > of * n:
                        free.put(amount - of * n, (first, m, slot + of))
                    k, first, many = k + m * of, first + m, many - m
            if many:
                free.put(amount, (first, many, slot))
    return np.array(steps, np.int64).reshape(-1, 6)


_ENCODERS: dict = {}


def _encoder(path: str, pattern: str):
    if (path, pattern) not in _ENCODERS:
        import tiktoken

        _ENCODERS[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
    return _ENCODERS[path, pattern]


def _segments(vocabulary: str, pattern: str, end_id: int, length: int):
    """Rows (id, part, n, task, nth, ids): the segments of a text, each the ``nth`` of its size in its task; ids are 16 or 32 bits wide."""

    def run(batches):
        encoder = _encoder(vocabulary, pattern)
        kind = "<u2" if max(encoder.max_token_value, end_id) < 1 << 16 else "<i4"
        task, seen = TaskContext.get().partitionId(), [0] * (length + 1)
        for b in (part for batch in batches for part in slices(batch)):
            of, part, size, nth, ids = [], [], [], [], []
            for i, t in enumerate(b.column(1)):
                x = np.array(encoder.encode_ordinary(t.as_py()) + [end_id], kind)
                for k in range(0, len(x), length):
                    y = x[k : k + length]
                    of.append(i)
                    part.append(k // length)
                    size.append(len(y))
                    nth.append(seen[len(y)])
                    ids.append(y.tobytes())
                    seen[len(y)] += 1
            columns = [b.column(0).take(pa.array(of, pa.int32())), pa.array(part, pa.int32()), pa.array(size, pa.int32()), pa.array([task] * len(of), pa.int32()), pa.array(nth, pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "part", "n", "task", "nth", "ids"])

    return run


def _pieces(steps: np.ndarray):
    """Rows (task, n, low, high, past, row, per, slot) of rows (task, n, before, many): a task's segments of size n, of which ``before`` come
    before those of the task, by the steps of plan(). Segment nth of low..high-1 goes to row + (nth + past) / per."""
    steps = steps[np.lexsort((steps[:, 1], steps[:, 0]))]
    ends = np.cumsum(np.bincount(steps[:, 0], minlength=1))

    def run(batches):
        for b in batches:
            out: list[tuple[int, ...]] = []
            for task, n, before, many in zip(*(c.to_pylist() for c in b.columns)):
                mine = steps[ends[n - 1] : ends[n]]
                for _, k, row, per, slot, stop in mine[np.searchsorted(mine[:, 5], before, "right") : np.searchsorted(mine[:, 1], before + many)].tolist():
                    out.append((task, n, max(k - before, 0), min(stop - before, many), before - k, row, per, slot))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 8, [pa.int32(), pa.int32(), *[pa.int64()] * 6])], ["task", "n", "low", "high", "past", "row", "per", "slot"])

    return run


def pack(
    docs: DataFrame, vocabulary: str, pattern: str, end_id: int, length: int = 2048, id_col: str = "doc_id", text_col: str = "text",
    group_bytes: int = 8 << 20, matrices: bool = True,
) -> DataFrame:
    """Packed rows of ``length`` token ids: (row, doc_ids, parts, cu_seqlens, n_tokens, input_ids, position_ids, row_sha256).

    A text is its token ids and ``end_id``; one of more than ``length`` ids is cut into parts of that length and a rest, so nothing
    is lost. Segments lie end to end: segment k of a row has ids cu_seqlens[k]:cu_seqlens[k+1], is part parts[k] of document
    doc_ids[k], and its position_ids count from 0. Space after the last segment is filled with end_id at position 0.
    Null and empty texts are one end_id. ``row_sha256`` is the SHA-256 of ids and positions, in hex (little-endian 32-bit); with
    matrices=False it comes without the arrays. An empty table gives no rows.

    The whole table is packed as one: rows are numbered from 0 without gaps and are as many and as full as best_fit() of all its
    segments makes them. That depends only on how many segments there are of each size, so plan() needs ``length`` numbers on the
    driver whatever the table's size, and each segment finds its row by its number among those of its size: its number in its task
    and how many the tasks before have. Ids are written once and meet in blocks of rows of about ``group_bytes``, which decide
    nothing but a task's memory. Ids may be of any type; null ids are ordinary ids. Repeated rows are packed as often as they come.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    segments = cut(d.mapInArrow(_segments(vocabulary, pattern, end_id, length), f"id {kind}, part int, n int, task int, nth long, ids binary"), "segments")
    sizes = cut(segments.groupBy("task", "n").agg(F.count("*").alias("many")), "sizes")
    steps = plan({r["n"]: r["many"] for r in sizes.groupBy("n").agg(F.sum("many").alias("many")).collect()}, length)
    earlier = Window.partitionBy("n").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    numbered = sizes.select("task", "n", F.coalesce(F.sum("many").over(earlier), F.lit(0)).alias("before"), "many")
    pieces = cut(numbered.mapInArrow(_pieces(steps), "task int, n int, low long, high long, past long, row long, per long, slot long"), "pieces")
    block = max(1, group_bytes // (8 * length))

    def run(key, table):
        t = table.take(pa.compute.sort_indices(table, sort_keys=[("row", "ascending"), ("place", "ascending")])).combine_chunks()
        row, n = t.column("row").to_numpy(), t.column("n").to_numpy().astype(np.int64)
        first = np.flatnonzero(np.diff(row, prepend=-1))  # each row's first segment
        many = np.diff(first, append=len(row))
        start = np.cumsum(n) - n
        at = start - np.repeat(start[first], many)  # each segment's begin in its row
        used = np.add.reduceat(n, first)
        raw = b"".join(t.column("ids").to_pylist())
        tokens = np.frombuffer(raw, "<u2" if len(raw) == 2 * n.sum() else "<i4")
        own = np.arange(len(tokens)) - np.repeat(start, n)
        to = own + np.repeat(at + np.repeat(np.arange(len(first)), many) * length, n)
        flat, pos = np.full(len(first) * length, end_id, np.int32), np.zeros(len(first) * length, np.int32)
        flat[to], pos[to] = tokens, own
        lists = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)
        ends = np.append(first, len(row))
        cu = np.insert(at + n, first, 0).astype(np.int32)  # 0 and where each segment ends
        columns = [pa.array(row[first]), lists(ends, t.column("id").combine_chunks()), lists(ends, t.column("part").combine_chunks()), lists(ends + np.arange(len(ends)), pa.array(cu)), pa.array(used.astype(np.int32))]
        if matrices:
            whole = np.arange(0, len(flat) + 1, length)
            columns += [lists(whole, pa.array(flat)), lists(whole, pa.array(pos))]
        digest = [hashlib.sha256(flat[i : i + length].tobytes() + pos[i : i + length].tobytes()).hexdigest() for i in range(0, len(flat), length)]
        return pa.table([*columns, pa.array(digest, pa.string())], names)

    names = ["row", "doc_ids", "parts", "cu_seqlens", "n_tokens", *(["input_ids", "position_ids"] if matrices else []), "row_sha256"]
    ddl = f"row long, doc_ids array<{kind}>, parts array<int>, cu_seqlens array<int>, n_tokens int, " + ("input_ids array<int>, position_ids array<int>, " if matrices else "") + "row_sha256 string"
    here = (F.col("nth") >= F.col("low")) & (F.col("nth") < F.col("high"))
    k = F.col("nth") + F.col("past")
    placed = segments.join(pieces, ["task", "n"]).where(here).select("id", "part", "n", "ids", (F.col("row") + F.expr("(nth + past) div per")).alias("row"), (F.col("slot") + k % F.col("per")).alias("place"))
    return placed.groupBy(F.expr(f"row div {block}").alias("block")).applyInArrow(run, ddl)


def write(packed: DataFrame, path: str) -> None:
    """The packed matrices as Parquet files: fixed-length lists of ids and positions, and each row's segment lengths."""
    packed.write.mode("overwrite").parquet(path)
