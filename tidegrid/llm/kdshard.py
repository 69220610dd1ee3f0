"""K-d tree partitioning of documents into shards of near-equal bytes, in DataFrame operations only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidegrid.llm.store import cut, drop

#: Buckets of one pass over a node's keys; bounds what a pass sends to the driver.
_BUCKETS = 4096
_COORD = (1 << 30) - 1
_NONE = -(1 << 62)
#: Repeated rows are dealt out in blocks of so many.
_COPIES = 1 << 16


def _coordinates(docs: DataFrame, dims: list[str]) -> dict[str, Column]:
    """Each dimension as a whole number from 0 to 2^30 - 1: numbers and times by value, texts by the order of a hash; null is 0."""
    numeric = [c for c in dims if isinstance(docs.schema[c].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType))]
    as_double = {c: F.col(f"`{c}`").cast("timestamp").cast("double") if isinstance(docs.schema[c].dataType, (T.DateType, T.TimestampNTZType)) else F.col(f"`{c}`").cast("double") for c in numeric}
    finite = {c: F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x) for c, x in as_double.items()}
    ends = docs.select([F.min(x).alias(f"lo{i}") for i, x in enumerate(finite.values())] + [F.max(x).alias(f"hi{i}") for i, x in enumerate(finite.values())]).first() if numeric else None
    out = {}
    for c in dims:
        if c in finite:
            i = numeric.index(c)
            lo, hi = ends[f"lo{i}"], ends[f"hi{i}"]
            wide = lo is not None and hi > lo
            x = F.floor((finite[c] - F.lit(lo)) / F.lit((hi - lo) if wide else 1.0) * F.lit(_COORD)) if wide else F.lit(0)
        else:
            x = F.crc32(F.col(f"`{c}`").cast("string").cast("binary")).bitwiseAND(F.lit(_COORD))
        out[c] = F.coalesce(x.cast("long"), F.lit(0).cast("long"))
    return out


def _by_node(values: dict[int, int], of: str = "node") -> Column:
    """A number for each node (nodes are numbered without gaps), null for others: an array in the plan, as long as there are nodes."""
    if not values:
        return F.lit(None).cast("long")
    table = np.full(max(values) + 1, _NONE, np.int64)
    table[list(values)] = list(values.values())
    return F.nullif(F.get(F.lit(table), F.col(of).cast("int")), F.lit(_NONE))


def _medians(rows: DataFrame, nodes: dict[int, tuple[int, int, float]]) -> dict[int, int]:
    """For each node, given (least key, greatest key, weight wanted on the left), the key that comes nearest to it: rows up to it go left.

    Each pass adds up weights in buckets of the keys' range, in parallel, and narrows the range to the bucket in which the
    wanted weight is reached. Buckets are added up where they are, too: a pass sends one row a node to the driver.
    """
    state = {n: (lo, hi, 0, want) for n, (lo, hi, want) in nodes.items()}
    done: dict[int, int] = {}
    while state:
        step = {n: (hi - lo) // _BUCKETS + 1 for n, (lo, hi, _, _) in state.items()}
        lo, hi, before = (_by_node({n: s[i] for n, s in state.items()}) for i in range(3))
        inside = rows.withColumn("lo", lo).withColumn("step", _by_node(step)).where(F.col("lo").isNotNull() & F.col("key").between(F.col("lo"), hi))
        buckets = inside.groupBy("node", F.expr("(key - lo) div step").alias("b")).agg(F.sum("size").alias("w"))
        upto = F.sum("w").over(Window.partitionBy("node").orderBy("b"))  # over at most _BUCKETS rows a node
        # Halves of whole sizes are exact in doubles; what is wanted is at most the node's weight, so some bucket reaches it.
        want = F.get(F.lit(np.array([state[n][3] if n in state else 0.0 for n in range(max(state) + 1)])), F.col("node").cast("int"))
        reached = buckets.withColumn("upto", upto + before).where(F.col("upto") >= want).groupBy("node").agg(F.min(F.struct("b", "w", "upto")).alias("x"))
        for r in reached.select("node", "x.*").collect():
            lo, hi, _, wanted = state.pop(r.node)
            width, below = step[r.node], r.upto - r.w
            if width == 1:
                # One key: it goes where the sides differ less from what is wanted.
                done[r.node] = lo + r.b - (1 if below > 0 and wanted - below < r.upto - wanted else 0)
            else:
                state[r.node] = (lo + r.b * width, min(hi, lo + (r.b + 1) * width - 1), below, wanted)
    return done


def _rows(docs: DataFrame, dims: list[str], id_col: str, text_col: str) -> DataFrame:
    """(id, size, text_crc32, c0, c1, ..., tie) of every row; rows equal in all come numbered, so that each has a tie of its own.

    Equal rows are counted, with map-side combination, and dealt out again in blocks: no window over them, and none is lost.
    """
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    coords = _coordinates(docs, dims)
    base = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"),
        *[c.alias(f"c{i}") for i, c in enumerate(coords.values())], F.xxhash64(text).alias("h"),
    )
    n = F.col("n") - 1
    some = base.groupBy(*base.columns).agg(F.count("*").alias("n")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(n / _COPIES))))
    begin = F.col("block") * _COPIES
    each = some.withColumn("copy", F.explode(F.sequence(begin, F.least(begin + (_COPIES - 1), n))))
    tie = F.pmod(F.xxhash64("id", "h", "copy"), F.lit(1 << 32))
    return each.select(*[c for c in base.columns if c != "h"], tie.alias("tie"))


def shard(docs: DataFrame, dims: list[str], shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot): every row's shard and its place there, gapless from 0.

    A row's size is the UTF-8 bytes of its text (null: none) and 1 more. The rows are halved again and again, each node at
    its weighted median along the dimension in which it is widest (as a share of the whole table's range), until there are
    ``shards`` leaves or each has ``target_bytes`` or less. Of an odd number of shards the left side gets one more and is cut at
    its share of the weight. Rows that agree in the dimension are ordered by a hash of id, text and, for repeated rows, their
    number, so a value or a row that most share is split like any other: equal texts aren't kept together.
    A shard stays empty only where rows are fewer than shards or one row outweighs others.
    Null or NaN in a dimension counts as its least value; null ids are ordinary ids. An empty table gives no rows.

    Sizes and coordinates are written without the texts, once and again after each level; passes aggregate over that table. The driver sees
    one row for each node.
    """
    if (shards is None) == (target_bytes is None) or (shards or target_bytes) < 1:
        raise ValueError("give a number of shards or target_bytes, 1 or more")
    rows = cut(_rows(docs, dims, id_col, text_col).withColumn("node", F.lit(0).cast("long")), "sizes")
    leaves = {0: shards or 0}  # shards that each node is to become; numbered from left to right
    while True:
        widths = [(F.max(f"c{i}") - F.min(f"c{i}")).alias(f"w{i}") for i in range(len(dims))]
        stats = {r.node: r for r in rows.groupBy("node").agg(F.sum("size").alias("w"), F.count("*").alias("n"), *widths).collect()}
        todo = [n for n in leaves if n in stats and (leaves[n] > 1 if shards else stats[n].w > target_bytes and stats[n].n > 1)]
        if not todo:
            break
        axis = {n: max(range(len(dims)), key=lambda i: (stats[n][f"w{i}"], -i)) if dims else 0 for n in todo}
        which = _by_node(axis)
        coord = F.coalesce(*[F.when(which == i, F.col(f"c{i}")) for i in range(len(dims))], F.lit(0))
        keyed = rows.withColumn("key", coord * F.lit(1 << 32) + F.col("tie"))
        left = {n: -(-leaves[n] // 2) for n in todo}
        share = {n: left[n] / leaves[n] if shards else 0.5 for n in todo}
        ends = keyed.where(which.isNotNull()).groupBy("node").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
        at = _medians(keyed.select("node", "key", "size"), {r.node: (r.lo, r.hi, stats[r.node].w * share[r.node]) for r in ends})
        begin, after = {}, {}
        for n in sorted(leaves):
            begin[n] = len(after)
            for k in (left[n], leaves[n] - left[n]) if n in at else (leaves[n],):
                after[len(after)] = k
        split = _by_node(at)
        node = _by_node(begin) + F.when(split.isNull(), 0).otherwise((F.col("key") > split).cast("int"))
        before, rows = rows, cut(keyed.withColumn("node", node.cast("long")).drop("key"), "nodes")  # nested conditions of all levels in one plan would grow as their product
        drop(before)
        leaves = after
    return _slots(rows)


def _slots(rows: DataFrame, per_task: int = 50_000) -> DataFrame:
    """Places in the shards (nodes), without one task for a whole shard."""
    rows = rows.withColumn("shard", F.col("node").cast("int"))
    parts = max(1, -(-(rows.groupBy("shard").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) // per_task))
    rows = rows.withColumn("part", F.pmod(F.col("tie"), F.lit(parts)))
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("shard", "part", before.alias("start"))
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("id", "text_crc32", "size"))
    return rows.withColumn("place", place).join(starts, ["shard", "part"]).select("id", "size", "text_crc32", "shard", (F.col("start") + F.col("place") - 1).cast("long").alias("slot"))
