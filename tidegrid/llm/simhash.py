"""SimHash near-duplicate groups by multi-index hashing, and their completion to all near copies of a given similarity."""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.graph import components
from tidegrid.llm.store import cut, drop, id_filter
from tidegrid.llm.tokens import binary_buffer, keep_only, mix, slices, split_words


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of a text's word shingles, repeats included; 0 for a text without words.

    Words are runs of bytes other than space and \\x09-\\x0D after lower-casing A-Z. A shingle's words are joined by one
    space and hashed by XXH64 with seed 42; a text of fewer words is one shingle. A bit is 1 if over half the hashes have it.
    """
    w = text.lower().split()
    if not w:
        return 0
    parts = [b" ".join(x) for x in zip(*(w[k:] for k in range(shingle)))] if len(w) >= shingle else [b" ".join(w)]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(parts), 65536):
        digests = b"".join([xxhash.xxh64_digest(p, 42) for p in parts[i : i + 65536]])
        ones += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(parts)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp long): every text's fingerprint, whatever its length; null texts count as empty (fingerprint 0)."""

    def run(batches):
        keep_only("simhash", lambda: None)
        for b in (part for batch in batches for part in slices(batch)):
            raw, off = binary_buffer(b.column(1))
            raw = raw.tobytes()
            fps = [fingerprint(raw[off[i] : off[i + 1]], shingle) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, f"id {kind}, fp long")


def _alike(fps: DataFrame, bits: int, segments: int) -> DataFrame:
    """The fingerprints that share all but two of ``segments`` segments with another: none at distance 2 or less is missing.

    One table for each choice of two segments to leave out; its key is the rest of the fingerprint.
    """
    edges = [bits * k // segments for k in range(segments + 1)]
    field = lambda k: (1 << edges[k + 1]) - (1 << edges[k])
    signed = lambda x: x - (1 << bits) if bits == 64 and x >> 63 else x
    keys = [F.struct(F.lit(n).alias("table"), F.col("fp").bitwiseAND(F.lit(signed(((1 << bits) - 1) & ~field(i) & ~field(j)))).alias("rest")) for n, (i, j) in enumerate(itertools.combinations(range(segments), 2))]
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.table", "k.rest")
    full = rows.groupBy("table", "rest").agg(F.count("*").alias("n")).where("n > 1").select("table", "rest")
    return rows.join(full, ["table", "rest"]).select("fp").distinct()


def linked(fps: DataFrame, n: int, bits: int = 64) -> DataFrame:
    """(u, v): enough links between ``n`` distinct fingerprints (column fp) at 2 or fewer differing bits to connect all that are.

    Multi-index hashing in two steps. Tables over parts of the fingerprint (see _alike; more segments for more
    fingerprints, so that a key keeps a few bits above log2 n) drop those that have no neighbour. Each of the others is
    entered under all members of the Hamming ball of radius 1 around each half, beside its other half, and two at
    distance 2 or less always meet: halfway between them if they differ in one half, else where one's flipped half is the
    other's own. Under these keys a bucket holds at most bits + 1 fingerprints whatever the number of near copies,
    and a link from each to the bucket's smallest connects it. Each fetched match is verified by its whole distance.
    """
    parts = 4 if n < 1 << 28 else 6 if n < 1 << 38 else 8
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = cut(_alike(fps, bits, parts), "alike").repartition(tasks, "fp")
    flips = [F.col("fp").bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63))) for k in range(bits)]
    probes = near.select("fp", F.explode(F.array("fp", *flips)).alias("key"))
    least = probes.groupBy("key").agg(F.min("fp").alias("v"), F.max("fp").alias("w"), F.count("*").alias("n")).where("n > 1")
    # Two members need no second look at the table; only fuller buckets fetch their members again.
    two = least.where("n = 2").select(F.col("w").alias("u"), "v")
    more = probes.join(least.where("n > 2").select("key", "v"), "key").select(F.col("fp").alias("u"), "v")
    return two.unionByName(more).where((F.col("u") != F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2)).distinct()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp, component_id): documents whose fingerprints are joined by links of 2 or fewer differing bits.

    component_id is the smallest id of the group. Empty and null texts have fingerprint 0 and link like any other.
    Equal fingerprints are one node, so copies cost one row each and never a pair. An empty table gives no rows; rows
    with a null id are dropped, repeated ids come back as often as they came.
    """
    fps = cut(fingerprints(docs.where(F.col(id_col).isNotNull()), id_col, text_col, shingle), "fingerprints")
    nodes = cut(fps.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = components(linked(nodes.select("fp"), nodes.count()))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = cut(named, "nodes")
    group = named.groupBy("root").agg(F.min("least").alias("component_id"))
    node = cut(named.join(group, "root").select("fp", "component_id"), "groups")
    return fps.join(node, "fp").select("id", "fp", "component_id")


#: Least hashes kept of a text's shingles to reject pairs that are far from similar, by the share that both have, and the margin below the
#: limit at which they do (six times the error of 64 hashes); whatever is nearer is measured on the whole sets.
SKETCH = 64
MARGIN = 0.3
#: Counters of the shingles' approximate frequency: 8 MB whatever the number of texts.
SLOTS = 1 << 23


def shingle_sets(col: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """Each row's distinct word shingles as sorted 64-bit hashes; a text of fewer words is one shingle, one without words has none."""
    for w in split_words(col, lower=True):
        h = w.hashes()
        m = len(h) - shingle + 1
        if m > 0:
            all_ = mix(h[:m])
            for k in range(1, shingle):
                all_ = mix(all_ + h[k : k + m])
        for x, y in zip(w.first[:-1], w.first[1:]):
            if y - x >= shingle:
                yield np.unique(all_[x : y - shingle + 1])
            else:
                one = np.array([y - x], np.uint64)
                for k in range(x, y):
                    one = mix(one + h[k : k + 1])
                yield one if y > x else one[:0]


def _levels(d: DataFrame, shingle: int, sample: int = 250_000) -> np.ndarray:
    """How common the shingles of each slot are among about ``sample`` texts, on a scale of logarithms.

    It only orders the shingles, so that common ones seldom are keys: any other table gives the same groups at another cost.
    """
    n = d.count()
    some = d if n <= sample else d.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < max(1, (sample << 30) // n))
    part = SLOTS // 16

    def count(batches):
        keep_only("simhash", lambda: None)
        sums = None
        for b in (x for batch in batches for x in slices(batch)):
            sets = list(shingle_sets(b.column(2), shingle))
            if sets:
                slot, times = np.unique(np.concatenate(sets) & np.uint64(SLOTS - 1), return_counts=True)
                sums = np.zeros(SLOTS, np.uint16) if sums is None else sums
                slot = slot.astype(np.int64)
                sums[slot] = np.minimum(sums[slot] + times, 65535)
        for k in range(16 if sums is not None else 0):
            packed = zlib.compress(sums[k * part : (k + 1) * part].tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([packed], pa.binary())], ["part", "sums"])

    def add(table):
        sums = np.zeros(part, np.int64)
        for x in table.column("sums"):
            sums += np.frombuffer(zlib.decompress(x.as_py()), np.uint16)
        return pa.table({"part": table.column("part")[:1], "levels": pa.array([(4 * np.log2(sums + 1)).astype(np.uint8).tobytes()], pa.binary())})

    levels = np.zeros(SLOTS, np.uint8)
    for r in some.mapInArrow(count, "part int, sums binary").groupBy("part").applyInArrow(add, "part int, levels binary").collect():
        levels[r["part"] * part : (r["part"] + 1) * part] = np.frombuffer(r["levels"], np.uint8)
    return levels


def _prefixes(levels: np.ndarray, shingle: int, similarity: float, fp_shingle: int):
    """Rows (id, h, fp, mark, n, sketch, prefix): a text's fingerprint, digest, size and sketch (least values) of its shingle set, and its
    rarest shingles, so many that two sets of at least ``similarity`` have one of them in common."""

    def lists(rows: list[np.ndarray], kind) -> pa.ListArray:
        ends = np.cumsum([0] + [len(x) for x in rows]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows).view(kind) if rows else np.zeros(0, kind)))

    def run(batches):
        keep_only("simhash", lambda: None)
        for b in (part for batch in batches for part in slices(batch)):
            raw, off = binary_buffer(b.column(2))
            fps = pa.array(np.array([fingerprint(raw[x:y].tobytes(), fp_shingle) for x, y in zip(off[:-1], off[1:])], np.uint64).view(np.int64))
            marks, sizes, least, keys = [], [], [], []
            for s in shingle_sets(b.column(2), shingle):
                order = np.argsort(levels[s.astype(np.int64) & (SLOTS - 1)], kind="stable")
                marks.append(xxhash.xxh3_128_digest(s.tobytes()))
                sizes.append(len(s))
                least.append((s[:SKETCH] >> np.uint64(32)).astype(np.uint32))
                keys.append(s[order[: len(s) - math.ceil(similarity * len(s) - 1e-9) + 1]])
            columns = [b.column(0), b.column(1), fps, pa.array(marks, pa.binary()), pa.array(sizes, pa.int32()), lists(least, np.int32), lists(keys, np.int64)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "h", "fp", "mark", "n", "sketch", "prefix"])

    return run


def _whole_sets(shingle: int):
    """Rows (node, hashes): a text's whole shingle set."""

    def run(batches):
        for b in (part for batch in batches for part in slices(batch)):
            sets = list(shingle_sets(b.column(1), shingle))
            ends = np.cumsum([0] + [len(x) for x in sets]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], ["node", "hashes"])

    return run


def _known(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, t): rows with an id, known by it and a hash of their text."""
    t = F.col(text_col).cast("binary")
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(t, F.lit(b""))).alias("h"), t.alias("t"))


def _by_fingerprint(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """(u, v): nodes of equal sets (marks: mark, rep; rows: mark, fp), so linked that those whose rows are one group of groups() are connected.

    Rows of one fingerprint are linked to the least node of them, these by multi-index hashing as in groups().
    """
    own = cut(rows.select("mark", "fp").distinct().join(marks.select("mark", "rep"), "mark").select("fp", "rep"), "own")
    heads = cut(own.groupBy("fp").agg(F.min("rep").alias("head")), "heads")
    head = lambda c: heads.select(F.col("fp").alias(c), F.col("head").alias(f"{c}_head"))
    equal = own.join(heads, "fp").where("rep <> head").select(F.col("rep").alias("u"), F.col("head").alias("v"))
    near = linked(heads.select("fp"), heads.count()).join(head("u"), "u").join(head("v"), "v").select(F.col("u_head").alias("u"), F.col("v_head").alias("v"))
    links = cut(equal.unionByName(near.where("u <> v")).distinct(), "fp-links")
    for done in (own, heads):
        drop(done)
    return links


def _grouped(d: DataFrame, shingle: int, similarity: float, fp_shingle: int) -> DataFrame:
    """(id, h, first) for the rows of _known(): ``first`` is the least struct (id, h) of the row's group. See near_copies()."""
    kind = d.schema["id"].dataType.simpleString()
    prefixes = d.mapInArrow(_prefixes(_levels(d, shingle), shingle, similarity, fp_shingle), f"id {kind}, h long, fp long, mark binary, n int, sketch array<int>, prefix array<long>")
    rows = cut(prefixes.withColumn("node", F.monotonically_increasing_id()), "prefixes")
    marks = cut(rows.groupBy("mark").agg(F.min("node").alias("rep"), F.min(F.struct("id", "h")).alias("first"), F.count("*").alias("copies")), "marks")
    by_fp = _by_fingerprint(rows, marks)
    # Equal sets are one node. Rows whose set surely no other row has need no exchange.
    twice = marks.where("copies > 1").select("mark", "rep")
    maybe = id_filter(twice, "mark")
    nodes = rows.where(~maybe).unionByName(rows.where(maybe).join(twice, "mark", "left").where("rep is null or node = rep").drop("rep"))
    post = nodes.select("node", F.posexplode("prefix").alias("at", "key"))
    full = cut(post.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "keys")
    met = cut(post.join(full, "key"), "met")
    load = met.groupBy("node").agg(F.sum("size").alias("load"))
    few = cut(nodes.select("node", "id", "h", "n", "sketch").join(load, "node"), "few")
    met = cut(met.select("key", "at", F.col("node").alias("rep")).join(few.select(F.col("node").alias("rep"), "n", "load"), "rep"), "members")

    def of(c: str, table: DataFrame, name: str) -> DataFrame:
        return table.select(F.col("node").alias(c), F.col(name).alias(f"{c}_{name}"))

    def verified(pairs: DataFrame) -> DataFrame:
        """The distinct pairs (u, v, and sizes u_n, v_n) that are similar."""
        pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.when(F.col("u") < F.col("v"), F.col("u_n")).otherwise(F.col("v_n")).alias("u_n"),
                                         F.when(F.col("u") < F.col("v"), F.col("v_n")).otherwise(F.col("u_n")).alias("v_n")).distinct()
        both = F.size(F.array_intersect("u_sketch", "v_sketch"))
        far = both < (similarity - MARGIN) * F.least("u_n", "v_n", F.lit(SKETCH))
        close = cut(pairs.join(of("u", few, "sketch"), "u").join(of("v", few, "sketch"), "v").where(~far).select("u", "v"), "close")
        ends = cut(few.select("node", "id", "h").join(close.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "node"), "ends")
        texts = d.where(id_filter(ends, "id", "h")).join(ends, ["id", "h"]).groupBy("id", "h").agg(F.first("node").alias("node"), F.first("t").alias("t"))
        sets = cut(texts.select("node", "t").mapInArrow(_whole_sets(shingle), "node long, hashes array<long>"), "sets")
        both = F.size(F.array_intersect("u_hashes", "v_hashes"))
        alike = both >= similarity * (F.size("u_hashes") + F.size("v_hashes") - both) - 1e-9
        links = cut(close.join(of("u", sets, "hashes"), "u").join(of("v", sets, "hashes"), "v").where(alike).select("u", "v"), "links")
        for done in (close, ends, sets):
            drop(done)
        return links

    def may_be(n: Column, at: Column, m: Column, there: Column) -> Column:
        """Whether sets of n and m shingles can be similar if the one at these places of their orders is the first that they have in
        common: so many must be left from there on. A similar pair meets this at its first common shingle."""
        return F.least(n - at, m - there) >= similarity / (1 + similarity) * (n + m) - 1e-6

    def spokes(hubs: DataFrame, members: DataFrame) -> DataFrame:
        """Each key's hub, the member of the greatest load, with all members of other groups."""
        hub = hubs.groupBy("key").agg(F.max_by(F.struct("rep", "n", "at", "root"), F.struct("load", "rep")).alias("hub"))
        met = members.join(hub, "key").where((F.col("root") != F.col("hub.root")) & may_be(F.col("n"), F.col("at"), F.col("hub.n"), F.col("hub.at")))
        return met.select(F.col("rep").alias("u"), F.col("n").alias("u_n"), F.col("hub.rep").alias("v"), F.col("hub.n").alias("v_n"))

    def with_roots(roots: DataFrame) -> DataFrame:
        return cut(met.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep")), "rooted")

    everywhere = with_roots(components(by_fp))  # what fingerprints link is compared no more
    links = verified(spokes(everywhere, everywhere))
    drop(everywhere)
    n_met, found, before = met.count(), links.count(), math.inf
    links = by_fp.unionByName(links)
    while True:
        roots = components(links)
        now = with_roots(roots)
        parts = now.groupBy("key", "root").agg(F.count("*").alias("m"))
        main = parts.groupBy("key").agg(F.max_by("root", F.struct("m", "root")).alias("main"), F.sum("m").alias("total"), F.max("m").alias("most")).where("most < total")
        work = main.agg(F.sum((F.col("total") - F.col("most")) * F.col("total"))).first()[0] or 0
        left = now.join(main.select("key", "main"), "key").where("root <> main")
        last = not found or work <= 4 * n_met or work > before / 2
        before = work
        if last:
            x = left.select("key", F.col("rep").alias("u"), F.col("n").alias("u_n"), F.col("at").alias("u_at"), F.col("root").alias("u_root"), "main")
            y = now.select("key", F.col("rep").alias("v"), F.col("n").alias("v_n"), F.col("at").alias("v_at"), F.col("root").alias("v_root"))
            once = (F.col("u_root") != F.col("v_root")) & ((F.col("v_root") == F.col("main")) | (F.col("u") < F.col("v")))
            more = verified(x.join(y, "key").where(once & may_be(F.col("u_n"), F.col("u_at"), F.col("v_n"), F.col("v_at"))))
        else:
            more = verified(spokes(left, now))
        found = more.count()
        links = links.unionByName(more)
        drop(now)
        if last:
            break
    roots = components(links) if found else roots
    rooted = cut(marks.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("mark", "first", F.coalesce("root", "rep").alias("root")), "rooted")
    group = rooted.groupBy("root").agg(F.min("first").alias("first"))
    named = rooted.select("mark", "root").join(group, "root").select("mark", "first")
    out = cut(rows.select("id", "h", "mark").join(named, "mark").select("id", "h", "first"), "grouped")
    for done in (rows, marks, by_fp, full, met, few, rooted):
        drop(done)
    return out


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, fp_shingle: int = 3) -> DataFrame:
    """(id, component_id): groups of texts linked by their fingerprints or by a similarity of their distinct ``shingle``-word shingles of
    ``similarity`` or more.

    First the groups of groups(): fingerprints over ``fp_shingle`` words, those at 2 or fewer differing bits found by multi-index hashing. As
    similar texts can differ in more bits than any index can enumerate, the links between these groups are then completed on the shingles.
    Exact, whatever the number of texts. In any order of all shingles, two sets that similar have one in common among the
    first (1 - similarity) of each, so every text is entered under those, in order of rarity. Of the texts that meet under a
    key, and that have enough of their shingles after it, first all are compared with the one that meets the most others, which
    joins a family to its base. Then, while that halves what is left, with another of those left over; at last each of these with
    all members of other groups, so no link between groups is left out. Far pairs are rejected by sketches, the others verified on their whole sets. Equal sets are one node. Null
    and empty texts are alike. Rows that share an id are compared each by its own text, and have a row here each; component_id
    is the smallest id of a group. Null ids are dropped; an empty table gives no rows.
    """
    return _grouped(_known(docs, id_col, text_col), shingle, similarity, fp_shingle).select("id", F.col("first.id").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, fp_shingle: int = 3) -> DataFrame:
    """docs with one row of each group of near_copies(): that of the smallest id (and, of one id's texts, of the least hash; of equal rows, one).

    Rows with a null id are compared with nothing and stay. Only rows that may be affected go through an exchange.
    """
    d = _known(docs, id_col, text_col)
    rows = _grouped(d, shingle, similarity, fp_shingle)
    stays = (F.col("id") == F.col("first.id")) & (F.col("h") == F.col("first.h"))
    gone = cut(rows.where(~stays).select("id", "h").distinct(), "gone")
    again = rows.where(stays).groupBy("id", "h").agg(F.count("*").alias("n")).where("n > 1").select("id", "h")
    touched = id_filter(gone.unionByName(again), "_id", "_h", names=("id", "h"))
    h = F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{id_col}`").alias("_id"), h.alias("_h"))
    touched = F.col("_id").isNotNull() & touched
    hit = keyed.where(touched).join(gone.select(F.col("id").alias("_id"), F.col("h").alias("_h")), ["_id", "_h"], "left_anti").groupBy("_id", "_h").agg(F.first("_row").alias("_row"))
    return keyed.where(~touched).select("_row").unionByName(hit.select("_row")).select(*[F.col("_row")[c].alias(c) for c in docs.columns])
