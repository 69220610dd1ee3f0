"""Near-duplicate vectors by spherical k-means cells and blocked cosine products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.graph import components
from tidegrid.llm.store import cut


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit vectors; deterministic. A cell that loses all its vectors takes the one farthest from its own."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[np.sort(rng.choice(len(x), k, replace=False))]
    for _ in range(rounds):
        sims = x @ c.T
        own = sims.argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=k) == 0)
        if len(empty):
            total[empty] = x[np.argsort(sims.max(1))[: len(empty)]]
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-300), c)
    return c


def centroids_of(x: np.ndarray, k: int, wide: int = 1024) -> np.ndarray:
    """k unit centroids or a few less; more than ``wide`` are learned in two steps, cells of cells, so that the work grows with k's root."""
    if k <= wide:
        return spherical_kmeans(x, k)
    top = spherical_kmeans(x, int(np.sqrt(k)))
    own = np.concatenate([(x[i : i + 4096] @ top.T).argmax(1) for i in range(0, len(x), 4096)])
    parts = [x[own == j] for j in range(len(top))]
    return np.concatenate([spherical_kmeans(part, max(1, round(k * len(part) / len(x)))) for part in parts if len(part)])


def cells(x: np.ndarray, c: np.ndarray, threshold: float, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """(home cell, other cells): for each unit vector its nearest cell, and of the cells where its partners may be at home the
    ``probes`` nearest, -1 beyond the last.

    A partner at cosine ``threshold`` or more lies within the chord sqrt(2 - 2 * threshold); if it is at home in another
    cell, the vector is no farther than that from the plane that halves the way between both centroids.
    """
    home, other = np.zeros(len(x), np.int64), np.full((len(x), probes), -1, np.int64)
    step, probes = max(16, (1 << 22) // len(c)), min(probes, len(c) - 1)
    for i in range(0, len(x), step):
        sims = x[i : i + step] @ c.T
        rows = np.arange(len(sims))
        home[i : i + step] = own = sims.argmax(1)
        if probes <= 0:
            continue
        gap = sims[rows, own][:, None] - sims
        gap[rows, own] = np.inf
        near = np.argpartition(gap, probes - 1, axis=1)[:, :probes]
        gap = gap[rows[:, None], near]
        apart = np.linalg.norm(c[own][:, None] - c[near], axis=2)
        other[i : i + step, :probes] = np.where(gap <= apart * np.sqrt(2 - 2 * threshold) + 1e-9, near, -1)
    return home, other


def local_roots(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of n nodes by links (i, j)."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        root = new[root]
        keep = root[i] != root[j]
        i, j = i[keep], j[keep]
    return root


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, sample: int = 20_000, per_cell: int = 8192, block: int = 8192, probes: int = 8, max_cells: int = 65_536
) -> DataFrame:
    """(id, n_links, component_id, kept): every vector's links at cosine ``threshold`` or more and its group's smallest id.

    A vector is compared with all others at home in its cell and in those of the ``probes`` nearest other cells that a partner
    may be in (see cells); both of a pair look for the other. So all links are found while a vector is near no more borders than
    that, always so with ``probes`` + 1 cells or fewer, and a vector has at most ``probes`` + 1 entries whatever the number
    of cells; the README has the recall beyond. Each link that is found counts for both. Vectors that are null, empty, zero or have null or non-finite components link with nothing, vectors of
    different lengths not with each other. Null ids are dropped. An empty table gives no rows.

    Equal vectors are one row with a count, so copies cost nothing. Cells are as many as make ``per_cell`` rows
    each, up to ``max_cells``; centroids are learned from at most ``sample`` rows, or 4 for each cell if that is more (by a hash
    of the id); every row is assigned. Cells larger than ``block`` are compared block by block, each pair of blocks in
    a group of its own; a block pair returns sums and a spanning forest, never its pairs.
    """
    v = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vec_col), lambda x: x.cast("double")).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = v.where(finite & F.exists("v", lambda x: x != 0)).select("id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))
    classes = cut(good.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "vectors")
    dims = [r[0] for r in classes.select(F.size("v")).distinct().collect()]
    centroids: list[tuple[int, np.ndarray, int]] = []
    first = 0
    for dim in sorted(dims):
        of = classes.where(F.size("v") == dim)
        n = of.count()
        k = max(1, min(max_cells, -(-n // per_cell)))
        most, key = max(sample, 4 * k), F.pmod(F.xxhash64("rep"), F.lit(1 << 30))
        few = of if n <= most else of.where(key <= int((2 * most << 30) / n))  # some more than are wanted, so that no task sorts them all
        some = few.orderBy(key, "rep").limit(most).select("v").toArrow()
        x = _matrix(some.column(0).combine_chunks())
        x = x / np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        c = centroids_of(x, k)
        centroids.append((dim, c, first))
        first += len(c)
    by_dim = {dim: (c, at) for dim, c, at in centroids}

    def assign(batches):
        for b in batches:
            sizes = np.diff(b.column(0).offsets.to_numpy())
            for dim in np.unique(sizes):
                part = b.take(pa.array(np.flatnonzero(sizes == dim)))
                c, at = by_dim[int(dim)]
                x = _matrix(part.column(0))
                x = x / np.abs(x).max(1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                home, other = cells(x, c, threshold, probes)
                row, k = np.nonzero(other >= 0)
                cell = np.concatenate([home, other[row, k]]) + at
                row, flag = np.concatenate([np.arange(len(x)), row]), np.arange(len(cell)) < len(x)
                lists = np.where(other >= 0, other + at, -1)
                for s in range(0, len(row), 4096):
                    r, own = row[s : s + 4096], flag[s : s + 4096]
                    vecs = pa.ListArray.from_arrays(pa.array(np.arange(len(r) + 1, dtype=np.int32) * int(dim)), pa.array(x[r].reshape(-1)))
                    looks = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(own * probes)]).astype(np.int32)), pa.array(lists[r[own]].reshape(-1).astype(np.int32)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell[s : s + 4096].astype(np.int32)), pa.array((home[r] + at).astype(np.int32)), part.column(1).take(pa.array(r)), part.column(2).take(pa.array(r)), looks, vecs], ["cell", "home", "rep", "n", "looks", "v"]
                    )

    rows = cut(classes.select("v", "rep", "n").mapInArrow(assign, "cell int, home int, rep long, n long, looks array<int>, v array<double>"), "cells")
    sizes = rows.groupBy("cell").agg(F.greatest(F.lit(1), F.ceil(F.sum((F.col("home") == F.col("cell")).cast("int")) / block)).cast("int").alias("down"), F.ceil(F.count("*") / block).cast("int").alias("across"))
    dealt = rows.join(sizes, "cell")
    at = lambda salt, n: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n)).cast("int")
    left = dealt.where("home = cell").select("cell", at(1, "down").alias("i"), F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("j"), F.lit(True).alias("left"), "home", "rep", "n", "looks", "v")
    right = dealt.select("cell", F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("i"), at(2, "across").alias("j"), F.lit(False).alias("left"), "home", "rep", "n", F.lit(None).cast("array<int>").alias("looks"), "v")

    def compare(key, table):
        table = table.combine_chunks()
        side = table.column("left").to_numpy()
        a, b = table.filter(pa.array(side)), table.filter(pa.array(~side))
        none = pa.array(np.zeros(0, np.int64))
        if not len(a) or not len(b):
            return pa.table({"rep": none, "links": none, "root": none})
        x, y = (_matrix(t.column("v").combine_chunks()) for t in (a, b))
        ra, rb, na, nb = (t.column(c).to_numpy() for c in ("rep", "n") for t in (a, b))
        home = b.column("home").to_numpy()
        looks = a.column("looks").combine_chunks().flatten().to_numpy().reshape(len(a), -1)
        looks = np.concatenate([looks, a.column("cell").to_numpy()[:, None]], axis=1)
        reps = np.unique(np.concatenate([ra, rb]))
        pa_, pb = np.searchsorted(reps, ra), np.searchsorted(reps, rb)
        links, root = np.zeros(len(reps), np.int64), np.arange(len(reps))
        for s in range(0, len(x), 256):  # a strip's links are folded into the forest before the next
            hit = (x[s : s + 256] @ y.T >= threshold) & (ra[s : s + 256, None] != rb[None])
            i, j = np.nonzero(hit)
            if len(i):
                links[pa_[s : s + 256]] += hit @ nb
                # A partner that this vector does not look for in its own cell would not hear of the link there.
                back = np.flatnonzero((looks[s + i] != home[j][:, None]).all(1))
                np.add.at(links, pb[j[back]], na[s + i[back]])
                root = local_roots(root[pa_[s + i]], root[pb[j]], len(reps))[root]
        root = reps[root]
        return pa.table({"rep": reps, "links": links, "root": root})

    found = left.unionByName(right).groupBy("cell", "i", "j").applyInArrow(compare, "rep long, links long, root long")
    found = cut(found.where("links > 0 or rep <> root"), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v"))).withColumnsRenamed({"node": "rep", "root": "component_id"})
    done = classes.join(links, "rep", "left").join(roots, "rep", "left").select(
        "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id")
    )
    linked = good.join(done, "v").select("id", "n_links", "component_id")
    alone = v.where(~F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("id") == F.col("component_id"))
