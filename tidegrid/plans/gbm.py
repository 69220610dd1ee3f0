"""Gradient-boosted histogram trees in numpy: squared, absolute and quantile loss, missing values, early stopping."""

from __future__ import annotations

from dataclasses import dataclass, field
from math import factorial

import numpy as np


@dataclass
class Params:
    objective: str = "l2"  # l2, l1 or quantile
    alpha: float = 0.5
    rate: float = 0.05
    rounds: int = 200
    depth: int = 5
    min_leaf: int = 20
    l2: float = 1.0
    columns: float = 1.0  # share of features for each tree
    rows: float = 1.0  # share of rows for each tree
    bins: int = 63
    seed: int = 42


@dataclass
class _Tree:
    feature: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    count: np.ndarray  # training rows that reached each node


@dataclass
class Booster:
    """A fitted model; node i of a tree has children 2i + 1 and 2i + 2, feature -1 is a leaf."""

    params: Params
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[_Tree] = field(default_factory=list)
    start: float = 0.0
    best: int = 0

    def _bin(self, x: np.ndarray) -> np.ndarray:
        """Bin 0 is for missing values."""
        out = np.zeros(x.shape, np.uint8)
        for j, e in enumerate(self.edges):
            ok = ~np.isnan(x[:, j])
            out[ok, j] = np.searchsorted(e, x[ok, j], "left") + 1
        return out

    def _loss(self, y: np.ndarray, f: np.ndarray) -> float:
        if self.params.objective == "l2":
            return float(np.mean((y - f) ** 2))
        a = 0.5 if self.params.objective == "l1" else self.params.alpha
        return float(np.mean(np.maximum(a * (y - f), (a - 1) * (y - f))))

    def _gradient(self, y: np.ndarray, f: np.ndarray) -> np.ndarray:
        if self.params.objective == "l2":
            return f - y
        a = 0.5 if self.params.objective == "l1" else self.params.alpha
        return np.where(y > f, -a, 1 - a)

    def _histogram(self, places: np.ndarray, g: np.ndarray, rows: np.ndarray, features: np.ndarray) -> np.ndarray:
        """Sums of gradients and rows for each of ``features`` and bin: two tables in one array."""
        width = self.params.bins + 2
        out = np.empty((2, len(features), width))
        for k in range(0, len(features), 64):
            f = features[k : k + 64]
            at = (places[rows[:, None], f] - (f - np.arange(len(f))) * width).ravel()
            n = len(f) * width
            out[0, k : k + 64] = np.bincount(at, np.repeat(g[rows], len(f)), n).reshape(len(f), width)
            out[1, k : k + 64] = np.bincount(at, minlength=n).reshape(len(f), width)
        return out

    def _split(self, h: np.ndarray) -> tuple[float, int, int, bool] | None:
        """(gain, feature's index, last bin on the left, whether missing values go left) of the best split; the first of equals."""
        p = self.params
        total_g, total_n = h[0, 0].sum(), h[1, 0].sum()
        left = np.cumsum(h[:, :, 1:], axis=2)
        left = np.stack([left + h[:, :, :1], left], axis=2)  # missing values on the left, then on the right
        cg, cn = left
        rg, rn = total_g - cg, total_n - cn
        whole = total_g**2 / (total_n + p.l2)
        ok = (cn >= p.min_leaf) & (rn >= p.min_leaf)
        gain = np.where(ok, cg**2 / np.maximum(cn + p.l2, 1e-9) + rg**2 / np.maximum(rn + p.l2, 1e-9) - whole, -1)
        j, side, k = np.unravel_index(int(gain.argmax()), gain.shape)
        return (float(gain[j, side, k]), int(j), int(k) + 1, side == 0) if gain[j, side, k] > 1e-12 else None

    def _grow(self, b: np.ndarray, places: np.ndarray, g: np.ndarray, resid: np.ndarray, rows: np.ndarray, features: np.ndarray) -> _Tree:
        p, size = self.params, 2 ** (self.params.depth + 1) - 1
        t = _Tree(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size, bool), np.zeros(size), np.zeros(size), np.zeros(size, np.int64))
        at, tables = {0: rows}, {}
        for node in range(size):
            r = at.pop(node, None)
            if r is None:
                continue
            t.count[node] = len(r)
            best = None
            if node < size // 2 and len(r) >= 2 * p.min_leaf:
                h = tables.pop(node, None)
                if h is None:
                    h = self._histogram(places, g, r, features)
                best = self._split(h)
            if best is None:
                t.value[node] = self._leaf(g, resid, r)
                continue
            gain, j, cut, left_missing = best
            t.feature[node], t.cut[node], t.missing_left[node], t.gain[node] = features[j], cut, left_missing, gain
            v = b[r, features[j]]
            left = np.where(v == 0, left_missing, v <= cut)
            at[2 * node + 1], at[2 * node + 2] = r[left], r[~left]
            if 2 * node + 1 < size // 2:  # the larger child's table is the parent's less the smaller one's
                small, large = sorted((2 * node + 1, 2 * node + 2), key=lambda c: len(at[c]))
                tables[small] = self._histogram(places, g, at[small], features)
                tables[large] = h - tables[small]
        return t

    def _leaf(self, g: np.ndarray, resid: np.ndarray, r: np.ndarray) -> float:
        """A Newton step, or the rows' own quantile where the loss has no curvature."""
        p = self.params
        if p.objective == "l2":
            return -g[r].sum() / (len(r) + p.l2) * p.rate
        return float(np.quantile(resid[r], 0.5 if p.objective == "l1" else p.alpha)) * p.rate

    def _leaves(self, t: _Tree, b: np.ndarray) -> np.ndarray:
        node = np.zeros(len(b), np.int64)
        for _ in range(self.params.depth):
            inner = np.flatnonzero(t.feature[node] >= 0)
            k = node[inner]
            v = b[inner, t.feature[k]]
            left = np.where(v == 0, t.missing_left[k], v <= t.cut[k])
            node[inner] = 2 * k + np.where(left, 1, 2)
        return node

    def fit(self, x: np.ndarray, y: np.ndarray, x_valid: np.ndarray | None = None, y_valid: np.ndarray | None = None, patience: int = 100) -> Booster:
        p, rng = self.params, np.random.default_rng(self.params.seed)
        x = np.asarray(x, float)
        self.edges = [np.unique(np.nanquantile(c, np.linspace(0, 1, p.bins + 1)[1:-1])) if (~np.isnan(c)).any() else np.zeros(0) for c in x.T]
        b = self._bin(x)
        q = 0.5 if p.objective == "l1" else p.alpha
        self.start = float(y.mean() if p.objective == "l2" else np.quantile(y, q))
        places = b + np.arange(b.shape[1]) * (p.bins + 2)
        f = np.full(len(y), self.start)
        bv, fv, least = (None, None, np.inf) if x_valid is None else (self._bin(np.asarray(x_valid, float)), np.full(len(y_valid), self.start), np.inf)
        for i in range(p.rounds):
            rows = np.arange(len(y)) if p.rows >= 1 else np.sort(rng.choice(len(y), max(1, int(len(y) * p.rows)), replace=False))
            features = np.arange(x.shape[1]) if p.columns >= 1 else np.sort(rng.choice(x.shape[1], max(1, int(x.shape[1] * p.columns)), replace=False))
            t = self._grow(b, places, self._gradient(y, f), y - f, rows, features)
            self.trees.append(t)
            f = f + t.value[self._leaves(t, b)]
            if bv is not None:
                fv = fv + t.value[self._leaves(t, bv)]
                loss = self._loss(y_valid, fv)
                if loss < least - 1e-12:
                    least, self.best = loss, i + 1
                elif i + 1 - self.best >= patience:
                    break
            else:
                self.best = i + 1
        self.trees = self.trees[: self.best]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(np.asarray(x, float))
        return self.start + sum((t.value[self._leaves(t, b)] for t in self.trees), np.zeros(len(b)))

    def gain(self, n: int) -> np.ndarray:
        out = np.zeros(n)
        for t in self.trees:
            np.add.at(out, t.feature[t.feature >= 0], t.gain[t.feature >= 0])
        return out

    def base(self) -> float:
        """What contributions() start from: the mean prediction over the training rows that the trees' nodes counted."""
        return self.start + sum(float(t.value[k] * t.count[k]) / t.count[0] for t in self.trees for k in np.flatnonzero((t.feature < 0) & (t.count > 0)))

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """Each feature's Shapley value for each prediction; a row's add up to its prediction less base().

        A coalition's value is the tree's mean over paths: known features are followed, others weighted by their share of
        training rows. A leaf's part of it is a product over the features of its path, so its Shapley values depend only on which
        of these (at most ``depth``) lead a row there: a table of all such cases for each leaf is looked up by row.
        """
        b = self._bin(np.asarray(x, float))
        out = np.zeros((len(b), b.shape[1]))
        for t in self.trees:
            inner = np.flatnonzero(t.feature >= 0)
            left = {}
            for k in inner:
                v = b[:, t.feature[k]]
                left[int(k)] = np.where(v == 0, t.missing_left[k], v <= t.cut[k])
            for leaf in np.flatnonzero((t.feature < 0) & (t.count > 0)):
                share: dict[int, float] = {}
                goes: dict[int, np.ndarray] = {}
                node = int(leaf)
                while node:
                    up, is_left = (node - 1) // 2, node % 2 == 1
                    f = int(t.feature[up])
                    share[f] = share.get(f, 1.0) * t.count[node] / t.count[up]
                    goes[f] = goes.get(f, True) & (left[up] if is_left else ~left[up])
                    node = up
                if share:
                    table = _shapley(np.array(list(share.values()))) * t.value[leaf]
                    case = sum(goes[f].astype(np.int64) << i for i, f in enumerate(goes))
                    out[:, list(goes)] += table[case]
        return out


def _shapley(share: np.ndarray) -> np.ndarray:
    """Shapley values of the product of 0/1 for known and ``share`` for unknown features: a row for each case of ones, a column a feature."""
    n = len(share)
    ones = (np.arange(1 << n)[:, None] >> np.arange(n) & 1).astype(float)
    out = np.zeros_like(ones)
    for f in range(n):
        by_size = np.ones((1 << n, 1))  # sums over coalitions of the other features, by their size
        for g in range(n):
            if g != f:
                by_size = np.pad(by_size * share[g], ((0, 0), (0, 1))) + np.pad(by_size * ones[:, g : g + 1], ((0, 0), (1, 0)))
        weight = np.array([factorial(k) * factorial(n - k - 1) / factorial(n) for k in range(n)])
        out[:, f] = (by_size @ weight) * (ones[:, f] - share[f])
    return out
