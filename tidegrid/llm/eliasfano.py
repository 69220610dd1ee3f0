"""Elias-Fano sequences: sorted integers in about 2 + log2(universe / n) bits each, searched without unpacking."""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: _NTH[b, k]: place of the k-th set bit of byte b (8 if there is none).
_NTH = np.full((256, 8), 8, np.uint8)
for _b in range(256):
    _at = [i for i in range(8) if _b >> i & 1]
    _NTH[_b, : len(_at)] = _at


def _pack_low(values: np.ndarray, width: int) -> np.ndarray:
    parts = []
    for i in range(0, len(values), 1 << 16):  # 2^16 values of any width end on a whole word
        v = values[i : i + (1 << 16)]
        bits = np.unpackbits(v.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little", count=width)
        parts.append(np.packbits(bits.reshape(-1), bitorder="little"))
    raw = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    return np.concatenate([raw, np.zeros(16 - len(raw) % 8, np.uint8)]).view(np.uint64)


class EliasFano:
    """``high``: bit v//2^l + i is set for the i-th value v; ``low``: the values' lower l bits; ``zeros``: unset bits of high before each word."""

    def __init__(self, n: int, width: int, high: np.ndarray, zeros: np.ndarray, low: np.ndarray):
        self.n, self.width, self.high, self.zeros, self.low = n, width, high, zeros, low
        self._ones: np.ndarray | None = None

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        width = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
        top = int(universe >> width) + 1
        bits = np.zeros((n + top + 64) // 64 * 64 + 64, np.uint8)
        bits[(values >> _U(width)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(high).astype(np.int64)
        zeros = np.concatenate([[0], np.cumsum(64 - ones)[:-1]])
        return cls(n, width, high, zeros, _pack_low(values, width))

    def _select(self, before: np.ndarray, words, k: np.ndarray) -> np.ndarray:
        """Place of the k-th set bit of words, of which words(w) is the w-th and has before[w] set bits before it."""
        word = np.searchsorted(before, k, "right") - 1
        left, each, at = k - before[word], words(word), word * 64
        for half in (32, 16, 8):  # is it in the upper half? At last one byte is left, and a table says where in it
            lower = np.bitwise_count(each & _U((1 << half) - 1))
            upper = left >= lower
            left = left - lower * upper
            step = upper * half
            each, at = each >> step.astype(np.uint64), at + step
        return at + _NTH[each & _U(255), left]

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th unset bit of high."""
        return self._select(self.zeros, lambda w: ~self.high[w], k)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Elements by index."""
        if self._ones is None:
            self._ones = np.arange(len(self.zeros)) * 64 - self.zeros
        at = self._select(self._ones, lambda w: self.high[w], i)
        return (((at - i).astype(np.uint64) << _U(self.width)) | self.lows(i)).astype(np.int64)

    def lows(self, i: np.ndarray) -> np.ndarray:
        if self.width == 0:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * _U(self.width)
        word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
        v = self.low[word] >> shift
        over = shift > _U(64 - self.width)
        v |= np.where(over, self.low[word + 1] << ((_U(64) - shift) & _U(63)), _U(0))
        return v & _U((1 << self.width) - 1)

    def successor(self, values: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """Index of the first element of at least each value (n if none), among elements lo:hi where given; values lie in the universe."""
        return self._successor(values.astype(np.uint64), lo, hi)[0]

    def _successor(self, v: np.ndarray, lo: np.ndarray | None, hi: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """The successors, and where the elements with the value's upper part end."""
        h = (v >> _U(self.width)).astype(np.int64)
        low = v & _U((1 << self.width) - 1)
        end = self._zero(h) - h
        i = np.zeros(len(v), np.int64)
        some = np.flatnonzero(h > 0)
        i[some] = self._zero(h[some] - 1) - (h[some] - 1)
        if lo is not None:
            i, end = np.clip(i, lo, hi), np.minimum(end, hi)
        stop = end.copy()
        # Elements with one upper part are as many as a frequent context has followers: halve, don't walk.
        open_ = np.flatnonzero(i < end)
        while len(open_):
            mid = (i[open_] + end[open_]) // 2
            less = self.lows(mid) < low[open_]
            i[open_] = np.where(less, mid + 1, i[open_])
            end[open_] = np.where(less, end[open_], mid)
            open_ = open_[i[open_] < end[open_]]
        return i, stop

    def values(self) -> np.ndarray:
        """All elements."""
        at = np.flatnonzero(np.unpackbits(np.ascontiguousarray(self.high).view(np.uint8), bitorder="little"))
        i = np.arange(self.n)
        return ((at - i).astype(np.uint64) << _U(self.width)) | self.lows(i)

    def find(self, values: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """Index of each value, -1 where it isn't an element (of lo:hi, where given)."""
        v = values.astype(np.uint64)
        i, stop = self._successor(v, lo, hi)
        out = np.full(len(i), -1, np.int64)
        k = np.flatnonzero(i < stop)
        k = k[self.lows(i[k]) == (v[k] & _U((1 << self.width) - 1))]
        out[k] = i[k]
        return out

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.size": np.array([self.n, self.width]), f"{name}.high": self.high, f"{name}.zeros": self.zeros, f"{name}.low": self.low}

    @classmethod
    def from_arrays(cls, get, name: str) -> EliasFano:
        n, width = (int(x) for x in get(f"{name}.size"))
        return cls(n, width, get(f"{name}.high"), get(f"{name}.zeros"), get(f"{name}.low"))
