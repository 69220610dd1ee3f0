"""Words and their 64-bit hashes, computed for whole Arrow buffers at once.

A word is a maximal run of bytes other than space and \\x09-\\x0D. Everything here works on
byte offsets of one contiguous buffer, so no Python object is made for a word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled in one numpy step; bounds a worker's memory whatever the batch size.
STEP_BYTES = 2 << 20

_K1, _K2, _K3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_LOW = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_WORD = np.ones(256, dtype=bool)
_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: For comparing text of other origins: any non-ASCII byte counts as a letter, ASCII punctuation separates.
_ALNUM = np.array([x >= 128 or chr(x).isalnum() for x in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


_HELD: dict[str, object] = {}


def keep_only(owner: str, clear) -> None:
    """What a worker process remembers between tasks, kept for one operator at a time: another's memo tables are cleared first,
    and what the allocators hold of them goes back to the system."""
    others = [k for k in _HELD if k != owner]
    for other in others:
        _HELD.pop(other)()
    _HELD[owner] = clear
    if others:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
        if trim:
            trim(0)


def slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """A batch in parts of few rows, so that a worker never holds what it makes of all of them."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(32))
    x = x * _K3
    x = x ^ (x >> np.uint64(29))
    x = x * _K2
    return x ^ (x >> np.uint64(32))


@dataclass
class Words:
    """The words of some rows. ``first[i]:first[i+1]`` are the words of row i; starts and ends are byte offsets in data."""

    rows: slice
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """One 64-bit hash for each word, a function of its bytes alone."""
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        left = self.ends - self.starts
        h = mix(left.astype(np.uint64) + _K1)
        at, pos = None, self.starts
        while len(pos):
            v = eight[pos] & _LOW[np.minimum(left, 8)]
            part = h if at is None else h[at]
            part = (part ^ (v * _K1)) * _K2
            part ^= part >> np.uint64(31)
            if at is None:
                h = part
            else:
                h[at] = part
            more = np.flatnonzero(left > 8)
            at = more if at is None else at[more]
            pos, left = pos[more] + 8, left[more] - 8
        return mix(h)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def binary_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string or binary column; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_binary(col.type) or pa.types.is_large_string(col.type)
    _, offsets, data = col.buffers()
    if len(col) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def split_words(col: pa.Array, lower: bool, step: int = STEP_BYTES, alnum: bool = False) -> Iterator[Words]:
    """The words of all rows of a column, in groups of rows of about ``step`` bytes; a longer row is a group of its own.

    With ``alnum`` words are runs of ASCII letters, digits and bytes above 127 instead.
    """
    raw, off = binary_buffer(col)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + step, "right")) - 1)
        data, o = raw[off[i] : off[j]], off[i : j + 1] - off[i]
        if lower:
            data = _LOWER[data]
        word = (_ALNUM if alnum else _WORD)[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[o] = True
        before = np.zeros(len(data), bool)
        before[1:] = word[:-1]
        after = np.zeros(len(data), bool)
        after[:-1] = word[1:]
        starts = np.flatnonzero(word & (~before | edge[:-1]))
        ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        yield Words(slice(i, j), data, starts, ends, np.searchsorted(starts, o))
        i = j
