"""Recompression of word sequences: equal stretches of text get equal symbols away from their ends.

Each round names maximal runs of a token, or pairs of neighbours from the two halves of a random split of the
alphabet (Jez, "Recompression", 2013). A name is a 64-bit hash of what it stands for, so it is global: every
executor gives the same stretch the same name and no round needs an exchange. Beside each symbol goes the range
of words that decided it (``lo:hi``); a symbol is the same in every text that agrees on that range.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tidegrid.llm.tokens import mix

_RUN, _PAIR = np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3)


@dataclass
class Level:
    name: np.ndarray
    start: np.ndarray
    size: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    row: np.ndarray

    def take(self, keep: np.ndarray) -> Level:
        return Level(*(x[keep] for x in vars(self).values()))


def _runs(x: Level, cap: int, first: np.ndarray, last: np.ndarray) -> Level:
    """Maximal runs of one token, up to ``cap`` words, become one symbol; longer runs stay as they are."""
    n = len(x.name)
    new = np.ones(n, bool)
    new[1:] = (x.name[1:] != x.name[:-1]) | (x.row[1:] != x.row[:-1])
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, n))
    owner = np.repeat(np.arange(len(at)), length)
    begin, end = x.start[at], x.start[at] + length
    whole = length <= cap
    keep = new | ~whole[owner]
    out = x.take(keep)
    owner, whole = owner[keep], whole[owner[keep]]
    out.size = np.where(whole, length[owner], 1)
    out.name = np.where(whole & (out.size > 1), mix(out.name * _RUN + out.size.astype(np.uint64)), out.name)
    # A whole run was decided by the words on both of its sides, a piece of a long one by cap words around it.
    out.lo = np.where(whole, begin[owner] - 1, np.maximum(begin[owner], out.start - cap))
    out.hi = np.where(whole, end[owner] + 1, np.minimum(end[owner], out.start + cap + 1))
    return out


def _pairs(x: Level, salt: int, cap: int) -> Level:
    """Neighbours (a, b) with a in the left and b in the right half of this round's split become one symbol."""
    n = len(x.name)
    left = (mix(x.name + mix(np.full(1, salt, np.uint64))) & np.uint64(1)).astype(bool)
    same = np.zeros(n + 1, bool)
    same[1:n] = x.row[1:] == x.row[:-1]
    fits = np.zeros(n + 1, bool)
    fits[1:n] = x.size[1:] + x.size[:-1] <= cap
    joins = np.zeros(n + 1, bool)  # joins[i]: symbols i-1 and i become one
    joins[1:n] = same[1:n] & fits[1:n] & left[:-1] & ~left[1:]
    taken, second = joins[1:], joins[:n]
    alone = ~taken & ~second & (x.size < cap)
    lo, hi = x.lo.copy(), x.hi.copy()
    # Left alone: a left symbol by what follows it, a right one by what stands before it; past a row's end nothing is known.
    i = np.flatnonzero(alone & left)
    nxt = np.minimum(i + 1, n - 1)
    inside = same[i + 1]
    hi[i] = np.where(inside, np.maximum(hi[i], x.hi[nxt]), x.start[i] + x.size[i] + 1)
    lo[i] = np.where(inside, np.minimum(lo[i], x.lo[nxt]), lo[i])
    i = np.flatnonzero(alone & ~left)
    prv = np.maximum(i - 1, 0)
    inside = same[i]
    lo[i] = np.where(inside, np.minimum(lo[i], x.lo[prv]), x.start[i] - 1)
    hi[i] = np.where(inside, np.maximum(hi[i], x.hi[prv]), hi[i])
    name, size = x.name.copy(), x.size.copy()
    i = np.flatnonzero(taken)
    name[i] = mix(mix(x.name[i] ^ _PAIR) * _RUN + x.name[i + 1])
    size[i] += x.size[i + 1]
    lo[i], hi[i] = np.minimum(x.lo[i], x.lo[i + 1]), np.maximum(x.hi[i], x.hi[i + 1])
    return Level(name, x.start, size, lo, hi, x.row).take(~second)


def levels(hashes: np.ndarray, first: np.ndarray, rounds: int, cap: int) -> list[Level]:
    """The symbols of rows of words (``first[r]:first[r+1]`` are row r's), single words first, of at most ``cap`` words."""
    n = len(hashes)
    pos = np.arange(n)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = [Level(hashes, pos, np.ones(n, np.int64), pos, pos + 1, row)]
    if n:
        out.append(_runs(out[0], cap, first[row], first[row + 1]))
        for r in range(rounds):
            out.append(_pairs(out[-1], r + 1, cap))
    return out


def anchors(hashes: np.ndarray, first: np.ndarray, window: int, rounds: int, cap: int) -> Level:
    """For every window of words one symbol that the window alone decides; the symbols so chosen.

    A window takes its symbols of the highest level that has any whose deciding words it holds, and of these the one
    of most words, then of least hash. Two equal windows hold equal symbols at equal places, whatever surrounds them, so they choose
    alike; a single word is a symbol of the lowest level, so every window has one. ``lo:hi`` of a returned symbol are
    the windows (by first word, end inclusive) that hold it.
    """
    row_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    n = len(hashes)
    begin, end = first[row_of], first[row_of + 1]
    open_ = np.arange(n) + window <= end
    found = []
    for x in reversed(levels(hashes, first, rounds, cap)):
        if not open_.any():
            break
        a = np.maximum(x.hi - window, begin[x.start])
        b = np.minimum(x.lo, end[x.start] - window)
        ok = a <= b
        total = np.concatenate([[0], np.cumsum(open_)])
        ok[ok] = total[b[ok] + 1] > total[a[ok]]
        if not ok.any():
            continue
        got = x.take(ok)
        got.lo, got.hi = a[ok], b[ok]
        rank = (mix(got.name ^ _RUN) >> np.uint64(8)) | (np.uint64(255) - np.minimum(got.size, 255).astype(np.uint64) << np.uint64(56))
        span = got.hi - got.lo + 1
        at = np.repeat(got.lo - np.concatenate([[0], np.cumsum(span)[:-1]]), span) + np.arange(span.sum())
        best = np.full(n, np.iinfo(np.uint64).max)
        each = np.repeat(rank, span)
        np.minimum.at(best, at, each)
        chosen = (best[at] == each) & open_[at]
        found.append(got.take(np.add.reduceat(chosen, np.cumsum(span) - span) > 0))
        held = np.zeros(n, bool)
        held[at] = True
        open_ &= ~held
    if not found:
        e = np.zeros(0, np.int64)
        return Level(np.zeros(0, np.uint64), e, e, e, e, e)
    out = Level(*(np.concatenate([getattr(f, k) for f in found]) for k in vars(found[0])))
    # A text that repeats itself names the same symbol again and again: windows that follow on become one entry.
    out = out.take(np.lexsort((out.lo, out.name, out.row)))
    new = np.ones(len(out.name), bool)
    new[1:] = (out.name[1:] != out.name[:-1]) | (out.row[1:] != out.row[:-1]) | (out.lo[1:] > out.hi[:-1] + 1)
    at = np.flatnonzero(new)
    hi = np.maximum.reduceat(out.hi, at)
    out = out.take(at)
    out.hi = hi
    return out
