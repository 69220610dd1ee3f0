"""Byte-level BPE by backtracking over an Aho-Corasick automaton."""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.tokens import keep_only, slices

#: What a worker's memo table may hold before it starts anew, in entries and in bytes, and the longest argument that it keeps at all;
#: they bound memory, never results.
MEMO = 300_000
MEMO_BYTES = 64 << 20
MEMO_ARGUMENT = 256
#: Bytes of a piece for which matches are looked up at once; a longer piece goes through them block by block.
BLOCK = 1 << 14


class Memo(dict):
    """A function's values by argument; emptied when it holds too much."""

    def __init__(self, f, most: int = MEMO):
        super().__init__()
        self.f, self.most, self.bytes = f, most, 0

    def __missing__(self, key):
        v = self.f(key)
        if isinstance(key, str):
            if len(key) > MEMO_ARGUMENT:
                return v
            self.bytes += len(key) + len(v) + 200
        if len(self) >= self.most or self.bytes > MEMO_BYTES:
            self.clear()
            self.bytes = 0
        self[key] = v
        return v


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one token in base64 and its rank to a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Bpe:
    """Encodes pieces of text as repeated merging of the lowest-ranked pair would.

    A sequence of tokens is what merging gives if and only if each adjacent pair is what merging gives for the pair's own
    bytes. So a piece is covered from left to right by the longest token found at each place, stepping back to shorter
    ones (or to the token before) when a pair is not compatible. Compatibility of a pair is worked out once and kept.
    Bytes are mapped to Latin-1 characters, in which the automaton finds all tokens of a piece in one pass.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            if self.merge(token) == [i]:  # others never come out of merging
                self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()
        self.longest = max(map(len, ranks), default=1)
        self.fits = Memo(self._fits, MEMO * 2 // 3)
        self.piece = Memo(self._piece, MEMO * 2 // 3)
        self.chunk = Memo(self._chunk)

    def merge(self, piece: bytes) -> list[int]:
        """The definition itself: merge the adjacent pair of lowest rank, the leftmost first, until none is a token."""
        get, none = self.ranks.get, 1 << 60
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while pairs and (least := min(pairs)) < none:
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
        return [self.ranks[x] for x in parts]

    def _fits(self, pair: tuple[int, int]) -> bool:
        return self.merge(self.tokens[pair[0]] + self.tokens[pair[1]]) == list(pair)

    def encode_piece(self, piece: bytes) -> list[int] | array:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        if n > BLOCK:
            return self._encode_long(piece)
        at: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (i, size) in self.automaton.iter(piece.decode("latin-1")):
            at[end + 1 - size].append((i, size))
        out: list[tuple[int, int, int]] = []  # token, size, which of at[place] it is
        dead = bytearray(n + 1)  # places from which no compatible cover goes on
        fits, pos = self.fits, 0
        k = len(at[0]) - 1
        while pos < n:
            last = out[-1][0] if out else None
            found = at[pos]
            while k >= 0:
                i, size = found[k]
                if not dead[pos + size] and (last is None or fits[last, i]):
                    break
                k -= 1
            if k >= 0:
                out.append((i, size, k))
                pos += size
                k = len(at[pos]) - 1 if pos < n else 0
            else:
                # The first cover that reaches a place is the only one that merging allows up to there.
                dead[pos] = 1
                _, size, k = out.pop()
                pos -= size
                k -= 1
        return [x[0] for x in out]

    def _encode_long(self, piece: bytes) -> array:
        """The same for a piece of any length: tokens and choices in flat arrays, matches of the last few blocks only."""
        n, longest = len(piece), self.longest
        blocks: dict[int, list[list[tuple[int, int]]]] = {}

        def matches(pos: int) -> list[tuple[int, int]]:
            b = pos // BLOCK
            got = blocks.get(b)
            if got is None:
                if len(blocks) >= 4:
                    del blocks[min(blocks) if b > min(blocks) else max(blocks)]
                begin = b * BLOCK
                got = blocks[b] = [[] for _ in range(min(BLOCK, n - begin))]
                for end, (i, size) in self.automaton.iter(piece[begin : begin + BLOCK + longest].decode("latin-1")):
                    if end + 1 - size < len(got):
                        got[end + 1 - size].append((i, size))
            return got[pos - b * BLOCK]

        tokens, choices, dead = array("I"), array("H"), bytearray(n + 1)
        fits, sizes, pos = self.fits, self.tokens, 0
        k = len(matches(0)) - 1
        while pos < n:
            last = tokens[-1] if tokens else None
            found = matches(pos)
            while k >= 0:
                i, size = found[k]
                if not dead[pos + size] and (last is None or fits[last, i]):
                    break
                k -= 1
            if k >= 0:
                tokens.append(i)
                choices.append(k)
                pos += size
                k = len(matches(pos)) - 1 if pos < n else 0
            else:
                dead[pos] = 1
                pos -= len(sizes[tokens.pop()])
                k = choices.pop() - 1
        return tokens

    def _piece(self, piece: str) -> bytes:
        ids = self.encode_piece(piece.encode())
        return ids.tobytes() if isinstance(ids, array) else struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, text: str) -> bytes:
        return b"".join([self.piece[x] for x in self.split(text)])

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        # A piece always begins at a single space between two non-spaces, so a text may be cut there and its parts looked up.
        parts = text.split(" ")
        if len(parts) > 1:
            edges = [i for i, p in enumerate(parts) if not p or not _solid(p)]
            if edges:
                joined, held, at = [], parts[0], set(edges)
                for i in range(1, len(parts)):
                    if i in at or i - 1 in at:
                        held += " " + parts[i]
                    else:
                        joined.append(held)
                        held = " " + parts[i]
                return b"".join([self.chunk[x] for x in [*joined, held]])
            return b"".join([self.chunk[parts[0]], *[self.chunk[" " + p] for p in parts[1:]]])
        return self.chunk[text]

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in memoryview(ids).cast("I")])


def _solid(p: str) -> bool:
    """Neither end is white space."""
    return not (p[0].isspace() or p[-1].isspace())


_LOADED: dict[tuple[str, str], Bpe] = {}


def loaded(path: str, pattern: str) -> Bpe:
    """One encoder a worker process, kept between its tasks."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Bpe(read_ranks(path), pattern)
    keep_only("bpe", _LOADED.clear)
    return _LOADED[path, pattern]


def _strings(col: pa.Array) -> Iterator[str]:
    return (x.as_py() or "" for x in col)


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string): token ids of every whole text and the text that they decode to.

    ``vocabulary`` is a rank file that every executor can open; ``pattern`` splits a text into the pieces that are
    encoded separately. Null and empty texts have no ids and decode to the empty text. Ids and repeated rows come back
    as they came; an empty table gives no rows.
    """

    def run(batches):
        bpe = loaded(vocabulary, pattern)
        for b in (part for batch in batches for part in slices(batch)):
            ids = [bpe.encode(t) for t in _strings(b.column(1))]
            off = np.cumsum([0] + [len(x) // 4 for x in ids]).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(ids), np.int32))
            texts = pa.array([bpe.decode(x) for x in ids], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(off), flat), texts], ["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, ids array<int>, decoded string")


def digests(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode() with the ids and the decoded bytes as SHA-256 in hex."""

    def run(batches):
        bpe = loaded(vocabulary, pattern)
        for b in (part for batch in batches for part in slices(batch)):
            n, x, y = [], [], []
            for t in _strings(b.column(1)):
                ids = bpe.encode(t)
                n.append(len(ids) // 4)
                x.append(hashlib.sha256(ids).hexdigest())
                y.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(x, pa.string()), pa.array(y, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
