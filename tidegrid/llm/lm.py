"""N-gram language model in an Elias-Fano trie, trained and queried in parallel."""

from __future__ import annotations

import io
import os
import zlib
from collections import OrderedDict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.eliasfano import EliasFano
from tidegrid.llm.store import cut, drop, remove, shared_dir
from tidegrid.llm.tokens import split_words

#: The hash that stands for a text's end; the context of its first word too.
END = np.uint64(0x2545F4914F6CDD1D)
#: log10 probabilities are kept as 16-bit steps of -_STEP.
_STEP = 16 / 65535
_SIGN = np.uint64(1 << 63)
#: Bytes of text whose tokens are looked up together: a walk through the files costs the same for many as for few.
STEP = 4 << 20
#: Training tokens for one file of the second level; heavier contexts are spread over several.
SHARD_TOKENS = 2_000_000


def _quantise(log10p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10p / _STEP), 0, 65535).astype(np.uint16)


def _save(path: str, arrays: dict[str, np.ndarray]) -> None:
    """One .npy file an array; written aside and renamed, so that a repeated task leaves the same file."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(path)
        store.create_dir(at, recursive=True)
        for k, v in arrays.items():
            with store.open_output_stream(f"{at}/{k}.npy") as f:
                np.save(f, v)
        return
    os.makedirs(path, exist_ok=True)
    for k, v in arrays.items():
        part = f"{path}/{k}.{os.getpid()}.part.npy"
        np.save(part, v)
        os.replace(part, f"{path}/{k}.npy")


#: Files that a worker process keeps open: mapped ones, and such of a store that isn't mounted, which it holds in memory.
OPEN_FILES, HELD_FILES = 16, 8


def _mapped(path: str) -> bool:
    return path.startswith("file:") or "://" not in path


def _open(path: str):
    """Arrays of a folder, memory-mapped; of a store that isn't mounted they are read. Nothing is copied to the executor's own disk."""
    if _mapped(path):
        if path.startswith("file:"):
            path = "/" + path[5:].lstrip("/")
        return lambda name: np.load(f"{path}/{name}.npy", mmap_mode="r")
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)

    def read(name: str) -> np.ndarray:
        with store.open_input_file(f"{at}/{name}.npy") as f:
            return np.load(io.BytesIO(f.read()))

    return read


def _sequence(w) -> tuple[np.ndarray, np.ndarray]:
    """Words' hashes with each row's end after them, and where each row begins."""
    ends = w.first[1:]
    return np.insert(w.hashes(), ends, END), w.first + np.arange(len(w.first))


def _sum_by_key(keys: np.ndarray, counts: np.ndarray, extra: np.ndarray = np.zeros(0, np.uint16)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct sorted keys, their counts added up, and of ``extra`` (equal for equal keys) one each."""
    if not len(keys):
        return keys, counts, extra
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(counts, at), extra[order][at] if len(extra) else extra


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, a place of each among ``keys`` (any), and for each of ``keys`` which one it is."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    back = np.empty(len(keys), np.int64)
    back[order] = np.cumsum(new) - 1
    return keys[new], order[new], back


class _Tally:
    """Keys, counts and a number that goes with each key, merged whenever more than ``most`` new ones have come."""

    def __init__(self, most: int = 3_000_000):
        self.held, self.most, self.parts = 0, most, []

    def add(self, keys: np.ndarray, extra: np.ndarray | None = None) -> None:
        k, at, back = _distinct(keys)
        self.parts.append((k, np.bincount(back, minlength=len(k)), np.zeros(0, np.uint16) if extra is None else extra[at]))
        self.held += len(k)

    def full(self) -> bool:
        return self.held > self.most

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint16)
        out = _sum_by_key(*(np.concatenate(x) for x in zip(*self.parts)))
        self.held, self.parts = 0, []
        return out


def _pack(x: np.ndarray) -> bytes:
    """Differences in planes of bytes, so that what is small costs little."""
    return zlib.compress(np.diff(x.astype(np.uint64), prepend=_U0).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


_U0 = np.uint64(0)


def _unpack(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(b), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1), dtype=np.uint64)


@dataclass
class Trie:
    """What a query needs to know beside the files: a few numbers for each file.

    ``names``: the files of the first level that have words, ``words``: the first hash of each, ``bases``: words before it. ``cuts``: first key of each file of
    the second level, a key being context * n_words + word; ``pair_bases``: pairs before it. A pair's number is its place among all
    pairs; file k of the third level has the words that follow the pairs of file k, ``third`` tells which of these exist.
    """

    path: str
    n_tokens: int = 0
    n_words: int = 0
    names: list[int] = field(default_factory=list)
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    bases: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    cuts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    discount: float = 0.5
    pair_bases: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    third: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))

    def _files(self, level: int, k: int):
        cache = self.__dict__.setdefault("_cache", OrderedDict())
        if (level, k) in cache:
            cache.move_to_end((level, k))
        else:
            if len(cache) >= (OPEN_FILES if _mapped(self.path) else HELD_FILES):
                cache.popitem(last=False)
            get = _open(f"{self.path}/{level}-{self.names[k] if level == 1 else k}")
            if level == 1:
                cache[level, k] = EliasFano.from_arrays(get, "words"), get("counts"), get("prob")
            else:
                cache[level, k] = EliasFano.from_arrays(get, "begin"), EliasFano.from_arrays(get, "keys"), get("prob"), get("bow")
        return cache[level, k]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_cache"}

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id or -1, training count, log10 probability alone) of sorted distinct hashes (in order of hash)."""
        out, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        prob = np.full(len(hashes), np.log10(1 / (self.n_tokens + self.n_words + 1)))
        edges = np.searchsorted(hashes, self.words)
        for k in range(len(self.words)):
            a, b = edges[k], edges[k + 1] if k + 1 < len(edges) else len(hashes)
            if a == b:
                continue
            words, count, p = self._files(1, k)
            i = words.find(hashes[a:b])
            ok = np.flatnonzero(i >= 0)
            out[a + ok] = self.bases[k] + i[ok]
            counts[a + ok] = count[i[ok]]
            prob[a + ok] = -_STEP * p[i[ok]].astype(np.float64)
        return out, counts, prob

    def alone(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(training count, log10 probability alone) of sorted ids."""
        counts, prob = np.zeros(len(ids), np.int64), np.zeros(len(ids))
        edges = np.append(np.searchsorted(ids, self.bases), len(ids))
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            if a < b:
                _, count, p = self._files(1, k)
                counts[a:b] = count[ids[a:b] - self.bases[k]]
                prob[a:b] = -_STEP * p[ids[a:b] - self.bases[k]].astype(np.float64)
        return counts, prob

    def pairs(self, context: np.ndarray, word: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability of each word after its context, the pair's number or -1); arguments sorted by context, then word; -1: not in training."""
        key = context.astype(np.uint64) * np.uint64(self.n_words) + np.maximum(word, 0).astype(np.uint64)
        out, number = alone.copy(), np.full(len(alone), -1, np.int64)
        known = np.flatnonzero(context >= 0)
        if not len(known):
            return out, number
        key, word, c = key[known], word[known], context[known]
        edges = np.append(np.searchsorted(key, self.cuts), len(key))
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            if a == b:
                continue
            low, at = int(self.cuts[k]), known[a:b]
            of = c[a:b] - low // self.n_words
            p, i = self._followers(2, k, of, word[a:b], key[a:b] - np.uint64(low), out[at])
            out[at] = p
            number[at] = np.where(i >= 0, i + self.pair_bases[k], -1) if len(self.pair_bases) > k else -1
        return out, number

    def triples(self, pair: np.ndarray, word: np.ndarray, two: np.ndarray) -> np.ndarray:
        """log10 probability of each word after a pair of words, given by its number, and ``two``: that after the pair's second word alone.

        Arguments sorted by pair, then word. A pair that training never continued says nothing: there ``two`` stands.
        """
        out = two.copy()
        known = np.flatnonzero(pair >= 0)
        pair, word = pair[known], word[known]
        edges = np.searchsorted(pair, self.pair_bases)
        for k in np.flatnonzero(self.third):
            a, b = edges[k], edges[k + 1]
            if a < b:
                of, at = pair[a:b] - self.pair_bases[k], known[a:b]
                key = of.astype(np.uint64) * np.uint64(self.n_words) + np.maximum(word[a:b], 0).astype(np.uint64)
                out[at] = self._followers(3, int(k), of, word[a:b], key, out[at])[0]
        return out

    def _followers(self, level: int, k: int, of: np.ndarray, word: np.ndarray, key: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability, index in the file or -1): the pointers of a context bound its followers; the word's key is looked for among these.

        What training did not see there has the probability of the level below times the context's share for it.
        """
        begin, keys, prob, bow = self._files(level, k)
        out = below - _STEP * bow[of].astype(np.float64)
        index = np.full(len(of), -1, np.int64)
        new = np.concatenate([[True], of[1:] != of[:-1]])
        own, which = of[new], np.cumsum(new) - 1
        first, last = begin.get(own)[which], begin.get(own + 1)[which]
        some = np.flatnonzero((first < last) & (word >= 0))
        index[some] = keys.find(key[some], first[some], last[some])
        hit = np.flatnonzero(index >= 0)
        out[hit] = -_STEP * prob[index[hit]].astype(np.float64)
        return out, index


def train(docs: DataFrame, text_col: str = "text", order: int = 3) -> Trie:
    """A trie of words, pairs and (order 3) triples of all texts, in files below the shared folder.

    Tokens are the texts' words (runs of bytes other than space and \\x09-\\x0D, A-Z lower-cased) and an end for each text; null
    and empty texts are an end alone. Probabilities are interpolated absolute discounting over add-one unigrams.

    Level 1 holds the words' hashes, level 2 for each context (a word, by its index in level 1) the words that follow it, level 3
    for each pair (by its index in level 2) the words that follow that. All are Elias-Fano sequences in files of bounded size; a
    context's followers are found at ``begin`` (monotone pointers) and as one range of keys. A pass for each level counts: each
    task counts what it reads and sends each file's share as one packed row, so an exchange carries a few bytes for each
    distinct pair or triple and a frequent one costs no more. A context of very many tokens is spread over several files. No counts are dropped. Ids are not read; a repeated row counts as
    often as it comes. 2^32 distinct words or more are an error.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(text_col).cast("binary").alias("text"))

    def words(batches):
        tally = _Tally()

        def rows():
            k, c, _ = tally.take()
            return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "c"])

        for b in batches:
            for w in split_words(b.column(0), lower=True):
                tally.add(_sequence(w)[0])
                if tally.full():
                    yield rows()
        yield rows()

    counts = cut(d.mapInArrow(words, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "vocabulary")
    total = counts.agg(F.count("*").alias("v"), F.sum("c").alias("n")).first()
    trie = Trie(shared_dir(spark, "trie"), int(total.n or 0), int(total.v))
    if trie.n_words >= 1 << 32:
        raise ValueError(f"{trie.n_words} distinct words: a pair of words must fit 64 bits")
    if not trie.n_words:
        return trie
    # The first level: files by equal ranges of the hash, which is uniform.
    n1 = max(1, -(-trie.n_words // 1_000_000))
    heavy = max(1, trie.n_tokens // max(1, -(-trie.n_tokens // SHARD_TOKENS)))
    of = F.least(F.floor((F.col("h").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64) * n1), F.lit(n1 - 1)).cast("int")
    path, n_tokens, n_words = trie.path, trie.n_tokens, trie.n_words

    def first_level(key, table):
        k = key[0].as_py()
        h = table.column("h").to_numpy().astype(np.int64).view(np.uint64) ^ _SIGN
        order = np.argsort(h)
        h, c = h[order], table.column("c").to_numpy()[order]
        p = np.log10((c + 1.0) / (n_tokens + n_words + 1.0))
        _save(f"{path}/1-{k}", EliasFano.build(h, (1 << 64) - 1).arrays("words") | {"counts": c, "prob": _quantise(p)})
        big = np.flatnonzero(c > heavy)
        return pa.table({"file": [k], "first": [int(h[0]) - (1 << 63)], "n": [len(h)], "big": [big.tolist()], "big_c": [c[big].tolist()]}, schema=_META1)

    got = counts.withColumn("file", of).groupBy("file").applyInArrow(first_level, "file int, first long, n long, big array<long>, big_c array<long>").collect()
    at, big = 0, []
    for r in sorted(got):
        trie.names.append(r.file)
        big += [(at + i, c) for i, c in zip(r.big, r.big_c)]
        at += r.n
    trie.words = np.array([r.first + (1 << 63) for r in sorted(got)], np.uint64)
    trie.bases = np.cumsum([0] + [r.n for r in sorted(got)][:-1])
    # The second level: equal ranges of contexts, and more cuts where a context is heavy.
    v, n2 = trie.n_words, max(1, -(-trie.n_tokens // SHARD_TOKENS))
    cuts = {k * v // n2 * v for k in range(n2)}
    for i, c in big:
        parts = -(-c // heavy)
        cuts |= {i * v + j * v // parts for j in range(parts)} | ({(i + 1) * v} if i + 1 < v else set())
    trie.cuts = np.array(sorted(cuts), np.uint64)
    drop(counts)
    _second_level(d, trie)
    return _third_level(d, trie) if order > 2 else trie


_META1 = pa.schema([("file", pa.int32()), ("first", pa.int64()), ("n", pa.int64()), ("big", pa.list_(pa.int64())), ("big_c", pa.list_(pa.int64()))])


_META2 = pa.schema([("file", pa.int32()), ("n1", pa.int64()), ("n2", pa.int64()), ("n", pa.int64()), ("head", pa.int64()), ("tail", pa.int64())])


def _tokens(w, trie: Trie):
    """Of rows of words: each token's id, count and probability, its context's id, and where the rows begin."""
    seq, first = _sequence(w)
    each, _, back = _distinct(seq ^ _SIGN)
    ids, counts, alone = (x[back] for x in trie.ids(each))
    context = np.empty(len(ids), np.int64)
    context[1:] = ids[:-1]
    context[first[:-1]] = ids[first[1:] - 1]  # all rows end alike
    return ids, counts, alone, context, first


def _second_level(d: DataFrame, trie: Trie) -> Trie:
    def count(batches):
        tally = _Tally()

        def rows():
            k, c, _ = tally.take()
            e = np.append(np.searchsorted(k, trie.cuts), len(k))
            some = np.flatnonzero(e[1:] > e[:-1])
            return pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), pa.array([_pack(k[e[i] : e[i + 1]]) for i in some], pa.binary()), pa.array([_pack(np.cumsum(c[e[i] : e[i + 1]])) for i in some], pa.binary())],
                ["file", "keys", "counts"],
            )

        for b in batches:
            for w in split_words(b.column(0), lower=True):
                ids, _, _, context, _ = _tokens(w, trie)
                tally.add(context.astype(np.uint64) * np.uint64(trie.n_words) + ids.astype(np.uint64))
                if tally.full():
                    yield rows()
        yield rows()

    v, path, cuts = trie.n_words, trie.path, trie.cuts

    def build(key, table):
        k = key[0].as_py()
        keys = [_unpack(x.as_py()) for x in table.column("keys")]
        counts = [np.diff(_unpack(x.as_py()), prepend=_U0).astype(np.int64) for x in table.column("counts")]
        keys, counts, _ = _sum_by_key(np.concatenate(keys), np.concatenate(counts))
        low = int(cuts[k])
        top = int(cuts[k + 1]) if k + 1 < len(cuts) else v * v
        context = (keys // np.uint64(v)).astype(np.int64) - low // v
        n_context = (top - 1) // v - low // v + 1
        begin = np.searchsorted(context, np.arange(n_context + 1))
        arrays = EliasFano.build(keys - np.uint64(low), top - low).arrays("keys") | EliasFano.build(begin, len(keys) + 1).arrays("begin")
        _save(f"{path}/2-{k}", arrays)
        _save(f"{path}-counts/2-{k}", {"counts": np.frombuffer(zlib.compress(counts.tobytes(), 1), np.uint8)})
        ends = [int(begin[1] - begin[0]), int(begin[-1] - begin[-2])]  # of contexts that may go on in the next files
        return pa.table({"file": [k], "n1": [int((counts == 1).sum())], "n2": [int((counts == 2).sum())], "n": [len(keys)], "head": [ends[0]], "tail": [ends[1]]}, schema=_META2)

    packed = d.mapInArrow(count, "file int, keys binary, counts binary")
    got = {r.file: r for r in packed.groupBy("file").applyInArrow(build, "file int, n1 long, n2 long, n long, head long, tail long").collect()}
    trie.discount = _discount(got)
    trie.pair_bases = np.cumsum([0] + [got[k].n if k in got else 0 for k in range(len(cuts))])
    # Followers of contexts that several files share.
    spread: dict[int, int] = {}
    for k in range(len(cuts)):
        low, top = int(cuts[k]), int(cuts[k + 1]) if k + 1 < len(cuts) else v * v
        a, b = low // v, (top - 1) // v
        for c, n in {a: got[k].head if k in got else 0, b: got[k].tail if k in got else 0}.items():
            if low > c * v or top < (c + 1) * v:
                spread[c] = spread.get(c, 0) + n

    def finish(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                low, top = int(cuts[k]), int(cuts[k + 1]) if k + 1 < len(cuts) else v * v
                a, b = low // v, (top - 1) // v
                total, _ = trie.alone(np.arange(a, b + 1))
                keys = counts = np.zeros(0, np.int64)
                arrays = {}
                if k in got:
                    get = _open(f"{path}/2-{k}")
                    keys = EliasFano.from_arrays(get, "keys").values().astype(np.int64) + (low - a * v)
                    counts = np.frombuffer(zlib.decompress(_open(f"{path}-counts/2-{k}")("counts").tobytes()), np.int64)
                else:
                    arrays = EliasFano.build(keys, 1).arrays("keys") | EliasFano.build(np.zeros(b - a + 2, np.int64), 1).arrays("begin")
                context, word = keys // v, keys % v
                followers = np.bincount(context, minlength=b - a + 1).astype(np.float64)
                for c in {a, b} & spread.keys():
                    followers[c - a] = spread[c]
                weight = np.where(followers > 0, trie.discount * followers / total, 1)
                p = np.zeros(len(word))
                order = np.argsort(word)
                p[order] = trie.alone(word[order])[1]
                p = np.maximum(counts - trie.discount, 0) / total[context] + weight[context] * 10**p
                _save(f"{path}/2-{k}", arrays | {"prob": _quantise(np.log10(p)), "bow": _quantise(np.log10(weight))})
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32())], ["file"])

    todo = d.sparkSession.range(0, len(cuts), 1, min(len(cuts), 4096)).select(F.col("id").cast("int").alias("file"))
    todo.mapInArrow(finish, "file int").collect()
    remove(d.sparkSession, f"{path}-counts")
    return trie


def _discount(files: dict) -> float:
    """Absolute discount from how many entries were counted once and twice (Ney, Essen and Kneser)."""
    n1, n2 = sum(r.n1 for r in files.values()), sum(r.n2 for r in files.values())
    return n1 / (n1 + 2 * n2) if n1 and n2 else 0.5


_META3 = pa.schema([("file", pa.int32()), ("n1", pa.int64()), ("n2", pa.int64())])


def _seen_pairs(ids: np.ndarray, context: np.ndarray, alone: np.ndarray, first: np.ndarray, trie: Trie) -> tuple[np.ndarray, np.ndarray]:
    """For each token its log10 probability after the one before it, and the number of the pair before it (-1 for a row's first token)."""
    wide = np.uint64(trie.n_words + 1)
    _, at, back = _distinct((context + 1).astype(np.uint64) * wide + (ids + 1).astype(np.uint64))
    p, number = trie.pairs(context[at], ids[at], alone[at])
    before = np.full(len(ids), -1, np.int64)
    before[1:] = number[back[:-1]]
    before[first[:-1]] = -1
    return p[back], before


def _third_level(d: DataFrame, trie: Trie) -> Trie:
    """Adds the words that follow each pair. A task knows the probability after the pair's second word, and sends it along."""
    v, path, bases = trie.n_words, trie.path, trie.pair_bases
    if (int(bases[-1]) + 1) * (v + 1) >= 1 << 64:
        raise ValueError(f"{bases[-1]} pairs of {v} words: a triple must fit 64 bits; use order=2")
    lows = bases.astype(np.uint64) * np.uint64(v)

    def count(batches):
        tally = _Tally(1_000_000)

        def rows():
            k, c, p = tally.take()
            e = np.searchsorted(k, lows)
            some = np.flatnonzero(e[1:] > e[:-1])
            part = lambda f: pa.array([f(slice(e[i], e[i + 1])) for i in some], pa.binary())
            packed = [part(lambda x: _pack(k[x])), part(lambda x: _pack(np.cumsum(c[x]))), part(lambda x: zlib.compress(p[x].tobytes(), 1))]
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *packed], ["file", "keys", "counts", "below"])

        for b in batches:
            for w in split_words(b.column(0), lower=True, step=STEP):
                ids, _, alone, context, first = _tokens(w, trie)
                below, before = _seen_pairs(ids, context, alone, first, trie)
                some = np.flatnonzero(before >= 0)
                tally.add(before[some].astype(np.uint64) * np.uint64(v) + ids[some].astype(np.uint64), _quantise(below[some]))
                if tally.full():
                    yield rows()
        yield rows()

    def build(key, table):
        k = key[0].as_py()
        keys = np.concatenate([_unpack(x.as_py()) for x in table.column("keys")])
        counts = np.concatenate([np.diff(_unpack(x.as_py()), prepend=_U0).astype(np.int64) for x in table.column("counts")])
        below = np.concatenate([np.frombuffer(zlib.decompress(x.as_py()), np.uint16) for x in table.column("below")])
        keys, counts, below = _sum_by_key(keys, counts, below)
        n = int(bases[k + 1] - bases[k])
        keys = keys - lows[k]
        begin = np.searchsorted((keys // np.uint64(v)).astype(np.int64), np.arange(n + 1))
        _save(f"{path}/3-{k}", EliasFano.build(keys, n * v).arrays("keys") | EliasFano.build(begin, len(keys) + 1).arrays("begin"))
        _save(f"{path}-counts/3-{k}", {x: np.frombuffer(zlib.compress(y.tobytes(), 1), np.uint8) for x, y in (("counts", counts), ("below", below))})
        return pa.table({"file": [k], "n1": [int((counts == 1).sum())], "n2": [int((counts == 2).sum())]}, schema=_META3)

    packed = d.mapInArrow(count, "file int, keys binary, counts binary, below binary")
    got = {r.file: r for r in packed.groupBy("file").applyInArrow(build, "file int, n1 long, n2 long").collect()}
    discount = _discount(got)

    def finish(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                get, held = _open(f"{path}/3-{k}"), _open(f"{path}-counts/3-{k}")
                context = EliasFano.from_arrays(get, "keys").values().astype(np.int64) // v
                counts = np.frombuffer(zlib.decompress(held("counts").tobytes()), np.int64)
                below = 10 ** (-_STEP * np.frombuffer(zlib.decompress(held("below").tobytes()), np.uint16).astype(np.float64))
                n = int(bases[k + 1] - bases[k])
                total, followers = np.bincount(context, counts, n), np.bincount(context, minlength=n)
                weight = np.where(followers > 0, discount * followers / np.maximum(total, 1), 1)
                p = np.maximum(counts - discount, 0) / total[context] + weight[context] * below
                _save(f"{path}/3-{k}", {"prob": _quantise(np.log10(p)), "bow": _quantise(np.log10(weight))})
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32())], ["file"])

    files = sorted(got)
    if files:
        todo = d.sparkSession.createDataFrame([(k,) for k in files], "file int").repartition(min(len(files), 4096), "file")
        todo.mapInArrow(finish, "file int").collect()
        remove(d.sparkSession, f"{path}-counts")
    trie.third = np.isin(np.arange(len(bases) - 1), files)
    return trie


def score(docs: DataFrame, trie: Trie, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of every whole text.

    base_score sums log10((c + 1) / (N + V + 1)) over the text's tokens, c being a token's training count; score sums the
    trie's log10 probabilities of each token after the two before it. What training did not see after two words has its probability
    after one, and a token that training did not have the base's, times the contexts' shares for what never followed them. Null and empty texts are scored as an end alone. Ids
    (null, repeated, of any type) come back as they came, a row for each.

    A task sorts the distinct pairs of what it has read, so that it walks through the mapped files in order.
    """

    def run(batches):
        for b in batches:
            for w in split_words(b.column(1), lower=True, step=STEP):
                ids, counts, alone, context, first = _tokens(w, trie)
                p, before = _seen_pairs(ids, context, alone, first, trie)
                some = np.flatnonzero(before >= 0)
                if len(some) and trie.third.any():
                    key = before[some].astype(np.uint64) * np.uint64(trie.n_words + 1) + (ids[some] + 1).astype(np.uint64)
                    _, at, back = _distinct(key)
                    at = some[at]
                    p[some] = trie.triples(before[at], ids[at], p[at])[back]
                base = np.log10((counts + 1.0) / (trie.n_tokens + trie.n_words + 1.0))
                at = first[:-1]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(w.rows.start, w.rows.stop - w.rows.start), pa.array(np.diff(first)), pa.array(np.add.reduceat((counts > 0).astype(np.int64), at)),
                     pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(p, at))],
                    ["id", "n_tokens", "n_known", "base_score", "score"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, n_known long, base_score double, score double")
