"""Toxicity scores from confirmed toxic texts and unlabelled ones (non-negative PU learning)."""

from __future__ import annotations

import re
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm.tokens import keep_only, slices

#: Buckets that features are hashed to while the vocabulary is chosen.
BUCKETS = 1 << 21
_WORD = re.compile(r"[^\W\d_]+")
#: Lengths of word beginnings that are features beside the words.
PREFIXES = (4, 5, 6, 7)


def _features(word: str) -> list[int]:
    """Buckets of a lower-case word and of its beginnings: inflected forms share the latter."""
    parts = {f"={word}", *(word[:n] for n in PREFIXES if len(word) >= n)}
    return [zlib.crc32(p.encode("utf-8", "replace")) % BUCKETS for p in sorted(parts)]


def values(counts: np.ndarray) -> np.ndarray:
    """A count as two numbers: is it there, and how often beyond the first time (levelling off)."""
    return np.concatenate([counts > 0, np.log2(np.maximum(counts, 1))], axis=-1)


@dataclass
class Model:
    """A linear model over chosen buckets, whether they occur and whether they do so often; ``slots`` has each bucket's place or -1."""

    slots: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def counts(self, text: str, memo: dict[str, list[int]]) -> dict[int, int]:
        out: dict[int, int] = {}
        for w in _WORD.findall(text.lower()):
            got = memo.get(w)
            if got is None:
                if len(memo) > 200_000:
                    memo.clear()
                got = memo[w] = [s for s in self.slots[_features(w)].tolist() if s >= 0]
            for s in got:
                out[s] = out.get(s, 0) + 1
        return out

    def score(self, text: str, memo: dict[str, list[int]]) -> float:
        got = self.counts(text, memo)
        z = self.bias
        if got:
            k = np.array(sorted(got))
            z += float(np.concatenate([self.weights[k], self.weights[len(self.weights) // 2 + k]]) @ values(np.array([got[s] for s in k.tolist()])))
        return float(1 / (1 + np.exp(-z)))


def risk(z_pos: np.ndarray, z_all: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The positive part and the negative part of the PU risk under logistic loss, and the latter's gradients in z.

    The negative part is that of unlabelled text less what the positives in it contribute; a true risk is never below 0.
    """
    loss = lambda z: np.logaddexp(0, -z)
    positive = prior * loss(z_pos).mean()
    negative = loss(-z_all).mean() - prior * loss(-z_pos).mean()
    sig = lambda z: 1 / (1 + np.exp(-z))
    return positive, negative, sig(z_all) / len(z_all), -prior * sig(z_pos) / len(z_pos)


def fit(positive: list[str], unlabelled: list[str], prior: float, vocabulary: int = 512, false_share: float = 0.05, steps: int = 400, rate: float = 0.05, ridge: float = 1e-3) -> Model:
    """Learns from whole texts. Buckets are those most over-represented in the positive texts, by document frequency.

    When the negative part of the risk falls below 0 the step goes against it only (Kiryo et al., 2017).
    Without positive or unlabelled texts, or with a prior of 0, every score is the prior.
    """
    none = Model(np.full(BUCKETS, -1, np.int32), np.zeros(0), float(np.log((prior + 1e-6) / (1 - prior + 1e-6))), prior)
    if not positive or not unlabelled or prior <= 0:
        return none
    memo: dict[str, list[int]] = {}

    def frequency(texts: list[str]) -> np.ndarray:
        out = np.zeros(BUCKETS, np.int32)
        for t in texts:
            got: set[int] = set()
            for w in set(_WORD.findall(t.lower())):
                f = memo.get(w)
                if f is None:
                    if len(memo) > 300_000:
                        memo.clear()
                    f = memo[w] = _features(w)
                got.update(f)
            out[list(got)] += 1
        return out

    def gain(a: np.ndarray, n: int, b: np.ndarray, m: int) -> np.ndarray:
        expected = b * (n / m)
        return np.where(a >= 3, (a - expected) / np.sqrt(a + expected + 1), 0)

    n = min(len(positive), len(unlabelled) // 2)
    some, rest = frequency(unlabelled[:n]), frequency(unlabelled[n:])
    found = gain(frequency(positive), len(positive), some + rest, len(unlabelled))
    # What the same comparison finds between unlabelled texts is chance; the limit keeps its share small.
    chance = np.sort(gain(some, n, rest, len(unlabelled) - n))[::-1] if n else np.zeros(1)
    order = np.argsort(-found, kind="stable")[:vocabulary]
    false = np.searchsorted(-chance, -found[order], "right")
    ok = np.flatnonzero((false <= false_share * np.arange(1, len(order) + 1)) & (found[order] > 0))
    chosen = np.sort(order[: ok[-1] + 1]) if len(ok) else order[:0]
    if not len(chosen):
        return none
    memo.clear()
    slots = none.slots.copy()
    slots[chosen] = np.arange(len(chosen))
    model = Model(slots, np.zeros(2 * len(chosen)), 0.0, prior)

    def matrix(texts: list[str]) -> np.ndarray:
        x = np.ones((len(texts), 2 * len(chosen) + 1), np.float32)
        for i, t in enumerate(texts):
            got = model.counts(t, memo)
            row = np.zeros(len(chosen))
            row[list(got)] = list(got.values())
            x[i, :-1] = values(row)
        return x

    x_pos, x_all = matrix(positive), matrix(unlabelled)
    w = np.zeros(2 * len(chosen) + 1)
    w[-1] = none.bias
    m, v = np.zeros_like(w), np.zeros_like(w)
    back = lambda x, g: (g.astype(np.float32) @ x).astype(float)
    for step in range(1, steps + 1):
        narrow = w.astype(np.float32)
        z_pos, z_all = (x_pos @ narrow).astype(float), (x_all @ narrow).astype(float)
        _, negative, g_all, g_pos = risk(z_pos, z_all, prior)
        g = back(x_all, g_all) + back(x_pos, g_pos)
        if negative >= 0:
            g += back(x_pos, -prior / (1 + np.exp(z_pos)) / len(z_pos))
        else:
            g = -g
        g[:-1] += ridge * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model.weights, model.bias = w[:-1], float(w[-1])
    return model


def train(docs: DataFrame, labels: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_positive: int = 3000, max_unlabelled: int = 6000) -> Model:
    """fit() on texts chosen by a hash of their ids: at most ``max_positive`` with label 1 and ``max_unlabelled`` of any kind.

    ``learn`` is a condition on the id; no label of another row is read. The class prior is the share of label 1 among
    all labelled rows that it admits. These two numbers bound what reaches the driver.
    """
    known = labels.where(learn & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col)).agg(F.max(label_col).alias("y"))
    prior = known.agg(F.avg("y")).first()[0] or 0.0

    def texts(ids: DataFrame, most: int, salt: int) -> list[str]:
        some = ids.select(id_col).distinct().orderBy(F.xxhash64(F.col(id_col), F.lit(salt)), id_col).limit(most)
        got = docs.select(id_col, text_col).join(F.broadcast(some), id_col).orderBy(id_col, text_col).select(text_col).toArrow()
        return [t or "" for t in got.column(0).to_pylist()]

    positive = texts(known.where("y = 1"), max_positive, 1)
    unlabelled = texts(docs.where(learn & F.col(id_col).isNotNull()), max_unlabelled, 2)
    return fit(positive, unlabelled, prior)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with a column of scores from 0 to 1, of whole texts; null and empty texts have the score of no evidence.

    Only words of the text count: no other column is read. An empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: BUCKETS slots and at most ``vocabulary`` weights
    names, mark = docs.columns, uuid.uuid4().hex

    def run(batches):
        held = _MEMO
        keep_only("toxicity", held.clear)
        if held.get("of") != mark:
            held.clear()
            held.update(of=mark, words={})
        for b in (part for batch in batches for part in slices(batch)):
            scores = [shared.value.score(t.as_py() or "", held["words"]) for t in b.column(names.index(text_col))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], [*names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


_MEMO: dict = {}
