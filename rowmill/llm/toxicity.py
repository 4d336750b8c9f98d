"""Toxicity by class-conditional Kneser-Ney models.

A word's probability has its class, toxic or ordinary, as context. It is counted by continuations, the different words
it follows, so that a passage which many texts share counts as one. Both classes back off to the same counts, the number
of classes a word occurs in, and those to a uniform floor, so that rare expressions weigh little. A text's two
log-likelihoods are compared per token, by a power mean over its tokens: dividing by the length keeps long and short
texts comparable, and the power keeps a few strong expressions visible in a long text. A logistic curve fitted on sample
rows that the models have not seen turns the result into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmill.llm import words as W

# The bound of the sample: rows per class, the first in order of a hash of their id.
MAX_ROWS = 4000
DISCOUNT = 0.75  # of the shared counts; class counts have a discount of 1
POWER = 2.0
THRESHOLD = 0.7
# Every fourth sample row of a class fits the curve.
_HOLD = 4
_BLOCK = 1 << 20
_START = np.uint64(0x51A7)  # context of a text's first word
_HALF = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the words of a text, A-Z folded, without surrounding ASCII punctuation."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    data = _PLAIN[data]
    return W.hashes(data, *W.bounds(data), fold=True)


_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = 0x20


@dataclass
class Model:
    """Sorted word hashes and, per word, log P(word | toxic) - log P(word | ordinary); 0 for unknown words."""

    words: np.ndarray
    ratio: np.ndarray
    slope: float = 1.0
    middle: float = 0.0

    def evidence(self, text: str | None, power: float = POWER) -> float:
        """Power mean of the tokens' log ratios; 0 without words."""
        w = tokens(text)
        if not len(w) or not len(self.words):
            return 0.0
        total = 0.0
        for at in range(0, len(w), _BLOCK):
            part = w[at : at + _BLOCK]
            i = np.searchsorted(self.words, part)
            i[i == len(self.words)] = 0
            total += float(np.exp(power * np.where(self.words[i] == part, self.ratio[i].astype(np.float64), 0.0)).sum())
        return float(np.log(total / len(w)) / power)

    def score(self, text: str | None) -> float:
        x = self.slope * (self.evidence(text) - self.middle)
        return float(1 / (1 + np.exp(-np.clip(x, -60, 60))))


def train(texts: list[str | None], toxic: list[bool], discount: float = DISCOUNT) -> Model:
    """Both class models from the given rows, with the shared backoff."""
    uni = []
    for label in (False, True):
        found = [w for w in (tokens(t) for t, y in zip(texts, toxic) if y == label) if len(w)]
        words = np.concatenate([np.zeros(0, np.uint64), *found])
        before = np.concatenate([np.zeros(0, np.uint64), *[np.concatenate([[_START], w[:-1]]) for w in found]])
        first = np.unique(W.mix(before * _HALF + words), return_index=True)[1]
        uni.append(np.unique(words[first], return_counts=True))
    vocabulary = np.union1d(uni[0][0], uni[1][0])
    size = len(vocabulary)
    counts = np.zeros((2, size))
    for c in (0, 1):
        counts[c][np.searchsorted(vocabulary, uni[c][0])] = uni[c][1]
    classes = (counts > 0).sum(axis=0)
    shared = np.maximum(classes - discount, 0) / max(classes.sum(), 1)
    shared = shared + (1 - shared.sum()) / (size + 1)
    # Both classes leave the larger of their discounted shares to the backoff, so that an unknown word says nothing.
    left = max((counts > 0).sum(axis=1) / np.maximum(counts.sum(axis=1), 1)) if size else 1.0
    own = np.maximum(counts - 1, 0)
    p = (1 - left) * own / np.maximum(own.sum(axis=1, keepdims=True), 1) + left * shared
    return Model(vocabulary, np.log(p[1] / p[0]).astype(np.float32))


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and middle of a logistic curve, by Newton steps with a small ridge; classes weigh the same."""
    weight = np.where(y, 0.5 / max(y.sum(), 1), 0.5 / max((~y).sum(), 1)) * len(y)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = weight * (p - y)
        h = weight * p * (1 - p)
        grad = np.array([(g * x).sum() + 0.1 * a, g.sum()])
        hess = np.array([[(h * x * x).sum() + 0.1, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return (float(a), float(-b / a)) if a > 1e-3 else (1.0, float(x.max() + 1))


def fit(rows: list[tuple[str | None, bool]]) -> Model | None:
    """Models and curve from sample rows; in each class every fourth row is kept for the curve. None if a class has no rows."""
    kept, held = [], []
    for label in (True, False):
        own = [r for r in rows if r[1] == label]
        if not own:
            return None
        held += own[::_HOLD]
        kept += [r for i, r in enumerate(own) if i % _HOLD] or own
    model = train(*map(list, zip(*kept)))
    x, y = np.array([model.evidence(t) for t, _ in held]), np.array([y for _, y in held])
    model.slope, model.middle = _fit_curve(x, y)
    return model


def sample_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", max_rows: int = MAX_ROWS) -> list[tuple[str | None, bool]]:
    """At most ``max_rows`` labelled rows per class, by order of a hash of the key. ``labels``: ``key``, boolean ``toxic``.

    A key with several labels is toxic if any says so; NULL labels and keys are left out.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max("toxic").alias("toxic"))
    known = known.join(docs.select(key), key, "left_semi")
    chosen = [known.where(c).orderBy(F.xxhash64(key), key).limit(max_rows) for c in (F.col("toxic"), ~F.col("toxic"))]
    ids = chosen[0].union(chosen[1])
    # At most 2 * max_rows ids: bounded, so they may be sent to every task.
    found = docs.select(key, text).join(F.broadcast(ids), key).groupBy(key, "toxic").agg(F.min(text).alias("t"))
    rows = found.orderBy(F.xxhash64(key), key).select("t", "toxic").collect()
    return [(r.t, r.toxic) for r in rows]


def score_texts(df: DataFrame, model: Model | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``df``, then ``score`` and ``predicted`` (replaced if there). Without a model every score is 0.

    A text without words has evidence 0 like any other text that says nothing.
    """
    names = [c for c in df.columns if c not in ("score", "predicted")]
    source = df.select(*[f"`{c}`" for c in names])
    schema = T.StructType([*source.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            scores = [m.score(t.as_py()) if m else 0.0 for t in batch.column(names.index(text))]
            said = [int(s >= threshold) for s in scores]
            extra = [pa.array(scores, pa.float64()), pa.array(said, pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*names, "score", "predicted"])

    return source.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", max_rows: int = MAX_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Score every row of ``docs`` by models learnt from ``labels`` (``key``, boolean ``toxic``).

    Learning collects at most ``2 * max_rows`` rows; scoring reads each text whole, in its own task, without a shuffle.
    """
    return score_texts(docs, fit(sample_rows(docs, labels, key, text, max_rows)), text, threshold)
