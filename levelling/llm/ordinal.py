"""Quality classifier: ordinal cumulative-link regression on hashed text (operator 4).

A document is a sparse vector of hashed features: its lower-cased words and
their stems (first six bytes), as log counts scaled to length one, and, in a
block of their own, the shares of its word shapes and of words that repeat the
word before.  One weight vector
``w`` is shared by all grades; ``P(grade > k) = sigmoid(w.x - t_k)`` with
ordered thresholds ``t_1 < t_2 < ...``.  The default grade of a labelled
document is ``quality + (1 - toxic)``: 2 is clean, 1 has one fault, 0 both.

In the fit a feature's values are scaled by how unevenly it is spread: the
log ratio of its smoothed shares among documents of the highest grade and of
the others, so that telling words learn fast and chance words hardly at all;
the scale is folded into the weights.  The model is fitted on at most ``max_labels`` labelled rows (those with the
smallest id hash; a documented bound, so the list of their ids may be
broadcast).  Their features are written once; every step of the
optimiser is a Spark job that adds up the gradients of at most ``GRADIENTS``
partitions, and only their sum, of fixed size, reaches the driver.  Scoring is one pass over whole texts.

Defined results: null and empty texts have no features and get the thresholds'
own probabilities; labels with a null grade, or whose document is missing, are
not used; without any usable label all probabilities are 0.5; repeated rows
and ids are scored each; an empty table gives an empty result; other columns
are kept by ``score`` and ``select``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stash
from .tokens import Words, blocks, mix

BITS = 18          # hashed features per block
GRADIENTS = 8      # partial gradients per step
STEPS = 60
RATE = 1.0
L2 = 3e-5
PRIOR = 5.0        # documents of an average feature mixed into its log ratio
_U = np.uint64


def features(col: pa.Array):
    """Per block: first row, row offsets (n+1), feature numbers, values."""
    size = 1 << BITS
    for lo, _hi, data, off in blocks(col):
        w = Words(data, off)
        n = np.diff(w.off)
        doc = np.repeat(np.arange(len(n)), n)
        word, stem = w.hashes(), w.stems()
        again = np.zeros(len(word), bool)
        again[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
        key = (doc.astype(np.int64) << (BITS + 1))
        names = np.concatenate([
            key | (word >> _U(64 - BITS)).astype(np.int64),
            key | (mix(stem ^ _U(0x5EED)) >> _U(64 - BITS)).astype(np.int64),
            key | size | (mix(w.shapes()) >> _U(64 - BITS)).astype(np.int64),
            key[again] | (2 * size - 1)])
        names, count = np.unique(names, return_counts=True)
        at, feat = names >> (BITS + 1), names & (2 * size - 1)
        is_word = feat < size
        val = np.where(is_word, np.log1p(count), count / np.maximum(1, n[at]))
        square = np.bincount(at[is_word], val[is_word] ** 2, len(n))
        val = np.where(is_word, val / np.sqrt(np.maximum(square, 1e-12))[at], val)
        yield lo, np.searchsorted(at, np.arange(len(n) + 1)), feat, val


def _dot(w: np.ndarray, off: np.ndarray, feat: np.ndarray, val: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(w[feat] * val)])
    return total[off[1:]] - total[off[:-1]]


def thresholds(raw: np.ndarray) -> np.ndarray:
    """Ordered thresholds: the first is free, each next one lies a positive gap above."""
    return raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))])


def tails(score: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """P(grade > k) for k = 0 .. top-1, one row per document."""
    return 1 / (1 + np.exp(np.clip(thresholds(raw)[None, :] - score[:, None], -60, 60)))


def gradient(score: np.ndarray, grade: np.ndarray, raw: np.ndarray):
    """Loss, its derivative by each score, and by the raw thresholds."""
    n, k = len(score), len(raw)
    p = np.concatenate([np.ones((n, 1)), tails(score, raw), np.zeros((n, 1))], axis=1)
    hit = np.arange(n), grade
    like = np.maximum(p[hit] - p[hit[0], grade + 1], 1e-12)
    slope = p * (1 - p)
    by_score = -(slope[hit] - slope[hit[0], grade + 1]) / like
    by_t = np.zeros((n, k + 2))
    by_t[hit] += slope[hit] / like          # threshold below the grade
    by_t[hit[0], grade + 1] -= slope[hit[0], grade + 1] / like
    by_t = by_t[:, 1:-1].sum(axis=0)
    by_raw = np.cumsum(by_t[::-1])[::-1]    # a threshold is the sum of all gaps below it
    by_raw[1:] *= np.exp(raw[1:])
    return -np.log(like).sum(), by_score, by_raw


_SUMS = "g binary, t binary"


def _sums(g: np.ndarray, t: np.ndarray) -> pa.RecordBatch:
    """A long and a short vector as one row."""
    return pa.RecordBatch.from_arrays([pa.array([g.astype(np.float32).tobytes()], pa.binary()),
                                       pa.array([t.astype(np.float64).tobytes()], pa.binary())], names=["g", "t"])


def _total(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The sum of at most ``GRADIENTS`` such rows; one row of fixed size reaches the driver."""
    def add(batches):
        g, t = 0.0, 0.0
        for b in batches:
            for x, y in zip(b["g"], b["t"]):
                g, t = g + np.frombuffer(x.as_buffer(), np.float32), t + np.frombuffer(y.as_buffer(), np.float64)
        if not np.isscalar(g):
            yield _sums(g, t)

    r = rows.repartition(1).mapInArrow(add, _SUMS).first()
    return np.frombuffer(r["g"], np.float32).astype(np.float64), np.frombuffer(r["t"], np.float64)


class Model:
    """Weights and raw thresholds; ``top`` is the highest grade."""

    def __init__(self, w: np.ndarray, raw: np.ndarray):
        self.w, self.raw, self.top = w, raw, len(raw)


def fit(docs: DataFrame, labels: DataFrame, grade: Column | None = None, top: int = 2,
        id_col: str = "doc_id", text_col: str = "text", max_labels: int = 20000) -> Model:
    """Fit on the labelled documents (``labels``: id and grade columns)."""
    grade = F.col("quality") + (1 - F.col("toxic")) if grade is None else grade
    size = 2 << BITS
    sample = (labels.select(F.col(id_col).alias("__id"), grade.cast("int").alias("__grade"))
              .where("__id is not null and __grade is not null").where(F.col("__grade").between(0, top))
              .orderBy(F.xxhash64("__id"), "__id", "__grade").limit(max_labels))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(
        F.broadcast(sample), "__id")  # at most max_labels rows of two numbers

    def featurise(batches):
        for b in batches:
            grades = b["__grade"].to_pylist()
            for lo, off, feat, val in features(b["__text"]):
                n = len(off) - 1
                yield pa.RecordBatch.from_arrays([
                    pa.array(grades[lo:lo + n], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(feat, pa.int32())),
                    pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(val, pa.float32()))],
                    names=["grade", "feat", "val"])

    data = stash(rows.select("__text", "__grade").mapInArrow(
        featurise, "grade int, feat array<int>, val array<float>"), "features")
    n = data.count()
    w, raw = np.zeros(size), np.zeros(top)
    if not n:
        raw[1:] = -60.0  # all thresholds at zero
        return Model(w, raw)
    spark = docs.sparkSession
    held = data.coalesce(GRADIENTS)

    def spread(batches):
        total, seen, some = np.zeros((2, size)), np.zeros(2), False
        for b in batches:
            low = (b["grade"].to_numpy() < top).astype(int)
            feat = b["feat"]
            per = np.diff(feat.offsets.to_numpy())
            idx, of = feat.flatten().to_numpy(), np.repeat(low, per)
            for k in (0, 1):
                total[k] += np.bincount(idx[of == k], minlength=size)
            seen, some = seen + np.bincount(low, minlength=2), True
        if some:
            yield _sums(total.ravel(), seen)

    c, share = _total(held.mapInArrow(spread, _SUMS))
    c, share = c.reshape(2, size), np.clip(share / n, 1e-3, 1.0)
    c = (c + PRIOR * share[:, None]) / (c.sum(axis=0) + PRIOR) / share[:, None]
    scale = np.abs(np.log(c[0] / c[1]))
    scale_shared = spark.sparkContext.broadcast(scale)

    def partial(state):
        def run(batches):
            (w, raw), s = state.value, scale_shared.value
            g, gt, some = np.zeros(size), np.zeros(top), False
            for b in batches:
                feat = b["feat"]
                off = feat.offsets.to_numpy()
                off = off - off[0]
                idx = feat.flatten().to_numpy()
                val = b["val"].flatten().to_numpy() * s[idx]
                _, by_score, by_raw = gradient(_dot(w, off, idx, val), b["grade"].to_numpy(), raw)
                g += np.bincount(idx, val * np.repeat(by_score, np.diff(off)), size)
                gt, some = gt + by_raw, True
            if some:
                yield _sums(g, gt)
        return run

    state_w, state_v = [np.zeros(size), np.zeros(top)], [np.zeros(size), np.zeros(top)]
    for step in range(1, STEPS + 1):
        state = spark.sparkContext.broadcast((w, raw))
        g, gt = _total(held.mapInArrow(partial(state), _SUMS))
        state.destroy()
        grads = [g / n + L2 * w, gt / n]
        rate = RATE * 0.5 * (1 + np.cos(np.pi * (step - 1) / STEPS))
        for x, g, m, v, pace in ((w, grads[0], state_w[0], state_v[0], 1.0),
                                 (raw, grads[1], state_w[1], state_v[1], 0.3)):
            m += 0.1 * (g - m)
            v += 0.02 * (g * g - v)
            x -= pace * rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.98 ** step)) + 1e-6)
    scale_shared.destroy()
    return Model(w * scale, raw)


def score(docs: DataFrame, model: Model, text_col: str = "text", tail: int | None = None,
          out: str = "quality") -> DataFrame:
    """Add a struct column: ``expected`` grade and ``tail`` = P(grade >= tail), the highest grade by default."""
    tail = model.top if tail is None else tail
    shared = docs.sparkSession.sparkContext.broadcast((model.w, model.raw))

    @F.arrow_udf("struct<expected:double,tail:double>")
    def rate(col: pa.Array) -> pa.Array:
        w, raw = shared.value
        expected, top = np.empty(len(col)), np.empty(len(col))
        for lo, off, feat, val in features(col):
            p = tails(_dot(w, off, feat, val), raw)
            expected[lo:lo + len(p)], top[lo:lo + len(p)] = p.sum(axis=1), p[:, tail - 1]
        return pa.StructArray.from_arrays([pa.array(expected), pa.array(top)], ["expected", "tail"])

    return docs.withColumn(out, rate(F.col(text_col).cast("binary")))


def select(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The documents whose highest grade has probability ``least`` or more, all their columns kept."""
    return score(docs, model, text_col, out="__q").where(F.col("__q.tail") >= least).drop("__q")
