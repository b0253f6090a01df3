"""Cumulative-link (ordinal) regression over hashed text features, fitted on bounded and scored on all data.

P(grade > k) = sigmoid(weights . features - threshold_k) with one weight vector and ordered thresholds. Features are selected and weights fitted
on a bounded sample of the labelled rows, which a hash of their ids picks; so the labels are small enough to broadcast, and no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govlens.llm import text as T
from govlens.llm.common import small_batches

BITS = 18
#: Labelled rows that a model learns from at most (16 bytes each, broadcast), and features that it has at most.
FIT_ROWS = 20_000
FEATURES = 4096
#: Least likelihood-ratio statistic of a feature against the grades.
EVIDENCE = 12.0

#: (rows of the batch, feature numbers) of one Arrow batch of texts; a pair may repeat.
Featurise = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Model:
    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, total: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k but the last, by row."""
        return 1 / (1 + np.exp(-(total[:, None] - self.thresholds[None, :])))


def pairs_once(rows: np.ndarray, features: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((rows.astype(np.int64) << bits) | features)
    return both >> bits, both & ((1 << bits) - 1)


def totals(weights: np.ndarray, rows: np.ndarray, features: np.ndarray, n: int) -> np.ndarray:
    """Each row's sum over the features that it has; features without weight are passed over."""
    hit = weights[features] != 0
    r, f = pairs_once(rows[hit], features[hit])
    return np.bincount(r, weights[f], n)


def _count(featurise: Featurise, grades: list[int], ranges: int):
    place = {g: i for i, g in enumerate(grades)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(((1 << BITS), len(grades)), np.int64)
        for b in batches:
            grade = np.array([place[g] for g in b.column("grade").to_pylist()], np.int64)
            r, f = pairs_once(*featurise(b.column("text")))
            sums += np.bincount(f * len(grades) + grade[r], minlength=sums.size).reshape(sums.shape)
        for i, part in enumerate(np.split(sums, ranges)):
            flat = part.ravel()
            there = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([np.stack((there, flat[there])).astype(np.int32).tobytes()], pa.binary())], ["range", "sums"])

    return run


def _add(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for i, s in zip(b.column("range").to_pylist(), b.column("sums").to_pylist(), strict=True):
                there, n = np.frombuffer(s, np.int32).reshape(2, -1)
                found.setdefault(i, np.zeros(size, np.int64))[there] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([x.tobytes() for x in found.values()], pa.binary())], ["range", "sums"])

    return run


def _pick(featurise: Featurise, chosen: np.ndarray):
    keep = np.zeros(1 << BITS, bool)
    keep[chosen] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r, f = featurise(b.column("text"))
            r, f = pairs_once(r[keep[f]], f[keep[f]])
            cut = np.searchsorted(r, np.arange(b.num_rows + 1))
            own = [f[a:z].astype(np.int32) for a, z in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("grade"), pa.array(own, pa.list_(pa.int32()))], ["grade", "features"])

    return run


def evidence(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Likelihood-ratio statistic of each feature's presence against the grades."""
    n, total = counts.sum(1, keepdims=True), sizes.sum()
    out = np.zeros(len(counts))
    for part, share in ((counts, n / total), (sizes[None, :] - counts, 1 - n / total)):
        expected = np.maximum(share * sizes[None, :], 1e-9)
        out += 2 * np.where(part > 0, part * np.log(np.maximum(part, 1e-9) / expected), 0).sum(1)
    return out


def fit_ordinal(rows: np.ndarray, features: np.ndarray, grade: np.ndarray, grades: int, size: int, steps: int = 300, ridge: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by Adam over the whole sample; rows and features hold the pairs that are present."""
    n = len(grade)
    w, share = np.zeros(size), np.array([(grade > k).mean() for k in range(grades - 1)])
    share = np.clip(share, 1e-3, 1 - 1e-3)
    base, gaps = np.log((1 - share[0]) / share[0]), np.diff(np.log((1 - share) / share))
    params = [w, np.array([base]), np.log(np.maximum(gaps, 1e-2))]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        w, first, gap = params
        theta = first + np.concatenate(([0.0], np.cumsum(np.exp(gap))))
        s = np.bincount(rows, w[features], n)
        edge = np.concatenate((np.zeros((n, 1)), 1 / (1 + np.exp(-(theta[None, :] - s[:, None]))), np.ones((n, 1))), 1)
        lo, hi = edge[np.arange(n), grade], edge[np.arange(n), grade + 1]
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        d_s = (d_hi - d_lo) / n
        d_theta = np.array([-(d_hi[grade == k].sum() - d_lo[grade == k + 1].sum()) / n for k in range(grades - 1)])
        tail = np.cumsum(d_theta[::-1])[::-1]
        grad = [np.bincount(features, d_s[rows], size) + ridge * w, np.array([d_theta.sum()]), tail[1:] * np.exp(gap)]
        for i, g in enumerate(grad):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
            params[i] = params[i] - 0.1 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-9)
    w, first, gap = params
    return w, first + np.concatenate(([0.0], np.cumsum(np.exp(gap))))


def sample(docs: DataFrame, labels: DataFrame, grade: str, keep: Column, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Text and grade of at most ``fit_rows`` labelled documents for which ``keep`` holds; of several labels of a document the highest counts.

    A label without doc_id or grade is passed over.
    """
    known = labels.select("doc_id", F.col(grade).cast("int").alias("grade")).dropna().filter(keep)
    known = known.groupBy("doc_id").agg(F.max("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id").select("text", "grade")


def train(labelled: DataFrame, featurise: Featurise, ranges: int = 16) -> Model:
    """A model from a bounded number of rows of text and integer grade."""
    small_batches(labelled.sparkSession)
    sizes = {r.grade: r["count"] for r in labelled.groupBy("grade").count().collect()}
    grades = sorted(sizes)
    weights = np.zeros(1 << BITS, np.float32)
    if len(grades) < 2:
        return Model(grades or [0, 1], weights, np.zeros(max(0, len(grades or [0, 1]) - 1)))
    counted = labelled.mapInArrow(_count(featurise, grades, ranges), "range int, sums binary")
    counted = counted.repartition(ranges, "range").mapInArrow(_add((1 << BITS) // ranges * len(grades)), "range int, sums binary")
    parts = {r["range"]: np.frombuffer(r["sums"], np.int64).reshape(-1, len(grades)) for r in counted.collect()}
    counts = np.concatenate([parts[i] for i in range(ranges)])
    told = evidence(counts, np.array([sizes[g] for g in grades]))
    told[counts.sum(1) < 3] = 0
    chosen = np.argsort(-told, kind="stable")[:FEATURES]
    chosen = np.sort(chosen[told[chosen] >= EVIDENCE])
    taken = labelled.mapInArrow(_pick(featurise, chosen), "grade int, features array<int>").toPandas()
    number = np.full(1 << BITS, -1)
    number[chosen] = np.arange(len(chosen))
    rows = np.repeat(np.arange(len(taken)), [len(f) for f in taken["features"]])
    flat = np.concatenate([np.asarray(f, np.int64) for f in taken["features"]] or [np.zeros(0, np.int64)])
    grade = np.searchsorted(grades, taken["grade"].to_numpy())
    w, theta = fit_ordinal(rows, number[flat], grade, len(grades), len(chosen))
    weights[chosen] = w
    return Model(grades, weights, theta)


def scorer(model: Model, featurise: Featurise):
    """mapInArrow function: doc_id and the tail probabilities P(grade > k)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            above = model.above(totals(model.weights, *featurise(b.column("text")), b.num_rows))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names if c != "text"), pa.array(list(above), pa.list_(pa.float64()))], [*(c for c in b.schema.names if c != "text"), "above"])

    return run


_PUNCT = np.zeros(256, bool)
_PUNCT[[i for i in range(33, 127) if not chr(i).isalnum()]] = True


def cores(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Words without up to ``most`` ASCII punctuation marks at either end; a word of nothing else stays as it is."""
    s, e = starts.copy(), ends.copy()
    for _ in range(most if len(s) else 0):
        s += _PUNCT[data[s]] & (e - s > 1)
        e -= _PUNCT[data[e - 1]] & (e - s > 1)
    return s, e


def slot(h: np.ndarray, salt: int) -> np.ndarray:
    """Feature number of a hash."""
    return (T.mix(h + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(64 - BITS)).astype(np.int64)
