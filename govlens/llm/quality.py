"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Features are hashed: words without punctuation, and word shapes (runs of capitals, small letters, digits, other letters and each
punctuation mark) and words that follow themselves, at how many times a text has them, by powers of four. One weight vector and ordered thresholds give the
expected grade and the probability of each tail.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlens.llm import linear
from govlens.llm import text as T

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58], _SHAPE[128:] = ord("Z"), ord("a"), ord("0"), ord("b")
#: Times that a shape must occur for each of its features.
LEVELS = (1, 4, 16)


def featurise(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, off = T.buffers(texts)
    starts, ends, at = T.spans(data, off)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(at))
    words = linear.slot(T.hashes(data, *linear.cores(data, starts, ends)), 1)
    # shapes: a byte stays where its class is not that of the byte before it in the word
    shape = _SHAPE[data]
    stays = np.ones(len(data), bool)
    stays[1:] = shape[1:] != shape[:-1]
    stays[starts] = True
    left = np.concatenate(([0], np.cumsum(stays)))
    # hashing folds capitals into small letters, so capitals go in as a mark of their own
    shaped = np.where(shape == ord("Z"), 1, shape)[stays].astype(np.uint8)
    shapes = linear.slot(T.hashes(shaped, left[starts], left[ends]), 2)
    both, n = np.unique((doc << linear.BITS) | shapes, return_counts=True)
    rows, own = both >> linear.BITS, both & ((1 << linear.BITS) - 1)
    out = [(doc, words)]
    for k, least in enumerate(LEVELS):
        out.append((rows[n >= least], linear.slot(own[n >= least].astype(np.uint64), 3 + k)))
    # a word that follows itself, by how often
    again = np.bincount(doc[1:][(words[1:] == words[:-1]) & (doc[1:] == doc[:-1])], minlength=len(off) - 1)
    for k, least in enumerate(LEVELS):
        rows = np.flatnonzero(again >= least)
        out.append((rows, linear.slot(np.zeros(len(rows), np.uint64), 8 + k)))
    return np.concatenate([r for r, _ in out]), np.concatenate([f for _, f in out])


def train(docs: DataFrame, ratings: DataFrame, grade: str = "quality", fit_rows: int = linear.FIT_ROWS) -> linear.Model:
    """A model from at most ``fit_rows`` of the rated documents whose crc32(doc_id as text) mod 5 is not 0."""
    learns = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    return linear.train(linear.sample(docs, ratings, grade, learns, fit_rows), featurise)


def score(docs: DataFrame, model: linear.Model, accept: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, expected_grade, p_accept (that the grade is ``accept`` or more), accepted.

    ``accept`` is the highest grade unless given. A null text is empty; an empty text has the grades' base rates. Repeated rows
    are scored each; other columns aren't read. A model of fewer than two grades accepts every text with probability 0.5.
    """
    accept = model.grades[-1] if accept is None else accept
    k = sum(g < accept for g in model.grades) - 1
    kind = dict(docs.dtypes)["doc_id"]
    scored = docs.select("doc_id", "text").mapInArrow(linear.scorer(model, featurise), f"doc_id {kind}, above array<double>")
    steps = [F.element_at("above", i + 1) * F.lit(float(b - a)) for i, (a, b) in enumerate(zip(model.grades, model.grades[1:], strict=False))]
    expected = sum(steps, F.lit(float(model.grades[0])))
    tail = F.lit(1.0) if k < 0 and len(model.grades) > 1 else F.coalesce(F.try_element_at("above", F.lit(k + 1)), F.lit(0.5)) if k >= 0 else F.lit(0.5)
    return scored.select("doc_id", expected.alias("expected_grade"), tail.alias("p_accept"), (tail >= 0.5).alias("accepted"))


def accepted(docs: DataFrame, model: linear.Model, accept: int | None = None) -> DataFrame:
    """The rows of docs that the model accepts by ``score``, with all their columns, which may have any names.

    A null text counts as empty; empty texts stand at the grades' base rates and go or stay together. Rows that repeat a text go or stay alike. A model
    of fewer than two grades keeps all rows. An empty table gives no rows.
    """
    k = sum(g < (model.grades[-1] if accept is None else accept) for g in model.grades) - 1

    def keep(batches):
        for b in batches:
            text = b.column(b.schema.get_field_index("text"))
            above = model.above(linear.totals(model.weights, *featurise(text), b.num_rows))
            ok = above[:, k] >= 0.5 if k >= 0 and above.shape[1] else np.ones(b.num_rows, bool)
            yield b.filter(pa.array(ok))

    return docs.mapInArrow(keep, docs.schema)
