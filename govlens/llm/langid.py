"""Language ID: sparse multinomial logistic regression on TF-IDF of character n-grams, by follow-the-regularised-leader, with a temperature.

Features are the runs of one, two and three characters (A-Z as a-z, digits as one digit, any whitespace as one space), hashed. A feature's value is
its share of the text's n-grams times its inverse document frequency over all documents that may be learned from. Weights are fitted by FTRL-proximal with
elastic-net penalties in one pass over a bounded sample of those documents; then one temperature for all logits is fitted on rows kept apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlens.llm import text as T
from govlens.llm.common import small_batches

BITS = 18
SIZES = (1, 2, 3)
#: Documents with a language that the weights are fitted on at most; a hash of doc_id picks them.
FIT_ROWS = 20_000
#: Of each so many of them, one is kept for the temperature.
CALIBRATES = 5
#: Brings shares times IDF, which are about one thousandth, near one.
SCALE = 100.0
UNDETERMINED = "und"


@dataclass(frozen=True)
class Model:
    langs: list[str]
    weights: np.ndarray  # feature by language, IDF and scale in it
    bias: np.ndarray
    temperature: float


def _characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points, first of each text and their number), folded; a null is empty."""
    data, off = T.buffers(texts)
    lead = (data & 0xC0) != 0x80
    at = np.concatenate(([0], np.cumsum(lead)))[off]
    cp = data.astype(np.uint32)
    # bytes of a character join at its first one
    starts = np.flatnonzero(lead)
    points = cp[starts]
    more = np.diff(np.concatenate((starts, [len(data)]))) - 1
    for k, mask in ((1, 0x1F), (2, 0x0F), (3, 0x07)):
        own = more == k
        value = points[own] & mask
        for j in range(1, k + 1):
            value = (value << 6) | (cp[starts[own] + j] & 0x3F)
        points[own] = value
    points[(points >= 65) & (points <= 90)] += 32
    points[(points >= 48) & (points <= 57)] = 48
    points[((points >= 9) & (points <= 13)) | (points == 0xA0)] = 32
    return points, at


_MIX = [np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917)]


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(features of all n-grams, text by text, first of each text and their number)."""
    points, at = _characters(texts)
    n, sizes = len(points), np.diff(at)
    own = np.repeat(np.arange(len(sizes)), sizes)
    spread = [points * m for m in _MIX]
    parts, rows = [], []
    for k in SIZES:
        h = np.full(max(0, n - k + 1), k * 0x9E3779B1 % 2**32, np.uint32)
        for j in range(k):
            h = (h ^ spread[j][j : n - k + 1 + j]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
        inside = own[: n - k + 1] == own[k - 1 :] if n >= k else np.zeros(0, bool)
        parts.append((h >> np.uint32(32 - BITS))[inside].astype(np.int32))
        rows.append(np.bincount(own[: n - k + 1][inside], minlength=len(sizes)) if n >= k else np.zeros(len(sizes), np.int64))
    ends = [np.concatenate(([0], np.cumsum(r))) for r in rows]
    total = np.concatenate(([0], np.cumsum(sum(rows)))).astype(np.int64)
    out = np.empty(total[-1], np.int32)
    for i in range(len(sizes)):
        a = total[i]
        for p, e in zip(parts, ends, strict=True):
            z = a + e[i + 1] - e[i]
            out[a:z] = p[e[i] : e[i + 1]]
            a = z
    return out, total


def _frequencies(ranges: int):
    """mapInArrow function: in how many of a task's texts each feature is, as arrays by range of features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, there, n = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, bool), 0
        for b in batches:
            g, at = grams(b.column("text"))
            n += b.num_rows
            for a, z in zip(at[:-1], at[1:], strict=True):
                if z - a < 1 << (BITS - 3):
                    df[np.unique(g[a:z])] += 1
                else:
                    there[g[a:z]] = True
                    df += there
                    there[:] = False
        for i, part in enumerate(np.split(df, ranges)):
            own = np.flatnonzero(part)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([own.astype(np.int32)], pa.list_(pa.int32())), pa.array([part[own]], pa.list_(pa.int64())), pa.array([n if i == 0 else 0], pa.int64())], ["range", "own", "df", "n"])

    return run


def _sum(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            for i, own, df, n in zip(*(b.column(c) for c in ("range", "own", "df", "n")), strict=True):
                s = sums.setdefault(i.as_py(), [np.zeros(size, np.int64), 0])
                s[0][own.values.to_numpy()] += df.values.to_numpy()
                s[1] += n.as_py()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s[0].tobytes() for s in sums.values()], pa.binary()), pa.array([s[1] for s in sums.values()], pa.int64())], ["range", "df", "n"])

    return run


def idf(texts: DataFrame, ranges: int = 16) -> np.ndarray:
    """Smooth inverse document frequency of every feature over all rows of text: a fixed table of 2**BITS numbers."""
    counted = texts.select("text").mapInArrow(_frequencies(ranges), "range int, own array<int>, df array<long>, n long")
    summed = counted.repartition(ranges, "range").mapInArrow(_sum((1 << BITS) // ranges), "range int, df binary, n long").collect()
    df, n = np.zeros(1 << BITS), 0
    for r in summed:
        own = np.frombuffer(r.df, np.int64)
        df[r["range"] * len(own) : (r["range"] + 1) * len(own)] = own
        n += r.n
    return np.log((1 + n) / (1 + df)) + 1


class Ftrl:
    """FTRL-proximal for the softmax: one pair of sums a weight, from which the weight follows; l1 and l2 are the elastic net's penalties."""

    def __init__(self, features: int, classes: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.5, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((features, classes)), np.zeros((features, classes))

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z = self.z[at]
        over = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -over / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, x: np.ndarray, right: int) -> None:
        w = self.weights(at)
        p = softmax((x @ w)[None, :])[0]
        p[right] -= 1
        g = x[:, None] * p[None, :]
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def temperature(logits: np.ndarray, right: np.ndarray) -> float:
    """The divisor of the logits that makes the right answers likeliest, by golden section on its logarithm between 1/50 and 50.

    As in Platt's scaling an answer counts as right with (n + 1) / (n + 2), so that few answers, all right, don't give certainty.
    """
    n, classes = logits.shape
    if not n or classes < 2:
        return 1.0
    target = np.full((n, classes), 1 / (n + 2) / (classes - 1))
    target[np.arange(n), right] = (n + 1) / (n + 2)

    def loss(u: float) -> float:
        return -(target * np.log(np.maximum(softmax(logits / np.exp(u)), 1e-300))).sum(1).mean()

    lo, hi, r = -np.log(50), np.log(50), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def _values(g: np.ndarray, idfs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, TF-IDF values) of one text; the last feature is the bias."""
    at, n = np.unique(g, return_counts=True)
    return np.append(at, 1 << BITS), np.append(n / max(1, len(g)) * idfs[at] * SCALE, 1.0)


def _fit(langs: list[str], idfs: np.ndarray):
    """mapInArrow function over one task's bounded sample, in the order of its hashes: the weights that aren't zero, as arrays."""
    place = {x: i for i, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, apart, seen = Ftrl((1 << BITS) + 1, len(langs)), [], 0
        for b in batches:
            g, at = grams(b.column("text"))
            for a, z, lang in zip(at[:-1], at[1:], b.column("lang").to_pylist(), strict=True):
                own = _values(g[a:z], idfs)
                seen += 1
                if seen % CALIBRATES == 0:
                    apart.append((*own, place[lang]))
                else:
                    model.learn(*own, place[lang])
        w = model.weights(slice(None))
        logits = np.array([x @ w[at] for at, x, _ in apart]).reshape(len(apart), len(langs))
        heat = temperature(logits, np.array([k for _, _, k in apart], int))
        own = np.flatnonzero(w.any(1))
        yield pa.RecordBatch.from_arrays([pa.array([own.astype(np.int32).tobytes()], pa.binary()), pa.array([w[own].astype(np.float32).tobytes()], pa.binary()), pa.array([heat])], ["own", "weights", "temperature"])

    return run


def train(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """A model from text and lang of the documents whose crc32(doc_id as text) mod 3 is not 1; rows without doc_id or lang are passed over.

    Document frequencies are those of all such rows, weights those of at most ``fit_rows`` ids. Without any such row the model has no language.
    """
    spark = docs.sparkSession
    small_batches(spark)
    learns = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    known = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang").filter(learns & F.col("lang").isNotNull())
    langs = sorted(r.lang for r in known.select("lang").distinct().collect())
    if not langs:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0), 1.0)
    idfs = idf(known)
    ids = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    chosen = known.join(F.broadcast(ids), "doc_id").repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "lang", "text")
    fitted = chosen.select("text", "lang").mapInArrow(_fit(langs, idfs), "own binary, weights binary, temperature double").first()
    own, w = np.frombuffer(fitted.own, np.int32), np.frombuffer(fitted.weights, np.float32).reshape(-1, len(langs))
    weights = np.zeros(((1 << BITS) + 1, len(langs)), np.float32)
    weights[own] = w
    return Model(langs, weights[:-1] * (idfs * SCALE)[:, None].astype(np.float32), weights[-1].astype(float), fitted.temperature)


def scorer(model: Model):
    """mapInArrow function: the other columns, lang_pred and score of each text."""
    has = model.weights.any(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = [c for c in b.schema.names if c != "text"]
            g, at = grams(b.column("text"))
            hit = has[g]
            cut = np.concatenate(([0], np.cumsum(hit)))[at]
            sums = np.zeros((b.num_rows, len(model.langs)))
            full = np.flatnonzero(cut[1:] > cut[:-1])
            if len(full):
                sums[full] = np.add.reduceat(model.weights[g[hit]], cut[:-1][full], axis=0, dtype=np.float64)
            p = softmax((sums / np.maximum(np.diff(at), 1)[:, None] + model.bias) / model.temperature)
            best = p.argmax(1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array([model.langs[i] for i in best], pa.string()), pa.array(p.max(1))], [*names, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score (the calibrated probability of lang_pred).

    A text that is null or has no letter, empty ones too, is ``und`` with score 0; so is every text if the model has no language. Texts are read
    whole at any length. Rows that repeat are scored each; a null doc_id isn't held out; an empty table gives no rows. Other columns aren't read, lang
    and source among them. Of equally likely languages the first by name is taken.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    own = docs.select("doc_id", held_out.alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"), "text")
    if not model.langs:
        return own.select("doc_id", "held_out", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    scored = own.mapInArrow(scorer(model), f"doc_id {kind}, held_out boolean, letters boolean, lang_pred string, score double")
    return scored.select("doc_id", "held_out", F.when(F.col("letters"), F.col("lang_pred")).otherwise(UNDETERMINED).alias("lang_pred"), F.when(F.col("letters"), F.col("score")).otherwise(0.0).alias("score"))
