"""Toxicity after noisy-channel deobfuscation.

A word that may be disguised (digits and signs for letters, marks between letters, letters drawn out or doubled, letters spaced apart)
becomes a lattice of characters: each sign may stand for itself or for letters, a mark may be dropped, a run of equal letters or signs may be
shortened, a space between single characters may be dropped or kept. A run is one step of the lattice, however long, so a word of any length is
decoded in time that grows with its runs. Viterbi decoding under a character trigram model, learnt from all texts, picks the reading. All other
words have a single reading and stay as they are. The restored text is scored by a logistic model over its hashed words and word beginnings.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlens.llm import linear
from govlens.llm import text as T
from govlens.llm.common import small_batches

#: What a sign may stand for, besides itself.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "*": "aeiou",
}
#: Marks that may stand between the letters of a word.
MARKS = ".-_*"
#: Costs (natural log) of reading a sign as a letter, of dropping a mark, of shortening a run, of a space that stays between single characters.
SIGN_COST, MARK_COST, RUN_COST, SPACE_COST = 1.5, 1.0, 0.5, 1.0
#: Words of one character in a row, from which on they may be one word spaced apart.
SPACED = 4
#: Lengths in bytes of the word beginnings that are features.
BEGINNINGS = (4, 5, 6)
#: Readings that a Python worker remembers.
REMEMBERED = 200_000

_N = 28  # boundary, a-z, any other character
_SYMBOL = np.full(256, 27, np.uint8)
_SYMBOL[97:123] = _SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_SIGN, _MARK, _LETTER = (np.zeros(256, np.int32) for _ in range(3))
_SIGN[[ord(c) for c in SIGNS]] = 1
_MARK[[ord(c) for c in MARKS]] = 1
_LETTER[97:123] = _LETTER[65:91] = _LETTER[128:] = 1
_FIRST = np.ones(256, np.int32)  # bytes that begin a character
_FIRST[0x80:0xC0] = 0
_DIGIT = np.zeros(256, np.int32)
_DIGIT[48:58] = 1
_HEAD, _TAIL = np.zeros(256, bool), np.zeros(256, bool)
_HEAD[[ord(c) for c in "\"'([{"]] = True
_TAIL[[ord(c) for c in "\"')]}.,;:!?"]] = True


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros(_N**3, np.int64)
    for b in batches:
        data, off = T.buffers(b.column("text"))
        s = np.concatenate((_SYMBOL[data], np.zeros(2, np.uint8))).astype(np.int64)
        sums += np.bincount(s[:-2] * _N * _N + s[1:-1] * _N + s[2:], minlength=_N**3)
    at = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["code", "n"])


def character_model(docs: DataFrame) -> np.ndarray:
    """Natural-log probability of a character after the two before it, from all texts; a table of 28 cubed."""
    small_batches(docs.sparkSession)
    found = docs.select("text").mapInArrow(_trigrams, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    counts = np.full(_N**3, 0.5)
    for r in found:
        counts[r["code"]] += r["n"]
    counts = counts.reshape(_N, _N, _N)
    counts[0, 0] = counts[:, 0].sum(0)  # the start of a word, whatever stands before it
    # a character that is no letter says nothing of which one it is: it shares its probability among many
    model = np.log(counts / counts.sum(2, keepdims=True))
    model[:, :, 27] -= math.log(40)
    return model


Step = list[tuple[str, float]]


def _drawn(runs: list[tuple[str, int]]) -> bool:
    """Whether a word's letters are doubled throughout: two runs and more, and more than half of all."""
    sizes = [n for c, n in runs if c not in SIGNS and c not in MARKS]
    return 2 <= sum(n > 1 for n in sizes) > len(sizes) / 2


def lattice(word: str) -> list[Step]:
    """Per run of equal characters the readings and their costs; a reading is a string of any length."""
    runs = [(c, len(list(run))) for c, run in groupby(word)]
    drawn = _drawn(runs)
    steps: list[Step] = []
    for i, (c, n) in enumerate(runs):
        if c in SIGNS or c in MARKS:
            readings = [(c * n, 0.0)]
            for x in SIGNS.get(c, ""):
                readings.append((x, SIGN_COST + (RUN_COST if n > 1 else 0.0)))
                if n > 1:
                    readings.append((x * 2, SIGN_COST + (RUN_COST if n > 2 else 0.0)))
            if c in MARKS:
                readings.append(("", MARK_COST))
            elif n > 2 and 0 < i < len(runs) - 1:  # a sign over and over between letters is a mark
                readings.append(("", 2 * MARK_COST))
            steps.append(readings)
        elif n > 2:
            steps.append([(c, RUN_COST), (c * 2, RUN_COST), *([(c * n, 0.0)] if n == 3 else [])])
        elif n == 2 and drawn:
            steps.append([(c * 2, 0.0), (c, RUN_COST)])
        else:
            steps.append([(c * n, 0.0)])
    return steps


def apart(letters: list[str], gaps: list[int]) -> list[Step]:
    """Lattice of single characters with white space of these widths between them; what is wider than the narrowest is a space."""
    steps = lattice(letters[0])
    for c, gap in zip(letters[1:], gaps, strict=True):
        steps.append([(" ", 0.0)] if gap > min(gaps) else [("", 0.0), (" ", SPACE_COST)])
        steps += lattice(c)
    return steps


def best_reading(steps: list[Step], model: np.ndarray) -> tuple[str, float]:
    """The likeliest reading of a lattice and its cost, by Viterbi over the last two characters; readings are kept as links."""
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for step in steps:
        following: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, link) in best.items():
            for reading, own in step:
                x, y, total = a, b, cost + own
                for c in reading:
                    s = ord(c) - 96 if "a" <= c <= "z" else 0 if c == " " else 27
                    total -= model[x, y, s]
                    x, y = y, s
                if (x, y) not in following or total < following[x, y][0]:
                    following[x, y] = (total, (link, reading))
        best = following
    cost, _, link = min(((cost - model[x, y, 0], (x, y), link) for (x, y), (cost, link) in best.items()), key=lambda r: r[:2])
    parts = []
    while link:
        link, reading = link
        parts.append(reading)
    return "".join(reversed(parts)), float(cost)


def decode(word: str, model: np.ndarray) -> tuple[str, float]:
    """The likeliest reading of a lower-cased word and its cost."""
    return best_reading(lattice(word), model)


class Restorer:
    """Readings of the disguised words of a batch of texts."""

    def __init__(self, model: np.ndarray) -> None:
        self.model = model
        self.known: dict[str, str] = {}

    def read(self, word: str) -> str:
        """A word's likeliest reading; those of ordinary length are remembered."""
        if len(word) > 64:
            return decode(word, self.model)[0]
        if word not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = decode(word, self.model)[0]
        return self.known[word]

    def joined(self, letters: list[str], gaps: list[int]) -> str | None:
        """The words that spaced characters make, if any space is to go; characters that are one over and over, or mostly digits, stay."""
        if len(set(letters)) < 2 or 2 * sum(c not in SIGNS for c in letters) < len(letters):
            return None
        text, _ = best_reading(apart(letters, gaps), self.model)
        return text if text.split() != letters else None

    def find(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, str]]]:
        """(starts, ends, first words) of the trimmed words, and (first word, words, reading) of what is read otherwise."""
        starts, ends, at = T.spans(data, off)
        s, e = starts.copy(), ends.copy()
        for _ in range(4 if len(s) else 0):
            s += _HEAD[data[s]] & (e - s > 1)
            e -= _TAIL[data[e - 1]] & (e - s > 1)
        if not len(s):
            return s, e, at, []
        low = T.lowered(data)
        same = np.zeros(len(data), bool)
        same[1:] = low[1:] == low[:-1]
        same[s] = False
        again = np.concatenate(([False], same[:-1]))  # the byte before is like the one before it
        letter = _LETTER[low] > 0

        def within(flags: np.ndarray) -> np.ndarray:
            total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
            return total[e] - total[s]

        signs, marks, letters, chars, digits = (within(x[data]) for x in (_SIGN, _MARK, _LETTER, _FIRST, _DIGIT))
        runs, doubles, equal, kinds = (within(x) for x in (same & again & letter, same & ~again & letter, same & letter, ~same))
        single = (chars == 1) & (signs + letters > 0)
        drawn = (doubles > 1) & (2 * doubles > letters - equal)
        only_signs = (letters == 0) & (digits == 0) & (signs == chars) & (signs > 2) & (kinds > 1)
        doubtful = (((signs + marks > 0) & (letters > 0)) | (runs > 0) | drawn | only_signs) & ~single
        out: list[tuple[int, int, str]] = []
        text = low.tobytes()
        for i in np.flatnonzero(doubtful).tolist():
            word = text[s[i] : e[i]].decode("utf-8", "ignore")
            reading = self.read(word)
            if reading != word:
                out.append((i, 1, reading))
        doc = np.repeat(np.arange(len(off) - 1), np.diff(at))
        edge = np.concatenate(([True], (single[1:] != single[:-1]) | (doc[1:] != doc[:-1]), [True]))
        cut = np.flatnonzero(edge)
        for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if single[a] and z - a >= SPACED:
                own = [text[s[i] : e[i]].decode("utf-8", "ignore") for i in range(a, z)]
                if words := self.joined(own, (s[a + 1 : z] - e[a : z - 1]).tolist()):
                    out.append((a, z - a, words))
        return s, e, at, out

    def restore(self, texts: pa.Array) -> list[str]:
        """The texts with every disguised word as it is read; white space elsewhere stays."""
        data, off = T.buffers(texts)
        s, e, at, found = self.find(data, off)
        raw, out, found = data.tobytes(), [], sorted(found)
        k = 0
        for d in range(len(off) - 1):
            parts, here = [], int(off[d])
            while k < len(found) and found[k][0] < at[d + 1]:
                first, n, reading = found[k]
                parts += [raw[here : s[first]], reading.encode()]
                here = int(e[first + n - 1])
                k += 1
            out.append(b"".join([*parts, raw[here : off[d + 1]]]).decode("utf-8"))
        return out


def featuriser(model: np.ndarray) -> linear.Featurise:
    """Hashed words and beginnings of words of the restored texts."""
    restorer = Restorer(model)

    def featurise(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, off = T.buffers(texts)
        s, e, at, found = restorer.find(data, off)
        if not len(s):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(off) - 1), np.diff(at))
        keep = np.ones(len(s), bool)
        for first, n, _ in found:
            keep[first : first + n] = False
        out = [(doc[keep], data, s[keep], e[keep])]
        if found:
            read = [(i, w.encode()) for i, _, r in found for w in r.split()]
            z = np.cumsum([len(w) for _, w in read]).astype(np.int64)
            if read:
                out.append((doc[[i for i, _ in read]], np.frombuffer(b"".join(w for _, w in read), np.uint8), np.concatenate(([0], z[:-1])).astype(np.int64), z))
        rows, features = [], []
        for d, bytes_, a, b in out:
            if not len(a):
                continue
            nearer = [np.minimum(a + n, b) for n in BEGINNINGS]
            hashed = T.hashes_to(bytes_, a, b, *nearer)
            rows.append(d)
            features.append(linear.slot(hashed[0], 20))
            for n, h in zip(BEGINNINGS, hashed[1:], strict=True):
                longer = b - a > n
                rows.append(d[longer])
                features.append(linear.slot(h[longer], 20 + n))
        return np.concatenate(rows), np.concatenate(features)

    return featurise


def held_out(doc_id: str = "doc_id", mod: int = 5):
    """Rows whose crc32(doc_id as text) mod ``mod`` is 0; a null doc_id counts as empty text, which is held out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % mod == 0


def train(docs: DataFrame, labels: DataFrame, mod: int = 5, fit_rows: int = linear.FIT_ROWS) -> tuple[linear.Model, np.ndarray]:
    """(classifier, character model); labels come from at most ``fit_rows`` rows that aren't held out."""
    characters = character_model(docs)
    return linear.train(linear.sample(docs, labels, "toxic", ~held_out(mod=mod), fit_rows), featuriser(characters)), characters


def score(docs: DataFrame, model: linear.Model, characters: np.ndarray, mod: int = 5) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    The score is the probability of the mark on the restored text. A null text is empty; empty texts have the base rate. Repeated
    rows are scored each, other columns aren't read. A model that knew one mark only scores 0.5 where it has no threshold.
    """
    kind = dict(docs.dtypes)["doc_id"]
    scored = docs.select("doc_id", "text").mapInArrow(linear.scorer(model, featuriser(characters)), f"doc_id {kind}, above array<double>")
    p = F.coalesce(F.try_element_at("above", F.lit(1)), F.lit(0.5))
    return scored.select("doc_id", held_out(mod=mod).alias("held_out"), p.alias("score"), (p >= 0.5).cast("int").alias("predicted"))


def restored(docs: DataFrame, characters: np.ndarray) -> DataFrame:
    """docs with their texts as they are read; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(characters)
        for b in batches:
            i = b.schema.get_field_index("text")
            old = b.column(i)
            new = [None if o is None else t for o, t in zip(old.to_pylist(), restorer.restore(old), strict=True)]
            yield b.set_column(i, b.schema.field(i), pa.array(new, old.type))

    return docs.mapInArrow(run, docs.schema)
