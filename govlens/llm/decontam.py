"""Benchmark decontamination: every passage of the corpus queries a BM25 index of test items by block-max WAND.

An item's term weights are scaled so that 1 is the least score of a passage that holds four fifths of the item's five-word shingles:
what such a passage can lack at most is known from the item. So retrieval at 1 loses none of them, and the retrieved pairs are verified
on the shingles of question (all lines but the last) and answer (the last line).
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlens.llm import text as T
from govlens.llm.common import gone, small_batches, table

K1, B = 1.2, 0.75
#: Share of shingles that a leak holds.
OVERLAP = 0.8
WIDTH = 5
#: Neighbouring items of a block, for which each term's greatest weight is known. Items lie in order of their own greatest weight, so that
#: a block's bound is near to its items' scores.
BLOCK = 4
#: Test items of one index (some 2 MB); more are worked through one index after the other.
INDEX_ITEMS = 2_000


@dataclass
class Index:
    """Postings by term: items in order and weights, the list's greatest weight, and the blocks that it reaches with their greatest."""

    terms: np.ndarray
    items: list[np.ndarray]
    weights: list[np.ndarray]
    most: np.ndarray
    reach: np.ndarray
    block: np.ndarray
    bound: np.ndarray
    n_blocks: int
    ids: list
    words: list[np.ndarray]
    answers: list[int]
    longest: int


@dataclass(frozen=True)
class Statistics:
    """Of all items: their number, words of one on average and at most, and in how many each term is (of an index's terms at least)."""

    items: int
    mean: float
    longest: int
    df: dict[int, int]


def build(ids: list, texts: list[str | None], known: Statistics | None = None) -> Index:
    """An index of items, weighted by the statistics of all items, which are these unless given; items without words have no postings.

    answers: the first word of the last line, if there are more.
    """
    texts = [t or "" for t in texts]
    data, off = T.buffers(pa.array(texts, pa.string()))
    starts, ends, at = T.spans(data, off)
    h = T.hashes(data, starts, ends)
    words = [h[a:z] for a, z in zip(at[:-1], at[1:], strict=True)]
    answers = []
    for i, t in enumerate(texts):
        head = t.rstrip().encode().rfind(b"\n")
        first = int(np.searchsorted(starts[at[i] : at[i + 1]], off[i] + head)) if head >= 0 else 0
        answers.append(first if 0 < first < len(words[i]) else len(words[i]))
    terms, inverse = np.unique(h, return_inverse=True)
    item = np.repeat(np.arange(len(words)), np.diff(at))
    key, tf = np.unique(inverse.astype(np.int64) * max(1, len(words)) + item, return_counts=True)
    term, item = key // max(1, len(words)), key % max(1, len(words))
    length = np.diff(at).astype(float)
    df = np.bincount(term, minlength=len(terms))
    known = known or Statistics(len(words), length.sum() / max(1, len(length)), int(length.max(initial=0)), dict(zip(terms.tolist(), df.tolist(), strict=True)))
    df = np.array([known.df[t] for t in terms.tolist()], np.int64)
    idf = np.log(1 + (known.items - df + 0.5) / (df + 0.5))
    norm = K1 * (1 - B + B * length / max(1.0, known.mean))
    w = idf[term] * tf * (K1 + 1) / (tf + norm[item])
    own = np.bincount(item, w, len(words))
    by_item: list[np.ndarray] = [np.zeros(0)] * len(words)
    order = np.argsort(item, kind="stable")
    cut = np.searchsorted(item[order], np.arange(len(words) + 1))
    least = np.ones(len(words))
    for i in range(len(words)):
        by_item[i] = np.sort(w[order[cut[i] : cut[i + 1]]])[::-1]
        shingles = max(1, len(words[i]) - WIDTH + 1)
        lacking = int((1 - OVERLAP) * shingles + 1e-9)
        least[i] = max(own[i] - by_item[i][:lacking].sum(), 1e-9) * (1 - 1e-9)
    w = w / least[item]
    greatest = np.zeros(len(words))
    np.maximum.at(greatest, item, w)
    order = np.argsort(greatest, kind="stable")
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    by = np.lexsort((rank[item], term))
    term, item, w = term[by], rank[item][by], w[by]
    at_term = np.searchsorted(term, np.arange(len(terms) + 1))
    lists = list(zip(at_term[:-1], at_term[1:], strict=True))
    n_blocks = max(1, -(-len(words) // BLOCK))
    block, inverse = np.unique(term * n_blocks + item // BLOCK, return_inverse=True)
    bound = np.zeros(len(block))
    np.maximum.at(bound, inverse, w)
    return Index(
        terms,
        [item[a:z] for a, z in lists],
        [w[a:z] for a, z in lists],
        np.array([w[a:z].max() for a, z in lists]) if lists else np.zeros(0),
        np.searchsorted(block // n_blocks, np.arange(len(terms) + 1)),
        block % n_blocks,
        bound,
        n_blocks,
        [ids[i] for i in order],
        [words[i] for i in order],
        [answers[i] for i in order],
        known.longest,
    )


def bounds(index: Index, passage: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
    """For n passages the greatest sum of block bounds over their distinct (passage, term) pairs."""
    out = np.zeros(n)
    step = max(1, 4_000_000 // index.n_blocks)
    for lo in range(0, n, step):
        a, z = np.searchsorted(passage, (lo, lo + step))
        size = index.reach[term[a:z] + 1] - index.reach[term[a:z]]
        entry = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(index.reach[term[a:z]], size)
        key = np.repeat(passage[a:z] - lo, size) * index.n_blocks + index.block[entry]
        own = min(step, n - lo)
        out[lo : lo + own] = np.bincount(key, index.bound[entry], own * index.n_blocks).reshape(own, -1).max(1)
    return out


def search(index: Index, terms: list[int], threshold: float = 1.0) -> list[tuple[int, float]]:
    """All items whose score for these distinct terms reaches the threshold, by block-max WAND."""
    items, weights = index.items, index.weights
    best = {t: dict(zip(index.block[index.reach[t] : index.reach[t + 1]].tolist(), index.bound[index.reach[t] : index.reach[t + 1]].tolist(), strict=True)) for t in terms}
    cursors = [[t, 0, items[t].tolist()] for t in terms]
    found = []
    while True:
        cursors = sorted((c for c in cursors if c[1] < len(c[2])), key=lambda c: c[2][c[1]])
        total, pivot = 0.0, -1
        for i, (t, _, _) in enumerate(cursors):
            total += index.most[t]
            if total >= threshold:
                pivot = i
                break
        if pivot < 0:
            return found
        at = cursors[pivot][2][cursors[pivot][1]]
        block = at // BLOCK
        upper = sum(best[t].get(block, 0.0) for t, _, _ in cursors)
        if upper < threshold:  # nothing in the pivot's block can reach it
            goal = (block + 1) * BLOCK
        else:
            score = 0.0
            for t, p, own in cursors:
                q = bisect_left(own, at, p)
                if q < len(own) and own[q] == at:
                    score += float(weights[t][q])
            if score >= threshold:
                found.append((at, score))
            goal = at + 1
        for c in cursors:
            if c[2][c[1]] < goal:
                c[1] = bisect_left(c[2], goal, c[1])


def shingles(words: np.ndarray, width: int = WIDTH) -> set[bytes]:
    """Distinct runs of ``width`` words; of fewer words the one run that there is."""
    width = min(width, len(words))
    return {words[i : i + width].tobytes() for i in range(len(words) - width + 1)} if width else set()


def overlap(passage: np.ndarray, part: np.ndarray) -> float:
    """Share of the part's shingles that the passage has; of no words 1."""
    own = shingles(part)
    return len(own & shingles(passage, min(WIDTH, len(part)))) / len(own) if own else 1.0


def _scan(index: Index):
    window = max(2 * WIDTH, 2 * index.longest + index.longest // 2)
    stride = max(1, index.longest + index.longest // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = T.buffers(b.column("text"))
            starts, ends, at = T.spans(data, off)
            h = T.hashes(data, starts, ends)
            place = np.minimum(np.searchsorted(index.terms, h), max(0, len(index.terms) - 1))
            known = index.terms[place] == h if len(index.terms) else np.zeros(len(h), bool)
            n = np.diff(at)
            passages = np.maximum(1, -(-(n - window) // stride) + 1) * (n > 0)
            doc = np.repeat(np.arange(len(n)), passages)
            first = at[doc] + stride * (np.arange(len(doc)) - np.repeat(np.cumsum(passages) - passages, passages))
            last = np.minimum(first + window, at[doc + 1])
            best: dict[tuple[int, int], tuple] = {}
            size = last - first
            word = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
            of = np.repeat(np.arange(len(doc)), size)[known[word]]
            pairs = np.unique((of << 32) | place[word[known[word]]])
            of, term = pairs >> 32, pairs & 0xFFFFFFFF
            for p in np.flatnonzero(bounds(index, of, term, len(doc)) >= 1.0).tolist():
                a, z = int(first[p]), int(last[p])
                terms = term[np.searchsorted(of, p) : np.searchsorted(of, p, "right")].tolist()
                for item, score in search(index, terms):
                    words, answer = index.words[item], index.answers[item]
                    whole, question, reply = (overlap(h[a:z], x) for x in (words, words[:answer], words[answer:]))
                    if whole >= OVERLAP or (question >= OVERLAP and reply >= OVERLAP):
                        row = (score, a - int(at[doc[p]]), z - a, whole, question, reply)
                        best[int(doc[p]), item] = max(best.get((int(doc[p]), item), row), row)
            docs = b.column("doc_id").to_pylist()
            rows = [(docs[d], *index.ids[i], *row) for (d, i), row in sorted(best.items())]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 9
            kinds = [b.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            names = ["doc_id", "item_id", "items", "score", "first_word", "words", "overlap", "question_overlap", "answer_overlap"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names)

    return run


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, number of words and distinct terms of each text."""
    for b in batches:
        data, off = T.buffers(b.column("text"))
        starts, ends, at = T.spans(data, off)
        h = T.hashes(data, starts, ends)
        terms = [np.unique(h[a:z]).view(np.int64) for a, z in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("part"), pa.array(np.diff(at)), pa.array(terms, pa.list_(pa.int64()))], ["part", "words", "terms"])


def indexes(items: DataFrame, most: int = INDEX_ITEMS) -> Iterator[Index]:
    """Indexes of all items, about ``most`` in each; its ids are (least item_id, items) of a text.

    Items of equal text are one entry before anything is collected, whatever their number. So about ``most`` texts come to the driver at once. Where
    there is more than one index, the statistics of all items are counted first and their terms' frequencies looked up for each, so scores and windows
    don't depend on how the items are parted.
    """
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.groupBy("text").agg(F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("n"))
    parts = max(1, -(-rows.count() // max(1, most // 2)))
    if parts == 1:
        own = rows.orderBy("item_id", "text").collect()
        yield build([(r["item_id"], r["n"]) for r in own], [r["text"] for r in own])
        return
    rows = table(rows.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(parts))), "wand-items")
    measured = table(rows.select("part", "text").mapInArrow(_measured, "part long, words long, terms array<long>"), "wand-terms")
    whole = measured.agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("words"), F.max("words").alias("longest")).first()
    frequency = table(measured.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "wand-df")
    for part in range(parts):
        own = rows.filter(F.col("part") == part).orderBy("item_id", "text").collect()
        terms = measured.filter(F.col("part") == part).select(F.explode("terms").alias("term")).distinct().join(frequency, "term").collect()
        df = {r["term"] % 2**64: r["df"] for r in terms}
        yield build([(r["item_id"], r["n"]) for r in own], [r["text"] for r in own], Statistics(whole["n"], whole["words"] / whole["n"], whole["longest"], df))
    gone(rows, measured, frequency)


def leaks(docs: DataFrame, items: DataFrame, most: int = INDEX_ITEMS) -> DataFrame:
    """One row per document and text of a test item that it holds: doc_id, item_id, items, score (1 and more), first_word, words (the best
    passage), overlap, question_overlap, answer_overlap.

    A leak holds 0.8 or more of an item's five-word shingles, or of its question's and of its answer's. Words are runs of bytes other than space
    and 0x09-0x0D, A-Z as a-z. Null and wordless texts, of documents and items, hold and match nothing. Any number of items of equal text is one,
    under the least of their ids; ``items`` is their number. Rows that repeat a document give rows each; other columns aren't read. Empty tables give
    no rows.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, item_id long, items long, score double, first_word long, words long, overlap double, question_overlap double, answer_overlap double"
    found = [docs.select("doc_id", "text").mapInArrow(_scan(i), schema) for i in indexes(items, most)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def clean(docs: DataFrame, items: DataFrame, most: int = INDEX_ITEMS) -> DataFrame:
    """The rows of docs that hold no test item by ``leaks``, with all their columns, which may have any names.

    A null, empty or wordless text holds nothing and stays. Rows that repeat a document stay or go alike. Without items all rows stay.
    """

    def keep(scan):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                text = b.column(b.schema.get_field_index("text"))
                numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(b.num_rows)), text], ["doc_id", "text"])
                hit = {d for r in scan(iter([numbered])) for d in r.column("doc_id").to_pylist()}
                yield b.filter(pa.array([i not in hit for i in range(b.num_rows)], pa.bool_()))

        return run

    small_batches(docs.sparkSession)
    for index in indexes(items, most):
        docs = docs.mapInArrow(keep(_scan(index)), docs.schema)
    return docs
