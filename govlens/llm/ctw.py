"""Language-model scoring by context-tree weighting over binary-decomposed bytes.

A text is its lower-cased words with one space between them and an end byte. Each byte is eight binary decisions; each
decision has a context tree over the bytes before it, whose nodes hold Krichevsky-Trofimov estimates and are weighted with
their children over all depths. The tree learns from all training texts; a text's code length is the sum over its bytes.

Documents are worked through in chunks. A chunk sends out its distinct words and byte windows, each once, as sorted arrays cut by leading bits:
of windows by the three latest context bytes. What shares these bits is summed up by way of bounded runs of chunks, each of which a task folds
row by row, so that it holds the distinct keys and one batch. The nodes of three context bytes and more are built in such a part; those of two are
sums over parts, by Spark; those above are one small table. Then each run of chunks meets the part's probabilities and sends them back in the
order of its keys. So neither the model, nor the vocabulary, nor all chunks of a common context are ever in one place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlens.llm import text as T
from govlens.llm.common import gone, small_batches, table

DEPTH = 5
CHUNK_BYTES = 16 << 20
#: Rows that a chunk has at most on average, for tables of empty texts.
CHUNK_ROWS = 500_000
END = 0x0A
#: Words are cut by this many leading bits of their hash, windows by this many of their latest context bytes.
WORD_BITS, SPLIT = 10, 3
#: Parts of windows are numbered from here, those of words from 0.
GRAMS = 1 << 40
#: Chunks of a run: what one task folds, or answers, of a part.
RUN = 256
#: Bytes worked on at once inside a chunk.
_STEP = 1 << 20


def normalised(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts as the model sees them, (hashes, offsets) of their words."""
    starts, ends, at = T.spans(data, off)
    h = T.hashes(data, starts, ends)
    words = np.diff(at)
    size = ends - starts
    doc = np.repeat(np.arange(len(words)), words)
    bare = np.cumsum(words == 0) - (words == 0)  # texts without a word before each text
    first = np.cumsum(size + 1) - (size + 1) + bare[doc]
    lengths = np.bincount(doc, size + 1, len(words)).astype(np.int64) + (words == 0)
    to = np.concatenate(([0], np.cumsum(lengths)))
    out = np.full(to[-1], 0x20, np.uint8)
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
    source = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts, size)
    out[place] = T.lowered(data[source])
    out[to[1:] - 1] = END
    return out, to, h, at


def windows(data: np.ndarray, off: np.ndarray, depth: int) -> np.ndarray:
    """Each byte with the depth bytes before it as one number: the latest context byte leads, the byte itself is last."""
    n = len(data)
    key = data.astype(np.uint64)
    for d in range(1, depth + 1):
        before = np.full(n, END, np.uint64)
        before[d:] = data[:-d] if d < n else 0
        for k in range(d):  # contexts don't reach into the text before
            i = off[:-1] + k
            before[i[i < off[1:]]] = END
        key |= before << np.uint64(8 * (depth - d + 1))
    return key


def _held(doc_ids: list, mod: int) -> np.ndarray:
    import zlib

    return np.array([zlib.crc32(b"" if d is None else str(d).encode()) % mod == 0 for d in doc_ids], bool)


def _pieces(t: pa.Table | pa.RecordBatch, depth: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of a table's texts of some million bytes: first and last row, windows, their offsets, word hashes, their offsets."""
    data, off = T.buffers(t.column("text"))
    lo = 0
    while lo < len(off) - 1:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + _STEP, "right")) - 1)
        own, to, h, at = normalised(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        yield lo, hi, windows(own, to, depth), to, h, at
        lo = hi


class _Counter:
    """Distinct keys with summed counts, merged whenever enough has come together."""

    def __init__(self) -> None:
        self.keys, self.counts, self.waiting = [], [], 0

    def add(self, keys: np.ndarray, weight: np.ndarray | None = None) -> None:
        if not len(keys):
            return
        if weight is None:
            k, c = np.unique(keys, return_counts=True)
        else:
            k, inverse = np.unique(keys, return_inverse=True)
            c = np.bincount(inverse, weight, len(k)).astype(np.int64)
        self.keys.append(k)
        self.counts.append(c)
        self.waiting += len(k)
        if self.waiting > 1 << 20:
            self.merge()

    def put(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Adds keys that are distinct and sorted already."""
        self.keys.append(keys)
        self.counts.append(counts)
        self.waiting += len(keys)
        if self.waiting > 1 << 20:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        k, inverse = np.unique(np.concatenate(self.keys), return_inverse=True)
        c = np.bincount(inverse, np.concatenate(self.counts), len(k)).astype(np.int64)
        self.keys, self.counts, self.waiting = [k], [c], 0
        return k, c


def _emit(depth: int, mod: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[_Counter, _Counter]] = {}
        for b in batches:
            chunks = b.column("chunk").to_numpy()
            for c in np.unique(chunks).tolist():
                own = pa.table(b).filter(pa.array(chunks == c))
                train = ~_held(own.column("doc_id").to_pylist(), mod)
                words, grams = seen.setdefault(c, (_Counter(), _Counter()))
                for lo, hi, w, to, h, at in _pieces(own, depth):
                    for counter, keys, o in ((grams, w, to), (words, h, at)):
                        learns = np.repeat(train[lo:hi], np.diff(o))
                        counter.add(keys[learns])
                        rest = keys[~learns]
                        counter.add(rest, np.zeros(len(rest), np.int64))
        for c in list(seen):
            words, grams = seen.pop(c)
            for first, counter, shift in ((0, words, 64 - WORD_BITS), (GRAMS, grams, 8 * (depth + 1 - SPLIT))):
                keys, counts = counter.merge()
                top = (keys >> np.uint64(shift)).astype(np.int64)
                cut = np.concatenate(([0], np.flatnonzero(top[1:] != top[:-1]) + 1, [len(top)])) if len(top) else np.zeros(1, np.int64)
                spans = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
                for i in range(0, len(spans), 5000):
                    part = spans[i : i + 5000]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([first + int(top[a]) for a, _ in part], pa.int64()),
                            pa.array([c] * len(part), pa.int64()),
                            pa.array([keys[a:z].tobytes() for a, z in part], pa.binary()),
                            pa.array([counts[a:z].tobytes() for a, z in part], pa.binary()),
                        ],
                        ["top", "chunk", "keys", "counts"],
                    )

    return run


COUNTED = "top long, keys binary, counts binary, total long, types long"


def _fold_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct keys with summed counts of rows that come sorted by ``part``, and the sums behind N and V."""
    part, top, counter, out = None, 0, _Counter(), []

    def done() -> tuple:
        keys, counts = counter.merge()
        return top, keys.tobytes(), counts.tobytes(), int(counts.sum()), int((counts > 0).sum())

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], ["top", "keys", "counts", "total", "types"])

    for b in batches:
        parts, tops = b.column("part").to_numpy(), b.column("top").to_numpy()
        for i, (k, c) in enumerate(zip(b.column("keys").to_pylist(), b.column("counts").to_pylist(), strict=True)):
            if parts[i] != part:
                if part is not None:
                    out.append(done())
                    if len(out) >= 1000 or len(out[-1][1]) > 1 << 20:
                        yield flush()
                        out = []
                part, top, counter = parts[i], int(tops[i]), _Counter()
            counter.put(np.frombuffer(k, np.uint64), np.frombuffer(c, np.int64))
    if part is not None:
        out.append(done())
    yield flush()


def _summed(rows: DataFrame, part) -> DataFrame:
    """Rows of top, keys and counts with those of a part made one."""
    dealt = rows.select(part.alias("part"), "top", "keys", "counts").repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(_fold_rows, COUNTED)


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """To each chunk the values of its keys; rows come sorted by part, the part's values (chunk -1) before its chunks."""
    known, values = np.zeros(0, np.uint64), np.zeros(0)
    for b in batches:
        tops, chunks, out = b.column("top").to_numpy(), b.column("chunk").to_numpy(), []
        for i, (k, v) in enumerate(zip(b.column("keys").to_pylist(), b.column("values").to_pylist(), strict=True)):
            keys = np.frombuffer(k, np.uint64)
            if chunks[i] < 0:
                known, values = keys, np.frombuffer(v, np.float32 if tops[i] >= GRAMS else np.float64)
            else:
                out.append((tops[i], chunks[i], values[np.searchsorted(known, keys)].tobytes()))
        cols = list(zip(*out, strict=True)) if out else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["top", "chunk", "values"])


def _as_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words as their values."""
    for b in batches:
        own = [np.frombuffer(c, np.int64).astype(np.float64).tobytes() for c in b.column("counts").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("top"), b.column("keys"), pa.array(own, pa.binary())], ["top", "keys", "values"])


def _lgamma(x: np.ndarray) -> np.ndarray:
    shift = np.ones_like(x)
    for k in range(8):
        shift *= x + k
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) - np.log(shift)


def kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log2 of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return (_lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - _lgamma(n0 + n1 + 1.0)) / math.log(2) - math.log2(math.pi)


def _fold(keys: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None) -> dict:
    """Nodes of one depth from rows that fall on them; below: the rows' own weighted log-probabilities, if they are nodes."""
    nodes, inverse = np.unique(keys, return_inverse=True)
    n0, n1 = (np.bincount(inverse, x, len(nodes)) for x in (n0, n1))
    own = kt(n0, n1)
    if below is None:
        weighted, ratio = own, None
    else:
        children = np.bincount(inverse, below, len(nodes))
        weighted = np.logaddexp2(own, children) - 1
        ratio = own - children
    return {"nodes": nodes, "up": inverse, "p1": (n1 + 0.5) / (n0 + n1 + 1), "n0": n0, "n1": n1, "weighted": weighted, "ratio": ratio}


def _decisions(keys: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Per window eight node keys at full depth, and the bits; a node key is the context bytes, latest first, and the prefix."""
    byte = (keys & np.uint64(255)).astype(np.int64)
    context = keys >> np.uint64(8)
    i = np.arange(8)
    prefix = (1 << i)[None, :] | (byte[:, None] >> (8 - i)[None, :])
    bits = (byte[:, None] >> (7 - i)[None, :]) & 1
    return (context[:, None] << np.uint64(8)) | prefix.astype(np.uint64), bits


def _shorter(nodes: np.ndarray) -> np.ndarray:
    """Node keys without their oldest context byte, which stands just above the prefix."""
    return ((nodes >> np.uint64(16)) << np.uint64(8)) | (nodes & np.uint64(255))


def grow(keys: np.ndarray, counts: np.ndarray, depth: int, least: int = SPLIT) -> dict[int, dict]:
    """The nodes of all depths from ``least`` to ``depth`` over these training windows."""
    seen = counts > 0
    nodes, bits = _decisions(keys[seen], depth)
    weight = np.repeat(counts[seen].astype(np.float64), 8)
    flat = bits.ravel()
    tree = {depth: _fold(nodes.ravel(), weight * (1 - flat), weight * flat, None)}
    for d in range(depth - 1, least - 1, -1):
        t = tree[d + 1]
        tree[d] = _fold(_shorter(t["nodes"]), t["n0"], t["n1"], t["weighted"])
    return tree


def spread(tree: dict[int, dict], start: int, mixed: np.ndarray, rest: np.ndarray) -> None:
    """From depth ``start`` down: p1 of a decision whose deepest known context is the node, mixed over all depths above."""
    for d in range(start, max(tree) + 1):
        t = tree[d]
        t["q1"] = mixed + rest * t["p1"]
        if t["ratio"] is not None:
            share, up = _share(t["ratio"]), t["up"]
            mixed, rest = (mixed + rest * share * t["p1"])[up], (rest * (1 - share))[up]


def _threes(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the nodes of three context bytes hand up to those of two."""
        for b in batches:
            out: list[tuple[np.ndarray, ...]] = []
            for k, c in zip(b.column("keys").to_pylist(), b.column("counts").to_pylist(), strict=True):
                keys, counts = np.frombuffer(k, np.uint64), np.frombuffer(c, np.int64)
                if counts.any():
                    t = grow(keys, counts, depth)[SPLIT]
                    out.append(((t["nodes"] >> np.uint64(16)).astype(np.int64), (t["nodes"] & np.uint64(255)).astype(np.int64), t["n0"], t["n1"], t["weighted"]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["parent", "prefix", "n0", "n1", "below"])

    return run


def _twos(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of two context bytes from the sums of those below."""
    for b in batches:
        parent, prefix, n0, n1, below = (b.column(c).to_numpy() for c in ("parent", "prefix", "n0", "n1", "below"))
        own = kt(n0, n1)
        cols = [parent, prefix, n0, n1, np.logaddexp2(own, below) - 1, own - below]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["parent", "prefix", "n0", "n1", "weighted", "ratio"])


def _share(ratio: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp2(np.clip(-ratio, -1000, 1000)))


def _handed(top: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Probability at the nodes of two context bytes, and what they hand down."""
        for b in batches:
            parent, prefix, n0, n1, ratio = (b.column(c).to_numpy() for c in ("parent", "prefix", "n0", "n1", "ratio"))
            at, p1, share = (parent >> 8, prefix), (n1 + 0.5) / (n0 + n1 + 1), _share(ratio)
            mixed, rest = top["mixed"][at], top["rest"][at]
            cols = [parent, prefix, mixed + rest * p1, mixed + rest * share * p1, rest * (1 - share)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["parent", "prefix", "q", "mixed", "rest"])

    return run


def crown(nodes: np.ndarray, n0: np.ndarray, n1: np.ndarray, weighted: np.ndarray) -> dict[str, np.ndarray]:
    """The two top levels: for each latest byte and prefix p1, and what is handed down. At most 65,280 + 255 nodes."""
    low = _fold(nodes, n0, n1, weighted)
    root = _fold(low["nodes"] & np.uint64(255), low["n0"], low["n1"], low["weighted"])
    share = [_share(t["ratio"]) for t in (root, low)]
    mixed, rest = (share[0] * root["p1"])[root["up"]], (1 - share[0])[root["up"]]
    q0, q1 = np.full(256, 0.5), np.full((256, 256), np.nan)
    q0[root["nodes"].astype(int)] = root["p1"]
    at = ((low["nodes"] >> np.uint64(8)).astype(int), (low["nodes"] & np.uint64(255)).astype(int))
    q1[at] = mixed + rest * low["p1"]
    m2, r2 = np.zeros((256, 256)), np.ones((256, 256))
    m2[at], r2[at] = mixed + rest * share[1] * low["p1"], rest * (1 - share[1])
    return {"q0": q0, "q1": np.where(np.isnan(q1), q0[None, :], q1), "mixed": m2, "rest": r2}


def resolve(keys: np.ndarray, tree: dict[int, dict], top: dict[str, np.ndarray], depth: int, second: np.ndarray | None = None) -> np.ndarray:
    """log2 of each window's probability: each decision at the deepest context that training has seen; second: by prefix, p1 at two context bytes,
    nan where unseen, if the keys share these."""
    nodes, bits = _decisions(keys, depth)
    nodes = nodes.ravel()
    prefix = (nodes & np.uint64(255)).astype(np.int64)
    latest = (nodes >> np.uint64(8 * depth)).astype(np.int64)
    q = top["q1"][latest, prefix]
    if second is not None:
        q = np.where(np.isnan(second[prefix]), q, second[prefix])
    for d in range(min(tree), depth + 1) if tree else ():
        cut = np.uint64(8 * (depth - d))
        short = ((nodes >> (cut + np.uint64(8))) << np.uint64(8)) | prefix.astype(np.uint64)
        known = tree[d]["nodes"]
        at = np.minimum(np.searchsorted(known, short), len(known) - 1)
        q = np.where(known[at] == short, tree[d]["q1"][at], q)
    q = q.reshape(-1, 8)
    return np.log2(np.where(bits == 1, q, 1 - q)).sum(1)


def _window_values(depth: int, top: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tops, out = b.column("top").to_pylist(), []
            for t, k, c, above in zip(tops, b.column("keys").to_pylist(), b.column("counts").to_pylist(), b.column("above").to_pylist(), strict=True):
                keys, counts = np.frombuffer(k, np.uint64), np.frombuffer(c, np.int64)
                second, mixed, rest = np.full(256, np.nan), np.zeros(256), np.ones(256)
                for a in above or ():
                    second[a["prefix"]], mixed[a["prefix"]], rest[a["prefix"]] = a["q"], a["mixed"], a["rest"]
                tree: dict[int, dict] = {}
                if counts.any():
                    tree = grow(keys, counts, depth)
                    prefix = (tree[SPLIT]["nodes"] & np.uint64(255)).astype(int)
                    spread(tree, SPLIT, mixed[prefix], rest[prefix])
                values = np.concatenate([resolve(keys[i : i + 50_000], tree, top, depth, second) for i in range(0, len(keys), 50_000)])
                out.append((t, k, values.astype(np.float32).tobytes()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(cols, (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["top", "keys", "values"])

    return run


def _score_chunk(depth: int, mod: int):
    def run(docs: pa.Table, values: pa.Table) -> pa.Table:
        grams_, looked = values.column("top").to_numpy() >= GRAMS, []
        for kind, dtype in ((False, np.float64), (True, np.float32)):
            own = values.filter(pa.array(grams_ == kind)).sort_by("top")
            looked.append(np.frombuffer(b"".join(own.column("values").to_pylist()), dtype).astype(np.float64))
        words, grams = _Counter(), _Counter()
        for _, _, w, _, h, _ in _pieces(docs, depth):
            words.add(h)
            grams.add(w)
        word_keys, gram_keys = words.merge()[0], grams.merge()[0]
        n = len(docs)
        n_tokens, n_known, base, score, n_bytes = (np.zeros(n) for _ in range(5))
        for lo, hi, w, to, h, at in _pieces(docs, depth):
            doc_w, doc_h = np.repeat(np.arange(hi - lo), np.diff(to)), np.repeat(np.arange(hi - lo), np.diff(at))
            k, inverse = np.unique(w, return_inverse=True)
            score[lo:hi] = np.bincount(doc_w, looked[1][np.searchsorted(gram_keys, k)][inverse], hi - lo)
            c = looked[0][np.searchsorted(word_keys, h)]
            n_tokens[lo:hi], n_bytes[lo:hi] = np.diff(at) + 1, np.diff(to)
            n_known[lo:hi] = np.bincount(doc_h, c > 0, hi - lo)
            base[lo:hi] = np.bincount(doc_h, np.log10(c + 0.1), hi - lo)
        held = _held(docs.column("doc_id").to_pylist(), mod)
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "held_out": pa.array(held),
                "n_tokens": pa.array(n_tokens.astype(np.int64)),
                "known_words": pa.array(n_known.astype(np.int64)),
                "base_words": pa.array(base),
                "score": pa.array(score * math.log10(2)),
                "bits_per_byte": pa.array(-score / n_bytes),
            }
        )
    return run


def deal(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """(doc_id, text, chunk) and the number of chunks: rows are numbered once, so that a chunk is bounded whatever ids and texts repeat."""
    docs = table(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "ctw-rows")
    size, rows = docs.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    chunks = max(1, -(-(size or 0) // chunk_bytes), -(-rows // CHUNK_ROWS))
    return docs.select("doc_id", "text", F.pmod(F.xxhash64("row"), F.lit(chunks)).alias("chunk")), chunks


def score(docs: DataFrame, depth: int = DEPTH, mod: int = 10, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Texts whose crc32(doc_id as text) mod ``mod`` is not 0 are learnt from, all are scored. A null text is empty, and has its
    end alone; a null doc_id counts as empty text in the crc. Rows that repeat are learnt from and scored each, and spread over chunks like any others. base_score is the smoothed unigram score in log10; score the
    model's log10 probability of the lower-cased words, one space between them, and the end. A context that training never
    had adds nothing: the mix is then over the depths above. Other columns aren't read. An empty table gives no rows;
    without training texts every byte costs eight bits. ``depth`` is 3 to 7.
    """
    if not SPLIT <= depth <= 7:
        raise ValueError("a window of context bytes and byte is a number of 64 bits")
    spark = docs.sparkSession
    small_batches(spark)
    dealt, chunks = deal(docs, chunk_bytes)
    docs = dealt.select("doc_id", "text")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % mod == 0
    sent = table(dealt.repartition("chunk").mapInArrow(_emit(depth, mod), "top long, chunk long, keys binary, counts binary"), "ctw-sent")
    runs = -(-chunks // RUN)
    run = F.col("top") * F.lit(runs) + F.pmod("chunk", F.lit(runs))
    summed = _summed(sent, run) if runs > 1 else sent
    counted = table(_summed(summed, F.col("top")), "ctw-counts")
    words, grams = counted.filter(F.col("top") < GRAMS), counted.filter(F.col("top") >= GRAMS)
    # the end of a text is a token like any other: as often as there are training texts
    n_docs = docs.filter(~held).count()
    sums = words.agg(F.sum("total"), F.sum("types")).first()
    tokens, types = (sums[0] or 0) + n_docs, (sums[1] or 0) + (n_docs > 0)
    twos = grams.mapInArrow(_threes(depth), "parent long, prefix long, n0 double, n1 double, below double").groupBy("parent", "prefix")
    twos = twos.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("below").alias("below"))
    twos = table(twos.mapInArrow(_twos, "parent long, prefix long, n0 double, n1 double, weighted double, ratio double"), "ctw-twos")
    roots = twos.groupBy(F.shiftright("parent", 8).alias("latest"), "prefix").agg(F.sum("n0"), F.sum("n1"), F.sum("weighted")).toPandas().sort_values(["latest", "prefix"])
    keys = (roots["latest"].to_numpy().astype(np.uint64) << np.uint64(8)) | roots["prefix"].to_numpy().astype(np.uint64)
    top = crown(keys, *(roots[c].to_numpy().astype(np.float64) for c in roots.columns[2:]))
    # at most 255 nodes share two context bytes
    above = twos.mapInArrow(_handed(top), "parent long, prefix long, q double, mixed double, rest double")
    above = above.groupBy("parent").agg(F.collect_list(F.struct("prefix", "q", "mixed", "rest")).alias("above"))
    grams = grams.withColumn("parent", F.shiftright(F.col("top") - GRAMS, 8)).join(above, "parent", "left").select("top", "keys", "counts", "above")
    valued = grams.mapInArrow(_window_values(depth, top), "top long, keys binary, values binary").unionByName(words.mapInArrow(_as_values, "top long, keys binary, values binary"))
    # each run of chunks has its own copy of a part's values
    copies = valued.select("top", "keys", "values", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("copy"))
    asked = copies.select((F.col("top") * F.lit(runs) + F.col("copy")).alias("part"), "top", F.lit(-1).cast("long").alias("chunk"), "keys", "values")
    asked = asked.unionByName(sent.select(run.alias("part"), "top", "chunk", "keys", F.lit(None).cast("binary").alias("values")))
    back = table(asked.repartition("part").sortWithinPartitions("part", "chunk").mapInArrow(_answer, "top long, chunk long, values binary"), "ctw-values")
    gone(sent, counted, twos)
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, known_words long, base_words double, score double, bits_per_byte double"
    scored = dealt.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(_score_chunk(depth, mod), schema)
    end = math.log10(n_docs + 0.1)
    per_token = math.log10(tokens + 0.1 * (types + 1))
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known_words") + F.lit(int(n_docs > 0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base_words") + F.lit(end) - F.col("n_tokens") * F.lit(per_token)).alias("base_score"),
        "score",
        "bits_per_byte",
    )
