"""Best-fit packing of token sequences, certified by dual-feasible lower bounds.

Documents become pieces of at most ``capacity`` tokens. Pieces are dealt to parts of bounded size; each part runs
best-fit decreasing and computes a lower bound on its number of sequences from dual feasible functions. What lies in unfilled
sequences of a part whose count isn't certified, and the emptiest sequence of every part, is exchanged: dealt anew to fewer
parts and packed again, until one part is left or a round wins nothing.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlens.llm.common import small_batches, table
from govlens.llm.minhash import _grouped

CAPACITY = 2048
#: Pieces of a part: what one task holds (some 20 bytes each).
PART = 20_000
#: A round that leaves more than this share of the pieces for the next one wins nothing.
WINS = 0.95
#: Chunks whose ids a Python worker remembers.
REMEMBERED = 300_000
#: Chunks of a text whose ids, one after the other, are the text's: the tokenizer's own pattern never goes on from a mark to white
#: space or from a letter to an ASCII mark, takes a single line end before a mark by itself, and looks ahead in white space only.
_CHUNK = re.compile(r"\n(?=\S)|\s*[A-Za-zÀ-ÖØ-öø-ÿ]+(?![^\s!-@\[-`{-~])|\s*\S+|\s+")

_tokenizers: dict[str, tuple] = {}


def _tokenizer(path: str) -> tuple:
    """(tokenizer, bytes of each id, remembered ids by chunk, the file's added tokens) of this Python worker."""
    if path not in _tokenizers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        added = list(t.get_added_tokens_decoder().values())
        if any(a.lstrip or a.rstrip or a.single_word or a.normalized for a in added):
            raise ValueError("added tokens that take in spaces, words or normal forms can't be split off")
        names = sorted((a.content for a in added), key=len, reverse=True)
        vocabulary = t.get_vocab(with_added_tokens=False)
        size = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            size[i] = len(token)  # a byte is a character of the token's name
        _tokenizers[path] = (t, size, {}, names)
    return _tokenizers[path]


def _chunks(text: str, added: list[str]) -> list[str]:
    """Chunks of a text: its added tokens, each by itself, and those of what lies between them."""
    if not any(name in text for name in added):
        return _CHUNK.findall(text)
    parts = re.split("(" + "|".join(map(re.escape, added)) + ")", text)
    return [c for i, part in enumerate(parts) for c in ([part] if i % 2 else _CHUNK.findall(part))]


def _learn(chunks: list[str], tokenizer, size: np.ndarray, known: dict[str, bytes]) -> None:
    """Remembers the ids of new chunks; those that begin with a space go through the tokenizer a hundred at a time."""
    joined = [c for c in chunks if c[0] == " " and c[-1] > " "]
    alone = [c for c in chunks if c[0] != " " or c[-1] <= " "]
    groups = [joined[i : i + 100] for i in range(0, len(joined), 100)]
    for group, e in zip(groups, tokenizer.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False), strict=True):
        ids = np.array(e.ids, "<u4")
        ends, reach = np.cumsum([len(c.encode()) for c in group]), np.cumsum(size[ids])
        at = np.searchsorted(reach, ends) + 1
        if not np.array_equal(reach[np.minimum(at, len(reach)) - 1], ends):
            alone += group
            continue
        raw, a = ids.tobytes(), 0
        for c, z in zip(group, (4 * at).tolist(), strict=True):
            known[c] = raw[a:z]
            a = z
    for c, e in zip(alone, tokenizer.encode_batch_fast(alone, add_special_tokens=False), strict=True):
        known[c] = np.array(e.ids, "<u4").tobytes()


def token_ids(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit, with the closing id 0.

    They are those of the tokenizer's file as it stands, without tokens added around a text: an added token that a text names is that token.
    """
    tokenizer, size, known, added = _tokenizer(path)
    if len(known) > REMEMBERED:
        known.clear()
    out: list[bytes] = []
    for i in range(0, len(texts), 200):
        waiting, new = [], set()
        for text in texts[i : i + 200]:
            chunks = _chunks(text, added)
            parts = list(map(known.get, chunks))
            gaps = [(k, chunks[k]) for k, p in enumerate(parts) if p is None]
            new.update([c for _, c in gaps])
            waiting.append((parts, gaps))
        _learn(list(new), tokenizer, size, known)
        for parts, gaps in waiting:
            for k, c in gaps:
                parts[k] = known[c]
            out.append(b"".join(parts) + b"\0\0\0\0")
    return out


def cuts(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces: all full but the first, which has what is left over."""
    first = length % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


def _pieces(path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            rows = []
            for doc, ids in zip(b.column("doc_id").to_pylist(), token_ids(texts, path), strict=True):
                for k, (s, n) in enumerate(cuts(len(ids) // 4, capacity)):
                    own = ids[4 * s : 4 * (s + n)]
                    rows.append((doc, k, s, n, zlib.crc32(own), *([np.frombuffer(own, "<u4")] if with_ids else [])))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * (5 + with_ids)
            kinds = [b.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.list_(pa.int32())] if with_ids else [])]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    return run


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY) -> int:
    """The most that dual feasible functions say: volume, the threshold family and the rounding family."""
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * x).sum()) // capacity)
    number, volume = np.cumsum(count), np.cumsum(count * x)
    t = np.arange(1, capacity // 2 + 1)  # sizes over capacity - t count as whole, those under t as nothing
    whole = number[capacity] - number[capacity - t]
    middle = volume[capacity - t] - volume[t - 1]
    best = max(best, int((whole + -(-middle // capacity)).max()))
    for k in range(1, 21):
        scaled = np.where((k + 1) * x % capacity == 0, x * k, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int((count * scaled).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(bin, offset) of each size, and each bin's filling: the largest first, into the fullest bin with room."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, filled = 0, []  # rooms: a bit for each room that some bin has
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(filled)
            filled.append(0)
        bins[i], offsets[i] = b, filled[b]
        filled[b] += size
        if room - size:
            by_room[room - size].append(b)
            rooms |= 1 << (room - size)
    return bins, offsets, filled


def _pack(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _grouped(batches, "part"):
            sizes = g.column("length").to_numpy()
            bins, offsets, filled = best_fit_decreasing(sizes, capacity)
            fill, bound = np.array(filled, np.int64), lower_bound(sizes, capacity)
            again = fill == fill.min()
            if len(fill) > bound:
                again |= fill < capacity
            n = len(g)
            yield pa.RecordBatch.from_arrays(
                [g.column("item").combine_chunks(), pa.array(sizes), g.column("part").combine_chunks(), pa.array(bins), pa.array(offsets), pa.array(again[bins]), pa.array(np.full(n, len(fill))), pa.array(np.full(n, bound))],
                ["item", "length", "part", "bin", "offset", "again", "bins", "bound"],
            )

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, and its ids if asked for."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    ids = ", ids array<int>" if with_ids else ""
    return docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, capacity, with_ids), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long{ids}")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, part: int = PART) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified.

    A null text is empty and gives one token, the closing one. Rows that repeat a doc_id are packed each. Other columns
    aren't read. An empty table gives no rows. certified says that the piece's part met its lower bound when it was packed
    last; a full piece is a sequence of its own.
    """
    cut = table(pieces(docs, tokenizer, capacity).withColumn("item", F.monotonically_increasing_id()), "pack-pieces")
    pending = cut.filter(F.col("length") < capacity).select("item", "length")
    left = pending.count()
    placed = cut.filter(F.col("length") >= capacity).select("item", (-F.col("item") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))
    schema = "item long, length long, part long, bin long, offset long, again boolean, bins long, bound long"
    for turn in count():
        if not left:
            break
        parts = -(-left // part)
        dealt = pending.withColumn("part", F.pmod(F.xxhash64("item", F.lit(turn)), F.lit(parts)))
        packed = table(dealt.repartition("part").sortWithinPartitions("part", "item").mapInArrow(_pack(capacity), schema), "pack-round")
        pending = packed.filter("again").select("item", "length")
        before, left = left, pending.count()
        last = parts == 1 or left > WINS * before
        done = packed if last else packed.filter(~F.col("again"))
        number = F.lit(turn).cast("long") * F.lit(2**52) + F.col("part") * F.lit(2**24) + F.col("bin")
        placed = placed.unionByName(done.select("item", number.alias("sequence_id"), "offset", (F.col("bins") == F.col("bound")).alias("certified")))
        if last:
            break
    out = cut.join(placed, "item")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified")


def sequences(docs: DataFrame, packed: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """The packed token sequences themselves: sequence_id and ids, for docs with distinct doc_ids."""
    own = pieces(docs, tokenizer, capacity, with_ids=True).select("doc_id", "piece", "ids")
    placed = packed.select("doc_id", "piece", "sequence_id", "offset").join(own, ["doc_id", "piece"])
    laid = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("laid"))
    return laid.select("sequence_id", F.flatten(F.col("laid.ids")).alias("ids"))
