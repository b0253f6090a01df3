"""Vectorised text primitives on Arrow buffers: words, word hashes and shingles without a Python string in sight.

A word is a run of bytes other than space and 0x09-0x0D; A-Z count as a-z. A word's hash is a polynomial over a random
table of the byte values modulo 2**64, got from prefix sums for all words of a batch at once, then mixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
_TABLE = _RNG.integers(1, 2**64, size=256, dtype=np.uint64)
_TABLE[65:91] = _TABLE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 2**64))
_SEP = np.zeros(256, bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)
_powers = {"p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def mix(z: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    z = (z ^ (z >> _S30)) * _C1
    z = (z ^ (z >> _S27)) * _C2
    return z ^ (z >> _S31)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["p"]) < n:
        size = max(n, 1 << 16)
        for key, base in (("p", _BASE), ("i", _BASE_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["p"], _powers["i"]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z as a-z."""
    return _LOWER[data]


def spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and their number) of all words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    word = ~_SEP[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = off[(off > 0) & (off < len(data))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; worked through in pieces that stay in cache and keep the powers short."""
    return hashes_to(data, starts, ends)[0]


def hashes_to(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, *nearer: np.ndarray) -> list[np.ndarray]:
    """Hashes of the words, and of their beginnings up to each array of nearer ends."""
    out = [np.empty(len(starts), np.uint64) for _ in (ends, *nearer)]
    piece, i = 1 << 16, 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + piece, "right")))
        hi = ends[j - 1]
        p, inv = _power(int(hi - lo) + 1)
        sums = np.empty(hi - lo + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_TABLE[data[lo:hi]] * p[: hi - lo], out=sums[1:])
        s = starts[i:j] - lo
        for to, ends_ in zip(out, (ends, *nearer), strict=True):
            e = ends_[i:j] - lo
            to[i:j] = mix((sums[e] - sums[s]) * inv[s] + (e - s).astype(np.uint64))
        i = j
    return out


_SEQ = _RNG.integers(1, 2**63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its word shingles; a shorter text is one shingle, an empty one has none."""
    starts, ends, at = spans(data, off)
    h = hashes(data, starts, ends)
    n = len(h)
    rolled = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        rolled += h[k : k + len(rolled)] * _SEQ[k]
    rolled = mix(rolled)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= width:
            x = np.sort(rolled[a : b - width + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif b > a:
            with np.errstate(over="ignore"):
                whole = (h[a:b] * _SEQ[width : width + b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
