"""Words of Arrow text columns as numpy arrays, and hashes of words and word windows.

Short runs are hashed together by polynomials modulo 2**64. Those give equal values to long runs
that alternate two symbols in certain patterns (Thue-Morse), so longer runs are hashed one by one.

Everything works on the UTF-8 bytes of whole texts, a few megabytes at a time.
A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; those are ASCII,
so runs of bytes and runs of code points are the same words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 1 << 19

WORD_BYTES = np.ones(256, dtype=bool)
WORD_BYTES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

#: Odd multipliers of the two polynomial hashes over bytes and over words.
BYTE_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
WORD_BASES = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Runs of more values than this do not rely on a polynomial.
LONG = 64


def one_by_one(out: np.ndarray, values: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """``out`` with the hashes of long runs of ``values`` replaced by ones that hold for any pattern."""
    view = memoryview(np.ascontiguousarray(values)).cast("B")
    width = values.itemsize
    for i in np.flatnonzero(end - start > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(view[start[i] * width : end[i] * width], seed)
    return out


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i below n (kept between calls while small)."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 8 << 20:
            _POWERS[base] = have
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


class Windows:
    """Hashes of any runs of a sequence of 64-bit values, from one prefix sum."""

    def __init__(self, values: np.ndarray, base: int):
        self.prefix = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * powers(base, len(values)), out=self.prefix[1:])
        self.back = powers(inverse(base), len(values) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.back[start]


@dataclass
class Words:
    """Words of consecutive documents: byte ranges in ``data``; document i has the words first[i] to first[i + 1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self, seed: int = 0) -> np.ndarray:
        """One 64-bit hash per word; ``seed`` 0 or 1 picks one of two independent hashes."""
        out = np.empty(len(self.start), dtype=np.uint64)
        i = 0
        while i < len(out):  # a bounded stretch of bytes at a time
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + SLICE_BYTES, side="right")))
            lo = int(self.start[i])
            w = Windows(self.data[lo : int(self.end[j - 1])].astype(np.uint64) + np.uint64(1), BYTE_BASES[seed])
            s, e = self.start[i:j] - lo, self.end[i:j] - lo
            out[i:j] = mix(w.of(s, e) + (e - s).astype(np.uint64) * np.uint64(BYTE_BASES[1 - seed]))
            i = j
        return one_by_one(out, self.data, self.start, self.end, seed)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    offs = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    body = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def split(data: np.ndarray, offs: np.ndarray, lower: bool = False, word_bytes: np.ndarray = WORD_BYTES) -> Words:
    if lower:
        data = _LOWER[data]
    word = word_bytes[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = word[:-1]
    inner = offs[(offs > 0) & (offs < len(data))]
    before[inner] = False
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = word[1:]
    after[inner - 1] = False
    start = np.flatnonzero(word & ~before)
    end = np.flatnonzero(word & ~after) + 1
    return Words(data, start, end, np.searchsorted(start, offs))


def slices(texts: pa.Array, lower: bool = False, word_bytes: np.ndarray = WORD_BYTES) -> Iterator[tuple[int, int, Words]]:
    """Whole documents i to j at a time, of about SLICE_BYTES together."""
    data, offs = buffers(texts)
    i, n = 0, len(offs) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offs, offs[i] + SLICE_BYTES, side="right")) - 1))
        yield i, j, split(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], lower, word_bytes)
        i = j


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
