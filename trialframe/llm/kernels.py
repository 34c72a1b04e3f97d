"""Vectorised text kernels shared by the operators that run Arrow batches.

A batch of texts is handled as one byte buffer: word bounds come from a
byte-class table, word and n-gram hashes from prefix sums of a polynomial
modulo 2**64 followed by a 64-bit finaliser. No Python loop runs per word.
Nulls are empty texts; very long texts are handled whole (a slice always
holds at least one document).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# fixed value: the separators of the word pattern [^\x20\x09-\x0D]+
SEPARATORS = bytes([0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20])
SLICE_BYTES = 1 << 19

_IS_WORD_BYTE = np.ones(256, dtype=bool)
_IS_WORD_BYTE[list(SEPARATORS)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_GRAM_BASE = 0xD6E8FEB86659FD93 | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_table(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i in 0..n."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            t = np.full(size, b, dtype=np.uint64)
            t[0] = 1
            out.append(np.multiply.accumulate(t))
        have = _powers[base] = (out[0], out[1])
        if size > 4 * SLICE_BYTES:  # do not keep a table sized by one huge text
            del _powers[base]
    return have


class Words:
    """Words of a slice of texts.

    data: the bytes; starts/ends: byte bounds of each word; doc: bounds of
    each text's words (len = texts + 1).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray = _IS_WORD_BYTE):
        self.data = data
        self.offsets = offsets
        n = len(data)
        w = word_bytes[data]
        start = w.copy()
        end = w.copy()
        if n:
            start[1:] &= ~w[:-1]
            end[:-1] &= ~w[1:]
            inner = offsets[(offsets > 0) & (offsets < n)]
            start[inner] = w[inner]
            end[inner - 1] = w[inner - 1]
        self.starts = np.flatnonzero(start)
        self.ends = np.flatnonzero(end) + 1
        self.doc = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        n = len(self.data)
        pw, inv = _power_table(_BASE, n)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * pw[:n], out=total[1:])
        h = (total[self.ends] - total[self.starts]) * inv[self.starts]
        return mix64(h + (self.ends - self.starts).astype(np.uint64))

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.doc) - 1), np.diff(self.doc))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n consecutive words that start at each position (the last
    n - 1 positions are left out; callers mask windows that cross texts)."""
    m = len(words)
    if m < n:
        return np.zeros(0, dtype=np.uint64)
    pw, inv = _power_table(_GRAM_BASE, m)
    total = np.zeros(m + 1, dtype=np.uint64)
    np.cumsum(words * pw[:m], out=total[1:])
    return mix64((total[n:] - total[:-n]) * inv[: m - n + 1])


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; nulls become empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(offsets):
        offsets = np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(texts: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of texts of about SLICE_BYTES."""
    data, offsets = text_buffers(texts)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, side="right")) - 1
        j = min(n, max(j, i + 1))
        part = data[offsets[i] : offsets[j]]
        yield i, j, (_LOWER[part] if lower else part), offsets[i : j + 1] - offsets[i]
        i = j


def lower_latin(data: np.ndarray) -> np.ndarray:
    """A-Z and the two-byte capitals U+00C0..U+00DE in lower case."""
    out = _LOWER[data]
    if len(out) > 1:
        capital = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)
        out[1:][capital] += 0x20
    return out


def code_point_index(data: np.ndarray) -> np.ndarray:
    """For each byte offset 0..n, the number of code points before it."""
    out = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
