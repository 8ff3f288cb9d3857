"""Vectorised tokenising and hashing of Arrow text batches with numpy.

A batch of texts is treated as one byte buffer.  Words are maximal runs of
bytes outside ``{0x20, 0x09..0x0D}`` after lower-casing A-Z, so the word rule
equals ``[^\\x20\\x09-\\x0D]+`` on the code points of the text.  Every word
gets a 64-bit hash of its bytes: a polynomial over Z/2^64 of randomised byte
values, taken from one running sum over the buffer, then mixed.
"""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MIX1, _MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_GAP = U64(0x2545F4914F6CDD1D)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (the public splitmix64 mixer)."""
    x = (x ^ (x >> U64(30))) * _MIX1
    x = (x ^ (x >> U64(27))) * _MIX2
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U64(_BASE))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~"]] = True
_LOWER_BYTE = _BYTE[_LOWER]
_pow: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and its inverses for i < n, mod 2**64; grown on demand."""
    if not _pow or len(_pow["up"]) < n:
        size = -(-n // (1 << 18)) << 18
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            out = np.empty(size, dtype=np.uint64)
            out[0] = 1
            filled, factor = 1, base
            while filled < size:
                step = min(filled, size - filled)
                out[filled : filled + step] = out[:step] * U64(factor)
                factor = factor * factor % (1 << 64)
                filled += step
            _pow[name] = out
    return _pow["up"], _pow["down"]


def utf8_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_string(column.type):
        kind = np.int32
    else:
        column, kind = column.cast(pa.large_string()), np.int64
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if len(at) == 0:
        at = np.zeros(1, dtype=np.int64)
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


class Words:
    """Words of a batch: hashes in text order, with each document's range.

    ``first[d]:first[d + 1]`` are the words of document d; ``start`` and
    ``end`` are byte positions in ``data``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True):
        self.data, self.offsets = data, offsets
        n = len(data)
        if n == 0:
            self.start = self.end = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
            self.first = np.zeros(len(offsets), np.int64)
            return
        word = ~_SPACE[data]
        starts = word.copy()
        starts[1:] &= ~word[:-1]
        inner = offsets[1:-1]
        inner = inner[inner < n]
        starts[inner] = word[inner]
        ends = word.copy()
        ends[:-1] &= ~word[1:]
        last = inner[inner > 0] - 1
        ends[last] = word[last]
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        up, down = powers(n + 1)
        total = np.empty(n + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum((_LOWER_BYTE if lower else _BYTE)[data] * up[:n], out=total[1:])
        self._total, self._down = total, down
        self.hash = self.spans(self.start, self.end)
        self.first = np.searchsorted(self.start, offsets).astype(np.int64)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges, equal for equal (lower-cased) bytes."""
        return mix((self._total[end] - self._total[start]) * self._down[start])

    def bare(self) -> np.ndarray:
        """Word hashes without punctuation at either end, up to three bytes a
        side; a word of punctuation alone keeps one byte."""
        start, end = self.start.copy(), self.end.copy()
        for _ in range(3):
            end -= _PUNCT[self.data[end - 1]] & (end - start > 1)
            start += _PUNCT[self.data[start]] & (end - start > 1)
        self.bare_start, self.bare_end = start, end
        return self.spans(start, end) if len(start) else self.hash

    def stems(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, document) of the first ``size`` bytes of every word whose
        bare form is longer; after bare()."""
        at = np.flatnonzero(self.bare_end - self.bare_start > size)
        start = self.bare_start[at]
        return self.spans(start, start + size), self.docs()[at]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def docs(self) -> np.ndarray:
        """Document number of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words_of(column: pa.Array, lower: bool = True) -> Words:
    return Words(*utf8_buffers(column), lower=lower)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of every k-word shingle; a document with 1..k-1 words
    has its whole word sequence as its one shingle, one without words none."""
    n, counts = len(words.hash), words.counts
    per = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    first = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(per, out=first[1:])
    if first[-1] == 0:
        return np.zeros(0, np.uint64), first
    acc = np.zeros(n, np.uint64)
    for j in range(min(k, n)):
        step = U64(pow(int(_GAP), j + 1, 1 << 64))
        acc[: n - j] += words.hash[j:] * step if j else words.hash * step
    begins = np.repeat(words.first[:-1] - first[:-1], per) + np.arange(first[-1])
    out = acc[begins]
    for d in np.flatnonzero((counts > 0) & (counts < k)):
        own = words.hash[words.first[d] : words.first[d + 1]]
        value = 0
        for j, h in enumerate(own.tolist()):
            value = (value + h * pow(int(_GAP), j + 1, 1 << 64)) & ((1 << 64) - 1)
        out[first[d]] = (value ^ (len(own) * 0x5851F42D4C957F2D)) & ((1 << 64) - 1)
    return mix(out), first


#: Text bytes of one slice; the arrays of a slice are some fifty times that.
PIECE = 2 << 20


def give_back() -> None:
    """Return freed memory to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def pieces(batches, budget: int = PIECE):
    """Slice record batches so that each has about ``budget`` text bytes; a
    single longer text comes whole in a slice of its own."""
    try:
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at, total = 0, 0
            for i, s in enumerate(sizes.tolist()):
                if i > at and total + s > budget:
                    yield batch.slice(at, i - at)
                    at, total = i, 0
                total += s
            if at < len(sizes):
                yield batch.slice(at)
    finally:
        give_back()


import pyarrow.compute  # noqa: E402,F401  (binds pa.compute)
