"""Words and shingles of Arrow text columns, hashed with NumPy.

A word is a run of bytes other than blank and 0x09-0x0D, after A-Z became a-z. Words and
shingles are known by 64-bit hashes of all their bytes. Texts are taken in slices of bounded size;
only a single text longer than that makes a larger slice.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
SHINGLE = 5

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a bijection)."""
    x = x.astype(_U, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> _U(shift)
        x *= _U(factor)
    x ^= x >> _U(31)
    return x


def seeds(n: int, start: int = 1) -> np.ndarray:
    """The first n odd pseudo-random factors."""
    return mix(np.arange(start, start + n, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have at most ``limit`` bytes together, or one text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(size)
    if start < len(sizes):
        yield batch.slice(start)


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def released(rows: Batches) -> Batches:
    """``rows``, after which the worker gives back what Arrow and the C library hold free.

    Spark keeps its Python workers for later tasks; what they do not need would stay beside those.
    """

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
        if trim:
            trim(0)

    return through


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column one after the other, and n + 1 bounds; NULL is empty."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)
    bounds = bounds[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or not len(bounds) or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.ones(256, bool)
_IN_WORD[[9, 10, 11, 12, 13, 32]] = False


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word; a word never crosses from one text to the next."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = _IN_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span (spans neither empty nor overlapping)."""
    if not len(starts):
        return np.zeros(0, _U)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(first, lengths)
    bytes_ = data[place + np.repeat(starts, lengths)]
    terms = (bytes_.astype(_U) + _U(1)) * seeds(int(lengths.max()))[place]
    return mix(np.add.reduceat(terms, first) + mix(lengths.astype(_U)))


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word in order, the number of words of each text, and the words' first place."""
    data, bounds = text_bytes(texts)
    low = _LOWER[data]
    starts, ends = word_spans(low, bounds)
    first = np.searchsorted(starts, bounds)
    return hash_spans(low, starts, ends), np.diff(first), first


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its 5-word shingles.

    A shorter text counts as one shingle of all its words; no words, no shingles.
    """
    hashes, counts, first = hashed_words(texts)
    factors = seeds(SHINGLE, 1 << 20)
    n = max(len(hashes) - SHINGLE + 1, 0)
    rolled = np.zeros(n, _U)
    for j in range(SHINGLE):
        rolled += hashes[j : j + n] * factors[j]
    rolled = mix(rolled + _U(SHINGLE))
    out = []
    for i, count in enumerate(counts.tolist()):
        a = int(first[i])
        if count >= SHINGLE:
            own = np.sort(rolled[a : a + count - SHINGLE + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif count:
            whole = (hashes[a : a + count] * factors[:count]).sum(dtype=_U) + _U(count)
            out.append(mix(np.array([whole], _U)))
        else:
            out.append(np.zeros(0, _U))
    return out
