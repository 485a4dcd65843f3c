"""Vectorised words and hashes of whole Arrow batches of texts (numpy over UTF-8 bytes).

A word is a run of bytes other than 0x20 and 0x09-0x0D; as those are ASCII, byte runs
and character runs are the same in UTF-8. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 2**64)
#: Bytes of text that are hashed at once; a longer single text is taken whole.
SLICE_BYTES = 1 << 20


def release() -> None:
    """Gives freed memory back to the system; a Python worker lives for many tasks, and else keeps its peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no glibc
        pass


def tidy_up() -> None:
    """At a task's end: tables of powers go as well. A function of the module, as one that is sent to tasks has a copy of `_cache`."""
    _cache.clear()
    release()


def tidy(f):
    """A function over batches that gives its memory back when a task ends."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            tidy_up()

    return run


def tidy_group(f):
    """The same for functions over groups; arguments are one table, or two of a cogroup."""

    def one(table):
        out = f(table)
        tidy_up()
        return out

    def two(left, right):
        out = f(left, right)
        tidy_up()
        return out

    return two if f.__code__.co_argcount == 2 else one


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


_cache: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """Powers are kept for slices of the usual length only."""
    if n > 4 * SLICE_BYTES:
        return powers(base, n)
    if base not in _cache or len(_cache[base]) < n:
        _cache[base] = powers(base, max(n, 1 << 16))
    return _cache[base][:n]


@dataclass
class Words:
    """Words of consecutive texts: `first[i]:first[i + 1]` are those of text i."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        n = len(self.data)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[self.data] * _powers(_BASE, n), out=sums[1:])
        raw = (sums[self.end] - sums[self.start]) * _powers(_BASE_INVERSE, n)[self.start]
        return mix(raw + (self.end - self.start).astype(np.uint64))


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets from 0) of a string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def split_words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> Words:
    n = len(data)
    inside = ~_SEPARATOR[data]
    start, end = inside.copy(), inside.copy()
    if n > 1:
        start[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
    begins = offsets[:-1][(offsets[:-1] < n) & (np.diff(offsets) > 0)]
    start[begins] = inside[begins]
    last = offsets[1:][np.diff(offsets) > 0] - 1
    end[last] = inside[last]
    starts = np.flatnonzero(start)
    return Words(_LOWER[data] if lower else data, starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets))


def slices(texts: pa.Array, lower: bool) -> Iterator[tuple[int, int, Words]]:
    """(from, to, words) of runs of texts with about SLICE_BYTES each."""
    data, offsets = buffers(texts)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1)
        j = min(j, n)
        yield i, j, split_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower)
        i = j
    release()


def runs(first: np.ndarray, k: int) -> np.ndarray:
    """Indexes of words at which k words of one text start."""
    n = int(first[-1])
    ok = np.zeros(n + 1, dtype=np.int32)
    has = np.diff(first) >= k
    np.add.at(ok, first[:-1][has], 1)
    np.add.at(ok, first[1:][has] - k + 1, -1)
    return np.flatnonzero(np.cumsum(ok[:n]) > 0)


def rolling(h: np.ndarray, at: np.ndarray, k: int, base: int = _BASE) -> np.ndarray:
    """Rabin-Karp hashes, modulo 2^64, of k words from each index in `at`."""
    n = len(h)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(h * _powers(base, n), out=sums[1:])
    return mix((sums[at + k] - sums[at]) * _powers(pow(base, -1, 2**64), n)[at])


def group_starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin in a sorted array."""
    if not len(x):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
