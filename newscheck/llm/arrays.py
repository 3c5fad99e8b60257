"""Arrays over whole Arrow batches: text buffers, word hashes, hash tables.

All helpers run inside Spark tasks and look at one piece of a batch at a time, so a
task needs memory for a piece (:data:`PIECE` bytes, or one longer text) and no more.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text looked at in one go.
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_DIGIT = np.arange(1, 257, dtype=np.uint64)


def per_process(key: tuple, build: Callable):
    """What ``build()`` gave in this Python process, kept for later tasks.

    One value is kept for each ``key[0]``; another key of that kind replaces it.
    """
    kept = sys.__dict__.setdefault("_newscheck_llm", {})
    if key[0] not in kept or kept[key[0]][0] != key:
        kept[key[0]] = (key, build())
    return kept[key[0]][1]


def _give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable, *kinds: str) -> Callable:
    """``run`` for ``mapInArrow``, in a process that other stages have used before.

    What :func:`per_process` keeps for them goes first (all but ``kinds``), and freed
    memory goes back to the system after each batch: Python workers live on, and several
    of them share an executor.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = sys.__dict__.setdefault("_newscheck_llm", {})
        for kind in [k for k in kept if k not in kinds]:
            del kept[kind]

        def watched() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                _give_back()

        yield from run(watched())
        _give_back()

    return tidied


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each begins and the last ends (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if buffers[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def pieces(data: np.ndarray, offsets: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs ``(first, last)`` of whole texts with about ``size`` bytes, and their buffers."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""

    def build():
        inverse = pow(_BASE, -1, 1 << 64)
        both = []
        for base in (_BASE, inverse):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            both.append(np.cumprod(table, dtype=np.uint64))
        return tuple(both)

    size = 1 << max(20, int(n).bit_length())
    return per_process(("powers", size), build)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; equal spans have equal hashes wherever they stand."""
    n = len(data)
    power, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_DIGIT[data] * power[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64))


_GAP = np.zeros(256, bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words between ASCII white space: starts, ends, and the first word of each text (and the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    gap = _GAP[data]
    edge = np.zeros(n + 1, bool)  # a text begins here
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = gap[:-1]
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = gap[1:]
    starts = np.flatnonzero(~gap & (before | edge[:-1]))
    ends = np.flatnonzero(~gap & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all else unchanged."""
    capital = (data >= 65) & (data <= 90)
    return data + (capital.astype(np.uint8) << 5)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices ``starts[i], ..., starts[i] + counts[i] - 1`` of all i in a row."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


class HashIndex:
    """64-bit keys to 0, 1, 2, ... in order of addition; lookups of whole arrays."""

    def __init__(self) -> None:
        self.size = 0
        self._slots = np.full(1 << 12, -1, np.int64)
        self._keys = np.zeros(1 << 11, np.uint64)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - len(self._slots).bit_length())

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the keys; -1 for one that is not there."""
        out = np.full(len(keys), -1, np.int64)
        mask = np.uint64(len(self._slots) - 1)
        place = self._place(keys)
        got = self._slots[place.astype(np.int64)]
        hit = (got >= 0) & (self._keys[np.maximum(got, 0)] == keys)
        out[hit] = got[hit]
        left = np.flatnonzero(~hit & (got >= 0))
        place = place[left]
        while len(left):
            place = (place + np.uint64(1)) & mask
            got = self._slots[place.astype(np.int64)]
            hit = (got >= 0) & (self._keys[np.maximum(got, 0)] == keys[left])
            out[left[hit]] = got[hit]
            on = ~hit & (got >= 0)
            left, place = left[on], place[on]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Add keys that differ from each other and from all there."""
        self._keys = np.concatenate([self._keys[: self.size], keys])
        first, self.size = self.size, self.size + len(keys)
        if self.size * 3 > len(self._slots):
            self._slots = np.full(1 << (self.size * 4).bit_length(), -1, np.int64)
            first = 0
        left = np.arange(first, self.size)
        mask = np.uint64(len(self._slots) - 1)
        place = self._place(self._keys[left])
        while len(left):
            at = place.astype(np.int64)
            free = self._slots[at] < 0
            self._slots[at[free]] = left[free]  # of several, the last stays
            on = self._slots[at] != left
            left, place = left[on], (place[on] + np.uint64(1)) & mask
