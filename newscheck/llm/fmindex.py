"""Benchmark passages in training texts: an FM-index over each shard of texts, searched for all passages."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newscheck.llm import arrays as A
from newscheck.session import discard, materialize

# Words of a window; an item of fewer words is one window.
WINDOW = 10
# Bytes of text in a shard; a longer text is cut, with an overlap, so no shard is larger (but for a single longer word).
SHARD = 1 << 21
# Bytes of benchmark text that are looked for in one pass over the documents.
BLOCK = 1 << 22
# Of so many suffixes one keeps its place.
SAMPLE = 16
# Occurrences that are located at a time.
_LOCATED = 1 << 20
_COLUMNS = "n_words long, spans array<struct<first:long,last:long>>, items array<string>"
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

# Fixed class: bytes of words, once A-Z are in lower case: digits, letters, all beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Starts and ends of words, the first word of each text (and the end), and the words themselves."""
    data = A.lower_ascii(data)
    word = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(word & (edge[:-1] | ~np.r_[False, word[:-1]][: len(word)]))
    ends = np.flatnonzero(word & (edge[1:] | ~np.r_[word[1:], False][: len(word)])) + 1
    places = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=places[1:])
    values = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(data[word])])
    return starts, ends, np.searchsorted(starts, offsets), values


@dataclass(frozen=True)
class Phrases:
    """Distinct windows, as numbers of ``words`` at the right end of rows of WINDOW, and the items that each is in."""

    words: pa.Array
    windows: np.ndarray
    lengths: np.ndarray
    first_item: np.ndarray
    items: np.ndarray
    names: list[str | None]


def phrases(names: list[str | None], texts: list[str | None], window: int = WINDOW) -> Phrases:
    """Windows of the items; a missing text has none."""
    data, offsets = A.text_buffer(pa.array(texts, pa.string()))
    _, _, first, values = _words(data, offsets)
    coded = values.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    rows, owner = [np.zeros((0, window), np.int64)], []
    for k, (a, b) in enumerate(zip(first, first[1:])):
        size = min(b - a, window)
        if size:
            n = b - a - size + 1
            row = np.full((n, window), -1, np.int64)
            row[:, window - size :] = np.lib.stride_tricks.sliding_window_view(codes[a:b], size)
            rows.append(row)
            owner.append(np.full(n, k))
    windows, number = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
    pairs = np.unique(np.stack([number.ravel(), np.concatenate([np.zeros(0, np.int64), *owner])], 1).astype(np.int64), axis=0)
    lengths = (windows >= 0).sum(1)
    starts = np.searchsorted(pairs[:, 0], np.arange(len(windows) + 1))
    return Phrases(coded.dictionary, windows, lengths, starts, pairs[:, 1], names)


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Places of all suffixes in order; a suffix that ends comes before those that go on.

    Prefix doubling that sorts again only what is still equal: few suffixes after some
    words, except within copies.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    bits = int(symbols.max() + 1).bit_length()
    h = max(1, 63 // bits)
    key = np.zeros(n, np.int64)
    for k in range(h):
        key <<= bits
        key[: max(n - k, 0)] += symbols[k:] + 1
    order = np.argsort(key)
    held = key[order]
    new = np.r_[True, held[1:] != held[:-1]]
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    alone = new & np.r_[new[1:], True]
    todo = np.flatnonzero(~alone)
    while len(todo):
        at = order[todo]
        further = np.where(at + h < n, rank[np.minimum(at + h, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + further
        place = np.argsort(key)
        at, key = at[place], key[place]
        order[todo] = at
        new = np.r_[True, key[1:] != key[:-1]]
        rank[at] = todo[np.maximum.accumulate(np.where(new, np.arange(len(todo)), 0))]
        todo = todo[~(new & np.r_[new[1:], True])]
        h *= 2
    return order


class Bits:
    """A bit sequence with ranks: 64-bit words and the number of ones before each."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        padded = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        padded[: len(packed)] = packed
        self.words = padded.view(np.uint64)
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at >> 6] + np.bitwise_count(self.words[at >> 6] & mask)


class Wavelet:
    """Wavelet matrix: a bit sequence for each bit of the symbols, the highest first."""

    def __init__(self, symbols: np.ndarray, n_symbols: int) -> None:
        self.levels, self.zeros = [], []
        for shift in reversed(range(max(1, int(n_symbols - 1).bit_length()))):
            bit = (symbols >> shift) & 1 == 1
            self.levels.append(Bits(bit))
            self.zeros.append(int(len(bit) - np.count_nonzero(bit)))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        every = np.arange(n_symbols)
        self.begin = self._down(every, np.zeros(n_symbols, np.int64))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros)):
            one = (symbols >> (len(self.levels) - 1 - k)) & 1 == 1
            ones = level.rank(at)
            at = np.where(one, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        return self._down(symbols, at) - self.begin[symbols]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before."""
        symbols = np.zeros(len(at), np.int64)
        for level, zeros in zip(self.levels, self.zeros):
            one = level.get(at)
            ones = level.rank(at)
            at = np.where(one, zeros + ones, at - ones)
            symbols = symbols * 2 + one
        return symbols, at - self.begin[symbols]


class FMIndex:
    """FM-index of a few texts of words: which of given word sequences occur, and where.

    Texts end with separators, which order suffixes and match nothing. Every
    :data:`SAMPLE`-th place and the first of each text keep their numbers, so a walk back from
    an occurrence meets one within its text.
    """

    def __init__(self, codes: np.ndarray, n_codes: int, first: np.ndarray) -> None:
        n_texts = len(first) - 1
        sizes = np.diff(first)
        text = np.repeat(np.arange(n_texts), sizes)
        symbols = np.zeros(len(codes) + n_texts, np.int64)
        symbols[first[1:] + np.arange(n_texts)] = np.arange(n_texts)  # separators, each its own for the order
        symbols[np.arange(len(codes)) + text] = codes + n_texts
        self.starts = first[:-1] + np.arange(n_texts)
        order = suffix_array(symbols)
        plain = np.maximum(symbols - n_texts + 1, 0)  # separators are one symbol from here on
        self.n = len(plain)
        self.below = np.zeros(n_codes + 2, np.int64)
        np.cumsum(np.bincount(plain, minlength=n_codes + 1), out=self.below[1:])
        self.wavelet = Wavelet(plain[order - 1], n_codes + 1)
        kept = np.zeros(self.n, bool)
        kept[::SAMPLE] = True
        kept[self.starts] = True
        self.sampled = Bits(kept[order])
        self.places = order[kept[order]]

    def search(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search: numbers of the windows that occur, and their ranges of suffixes."""
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), self.n, np.int64)
        left = np.arange(len(windows))
        for k in range(windows.shape[1]):
            on = left[lengths[left] > k]
            symbol = windows[on, windows.shape[1] - 1 - k] + 1
            low[on] = self.below[symbol] + self.wavelet.rank(symbol, low[on])
            high[on] = self.below[symbol] + self.wavelet.rank(symbol, high[on])
            left = left[low[left] < high[left]]
        return left, low[left], high[left]

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Places of suffixes: walk back to a sampled one."""
        at, out, steps = at.copy(), np.zeros(len(at), np.int64), 0
        left = np.arange(len(at))
        while len(left):
            here = at[left]
            known = self.sampled.get(here)
            out[left[known]] = self.places[self.sampled.rank(here[known])] + steps
            left, here = left[~known], here[~known]
            symbol, before = self.wavelet.access(here)
            at[left] = self.below[symbol] + before
            steps += 1
        return out


def _find(data: np.ndarray, offsets: np.ndarray, wanted: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts of a shard: the first word of each, which words are hit, and pairs of text and item."""
    starts, _, first, values = _words(data, offsets)
    pairs = np.zeros((0, 2), np.int64)
    coded = values.dictionary_encode()
    known = pc.fill_null(pc.index_in(wanted.words, value_set=coded.dictionary), -1)
    known = np.append(known.to_numpy(zero_copy_only=False).astype(np.int64), -2)  # -2: nothing stands there
    windows = known[wanted.windows]
    usable = np.flatnonzero((windows != -1).all(1))
    if not len(usable) or not len(starts):
        return first, np.zeros(len(starts), bool), pairs
    index = FMIndex(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary), first)
    found, low, high = index.search(windows[usable], wanted.lengths[usable])
    found = usable[found]
    n_items = np.diff(wanted.first_item)
    total = np.cumsum(high - low)
    turns = np.zeros(index.n + 1, np.int64)
    for a in range(0, int(total[-1]) if len(total) else 0, _LOCATED):
        k = np.arange(a, min(a + _LOCATED, total[-1]))
        which = np.searchsorted(total, k, "right")
        place = index.locate(high[which] - (total[which] - k))
        phrase = found[which]
        turns += np.bincount(place, minlength=len(turns)) - np.bincount(place + wanted.lengths[phrase], minlength=len(turns))
        text = np.searchsorted(index.starts, place, "right") - 1
        both = np.unique(np.stack([text, phrase], 1), axis=0)
        n = n_items[both[:, 1]]
        items = wanted.items[A.ragged(wanted.first_item[both[:, 1]], n)]
        pairs = np.unique(np.concatenate([pairs, np.stack([np.repeat(both[:, 0], n), items], 1)]), axis=0)
    covered = np.cumsum(turns[:-1]) > 0
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return first, covered[np.arange(len(starts)) + text], pairs


def _parts(data: np.ndarray, size: int, overlap: int) -> Iterator[tuple[int, int, int]]:
    """Cuts of one long text between words: first byte, last byte, and words that the part before has too."""
    n = len(data)
    word = _WORD[A.lower_ascii(data)]
    at, begin, shared = 0, 0, 0
    while True:
        end = min(at + size, n)
        if end < n:
            between = np.flatnonzero(~(word[at:end] & word[at + 1 : end + 1]))
            if len(between):
                end = at + 1 + int(between[-1])
            else:  # a word longer than a shard
                gaps = np.flatnonzero(~word[end:])
                end = end + int(gaps[0]) if len(gaps) else n
        yield begin, end, shared
        if end == n:
            return
        starts = _words(data[begin:end], np.array([0, end - begin]))[0]
        shared = min(overlap, len(starts))
        begin = begin + int(starts[len(starts) - shared]) if shared else end
        at = end


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last (exclusive) places of runs of true."""
    edge = np.diff(np.r_[0, hit.astype(np.int8), 0])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _mark(texts: pa.Array, wanted: Phrases, before: tuple[list, list] | None, shard: int) -> dict[str, pa.Array]:
    """Number of words, spans of words hit, and items found of each text; ``before`` has spans and items of earlier passes."""
    data, offsets = A.text_buffer(texts)
    overlap = wanted.windows.shape[1] - 1
    counts, spans, items = [], [], []

    def add(hit: np.ndarray, found: np.ndarray) -> None:
        names = {wanted.names[i] for i in found} - {None}
        if before is not None:
            for span in before[0][len(counts)]:
                hit[span["first"] : span["last"]] = True
            names |= set(before[1][len(counts)])
        counts.append(len(hit))
        spans.append([{"first": int(a), "last": int(b)} for a, b in zip(*_runs(hit))])
        items.append(sorted(names))

    for a, b, some, at in A.pieces(data, offsets, shard):
        if b - a == 1 and len(some) > shard:
            hits, found = np.zeros(0, bool), np.zeros(0, np.int64)
            for begin, end, shared in _parts(some, shard, overlap):
                _, hit, pairs = _find(some[begin:end], np.array([0, end - begin]), wanted)
                hits[len(hits) - shared :] |= hit[:shared]
                hits = np.concatenate([hits, hit[shared:]])
                found = np.union1d(found, pairs[:, 1])
            add(hits, found)
            continue
        first, hit, pairs = _find(some, at, wanted)
        of = np.searchsorted(pairs[:, 0], np.arange(b - a + 1))
        for k in range(b - a):
            add(hit[first[k] : first[k + 1]].copy(), pairs[of[k] : of[k + 1], 1])
    return {"n_words": pa.array(counts, pa.int64()), "spans": pa.array(spans, _SPANS), "items": pa.array(items, pa.list_(pa.string()))}


def _blocks(benchmark: DataFrame, block: int) -> Iterator[tuple[list, list]]:
    """Distinct items in blocks of about ``block`` bytes (or one longer item); one is on the driver at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        yield [r[0] for r in rows], [r[1] for r in rows]


def mark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """``docs`` with ``n_words``, ``spans`` (merged, of words from 0, the end exclusive) and ``items`` (sorted ids).

    Words are runs of digits, letters and characters beyond ASCII, with A-Z in lower case. A
    window is ``window`` words of an item, or all words of a shorter one; words within any
    occurrence of a window are hit.

    A missing text has no words, on either side. Items without an id hit words but are not
    listed; an id that is there twice is listed once. Columns of the same names are replaced.
    Documents are not shuffled; a task holds one shard and one block of the benchmark. Items
    beyond a block are looked for in further passes, each over the written rows of the last.
    """
    made = T.StructType.fromDDL(_COLUMNS)
    rows = docs.drop(*made.names)
    out = T.StructType([*rows.schema.fields, *made.fields])
    written = None
    for number, (names, texts) in enumerate(_blocks(benchmark, block)):
        if number:
            kept = materialize(rows, "marked")
            if written is not None:
                discard(written)
            rows = written = kept
        rows = rows.mapInArrow(_search(docs.sparkSession.sparkContext.broadcast((names, texts)), window, shard, number > 0), out)
    return rows


def _search(sent, window: int, shard: int, later: bool):
    key = ("phrases", uuid.uuid4().hex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = A.per_process(key, lambda: phrases(*sent.value, window))
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns))
            before = (columns["spans"].to_pylist(), columns["items"].to_pylist()) if later else None
            found = _mark(columns["text"], wanted, before, shard)
            yield pa.RecordBatch.from_pydict({n: c for n, c in columns.items() if n not in found} | found)

    return A.tidy(run, "phrases")


def remove(marked: DataFrame) -> DataFrame:
    """A table of :func:`mark` whose texts lack what the spans cover: first byte of the first word to last byte of the last."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        data, offsets = A.text_buffer(texts)
        out = texts.to_pylist()
        for k, found in enumerate(spans.to_pylist()):
            if found:
                text = data[offsets[k] : offsets[k + 1]]
                starts, ends, _, _ = _words(text, np.array([0, len(text)]))
                at = [0, *(int(p) for s in found for p in (starts[s["first"]], ends[s["last"] - 1])), len(text)]
                out[k] = b"".join(text[a:b].tobytes() for a, b in zip(at[::2], at[1::2])).decode()
        return pa.array(out, pa.string())

    return marked.withColumn("text", cut("text", "spans"))
