"""Language of a text by prediction by partial matching over bytes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from newscheck.llm import arrays as A

# Bytes of the longest context.
ORDER = 4
# Bound of the training sample: rows for each language.
SAMPLE_ROWS = 600
UNKNOWN = "und"
_FAR = np.uint64(8)


def _mask(size: int) -> np.uint64:
    return np.uint64((1 << 8 * size) - 1)


def _windows(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """Each byte with the ``order`` bytes before it in its text (zeros before the first)."""
    wide = data.astype(np.uint64)
    w = wide.copy()
    for k in range(1, order + 1):
        w[k:] |= wide[:-k] << np.uint64(8 * k)
    for k in range(order):
        at = offsets[:-1] + k
        at = at[at < offsets[1:]]
        w[at] &= _mask(k + 1)
    return w


@dataclass
class Level:
    """Contexts of one length in one language, and what followed them."""

    contexts: np.ndarray  # sorted
    n: np.ndarray  # bytes seen after the context
    kinds: np.ndarray  # distinct bytes among them
    covered: np.ndarray  # times that these same bytes were seen after the next shorter context
    parent: np.ndarray  # place of the next shorter context in its level
    grams: np.ndarray  # sorted, context and byte
    counts: np.ndarray


def _look_up(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def _levels(grams: np.ndarray, counts: np.ndarray, order: int) -> list[Level]:
    """The context tree of one language from counts of its longest grams; shortest contexts first."""
    out: list[Level] = []
    for k in range(order + 1):
        own, at = np.unique(grams & _mask(k + 1), return_inverse=True)
        c = np.bincount(at, counts, len(own)).astype(np.int64)
        contexts, first, kinds = np.unique(own >> _FAR, return_index=True, return_counts=True)
        n = np.add.reduceat(c, first)
        covered, parent = np.zeros(len(contexts), np.int64), np.zeros(len(contexts), np.int64)
        if k:
            below = out[-1]
            shorter = below.counts[_look_up(below.grams, own & _mask(k))]
            covered = np.add.reduceat(shorter, first)
            parent = _look_up(below.contexts, contexts & _mask(k - 1))
        out.append(Level(contexts, n, kinds, covered, parent, own, c))
    return out


def code_lengths(levels: list[Level], windows: np.ndarray) -> np.ndarray:
    """Bits for the last byte of each window after the bytes before it, under frozen counts.

    From the longest known context down: a byte seen there takes log2(total / count),
    where the total holds one escape count for each distinct byte. An escape takes
    log2(total / escapes), and the bytes it rules out do not count further down. At the
    end all bytes not ruled out are equally likely.
    """
    bits = np.zeros(len(windows))
    left = np.arange(len(windows))
    above = np.full(len(windows), -1, np.int64)  # the context just escaped from
    for k in range(len(levels) - 1, -1, -1):
        level, w = levels[k], windows[left]
        node = _look_up(level.contexts, (w >> _FAR) & _mask(k))
        seen = _look_up(level.grams, w & _mask(k + 1))
        at = np.maximum(node, 0)
        total, escapes = level.n[at] + level.kinds[at], level.kinds[at].copy()
        ruled = np.flatnonzero(above >= 0)
        if len(ruled):
            upper, v = levels[k + 1], above[ruled]
            total[ruled] -= upper.covered[v] + upper.kinds[v]
            escapes[ruled] -= upper.kinds[v]
        hit = (node >= 0) & (seen >= 0)
        bits[left[hit]] += np.log2(total[hit] / level.counts[seen[hit]])
        out = (node >= 0) & ~hit & (escapes > 0)
        bits[left[out]] += np.log2(total[out] / escapes[out])
        left, above = left[~hit], node[~hit]
    if levels and len(left):
        bits[left] += np.log2(256 - levels[0].kinds[0])
    return bits


@dataclass
class Model:
    """Context trees by language, and the code lengths of all grams that any of them has."""

    languages: list[str]
    trees: list[list[Level]]
    order: int

    def __post_init__(self) -> None:
        every = [t[-1].grams for t in self.trees]
        self.grams = np.unique(np.concatenate(every)) if every else np.zeros(0, np.uint64)
        self.bits = np.stack([code_lengths(t, self.grams) for t in self.trees]) if every else np.zeros((0, 0))

    def ready(self) -> Model:
        """Make the lookup table, once in each worker."""
        if not hasattr(self, "index"):
            self.index = A.HashIndex()
            self.index.add(self.grams)
        return self

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text in each language (languages x texts)."""
        w = _windows(data, offsets, self.order)
        at = self.index.find(w)
        bits = np.zeros((len(self.languages), len(offsets) - 1))
        full = np.flatnonzero(np.diff(offsets) > 0)
        miss = np.flatnonzero(at < 0)
        rare, where = np.unique(w[miss], return_inverse=True)
        at[miss] = 0
        for k, tree in enumerate(self.trees):
            each = self.bits[k][at]
            each[miss] = code_lengths(tree, rare)[where]
            if len(full):
                bits[k, full] = np.add.reduceat(each, offsets[:-1][full])
        return bits


def train(docs: DataFrame, order: int = ORDER, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Context trees from ``text`` and non-null ``lang`` of ``docs``.

    Fitted on a bounded sample: at most ``sample_rows`` whole texts of each language,
    those with the smallest hash. Grams are counted in Spark; the driver gets the counts.
    Null texts and null languages teach nothing; without any row the model has no language.
    """
    if not 1 <= order <= 7:
        raise ValueError("order is 1 to 7")
    rows = docs.where("lang is not null and text is not null").select("lang", "text")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], [], order)
    # a little more than the bound by a hash threshold, so that few texts are sorted
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 1.3 * sample_rows / n + 1e-3))])
    sample = (
        rows.withColumn("h", F.xxhash64("text"))
        .where(F.pmod(F.col("h"), F.lit(1 << 20)) < share[F.col("lang")] * F.lit(1 << 20))
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
        .where(F.col("rank") <= sample_rows)
        .select("lang", "text")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            data, offsets = A.text_buffer(batch.column("text"))
            for first, last, part, ends in A.pieces(data, offsets):
                w = _windows(part, ends, order)
                code = np.repeat(langs.indices.to_numpy()[first:last], np.diff(ends))
                for k in np.unique(code):
                    grams, n = np.unique(w[code == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([langs.dictionary[int(k)].as_py()] * len(grams), pa.string()),
                            pa.array(grams.view(np.int64)),
                            pa.array(n, pa.int64()),
                        ],
                        ["lang", "gram", "n"],
                    )

    counted = (
        sample.mapInArrow(A.tidy(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ).toArrow()
    names = sorted(sizes)
    lang = np.array(counted.column("lang").to_pylist(), object)
    gram = counted.column("gram").to_numpy().view(np.uint64)
    n = counted.column("n").to_numpy()
    known = [name for name in names if (lang == name).any()]
    return Model(known, [_levels(gram[lang == x], n[lang == x], order) for x in known], order)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred``, ``score`` and ``bits_per_byte``.

    The language with the shortest code for the whole text (ties: the first by name);
    ``score`` is its share of all languages' probabilities of the text. A text that is
    null or has no letter is ``und`` with score 0, as is any text under an empty model.
    Columns of these three names are replaced. Rows are taken one by one, without shuffle.
    """
    added = {"lang_pred": T.StringType(), "score": T.DoubleType(), "bits_per_byte": T.DoubleType()}
    kept = [c for c in docs.columns if c not in added]
    mark = "_has_letter" + "_" * max(map(len, docs.columns))  # clashes with no column
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(c, t) for c, t in added.items()])
    plain = (model.languages, [[astuple(level) for level in tree] for tree in model.trees], model.order)
    shared, key = docs.sparkSession.sparkContext.broadcast(plain), uuid.uuid4().hex

    def ready() -> Model:
        languages, trees, order = shared.value
        return Model(languages, [[Level(*level) for level in tree] for tree in trees], order).ready()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = A.per_process(("language", key), ready)
        for batch in batches:
            lettered = batch.column(mark).fill_null(False).to_numpy(zero_copy_only=False)
            for first, last, data, offsets in A.pieces(*A.text_buffer(batch.column("text"))):
                some = lettered[first:last].copy()
                pred, score, rate = np.full(last - first, UNKNOWN, object), np.zeros(last - first), np.zeros(last - first)
                if m.languages:
                    bits = m.score(data, offsets)
                    best = bits.argmin(0)
                    least = bits.min(0)
                    pred[some] = np.array(m.languages, object)[best[some]]
                    score[some] = (1 / np.exp2(np.maximum(least - bits, -1000)).sum(0))[some]
                    rate = least / np.maximum(np.diff(offsets), 1)
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in kept] + [pa.array(pred, pa.string()), pa.array(score), pa.array(rate)],
                    [*kept, *added],
                )

    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col("text").rlike(r"\p{L}").alias(mark)).mapInArrow(A.tidy(run, "language"), schema)
