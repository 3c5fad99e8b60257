"""Exact Jaccard similarity join of documents on word shingles, heavy and light sets apart."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newscheck.llm import arrays as A
from newscheck.llm.components import components
from newscheck.llm.nodes import numbered
from newscheck.llm.substring import release
from newscheck.session import discard, materialize

# Documents of a candidate family that are compared in one task.
BLOCK = 8_000
# Bytes of text whose keys a task holds at a time (or one longer text).
HELD = 1 << 21
# A shingle is common if so large a share of the documents has it.
COMMON = 0.0003
# What opening a list costs, in keys.
OPENING = 2
_KEY, _DOC, _SAME, _EDGE = 0, 1, 2, 3


@dataclass(frozen=True)
class Rule:
    """Words of a shingle, and the least similarity as a percentage."""

    words: int
    percent: int

    def partner(self, size: int) -> int:
        """Size of the largest set that can be similar to one of ``size``."""
        return size * 100 // self.percent

    def least(self, size: int) -> int:
        """Least common elements with a set of ``size`` that is not the smaller one."""
        return -(-self.percent * size // 100)

    def buckets(self, size: int) -> list[int]:
        """First sizes of size classes; sets of a pair lie in one class or in two that follow."""
        first = [1]
        while first[-1] <= size:
            first.append(self.partner(first[-1]) + 1)
        return first

    def classes(self, first: int) -> tuple[int, int]:
        """For pairs whose smaller set is in the size class: most differing elements, and parts to cut sets into."""
        high = self.partner(first)
        total = high + self.partner(high)
        differ = total * (100 - self.percent) // (100 + self.percent)
        return differ, differ + 2 + differ // 25

    def light_sizes(self, size: int) -> list[int]:
        """Sizes of the subsets that a light set of ``size`` lists."""
        return sorted({c for b in range(size, self.partner(size) + 1) if (c := self.least(b)) <= size})

    def boundary(self) -> int:
        """The largest size for which listing subsets costs less than opening lists."""
        size = 0
        while True:
            first = self.buckets(size + 1)
            light = sum(math.comb(size + 1, c) for c in self.light_sizes(size + 1))
            heavy = sum(self.classes(f)[1] for f in first[-3:-1])
            if light > heavy * (1 + OPENING):
                return size
            size += 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, in order, and where each text's begin.

    A text with fewer words has one shingle of them all; one without words has none.
    """
    data = A.lower_ascii(data)
    starts, ends, first = A.words(data, offsets)
    n = np.diff(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    h = A.span_hashes(data, starts, ends)
    padded = np.concatenate([h, np.zeros(words, np.uint64)])
    at = A.ragged(first[:-1], np.where(n >= words, n - words + 1, (n > 0).astype(np.int64)))
    text = np.searchsorted(first, at, "right") - 1
    g = np.zeros(len(at), np.uint64)
    size = np.minimum(n[text], words)
    for j in range(words):
        inside = j < size
        g += np.where(inside, padded[at + j], np.uint64(0)) * np.uint64(pow(0x9FB21C651E98DF25, j + 1, 1 << 64))
    g = A.mix(g + size.astype(np.uint64))
    order = np.lexsort((g, text))
    g, text = g[order], text[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (text[1:] != text[:-1])
    g, text = g[new], text[new]
    return g, np.searchsorted(text, np.arange(len(offsets)))


def _sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    out = np.zeros(len(begin) - 1, np.uint64)
    full = np.flatnonzero(np.diff(begin) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, begin[full])
    return out


def _common(words: int, share: float):
    """Batches of ``d, text`` to shingles that at least ``share`` of the batch has (and two), with counts.

    A shingle that the share of all documents has is among them in some batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shingle_sets(data, offsets, words)[0] for _, _, data, offsets in A.pieces(*A.text_buffer(batch.column("text")))]
            shingle, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]), return_counts=True)
            many = n >= max(2, share * len(batch))
            yield pa.RecordBatch.from_arrays([pa.array(shingle[many].view(np.int64)), pa.array(n[many], pa.int64())], ["shingle", "n"])

    return run


def common_shingles(rows: DataFrame, words: int, share: float = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of at least ``share`` of all rows, in order, and how many rows have them.

    There are at most (shingles of a document on average) / ``share`` of them, whatever
    the number of documents. They only decide which keys are drawn, not what links.
    """
    least = max(2, math.ceil(share * rows.count()))
    found = rows.mapInArrow(A.tidy(_common(words, share), "powers"), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    table = found.where(F.col("n") >= least).toArrow()
    shingle, n = table.column("shingle").to_numpy().view(np.uint64), table.column("n").to_numpy()
    order = np.argsort(shingle)
    return shingle[order], n[order]


def join_keys(
    sets: np.ndarray, begin: np.ndarray, rule: Rule, common: tuple[np.ndarray, np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """``(set number, key)``: every two sets that are similar enough have a key in common.

    Light sets list all subsets of the sizes that a similar set must share. Heavy ones
    are cut into parts by element hash, one more than may differ and some: a similar set
    has a part in common, and that part is the key of an inverted list. Parts that are
    empty or hold ``common`` elements only would make long lists and are no keys; where
    all parts in common could be such, the elements of a prefix, rarest first, are keys.
    """
    size = np.diff(begin)
    often = np.zeros(len(sets), np.int64)
    if common is not None and len(common[0]):
        place = np.minimum(np.searchsorted(common[0], sets), len(common[0]) - 1)
        often = np.where(common[0][place] == sets, common[1][place], 0)
    boundary = rule.boundary()
    value = A.mix(sets ^ np.uint64(0x5851F42D4C957F2D))
    who, keys = [], []
    for i in np.flatnonzero((size > 0) & (size <= boundary)):
        own = [int(x) for x in value[begin[i] : begin[i + 1]]]
        whole = sum(own)
        made = [
            (whole - sum(out) & (1 << 64) - 1, c)
            for c in rule.light_sizes(len(own))
            for out in combinations(own, len(own) - c)
        ]
        rest = np.array([m for m, _ in made], np.uint64)
        c = np.array([c for _, c in made], np.uint64)
        who.append(np.full(len(made), i))
        keys.append(A.mix(rest + A.mix(c + np.uint64(1 << 40))))
    heavy = np.flatnonzero(size * 100 // rule.percent > boundary)
    if len(heavy):
        first = rule.buckets(int(size.max()))
        bucket = np.searchsorted(first, size[heavy], "right") - 1
        parts = np.array([rule.classes(f) for f in first])
        element = A.ragged(begin[heavy], size[heavy])
        row = np.repeat(np.arange(len(heavy)), size[heavy])
        for back in (0, 1):
            space = bucket - back
            on = space >= 0
            differ, k = parts[np.maximum(space, 0)].T
            k = np.where(on, k, 0)
            at = np.cumsum(k) - k
            mine = on[row]
            e, r = element[mine], row[mine]
            spin = A.mix(value[e] + space[r].astype(np.uint64))
            part = (spin >> np.uint64(33)) % k[r].astype(np.uint64)
            slot = at[r] + part.astype(np.int64)
            order = np.argsort(slot, kind="stable")
            slot, held, rare = slot[order], value[e][order], (often[e] == 0)[order]
            head = np.flatnonzero(np.append(True, slot[1:] != slot[:-1])) if len(slot) else np.zeros(0, np.int64)
            if not len(head):
                continue
            used = slot[head]
            owner = np.searchsorted(at, used, "right") - 1
            tag = (used - at[owner]).astype(np.uint64) + (space[owner].astype(np.uint64) << np.uint64(32))
            strong = np.logical_or.reduceat(rare, head)
            who.append(heavy[owner[strong]])
            keys.append(A.mix(np.add.reduceat(held, head) + A.mix(tag + np.uint64(1 << 50)))[strong])
            weak = k - np.bincount(owner[strong], minlength=len(heavy))
            for i in np.flatnonzero(on & (weak >= k - differ)):
                n, own = size[heavy[i]], slice(begin[heavy[i]], begin[heavy[i] + 1])
                prefix = value[own][np.lexsort((value[own], often[own]))][: n - rule.least(n) + 1]
                who.append(np.full(len(prefix), heavy[i]))
                keys.append(A.mix(prefix + np.uint64(1 << 60)))
    if not who:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(who), np.concatenate(keys)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about :data:`HELD` bytes of text."""
    for batch in batches:
        for low, high, _, _ in A.pieces(*A.text_buffer(batch.column("text")), HELD):
            yield batch.slice(low, high - low)


def _rows(rule: Rule, shared):
    """Batches of ``d, text`` to rows ``route, d, tag, other``; ``tag`` holds the kind and a set size.

    One row for each document (size of its set; equal sets of the batch point to the
    first), and the keys of distinct sets. Sets of the batch with the same key are tied to the
    first of them here, and only that one goes on to meet other batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _held(batches):
            ids = batch.column("d").to_numpy()
            size, digest = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.uint64)
            who, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            seen: dict[tuple[int, int], int] = {}
            same = np.arange(len(batch))
            for low, high, data, offsets in A.pieces(*A.text_buffer(batch.column("text"))):
                sets, begin = shingle_sets(data, offsets, rule.words)
                size[low:high] = np.diff(begin)
                digest[low:high] = A.mix(_sums(A.mix(sets + np.uint64(0x1D8E4E27C47D124F)), begin) + size[low:high].astype(np.uint64))
                for i in range(low, high):
                    if size[i]:
                        same[i] = seen.setdefault((int(size[i]), int(digest[i])), i)
                w, k = join_keys(sets, begin, rule, shared.value)
                new = same[low + w] == low + w
                who.append(low + w[new])
                keys.append(k[new])
            w, k = np.concatenate(who), np.concatenate(keys)
            order = np.lexsort((ids[w], k))
            w, k = w[order], k[order]
            head = np.ones(len(k), bool)
            head[1:] = k[1:] != k[:-1]
            leader = w[np.maximum.accumulate(np.where(head, np.arange(len(k)), 0))]
            tied = np.unique(np.stack([w[~head], leader[~head]], 1), axis=0) if len(k) else np.zeros((0, 2), np.int64)
            tied = tied[ids[tied[:, 0]] != ids[tied[:, 1]]]
            main = np.flatnonzero((same == np.arange(len(batch))) & (size > 0))
            copy = np.flatnonzero((same != np.arange(len(batch))) | (size == 0))
            alone = lambda d, x: A.mix(A.mix(d.astype(np.uint64)) + x.astype(np.uint64))
            route = [k[head], digest[main], alone(ids[copy], copy), alone(ids[tied[:, 0]], ids[tied[:, 1]])]
            d = [ids[w[head]], ids[main], ids[copy], ids[tied[:, 0]]]
            none = lambda x: np.zeros(len(x), np.int64)
            other = [none(w[head]), none(main), ids[same[copy]], ids[tied[:, 1]]]
            n = [np.zeros(head.sum(), np.int64), size[main], size[copy], np.zeros(len(tied), np.int64)]
            kind = np.repeat([_KEY, _DOC, _SAME, _EDGE], [len(x) for x in d])
            tag = 4 * np.concatenate(n) + kind
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(route).view(np.int64)),
                    pa.array(np.concatenate(d), pa.int64()),
                    pa.array(tag, pa.int64()),
                    pa.array(np.concatenate(other), pa.int64()),
                ],
                ["route", "d", "tag", "other"],
            )

    return run


def _batch_sets(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs ``(first, last)`` of a batch's rows with the sets of their texts and where each begins."""
    for low, high, data, offsets in A.pieces(*A.text_buffer(batch.column("text"))):
        yield low, high, *shingle_sets(data, offsets, words)


def _family_sets(words: int):
    """Rows ``family, d, text`` to rows ``family, d, s``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, sets, begin in _batch_sets(batch, words):
                part = batch.slice(low, high - low)
                s = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("family"), part.column("d"), s], ["family", "d", "s"])

    return run


class _Lists:
    """Inverted lists of the sets of a block."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.size = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        order = np.argsort(flat)
        flat = flat[order]
        self.owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.size)[order]
        del order
        self.first = np.append(np.flatnonzero(np.append(True, flat[1:] != flat[:-1])), len(flat))
        self.element = flat[self.first[:-1]]

    def similar(self, s: np.ndarray, percent: int) -> np.ndarray:
        """Numbers of the sets similar enough to ``s``."""
        at = np.minimum(np.searchsorted(self.element, s), len(self.element) - 1)
        at = at[self.element[at] == s]
        lists = self.owner[A.ragged(self.first[at], self.first[at + 1] - self.first[at])]
        common = np.bincount(lists, minlength=len(self.size))
        return np.flatnonzero((common > 0) & (100 * common >= percent * (self.size + len(s) - common)))


def link_block(ids: np.ndarray, sets: list[np.ndarray], probe: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Edges that connect what similar pairs with at least one ``probe`` document connect.

    Documents are looked up one by one in the inverted lists; it ends as soon as those
    not yet looked up are all connected to each other.
    """
    lists, group, out = _Lists(sets), np.arange(len(sets)), []
    left = np.array(probe, bool)
    others = not left.all()
    while left.any():
        rest = np.flatnonzero(left)
        if not others and (group[rest] == group[rest[0]]).all():
            break
        names, counts = np.unique(group[rest], return_counts=True)
        i = rest[np.argmax(group[rest] != names[counts.argmax()])] if len(names) > 1 else rest[0]
        left[i] = False
        near = lists.similar(sets[i], percent)
        for other in np.unique(group[near]):
            if other != group[i]:
                out.append((int(ids[i]), int(ids[other])))
                low, high = sorted((other, group[i]))
                group[group == high] = low
    return out


class _Place:
    """Documents that meet: those listed with each other or, if others stream past, only with these."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.ids: list[int] = []
        self.sets: list[np.ndarray] = []
        self.probe: list[bool] = []
        self.lists: _Lists | None = None

    def add(self, d: int, s: np.ndarray, probe: bool) -> None:
        self.ids.append(d)
        self.sets.append(s.copy())
        self.probe.append(probe)

    def pass_by(self, d: int, s: np.ndarray) -> list[tuple[int, int]]:
        """Edges of one more document; of documents connected here already, to one only."""
        if not self.ids:
            return []
        if self.lists is None:
            self.lists = _Lists(self.sets)
            self.sets = []
            self.group = np.arange(len(self.ids))
        near = np.unique(self.group[self.lists.similar(s, self.percent)])
        if len(near) > 1:
            self.group[np.isin(self.group, near)] = near[0]
        return [(d, self.ids[g]) for g in near]

    def settle(self) -> list[tuple[int, int]]:
        """Edges among the listed, if none passed by."""
        if self.lists is not None or len(self.ids) < 2:
            return []
        return link_block(np.array(self.ids), self.sets, np.array(self.probe), self.percent)


def _links(words: int, percent: int):
    """Rows ``place, side, d, text, probe``, places in a row and listed documents (side 0) first, to edges ``a, b``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, here = None, _Place(percent)
        for batch in batches:
            edges: list[tuple[int, int]] = []
            named = list(zip(*(batch.column(c).to_pylist() for c in ("place", "side", "d", "probe"))))
            for low, high, sets, begin in _batch_sets(batch, words):
                for i, (place, side, d, probe) in enumerate(named[low:high]):
                    if place != at:
                        edges += here.settle()
                        at, here = place, _Place(percent)
                    s = sets[begin[i] : begin[i + 1]]
                    if side:
                        edges += here.pass_by(d, s)
                    else:
                        here.add(d, s, probe)
            yield _edges(edges)
        yield _edges(here.settle())

    def _edges(edges: list[tuple[int, int]]) -> pa.RecordBatch:
        both = np.array(edges, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    return run


def similar_classes(docs: DataFrame, words: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs`` (``doc_id, text``).

    Two documents link if the Jaccard similarity of their sets of ``words``-word shingles
    (A-Z in lower case) is at least ``percent``; the component is the smallest id that
    links reach. Exact: candidates share a key of :func:`join_keys`, and are compared whole.

    1. Common shingles are counted. Keys are drawn from each text and shuffled; documents with the same key are tied to
    the first that has it. 2. Ties give families of candidates. 3. A family's sets meet in
    one task and are compared by inverted lists; in one larger than ``block`` all are first
    compared with one member, and those not similar to it with each other and the rest, in blocks.

    Null, empty and blank texts have no shingles and link with nothing. Equal texts are
    linked without comparison. Rows of one ``doc_id`` count as one document; each row with a
    null id is a document of its own whose id is above all others, shown as null. An empty
    table gives no rows.
    """
    nodes = numbered(docs.select("doc_id", "text"), "d")
    found = _classes(nodes.rows.select("d", "text"), words, percent, block)
    nodes.discard()
    return found.select(nodes.id_of(F.col("d")).alias("doc_id"), F.col("n").alias("n_shingles"), nodes.id_of(F.col("root")).alias("component_id"))


def _classes(rows: DataFrame, words: int, percent: int, block: int) -> DataFrame:
    """``d, n, root`` of every row of ``rows`` (``d, text``); see :func:`similar_classes`."""
    if words < 1 or not 50 < percent <= 100:
        raise ValueError("words is at least 1, percent above 50 and at most 100")
    rule = Rule(words, percent)
    kind = (F.col("tag") % 4).alias("kind")
    over = Window.partitionBy("route", F.col("tag") % 4)
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(common_shingles(rows, words))
    made = rows.mapInArrow(A.tidy(_rows(rule, shared), "powers"), "route long, d long, tag long, other long")
    tied = made.select("d", kind, F.floor(F.col("tag") / 4).alias("n"), "other", F.min("d").over(over).alias("low"))
    tied = tied.withColumn("other", F.when(F.col("kind") <= _DOC, F.col("low")).otherwise(F.col("other")))
    tied = tied.where((F.col("kind") == _DOC) | (F.col("kind") == _SAME) | (F.col("d") != F.col("other"))).drop("low")
    tied = materialize(tied, "ties")
    release(spark)
    sizes = tied.where(F.col("kind").isin(_DOC, _SAME)).select("d", "n")
    equal = tied.where(F.col("kind").isin(_DOC, _SAME) & (F.col("d") != F.col("other"))).select(F.col("d").alias("a"), F.col("other").alias("b"))
    maybe = tied.where(F.col("kind").isin(_KEY, _EDGE)).select(F.col("d").alias("a"), F.col("other").alias("b")).distinct()
    nodes = components(maybe)
    counted = nodes.groupBy("root").agg(F.count("*").alias("m"), F.min("node").alias("head"))
    family = nodes.join(counted, "root").select(F.col("node").alias("d"), F.col("root").alias("family"), "m", "head")
    # families grow with the input, so they are not broadcast at any size
    family = materialize(family, "families")
    # texts take half the space of their sets, which are made again where they are compared
    held = materialize(rows.join(family.hint("merge"), "d").select("family", "m", "head", "d", "text"), "held")
    release(spark)
    side = lambda n: (n if isinstance(n, Column) else F.lit(n)).cast("int").alias("side")
    small = held.where(F.col("m") <= block).select(F.col("family").alias("place"), side(0), "d", "text", F.lit(True).alias("probe"))
    # large families: first against one member
    large = held.where(F.col("m") > block)
    sets_of = lambda t: t.select("family", "d", "text").mapInArrow(A.tidy(_family_sets(words), "powers"), "family long, d long, s array<long>")
    head = sets_of(large.where("d = head")).groupBy("family").agg(F.first("s").alias("h"), F.first("d").alias("head"))
    common = F.size(F.array_intersect("s", "h"))
    close = common * 100 >= (F.size("s") + F.size("h") - common) * percent
    tested = sets_of(large).join(head, "family").groupBy("family", "d", "head").agg(F.max(close).alias("close"), F.min(close).alias("all_close"))
    tested = materialize(tested, "tested")
    every = large.drop("head").join(tested.hint("merge"), ["family", "d"])
    loose = every.where("not all_close")
    # the loose ones of a family in parts: each part meets each part, itself too, once; the
    # others, which only loose ones have to meet, in parts of their own. A task lists one part
    # and has the other pass by
    count = F.count_if(~F.col("all_close"))
    spread = tested.groupBy("family").agg(F.ceil(count / F.lit(block)).alias("columns"), F.greatest(F.lit(1), F.ceil((F.count("*") - count) / F.lit(block))).alias("lines"))
    spread = spread.where("columns > 0")
    part = lambda n: F.pmod(F.xxhash64("d"), F.col(n))
    across = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), (F.col(n) - 1).cast("long")))
    loose = loose.join(spread, "family").withColumn("part", part("columns"))
    rest = every.where("all_close").join(spread, "family").withColumn("part", part("lines"))
    place = lambda kind, one, two: F.xxhash64(F.lit(kind), "family", one, two).alias("place")
    probe = lambda yes: F.lit(yes).alias("probe")
    loose_pairs = loose.withColumn("with", across("columns")).select(place(0, F.least("part", "with"), F.greatest("part", "with")), side(F.col("part") > F.col("with")), "d", "text", probe(True))
    asked = loose.withColumn("with", across("lines")).select(place(1, F.col("with"), F.col("part")), side(1), "d", "text", probe(True))
    others = rest.withColumn("with", across("columns")).select(place(1, F.col("part"), F.col("with")), side(0), "d", "text", probe(False))
    blocks = loose_pairs.union(asked).union(others)
    found = small.union(blocks).repartition("place").sortWithinPartitions("place", "side", "d").mapInArrow(A.tidy(_links(words, percent), "powers"), "a long, b long")
    stars = tested.where("close and d <> head").select(F.col("d").alias("a"), F.col("head").alias("b"))
    roots = components(found.union(stars).union(equal))
    discard(held, family, tested)
    release(spark)
    return sizes.join(roots, sizes["d"] == roots["node"], "left").select("d", "n", F.coalesce("root", "d").alias("root"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """Rows of ``docs`` without near duplicates: of each component the document with the smallest id stays.

    Same columns. Cases as in :func:`similar_classes`; all rows of a kept id stay, and a row
    with a null id goes if it reaches an id or a row without one that comes before it.
    """
    mark = "_node" + "_" * max(map(len, docs.columns))  # clashes with no column
    rows = numbered(docs, mark).rows
    classes = _classes(rows.select(F.col(mark).alias("d"), "text"), words, percent, block)
    gone = classes.where("d <> root").select(F.col("d").alias(mark)).distinct()
    return rows.join(gone, mark, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
