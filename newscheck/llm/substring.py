"""Repeated passages across documents by suffix automata of reference shards."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newscheck.llm import arrays as A
from newscheck.llm.nodes import numbered
from newscheck.session import discard, materialize

# Words of a window, and of the shingles that anchor it.
WINDOW = 13
ANCHOR = 6
# Reference passages of one anchor beyond which its windows are dealt apart.
HOT = 20_000


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of jobs that are over."""
    gc.collect()
    spark._jvm.System.gc()


def _anchors(data: np.ndarray, offsets: np.ndarray, window: int, anchor: int):
    """Runs of windows with the same anchor: text number, key, first and last window; and the words.

    A window's anchor is its shingle of the smallest hash, the leftmost of equal ones:
    equal windows have equal anchors at equal places, whatever stands around them.
    Window and word numbers count through the whole piece.
    """
    starts, ends, first = A.words(data, offsets)
    n = np.diff(first)
    windows = A.ragged(first[:-1], np.maximum(n - window + 1, 0))
    if not len(windows):
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none, starts, ends, first
    h = A.span_hashes(data, starts, ends)
    g = np.zeros(len(h) - anchor + 1, np.uint64)
    for j in range(anchor):
        g += h[j : j + len(g)] * np.uint64(pow(0x9FB21C651E98DF25, j + 1, 1 << 64))
    g = A.mix(g)
    least, place = g[windows], windows.copy()
    for j in range(1, window - anchor + 1):
        at = windows + j
        lower = g[at] < least
        least[lower], place[lower] = g[at[lower]], at[lower]
    text = np.searchsorted(first, windows, "right") - 1
    new = np.ones(len(windows), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    run = np.flatnonzero(new)
    last = np.append(run[1:], len(windows)) - 1
    return text[run], least[run], windows[run], windows[last], starts, ends, first


def _keys(window: int, anchor: int):
    """Batches of ``d, text`` to the distinct anchor keys of their texts.

    Keys that several documents of a batch have are settled here: one row goes on to meet
    other batches (``route`` is the key), the others keep to themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("d").to_numpy()
            keys, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for first, _, data, offsets in A.pieces(*A.text_buffer(batch.column("text"))):
                text, key, *_ = _anchors(data, offsets, window, anchor)
                keys.append(key)
                docs.append(ids[first + text])
            key, d = np.concatenate(keys), np.concatenate(docs)
            order = np.lexsort((d, key))
            key, d = key[order], d[order]
            again = np.zeros(len(key), bool)
            again[1:] = (key[1:] == key[:-1]) & (d[1:] == d[:-1])
            key, d = key[~again], d[~again]
            head = np.ones(len(key), bool)
            head[1:] = key[1:] != key[:-1]
            group = np.cumsum(head) - 1
            many = np.bincount(group)[group] > 1 if len(key) else head
            route = np.where(head, key, A.mix(key ^ A.mix(d.astype(np.uint64))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(route.view(np.int64)), pa.array(key.view(np.int64)), pa.array(d), pa.array(many)],
                ["route", "key", "d", "many"],
            )

    return run


def _passages(window: int, anchor: int):
    """Batches of ``d, t, text, keys`` to the passages around shared anchors.

    A passage is the words of a run of windows. Those equal in a batch are one row with
    all the places where they stand.
    """
    place = pa.struct([("d", pa.int64()), ("t", pa.int64()), ("start", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column("d").to_numpy(), batch.column("t").to_numpy()
            shared = batch.column("keys")
            found: dict[tuple[int, bytes], list[tuple[int, int, int]]] = {}
            for low, high, data, offsets in A.pieces(*A.text_buffer(batch.column("text"))):
                text, key, begin, end, starts, ends, first = _anchors(data, offsets, window, anchor)
                part = shared.slice(low, high - low)
                own = part.flatten().to_numpy().view(np.uint64)
                row = np.repeat(np.arange(high - low), np.diff(part.offsets.to_numpy()))
                # a key counts in the texts it is listed for
                tag = np.sort(A.mix(own ^ A.mix(row.astype(np.uint64))))
                mine = A.mix(key ^ A.mix(text.astype(np.uint64)))
                at = np.minimum(np.searchsorted(tag, mine), max(len(tag) - 1, 0))
                hit = np.flatnonzero(tag[at] == mine) if len(tag) else np.zeros(0, np.int64)
                raw = data.tobytes()
                for k in hit:
                    words = b" ".join(raw[starts[begin[k]] : ends[end[k] + window - 1]].split())
                    i = low + int(text[k])
                    spot = (int(ids[i]), int(hashes[i]), int(begin[k] - first[text[k]]))
                    found.setdefault((int(key[k]), words), []).append(spot)
            rows = list(found.items())
            spots = [sorted(s) for _, s in rows]
            flat = [x for s in spots for x in s]
            sizes = np.cumsum([0, *map(len, spots)])
            columns = [pa.array([x[c] for x in flat], place.field(c).type) for c in range(3)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.array([k for (k, _), _ in rows], np.uint64).view(np.int64)),
                    pa.array([w.decode() for (_, w), _ in rows], pa.string()),
                    pa.array([s[0][0] for s in spots], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(place))),
                ],
                ["key", "passage", "earliest", "places"],
            )

    return run


class Automaton:
    """Suffix automaton of word sequences, added in order of document; states know their first document."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size, self.first = [-1], [0], [-1]

    def _state(self, size: int, link: int, first: int, following: dict[str, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.size.append(size)
        self.first.append(first)
        return len(self.size) - 1

    def _split(self, p: int, word: str, q: int) -> int:
        """The state for the words of ``p`` and ``word``, cut off from the longer ones of ``q``."""
        copy = self._state(self.size[p] + 1, self.link[q], self.first[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, words: list[str], doc: int) -> None:
        last = 0
        for word in words:
            if (q := self.next[last].get(word)) is not None:
                last = q if self.size[q] == self.size[last] + 1 else self._split(last, word, q)
                continue
            new, p = self._state(self.size[last] + 1, 0, doc, {}), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, word, q)
            last = new

    def firsts(self, words: list[str], window: int) -> list[int | None]:
        """First document of each window, from the matching statistics at its last word."""
        out: list[int | None] = []
        state = matched = 0
        for n, word in enumerate(words, 1):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.size[state]
            if word in self.next[state]:
                state = self.next[state][word]
                matched += 1
            if n >= window:
                if matched < window:
                    out.append(None)
                    continue
                while self.size[self.link[state]] >= window:  # the state of the window itself
                    state = self.link[state]
                    matched = self.size[state]
                out.append(self.first[state])
        return out


def _matches(window: int):
    """Passages of a shard, by route and then document: to the places of windows seen in an earlier one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        route, automaton, known = None, Automaton(), {}
        for batch in batches:
            d, t, starts = [], [], []
            for at, passage, places in zip(*(batch.column(c).to_pylist() for c in ("route", "passage", "places"))):
                if at != route:
                    route, automaton, known = at, Automaton(), {}
                earliest = places[0]["d"]
                if passage not in known:
                    words = passage.split(" ")
                    firsts = automaton.firsts(words, window)
                    if None in firsts:
                        automaton.add(words, earliest)
                    known[passage] = [earliest if f is None else f for f in firsts]
                firsts = known[passage]
                for p in places:
                    gone = [p["start"] + i for i, f in enumerate(firsts) if f < p["d"]]
                    if gone:
                        d.append(p["d"])
                        t.append(p["t"])
                        starts.append(gone)
            yield pa.RecordBatch.from_arrays(
                [pa.array(d, pa.int64()), pa.array(t, pa.int64()), pa.array(starts, pa.list_(pa.int32()))], ["d", "t", "starts"]
            )

    return run


def repeated_windows(rows: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """``d, t, starts``: windows of ``rows`` (``d, text``) whose words also start in a smaller ``d``.

    ``d`` is the number of a document, ``t`` the hash of the text, ``starts``
    the first words of such windows. Documents without any are not listed.

    1. Each text gives the keys of its anchors; a shuffle by key finds those that several
       documents have. 2. The passages around shared anchors are cut out of the texts.
    3. Passages are dealt into shards by key; in a shard the automaton of the passages
       so far is the reference, and each next one is streamed through it, in order of
       document. An anchor with many passages is dealt by its single windows instead.
    """
    if not 0 < anchor < window:
        raise ValueError("an anchor is shorter than a window")
    spark = rows.sparkSession
    rows = rows.where("text is not null")
    keys = rows.mapInArrow(A.tidy(_keys(window, anchor), "powers"), "route long, key long, d long, many boolean")
    over = Window.partitionBy("route")
    shared = (
        keys.withColumns({"low": F.min("d").over(over), "high": F.max("d").over(over), "any": F.max("many").over(over)})
        .where("many or any or low < high")
        .groupBy("d")
        .agg(F.collect_set("key").alias("keys"))  # bounded by the document
    )
    shared = materialize(shared, "shared-anchors")
    release(spark)
    marked = rows.withColumn("t", F.xxhash64("text")).join(shared, "d").select("d", "t", "text", "keys")
    schema = "key long, passage string, earliest long, places array<struct<d:long,t:long,start:int>>"
    passages = materialize(marked.mapInArrow(A.tidy(_passages(window, anchor), "powers"), schema), "passages")
    release(spark)
    # written, so that Spark knows its size and moves the passages only if it must
    crowded = passages.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= hot).select("key", F.lit(True).alias("crowded"))
    crowded = materialize(crowded, "crowded")
    dealt = passages.join(crowded, "key", "left")
    words = F.split("passage", " ")
    single = F.transform(
        F.sequence(F.lit(0), F.size(words) - window),
        lambda i: F.struct(F.array_join(F.slice(words, i + 1, window), " ").alias("passage"), i.alias("shift")),
    )
    whole = F.array(F.struct(F.col("passage"), F.lit(0).alias("shift")))
    parts = dealt.select("key", "earliest", "places", "crowded", F.inline(F.when(F.col("crowded"), single).otherwise(whole)))
    moved = F.transform("places", lambda p: F.struct(p["d"].alias("d"), p["t"].alias("t"), (p["start"] + F.col("shift")).cast("int").alias("start")))
    found = (
        parts.select(
            F.when(F.col("crowded"), F.xxhash64("passage")).otherwise(F.col("key")).alias("route"), "passage", "earliest", moved.alias("places")
        )
        .repartition("route")
        .sortWithinPartitions("route", "earliest")
        .mapInArrow(A.tidy(_matches(window), "powers"), "d long, t long, starts array<int>")
    )
    gone = found.groupBy("d", "t").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))
    gone = materialize(gone, "repeats")
    discard(shared, passages, crowded)
    release(spark)
    return gone


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """All columns of ``docs`` with repeated passages cut out of ``text``, and ``n_words``, ``n_removed``.

    A word goes if a window of ``window`` words over it also starts in a document with a
    smaller ``doc_id``; windows are those of the given texts. Where words go, one line
    break or blank stays between the others; texts that lose nothing stay as they are.

    A null text has no words and stays null. Each row with a null ``doc_id`` is a document
    of its own, after all others and those without an id that come before it. Rows of one
    ``doc_id`` do not take from each other. Columns named like the
    two counts are replaced. An empty table gives no rows.
    """
    added = ["n_words", "n_removed"]
    kept = [c for c in docs.columns if c not in added]
    own = {c: f"_{c}" + "_" * max(map(len, docs.columns)) for c in ("d", "t", "starts")}  # clash with no column
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(c, T.LongType()) for c in added])
    rows = numbered(docs.select(*[F.col(f"`{c}`") for c in kept]), own["d"]).rows
    gone = repeated_windows(rows.select(F.col(own["d"]).alias("d"), "text"), window, anchor, hot)
    keyed = rows.withColumn(own["t"], F.xxhash64("text"))
    marks = gone.select(*[F.col(c).alias(name) for c, name in own.items()])
    joined = keyed.join(marks, [own["d"], own["t"]], "left").select(*[F.col(f"`{c}`") for c in kept], own["starts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, marks = batch.column("text"), batch.column(own["starts"])
            texts, counts, removed = column.to_pylist(), np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for low, high, data, offsets in A.pieces(*A.text_buffer(column)):
                starts, ends, first = A.words(data, offsets)
                counts[low:high] = np.diff(first)
                for i in range(low, high):
                    if not marks[i].is_valid or not len(marks[i]):
                        continue
                    a, n = first[i - low], counts[i]
                    edge = np.zeros(n + 1, np.int64)
                    at = np.array(marks[i].as_py())
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    removed[i] = n - stay.sum()
                    head = np.flatnonzero(stay & ~np.append(False, stay[:-1]))
                    tail = np.flatnonzero(stay & ~np.append(stay[1:], False))
                    raw = data[offsets[i - low] : offsets[i - low + 1]].tobytes()
                    shift = offsets[i - low]
                    parts = [raw[starts[a + x] - shift : ends[a + y] - shift] for x, y in zip(head, tail)]
                    texts[i] = (b"\n" if b"\n" in raw else b" ").join(parts).decode()
            columns = [pa.array(texts, column.type) if c == "text" else batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts), pa.array(removed)], [*kept, *added])

    return joined.mapInArrow(A.tidy(run, "powers"), schema)
