"""Registered queries over whole small tables against plain Python."""

import collections
import hashlib
import re
import zlib
from bisect import bisect_left

import pytest
from pyspark.sql import functions as F

from newscheck.llm import ring
from newscheck.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def _shards(places, nodes, n_shards):
    """Rows by arc and shard: one row after the other goes to its node's shard, or the next with room."""
    arcs = [bisect_left([p for p, _ in nodes], place) % len(nodes) for place in places]
    room = [len(arcs) // n_shards + (s < len(arcs) % n_shards) for s in range(n_shards)]
    out, waiting = collections.Counter(), []
    for arc in sorted(arcs):
        shard = nodes[arc][1]
        if room[shard]:
            room[shard] -= 1
            out[arc, shard] += 1
        else:
            waiting.append(arc)
    for arc in waiting:
        step = arc
        while not room[nodes[step % len(nodes)][1]]:
            step += 1
        shard = nodes[step % len(nodes)][1]
        room[shard] -= 1
        out[arc, shard] += 1
    return out


@pytest.mark.parametrize("run", [7, ring.RUN])
def test_ring_against_plain_ring(spark, run):
    rows = [(k, "same" if k % 3 else f"text {k}") for k in range(400)] + [(1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    place = {r.doc_id: r.p for r in docs.select("doc_id", ring._position(F.coalesce("text", F.lit(""))).alias("p")).collect()}
    nodes = ring.ring(spark, 5, 8)
    ends = [p for p, _ in nodes]
    got = collections.Counter()
    for r in ring.assign(docs, 5, 8, run).collect():
        got[bisect_left(ends, place[r.doc_id]) % len(nodes), r.shard] += 1
    assert got == _shards([place[i] for i, _ in rows], nodes, 5)


def test_op5(spark, sf_dir, texts):
    got = QUERIES["op5_sharding"](spark, sf_dir).collect()
    raw = {i: (t or "").encode() for i, t in texts.items()}
    assert {(r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in got} == {(i, len(b) + 1, zlib.crc32(b), "rows", None) for i, b in raw.items()}
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    sizes = [len(slots[s]) for s in range(16)]
    assert len(got) == len(texts) and max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op9(spark, sf_dir, texts):
    first = {}
    words = {i: WORD.findall(t or "") for i, t in texts.items()}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    want = set()
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.add((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert {tuple(r) for r in QUERIES["op9_substrings"](spark, sf_dir).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()} == want


def test_op6_base(spark, sf_dir, texts):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    want = set()
    for i, t in texts.items():
        w = word.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        places = [(k, label) for p, label in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        at = [k for k, _ in places]
        want.add((i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))))
    found = QUERIES["op6_licenses"](spark, sf_dir).collect()
    assert {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found} == want
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in found)


def test_op1_split(spark, sf_dir, texts):
    got = QUERIES["op1_language"](spark, sf_dir).collect()
    assert {(r.doc_id, r.held_out) for r in got} == {(i, zlib.crc32(str(i).encode()) % 3 == 1) for i in texts}
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id] or "")) for r in got)
