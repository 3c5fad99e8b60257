"""Fill-in-the-middle, filter audit and contamination against plain Python."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from newscheck.llm import audit, fim, fmindex
from newscheck.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_fim(doc_id, text, rule=fim.Rule()):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = sha(f"{rule.seed}:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rule.turned:
        return len(units), "plain", None, None, text
    if h[3] % 100 < rule.suffix_first:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def lines(spark):
    pick = random.Random(3)
    rows = [(k, "".join(pick.choice(["a", "ü", "語", "\n", " ", "<", "P", ">", "😀"]) for _ in range(pick.randrange(60)))) for k in range(120)]
    rows += [(500, None), (501, ""), (502, "\n\n\n"), (None, "no\nid\n"), (503, "has <M> mark\nx"), (504, "<S"), (7, "again\n7")]
    rows += [(600 + k, "\n".join("x" * pick.randrange(9) for _ in range(400)) + "é" * 300) for k in range(6)]
    return rows, spark.createDataFrame([(*r, "kept", 5) for r in rows], "doc_id long, text string, extra string, n int")


@pytest.mark.parametrize("frame", [5, 64, fim.FRAME])
def test_fim_equals_plain(lines, frame):
    rows, docs = lines
    turned = fim.turn(fim.store(docs, frame=frame))
    got = collections.Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.text, r.restored, r.extra) for r in fim.texts(turned).collect())
    want = collections.Counter((i, *(p := plain_fim(i, t))[:4], p[4], t or "", "kept") for i, t in rows)
    assert got == want
    made = collections.Counter((r.doc_id, r.output_sha256, r.restored_sha256) for r in fim.digests(turned).collect())
    assert made == collections.Counter((i, sha(plain_fim(i, t)[4]), sha(t or "")) for i, t in rows)


def test_fim_store_can_be_written_and_read(lines, tmp_path, spark):
    rows, docs = lines
    fim.store(docs, frame=64).write.parquet(str(tmp_path / "frames"))
    stored = spark.read.parquet(str(tmp_path / "frames"))
    for r in stored.select("doc_id", "frames").collect():
        units = [f["units"] for f in r.frames]
        assert units == sorted(units)
        for f in r.frames:  # each can be read alone
            zstandard.ZstdDecompressor().decompress(f["data"]).decode()
    rule = fim.Rule(seed=8, turned=50, suffix_first=0)
    got = {(r.doc_id, r.n, r.form, r.text) for r in fim.texts(fim.turn(stored, rule), rule).collect()}
    assert got == {(i, *(p := plain_fim(i, t, rule))[:2], p[4]) for i, t in rows}


def test_fim_opens_only_cut_frames():
    text = ("line\n" * 4000).encode()
    frames = fim._frames(np.frombuffer(text, np.uint8), 1000, zstandard.ZstdCompressor().compress)
    opened = []

    def unpack(data):
        opened.append(data)
        return zstandard.ZstdDecompressor().decompress(data)

    marks = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
    out, a, m = fim._arrange(frames, 1234, 3001, "psm", marks, zstandard.ZstdCompressor().compress, unpack)
    assert len(opened) == 2 and (a, m) == (5 * 1234, 5 * (3001 - 1234))
    whole = zstandard.ZstdDecompressor().stream_reader(b"".join(out), read_across_frames=True).read()  # one stream
    assert whole == b"<P>" + text[: 5 * 1234] + b"<S>" + text[5 * 3001 :] + b"<M>" + text[5 * 1234 : 5 * 3001]


def test_fim_empty_table(spark):
    assert fim.digests(fim.turn(fim.store(spark.createDataFrame([], "doc_id long, text string")))).collect() == []


def plain_audit(docs, labels):
    letters = "ABCDE"
    quality, toxic = ({i for i, *r in labels if i is not None and r[k] == 1} for k in (0, 1))
    rows = []
    for i, text, lang in docs:
        text = text or ""
        words = WORD.findall(text)
        fails = "".join(
            x
            for x, yes in zip(
                letters,
                (
                    len(words) < 200,
                    100 * len(set(words)) < 50 * len(words),
                    100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
                    re.search(r"[#$%&*|]", text) is not None,
                    i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs),
                ),
            )
            if yes
        )
        rows.append((lang or "", fails, i in quality, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = collections.Counter()
        for order in map("".join, itertools.permutations(letters)):
            for step, here in enumerate(order, 1):
                before = set(order[: step - 1])
                gone = [bool(before & set(r[1])) for r in mine]
                removed = [r for r, g in zip(mine, gone) if here in r[1] and not g]
                shapley[here] += len(removed)
                out[part, order, step] = [
                    sum(here not in r[1] and not g for r, g in zip(mine, gone)),
                    len(removed),
                    sum(here in r[1] and g for r, g in zip(mine, gone)),
                    sum(r[1] == here for r in mine),
                    sum(r[2] for r in removed),
                    sum(r[3] for r in removed),
                ]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit_equals_plain(spark):
    pick = random.Random(5)
    long = " ".join(f"w{k}" for k in range(250))
    texts = [None, "", "short", "SHOUT", "a|b", long, long + " $", long.upper(), " ".join(["same"] * 300), "cost 5% " + long]
    docs = [(pick.choice([None, *range(40)]), pick.choice(texts), pick.choice(["en", "de", None, ""])) for _ in range(150)]
    docs += [(100 + k, long, "en") for k in range(60)]  # a text of many copies
    labels = [(k, pick.choice([0, 1, None]), pick.choice([0, 1, None])) for k in range(0, 130, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, lang string, bits string, n int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in audit.interactions(frame, marks).collect()}
    assert got == plain_audit(docs, labels)


def test_audit_without_list_of_repeated_hashes(spark, monkeypatch):
    """The way beyond the broadcast bound gives the same rows, and so do salts."""
    docs = [(k % 50, f"text {k % 7}", "en") for k in range(120)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    want = plain_audit(docs, [])
    for name, value in (("SENT", 0), ("SHARE", 40)):
        monkeypatch.setattr(audit, name, value)
        got = {tuple(r)[:3]: tuple(r)[3:] for r in audit.interactions(frame, none).collect()}
        assert got == want


def test_audit_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert audit.interactions(frame, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


def plain_hits(docs, benchmark, window=10):
    lower = lambda s: re.sub("[A-Z]", lambda m: m.group().lower(), s or "")
    wanted = collections.defaultdict(set)
    for item, text in benchmark:
        words = BENCH_WORD.findall(lower(text))
        size = min(window, len(words))
        for k in range(len(words) - size + 1 if size else 0):
            wanted[tuple(words[k : k + size])].add(item)
    sizes = {len(w) for w in wanted}
    out = []
    for i, text in docs:
        words, hit, items = BENCH_WORD.findall(lower(text)), set(), set()
        for size in sizes:
            for k in range(len(words) - size + 1):
                if (found := wanted.get(tuple(words[k : k + size]))) is not None:
                    hit |= set(range(k, k + size))
                    items |= found
        spans = [k for k in sorted(hit) if k - 1 not in hit], [k + 1 for k in sorted(hit) if k + 1 not in hit]
        out.append((i, len(words), tuple(zip(*spans)), tuple(sorted(str(x) for x in items if x is not None))))
    return collections.Counter(out)


def found_rows(df):
    return collections.Counter((r.doc_id, r.n_words, tuple((s["first"], s["last"]) for s in r.spans), tuple(r["items"])) for r in df.collect())


@pytest.fixture(scope="module")
def leaks(spark):
    pick = random.Random(11)
    some = lambda n: " ".join(pick.choice("ab c1 d É ü x-y".split()) for _ in range(n))
    docs = [(k, some(pick.randrange(80))) for k in range(80)]
    docs += [(7, docs[3][1]), (None, "one two three four five six seven eight nine ten, ELEVEN!"), (90, None), (91, ""), (92, "?!"), (93, some(4000))]
    docs += [(94, "b" * 700 + " " + some(30)), (95, docs[93 - 8][1] if len(docs) > 85 else "")]
    items = [(1, "One two; three four five six seven eight nine ten eleven"), (2, "c1 d"), (2, "c1 d"), (3, None), (4, ""), (None, "x y ab"), (5, some(14)), (6, some(11)), (6, some(10))]
    items += [(10, "d " * 12), (11, "É")]
    frames = spark.createDataFrame([(*r, "e", "clash") for r in docs], "doc_id long, text string, extra string, spans string")
    return docs, items, frames, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("window,shard,block", [(10, 1 << 21, 1 << 22), (4, 1 << 21, 1 << 22), (4, 500, 1 << 22), (3, 64, 30)])
def test_marks_equal_plain(leaks, window, shard, block):
    docs, items, frame, benchmark = leaks
    got = fmindex.mark(frame, benchmark, window, shard, block)
    assert "extra" in got.columns
    assert found_rows(got) == plain_hits(docs, items, window)


def test_removed_spans(leaks, spark):
    docs = spark.createDataFrame([(1, "Keep this. One, two three four five six seven eight nine TEN! and that"), (2, None), (3, "clean")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    done = {r.doc_id: r.text for r in fmindex.remove(fmindex.mark(docs, benchmark)).collect()}
    assert done == {1: "Keep this. ! and that", 2: None, 3: "clean"}


def test_contamination_of_empty_tables(leaks, spark):
    docs, _, frame, benchmark = leaks
    none = benchmark.limit(0)
    assert found_rows(fmindex.mark(frame, none)) == plain_hits(docs, [])
    assert fmindex.mark(frame.limit(0), benchmark).collect() == []


def test_fm_index_against_search():
    pick = np.random.default_rng(2)
    texts = [pick.integers(0, 4, n) for n in (0, 1, 50, 200, 200, 0, 33)]
    texts[4] = texts[3]
    first = np.cumsum([0, *map(len, texts)])
    index = fmindex.FMIndex(np.concatenate(texts), 4, first)
    symbols = np.concatenate([np.append(t + 7, k) for k, t in enumerate(texts)])
    order = fmindex.suffix_array(symbols)
    assert [tuple(symbols[k:]) for k in order] == sorted(tuple(symbols[k:]) for k in range(len(symbols)))
    for size in (1, 2, 5):
        windows = np.full((40, 6), -1)
        windows[:, 6 - size :] = pick.integers(0, 4, (40, size))
        found, low, high = index.search(windows, np.full(40, size))
        got = {int(w): sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(found, low, high)}
        for k, w in enumerate(windows[:, 6 - size :]):
            want = [int(index.starts[t] + i) for t, x in enumerate(texts) for i in range(len(x) - size + 1) if (x[i : i + size] == w).all()]
            assert got.get(k, []) == want


def test_queries_equal_plain(spark, sf_dir):
    """The registered queries over whole tables."""
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    docs = [tuple(r) for r in table("documents").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in QUERIES["op11_fim"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for i, text in docs:
        n, form, prefix, middle, out = plain_fim(i, text)
        r = got[i]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, prefix, middle, sha(out), sha(text or ""))
    items = [tuple(r) for r in table("benchmark").select("item_id", "text").collect()]
    want = {
        (i, n, sum(b - a for a, b in spans), len(names), sha(",".join(names)), bool(spans)) for i, n, spans, names in plain_hits(docs, items)
    }
    found = QUERIES["op13_contamination"](spark, sf_dir)
    assert {(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.collect()} == want
    assert sum(r[-1] for r in want) > 0


def test_phrases_share_items():
    made = fmindex.phrases(["a", "b", "a"], ["x y z", "X, Y Z!", None], 2)
    assert len(made.windows) == 2 and made.items.tolist() == [0, 1, 0, 1]
    assert pa.types.is_large_binary(made.words.type)
