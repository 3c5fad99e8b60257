"""Small cases against brute force: nulls, empties, copies, ties, clashes, empty tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newscheck.llm import arrays, blocks, bpe, jaccard, language, licenses, mih, packing, pii, ring, segtopk, substring
from newscheck.llm.queries import default_tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_language_bits_equal_a_plain_model():
    """Code lengths against dictionaries of contexts with exclusion."""
    text, probe, order = b"abracadabra abrac", b"abrab xa", 3
    seen = collections.defaultdict(collections.Counter)
    for i, b in enumerate(text):
        history = (b"\0" * order + text)[i : i + order]
        for k in range(order + 1):
            seen[history[order - k :]][b] += 1

    def bits(history, b):
        total, out = 0.0, set()
        for k in range(order, -1, -1):
            table = seen.get(history[order - k :])
            if table is None:
                continue
            left = {x: c for x, c in table.items() if x not in out}
            n = sum(left.values()) + len(left)
            if b in left:
                return total + math.log2(n / left[b])
            if left:
                total += math.log2(n / len(left))
            out |= set(table)
        return total + math.log2(256 - len(out))

    want = sum(bits((b"\0" * order + probe)[i : i + order], b) for i, b in enumerate(probe))
    w = language._windows(np.frombuffer(text, np.uint8), np.array([0, len(text)]), order)
    grams, n = np.unique(w, return_counts=True)
    model = language.Model(["x"], [language._levels(grams, n, order)], order).ready()
    got = model.score(np.frombuffer(probe, np.uint8), np.array([0, len(probe)]))
    assert got[0, 0] == pytest.approx(want)


def test_language_cases(spark, documents):
    model = language.train(documents)
    found = {(r.doc_id, r.text): r for r in language.identify(documents, model).collect()}
    assert found[(3, None)].lang_pred == found[(4, "")].lang_pred == found[(7, "  \n ")].lang_pred == "und"
    assert {r.lang_pred for r in found.values()} <= {"en", "de", "und"} and all(0 <= r.score <= 1 for r in found.values())
    assert [r.lang_pred for k, r in found.items() if k[0] is None] == ["de"]
    empty = documents.limit(0)
    assert language.identify(empty, language.train(empty)).count() == 0
    assert {r.lang_pred for r in language.identify(documents, language.train(empty)).collect()} == {"und"}


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    found = language.identify(docs.where(held), language.train(docs.where(~held)))
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_bpe_equals_the_library():
    codec = bpe.Codec(bpe.tokenizer_bytes(default_tokenizer()))
    draw = random.Random(3)
    bits = ["'", "s", "re", "ll", " ", "  ", "\n", "é", "1", "-", "the", "ing", "t", "A", ".", "😀", "　", "\xa0", "<|endoftext|>"]
    texts = ["", " ", "x" * 200, "don't 'S we'll", "  a\n\n b ", *("".join(draw.choices(bits, k=draw.randint(1, 30))) for _ in range(1500))]
    ids, begin, back = codec.encode(*arrays.text_buffer(pa.array(texts)))
    for k, text in enumerate(texts):
        assert list(ids[begin[k] : begin[k + 1]]) == codec.library.encode(text, add_special_tokens=False).ids, text
    assert back.tobytes().decode() == "".join(texts)


def test_bpe_cases(documents):
    found = bpe.encode_decode(documents, default_tokenizer()).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in found) == sorted((r.doc_id or 0, r.text or "") for r in documents.collect())
    digests = {r.doc_id: r for r in bpe.encoded_digests(documents, default_tokenizer()).collect()}
    assert digests[3].n_tokens == digests[4].n_tokens == 0
    assert digests[3].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.encoded_digests(documents.limit(0), default_tokenizer()).count() == 0


def test_packing(documents):
    codec = bpe.codec(bpe.tokenizer_bytes(default_tokenizer()))
    found = packing.pack(documents, default_tokenizer(), capacity=256, keep_ids=True, group=8).collect()
    want = collections.Counter((r.doc_id, *codec.library.encode(r.text or "", add_special_tokens=False).ids, 1) for r in documents.collect())
    whole = collections.defaultdict(list)
    for r in found:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4")) and len(r.ids) == r.length
        whole[(r.doc_id, r.doc_tokens, r.start)].append(r)
    assert sum(r.length for r in found) == sum(len(k) - 1 for k in want.elements())
    places = collections.defaultdict(list)
    for r in found:
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(documents.limit(0), default_tokenizer()).count() == 0


def test_privacy_base_and_added(documents):
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.pii] for r in pii.find(documents).collect()}
    text = documents.where("doc_id = 9").first().text
    assert [(k, text[a:b]) for k, a, b in found[9]] == [
        ("email", "a.b@c.example.org"),
        ("ip", "10.0.0.255"),
        ("card", "4111 1111 1111 1111"),
        ("phone", "+1 (017) 555-5036"),
        ("iban", "DE89 3704 0044 0532 0130 00"),
    ]
    assert found[3] == found[4] == []
    clean = {r.doc_id: r.text for r in pii.redact(documents).collect()}
    assert clean[3] is None and "a.b@c" not in clean[9] and "4111" not in clean[9] and clean[10].startswith("Licensed")
    assert pii.redact(documents).columns == documents.columns and pii.redact(documents.limit(0)).count() == 0


def test_privacy_spans_equal_plain_patterns(spark):
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def good(kind, m):
        digits = re.sub(r"\D", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "phone":
            return 9 <= len(digits) <= 15
        luhn = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(digits))) % 10 == 0
        return kind == "email" or 13 <= len(digits) <= 19 and luhn

    draw = random.Random(5)
    bits = ["a", "b.c", "@", ".", "_", "x-1", "1", "22", "300", "4111111111111111", "-", " ", "+", "(", ")", "é", "😀", "0"]
    texts = ["".join(draw.choices(bits, k=draw.randint(1, 40))) for _ in range(1500)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.digest(pii.find(frame)).collect()}
    for k, text in enumerate(texts):
        spans = ",".join(f"{kind}:{m.start()}:{m.end()}" for kind, p in plain.items() for m in re.finditer(p, text) if good(kind, m.group()))
        assert got[k].base_sha256 == hashlib.sha256(spans.encode()).hexdigest(), text


def test_privacy_account_numbers(spark):
    """Text behind an account number does not hide it, nor does another candidate before or inside it."""
    spaced, joined, british = "DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"
    cases = [
        (f"IBAN {spaced} Please pay", [spaced]),
        (f"IBAN {joined} BIC COBADEFF", [joined]),
        (f"IBAN {joined} COBADEFFXXX", [joined]),
        (f"IBAN {spaced} 5000 EUR", [spaced]),
        (f"IBAN {joined}-12 A", [joined]),
        (f"IBAN {spaced} {british} {joined}", [spaced, british, joined]),
        (f"😀 IBAN AB12 {spaced}", [spaced]),
        (f"IBAN\n{joined}\nPAY", [joined]),
        (f"IBAN {joined}X and {joined}x and DE88 3704 0044 0532 0130 00 Please", []),
    ]
    frame = spark.createDataFrame([(k, text) for k, (text, _) in enumerate(cases)], "doc_id long, text string")
    found = {r.doc_id: [r.text[s.start : s.end] for s in r.pii if s.kind == "iban"] for r in pii.find(frame).collect()}
    assert [found[k] for k in range(len(cases))] == [want for _, want in cases]
    clean = {r.doc_id: r.text for r in pii.redact(frame).collect()}
    assert clean[0] == "IBAN [IBAN] Please pay" and clean[1] == "IBAN [IBAN] BIC COBADEFF"


def test_privacy_long_secrets(spark):
    """A secret goes as a whole, however long it is."""
    value = "eyJhbGciOi." * 27 + "_9-x=="
    texts = [f"token={value} and more", f'password: "{value}" and more', f"token={value * 300}"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.redact(frame).collect()}
    assert clean == {0: "[SECRET] and more", 1: '[SECRET]" and more', 2: "[SECRET]"}


def test_licenses(documents):
    found = {r.doc_id: r for r in licenses.detect(licenses.phrase_places(documents)).collect()}
    r = found[10]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (14, 3, 3, 10, ["apache", "gpl", "mit"])
    assert [d.label for d in r.licences] == ["apache-2.0", "mit", "gpl"]
    assert found[3].n_words == 0 and found[3].licences == [] and found[4].first_word is None
    assert len(licenses.rules()) > 200 and licenses.detect(documents.limit(0)).count() == 0


def test_licence_keywords(spark):
    """Every rule's match, written over several lines, passes the gates and the rule's keyword."""
    texts = []
    for rule in licenses.rules():
        words = rule.pattern.removeprefix(licenses._BEGIN + "(?i:").removesuffix(")" + licenses._END)
        words = re.sub(r"\(\?:([^()|]*)[^()]*\)\??", r"\1", words.replace(f"{licenses._GAP}*+", "").replace(f"{licenses._GAP}++", "\n"))
        text = words.replace("[sc]", "c").upper()
        assert re.search(rule.pattern, text), text
        bare = re.sub(r"\(\?:[^()]*\)\?", "", rule.pattern.replace(licenses._GAP, ""))
        assert re.fullmatch("[a-z0-9]+", rule.keyword) and rule.keyword in bare and rule.keyword in text.lower()
        assert any(g in text.lower() for g in licenses.GATES), text
        texts.append((len(texts), text, rule.label))
    found = licenses.detect(spark.createDataFrame(texts, "doc_id long, text string, label string")).collect()
    assert [r.text for r in found if r.label not in {d.label for d in r.licences}] == []


def test_licences_over_lines(spark):
    cases = {
        "SIL Open\nFont License": "ofl",
        "All\nrights reserved": "all-rights-reserved",
        "it is in the public\ndomain now": "public-domain",
        "This software is provided 'as-is', without any express or implied\nwarranty.": "zlib",
        "Berkeley Software Distribution License": "bsd",
        "PSF License": "psf",
    }
    frame = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    found = {r.text: [d.label for d in r.licences] for r in licenses.detect(frame).collect()}
    assert found == {text: [label] for text, label in cases.items()}


def test_ring(spark, documents):
    placed = ring.assign(documents, shards=3, run=2).collect()
    assert len(placed) == documents.count()
    by_shard = collections.defaultdict(list)
    for r in placed:
        by_shard[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1
    assert {r.size for r in placed if r.doc_id == 3} == {1} and {r.text_crc32 for r in placed if r.doc_id == 3} == {0}
    copies = spark.createDataFrame([(k, "same" if k % 3 else f"t{k}") for k in range(300)], "doc_id long, text string")
    sizes = collections.Counter(r.shard for r in ring.assign(copies, run=10).collect())
    assert max(sizes.values()) - min(sizes.values()) <= 1 and ring.assign(documents.limit(0)).count() == 0


def _vectors(spark, n=400, width=12):
    draw = np.random.default_rng(1)
    values = draw.normal(size=(n, width)).round(2)
    values[5] = values[7]
    bad = [(n, None), (n + 1, [0.0] * width), (n + 2, [1.0, None]), (n + 3, [float("nan")] * width), (n + 4, [float("inf")] * width)]
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(values)] + bad
    return values, spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_neighbours(spark):
    values, frame = _vectors(spark)
    got = collections.defaultdict(list)
    for r in sorted(mih.nearest(frame, F.col("vec_id") % 10 == 0, k=10).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append(r.vec_id)
        assert r.score == pytest.approx(np.linalg.norm(values[r.query_id] - values[r.vec_id]), rel=1e-12)
    hits = 0
    for q in range(0, 400, 10):
        d = np.linalg.norm(values - values[q], axis=1)
        d[q] = np.inf
        hits += len(set(np.argsort(d, kind="stable")[:10]) & set(got[q]))
    assert hits / 400 >= 0.9 and set(got) == set(range(0, 400, 10))
    assert mih.nearest(frame.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_exact_top_k(spark):
    values, frame = _vectors(spark)
    got = collections.defaultdict(list)
    for r in sorted(segtopk.top_k(frame, F.col("vec_id") % 10 == 0).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    whole = np.concatenate([np.floor(256 * values), np.zeros((2, values.shape[1]))]).astype(int)
    for q in range(0, 400, 10):
        score = whole @ whole[q]
        order = sorted((-s, i) for i, s in enumerate(score) if i != q and i != 400)[:5]
        assert got[q] == [(i, -s) for s, i in order]
    assert segtopk.top_k(frame.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def _classes(texts, words, percent):
    sets, parent = {}, {}
    for d, text in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets[d] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
        parent[d] = d

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {(d, len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize(("words", "percent", "block"), [(4, 85, 3000), (5, 80, 4), (1, 60, 5)])
def test_jaccard_join(spark, words, percent, block):
    draw = random.Random(words)
    texts = []
    for family in range(12):
        base = [draw.choice("abcdefghijklmnopqrstuvwxyz") * draw.randint(1, 3) for _ in range(draw.choice([3, 6, 9, 14, 30, 80]))]
        for _ in range(12):
            copy = list(base)
            for _ in range(draw.randint(0, 3)):
                copy[draw.randrange(len(copy))] = draw.choice(["x", "Y", "zz"])
            texts.append((len(texts), " ".join(copy)))
    texts += [(len(texts), None), (len(texts) + 1, ""), (len(texts) + 2, " \n")]
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    got = rows(jaccard.similar_classes(frame, words, percent, block))
    assert len(got) == len(texts) and set(got) == _classes(texts, words, percent)


def test_jaccard_cases(documents):
    got = {(r.doc_id, r.component_id) for r in jaccard.similar_classes(documents).collect()}
    assert {(1, 1), (5, 1), (3, 3), (4, 4), (7, 7), (2, 2)} <= got and (None, None) in got
    kept = jaccard.keep_one(documents)
    assert kept.columns == documents.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 6, 7, 8, 9, 10, None}
    assert jaccard.similar_classes(documents.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [20_000, 2])
def test_repeats(spark, hot):
    draw = random.Random(hot)
    passages = [[draw.choice(["aa", "b", "cc", "d"]) + str(draw.randint(0, 30)) for _ in range(25)] for _ in range(6)]
    texts = []
    for d in range(80):
        words = [draw.choice("abcdefg") + str(draw.randint(0, 99)) for _ in range(draw.randint(0, 30))]
        for _ in range(draw.randint(0, 2)):
            p = draw.choice(passages)
            a = draw.randint(0, 8)
            at = draw.randint(0, len(words))
            words[at:at] = p[a : a + draw.randint(10, 25)]
        texts.append((d, draw.choice([" ", "\n"]).join(words)))
    texts += [(100, texts[3][1]), (101, "a b " * 40), (102, "a b " * 40), (103, None)]
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in substring.remove_repeats(frame, hot=hot).collect()}
    seen: dict = {}
    for d, text in texts:
        w = WORD.findall(text or "")
        stay = [True] * len(w)
        for i in range(len(w) - 12):
            key = tuple(w[i : i + 13])
            if seen.setdefault(key, d) < d:
                stay[i : i + 13] = [False] * 13
        assert (got[d].n_words, got[d].n_removed) == (len(w), stay.count(False))
        assert WORD.findall(got[d].text or "") == [x for x, s in zip(w, stay) if s]
    assert got[103].text is None


def test_repeats_cases(documents):
    found = substring.remove_repeats(documents)
    assert found.columns == ["doc_id", "text", "lang", "d", "n_words", "n_removed"] and found.count() == documents.count()
    assert {r.n_removed for r in found.where("doc_id = 5").collect()} == {80}
    assert substring.remove_repeats(documents.limit(0)).count() == 0


def test_rows_without_an_id(spark):
    """Each row without an id is a document: copies go one by one, and others do not go or link with them."""
    draw = random.Random(8)
    a, b, c, e = (" ".join(f"{draw.choice('abcdefg')}{draw.randint(0, 999)}" for _ in range(40)) for _ in range(4))
    texts = [(1, a), (2, b), (3, "short one"), (None, a), (None, b), (None, c), (None, c), (None, e), (None, None), (None, None)]
    for top in (3, (1 << 63) - 1):
        ids = {1: 1, 2: 2, 3: top, None: None}
        frame = spark.createDataFrame([(ids[d], t) for d, t in texts], "doc_id long, text string").repartition(4)
        got = collections.Counter((r.doc_id, r.component_id) for r in jaccard.similar_classes(frame).collect())
        assert got == {(1, 1): 1, (2, 2): 1, (top, top): 1, (None, 1): 1, (None, 2): 1, (None, None): 5}
        kept = collections.Counter(rows(jaccard.keep_one(frame)))
        assert kept == {(1, a): 1, (2, b): 1, (top, "short one"): 1, (None, c): 1, (None, e): 1, (None, None): 2}
        left = collections.Counter((r.doc_id, r.text) for r in substring.remove_repeats(frame).collect())
        assert left == {(1, a): 1, (2, b): 1, (top, "short one"): 1, (None, ""): 3, (None, c): 1, (None, e): 1, (None, None): 2}


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    packed = corpus_pipeline.run(spark, sf_dir)
    assert packed.select("doc_id").distinct().count() > 0.7 * len(ids)
    assert packed.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf_dir).columns == docs.columns
