"""Very long words and texts of many hits: same results, time in proportion."""

import random
import time

import pytest

from newscheck.llm import bpe, pii
from newscheck.llm.queries import default_tokenizer


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.tokenizer_bytes(default_tokenizer()))


def test_long_words_equal_the_library(codec):
    pick = random.Random(3)
    words = ["".join(pick.choice("etaoinshr") for _ in range(3000)), "a" * 5000, "-=" * 900, "0123456789" * 300, "ab" * 77 + "c" * 300]
    words += ["".join(chr(pick.randrange(0x4E00, 0x9FFF)) for _ in range(2000)), "".join(pick.choice("éüßñ😀語") for _ in range(900))]
    for word in words:
        assert codec._one(word.encode()) == codec.library.encode(word, add_special_tokens=False).ids


def test_time_of_long_words(codec):
    pick = random.Random(4)
    word = "".join(chr(pick.randrange(0x4E00, 0x5400)) for _ in range(60_000)).encode()
    start = time.perf_counter()
    codec._one(word)
    assert time.perf_counter() - start < 10


def test_texts_without_blanks(spark):
    pick = random.Random(5)
    texts = [(k, "".join(chr(pick.randrange(0x4E00, 0x9FFF)) for _ in range(400 + k))) for k in range(20)] + [(99, "x" * 30_000 + " and then")]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    codec = bpe.Codec(bpe.tokenizer_bytes(default_tokenizer()))
    got = {r.doc_id: r.n_tokens for r in bpe.encoded_digests(frame, default_tokenizer()).collect()}
    assert got == {i: len(codec.library.encode(t, add_special_tokens=False).ids) for i, t in texts}


def _log(n):
    return " ".join(f"host 10.0.{k % 256}.{k // 256} mail a{k}@b.org +49 170 {1000000 + k} password=abc{k:06d} -" for k in range(n))


def test_many_hits_take_time_in_proportion(spark):
    """Spans of a text that is one long log, and its redaction."""
    seconds = []
    for n in (500, 5000):
        text = _log(n)
        frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
        start = time.perf_counter()
        (row,) = pii.find(frame).collect()
        (clean,) = pii.redact(frame).collect()
        seconds.append(time.perf_counter() - start)
        assert len(row.pii) == 4 * n
        for s in row.pii:
            part = text[s.start : s.end]
            assert part.startswith({"ip": "10.0.", "email": "a", "phone": "+49", "secret": "password="}[s.kind])
        assert clean.text.count("[IP]") == clean.text.count("[SECRET]") == n and "abc0" not in clean.text and "@" not in clean.text
    assert seconds[1] < 40 * seconds[0] and seconds[1] < 60


def test_parts_of_texts(spark):
    text = "".join(chr(0x1F600 + k % 50) if k % 7 == 0 else chr(97 + k % 26) for k in range(1000)) + "\n\r"
    spans = [(0, 0), (0, 5), (250, 256), (250, 257), (256, 512), (255, 1001), (999, 1100), (0, 1002)]
    frame = spark.createDataFrame([(text, a, b) for a, b in spans], "text string, a long, b long")
    from pyspark.sql import functions as F

    got = frame.select("a", "b", pii._let(pii._pieces(F.col("text")), lambda p: pii._part(p, F.col("a"), F.col("b"))).alias("part")).collect()
    assert {(r.a, r.b): r.part for r in got} == {(a, b): text[a:b] for a, b in spans}
