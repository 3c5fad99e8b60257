import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from newscheck.functions import dates, labels, text
from newscheck.operators import segment
from newscheck.sources.stores import read_crawl_store, read_word_list, write_crawl_store

CASES = [
    "see http://a.b/c?d now",
    "midhttps://x.y word",
    "go www.site.org/path end",
    "a-b c_d",
    "tiếng_việt có dấu",
    "1/2 ½ ‿ x",
    "no break\tand\nlines  ",
    "",
    "?!...",
    "plain",
]


def _column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("t"))).collect()]


def test_clean_text(spark):
    assert _column(spark, CASES, text.clean_text) == [
        "see now",
        "mid word",
        "go end",
        "ab c_d",
        "tiếng_việt có dấu",
        "12 ½ x",
        "no break and lines",
        "",
        "",
        "plain",
    ]
    assert _column(spark, [None], text.clean_text) == [None]


def test_words(spark):
    assert _column(spark, CASES, text.whitespace_words) == [c.split() for c in CASES]
    expected = [re.findall(r"(?u)\b\w\w+\b", c.lower()) for c in CASES if "‿" not in c]
    assert _column(spark, [c for c in CASES if "‿" not in c], text.lower_words) == expected
    assert _column(spark, ["a  b", "", None], text.word_count) == [2, 0, 0]


def test_ngrams(spark):
    grams = lambda c: text.ngrams(text.whitespace_words(c), 1, 3)
    assert _column(spark, ["a b c", "a", ""], grams) == [
        ["a", "b", "c", "a b", "b c", "a b c"],
        ["a"],
        [],
    ]
    with pytest.raises(ValueError):
        text.ngrams(F.col("x"), 2, 1)


def test_dates(spark):
    given = ["Thứ ba, 7/1/2025, 08:05 (GMT+7)", "2025-1-7 8:05:09", "none", "31/02/2025, 10:00", None]
    assert _column(spark, given, dates.published_at) == [
        dt.datetime(2025, 1, 7, 8, 5),
        dt.datetime(2025, 1, 7, 8, 5, 9),
        None,
        None,
        None,
    ]
    assert _column(spark, ["2025-01-07", "x"], dates.tolerant_time) == [dt.datetime(2025, 1, 7), None]


def test_risk_bands(spark):
    band = lambda c: labels.risk_band(c.cast("double"))
    given = ["0.2999", "0.3", "0.6999", "0.7"]
    assert _column(spark, given, band) == ["low", "medium", "medium", "high"]
    assert _column(spark, ["1", "0", "-1", "7"], lambda c: labels.label_name(c.cast("int"))) == [
        "Fake News",
        "Real News",
        "Unlabeled",
        "Label 7",
    ]


def test_stopwords(spark):
    texts = [(1, "the cat The the dog cat"), (2, "the"), (3, None), (4, "dog bird"), (4, "a the b"), (None, "the x"), (5, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    expected = [(None, "x"), (1, "cat The cat"), (2, ""), (3, None), (4, "a b"), (4, "bird"), (5, "")]
    order = lambda r: (r[0] or 0, r[1] or "")
    for more in (0, 30_000):
        listed = spark.range(more).selectExpr("concat('w', id) AS term").union(spark.createDataFrame([("the",), ("dog",), ("the",), (None,)], "term string"))
        assert sorted(map(tuple, segment.remove_stopwords(docs, listed).collect()), key=order) == expected
    nothing = segment.remove_stopwords(docs, listed.limit(0))
    assert sorted(map(tuple, nothing.collect()), key=order) == sorted(texts, key=order)


def _greedy(words, lexicon):
    out, at = [], 0
    while at < len(words):
        size = next((n for n in (4, 3, 2) if "_".join(words[at : at + n]) in lexicon
                     and at + n <= len(words)), 1)
        out.append("_".join(words[at : at + size]))
        at += size
    return " ".join(out)


def test_segmentation(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").limit(60)
    texts = [(i, r.text) for i, r in enumerate(rows.collect())] + [(1000, "a b c d e"), (1001, "x")]
    lexicon = {"a_b", "a_b_c_d", "d_e", "de_la"} | {
        "_".join(t.split()[i : i + n]) for _, t in texts[::3] for n in (2, 3) for i in range(0, 20, 4)
    }
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = segment.segment_words(docs, spark.createDataFrame([(x,) for x in lexicon], "term string"))
    assert {r.doc_id: r.text for r in found.collect()} == {
        i: _greedy(t.split(), lexicon) for i, t in texts
    }


@pytest.mark.parametrize("part_bytes", [1 << 24, 60])
def test_segmentation_by_row(spark, part_bytes):
    """Missing texts, repeated and missing ids; one trie or several, one after the other."""
    lexicon = ["x_a", "b_z", "a_b_c", "c_d", "a_b", "q_r_s_t", "q_r_s_t_u", "m_n_o", "alone", "p__q"]
    rows = [(1, "a b c d"), (1, "x a b y"), (None, "a b z"), (None, None), (2, None), (3, ""), (4, "q r s t u"), (5, "m_n o p _q"), (1, "a b c d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = segment.segment_words(docs, spark.createDataFrame([(x,) for x in lexicon], "term string"), part_bytes)
    want = [(i, t if t is None else _greedy(t.split(), set(lexicon))) for i, t in rows]
    assert want[0] == (1, "a_b_c d") and want[1] == (1, "x_a b y")
    order = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(map(tuple, found.collect()), key=order) == sorted(want, key=order)
    plain = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plain


def test_large_lexicon_is_one_pass(spark, monkeypatch):
    """Documents are written as often whatever the size of the lexicon."""
    written, write = [], segment.materialize
    monkeypatch.setattr(segment, "materialize", lambda df, name: written.append(name) or write(df, name))
    monkeypatch.setattr(segment, "CHUNK_ROWS", 2)
    lexicon = [f"a{i}_b{i}" for i in range(60)] + ["b1_a2"]
    texts = [(i, f"a{i} b{i} a{i + 1} b{i}") for i in range(1, 9)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = segment.segment_words(docs, spark.createDataFrame([(x,) for x in lexicon], "term string"), 30)
    assert sorted(map(tuple, found.collect())) == [(i, _greedy(t.split(), set(lexicon))) for i, t in texts]
    assert len(written) <= 3


def test_normalisation_with_lexicon(spark):
    """Clean, segment, drop stopwords, in that order."""
    rows = [(1, "Good, morning!  to all http://x.y"), (1, None), (None, "to-all good morning"), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = lambda *t: spark.createDataFrame([(x,) for x in t], "term string")
    found = segment.normalize(docs, stopwords=one("all", "good_morning"), lexicon=one("Good_morning", "good_morning", "to_all"))
    order = lambda r: (str(r[0]), str(r[1]))
    assert sorted(map(tuple, found.collect()), key=order) == sorted([(1, "Good_morning to_all"), (1, None), (None, "toall"), (2, "")], key=order)


def test_csv_store(spark, tmp_path):
    path = str(tmp_path / "store")
    assert read_crawl_store(spark, path).count() == 0
    row = (' "t", x', "u", "s", None, 'line\nwith "q", \\ and  ', None, dt.datetime(2025, 1, 1, 2), True, "n")
    stored = spark.createDataFrame([row], read_crawl_store(spark, path).schema)
    write_crawl_store(stored, path)
    assert [tuple(r) for r in read_crawl_store(spark, path).collect()] == [row]


def test_word_list(spark, tmp_path):
    path = tmp_path / "words.txt"
    path.write_text("và\n của \n\nvà\n")
    assert sorted(r.term for r in read_word_list(spark, str(path)).collect()) == ["của", "và"]
