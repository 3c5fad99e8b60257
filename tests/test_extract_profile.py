import numpy as np
import pytest

from newscheck.operators import extract, profile, words
from newscheck.operators.extract import Selector, SiteRules

LISTING = """
<section><article class="item main"><h3 class="title big"><a href="/one">&nbsp;First &amp; best </a></h3>
<p class="lead"> About <b>one</b> </p><span class="when" data-date="2025-1-7 8:05:09">x</span></article>
<article><h2 class="title"><a href="/two">Second</a></h2></article>
<article><h3 class="title">no link</h3></article>
<article><h3 class="other"><a href="/three">not a title</a></h3></article></section>"""

RULES = SiteRules(
    card=Selector("article"),
    title=(Selector("h3", "title"), Selector("h2", "title")),
    link=Selector("a"),
    summary=(Selector("p", "lead"),),
    date=(Selector("span", "when"),),
    date_attribute="data-date",
    container=(Selector("section", "page detail"), Selector("section", "photo")),
)


def _pages(spark, *html):
    rows = [(i, f"http://p/{i}", h) for i, h in enumerate(html)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_cards(spark):
    rows = extract.extract_cards(_pages(spark, LISTING, None), RULES).collect()
    assert sorted(tuple(r) for r in rows) == [
        (0, "First & best", "/one", "About one", "2025-1-7 8:05:09"),
        (0, "Second", "/two", None, None),
    ]


@pytest.mark.parametrize(
    "html, content",
    [
        ('<section class="page detail"><p>a<p> b <b> c</b></section>', "a\nbc"),
        ('<section class="page detail"><p>a<div><p>in</p></div></p><p> </p></section>', "a\nin"),
        ('<section class="page detail"><script>var x="<p>no</p>";</script><p>&lt;x&gt;</p></section>', "<x>"),
        ('<section class="photo big"><p>q</p></section><p>out</p>', "q"),
        ('<section class="detail page"><p>class text differs</p></section>', None),
        ('<section class="page detail"></section>', ""),
        ("<p>none</p>", None),
    ],
)
def test_content(spark, html, content):
    (row,) = extract.extract_content(_pages(spark, html), RULES).collect()
    assert row.content == content


def _prepared(spark, counts):
    rows = [(i, label, n) for i, (label, n) in enumerate(counts)]
    return spark.createDataFrame(rows, "id long, is_fake int, word_count int")


def test_histogram_against_numpy(spark):
    values = np.random.default_rng(0).integers(0, 300, 500)
    rows = profile.length_histogram(_prepared(spark, [(1, int(v)) for v in values])).collect()
    expected, _ = np.histogram(values, bins=50)
    assert [{r.bin: r.n for r in rows}.get(i, 0) for i in range(50)] == expected.tolist()
    one = profile.length_histogram(_prepared(spark, [(1, 3), (1, 3)])).collect()
    assert [(r.bin, r.n) for r in one] == [(0, 2)]


def test_kde_skips_labels_without_spread(spark):
    rows = profile.length_kde(_prepared(spark, [(0, 1), (0, 5), (0, 9), (1, 4), (1, 4), (-1, 2)])).collect()
    assert {r.is_fake for r in rows} == {0} and len(rows) == 200


def test_parts_make_the_whole_text(spark):
    rows = [(i, 1, f"t{i}") for i in range(200)] + [(200, -1, "x"), (201, 1, None)]
    df = spark.createDataFrame(rows, "id long, is_fake int, text string")
    parts = profile.joined_text(df, "text").orderBy("part").collect()
    assert len(parts) == 4 and {p.label for p in parts} == {"1"}
    assert " ".join(p.text for p in parts) == " ".join(f"t{i}" for i in range(200))


def test_word_cloud(spark):
    text = "Cat cat CAT cats Dogs dogs bass bas it's 2024 42 a1 CATS cat"
    df = spark.createDataFrame([(1, text)], "is_fake int, t string")
    rows = {r.word: r.n for r in words.word_frequencies(df, "t").collect()}
    assert rows == {"cat": 6, "Dogs": 2, "bass": 1, "bas": 1, "it": 1, "a1": 1}


def test_summary_of_nothing(spark):
    df = spark.createDataFrame([], "id long, source string, is_fake boolean")
    assert tuple(profile.summary_stats(df).first()) == (0, 0, 0, 0)
