"""The most frequent n-grams, of words that are frequent enough."""

from collections import Counter

import numpy as np
import pytest

from newscheck.operators import words


def _texts():
    pick = np.random.default_rng(3)
    return [" ".join(f"w{int(x)}" for x in pick.zipf(1.4, 30) if x < 400) for _ in range(300)] + ["aa aa aa aa", None, "", "x"]


def _expected(texts, low, high, top):
    n = Counter()
    for text in texts:
        w = [x for x in (text or "").split() if len(x) > 1]
        n.update(" ".join(w[i : i + k]) for k in range(low, high + 1) for i in range(len(w) - k + 1))
    return sorted(n.items(), key=lambda e: (-e[1], e[0]))[:top]


@pytest.mark.parametrize("listed", [5000, 0])
@pytest.mark.parametrize("top", [1, 7, 40, 100_000])
def test_top_ngrams_with_and_without_a_list(spark, monkeypatch, listed, top):
    monkeypatch.setattr(words, "LISTED", listed)
    rows = spark.createDataFrame([(t, i % 3 - 1) for i, t in enumerate(_texts())], "text string, is_fake int")
    for sizes in ((1, 3), (1, 2), (2, 2)):
        assert [tuple(r) for r in words.top_ngrams(rows, "text", sizes, top).collect()] == _expected(_texts(), *sizes, top)
    found = words.top_ngrams_by_label(rows, "text", (1, 2), top).orderBy("is_fake", "rank").collect()
    for label in (-1, 0, 1):
        some = [t for i, t in enumerate(_texts()) if i % 3 - 1 == label]
        assert [(r.ngram, r.n) for r in found if r.is_fake == label] == _expected(some, 1, 2, top)


def test_rare_words_make_no_ngrams(spark):
    """Only n-grams of the words that are frequent enough are counted."""
    rows = spark.createDataFrame([(t,) for t in _texts()], "text string")
    counted = words._counted(rows, "text", (1, 3), 5).where("ngram like '% %'").collect()
    assert {w for r in counted for w in r.ngram.split()} <= {e for e, _ in _expected(_texts(), 1, 1, 5)}
    assert {r.ngram: r.n for r in counted}["w1 w1"] == dict(_expected(_texts(), 2, 2, 1))["w1 w1"]
