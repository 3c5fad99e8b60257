"""N-gram and word-cloud frequencies."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newscheck.functions.text import cloud_words, lower_words, ngrams, only_words
from newscheck.operators.terms import each_entry
from newscheck.session import materialize

# Words shown in a cloud, n-grams shown in a chart.
CLOUD_SIZE = 200
TOP_NGRAMS = 30
TOP_NGRAMS_PER_LABEL = 15
# Frequent words that are listed in an expression; with more, all n-grams are counted.
LISTED = 5000


def _ngram_rows(articles: DataFrame, text: str, low: int, high: int, *keys: str, only: Collection[str] | None = None) -> DataFrame:
    """One row per n-gram; with ``only``, of those that have none but these words."""
    words = articles.select(*keys, lower_words(F.col(text)).alias("words"))
    words = words.select(*keys, only_words("words", only).alias("words"))
    return each_entry(words, ngrams(F.col("words"), low, high), "ngram", *keys)


def _frequent(counts: DataFrame, top_n: int) -> list[str] | None:
    """Words counted, for some label, at least as often as the ``top_n``-th of every label; None if they are too many or too few."""
    keys = [c for c in counts.columns if c not in ("ngram", "n")]
    if keys:
        top = _ranked(counts, keys[0], [F.desc("n")], top_n)
    else:
        top = counts.orderBy(F.desc("n")).limit(top_n)
    bounds = top.groupBy(*keys).agg(F.min("n").alias("least"), F.count("*").alias("found")).collect()  # one row per label
    if not bounds or min(r["found"] for r in bounds) < top_n:
        return None
    often = counts.where(F.col("n") >= min(r["least"] for r in bounds))
    listed = often.select("ngram").distinct().limit(LISTED + 1).collect()
    return [r[0] for r in listed] if len(listed) <= LISTED else None


def _counted(articles: DataFrame, text: str, ngram_range: tuple[int, int], top_n: int, *keys: str) -> DataFrame:
    """``*keys, ngram, n`` of all n-grams that can be among the ``top_n`` of their key.

    An n-gram does not occur more often than any of its words. So if words are asked for too, one
    that occurs less often than the ``top_n``-th word is in no longer n-gram that is sought.
    """
    count = lambda rows: rows.groupBy(*keys, "ngram").agg(F.count("*").alias("n"))
    if ngram_range[0] > 1 or ngram_range[1] == 1:
        return count(_ngram_rows(articles, text, *ngram_range, *keys))
    singles = materialize(count(_ngram_rows(articles, text, 1, 1, *keys)), "words")
    only = _frequent(singles, top_n)
    longer = _ngram_rows(articles, text, 2, ngram_range[1], *keys, only=only)
    return singles.unionByName(count(longer))


def top_ngrams(
    articles: DataFrame, text: str, ngram_range: tuple[int, int] = (1, 1), top_n: int = TOP_NGRAMS
) -> DataFrame:
    """The most frequent n-grams; equal counts in alphabetical order."""
    return _counted(articles, text, ngram_range, top_n).orderBy(F.desc("n"), "ngram").limit(top_n)


def top_ngrams_by_label(
    prepared: DataFrame,
    text: str,
    ngram_range: tuple[int, int] = (1, 1),
    top_n: int = TOP_NGRAMS_PER_LABEL,
) -> DataFrame:
    """The most frequent n-grams of every label, with their rank."""
    counts = _counted(prepared, text, ngram_range, top_n, "is_fake")
    return _ranked(counts, "is_fake", [F.desc("n"), F.asc("ngram")], top_n)


def _ranked(rows: DataFrame, key: str, order: list, top_n: int) -> DataFrame:
    """Rows ranked within ``key``, cut at ``top_n`` before and after the shuffle."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top_n)


def word_frequencies(
    articles: DataFrame,
    text: str,
    by_label: bool = False,
    top_n: int = CLOUD_SIZE,
    stopwords: DataFrame | None = None,
) -> DataFrame:
    """``label, word, n, weight``: what a word cloud draws.

    Words in ``stopwords`` (column ``term``) are left out, whatever their case; the list is met by
    the counted spellings, not by every word.

    Spellings that differ in case are counted together under the most frequent one.
    A plural in -s (not -ss) joins its singular if that occurs. The weight is
    relative to the most frequent word.
    """
    label = F.col("is_fake").cast("string") if by_label else F.lit("all")
    rows = articles.where("is_fake <> -1") if by_label else articles
    words = each_entry(rows, cloud_words(F.col(text)), "word", label.alias("label"))
    spellings = words.groupBy("label", "word").agg(F.count("*").alias("n"))

    if stopwords is not None:
        listed = stopwords.select(F.lower("term").alias("term")).distinct()
        spellings = spellings.join(listed, F.lower("word") == F.col("term"), "left_anti")

    lower = F.lower("word")
    plural = lower.rlike("[^s]s$")
    stem = F.when(plural, F.expr("left(lower(word), length(word) - 1)")).otherwise(lower)
    family = W.partitionBy("label", "stem")
    has_singular = F.max(F.col("lower") == F.col("stem")).over(family)
    merged = (
        spellings.withColumns({"lower": lower, "stem": stem})
        .withColumn("joins", (F.col("lower") != F.col("stem")) & has_singular)
        .select(
            "label",
            "stem",
            F.when(F.col("joins"), F.col("stem")).otherwise(F.col("lower")).alias("key"),
            F.when(F.col("joins"), F.expr("left(word, length(word) - 1)"))
            .otherwise(F.col("word"))
            .alias("word"),
            "n",
        )
        .groupBy("label", "stem", "key", "word")
        .agg(F.sum("n").alias("n"))
    )
    shown = F.min_by("word", F.struct(-F.col("n"), "word"))
    counted = merged.groupBy("label", "stem", "key").agg(shown.alias("word"), F.sum("n").alias("n"))
    top = _ranked(counted.select("label", "word", "n"), "label", [F.desc("n"), F.asc("word")], top_n)
    most = F.max("n").over(W.partitionBy("label"))
    return top.withColumn("weight", F.round(F.col("n") / most, 6))
