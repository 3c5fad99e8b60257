"""Document vectors over uni- and bigrams, in long form: TF-IDF and BM25.

A matrix is never built. A weight table holds one row per non-zero cell.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newscheck.functions.labels import label_name
from newscheck.functions.text import lower_words, ngrams, only_words, word_count
from newscheck.operators import bm25
from newscheck.operators.terms import choose_vocabulary, small_enough, term_counts, term_stats
from newscheck.session import materialize

# Fixed values of the vectorisers.
NGRAM_RANGE = (1, 2)
MIN_DF = 2
MAX_DF = 0.95
TFIDF_FEATURES = 2000
BM25_FEATURES_AT_MOST = 3000
BM25_FEATURES_PER_WORD = 1.5
HANDLER_FEATURES = 5000
K1 = 1.5
B = 0.75
TOP_TERMS = 20
# Frequent words that are listed in an expression; with more, all terms are counted.
LISTED = 8000


@dataclass(frozen=True)
class Weights:
    """``cells``: doc_id, term_id, term, tf, weight. ``vocab``: term_id, term, df, cf.

    ``docs`` has the ``doc_id`` of every document, also of those without a cell.
    """

    cells: DataFrame
    vocab: DataFrame
    docs: DataFrame
    n_docs: int
    max_features: int | None


def auto_max_features(articles: DataFrame, text: str) -> DataFrame:
    """One row: ``min(3000, int(mean word count * 1.5))``."""
    scaled = F.floor(F.avg(word_count(F.col(text))) * BM25_FEATURES_PER_WORD)
    return articles.agg(F.least(F.lit(BM25_FEATURES_AT_MOST), scaled).cast("int").alias("max_features"))


def _enough(stats: DataFrame, n_docs: int, max_features: int | None) -> list[str] | None:
    """Words as frequent as the last of ``max_features`` valid ones, or more; None if they are too many or too few.

    No other word is in a term of the vocabulary, as a term does not occur more often than any of its words.
    """
    if not max_features or max_features > LISTED:
        return None
    kept = choose_vocabulary(stats, n_docs, MIN_DF, MAX_DF, max_features)
    found, least = kept.agg(F.count("*"), F.min("cf")).first()
    if found < max_features:
        return None
    listed = stats.where(F.col("cf") >= least).select("term").limit(LISTED + 1).collect()
    return [r[0] for r in listed] if len(listed) <= LISTED else None


def _counted(docs: DataFrame, max_features: int | None) -> tuple[DataFrame, DataFrame, int]:
    words = materialize(docs.select("doc_id", lower_words(F.col("text")).alias("words")), "tokens")
    n_docs = words.count()
    low, high = NGRAM_RANGE
    singles = materialize(term_stats(words, "words"), "word-stats")
    longer = words.select("doc_id", ngrams(only_words("words", _enough(singles, n_docs, max_features)), low + 1, high).alias("terms"))
    vocab = materialize(
        choose_vocabulary(singles.unionByName(term_stats(longer)), n_docs, MIN_DF, MAX_DF, max_features), "vocab"
    )
    used = None
    if max_features and max_features <= LISTED:
        used = [r[0] for r in vocab.select(F.explode(F.split("term", " "))).distinct().collect()]
    grams = words.select("doc_id", ngrams(only_words("words", used), low, high).alias("terms"))
    occurrences = vocab.agg(F.sum("cf")).first()[0] or 0
    counts = term_counts(grams, vocab, max_features, rows=occurrences)
    known = small_enough(vocab.select("term_id", "term", "df"), max_features)
    return counts.join(known, "term_id"), vocab, n_docs


def tfidf(docs: DataFrame, max_features: int | None = TFIDF_FEATURES) -> Weights:
    """``tf * (ln((1 + N) / (1 + df)) + 1)``, every document scaled to length 1."""
    counts, vocab, n_docs = _counted(docs, max_features)
    raw = F.col("tf") * (F.log((1.0 + n_docs) / (1 + F.col("df"))) + 1)
    length = F.sqrt(F.sum(F.pow("raw", F.lit(2))).over(W.partitionBy("doc_id")))
    cells = counts.withColumn("raw", raw).select(
        "doc_id", "term_id", "term", "tf", (F.col("raw") / length).alias("weight")
    )
    return Weights(cells, vocab, docs.select("doc_id"), n_docs, max_features)


def bm25_vectors(docs: DataFrame, max_features: int | None = None) -> Weights:
    """BM25 weight of every term in every document, with the factor (k1 + 1)."""
    if max_features is None:
        max_features = auto_max_features(docs, "text").first()[0]
    counts, vocab, n_docs = _counted(docs, max_features)
    average = (vocab.agg(F.sum("cf")).first()[0] or 0) / max(n_docs, 1) or 1.0
    weight = (
        bm25.inverse_frequency(n_docs, F.col("df"))
        * bm25.saturation(F.col("tf"), F.col("dl"), average, K1, B)
        * (K1 + 1)
    )
    cells = counts.select("doc_id", "term_id", "term", "tf", weight.alias("weight"))
    return Weights(cells, vocab, docs.select("doc_id"), n_docs, max_features)


def index_weights(index: bm25.BM25Index) -> Weights:
    """Document-by-term weights of a BM25 index."""
    cells = bm25.postings(index).drop("dl")
    ids = index.corpus.select("doc_id")
    return Weights(cells, index.vocab, ids, index.n_docs, index.config.max_features)


def vectorize(docs: DataFrame, method: str = "tfidf", max_features: int | None = None) -> Weights:
    """``docs`` is ``doc_id, text``; ``method`` is 'tfidf' or 'bm25'.

    Without ``max_features`` TF-IDF keeps every valid term, BM25 the 5000 of the index.
    """
    if method.lower() == "tfidf":
        return tfidf(docs, max_features)
    if method.lower() == "bm25":
        config = bm25.BM25Config(max_features=max_features or HANDLER_FEATURES)
        return index_weights(bm25.fit(docs, config))
    raise ValueError(f"unknown method {method!r}: use 'tfidf' or 'bm25'")


def top_weighted_terms(weights: Weights, labels: DataFrame, top_n: int = TOP_TERMS) -> DataFrame:
    """``is_fake, label, rank, term, mean_weight``: the heaviest terms of every label.

    The mean goes over all documents of the label; a missing cell counts as 0.
    ``labels`` is ``doc_id, is_fake`` (1/0/-1).
    """
    sizes = labels.groupBy("is_fake").agg(F.count("*").alias("n_docs"))
    sums = (
        weights.cells.join(labels, "doc_id")
        .groupBy("is_fake", "term")
        .agg(F.sum("weight").alias("total"))
    )
    means = sums.join(F.broadcast(sizes), "is_fake").select(  # one row per label
        "is_fake", "term", F.round(F.col("total") / F.col("n_docs"), 6).alias("mean_weight")
    )
    order = W.partitionBy("is_fake").orderBy(F.desc("mean_weight"), "term")
    return (
        means.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top_n)
        .select("is_fake", label_name(F.col("is_fake")).alias("label"), "rank", "term", "mean_weight")
    )
