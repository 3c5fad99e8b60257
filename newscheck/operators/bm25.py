"""BM25 index kept as tables.

``vocab``     term_id, term, df, cf        at most ``max_features`` rows
``counts``    doc_id, term_id, tf, dl      raw counts; weights are derived when read
``corpus``    doc_id, text                 every indexed document, also empty ones

df, cf and the document number are sums over documents. Adding or removing
documents with a fixed vocabulary therefore only reads the documents that change.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newscheck.functions.text import whitespace_words, without_words
from newscheck.operators.terms import (
    choose_vocabulary,
    small_enough,
    tasks_for,
    term_counts,
    term_stats,
    to_vectors,
)
from newscheck.operators.pruned import topk_bounded
from newscheck.operators.topk import topk_dot
from newscheck.session import materialize


@dataclass(frozen=True)
class BM25Config:
    """Defaults are the fixed values of the retrieval model."""

    max_features: int | None = 5000
    k1: float = 1.5
    b: float = 0.75
    min_df: int = 2
    max_df: float = 0.95
    stopwords: tuple[str, ...] = field(default=())


@dataclass(frozen=True)
class BM25Index:
    config: BM25Config
    corpus: DataFrame
    vocab: DataFrame
    counts: DataFrame
    n_docs: int
    total_length: int

    @property
    def average_length(self) -> float:
        """Mean length over all documents, empty ones included."""
        return self.total_length / self.n_docs if self.n_docs else 0.0


def _tokens(docs: DataFrame, config: BM25Config) -> DataFrame:
    words = without_words(whitespace_words(F.col("text")), config.stopwords)
    return docs.select("doc_id", words.alias("terms"))


def _volume(docs: DataFrame) -> tuple[int, int]:
    """Number of documents, and about how many words they have."""
    n, chars = docs.agg(F.count("*"), F.sum(F.char_length("text"))).first()
    return n, (chars or 0) // 5


def batch_counts(docs: DataFrame, vocab: DataFrame, config: BM25Config, words: int | None = None) -> DataFrame:
    """``doc_id, term_id, tf, dl`` of ``docs`` (``doc_id, text``) over a vocabulary.

    ``words`` is about how many the documents have; if it is not given, texts are measured.
    """
    words = _volume(docs)[1] if words is None else words
    return term_counts(_tokens(docs, config), vocab, config.max_features, rows=words)


def _length(vocab: DataFrame) -> int:
    return vocab.agg(F.sum("cf")).first()[0] or 0


def fit(corpus: DataFrame, config: BM25Config = BM25Config()) -> BM25Index:
    """Index ``corpus`` (``doc_id, text``): one pass for the vocabulary, one for counts."""
    corpus = corpus.select("doc_id", "text")
    n_docs = corpus.count()
    tokens = _tokens(corpus, config)
    vocab = materialize(
        choose_vocabulary(
            term_stats(tokens), n_docs, config.min_df, config.max_df, config.max_features
        ),
        "vocab",
    )
    length = _length(vocab)
    counts = batch_counts(corpus, vocab, config, length)
    return BM25Index(config, corpus, vocab, counts, n_docs, length)


def inverse_frequency(n_docs: int | Column, df: Column) -> Column:
    """ln(1 + (N - df + 0.5) / (df + 0.5))"""
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def saturation(tf: Column, dl: Column, average: float, k1: float, b: float) -> Column:
    """tf / (tf + k1 (1 - b + b dl / average))"""
    return tf / (tf + k1 * (1 - b + b * dl / average))


def _weighted(index: BM25Index, counts: DataFrame) -> DataFrame:
    c = index.config
    average = index.average_length or 1.0
    weight = inverse_frequency(index.n_docs, F.col("df")) * saturation(
        F.col("tf"), F.col("dl"), average, c.k1, c.b
    )
    known = small_enough(index.vocab.select("term_id", "term", "df"), c.max_features)
    return counts.join(known, "term_id").select(
        "doc_id", "term_id", "term", "tf", "dl", weight.alias("weight")
    )


def postings(index: BM25Index) -> DataFrame:
    """``doc_id, term_id, term, tf, dl, weight`` of the indexed documents."""
    return _weighted(index, index.counts)


def transform(index: BM25Index, docs: DataFrame) -> DataFrame:
    """The same weights for new documents, with the fitted vocabulary and statistics."""
    counts = batch_counts(docs, index.vocab, index.config)
    return _weighted(index, counts)


def document_vectors(index: BM25Index) -> DataFrame:
    """``id, vec``: one sparse weight vector per indexed document with a known term."""
    return to_vectors(postings(index), "weight").withColumnRenamed("doc_id", "id")


def query_vectors(index: BM25Index, queries: DataFrame) -> DataFrame:
    """``id, vec`` of query texts; a repeated term counts as often as it occurs."""
    docs = queries.select(F.col("query_id").alias("doc_id"), "text")
    counts = batch_counts(docs, index.vocab, index.config)
    return to_vectors(counts, "tf").withColumnRenamed("doc_id", "id")


def _hits(found: DataFrame) -> DataFrame:
    return found.select(
        F.col("left_id").alias("query_id"), F.col("right_id").alias("doc_id"), "rank", "score"
    )


def vector_topk(
    index: BM25Index, vectors: DataFrame, n_queries: int, k: int = 10, pad_zero: bool = False
) -> DataFrame:
    """``query_id, doc_id, rank, score`` of query vectors (``id, vec``)."""
    documents = document_vectors(index)
    if pad_zero:
        empty = F.array().cast("array<struct<i:int,v:double>>")
        documents = (
            index.corpus.select(F.col("doc_id").alias("id"))
            .join(documents, "id", "left")
            .select("id", F.coalesce("vec", empty).alias("vec"))
        )
        found = topk_dot(vectors, documents, k, n_queries, index.n_docs, positive_only=False)
    else:
        found = topk_bounded(vectors, documents, k, n_queries, index.n_docs)
    return _hits(found)


def query_topk(
    index: BM25Index, queries: DataFrame, k: int = 10, pad_zero: bool = False
) -> DataFrame:
    """``query_id, doc_id, rank, score``: the k best documents of every query text.

    Only positive scores by default. ``pad_zero`` fills up with the lowest document
    ids of score 0 (for queries that have a known term), as a plain array top-k does.
    """
    return vector_topk(index, query_vectors(index, queries), queries.count(), k, pad_zero)


def self_topk(index: BM25Index, k: int = 10) -> DataFrame:
    """Every indexed document as a query against all indexed documents."""
    cells = postings(index)
    pair = F.struct(F.col("term_id").alias("i"), "tf", "weight")
    both = materialize(
        cells.groupBy(F.col("doc_id").alias("id")).agg(F.array_sort(F.collect_list(pair)).alias("cells")),
        "self",
    )

    def side(name: str) -> DataFrame:
        value = lambda c: F.struct(c["i"].alias("i"), c[name].cast("double").alias("v"))
        return both.select("id", F.transform("cells", value).alias("vec"))

    return _hits(topk_bounded(side("tf"), side("weight"), k, index.n_docs, index.n_docs))


def _shifted(index: BM25Index, docs: DataFrame, sign: int, n: int, words: int) -> tuple[DataFrame, int, int]:
    """Vocabulary statistics after adding (+1) or removing (-1) ``docs``."""
    delta = (
        batch_counts(docs, index.vocab, index.config, words)
        .groupBy("term_id")
        .agg(F.count("*").alias("d_df"), F.sum("tf").alias("d_cf"))
    )
    moved = lambda old, new: (F.col(old) + sign * F.coalesce(new, F.lit(0))).alias(old)
    vocab = materialize(
        index.vocab.join(delta, "term_id", "left").select(
            "term_id", "term", moved("df", "d_df"), moved("cf", "d_cf")
        ),
        "vocab",
    )
    return vocab, index.n_docs + sign * n, _length(vocab)


def add_documents(index: BM25Index, docs: DataFrame, rebuild_vocab: bool = False) -> BM25Index:
    """Add ``docs`` (``doc_id, text``, ids not yet indexed).

    With the vocabulary kept, unknown terms are ignored and only the new documents
    are read. ``rebuild_vocab`` chooses the vocabulary anew from all full texts.
    """
    docs = docs.select("doc_id", "text")
    corpus = index.corpus.unionByName(docs)
    if rebuild_vocab:
        return fit(corpus, index.config)
    n, words = _volume(docs)
    vocab, n_docs, length = _shifted(index, docs, 1, n, words)
    new = batch_counts(docs, vocab, index.config, words)
    return replace(
        index,
        corpus=corpus,
        vocab=vocab,
        counts=index.counts.unionByName(new),
        n_docs=n_docs,
        total_length=length,
    )


def _dealt(index: BM25Index, ids: DataFrame) -> DataFrame:
    """The distinct ``doc_id``s, dealt as the counts of ``index`` are.

    Dealt by Spark's own number they would, if they are not broadcast, have the counts follow them
    into tasks as few as their compressed size allows.
    """
    tasks = tasks_for(ids.sparkSession, index.total_length)
    return ids.select("doc_id").repartition(tasks, "doc_id").distinct()


def remove_documents(index: BM25Index, ids: DataFrame) -> BM25Index:
    """Take out the documents whose ``doc_id`` is in ``ids``; the vocabulary stays."""
    dealt, ids = _dealt(index, ids), ids.select("doc_id").distinct()
    gone = index.corpus.join(ids, "doc_id", "left_semi")
    vocab, n_docs, length = _shifted(index, gone, -1, *_volume(gone))
    return replace(
        index,
        corpus=index.corpus.join(ids, "doc_id", "left_anti"),
        vocab=vocab,
        counts=index.counts.join(dealt, "doc_id", "left_anti"),
        n_docs=n_docs,
        total_length=length,
    )


def documents(index: BM25Index, ids: DataFrame) -> DataFrame:
    """Texts of the given ``doc_id``s."""
    return index.corpus.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")


def embeddings(index: BM25Index, ids: DataFrame | None = None) -> DataFrame:
    """Weights of the given ``doc_id``s, or of all documents."""
    cells = postings(index)
    if ids is None:
        return cells
    return cells.join(_dealt(index, ids), "doc_id", "left_semi")


def matrix_stats(cells: DataFrame, n_docs: int, n_features: int) -> DataFrame:
    """Rows, columns, filled cells and sparsity of a weight table."""
    return cells.agg(F.count("*").alias("nnz")).select(
        F.lit(n_docs).cast("long").alias("n_rows"),
        F.lit(n_features).cast("long").alias("n_cols"),
        "nnz",
        F.round(1 - F.col("nnz") / (n_docs * n_features), 6).alias("sparsity"),
    )
