"""Tasks that count terms by document do not grow with the table; vocabularies from frequent words alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from newscheck.functions.text import only_words
from newscheck.operators import bm25, reduce, terms, vectors
from newscheck.sources import index_store


def _docs(spark):
    pick = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{int(x)}" for x in pick.zipf(1.3, 40) if x < 300)) for i in range(200)]
    return spark.createDataFrame([*rows, (200, None), (201, "")], "doc_id long, text string")


def test_tasks_by_volume(spark, monkeypatch):
    monkeypatch.setattr(terms, "TASK_ROWS", 100)
    docs = _docs(spark)
    index = bm25.fit(docs)
    most = spark.sparkContext.defaultParallelism
    for counts in (index.counts, vectors.tfidf(docs, 50).cells.select("doc_id", "term_id", "tf")):
        held = counts.select(F.spark_partition_id().alias("p")).distinct().count()
        assert held > 2 * most
    some = docs.where("doc_id < 100")
    for changed in (bm25.remove_documents(index, some), bm25.add_documents(bm25.fit(some), docs.where("doc_id >= 100"))):
        assert changed.n_docs in (102, 202)
        assert changed.total_length == changed.vocab.agg(F.sum("cf")).first()[0]


@pytest.mark.parametrize("size", [1, 10, 60, 100_000])
def test_vocabulary_from_frequent_words(spark, monkeypatch, size):
    docs, seen = _docs(spark), []
    counted = vectors.term_stats
    monkeypatch.setattr(vectors, "term_stats", lambda *a: seen.append(counted(*a)) or seen[-1])

    def cells():
        return sorted(tuple(r) for r in vectors.tfidf(docs, size).cells.withColumn("weight", F.round("weight", 9)).collect())

    found, pairs = cells(), seen[-1].count()
    monkeypatch.setattr(vectors, "LISTED", 0)
    assert found == cells()
    assert pairs < seen[-1].count() or size > 60


def test_listed_words(spark):
    row = spark.createDataFrame([(["a'b", "c\\d", "e", None],)], "words array<string>")
    assert row.select(only_words("words", ["a'b", "c\\d"])).first()[0] == ["a'b", "c\\d", None, None]
    assert row.select(only_words("words", [])).first()[0] == [None] * 4
    assert row.select(only_words("words", None)).first()[0] == ["a'b", "c\\d", "e", None]


@pytest.mark.parametrize("sent", [0, 1000])
def test_stored_counts_by_volume(spark, monkeypatch, tmp_path, sent):
    """Removed documents that are too many to be sent: the counts meet them in tasks of bounded size."""
    monkeypatch.setattr(index_store, "SENT_IDS", sent, raising=False)
    docs, gone = _docs(spark), spark.range(0, 150, 2).toDF("doc_id")
    whole = bm25.fit(docs)
    index_store.save_index(whole, str(tmp_path / "index"))
    index_store.remove_batch(str(tmp_path / "index"), gone, "some")
    monkeypatch.setattr(terms, "TASK_ROWS", 100)
    index_store.remove_batch(str(tmp_path / "index"), gone.where("doc_id < 50"), "again")
    left = index_store.load_index(spark, str(tmp_path / "index"))
    expected = bm25.remove_documents(whole, gone)
    assert left.n_docs == expected.n_docs == 127
    assert left.total_length == expected.total_length
    assert sorted(map(tuple, left.counts.collect())) == sorted(map(tuple, expected.counts.collect()))
    if not sent:
        held, before = [], {n: spark.conf.get(n) for n in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            for n in ("8", "200"):
                spark.conf.set("spark.sql.shuffle.partitions", n)
                counts = index_store.load_index(spark, str(tmp_path / "index")).counts
                held.append(counts.select(F.spark_partition_id().alias("p")).distinct().count())
        finally:
            for n, value in before.items():
                spark.conf.set(n, value)
        assert min(held) > 2 * spark.sparkContext.defaultParallelism


# What a query does with its counts, up to the step that holds most of them.
STEPS = {
    "index_lookup_embeddings": lambda docs: bm25.embeddings(bm25.fit(docs), docs.where("doc_id % 9 > 0")),
    "index_remove_documents": lambda docs: bm25.postings(bm25.remove_documents(bm25.fit(docs), docs.where("doc_id % 9 = 0"))),
    "index_add_documents": lambda docs: bm25.postings(bm25.add_documents(bm25.fit(docs.where("doc_id < 100")), docs.where("doc_id >= 100"))),
    "index_add_rebuild": lambda docs: bm25.postings(bm25.add_documents(bm25.fit(docs.where("doc_id < 100")), docs.where("doc_id >= 100"), True)),
    "top_weighted_terms_bm25": lambda docs: vectors.vectorize(docs, "bm25", 5000).cells.join(docs.select("doc_id", "text"), "doc_id"),
    "embedding_points, embedding_points_by_source, pca_reduce": lambda docs: reduce.with_empty(terms.to_vectors(vectors.tfidf(docs, 50).cells, "weight"), docs),
}


@pytest.mark.parametrize("query", STEPS)
def test_steps_after_counting_by_volume(spark, monkeypatch, query):
    """Joins with ids, labels or documents leave the counts in the tasks they were dealt to, also without broadcasts."""
    monkeypatch.setattr(terms, "TASK_ROWS", 200, raising=False)
    settings = {"spark.sql.shuffle.partitions": "200", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {n: spark.conf.get(n) for n in settings}
    for n, value in settings.items():
        spark.conf.set(n, value)
    try:
        table = STEPS[query](_docs(spark).coalesce(8))
        size = F.sum(F.size("vec")) if "vec" in table.columns else F.count("*")
        held = table.groupBy(F.spark_partition_id()).agg(size.alias("n")).agg(F.max("n"), F.sum("n")).first()
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)
    assert held[1] > 2000
    assert held[0] < 500
