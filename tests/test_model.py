import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from newscheck.operators import bm25, detect, neighbors, reduce, vectors
from newscheck.operators.terms import choose_vocabulary, dense_index, to_vectors
from newscheck.operators.topk import topk_dot
from newscheck.sources import index_store
from newscheck.streaming.articles import maintain_index

TEXTS = {
    1: "virus vaccine virus safe",
    2: "vaccine safe tested",
    3: "virus hoax secret common",
    4: "hoax secret cure common",
    5: "",
}
ALL_COMMON = {i: (t + " every").strip() for i, t in TEXTS.items()}


def _docs(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string")


def _weights(texts, vocab, k1=1.5, b=0.75):
    tf = {i: Counter(w for w in t.split() if w in vocab) for i, t in texts.items()}
    n, df = len(texts), Counter(w for c in tf.values() for w in c)
    average = sum(sum(c.values()) for c in tf.values()) / n
    return {
        (i, w): math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
        * x
        / (x + k1 * (1 - b + b * sum(c.values()) / average))
        for i, c in tf.items()
        for w, x in c.items()
    }


def _found(cells):
    return {(r.doc_id, r.term): pytest.approx(r.weight) for r in cells.collect()}


def _vocab(texts):
    df = Counter(w for t in texts.values() for w in set(t.split()))
    return {w for w, x in df.items() if 2 <= x <= int(len(texts) * 0.95)}


@pytest.fixture(scope="module")
def index(spark):
    return bm25.fit(_docs(spark, ALL_COMMON))


def test_fit(index):
    vocab = {r.term: r.term_id for r in index.vocab.collect()}
    assert set(vocab) == {"virus", "vaccine", "safe", "hoax", "secret", "common"}  # not 'every', not df 1
    assert [vocab[t] for t in sorted(vocab)] == list(range(6))
    assert index.n_docs == 5 and index.average_length == pytest.approx(13 / 5)
    assert _found(bm25.postings(index)) == _weights(ALL_COMMON, set(vocab))


def test_query(spark, index):
    asked = {1: "virus virus hoax unknown", 2: "nothing known", 3: "safe"}
    rows = bm25.query_topk(index, _docs(spark, asked).withColumnRenamed("doc_id", "query_id"), k=2).collect()
    w = _weights(ALL_COMMON, _vocab(ALL_COMMON))
    score = lambda d, q: sum(w.get((d, t), 0) for t in q.split())
    expected = {
        (q, rank): d
        for q, text in asked.items()
        for rank, d in enumerate(
            sorted((d for d in TEXTS if score(d, text) > 0), key=lambda d: (-round(score(d, text), 6), d))[:2], 1
        )
    }
    assert {(r.query_id, r.rank): r.doc_id for r in rows} == expected
    padded = bm25.query_topk(
        index, _docs(spark, asked).withColumnRenamed("doc_id", "query_id"), k=5, pad_zero=True
    )
    assert Counter(r.query_id for r in padded.collect()) == {1: 5, 3: 5}


def test_add_and_remove_restore(spark, index):
    new = {8: "virus cure fresh", 9: "fresh vaccine"}
    grown = bm25.add_documents(index, _docs(spark, new))
    everything = {**ALL_COMMON, **new}
    assert _found(bm25.postings(grown)) == _weights(everything, _vocab(ALL_COMMON))
    back = bm25.remove_documents(grown, spark.createDataFrame([(8,), (9,)], "doc_id long"))
    assert back.n_docs == 5 and _found(bm25.postings(back)) == _found(bm25.postings(index))
    assert sorted(map(tuple, back.vocab.collect())) == sorted(map(tuple, index.vocab.collect()))
    rebuilt = bm25.add_documents(index, _docs(spark, new), rebuild_vocab=True)
    assert _found(bm25.postings(rebuilt)) == _weights(everything, _vocab(everything))


def test_store_appends_batches_once(spark, index, tmp_path):
    path, new = str(tmp_path / "index"), {8: "virus cure fresh", 9: "fresh vaccine"}
    index_store.save_index(index, path)
    assert _found(bm25.postings(index_store.load_index(spark, path))) == _found(bm25.postings(index))
    expected = _weights({**ALL_COMMON, **new}, _vocab(ALL_COMMON))
    for _ in range(2):
        index_store.append_batch(path, _docs(spark, new), 1)
        assert _found(bm25.postings(index_store.load_index(spark, path))) == expected


def test_store_knows_its_documents(spark, index, tmp_path):
    path, new = str(tmp_path / "index"), {8: "virus cure fresh", 9: "fresh vaccine"}
    index_store.save_index(index, path)
    index_store.append_batch(path, _docs(spark, new), "a")
    index_store.append_batch(path, _docs(spark, new).union(_docs(spark, ALL_COMMON)), "b")  # nothing new
    loaded = index_store.load_index(spark, path)
    everything = {**ALL_COMMON, **new}
    assert loaded.n_docs == len(everything)
    assert _found(bm25.postings(loaded)) == _weights(everything, _vocab(ALL_COMMON))
    gone = spark.createDataFrame([(8,), (8,), (9,), (77,)], "doc_id long")
    for _ in range(2):
        index_store.remove_batch(path, gone, "c")
        back = index_store.load_index(spark, path)
        assert back.n_docs == 5 and _found(bm25.postings(back)) == _found(bm25.postings(index))
    index_store.append_batch(path, _docs(spark, new), "d")  # removed ones may come back
    assert _found(bm25.postings(index_store.load_index(spark, path))) == _weights(everything, _vocab(ALL_COMMON))


def test_unfinished_batch_is_not_read(spark, index, tmp_path, monkeypatch):
    path, new = str(tmp_path / "index"), {8: "virus cure fresh"}
    index_store.save_index(index, path)
    index_store.append_batch(path, _docs(spark, new), "a")

    def fails(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(index_store, "batch_counts", fails)
    with pytest.raises(RuntimeError):
        index_store.append_batch(path, _docs(spark, {9: "fresh vaccine"}), "a")
    assert _found(bm25.postings(index_store.load_index(spark, path))) == _found(bm25.postings(index))


def test_index_stream(spark, index, tmp_path):
    path, source = str(tmp_path / "index"), str(tmp_path / "in")
    index_store.save_index(index, path)
    texts = dict(ALL_COMMON)
    for new in ({8: "virus cure fresh"}, {9: "fresh vaccine"}):
        texts.update(new)
        _docs(spark, new).write.mode("append").parquet(source)
        maintain_index(
            spark.readStream.schema("doc_id long, text string").parquet(source), path, str(tmp_path / "c")
        )
    assert _found(bm25.postings(index_store.load_index(spark, path))) == _weights(texts, _vocab(ALL_COMMON))


def test_stopwords_and_unlimited_vocabulary(spark):
    config = bm25.BM25Config(max_features=None, stopwords=("virus",))
    rows = bm25.fit(_docs(spark, ALL_COMMON), config).vocab.orderBy("term").collect()
    assert [r.term for r in rows] == ["common", "hoax", "safe", "secret", "vaccine"]
    assert [r.term_id for r in rows] == [0, 1, 2, 3, 4]


def test_max_features_breaks_ties_by_term(spark):
    stats = spark.createDataFrame([("b", 2, 5), ("a", 2, 5), ("c", 2, 9)], "term string, df long, cf long")
    kept = choose_vocabulary(stats, 10, 2, 0.95, 2)
    assert sorted((r.term_id, r.term) for r in kept.collect()) == [(0, "a"), (1, "c")]


def test_dense_index(spark):
    df = spark.range(1000).selectExpr("id * 37 % 1000 as k")
    rows = dense_index(df, ["k"], "n", start=5).collect()
    assert sorted((r.k, r.n) for r in rows) == [(i, i + 5) for i in range(1000)]


def _vote(spark, scores):
    queries = spark.createDataFrame([(1, True), (2, False), (3, True)], "query_id long, has_terms boolean")
    hits = spark.createDataFrame(scores, "query_id long, doc_id long, rank int, score double")
    articles = spark.createDataFrame([(1, True), (2, False), (3, True)], "id long, is_fake boolean")
    return {r.query_id: r for r in detect.vote(queries, hits, articles).collect()}


@pytest.mark.parametrize(
    "scores, prediction, probability",
    [
        ([(1, 1, 1, 2.0), (1, 3, 2, 1.0)], "FAKE", 1.0),
        ([(1, 2, 1, 2.0)], "REAL", 0.0),
        ([(1, 1, 1, 2.0), (1, 2, 2, 2.0)], "FAKE", 0.5),
        ([(1, 1, 1, 0.0)], "FAKE", 0.5),
    ],
)
def test_vote(spark, scores, prediction, probability):
    rows = _vote(spark, scores)
    assert (rows[1].prediction, rows[1].fake_probability) == (prediction, probability)
    assert rows[1].confidence == abs(probability - 0.5) * 2
    assert (rows[2].prediction, rows[2].confidence, rows[2].fake_probability) == ("UNKNOWN", 0.0, 0.5)


def test_detect_without_labelled_articles(spark):
    none = spark.createDataFrame([], "id long, title string, source string, is_fake boolean")
    empty = bm25.fit(spark.createDataFrame([], "doc_id long, text string"))
    queries = spark.createDataFrame([(1, "any text")], "query_id long, text string")
    assert [r.prediction for r in detect.detect(empty, queries, none).collect()] == ["UNKNOWN"]


def test_nested_articles(spark, index):
    articles = spark.createDataFrame(
        [(i, "t" * 150 if i == 1 else None, None, i % 2 == 1) for i in TEXTS],
        "id long, title string, source string, is_fake boolean",
    )
    queries = spark.createDataFrame([(7, "virus safe"), (8, "zzz")], "query_id long, text string")
    votes = detect.detect(index, queries, articles)
    similar = detect.similar_articles(bm25.query_topk(index, queries), articles)
    rows = {r.query_id: r for r in detect.with_article_list(votes, similar).collect()}
    first = rows[7].similar_articles[0]
    assert [a.rank for a in rows[7].similar_articles] == [1, 2, 3] and rows[8].similar_articles == []
    assert len(first.title) == 100 and first.source == "Unknown" and first.label == 1


def test_topk_against_numpy(spark):
    random = np.random.default_rng(1)
    dense = random.random((700, 40)) * (random.random((700, 40)) < np.linspace(0.01, 0.9, 40))
    dense[300:420] = dense[5]  # many equal rows: ties go by id
    rows = [(i, [(j, float(v)) for j, v in enumerate(r) if v]) for i, r in enumerate(dense.tolist())]
    df = spark.createDataFrame(rows, "id long, vec array<struct<i:int,v:double>>")
    found = {(r.left_id, r.rank): (r.right_id, r.score) for r in topk_dot(df, df, 7, 700, 700).collect()}
    scores = np.round(dense @ dense.T, 6)
    for i, row in enumerate(scores):
        best = sorted((j for j in range(700) if row[j] > 0), key=lambda j: (-row[j], j))[:7]
        assert [found[i, n + 1] for n in range(len(best))] == [(j, pytest.approx(row[j])) for j in best]
    assert len(found) == sum(min(7, int((row > 0).sum())) for row in scores)


def test_knn_keeps_negative_cosines(spark):
    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 2.0])], "id long, v array<float>")
    rows = neighbors.knn_graph(points, "id", "v", k=3).collect()
    assert {(r.vec_id, r.rank): (r.neighbour_id, r.cosine) for r in rows}[1, 3] == (2, -1.0)


def test_tfidf(spark):
    docs = _docs(spark, {1: "Red apple red", 2: "red apple", 3: "green pear a"})
    cells = {(r.doc_id, r.term): r.weight for r in vectors.tfidf(docs).cells.collect()}
    idf = math.log(4 / 3) + 1
    raw = {"red": 2 * idf, "apple": idf, "red apple": idf}
    length = math.sqrt(sum(v * v for v in raw.values()))
    assert {t: w for (d, t), w in cells.items() if d == 1} == {
        t: pytest.approx(v / length) for t, v in raw.items()
    }
    assert {d for d, _ in cells} == {1, 2}
    with pytest.raises(ValueError):
        vectors.vectorize(docs, "word2vec")


def _matrix(spark, dense):
    rows = [(i, j, float(v)) for i, r in enumerate(dense) for j, v in enumerate(r) if v]
    cells = spark.createDataFrame(rows, "doc_id long, term_id int, weight double")
    ids = spark.range(len(dense)).withColumnRenamed("id", "doc_id")
    return reduce.with_empty(to_vectors(cells, "weight"), ids)


@pytest.mark.parametrize("method", ["svd", "pca"])
def test_reduction_against_numpy(spark, tmp_path, method):
    random = np.random.default_rng(3)
    dense = random.random((60, 5)) @ random.random((5, 25)) * (random.random((60, 25)) < 0.5)
    dense[7] = 0
    rows = _matrix(spark, dense)
    fitted = reduce.fit_reducer(rows, 60, 25, 3, method)
    x = dense - dense.mean(axis=0) if method == "pca" else dense
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    np.testing.assert_allclose(fitted.singular_values, s[:3], rtol=1e-3)
    scores = x @ vt[:3].T
    ratio = scores.var(axis=0) / dense.var(axis=0).sum()
    np.testing.assert_allclose(fitted.explained_variance_ratio, ratio, rtol=2e-2)
    assert (fitted.components[np.arange(3), np.abs(fitted.components).argmax(axis=1)] > 0).all()
    reduce.save_reducer(spark, fitted, str(tmp_path / "m"))
    loaded = reduce.load_reducer(spark, str(tmp_path / "m"))
    got = {r.doc_id: r.vector for r in reduce.project(rows, loaded).collect()}
    mine = np.array([got[i] for i in range(60)])
    np.testing.assert_allclose(mine, (dense - fitted.mean) @ fitted.components.T, atol=1e-9)
    np.testing.assert_allclose(np.abs(mine[:, 0]), np.abs(scores[:, 0]), atol=1e-2)


def test_reducer_limits(spark):
    rows = _matrix(spark, np.eye(4))
    few = reduce.fit_reducer(rows, 4, 4, 10, "svd")  # more components than features
    np.testing.assert_allclose(few.singular_values, np.ones(4))
    with pytest.raises(ValueError):
        reduce.fit_reducer(rows, 4, 4, 2, "umap")


def test_projection_of_unseen_documents(spark, index):
    weights = vectors.index_weights(index)
    fitted = reduce.hybrid_reducer(weights, reduce.sparse_rows(weights), "SVD")
    assert len(fitted.components) == 4  # min(256, features - 1, documents - 1)
    new = _docs(spark, {50: "virus hoax", 51: "unknown"})
    found = to_vectors(bm25.transform(index, new), "weight")
    got = {r.doc_id: r.vector for r in reduce.project(reduce.with_empty(found, new), fitted).collect()}
    assert len(got[50]) == 4 and any(got[50]) and got[51] == [0, 0, 0, 0]
    payload = detect.hybrid_payload(reduce.project(reduce.with_empty(found, new), fitted), new, "m")
    assert '"document":"unknown"' in {r.doc_id: r.payload for r in payload.collect()}[51]


def test_points_by_source_leave_out_unlabelled(spark):
    reduced = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "doc_id long, vector array<double>")
    articles = spark.createDataFrame([(1, 1, "s"), (2, -1, "s")], "id long, is_fake int, source string")
    assert reduce.plot_points(reduced, articles).count() == 2
    (row,) = reduce.plot_points(reduced, articles, by_source=True).collect()
    assert (row.x, row.y, row.z, row.label) == (1.0, 2.0, None, "Fake News")


def test_hot_term_is_combined_before_the_shuffle(spark):
    from newscheck.operators.terms import term_stats

    docs = spark.range(50).select("id", F.array(F.lit("hot"), F.lit("hot")).alias("terms"))
    stats = term_stats(docs)
    assert "partial_sum" in stats._jdf.queryExecution().toString()
    assert [tuple(r) for r in stats.collect()] == [("hot", 50, 100)]
