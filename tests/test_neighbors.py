"""Neighbour descent against the exact graph."""

import numpy as np
import pytest

from newscheck.operators import neighbors


def _frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")


def _graph(df):
    return {(r.vec_id, r.neighbour_id): (r["rank"], r.cosine) for r in df.collect()}


def test_descent_finds_most_neighbours(spark, monkeypatch):
    """Points around centres, far more than a bucket holds."""
    monkeypatch.setattr(neighbors, "BUCKET", 64)
    pick = np.random.default_rng(4)
    centres = pick.standard_normal((20, 24))
    points = _frame(spark, centres[pick.integers(0, 20, 2500)] + 0.6 * pick.standard_normal((2500, 24)))
    exact, found = (_graph(f(points, "vec_id", "embedding")) for f in (neighbors.knn_graph, neighbors.knn_descent))
    assert len(found) == len(exact) == 2500 * neighbors.NEIGHBOURS
    common = exact.keys() & found.keys()
    assert len(common) / len(exact) >= 0.9
    assert all(found[e][1] == pytest.approx(exact[e][1], abs=1e-6) for e in common)


def test_descent_of_few_and_equal_points(spark):
    pick = np.random.default_rng(1)
    some = pick.standard_normal((12, 3))
    for vectors in ([], [[1.0, 2.0]], [[1.0, 0.0], [0.0, 1.0], [1.0, 0.1]], [*some, None, [0.0, 0.0, 0.0], [float("nan"), 1.0, 0.0]]):
        points = _frame(spark, vectors)
        exact, found = (_graph(f(points, "vec_id", "embedding", 4)) for f in (neighbors.knn_graph, neighbors.knn_descent))
        assert found == exact


def test_descent_of_many_equal_points(spark, monkeypatch):
    """A vector that most points have: buckets stay small, all neighbours are as near as can be."""
    monkeypatch.setattr(neighbors, "BUCKET", 64)
    pick = np.random.default_rng(2)
    vectors = [[1.0, 2.0, 3.0]] * 400 + list(pick.standard_normal((200, 3)))
    found = _graph(neighbors.knn_descent(_frame(spark, vectors), "vec_id", "embedding", 5))
    assert len(found) == 600 * 5
    assert all(c == pytest.approx(1.0) for (i, _), (_, c) in found.items() if i < 400)


def test_descent_keeps_stored_floats(spark, monkeypatch):
    """Vectors of floats travel as such; cosines are those of their doubles."""
    pick, seen = np.random.default_rng(6), []
    kept = neighbors.materialize
    monkeypatch.setattr(neighbors, "materialize", lambda df, name: seen.append((name, dict(df.dtypes).get("v"))) or kept(df, name))
    vectors = [None, [0.0] * 8, [float("nan")] + [1.0] * 7, *pick.standard_normal((60, 8))]
    points = _frame(spark, vectors)
    floats = points.selectExpr("vec_id", "cast(embedding as array<float>) as embedding")
    found = _graph(neighbors.knn_descent(floats, "vec_id", "embedding", 5))
    assert ("unit", "struct<x:array<float>,length:double>") in seen
    assert found == _graph(neighbors.knn_graph(floats, "vec_id", "embedding", 5))


def test_exact_graph_deals_few_blocks():
    """Copies of a vector grow with blocks: 615,000 points of 64 components took 75 and 151 copies."""
    assert neighbors.graph_blocks(615_000, 64, 6) <= 5
    assert neighbors.graph_blocks(0, 1, 8) == 1 and neighbors.graph_blocks(300, 64, 8) == 2


def test_exact_graph_copies_stored_floats(spark, monkeypatch):
    """Several blocks and slices, odd vectors and repeated ids, against all pairs by numpy."""
    monkeypatch.setattr(neighbors, "SLICE", 100)
    pick = np.random.default_rng(8)
    vectors = [None, [0.0] * 6, [float("nan")] + [1.0] * 5, [2.0], *pick.standard_normal((900, 6)).round(1)]
    points = _frame(spark, vectors).selectExpr("vec_id", "cast(embedding as array<float>) as embedding")
    graph = neighbors.knn_graph(points, "vec_id", "embedding", 5)
    assert "struct(i, " not in graph._jdf.queryExecution().optimizedPlan().toString()
    m = np.zeros((len(vectors), 6))
    for i, v in enumerate(vectors):
        m[i, : len(v) if v is not None else 0] = np.nan_to_num(np.asarray(v if v is not None else [], np.float32).astype(float))
    m = np.divide(m, np.linalg.norm(m, axis=1)[:, None], out=np.zeros_like(m), where=m.any(1)[:, None])
    cosine = np.round(m @ m.T, 6)
    found = _graph(graph)
    assert len(found) == 5 * len(vectors)
    for i in range(len(vectors)):
        best = np.sort(cosine[i])[::-1][:5]
        mine = sorted((r, c) for (a, _), (r, c) in found.items() if a == i)
        assert [c for _, c in mine] == pytest.approx(best, abs=2e-6)
