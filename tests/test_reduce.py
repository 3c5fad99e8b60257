"""Reductions whose basis is a table, merged reducers, and the residual at which they end."""

import numpy as np
import pytest

from newscheck.operators import factor, reduce
from newscheck.operators.terms import to_vectors


def _frame(spark, dense, first=0):
    rows = [(first + i, j, float(v)) for i, r in enumerate(dense) for j, v in enumerate(r) if v]
    cells = spark.createDataFrame(rows, "doc_id long, term_id int, weight double")
    ids = spark.range(first, first + len(dense)).withColumnRenamed("id", "doc_id")
    return reduce.with_empty(to_vectors(cells, "weight"), ids)


def _dense(n=60, m=25, rank=5, seed=3):
    random = np.random.default_rng(seed)
    dense = random.random((n, rank)) @ random.random((rank, m)) * (random.random((n, m)) < 0.5)
    dense[7] = 0
    return dense


@pytest.mark.parametrize("method", ["svd", "pca"])
def test_table_basis_against_numpy(spark, tmp_path, monkeypatch, method):
    dense = _dense()
    rows = _frame(spark, dense)
    monkeypatch.setattr(reduce, "SENT_CELLS", 1)
    monkeypatch.setattr(factor, "BLOCK_CELLS", 100)
    fitted = reduce.fit_reducer(rows, 60, 25, 3, method, residual=1e-6)
    x = dense - dense.mean(axis=0) if method == "pca" else dense
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    np.testing.assert_allclose(fitted.singular_values, s[:3], rtol=1e-6)
    ratio = (x @ vt[:3].T).var(axis=0) / dense.var(axis=0).sum()
    np.testing.assert_allclose(fitted.explained_variance_ratio, ratio, rtol=1e-3)
    reduce.save_reducer(spark, fitted, str(tmp_path / "m"))
    loaded = reduce.load_reducer(spark, str(tmp_path / "m"))
    got = {r.doc_id: r.vector for r in reduce.project(rows, loaded).collect()}
    mine, want = np.array([got[i] for i in range(60)]), x @ vt[:3].T
    np.testing.assert_allclose(np.abs(mine), np.abs(want), atol=1e-3)
    loadings = np.zeros((25, 3))
    for r in loaded.basis.collect():
        loadings[r.i] = r.loadings
    np.testing.assert_allclose(loadings.T @ loadings, np.eye(3), atol=1e-9)
    assert (loadings[np.abs(loadings).argmax(axis=0), np.arange(3)] > 0).all()


def test_table_basis_of_few_dimensions(spark, monkeypatch):
    """Fewer dimensions than components, equal values, and no cells at all."""
    monkeypatch.setattr(reduce, "SENT_CELLS", 1)
    same = reduce.fit_reducer(_frame(spark, np.eye(4)), 4, 4, 10, "svd")
    np.testing.assert_allclose(same.singular_values, np.ones(4), atol=1e-6)
    flat = np.outer(np.arange(1, 9), [1.0, 2, 0, 3])
    one = reduce.fit_reducer(_frame(spark, flat), 8, 4, 2, "svd")
    np.testing.assert_allclose(one.singular_values[0], np.linalg.norm(flat), rtol=1e-6)
    assert abs(one.singular_values[1:]).max(initial=0) < 1e-3
    got = {r.doc_id: r.vector for r in reduce.project(_frame(spark, flat), one).collect()}
    assert [round(abs(got[i][0]), 6) for i in range(8)] == [round(float(np.linalg.norm(r)), 6) for r in flat]


def test_many_features_run(spark, monkeypatch):
    """Two million possible terms: no dense basis anywhere."""
    random = np.random.default_rng(1)
    cells = [(i, int(j), 1.0 + (i % 3)) for i in range(300) for j in {i % 5, *random.integers(0, 2_000_000, 8).tolist()}]
    rows = to_vectors(spark.createDataFrame(cells, "doc_id long, term_id int, weight double"), "weight")
    fitted = reduce.fit_reducer(rows, 300, 2_000_000, 2, "svd", residual=1e-2)
    assert isinstance(fitted, factor.TableReducer)
    used = sorted({j for _, j, _ in cells})
    dense = np.zeros((300, len(used)))
    for i, j, v in cells:
        dense[i, used.index(j)] = v
    np.testing.assert_allclose(fitted.singular_values, np.linalg.svd(dense, compute_uv=False)[:2], rtol=1e-3)


@pytest.mark.parametrize("method", ["svd", "pca"])
def test_merged_reducers_equal_fitting_anew(spark, tmp_path, method):
    random = np.random.default_rng(5)
    dense = random.random((50, 4)) @ random.random((4, 12))  # rank 4, 5 about a mean
    whole = reduce.fit_reducer(_frame(spark, dense), 50, 12, 6, method, residual=1e-10)
    part = reduce.fit_reducer(_frame(spark, dense[:30]), 30, 12, 6, method, residual=1e-10)
    reduce.save_reducer(spark, part, str(tmp_path / "m"))
    more = _frame(spark, dense[30:], 30)
    merged = reduce.extend_reducer(reduce.load_reducer(spark, str(tmp_path / "m")), more, 20)
    np.testing.assert_allclose(merged.singular_values, whole.singular_values, atol=1e-6)
    np.testing.assert_allclose(merged.explained_variance_ratio, whole.explained_variance_ratio, atol=1e-6)
    np.testing.assert_allclose(merged.mean, whole.mean, atol=1e-9)
    np.testing.assert_allclose(np.abs(merged.components[:3]), np.abs(whole.components[:3]), atol=1e-5)
    with pytest.raises(ValueError):
        reduce.merge_reducers(whole, reduce.fit_reducer(_frame(spark, dense), 50, 12, 2, "pca" if method == "svd" else "svd"))


def test_residual_is_reached(spark):
    dense = _dense(80, 40, 12, seed=9)
    fitted = reduce.fit_reducer(_frame(spark, dense), 80, 40, 5, "svd", residual=1e-8)
    gram = dense.T @ dense
    for v, s in zip(fitted.components, fitted.singular_values):
        assert np.linalg.norm(gram @ v - s**2 * v) <= 1e-8 * fitted.singular_values[0] ** 2 * 1.01


@pytest.mark.parametrize("method", ["svd", "pca"])
def test_frequent_terms_as_a_dense_block(spark, monkeypatch, method):
    """Terms multiplied by cells, in part and all as a block give one reducer."""
    rows, fitted = _frame(spark, _dense()), []
    for most, least in ((0, 1.0), (4, 0.1), (512, 0.0)):
        monkeypatch.setattr(reduce, "DENSE_TERMS", most)
        monkeypatch.setattr(reduce, "DENSE_PART", least)
        fitted.append(reduce.fit_reducer(rows, 60, 25, 4, method, residual=1e-8))
    for one in fitted[1:]:
        np.testing.assert_allclose(one.singular_values, fitted[0].singular_values, rtol=1e-8)
        np.testing.assert_allclose(one.components, fitted[0].components, atol=1e-6)
    np.testing.assert_allclose(fitted[0].singular_values, np.linalg.svd(_dense() - (_dense().mean(0) if method == "pca" else 0))[1][:4], rtol=1e-8)
