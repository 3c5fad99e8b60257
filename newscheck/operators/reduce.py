"""Truncated SVD and PCA of sparse document vectors.

Randomised subspace iteration: every step is one pass over the documents in which
each task multiplies its own rows and hands on a (features x components) block,
summed in a tree. Such blocks are sent and summed up to a size; beyond it the basis is a
table (:mod:`newscheck.operators.factor`).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newscheck.functions.labels import label_name
from newscheck.operators.factor import TableReducer, fit_table, project_table
from newscheck.operators.terms import to_vectors
from newscheck.operators.vectors import Weights
from newscheck.session import materialize

# Components beyond those asked for, seed, dimensions of the
# hybrid vector and of the reductions done ahead of a layout.
OVERSAMPLE = 10
SEED = 42
HYBRID_DIMENSIONS = 256
TSNE_DIMENSIONS, TSNE_ABOVE = 50, 50
UMAP_DIMENSIONS, UMAP_ABOVE = 100, 1000
# The iteration ends when the residual of the eigenvalue equation of all components is at
# most so large a part of the largest eigenvalue or, if no residual is asked for, when a pass adds
# less than so large a part to the variance that the components hold.
RESIDUAL, GAIN = 1e-4, 1e-3
# Features x components that are sent to a task (32 MB); a larger basis is a table.
SENT_CELLS = 1 << 22
# Terms that so large a part of the documents has, and at most so many of them, are multiplied
# as a dense block; it is faster than by cells from about a twenty-fifth on.
DENSE_PART, DENSE_TERMS = 1 / 32, 512


@dataclass(frozen=True)
class Reducer:
    """``components`` is (k, features); ``mean`` is zero for an SVD."""

    method: str
    components: np.ndarray
    mean: np.ndarray
    singular_values: np.ndarray
    explained_variance_ratio: np.ndarray
    average: np.ndarray
    n_docs: int
    total_variance: float


def sparse_rows(weights: Weights) -> DataFrame:
    """``doc_id, vec`` of every document, written once, as it is read in every pass."""
    return materialize(with_empty(to_vectors(weights.cells, "weight"), weights.docs), "rows")


def with_empty(vectors: DataFrame, docs: DataFrame) -> DataFrame:
    """Add an empty vector for every ``doc_id`` of ``docs`` that has none."""
    empty = F.array().cast("array<struct<i:int,v:double>>")
    joined = docs.select("doc_id").join(vectors, "doc_id", "left")
    return joined.select("doc_id", F.coalesce("vec", empty).alias("vec"))


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    vectors = batch.column("vec")
    cells = vectors.flatten()
    row = np.repeat(np.arange(len(vectors)), np.diff(vectors.offsets.to_numpy()))
    return row, cells.field("i").to_numpy(), cells.field("v").to_numpy(), len(vectors)


def _product(
    to: np.ndarray, frm: np.ndarray, val: np.ndarray, source: np.ndarray, n: int
) -> np.ndarray:
    """out[to] += val * source[frm] over all cells; ``to`` is ascending."""
    out = np.zeros((n, source.shape[1]))
    step = max(1, 4_000_000 // source.shape[1])
    for begin in range(0, len(val), step):
        part = slice(begin, begin + step)
        rows = to[part]
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        out[rows[starts]] += np.add.reduceat(val[part, None] * source[frm[part]], starts)
    return out


def _tree_sum(rows: DataFrame, shape: tuple[int, int], block) -> np.ndarray:
    """Sum of ``block(batch)`` over all batches."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            part = block(batch)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"sum": [total.tobytes()]})

    sums = rows.select("vec").mapInArrow(partial, "sum binary").rdd
    parts = sums.map(lambda r: np.frombuffer(bytes(r[0])))
    return parts.treeAggregate(np.zeros(shape).ravel(), np.add, np.add).reshape(shape)


def _orient(components: np.ndarray) -> np.ndarray:
    """Fix signs: the largest loading of every component is positive."""
    largest = np.abs(components).argmax(axis=1)
    signs = np.sign(components[np.arange(len(components)), largest])
    return components * np.where(signs == 0, 1, signs)[:, None]


def fit_reducer(
    rows: DataFrame, n_docs: int, n_features: int, k: int, method: str = "svd", residual: float | None = None
) -> Reducer | TableReducer:
    """Fit on ``doc_id, vec``, one row per document.

    Ends at :data:`RESIDUAL` or :data:`GAIN`, whichever is met first; with a ``residual``, at that alone.

    A basis above :data:`SENT_CELLS` numbers is kept as a table and neither sent nor
    brought to the driver.
    """
    if method not in ("svd", "pca"):
        raise ValueError(f"unknown method {method!r}: use 'svd' or 'pca'")
    width = min(k + OVERSAMPLE, n_features)
    if n_features * width > SENT_CELLS:
        ends = (RESIDUAL, GAIN) if residual is None else (residual, -1.0)
        return fit_table(rows, n_docs, k, method, OVERSAMPLE, *ends, SEED)
    context = rows.sparkSession.sparkContext

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        _, idx, val, _ = _flat(batch)
        return np.stack(
            [np.bincount(idx, v, n_features) for v in (val, val**2, np.ones(len(val)))], axis=1
        )

    first, second, part = _tree_sum(rows, (n_features, 3), moments).T / n_docs
    often = np.argsort(-part, kind="stable")[:DENSE_TERMS]
    often = often[part[often] >= DENSE_PART]
    place = np.full(n_features, -1)
    place[often] = np.arange(len(often))
    mean = first if method == "pca" else np.zeros(n_features)
    total_variance = (second - first**2).sum()

    def gram(q: np.ndarray) -> np.ndarray:
        """(X'X - N mean mean') q"""
        sent = context.broadcast(q)

        def block(batch: pa.RecordBatch) -> np.ndarray:
            row, idx, val, n = _flat(batch)
            at = place[idx]
            held = at >= 0
            dense = np.zeros((n, len(often)))
            np.add.at(dense, (row[held], at[held]), val[held])
            row, idx, val = row[~held], idx[~held], val[~held]
            y = _product(row, idx, val, sent.value, n) + dense @ sent.value[often]
            by_term = np.argsort(idx, kind="stable")
            out = _product(idx[by_term], row[by_term], val[by_term], y, n_features)
            out[often] += dense.T @ y
            return out

        product = _tree_sum(rows, q.shape, block)
        sent.unpersist()
        return product - n_docs * np.outer(mean, mean @ q)

    gain, residual = (GAIN, RESIDUAL) if residual is None else (-1.0, residual)
    held = 0.0
    q = np.linalg.qr(np.random.default_rng(SEED).standard_normal((n_features, width)))[0]
    while True:
        product = gram(q)
        values, turn = np.linalg.eigh(q.T @ product)
        order = np.argsort(values)[::-1][:k]
        left = product @ turn[:, order] - q @ (turn[:, order] * values[order])
        # rounding leaves about the part 1e-12 of the largest
        if np.linalg.norm(left, axis=0).max() <= max(residual, 1e-10) * max(values.max(), 0):
            break
        before, held = held, values[order].sum()
        if held - before <= gain * held:
            break
        q = np.linalg.qr(product)[0]
    components = _orient((q @ turn[:, order]).T)
    squares = np.maximum(values[order], 0)
    variance = squares / n_docs - (0 if method == "pca" else (components @ first) ** 2)
    ratio = variance / total_variance if total_variance > 0 else np.zeros(len(order))
    return Reducer(method, components, mean, np.sqrt(squares), ratio, first, n_docs, float(total_variance))


def merge_reducers(one: Reducer, other: Reducer, k: int | None = None) -> Reducer:
    """The reducer of both sets of documents, from their reducers alone.

    Both are of one method and one vocabulary. The scaled bases side by side (for PCA with
    the step between the means) have the singular values of all documents, so far as the parts
    kept theirs: with as many components as the rank it is what fitting anew gives,
    else what the parts dropped is missing.
    """
    if one.method != other.method or one.components.shape[1] != other.components.shape[1]:
        raise ValueError("reducers of different methods or vocabularies")
    n = one.n_docs + other.n_docs
    if not one.n_docs or not other.n_docs:
        return one if one.n_docs else other
    average = (one.n_docs * one.average + other.n_docs * other.average) / n
    step = one.average - other.average
    columns = [one.components.T * one.singular_values, other.components.T * other.singular_values]
    if one.method == "pca":
        columns.append(np.sqrt(one.n_docs * other.n_docs / n) * step[:, None])
    basis, values, _ = np.linalg.svd(np.concatenate(columns, axis=1), full_matrices=False)
    k = min(k or max(len(one.components), len(other.components)), len(values))
    components, values = _orient(basis[:, :k].T), values[:k]
    total = (one.n_docs * one.total_variance + other.n_docs * other.total_variance) / n
    total += one.n_docs * other.n_docs / n**2 * float(step @ step)
    variance = values**2 / n - (0 if one.method == "pca" else (components @ average) ** 2)
    ratio = variance / total if total > 0 else np.zeros(k)
    mean = average if one.method == "pca" else np.zeros(len(average))
    return Reducer(one.method, components, mean, values, ratio, average, n, total)


def extend_reducer(reducer: Reducer, rows: DataFrame, n_docs: int) -> Reducer:
    """A saved reducer after ``n_docs`` more documents (``doc_id, vec``, same vocabulary); the old ones are not read."""
    k, n_features = reducer.components.shape
    return merge_reducers(reducer, fit_reducer(rows, n_docs, n_features, k, reducer.method), k)


def project(rows: DataFrame, reducer: Reducer | TableReducer) -> DataFrame:
    """``doc_id, vector``: documents in the reduced space; no shuffle unless the basis is a table."""
    if isinstance(reducer, TableReducer):
        return project_table(rows, reducer)
    q = np.ascontiguousarray(reducer.components.T)
    shift = reducer.mean @ q
    sent = rows.sparkSession.sparkContext.broadcast((q, shift))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            loadings, offset = sent.value
            row, idx, val, n = _flat(batch)
            scores = _product(row, idx, val, loadings, n) - offset
            offsets = np.arange(len(scores) + 1) * scores.shape[1]
            vectors = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(scores.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), vectors], ["doc_id", "vector"])

    return rows.select("doc_id", "vec").mapInArrow(reduce, "doc_id long, vector array<double>")


def reduce_dimensions(weights: Weights, k: int = 2, method: str = "svd") -> DataFrame:
    """``doc_id, vector`` of all documents.

    For 'tsne' and 'umap' only the reduction ahead of the layout is done.
    """
    rows = sparse_rows(weights)
    n_features = weights.vocab.count()
    ahead = {"tsne": (TSNE_DIMENSIONS, TSNE_ABOVE), "umap": (UMAP_DIMENSIONS, UMAP_ABOVE)}
    if method in ahead:
        size, above = ahead[method]
        k, method = (size if n_features > above else n_features), "svd"
    return project(rows, fit_reducer(rows, weights.n_docs, n_features, k, method))


def hybrid_reducer(
    weights: Weights, rows: DataFrame, method: str = "SVD", n_components: int = HYBRID_DIMENSIONS
) -> Reducer:
    """Reducer of the hybrid detector.

    The t-SNE choice keeps only its SVD; UMAP, whose layout is not built, falls back to SVD.
    """
    n_features = weights.vocab.count()
    k = max(1, min(n_components, n_features - 1, weights.n_docs - 1))
    if method == "t-SNE":
        k = max(1, min(TSNE_DIMENSIONS, n_features - 1))
    kinds = {"SVD": "svd", "PCA": "pca", "UMAP": "svd", "t-SNE": "svd"}
    if method not in kinds:
        raise ValueError(f"unknown method {method!r}: use one of {sorted(kinds)}")
    return fit_reducer(rows, weights.n_docs, n_features, k, kinds[method])


def component_table(spark: SparkSession, reducer: Reducer | TableReducer) -> DataFrame:
    """``component, singular_value, explained_variance_ratio, loadings``: the model as rows.

    A basis that is a table has its loadings by term, in ``reducer.basis``, and here null.
    """
    schema = "component int, singular_value double, explained_variance_ratio double, loadings array<double>"
    rows = [
        (i, float(s), float(ratio), reducer.components[i].tolist() if isinstance(reducer, Reducer) else None)
        for i, (s, ratio) in enumerate(zip(reducer.singular_values, reducer.explained_variance_ratio))
    ]
    return spark.createDataFrame(rows, schema)


def save_reducer(spark: SparkSession, reducer: Reducer | TableReducer, path: str) -> None:
    component_table(spark, reducer).write.parquet(f"{path}/components")
    large = isinstance(reducer, TableReducer)
    if large:
        reducer.basis.write.parquet(f"{path}/basis")
    none: list[float] = []
    mean, average = (none, none) if large else (reducer.mean.tolist(), reducer.average.tolist())
    config = [(reducer.method, mean, average, reducer.n_docs, reducer.total_variance, large)]
    schema = "method string, mean array<double>, average array<double>, n_docs long, total_variance double, large boolean"
    spark.createDataFrame(config, schema).write.parquet(f"{path}/config")


def load_reducer(spark: SparkSession, path: str) -> Reducer | TableReducer:
    """Read a saved model back: k rows of bounded size, or a basis that stays a table."""
    rows = spark.read.parquet(f"{path}/components").orderBy("component").collect()
    c = spark.read.parquet(f"{path}/config").first()
    values = np.array([r["singular_value"] for r in rows])
    ratio = np.array([r["explained_variance_ratio"] for r in rows])
    if c["large"]:
        basis = spark.read.parquet(f"{path}/basis")
        return TableReducer(c["method"], basis, values, ratio, c["n_docs"], c["total_variance"])
    components, mean, average = (np.array(x) for x in ([r["loadings"] for r in rows], c["mean"], c["average"]))
    return Reducer(c["method"], components, mean, values, ratio, average, c["n_docs"], c["total_variance"])


def plot_points(reduced: DataFrame, articles: DataFrame, by_source: bool = False) -> DataFrame:
    """``doc_id, x, y[, z], is_fake, label, source``: coordinates matched to articles by id.

    By source, unlabelled articles are left out.
    """
    shown = articles.select(F.col("id").alias("doc_id"), "is_fake", "source")
    if by_source:
        shown = shown.where("is_fake in (0, 1)")
    axes = [F.get("vector", F.lit(i)).alias(a) for i, a in enumerate("xyz")]
    return reduced.join(shown, "doc_id").select(
        "doc_id", *axes, "is_fake", label_name(F.col("is_fake")).alias("label"), "source"
    )
