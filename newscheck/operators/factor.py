"""Truncated SVD and PCA whose basis is a table: for more features than a task can hold.

Subspace iteration on X'X. The basis has a row for each term; a block of documents gets
the rows of its own terms by a join, multiplies, and hands on rows of the product, which are
summed by term in a shuffle. The driver sees (width x width) matrices only: products
of the tall tables with themselves, from which it takes the Ritz values, the residual and
the turn that makes the next basis orthonormal.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newscheck.session import discard, materialize

# Cells of documents in a block, and numbers of the basis in a partition.
BLOCK_CELLS = 1 << 20
PART_NUMBERS = 1 << 22
_ROW = "i long, z array<double>"


@dataclass(frozen=True)
class TableReducer:
    """``basis`` is ``i, loadings array<double>, mean, average``, a row for each term found; other terms count as 0."""

    method: str
    basis: DataFrame
    singular_values: np.ndarray
    explained_variance_ratio: np.ndarray
    n_docs: int
    total_variance: float


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _list(matrix: np.ndarray) -> pa.Array:
    ends = np.arange(len(matrix) + 1, dtype=np.int64) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.ascontiguousarray(matrix).ravel()))


def _product(to: np.ndarray, frm: np.ndarray, val: np.ndarray, source: np.ndarray, n: int) -> np.ndarray:
    """out[to] += val * source[frm] over all cells; ``to`` is ascending."""
    out = np.zeros((n, source.shape[1]))
    step = max(1, 2_000_000 // source.shape[1])
    for begin in range(0, len(val), step):
        part = slice(begin, begin + step)
        rows = to[part]
        starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        out[rows[starts]] += np.add.reduceat(val[part, None] * source[frm[part]], starts)
    return out


def _cells(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and value of all cells of the column ``vec``."""
    vectors = table.column("vec").combine_chunks()
    cells = vectors.flatten()
    row = np.repeat(np.arange(len(vectors)), np.diff(vectors.offsets.to_numpy()))
    return row, cells.field("i").to_numpy().astype(np.int64), cells.field("v").to_numpy()


def _random(width: int, seed: int):
    """Rows ``i`` to rows ``i, z`` of normal numbers that depend on the seed and ``i`` alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("i").to_numpy()
            z = np.array([np.random.default_rng((seed, int(i) & (1 << 64) - 1)).standard_normal(width) for i in ids]).reshape(len(ids), width)
            yield pa.RecordBatch.from_arrays([batch.column("i"), _list(z)], ["i", "z"])

    return run


def _summed(width: int):
    """Rows ``i, z``, all of one ``i`` in one partition, to one row for each ``i``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, total = np.zeros(0, np.int64), np.zeros((0, width))
        for batch in batches:
            both = np.concatenate([ids, batch.column("i").to_numpy()])
            ids, at = np.unique(both, return_inverse=True)
            rows = np.concatenate([total, _rows(batch.column("z"), width)])
            total = np.zeros((len(ids), width))
            np.add.at(total, at, rows)
        for a in range(0, len(ids), 1 << 12):
            yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + (1 << 12)]), _list(total[a : a + (1 << 12)])], ["i", "z"])

    return run


def _small(table: DataFrame, left: str, right: str, shape: tuple[int, int]) -> np.ndarray:
    """left' right of two columns of rows, summed over the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            total += _rows(batch.column(left), shape[0]).T @ _rows(batch.column(right), shape[1])
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(total.size)), "v": pa.array(total.ravel())})

    sums = table.select(left, *([right] if right != left else [])).mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v"))
    out = np.zeros(shape[0] * shape[1])
    for at, v in sums.collect():
        out[at] = v
    return out.reshape(shape)


def _turned(table: DataFrame, column: str, turn: np.ndarray, name: str) -> DataFrame:
    """``i`` and the rows of ``column`` times a small matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("i"), _list(_rows(batch.column(column), len(turn)) @ turn)], ["i", name])

    return table.select("i", column).mapInArrow(run, f"i long, {name} array<double>")


def orthonormal(gram: np.ndarray) -> np.ndarray:
    """The matrix that turns columns with these products into orthonormal ones; dependent ones go."""
    scale = 1 / np.sqrt(np.maximum(np.diag(gram), np.finfo(float).tiny))
    values, turn = np.linalg.eigh(gram * scale[:, None] * scale)
    good = values > values.max(initial=0) * len(values) * 1e-14
    return scale[:, None] * turn[:, good] / np.sqrt(values[good])


class _Documents:
    """Documents in blocks, and the terms of each."""

    def __init__(self, rows: DataFrame, block_cells: int) -> None:
        cells = rows.agg(F.sum(F.size("vec"))).first()[0] or 0
        block = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-cells // block_cells)))).alias("block")
        vector = F.col("vec").cast("array<struct<i:long,v:double>>").alias("vec")
        self.blocks = materialize(rows.select(block, "doc_id", vector), "blocks")
        self.terms = materialize(self.blocks.select("block", F.explode("vec.i").alias("i")).distinct(), "block-terms")

    def times(self, basis: DataFrame, width: int, schema: str, work) -> DataFrame:
        """``work`` of each block and the rows of ``basis`` (``i, z``) that it needs."""
        needed = self.terms.join(basis, "i").select(F.col("block").alias("b"), "i", "z")

        def run(docs: pa.Table, rows: pa.Table) -> pa.Table:
            row, term, val = _cells(docs)
            known = rows.column("i").to_numpy()
            order = np.argsort(known)
            z = _rows(rows.column("z").combine_chunks(), width)[order] if len(known) else np.zeros((1, width))
            place = np.searchsorted(known[order], term)
            place = np.minimum(place, max(len(known) - 1, 0))
            held = known[order][place] == term if len(known) else np.zeros(len(term), bool)
            return work(docs, row[held], place[held], val[held], known[order], z)

        return self.blocks.groupBy("block").cogroup(needed.groupBy("b")).applyInArrow(run, schema)

    def gram(self, basis: DataFrame, width: int, parts: int) -> DataFrame:
        """X'X times the basis: rows ``i, z``."""

        def work(docs, row, place, val, terms, z):
            y = _product(row, place, val, z, docs.num_rows)
            by_term = np.argsort(place, kind="stable")
            out = _product(place[by_term], row[by_term], val[by_term], y, max(len(terms), 1))[: len(terms)]
            return pa.table({"i": pa.array(terms, pa.int64()), "z": _list(out)})

        return self.times(basis, width, _ROW, work).repartition(parts, "i").mapInArrow(_summed(width), _ROW)

    def discard(self) -> None:
        discard(self.blocks, self.terms)


def fit_table(
    rows: DataFrame, n_docs: int, k: int, method: str, oversample: int, residual: float, gain: float, seed: int, block_cells: int = BLOCK_CELLS
) -> TableReducer:
    """As :func:`~newscheck.operators.reduce.fit_reducer`, with the basis as a table at every step.

    Ends when for the first ``k`` pairs the residual of the eigenvalue equation is at most
    ``residual`` times the largest eigenvalue, or a pass adds at most the part ``gain`` to
    the sum of their eigenvalues.
    """
    docs = _Documents(rows, block_cells)
    cells = docs.blocks.select(F.inline("vec")).groupBy("i").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    moments = materialize(cells.select("i", (F.col("s") / n_docs).alias("average"), (F.col("q") / n_docs).alias("second")), "moments")
    n_terms, variance = moments.agg(F.count("*"), F.sum(F.col("second") - F.col("average") ** 2)).first()
    width = max(1, min(k + oversample, n_terms))
    parts = max(1, -(-n_terms * width // PART_NUMBERS), rows.sparkSession.sparkContext.defaultParallelism)
    center = F.col("average") if method == "pca" else F.lit(0.0)
    mean = moments.select("i", F.array(center).alias("m"))
    q = materialize(moments.select("i").mapInArrow(_random(width, seed), _ROW), "basis")
    held = 0.0
    while True:
        first = orthonormal(_small(q, "z", "z", (width, width)))
        basis = _turned(q, "z", first, "z")
        width = first.shape[1]
        product = docs.gram(basis, width, parts).withColumnRenamed("z", "p")
        both = materialize(basis.join(product, "i").join(mean, "i"), "products")
        discard(q)
        if method == "pca":
            along = _small(both, "m", "z", (1, width))[0] * n_docs
            shift = lambda b: _rows(b.column("p"), width) - _rows(b.column("m"), 1) * along
        else:
            shift = lambda b: _rows(b.column("p"), width)

        def shifted(batches: Iterator[pa.RecordBatch], shift=shift) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column("i"), b.column("z"), _list(shift(b))], ["i", "z", "p"])

        both_shifted = both.mapInArrow(shifted, "i long, z array<double>, p array<double>")
        zz, zp, pp = (_small(both_shifted, a, b, (width, width)) for a, b in ("zz", "zp", "pp"))
        turn = orthonormal(zz)
        values, own = np.linalg.eigh(turn.T @ (zp + zp.T) / 2 @ turn)
        order = np.argsort(values)[::-1][:k]
        values, own = values[order], turn @ own[:, order]
        squares = np.einsum("ij,ij->j", own, pp @ own) - 2 * values * np.einsum("ij,ij->j", own, zp @ own) + values**2 * np.einsum("ij,ij->j", own, zz @ own)
        most = max(values.max(initial=0.0), 0.0)
        done = math.sqrt(max(squares.max(initial=0.0), 0.0)) <= max(residual, 1e-7) * most or not most
        before, held = held, values.sum()
        if done or held - before <= gain * held:
            found = materialize(_turned(both_shifted, "z", own, "loadings"), "loadings")
            discard(both)
            break
        q = materialize(both_shifted.select("i", F.col("p").alias("z")), "basis")
        discard(both)
    docs.discard()
    largest = found.select(F.posexplode("loadings").alias("j", "x")).groupBy("j").agg(F.max_by("x", F.abs("x")))
    signs = np.ones(len(values))
    for j, x in largest.collect():
        signs[j] = -1.0 if x < 0 else 1.0
    table = _turned(found, "loadings", np.diag(signs), "loadings").join(moments, "i")
    basis = materialize(table.select("i", "loadings", center.alias("mean"), "average"), "reducer")
    discard(found, moments)
    squares = np.maximum(values, 0)
    along = _small(basis.withColumn("a", F.array("average")), "a", "loadings", (1, len(values)))[0]
    spread = squares / n_docs - (0 if method == "pca" else along**2)
    ratio = spread / variance if variance and variance > 0 else np.zeros(len(values))
    return TableReducer(method, basis, np.sqrt(squares), ratio, n_docs, float(variance or 0.0))


def project_table(rows: DataFrame, reducer: TableReducer, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """``doc_id, vector``: documents in the reduced space."""
    k = len(reducer.singular_values)
    docs = _Documents(rows, block_cells)
    offset = _small(reducer.basis.withColumn("m", F.array("mean")), "m", "loadings", (1, k))[0]

    def work(table, row, place, val, terms, z):
        return pa.table({"doc_id": table.column("doc_id"), "vector": _list(_product(row, place, val, z, table.num_rows) - offset)})

    return docs.times(reducer.basis.select("i", F.col("loadings").alias("z")), k, "doc_id long, vector array<double>", work)
