"""Nearest-neighbour graph by cosine similarity: exact, or by neighbour descent for many points."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newscheck.operators.topk import _best
from newscheck.session import discard, materialize

# Fixed value: neighbours of the graph, a point itself being the first.
NEIGHBOURS = 15
# Neighbour descent: neighbours kept for each one asked for, random starts, points that are
# compared with each other in a start, and the share of changed edges at which it ends.
POOL, STARTS, BUCKET, FEW = 2, 4, 512, 0.001
SEED = 42
# Exact graph: components of a block of points, at most (a task holds a block of each side as stored, 8 bytes
# a component at most); points of one side, and of the other, that are scored at a time; decimals of a cosine.
BLOCK_CELLS = 8_000_000
STEP, SLICE = 256, 16_384
DIGITS = 6
_EDGES = "u long, w long, s double"


def _with_length(vector: str, kind: str) -> Column:
    """Components as they are stored, null and NaN ones as 0, and the length: a few bytes a component."""
    zero = F.lit(0.0).cast(kind)
    values = F.transform(F.coalesce(vector, F.array().cast(f"array<{kind}>")), lambda v: F.nanvl(F.coalesce(v.cast(kind), zero), zero))
    length = F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return F.struct(values.alias("x"), length.alias("length"))


def _matrix(vectors: pa.StructArray, width: int) -> np.ndarray:
    """Unit vectors as rows; shorter ones are filled up with zeros, and so are those of length 0."""
    x, length = vectors.field("x"), vectors.field("length").to_numpy()[:, None]
    sizes = np.diff(x.offsets.to_numpy())
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = x.flatten().to_numpy()
    return np.divide(out, length, out=np.zeros_like(out), where=length != 0)


def graph_blocks(n: int, width: int, cores: int) -> int:
    """Blocks that ``n`` points are dealt to, on either side of all pairs."""
    blocks = max(1, math.ceil(n * max(1, width) / BLOCK_CELLS))
    # small inputs: smaller blocks, so that every core gets several pairs
    lack = 4 * cores / blocks**2
    return min(math.ceil(blocks * lack**0.5), math.ceil(n / STEP) or 1) if lack > 1 else blocks


def _stored(block: pa.Table) -> tuple[np.ndarray, pa.StructArray]:
    """Ids in order, and the vectors in that order."""
    block = block.sort_by(block.column_names[0])
    return block.column(0).to_numpy(), block.column(1).combine_chunks()


def _near(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """The ``k`` best right points of every left one (``id, vector``), in slices of some million scores."""
    columns = []
    if left.num_rows and right.num_rows:
        (l_ids, l_vec), (r_ids, r_vec) = _stored(left), _stored(right)
        width = max(1, *(int(np.diff(v.field("x").offsets.to_numpy()).max()) for v in (l_vec, r_vec)))
        beat, found = np.full(len(l_ids), -np.inf), []
        for begin in range(0, len(r_ids), SLICE):
            ids, columns_of = r_ids[begin : begin + SLICE], _matrix(r_vec[begin : begin + SLICE], width).T
            for start in range(0, len(l_ids), STEP):
                to_beat = beat[start : start + STEP]
                scores = _matrix(l_vec[start : start + STEP], width) @ columns_of
                at, other, value = _best(scores, ids, k, -np.inf, to_beat, DIGITS)
                found.append((start + at, other, value))
                # the k-th score of this slice, for the slices after it
                last = np.flatnonzero(np.bincount(at, minlength=len(to_beat)) == k)
                to_beat[last] = value[np.searchsorted(at, last, "right") - 1]
        row, other, value = (np.concatenate(part) for part in zip(*found))
        order = np.lexsort((other, -value, row))
        row, other, value = row[order], other[order], value[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        columns = [l_ids[row[keep]], other[keep], value[keep]]
    types = (pa.int64(), pa.int64(), pa.float64())
    return pa.table([pa.array(c, t) for c, t in zip(columns or [[], [], []], types)], ["left_id", "right_id", "score"])


def knn_graph(
    points: DataFrame, id_column: str, vector: str, k: int = NEIGHBOURS, n_points: int | None = None
) -> DataFrame:
    """``vec_id, neighbour_id, rank, cosine``: exact k nearest points of every point.

    Points are dealt to blocks and all pairs of blocks are brought together. Vectors are copied
    as they are stored, once for each block of the other side; a task hands on the k best of its pair.
    """
    kind = "float" if dict(points.dtypes)[vector] == "array<float>" else "double"
    unit = points.select(F.col(id_column).alias("id"), _with_length(vector, kind).alias("v"))
    n, width = unit.agg(F.count("*"), F.max(F.size("v.x"))).first()
    blocks = graph_blocks(n if n_points is None else n_points, width or 1, points.sparkSession.sparkContext.defaultParallelism)
    block, every = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    lefts = unit.select(F.col("id").alias("l_id"), F.col("v").alias("l_v"), block.alias("lb"), every.alias("rb"))
    rights = unit.select(F.col("id").alias("r_id"), F.col("v").alias("r_v"), every.alias("r_lb"), block.alias("r_rb"))

    def multiply(a: pa.Table, b: pa.Table) -> pa.Table:
        return _near(a.select(["l_id", "l_v"]), b.select(["r_id", "r_v"]), k)

    found = lefts.groupBy("lb", "rb").cogroup(rights.groupBy("r_lb", "r_rb")).applyInArrow(multiply, "left_id long, right_id long, score double")
    order = W.partitionBy("left_id").orderBy(F.desc("score"), "right_id")
    ranked = found.withColumn("score", F.round("score", DIGITS)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(
        F.col("left_id").alias("vec_id"),
        F.col("right_id").alias("neighbour_id"),
        "rank",
        F.col("score").alias("cosine"),
    )


def _codes(width: int, bits: int, starts: int):
    """Rows ``id, v`` to rows ``id, start, code``: the sides of random planes through the origin."""
    planes = np.random.default_rng(SEED).standard_normal((width, starts * bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            side = (_matrix(batch.column("v"), width) @ planes > 0).reshape(n, starts, bits)
            code = (side * (1 << np.arange(bits))).sum(2).astype(np.int64)
            ids = np.repeat(batch.column("id").to_numpy(), starts)
            start = np.tile(np.arange(starts, dtype=np.int32), n)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(start), pa.array(code.ravel())], ["id", "start", "code"])

    return run


def _edges(u: np.ndarray, w: np.ndarray, s: np.ndarray) -> dict[str, pa.Array]:
    return {"u": pa.array(u, pa.int64()), "w": pa.array(w, pa.int64()), "s": pa.array(s, pa.float64())}


def _started(points: DataFrame, n: int, width: int, keep: int) -> DataFrame:
    """First edges: the ``keep`` best of every point within its buckets of random codes.

    A bucket above :data:`BUCKET` points, as many equal vectors make it, is cut by a hash.
    """
    bits = min(62, max(1, math.ceil(math.log2(max(2.0, n / BUCKET)))))
    coded = materialize(points.select("id", "v").mapInArrow(_codes(width, bits, STARTS), "id long, start int, code long"), "codes")
    sizes = coded.groupBy("start", "code").agg(F.ceil(F.count("*") / BUCKET).alias("parts"))
    dealt = coded.join(sizes, ["start", "code"]).withColumn("part", F.pmod(F.xxhash64("id", "start"), F.col("parts")))

    def compare(bucket: pa.Table) -> pa.Table:
        ids, m = bucket.column("id").to_numpy(), _matrix(bucket.column("v").combine_chunks(), width)
        near = m @ m.T
        np.fill_diagonal(near, -np.inf)
        k = min(keep, len(ids) - 1)
        best = np.argpartition(-near, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(ids), 0), int)
        row = np.repeat(np.arange(len(ids)), k)
        return pa.table(_edges(ids[row], ids[best.ravel()], near[row, best.ravel()]))

    met = dealt.join(points.select("id", "v"), "id").groupBy("start", "code", "part").applyInArrow(compare, _EDGES)
    first = materialize(_kept(met.withColumn("fresh", F.lit(True)), keep), "edges")
    discard(coded)
    return first


def _kept(edges: DataFrame, keep: int) -> DataFrame:
    """Each edge once, fresh if it is new, and the ``keep`` best of every point."""
    once = edges.groupBy("u", "w").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"))
    best = W.partitionBy("u").orderBy(F.desc("s"), "w")
    return once.withColumn("n", F.row_number().over(best)).where(F.col("n") <= keep).drop("n")


def _met(width: int):
    """Rows ``v, w, fresh, least, x`` (vector of w), those of one ``v`` in a row, to pairs of its ``w`` that are better than ``least``."""

    def pairs(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, least = rows.column("w").to_numpy(), rows.column("least").to_numpy()
        fresh = rows.column("fresh").to_numpy(zero_copy_only=False)
        m = _matrix(rows.column("x"), width)
        v = rows.column("v").to_numpy()
        cuts = np.append(np.flatnonzero(np.append(True, v[1:] != v[:-1])), len(v))
        found = []
        for a, b in zip(cuts, cuts[1:]):
            if fresh[a:b].any():
                near = m[a:b] @ m[a:b].T
                good = (near > least[a:b, None]) & (fresh[a:b, None] | fresh[None, a:b])
                np.fill_diagonal(good, False)
                i, j = np.nonzero(good)
                found.append((ids[a + i], ids[a + j], near[i, j]))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("v").to_numpy()
            first = int(np.searchsorted(v, v[-1]))  # the last one may go on in the next batch
            if first:
                whole = pa.Table.from_batches([*held, batch.slice(0, first)]).combine_chunks().to_batches()
                held = []
                for part in whole:
                    yield pa.RecordBatch.from_pydict(_edges(*pairs(part)))
            held.append(batch.slice(first))
        for part in pa.Table.from_batches(held).combine_chunks().to_batches() if held else ():
            yield pa.RecordBatch.from_pydict(_edges(*pairs(part)))

    return run


def _round(edges: DataFrame, points: DataFrame, width: int, keep: int) -> DataFrame:
    """Edges after every point has introduced its neighbours, in both directions, to each other."""
    back = W.partitionBy("w").orderBy(F.desc("s"), "u")
    # best edges that lead to a point, as many as lead away from it
    rev = edges.withColumn("n", F.row_number().over(back)).where(F.col("n") <= keep)
    both = edges.select(F.col("u").alias("v"), "w", "fresh").union(rev.select(F.col("w").alias("v"), F.col("u").alias("w"), "fresh"))
    both = both.groupBy("v", "w").agg(F.max("fresh").alias("fresh"))
    least = edges.groupBy("u").agg(F.when(F.count("*") >= keep, F.min("s")).otherwise(-2.0).alias("least"))
    known = points.join(least, points["id"] == least["u"], "left").select(
        F.col("id").alias("w"), F.col("v").alias("x"), F.coalesce("least", F.lit(-2.0)).alias("least")
    )
    met = both.join(known, "w").select("v", "w", "fresh", "least", "x").repartition("v").sortWithinPartitions("v")
    new = met.mapInArrow(_met(width), _EDGES).groupBy("u", "w").agg(F.max("s").alias("s")).withColumn("fresh", F.lit(True))
    return _kept(edges.withColumn("fresh", F.lit(False)).union(new), keep)


def knn_descent(
    points: DataFrame, id_column: str, vector: str, k: int = NEIGHBOURS, pool: int = POOL, few: float = FEW
) -> DataFrame:
    """``vec_id, neighbour_id, rank, cosine`` as :func:`knn_graph` has them, by neighbour descent.

    For more points than can all be compared: work grows with points x (``pool`` x ``k``)
    squared x rounds. Points start with the best of some buckets of random projections; in
    each round every point introduces its neighbours (those it has and those that have it,
    ``pool`` x ``k`` each) to each other, until at most a share ``few`` of the edges is
    new. Cosines are exact, neighbours approximate. Ids are unique.
    """
    keep = pool * k
    kind = "float" if dict(points.dtypes)[vector] == "array<float>" else "double"
    unit = materialize(points.select(F.col(id_column).cast("long").alias("id"), _with_length(vector, kind).alias("v")), "unit")
    n, width = unit.agg(F.count("*"), F.max(F.size("v.x"))).first()
    edges = _started(unit, n, width or 1, keep)
    while edges.where("fresh").count() > few * keep * n:
        further = materialize(_round(edges, unit, width, keep), "edges")
        discard(edges)
        edges = further
    part = lambda v: F.coalesce(v.cast("double") / F.nullif(F.col("v.length"), F.lit(0.0)), F.lit(0.0))
    square = F.aggregate("v.x", F.lit(0.0), lambda s, v: s + part(v) * part(v))
    own = unit.select(F.col("id").alias("u"), F.col("id").alias("w"), square.alias("s"))
    order = W.partitionBy("u").orderBy(F.desc("cosine"), "w")
    every = edges.select("u", "w", "s").union(own).withColumn("cosine", F.round("s", 6))
    best = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select(F.col("u").alias("vec_id"), F.col("w").alias("neighbour_id"), "rank", "cosine")
