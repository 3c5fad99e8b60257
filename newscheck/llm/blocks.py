"""Searches of a stated query set against all vectors, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

# Vectors and queries that meet in one task.
ROWS, QUERIES = 16_384, 2_048


def clean(vectors: DataFrame, zero_too: bool) -> DataFrame:
    """``vec_id, v`` (doubles) of the vectors that take part.

    Null vectors and those with a null or non-finite component do not, nor, unless
    ``zero_too``, those of length zero. Rows without an id have no place in a result.
    """
    v = F.col("embedding").cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(False))
    )
    return out if zero_too else out.where(F.exists("v", lambda x: x != 0))


def stack(values: pd.Series, width: int) -> np.ndarray:
    """Rows of a matrix; shorter vectors are filled up with zeros."""
    out = np.zeros((len(values), width))
    for k, v in enumerate(values):
        out[k, : len(v)] = v
    return out


def search(
    vectors: DataFrame,
    is_query: Column,
    nearest: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray, np.ndarray]],
    k: int,
    score: T.DataType,
    smallest: bool,
    rows: int = ROWS,
    queries: int = QUERIES,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best of all vectors for each query row.

    Vectors are dealt by id into shards of about ``rows``, queries into blocks of about
    ``queries``; each pair of a shard and a block meets in one task, which hands on only
    its ``k`` best for each query. ``nearest(query ids, queries, ids, vectors, k)`` gives
    the query numbers, vector numbers and scores found there, the query's own id left out.
    Ties go to the smaller id; a repeated id counts once for each row.
    """
    size = vectors.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q"), F.max(F.size("v")).alias("width")).first()
    shards, blocks, width = max(1, -(-size["n"] // rows)), max(1, -(-size["q"] // queries)), max(1, size["width"] or 1)
    # the row's own vector salts the id, so that a repeated id does not fill one shard
    key = F.xxhash64("vec_id", "v")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = vectors.where(is_query).withColumn("block", F.pmod(key, F.lit(blocks))).withColumn("shard", every(shards))
    right = vectors.withColumn("shard", F.pmod(key, F.lit(shards))).withColumn("block", every(blocks))

    def meet(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        qid, xid = q["vec_id"].to_numpy(), x["vec_id"].to_numpy()
        a, b, s = nearest(qid, stack(q["v"], width), xid, stack(x["v"], width), k)
        return pd.DataFrame({"query_id": qid[a], "vec_id": xid[b], "score": s})

    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", score)])
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(meet, schema)
    order = F.col("score").asc() if smallest else F.col("score").desc()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best(scores: np.ndarray, ids: np.ndarray, k: int, smallest: bool) -> np.ndarray:
    """Places of the ``k`` best scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, k - 1)[k - 1] if smallest else np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores <= edge if smallest else scores >= edge)
    else:
        some = np.arange(len(scores))
    order = np.lexsort((ids[some], scores[some] if smallest else -scores[some]))
    return some[order[:k]]
