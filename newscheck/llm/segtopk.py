"""Exact top-k by inner product with bounds from segment means and deviations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from newscheck.llm import blocks

# Lengths of segments, coarse to fine.
WIDTHS = (16, 8, 4, 2)
# Vectors with the best coarse bound that are scored first, to have something to compare with.
SEEDS = 32
_CHUNK = 128
_LONG = (1 << 63) - 1


def quantize(vectors: np.ndarray) -> np.ndarray:
    """``floor(256 x)`` of each component."""
    return np.floor(256.0 * vectors)


def features(vectors: np.ndarray, width: int) -> np.ndarray:
    """Of each segment the mean and the deviation, so scaled that bounds are inner products.

    In a segment, q.x = w mean(q) mean(x) + (q - mean(q)).(x - mean(x)), and the last term
    is at most the product of the two deviations. This is the same as the lower bound of
    the distance by means and deviations, for |q - x|^2 = |q|^2 + |x|^2 - 2 q.x.
    """
    parts = vectors.reshape(len(vectors), -1, width)
    mean = parts.mean(2)
    deviation = np.sqrt(((parts - mean[:, :, None]) ** 2).sum(2))
    return np.concatenate([mean * np.sqrt(width), deviation], 1)


def exact(q: np.ndarray, x: np.ndarray, small: bool) -> np.ndarray:
    """Inner products of one query with vectors of whole numbers; none is rounded."""
    if small:
        return (x @ q).astype(np.int64)
    return np.array([min(max(sum(int(a) * int(b) for a, b in zip(q, row)), -_LONG), _LONG) for row in x], np.int64)


def search_block(qid: np.ndarray, q: np.ndarray, xid: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of ``x`` for each of ``q``: bounds coarse to fine, exact scores for survivors."""
    pad = -x.shape[1] % WIDTHS[0]
    q, x = (np.pad(quantize(m), ((0, 0), (0, pad))) for m in (q, x))
    # sums of products below 2^53 are exact in doubles
    small = float(np.abs(q).max()) * float(np.abs(x).max()) * x.shape[1] < 2.0**52
    levels = [(features(q, w), features(x, w)) for w in WIDTHS]
    who, which, score = [], [], []
    for low in range(0, len(q), _CHUNK):
        coarse = levels[0][0][low : low + _CHUNK] @ levels[0][1].T
        for i, bound in enumerate(coarse, low):
            bound[xid == qid[i]] = -1e300
            seeds = np.argpartition(-bound, min(SEEDS, len(x) - 1))[:SEEDS] if len(x) > SEEDS else np.arange(len(x))
            seeds = seeds[xid[seeds] != qid[i]]
            reached = np.sort(exact(q[i], x[seeds], small))[::-1]
            least = float(reached[k - 1]) if len(reached) >= k else -np.inf
            left = np.flatnonzero(bound + 1e-9 * np.abs(bound) + 1e-6 >= least)
            left = left[xid[left] != qid[i]]
            for fq, fx in levels[1:]:
                fine = fx[left] @ fq[i]
                left = left[fine + 1e-9 * np.abs(fine) + 1e-6 >= least]
            s = exact(q[i], x[left], small)
            top = blocks.best(s, xid[left], k, smallest=False)
            who.append(np.full(len(top), i))
            which.append(left[top])
            score.append(s[top])
    return np.concatenate(who), np.concatenate(which), np.concatenate(score)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest inner products of quantized vectors.

    Every vector but the query's own id is a candidate; those whose bound stays below the
    ``k``-th score already reached are left out at the first level that shows it.

    Null vectors and those with null or non-finite components take no part; zero and
    empty ones do; shorter vectors are filled up with zeros; ties go to the smaller id;
    an empty table or one without queries gives no row. Scores beyond 64 bits are
    held at the largest.
    """
    return blocks.search(blocks.clean(vectors, zero_too=True), is_query, search_block, k, T.LongType(), smallest=False)
