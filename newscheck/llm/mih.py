"""Approximate nearest neighbours by multi-index hashing of learned binary codes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newscheck.llm import blocks

# Bound of the sample that rotations and radius are fitted on: rows.
SAMPLE = 6_000
# Rotations, each giving as many bits as a vector has components.
ROTATIONS = 2
# Share of true neighbours in the sample that the radius must reach.
REACH = 0.985
_ROUNDS = 15
_BITS = 8  # of a substring


@dataclass
class Coder:
    """Centre, rotations (components x bits) and search radius."""

    centre: np.ndarray
    turn: np.ndarray
    radius: int

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """A row of substrings (bytes) for each vector."""
        return np.packbits((vectors - self.centre) @ self.turn > 0, axis=1)


def _wide(codes: np.ndarray) -> np.ndarray:
    padded = np.zeros((len(codes), -(-codes.shape[1] // 8) * 8), np.uint8)
    padded[:, : codes.shape[1]] = codes
    return padded.view(np.uint64)


def _distances(code: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ code).sum(1).astype(np.int64)


def fit(sample: np.ndarray, k: int, rotations: int = ROTATIONS, reach: float = REACH, seed: int = 7) -> Coder:
    """Learn rotations that make signs of components keep near vectors near.

    From a random start each rotation is turned, again and again, towards the nearest
    corners of the cube. The radius is the Hamming distance within which ``reach`` of the
    ``k`` nearest neighbours of sample vectors lie; in the whole table neighbours are nearer.
    """
    random = np.random.default_rng(seed)
    centre = sample.mean(0)
    x = sample - centre
    width = x.shape[1]
    turns = []
    for _ in range(rotations):
        r = np.linalg.qr(random.normal(size=(width, width)))[0]
        for _ in range(_ROUNDS):
            u, _, v = np.linalg.svd(x.T @ np.where(x @ r > 0, 1.0, -1.0))
            r = u @ v
        turns.append(r)
    coder = Coder(centre, np.concatenate(turns, 1), 0)
    codes = _wide(coder.codes(sample))
    far = []
    for q in range(min(300, len(sample))):
        d = ((sample - sample[q]) ** 2).sum(1)
        d[q] = np.inf
        near = np.argsort(d, kind="stable")[: min(k, len(sample) - 1)]
        far.append(_distances(codes[q], codes[near]))
    far = np.concatenate(far) if far else np.zeros(0)
    coder.radius = int(np.ceil(np.quantile(far, reach))) if len(far) else 0
    return coder


class Index:
    """Codes of a shard, one table of buckets for each substring."""

    def __init__(self, coder: Coder, vectors: np.ndarray) -> None:
        self.codes = coder.codes(vectors)
        self.wide = _wide(self.codes)
        self.order = np.argsort(self.codes, axis=0, kind="stable").astype(np.int32)
        self.first = np.stack([np.searchsorted(np.sort(c), np.arange(257)) for c in self.codes.T])

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Numbers of all codes within the radius.

        A code that differs in at most ``radius`` bits differs in at most ``radius // m``
        in one of the m substrings, and for all but the first ``radius % m + 1`` of them
        one bit less need be allowed. Each substring's buckets that near are opened.
        """
        m = self.codes.shape[1]
        some = np.zeros(len(self.codes), bool)
        apart = np.bitwise_count(np.arange(256, dtype=np.uint8)[None, :] ^ code[:, None])
        for j in range(m):
            allowed = radius // m - (j > radius % m)
            for bucket in np.flatnonzero(apart[j] <= allowed):
                some[self.order[self.first[j, bucket] : self.first[j, bucket + 1], j]] = True
        found = np.flatnonzero(some)
        return found[_distances(_wide(code[None])[0], self.wide[found]) <= radius]


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, sample: int = SAMPLE) -> DataFrame:
    """``query_id, rank, vec_id, score``: about the ``k`` nearest of all vectors (Euclidean) to each query.

    Rotated binary codes are learned from at most ``sample`` vectors (smallest hash). Every
    vector is indexed in its shard; for a query all codes within the learned radius are
    found by their substrings and ranked by their exact distance. Where a shard has fewer
    than ``k`` within the radius, it is widened until ``k`` or all are found.

    Null and zero vectors and those with null or non-finite components take no part;
    shorter vectors are filled up with zeros; ties go to the smaller id; an empty table
    or one without queries gives no row.
    """
    rows = blocks.clean(vectors, zero_too=False)
    drawn = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(sample).toPandas()
    width = max([len(v) for v in drawn["v"]], default=1)
    coder = fit(blocks.stack(drawn["v"], width), k) if len(drawn) else Coder(np.zeros(1), np.eye(1), 0)

    def find(qid, q, xid, x, k):  # noqa: ANN001, ANN202
        wide = max(width, q.shape[1])
        here = coder
        if wide > width:  # components the sample did not have have no bits
            grown = np.zeros((wide, coder.turn.shape[1]))
            grown[:width] = coder.turn
            here = Coder(np.pad(coder.centre, (0, wide - width)), grown, coder.radius)
        index, codes = Index(here, x), here.codes(q)
        who, which, score = [], [], []
        for i in range(len(q)):
            radius, bits = here.radius, codes.shape[1] * _BITS
            need = min(k, int((xid != qid[i]).sum()))
            while True:
                found = index.within(codes[i], radius)
                found = found[xid[found] != qid[i]]
                if len(found) >= need or radius >= bits:
                    break
                radius = min(bits, radius + codes.shape[1])
            d = np.sqrt(((x[found] - q[i]) ** 2).sum(1))
            top = blocks.best(d, xid[found], k, smallest=True)
            who.append(np.full(len(top), i))
            which.append(found[top])
            score.append(d[top])
        return np.concatenate(who), np.concatenate(which), np.concatenate(score)

    return blocks.search(rows, is_query, find, k, T.DoubleType(), smallest=True)
