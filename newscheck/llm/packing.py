"""Packing of tokenized documents into sequences of equal cost."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newscheck.llm import arrays as A
from newscheck.llm import bpe
from newscheck.session import materialize

# Pieces packed together; a group's memory is a few numbers for each.
GROUP = 16_384
# Token pairs that cost as much as one token's linear work.
PAIRS_PER_TOKEN = 4096


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, keep_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids: ``doc_id, start, length, ids_crc32, doc_tokens, salt[, ids]``.

    A document's ids end with ``end_id``; it is cut every ``capacity`` ids. ``salt`` tells
    repeated rows apart.
    """
    raw = docs.sparkSession.sparkContext.broadcast(bpe.tokenizer_bytes(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.codec(raw.value)
        row = 0
        for batch in batches:
            for first, last, data, offsets in A.pieces(*A.text_buffer(batch.column("text"))):
                ids, begin, _ = coder.encode(data, offsets)
                ends = begin[1:] + np.arange(1, len(begin))  # each with its end id
                ids = np.insert(ids, begin[1:], end_id).astype("<u4")
                total = np.diff(ends, prepend=0)
                parts = -(-total // capacity)
                doc = np.repeat(np.arange(len(total)), parts)
                start = A.ragged(np.zeros(len(parts), np.int64), parts) * capacity
                length = np.minimum(total[doc] - start, capacity)
                at = (ends - total)[doc] + start
                crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(at, length)]
                arrays = [
                    batch.column("doc_id").slice(first, last - first).take(pa.array(doc)),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                    pa.array(total[doc], pa.int64()),
                    pa.array(row + doc, pa.int64()),
                ]
                if keep_ids:  # pieces follow each other, so their ids do
                    bounds = np.append(at, ends[-1:])
                    arrays.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32))))
                row += last - first
                yield pa.RecordBatch.from_arrays(arrays, names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt", *["ids"] * keep_ids]
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt long" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(A.tidy(run, "codec"), schema)


def balance(lengths: np.ndarray, capacity: int, pairs_per_token: float = PAIRS_PER_TOKEN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence, offset and estimated sequence cost of each length, longest first.

    A piece costs its length plus the square of it over ``pairs_per_token``. It goes to
    the sequence of the lowest cost that has room; if none has, a new one is begun. As
    many as the tokens need are there from the start.
    """
    order = np.argsort(-lengths, kind="stable")
    cost = lengths + lengths.astype(float) ** 2 / pairs_per_token
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    n = max(1, -(-int(lengths.sum()) // capacity))
    used, spent = [0] * n, [0.0] * n
    ready = [(0.0, s) for s in range(n)]  # by cost
    waiting: list[tuple[int, int]] = []  # too full for the present length, roomiest first
    for k in order:
        size = int(lengths[k])
        while waiting and -waiting[0][0] >= size:
            s = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (spent[s], s))
        while ready and capacity - used[ready[0][1]] < size:
            s = heapq.heappop(ready)[1]
            if used[s] < capacity:
                heapq.heappush(waiting, (used[s] - capacity, s))
        if ready:
            s = heapq.heappop(ready)[1]
        else:
            s = len(used)
            used.append(0)
            spent.append(0.0)
        sequence[k], offset[k] = s, used[s]
        used[s] += size
        spent[s] += cost[k]
        heapq.heappush(ready, (spent[s], s))
    return sequence, offset, np.array(spent)[sequence]


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, keep_ids: bool = False, group: int = GROUP
) -> DataFrame:
    """Every id of every document in one place of one sequence.

    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_cost[, ids]``
    for each piece. Full pieces fill a sequence alone; the others are dealt by a hash into
    groups of about ``group`` pieces, which are balanced apart, so the work is a shuffle
    of a few numbers for each piece. A null text is only the end id; repeated rows and
    null ids are packed like others; an empty table gives no row. ``sequence_id`` is unique, not gapless.
    """
    made = token_pieces(docs, tokenizer, capacity, end_id, keep_ids).withColumn("piece", F.monotonically_increasing_id())
    pieces = materialize(made, "pieces")
    groups = max(1, round(pieces.count() / group))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "piece"], ascending=[False, True, True, True])
        sequence, offset, cost = balance(pdf["length"].to_numpy(), capacity)
        pdf["sequence_id"] = pdf["g"] * (1 << 32) + sequence
        pdf["offset"], pdf["sequence_cost"] = offset, cost
        return pdf[names]

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_cost", "piece"]
    schema = ", ".join(f"{n} {'double' if n == 'sequence_cost' else 'long'}" for n in names)
    dealt = pieces.drop("ids").withColumn("g", F.pmod(F.xxhash64("doc_id", "start", "salt"), F.lit(groups)))
    placed = dealt.groupBy("g").applyInPandas(place, schema)
    if keep_ids:  # ids do not pass through the groups' memory
        placed = placed.join(pieces.select("piece", "ids"), "piece")
    return placed.drop("piece")
