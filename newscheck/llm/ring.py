"""Sharding by a consistent-hash ring with bounded loads, with DataFrame functions only."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from newscheck.session import materialize

# Places of each shard on the ring.
VIRTUAL_NODES = 64
# Rows of an arc that are numbered together.
RUN = 2_000
_CELLS = 1 << 12  # equal parts of the ring, for finding a key's arc by an equality join


def _position(key: Column) -> Column:
    """Place on the ring, 0 up to 2**62."""
    return F.shiftrightunsigned(F.xxhash64(key), 2)


def ring(spark, shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """``(position, shard)`` of all virtual nodes in order."""
    nodes = spark.range(shards * virtual_nodes).select(
        _position(F.concat(F.lit("node "), F.col("id").cast("string"))).alias("p"),
        (F.col("id") % shards).cast("int").alias("shard"),
    )
    return sorted((r["p"], r["shard"]) for r in nodes.collect())


def capacities(rows: int, shards: int) -> list[int]:
    """Rows each shard takes: as even as can be, the first ones one more."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def deal(counts: dict[int, int], nodes: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Runs ``(arc, first, last, shard, slot)`` of rows in ring order.

    The arc before node k belongs to its shard. Rows are taken arc by arc around the
    ring, and within an arc by rank; when the shard is full, the rest goes to the next
    node clockwise whose shard has room. ``counts`` holds arcs only, so this is a loop
    over a fixed number of nodes, whatever the number of rows.
    """
    room, used, out = list(room), [0] * len(room), []
    # first every arc fills its own shard, then what is left moves clockwise
    rest = []
    for arc in sorted(counts):
        shard = nodes[arc][1]
        take = min(counts[arc], room[shard])
        if take:
            out.append((arc, 0, take, shard, used[shard]))
            used[shard] += take
            room[shard] -= take
        if take < counts[arc]:
            rest.append((arc, take))
    for arc, first in rest:
        step = arc
        while first < counts[arc]:
            step += 1
            shard = nodes[step % len(nodes)][1]
            take = min(counts[arc] - first, room[shard])
            if take:
                out.append((arc, first, first + take, shard, used[shard]))
                used[shard] += take
                room[shard] -= take
                first += take
    return out


def assign(docs: DataFrame, shards: int = 16, virtual_nodes: int = VIRTUAL_NODES, run: int = RUN) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row of ``docs`` (``doc_id, text``).

    Law ``rows``: shards differ by at most one row. A row's place on the ring comes from
    its text, so equal texts go to one shard as far as it has room, and what does not
    fit continues clockwise to the next. ``slot`` counts from 0 in each shard without gaps.

    A null text has no bytes (size 1) and the place of the empty text. Repeated rows
    take a slot each. An empty table gives no rows. Rows are numbered in runs of an arc,
    dealt by the hash of ``doc_id``, so an arc with a third of all rows is no single task's.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = materialize(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            _position(text).alias("place"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "ring",
    )
    nodes = ring(spark, shards, virtual_nodes)
    keyed = _with_arc(narrow, nodes)
    counts = {r["arc"]: r["n"] for r in keyed.groupBy("arc").agg(F.count("*").alias("n")).collect()}  # one row for each node
    runs = deal(counts, nodes, capacities(sum(counts.values()), shards))
    salts = spark.createDataFrame([(a, max(1, -(-n // run))) for a, n in counts.items()], "arc int, salts int")
    salted = keyed.join(F.broadcast(salts), "arc").withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts")).cast("int"))
    sizes = salted.groupBy("arc", "salt").agg(F.count("*").alias("n"))
    before = sizes.withColumn(
        "base", F.coalesce(F.sum("n").over(Window.partitionBy("arc").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).drop("n")
    ranked = (
        salted.withColumn("r", F.row_number().over(Window.partitionBy("arc", "salt").orderBy("place", "doc_id", "row")) - 1)
        .join(before, ["arc", "salt"])
        .withColumn("rank", F.col("base") + F.col("r"))
    )
    plan = spark.createDataFrame(runs, "arc int, first long, last long, shard int, base_slot long")
    return (
        ranked.join(F.broadcast(plan), "arc")
        .where("rank >= first and rank < last")
        .select("doc_id", "size", "text_crc32", "shard", (F.col("base_slot") + F.col("rank") - F.col("first")).alias("slot"))
    )


def _with_arc(rows: DataFrame, nodes: list[tuple[int, int]]) -> DataFrame:
    """Number of the node at or after each row's place (behind the last: the first)."""
    width = (1 << 62) // _CELLS
    places = [p for p, _ in nodes]
    parts = []
    for cell in range(_CELLS):
        low, high = cell * width, (cell + 1) * width if cell < _CELLS - 1 else 1 << 62
        k = bisect_left(places, low)
        while low < high:
            end = min(high, places[k] + 1) if k < len(places) else high
            parts.append((cell, low, end, k % len(places)))
            low, k = end, k + 1
    schema = T.StructType([T.StructField(n, t) for n, t in (("cell", T.IntegerType()), ("low", T.LongType()), ("high", T.LongType()), ("arc", T.IntegerType()))])
    cells = rows.sparkSession.createDataFrame(parts, schema)
    return (
        rows.withColumn("cell", F.shiftright("place", 62 - 12).cast("int"))
        .join(F.broadcast(cells), "cell")
        .where("place >= low and place < high")
        .drop("cell", "low", "high")
    )
