"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newscheck.session import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b``): the smallest node it reaches.

    Each round every node points to the smallest of itself and its neighbours, pointers
    are followed twice, and the edges are drawn between what they lead to; a star is done
    in one round. A round's tables are deleted when the next ones are written. Neighbours are only ever reduced to their minimum, so a node with a
    third of all edges is no single task's. Ends when no edge is left.
    """
    left = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    roots = left.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    written: list[DataFrame] = []
    while not left.isEmpty():
        both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("v"), F.least("a", "b").alias("p"))
        for _ in range(2):
            further = up.select(F.col("v").alias("p"), F.col("p").alias("q"))
            up = up.join(further, "p", "left").select("v", F.coalesce("q", "p").alias("p"))
        up = materialize(up, "pointers")
        old = [left, up, *written]
        roots = materialize(
            roots.join(up, roots["root"] == up["v"], "left").select("node", F.coalesce("p", "root").alias("root")), "roots"
        )
        written = [roots]
        ends = left.join(up.select(F.col("v").alias("a"), F.col("p").alias("x")), "a").join(
            up.select(F.col("v").alias("b"), F.col("p").alias("y")), "b"
        )
        left = materialize(ends.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).where("a <> b").distinct(), "edges")
        discard(*old)
    return roots
