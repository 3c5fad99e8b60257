"""Incremental ingest of articles, and upkeep of the index.

Both streams take what has arrived since the last run and stop. Their targets only
grow: each micro-batch has its own directory, and a batch that is run again (after
a failure, say) replaces its directory instead of adding to it. Batches are named
after the stream as well as their number: a stream with another checkpoint counts
from 0 again, and must not write over what an earlier one stored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from newscheck.operators.ingest import dedup_first, required_fields, skip_known_urls, stage
from newscheck.session import discard, materialize
from newscheck.sources.articles import ARTICLE_SCHEMA
from newscheck.sources.index_store import append_batch

_STORED = T.StructType([f for f in ARTICLE_SCHEMA if f.name != "id"]).add("run", "string").add("batch", "long")
_PLACE = ("run", "batch")
# Batches that are written without a stream.
NO_STREAM = "none"


def read_ingested(spark: SparkSession, target: str) -> DataFrame:
    """All ingested articles, with the ``run`` (stream) and ``batch`` (0, 1, ...) they came in."""
    return spark.read.schema(_STORED).parquet(target)


def _ingested_before(spark: SparkSession, target: str, run: str, batch: int) -> DataFrame:
    """What is stored, but for one batch; empty if there is nothing yet."""
    try:
        stored = read_ingested(spark, target)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _STORED)
    return stored.where(~((F.col("run") == run) & (F.col("batch") == batch)))


def write_batch(records: DataFrame, target: str, batch: int, run: str = NO_STREAM) -> None:
    """Stage, drop duplicates and known urls, store as ``batch`` of ``run``.

    All other batches of all runs count as known, so repeating a batch gives the same
    result. ``records`` carries ``sequence``; of equal urls the first record stays.
    """
    staged = required_fields(stage(records, keep=["sequence"]))
    fresh = materialize(dedup_first(staged, "sequence").drop("sequence"), "batch")  # joined twice
    new = skip_known_urls(fresh, _ingested_before(records.sparkSession, target, run, batch))
    columns = [
        F.col(f.name) if f.name in new.columns else F.lit(None).cast(f.dataType).alias(f.name)
        for f in _STORED
        if f.name not in _PLACE
    ]
    new.select(*columns).write.mode("overwrite").parquet(f"{target}/run={run}/batch={batch}")
    discard(fresh)


def _run(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, str, int], None]) -> StreamingQuery:
    def numbered(rows: DataFrame, batch: int) -> None:
        # the id that the checkpoint keeps; a new checkpoint has a new one
        each(rows, rows.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId"), batch)

    query = (
        stream.writeStream.trigger(availableNow=True)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(numbered)
        .start()
    )
    query.awaitTermination()
    return query


def ingest_articles(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Take in everything new of a stream of article records (with ``sequence``)."""
    return _run(stream, checkpoint, lambda records, run, batch: write_batch(records, target, batch, run))


def maintain_index(stream: DataFrame, index_path: str, checkpoint: str) -> StreamingQuery:
    """Add everything new of a stream of ``doc_id, text`` to a stored index."""
    return _run(stream, checkpoint, lambda docs, run, batch: append_batch(index_path, docs, f"{run}.{batch}"))
