"""Incremental ingest that also takes changed articles: a stream of records to a log of changes.

The stream's state knows the newest record of every url, as its sequence and a digest. A
record comes out if it is new or differs from the newest one, so the store is neither read
nor rewritten, and what is read twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from newscheck.operators.ingest import required_fields, stage
from newscheck.sources.articles import ARTICLE_SCHEMA

INSERTED, UPDATED = "insert", "update"
_STATE = T.StructType().add("sequence", "long").add("digest", "string")
_CHANGED = "sequence long, change string, record array<string>"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_FIELDS = [f for f in ARTICLE_SCHEMA if f.name != "id"]
CHANGE_SCHEMA = T.StructType([*_FIELDS, T.StructField("sequence", T.LongType()), T.StructField("change", T.StringType())])


def _newest(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows of one url: the newest one, if it differs from what is known."""
    newest, place = None, None
    for frame in rows:
        # of equal sequences the record with the larger digest, whatever the order of arrival
        for sequence, digest, record in zip(frame["sequence"].tolist(), frame["digest"].tolist(), frame["record"].tolist()):
            at = (int(sequence), digest)
            if place is None or at > place:
                newest, place = record, at
    known = state.get if state.exists else None
    if known is not None and place <= (known[0], known[1]):
        return
    state.update(place)
    if known is None or known[1] != place[1]:
        change = INSERTED if known is None else UPDATED
        yield pd.DataFrame({"sequence": [place[0]], "change": [change], "record": [newest]})


def changes(records: DataFrame) -> DataFrame:
    """The changes in a stream of article records with ``sequence``, keyed by url.

    Records without title or url are left out, as are columns that are not the article
    table's; columns that are not there are null. Of several records of a url in a batch the one with
    the highest sequence counts; one older than the newest known is ignored. Another time of
    crawl alone is no change.
    """
    staged = required_fields(stage(records, keep=["sequence"]))
    given = [F.col(f.name) if f.name in staged.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in _FIELDS]
    rows = staged.select(*given, F.col("sequence").cast("long").alias("sequence"))
    digest = F.sha2(F.to_json(F.struct(*[f.name for f in _FIELDS if f.name != "crawled_at"])), 256)
    # a task turns every column of every url into pandas by itself, so the fields go as one
    record = F.array(*[F.col(f.name).cast("string") for f in _FIELDS])
    found = (
        rows.select("url", "sequence", digest.alias("digest"), record.alias("record"))
        .groupBy("url")
        .applyInPandasWithState(_newest, _CHANGED, _STATE, "update", GroupStateTimeout.NoTimeout)
    )
    fields = [F.get("record", F.lit(i)).cast(f.dataType).alias(f.name) for i, f in enumerate(_FIELDS)]
    return found.select(*fields, "sequence", "change")


def upsert_articles(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Take in everything new of a stream; changes of each batch get a folder of their own, replaced if it runs again."""
    spark = stream.sparkSession
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)  # state outside the heap; a query keeps what it began with

    def write(rows: DataFrame, batch: int) -> None:
        run = rows.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        rows.write.mode("overwrite").parquet(f"{target}/run={run}/batch={batch}")

    try:
        query = (
            changes(stream).writeStream.trigger(availableNow=True).outputMode("update")
            .option("checkpointLocation", checkpoint).foreachBatch(write).start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before)
    return query


def read_changes(spark: SparkSession, target: str) -> DataFrame:
    """All changes, with the run and batch they came in; none if nothing is stored yet."""
    schema = T.StructType([*CHANGE_SCHEMA.fields, T.StructField("run", T.StringType()), T.StructField("batch", T.LongType())])
    try:
        return spark.read.schema(schema).parquet(target)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def current_articles(spark: SparkSession, target: str) -> DataFrame:
    """The newest record of every url, from the log of changes."""
    log = read_changes(spark, target)
    newest = F.max_by(F.struct(*[F.col(c) for c in log.columns if c not in ("url", "change", "run", "batch")]), "sequence")
    return log.groupBy("url").agg(newest.alias("r"), F.count("*").alias("n_changes")).select("url", "r.*", "n_changes")
