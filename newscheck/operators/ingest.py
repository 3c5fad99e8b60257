"""Staging, duplicate removal and merging of article records.

Duplicates are dropped by ranking within the key and keeping rank 1. Spark applies
such a limit before the shuffle too, so a key that makes up a third of the rows
leaves one row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newscheck.operators.terms import dense_index
from newscheck.session import materialize
from newscheck.sources.articles import ARTICLE_SCHEMA, KEY


def stage(records: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Keep the columns of the article table (not its id); an empty string becomes NULL.

    ``keep`` names further columns to carry along, such as the ingest sequence.
    """
    columns = []
    for column in ARTICLE_SCHEMA:
        if column.name == "id" or column.name not in records.columns:
            continue
        value = F.col(column.name)
        if isinstance(column.dataType, T.StringType):
            value = F.nullif(value, F.lit(""))
        columns.append(value.alias(column.name))
    return records.select(*columns, *keep)


def _one_per_key(records: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return records.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def dedup_latest(records: DataFrame, sequence: str, keys: Sequence[str] = KEY) -> DataFrame:
    """Last record of every key by ingest sequence. NULL keys count as equal."""
    return _one_per_key(records, keys, [F.desc(sequence)])


def dedup_first(records: DataFrame, sequence: str, keys: Sequence[str] = ("url",)) -> DataFrame:
    """First record of every key by ingest sequence."""
    return _one_per_key(records, keys, [F.asc(sequence)])


def append_keep_last(
    old: DataFrame,
    new: DataFrame,
    sequence: str,
    keys: Sequence[str] = ("url", "title", "content"),
) -> DataFrame:
    """Append, keep the last of equal records, drop those without content."""
    both = old.unionByName(new, allowMissingColumns=True)
    # rows without content go first: they are dropped whatever their rank
    return dedup_latest(both.where(F.col("content").isNotNull()), sequence, keys)


def _not_stored(records: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Records whose key is not stored. A NULL in a key matches nothing.

    The stored keys are first cut down to those of the batch. For that semi-join Spark
    may broadcast the batch, if it is small, so a large store is only scanned; in an
    anti-join alone it could only broadcast the store and would shuffle it instead.
    """
    keys = list(keys)
    seen = stored.select(*keys).join(records.select(*keys), keys, "left_semi")
    return records.join(seen, keys, "left_anti")


def skip_known_urls(records: DataFrame, known: DataFrame) -> DataFrame:
    """Records whose url is not stored yet; a missing url is never known."""
    return _not_stored(records, known, ["url"])


def required_fields(records: DataFrame, names: Sequence[str] = ("title", "url")) -> DataFrame:
    """Drop records where a required field is missing or empty."""
    present = F.lit(True)
    for name in names:
        present = present & F.coalesce(F.col(name) != "", F.lit(False))
    return records.where(present)


def tag_by_source(records: DataFrame, rules: DataFrame, crawled_at: Column | None = None) -> DataFrame:
    """Add source name, default label and crawl time.

    ``rules`` is ``site, source, is_fake``, one row per ``site`` of the records.
    """
    at = F.current_timestamp().cast("timestamp_ntz") if crawled_at is None else crawled_at
    return records.join(rules, "site", "left").drop("site").withColumn("crawled_at", at)


def _next_id(target: DataFrame) -> int:
    return (target.agg(F.max("id")).first()[0] or 0) + 1


def merge_articles(
    target: DataFrame, batch: DataFrame, sequence: str, mode: str = "upsert"
) -> DataFrame:
    """The article table after merging a batch of records on (url, title).

    ``upsert``: an existing row keeps its id and takes the columns the batch has.
    ``ignore``: existing rows stay as they are. New rows get the ids after the
    largest one, in (url, title) order. The caller writes the result to a new place;
    the target is never overwritten while it is read.
    """
    if mode not in ("upsert", "ignore"):
        raise ValueError("mode must be 'upsert' or 'ignore'")
    # a staging table, since the batch is joined three times below
    unique = dedup_latest(stage(batch, keep=[sequence]), sequence).drop(sequence)
    staged = materialize(unique, "staged")
    given = [c for c in staged.columns if c not in KEY]
    fresh = _not_stored(staged, target, KEY)
    added = dense_index(fresh, [*KEY], "id", start=_next_id(target))
    if mode == "ignore":
        kept = target
    else:
        found = F.col("s._found").isNotNull()
        columns = [
            F.when(found, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c)
            if c in given
            else F.col(f"t.{c}").alias(c)
            for c in target.columns
        ]
        marked = staged.withColumn("_found", F.lit(True))
        # a NULL in a key matches nothing
        same = (F.col("t.url") == F.col("s.url")) & (F.col("t.title") == F.col("s.title"))
        kept = target.alias("t").join(marked.alias("s"), same, "left").select(*columns)
    return kept.unionByName(added, allowMissingColumns=True)


def merge_statement(table: str, batch_view: str, columns: Sequence[str]) -> str:
    """The same upsert as SQL, for tables in a catalog that supports MERGE."""
    given = [c for c in columns if c not in KEY]
    updates = ", ".join(f"t.{c} = s.{c}" for c in given)
    names = ", ".join(columns)
    values = ", ".join(f"s.{c}" for c in columns)
    return (
        f"MERGE INTO {table} t USING {batch_view} s ON t.url = s.url AND t.title = s.title "
        f"WHEN MATCHED THEN UPDATE SET {updates} "
        f"WHEN NOT MATCHED THEN INSERT ({names}) VALUES ({values})"
    )
