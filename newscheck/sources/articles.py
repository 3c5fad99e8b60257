"""The article table: schema, readers, filters."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newscheck.functions.labels import label_code
from newscheck.functions.text import clean_text, text_length, word_count
from newscheck.session import spread

ARTICLE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("published_at", T.TimestampNTZType()),
        T.StructField("crawled_at", T.TimestampNTZType()),
        T.StructField("is_fake", T.BooleanType()),
        T.StructField("normalized_content", T.StringType()),
    ]
)
KEY = ("url", "title")
# The widths the article table allows.
MAX_WIDTH = {"title": 500, "url": 1000, "source": 200}


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Article table stored as parquet."""
    return spark.read.schema(ARTICLE_SCHEMA).parquet(path)


def read_articles_jdbc(
    spark: SparkSession, url: str, table: str, ids: tuple[int, int], parts: int, **options: str
) -> DataFrame:
    """Article table in a relational database, read in ``parts`` id ranges.

    Filters and column choices on the result are pushed into the database.
    """
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn="id", numPartitions=str(parts))
        .options(lowerBound=str(ids[0]), upperBound=str(ids[1]), **options)
        .load()
    )


def articles_from_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article view over the ``documents`` and ``labels`` tables."""
    documents = spread(
        spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    )
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return documents.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.substring("text", 1, 100).alias("title"),
        F.concat(F.lit("doc://"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        "source",
        F.lit(None).cast("string").alias("summary"),
        F.col("text").alias("content"),
        F.lit(None).cast("timestamp_ntz").alias("published_at"),
        F.expr(
            "timestamp_ntz'2024-01-01 00:00:00'"
            " + make_dt_interval(cast(doc_id div 24 as int), cast(doc_id % 24 as int))"
        ).alias("crawled_at"),
        (F.col("toxic") == 1).alias("is_fake"),
        clean_text(F.col("text")).alias("normalized_content"),
    )


def _local(when: dt.date) -> Column:
    """The same wall-clock time, in whatever zone the process or the session runs."""
    if isinstance(when, dt.datetime):
        when = when.replace(tzinfo=None)
    return F.lit(when.isoformat()).cast("timestamp_ntz")


def filter_articles(
    articles: DataFrame,
    start_date: dt.datetime | None = None,
    end_date: dt.date | None = None,
    sources: Sequence[str] = (),
    is_fake: bool | None = None,
) -> DataFrame:
    """The four optional table filters. A NULL never passes a filter that is set.

    A plain ``date`` as end means the whole of that day.
    """
    if start_date:
        articles = articles.where(F.col("crawled_at") >= _local(start_date))
    if end_date:
        if isinstance(end_date, dt.datetime):
            in_time = F.col("crawled_at") <= _local(end_date)
        else:
            in_time = F.col("crawled_at") < _local(end_date + dt.timedelta(days=1))
        articles = articles.where(in_time)
    if sources:
        articles = articles.where(F.col("source").isin(list(sources)))
    if is_fake is not None:
        articles = articles.where(F.col("is_fake") == F.lit(is_fake))
    return articles


def scan_by_id(articles: DataFrame) -> DataFrame:
    """All rows ordered by id (a range-partitioned sort)."""
    return articles.orderBy("id")


def labelled_articles(articles: DataFrame, text: str = "normalized_content") -> DataFrame:
    """Rows with a label and a text that is not blank; the label as 0/1."""
    has_text = F.col(text).rlike(r"(?U)\S")
    return articles.where(F.col("is_fake").isNotNull() & has_text).withColumn(
        "is_fake", F.col("is_fake").cast("int")
    )


def prepare_for_analysis(articles: DataFrame, text: str = "normalized_content") -> DataFrame:
    """Add lengths and date parts; turn the label into 1/0/-1."""
    at = F.col("crawled_at")
    return articles.withColumns(
        {
            "text_length": text_length(F.col(text)),
            "word_count": word_count(F.col(text)),
            "year": F.year(at),
            "month": F.month(at),
            "day": F.dayofmonth(at),
            "day_of_week": F.date_format(at, "EEEE"),
            "is_fake": label_code(F.col("is_fake")),
        }
    )


def load_for_analysis(articles: DataFrame, text: str = "normalized_content", **filters) -> DataFrame:
    """Filtered articles (see ``filter_articles``), prepared for analysis."""
    return prepare_for_analysis(filter_articles(articles, **filters), text)


def valid_articles(articles: DataFrame) -> DataFrame:
    """Rows the article table can hold: a title, and no field over its width."""
    fits = F.col("title").isNotNull()
    for name, width in MAX_WIDTH.items():
        if name in articles.columns:
            fits = fits & F.coalesce(F.char_length(name) <= width, F.lit(True))
    return articles.where(fits)
