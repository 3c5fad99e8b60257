"""Counts, lengths and cross tables of an article table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newscheck.functions.labels import FAKE, REAL, UNLABELLED
from newscheck.functions.text import text_length, word_count
from newscheck.session import materialize

# Bins of the length histogram, grid points of the density curve,
# documents per part of a joined text.
BINS = 50
GRID = 200
DOCS_PER_PART = 64


def summary_stats(articles: DataFrame) -> DataFrame:
    """Number of articles, fakes, reals and sources of the given (filtered) table."""
    by_source = articles.groupBy("source").agg(
        F.count("id").alias("n"),
        F.count_if(F.col("is_fake")).alias("fake"),
        F.count_if(~F.col("is_fake")).alias("real"),
    )
    return by_source.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_articles"),
        F.coalesce(F.sum("fake"), F.lit(0)).alias("fake_news"),
        F.coalesce(F.sum("real"), F.lit(0)).alias("real_news"),
        F.count("source").alias("num_sources"),
    )


def date_range(articles: DataFrame) -> DataFrame:
    return articles.agg(
        F.min("crawled_at").alias("min_date"), F.max("crawled_at").alias("max_date")
    )


def distinct_sources(articles: DataFrame) -> DataFrame:
    return articles.select("source").where("source is not null").distinct().orderBy("source")


def filter_options(articles: DataFrame) -> DataFrame:
    """Sources and date range in one row."""
    by_source = articles.groupBy("source").agg(
        F.min("crawled_at").alias("low"), F.max("crawled_at").alias("high")
    )
    return by_source.agg(
        F.sort_array(F.collect_set("source")).alias("sources"),
        F.min("low").alias("min_date"),
        F.max("high").alias("max_date"),
    )


def value_counts(articles: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first; NULL is not counted."""
    counts = articles.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), column)


def daily_counts(articles: DataFrame, column: str = "crawled_at") -> DataFrame:
    day = F.to_date(column).alias("day")
    dated = articles.select(day).where("day is not null")
    return dated.groupBy("day").agg(F.count("*").alias("n")).orderBy("day")


def _describe(value: str, prefix: str) -> list:
    quartiles = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return [
        F.count(value).alias(f"{prefix}_count"),
        F.round(F.avg(value), 6).alias(f"{prefix}_mean"),
        F.round(F.stddev_samp(value), 6).alias(f"{prefix}_std"),
        F.min(value).alias(f"{prefix}_min"),
        quartiles.alias(f"{prefix}_quartiles"),
        F.max(value).alias(f"{prefix}_max"),
    ]


def length_describe(articles: DataFrame, text: str) -> DataFrame:
    """``measure, count, mean, std, min, q25, q50, q75, max`` of words and characters."""
    lengths = articles.select(
        word_count(F.col(text)).alias("words"), text_length(F.col(text)).alias("chars")
    )
    one = lengths.agg(*_describe("words", "words"), *_describe("chars", "chars"))
    measures = [
        F.struct(
            F.lit(m).alias("measure"),
            F.col(f"{m}_count").alias("count"),
            F.col(f"{m}_mean").alias("mean"),
            F.col(f"{m}_std").alias("std"),
            F.col(f"{m}_min").alias("min"),
            *[F.col(f"{m}_quartiles")[i].alias(q) for i, q in enumerate(("q25", "q50", "q75"))],
            F.col(f"{m}_max").alias("max"),
        )
        for m in ("words", "chars")
    ]
    return one.select(F.inline(F.array(*measures)))


def source_label_crosstab(prepared: DataFrame) -> DataFrame:
    """Articles per source (rows) and label (columns)."""
    names = {UNLABELLED: "unlabelled", REAL: "real", FAKE: "fake"}
    counts = [F.count_if(F.col("is_fake") == code).alias(name) for code, name in names.items()]
    return prepared.where("source is not null").groupBy("source").agg(*counts)


def _length_counts(prepared: DataFrame) -> DataFrame:
    """Rows per label and word count: everything a distribution needs, so texts are read once."""
    counts = prepared.groupBy("is_fake", "word_count").agg(F.count("*").alias("n"))
    return materialize(counts, "lengths")


def length_histogram(prepared: DataFrame, bins: int = BINS) -> DataFrame:
    """``is_fake, bin, n`` over ``bins`` equal bins of the word count; empty bins left out."""
    counts = _length_counts(prepared)
    low = counts.agg(F.min("word_count")).scalar()
    high = counts.agg(F.max("word_count")).scalar()
    width = F.greatest(high - low, F.lit(1))
    place = F.floor((F.col("word_count") - low) * bins / width)
    return (
        counts.select("is_fake", F.least(place, F.lit(bins - 1)).cast("int").alias("bin"), "n")
        .groupBy("is_fake", "bin")
        .agg(F.sum("n").alias("n"))
    )


def length_kde(prepared: DataFrame, bins: int = BINS, grid: int = GRID) -> DataFrame:
    """``is_fake, point, x, density``: Gaussian density of the word counts per label.

    Scott's bandwidth, ``grid`` points from the smallest to the largest value of the
    label, scaled to the histogram's counts. Labels without spread have no curve.
    Work is (distinct lengths) x (grid points), independent of the number of articles.
    """
    counts = _length_counts(prepared)
    all_low = counts.agg(F.min("word_count")).scalar()
    all_high = counts.agg(F.max("word_count")).scalar()
    n, x = F.sum("n"), F.col("word_count").cast("double")
    shape = (
        counts.groupBy("is_fake")
        .agg(
            n.alias("total"),
            (F.sum(F.col("n") * x) / n).alias("mean"),
            F.min("word_count").alias("low"),
            F.max("word_count").alias("high"),
        )
        .where("high > low")
    )
    spread = (
        counts.join(F.broadcast(shape), "is_fake")  # one row per label
        .withColumn("sq", F.col("n") * F.pow(x - F.col("mean"), 2))
        .groupBy("is_fake", "total", "low", "high")
        .agg(F.sum("sq").alias("sq"))
        .select(
            "is_fake",
            "low",
            "high",
            (F.sqrt(F.col("sq") / (F.col("total") - 1)) * F.pow("total", F.lit(-0.2))).alias("h"),
        )
    )
    at = F.col("low") + F.col("point") * (F.col("high") - F.col("low")) / (grid - 1)
    width = (all_high - all_low) / bins
    kernel = F.exp(-F.pow((F.col("x") - F.col("word_count")) / F.col("h"), 2) / 2)
    return (
        counts.join(F.broadcast(spread), "is_fake")  # one row per label
        .withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
        .withColumn("x", at)
        .groupBy("is_fake", "point", "x", "h")
        .agg(F.sum(F.col("n") * kernel).alias("mass"))
        .select(
            "is_fake",
            "point",
            F.round("x", 6).alias("x"),
            F.round(F.col("mass") * width / (F.col("h") * (2 * F.pi()) ** 0.5), 6).alias("density"),
        )
    )


def joined_text(prepared: DataFrame, text: str, by_label: bool = True) -> DataFrame:
    """``label, part, text``: the texts in id order, joined by blanks, in bounded parts.

    The parts of a label one after the other are its whole text; no task ever holds
    more than the documents of one part. By label, unlabelled articles are left out.
    """
    label = F.col("is_fake").cast("string") if by_label else F.lit("all")
    rows = prepared.where("is_fake <> -1") if by_label else prepared
    rows = rows.where(F.col(text).isNotNull())
    part = F.floor(F.col("id") / DOCS_PER_PART).alias("part")
    ordered = F.array_sort(F.collect_list(F.struct("id", F.col(text).alias("text"))))
    return (
        rows.select(label.alias("label"), part, "id", text)
        .groupBy("label", "part")
        .agg(F.array_join(F.transform(ordered, lambda r: r["text"]), " ").alias("text"))
    )
