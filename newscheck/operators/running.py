"""A profile that grows with the batches: counts that add up in place of scans of all articles.

The state of a batch is a small table: how many articles of each label have each source,
day, word count and length, and a sketch of the sources. States of batches are added;
every number of the profile comes from the sum.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newscheck.functions.labels import FAKE, REAL
from newscheck.operators.profile import BINS

# Fixed: the sketch has 2**12 registers; its estimate is within 5 % in 99 of 100 cases.
SKETCH_BITS = 12
_KEYS = ("kind", "is_fake", "name", "value")
MEASURES = {"words": "word_count", "chars": "text_length"}


def batch_state(prepared: DataFrame) -> DataFrame:
    """``kind, is_fake, name, value, n, sketch`` of a batch of prepared articles (labels 1/0/-1).

    An article has one row of each kind: ``source`` (its name), ``second`` (when it was
    crawled), ``words`` and ``chars`` (a count); missing ones with a null. One scan, one
    shuffle of counts. The state of no articles has no rows.
    """
    none_text, none_number = F.lit(None).cast("string"), F.lit(None).cast("long")
    facts = [
        F.struct(F.lit("source").alias("kind"), F.col("source").alias("name"), none_number.alias("value")),
        F.struct(F.lit("second").alias("kind"), none_text.alias("name"), F.unix_micros(F.col("crawled_at").cast("timestamp")).alias("value")),
        *[F.struct(F.lit(k).alias("kind"), none_text.alias("name"), F.col(c).cast("long").alias("value")) for k, c in MEASURES.items()],
    ]
    rows = prepared.select(F.col("is_fake").cast("int").alias("is_fake"), F.inline(F.array(*facts)))
    # times are as good as unique; a day keeps its first and last one
    day = F.when(F.col("kind") == "second", F.floor(F.col("value") / 86_400_000_000)).otherwise(F.col("value"))
    return rows.groupBy("kind", "is_fake", "name", day.alias("value")).agg(
        F.count("*").alias("n"),
        F.min(F.when(F.col("kind") == "second", F.col("value"))).alias("low"),
        F.max(F.when(F.col("kind") == "second", F.col("value"))).alias("high"),
        F.hll_sketch_agg("name", SKETCH_BITS).alias("sketch"),
    ).withColumn("sketch", F.when(F.col("kind") == "source", F.col("sketch")))


def add_states(*states: DataFrame) -> DataFrame:
    """The state of all the batches together."""
    return reduce(DataFrame.unionByName, states).groupBy(*_KEYS).agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.hll_union_agg("sketch").alias("sketch")
    ).withColumn("sketch", F.when(F.col("kind") == "source", F.col("sketch")))


def _time(micros: Column) -> Column:
    return F.timestamp_micros(micros).cast("timestamp_ntz")


def summary(state: DataFrame) -> DataFrame:
    """Articles, fakes, reals, sources (exact, and by the sketch), first and last crawl: one row."""
    by_name = state.groupBy("kind", "name").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("is_fake") == FAKE, F.col("n")).otherwise(0)).alias("fake"),
        F.sum(F.when(F.col("is_fake") == REAL, F.col("n")).otherwise(0)).alias("real"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.hll_union_agg("sketch").alias("sketch"),
    )
    source = F.col("kind") == "source"
    total = lambda c: F.coalesce(F.sum(F.when(source, F.col(c))), F.lit(0))
    return by_name.agg(
        total("n").alias("total_articles"),
        total("fake").alias("fake_news"),
        total("real").alias("real_news"),
        F.count_if(source & F.col("name").isNotNull()).alias("num_sources"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimated_sources"),
        _time(F.min("low")).alias("min_date"),
        _time(F.max("high")).alias("max_date"),
    )


def source_counts(state: DataFrame) -> DataFrame:
    named = state.where("kind = 'source' AND name IS NOT NULL")
    return named.groupBy(F.col("name").alias("source")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "source")


def daily_counts(state: DataFrame) -> DataFrame:
    days = state.where("kind = 'second' AND value IS NOT NULL")
    return days.groupBy(F.date_from_unix_date(F.col("value").cast("int")).alias("day")).agg(F.sum("n").alias("n")).orderBy("day")


def length_describe(state: DataFrame) -> DataFrame:
    """``measure, count, mean, std, min, q25, q50, q75, max``, exact, from how often each length occurs."""
    lengths = state.where(F.col("kind").isin(*MEASURES) & F.col("value").isNotNull()).groupBy("kind", "value").agg(F.sum("n").alias("n"))
    total, first, second = F.sum("n"), F.sum(F.col("n") * F.col("value")), F.sum(F.col("n") * F.col("value") * F.col("value"))
    spread = second.cast("decimal(38,0)") * total - first.cast("decimal(38,0)") * first
    quartiles = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n"))
    made = lengths.groupBy(F.col("kind").alias("measure")).agg(
        total.alias("count"),
        F.round(first / total, 6).alias("mean"),
        F.round(F.sqrt(spread.cast("double") / total / F.nullif(total - 1, F.lit(0))), 6).alias("std"),
        F.min("value").cast("int").alias("min"),
        quartiles.alias("q"),
        F.max("value").cast("int").alias("max"),
    )
    return made.select("measure", "count", "mean", "std", "min", *[F.col("q")[i].alias(q) for i, q in enumerate(("q25", "q50", "q75"))], "max")


def length_histogram(state: DataFrame, bins: int = BINS) -> DataFrame:
    """``is_fake, bin, n`` over ``bins`` equal bins of the word count; empty bins left out."""
    counts = state.where("kind = 'words' AND value IS NOT NULL").groupBy("is_fake", "value").agg(F.sum("n").alias("n"))
    low, high = counts.agg(F.min("value")).scalar(), counts.agg(F.max("value")).scalar()
    place = F.floor((F.col("value") - low) * bins / F.greatest(high - low, F.lit(1)))
    dealt = counts.select("is_fake", F.least(place, F.lit(bins - 1)).cast("int").alias("bin"), "n")
    return dealt.groupBy("is_fake", "bin").agg(F.sum("n").alias("n"))
