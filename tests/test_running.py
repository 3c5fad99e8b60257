"""Profiles added up by batch against scans of everything."""

import datetime as dt

from pyspark.sql import functions as F

from newscheck.operators import profile, running
from newscheck.sources.articles import prepare_for_analysis

SCHEMA = "id long, source string, normalized_content string, crawled_at timestamp_ntz, is_fake boolean"


def _rows(df):
    return sorted(map(str, df.collect()))


def _articles(spark, n=300):
    day = dt.datetime(2024, 12, 30, 23, 59, 59, 999999)
    rows = [
        (k, None if k % 11 == 0 else f"src{k % 37}", None if k % 13 == 0 else "word " * (k * 7 % 50), None if k % 17 == 0 else day + dt.timedelta(hours=5 * k), (None, True, False)[k % 3])
        for k in range(n)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_sum_of_batches_equals_a_scan(spark, tmp_path):
    articles = _articles(spark)
    prepared = prepare_for_analysis(articles)
    for k in range(3):  # states are stored; batches are not read again
        running.batch_state(prepared.where(F.col("id") % 3 == k)).write.parquet(str(tmp_path / f"batch={k}"))
    state = running.add_states(*[spark.read.parquet(str(tmp_path / f"batch={k}")) for k in range(3)])
    (row,) = running.summary(state).collect()
    (want,) = profile.summary_stats(articles).collect()
    (dates,) = profile.date_range(articles).collect()
    assert tuple(row)[:4] == tuple(want) and (row.min_date, row.max_date) == tuple(dates)
    assert abs(row.estimated_sources - want.num_sources) <= 0.05 * want.num_sources
    assert _rows(running.source_counts(state)) == _rows(profile.value_counts(articles, "source"))
    assert _rows(running.daily_counts(state)) == _rows(profile.daily_counts(articles))
    assert _rows(running.length_describe(state)) == _rows(profile.length_describe(articles, "normalized_content"))
    assert _rows(running.length_histogram(state)) == _rows(profile.length_histogram(prepared))


def test_many_sources_are_estimated(spark):
    prepared = prepare_for_analysis(_articles(spark, 50).drop("source")).withColumn("source", F.explode(F.sequence(F.lit(1), F.lit(200))))
    prepared = prepared.withColumn("source", F.concat(F.lit("s"), F.col("id") * 200 + F.col("source")))
    (row,) = running.summary(running.batch_state(prepared)).collect()
    assert row.num_sources == 10_000 and abs(row.estimated_sources - 10_000) <= 500


def test_no_articles_and_one(spark):
    empty = running.batch_state(prepare_for_analysis(_articles(spark, 0)))
    (row,) = running.summary(running.add_states(empty, empty)).collect()
    assert tuple(row)[:4] == (0, 0, 0, 0) and row.min_date is None
    assert running.length_describe(empty).collect() == [] == running.daily_counts(empty).collect()
    one = running.batch_state(prepare_for_analysis(_articles(spark, 1)))
    assert {r.measure: r["std"] for r in running.length_describe(running.add_states(one, empty)).collect()} == {"words": None, "chars": None}
