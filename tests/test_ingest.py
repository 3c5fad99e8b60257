import datetime as dt

import pytest

from newscheck.operators import ingest
from newscheck.sources.articles import filter_articles, read_articles, valid_articles
from newscheck.streaming import articles as stream


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_filters(spark):
    rows = [
        (1, "a", dt.datetime(2024, 1, 1), True),
        (2, "b", dt.datetime(2024, 1, 2, 23, 59, 59, 999999), False),
        (3, "a", None, None),
        (4, None, dt.datetime(2024, 1, 3), True),
    ]
    df = spark.createDataFrame(rows, "id int, source string, crawled_at timestamp_ntz, is_fake boolean")
    ids = lambda **f: sorted(r.id for r in filter_articles(df, **f).collect())
    assert ids() == [1, 2, 3, 4]
    assert ids(end_date=dt.date(2024, 1, 2)) == [1, 2]
    assert ids(start_date=dt.datetime(2024, 1, 2)) == [2, 4]
    assert ids(sources=["a"]) == [1, 3]
    assert ids(is_fake=False) == [2] and ids(is_fake=True) == [1, 4]


def test_filters_reach_the_scan(spark, tmp_path):
    from newscheck.sources.articles import ARTICLE_SCHEMA

    spark.createDataFrame([], ARTICLE_SCHEMA).write.parquet(str(tmp_path / "t"))
    found = filter_articles(
        read_articles(spark, str(tmp_path / "t")),
        start_date=dt.datetime(2024, 1, 1),
        sources=["a", "b"],
        is_fake=True,
    ).select("id")
    plan = _plan(found)
    assert "GreaterThanOrEqual(crawled_at" in plan and "In(source" in plan
    assert "EqualTo(is_fake,true)" in plan and "content" not in plan.split("ReadSchema")[-1]


def test_dedup_limits_before_the_shuffle(spark):
    same = "cast(id % 1 as string)"
    df = spark.range(10).selectExpr(f"{same} as url", f"{same} as title", "id as sequence")
    assert "WindowGroupLimit" in _plan(ingest.dedup_latest(df, "sequence"))
    assert [r.sequence for r in ingest.dedup_latest(df, "sequence").collect()] == [9]
    assert [r.sequence for r in ingest.dedup_first(df, "sequence").collect()] == [0]


TARGET = "id long, title string, url string, source string, summary string, is_fake boolean"


def _target(spark):
    rows = [(1, "t1", "u1", "s", "old", True), (5, "t2", "u2", "s", "keep", None), (6, "t3", None, "s", "n", None)]
    return spark.createDataFrame(rows, TARGET)


def _batch(spark):
    rows = [
        (1, "t1", "u1", "first"),
        (2, "t1", "u1", ""),
        (3, "t9", "u9", "new"),
        (4, "t3", None, "null key"),
        (5, "t3", None, "null key again"),
    ]
    return spark.createDataFrame(rows, "seq long, title string, url string, summary string")


def test_upsert(spark):
    rows = ingest.merge_articles(_target(spark), _batch(spark), "seq").collect()
    found = {(r.id): (r.title, r.url, r.source, r.summary, r.is_fake) for r in rows}
    assert found == {
        1: ("t1", "u1", "s", None, True),  # last of the batch, empty string as NULL, other columns kept
        5: ("t2", "u2", "s", "keep", None),
        6: ("t3", None, "s", "n", None),  # a NULL url never matches
        7: ("t3", None, None, "null key again", None),
        8: ("t9", "u9", None, "new", None),
    }


def test_ignore_and_bad_mode(spark):
    rows = ingest.merge_articles(_target(spark), _batch(spark), "seq", "ignore").collect()
    assert {r.id: r.summary for r in rows} == {1: "old", 5: "keep", 6: "n", 7: "null key again", 8: "new"}
    with pytest.raises(ValueError):
        ingest.merge_articles(_target(spark), _batch(spark), "seq", "replace")


def test_keep_last_drops_missing_content(spark):
    schema = "seq long, url string, title string, content string"
    old = spark.createDataFrame([(1, "u", "t", "c"), (2, "u", "t", None)], schema)
    new = spark.createDataFrame([(3, "u", "t", "c"), (4, "u", "t", "d")], schema)
    assert sorted(r.seq for r in ingest.append_keep_last(old, new, "seq").collect()) == [3, 4]


def test_required_and_valid(spark):
    rows = [("t", "u"), (None, "u"), ("t", ""), ("x" * 501, "u")]
    df = spark.createDataFrame(rows, "title string, url string")
    assert ingest.required_fields(df).count() == 2
    assert valid_articles(df).count() == 2


def test_stream_takes_batches_once(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = "sequence long, title string, url string, content string"

    def arrive(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        records = spark.readStream.schema(schema).parquet(source)
        stream.ingest_articles(records, target, checkpoint)

    arrive((1, "a", "u1", "x"), (2, "b", "u1", "y"), (3, "c", "u2", ""))
    arrive((4, "d", "u2", "z"), (5, "e", "u3", "w"), (6, None, "u4", "w"))
    arrive((7, "f", "u3", "v"))
    stored = lambda: sorted(
        (r.url, r.title, r.content, r.batch) for r in stream.read_ingested(spark, target).collect()
    )
    expected = [("u1", "a", "x", 0), ("u2", "c", None, 0), ("u3", "e", "w", 1)]
    assert stored() == expected
    again = spark.createDataFrame([(4, "d", "u2", "z"), (5, "e", "u3", "w")], schema)
    stream.write_batch(again, target, 1)
    assert stored() == expected


def test_stream_with_another_checkpoint_adds(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "sequence long, title string, url string, content string"

    def arrive(checkpoint, *rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(source)
        records = spark.readStream.schema(schema).parquet(source)
        stream.ingest_articles(records, target, str(tmp_path / checkpoint))

    arrive("first", (1, "a", "u1", "x"))
    arrive("second", (2, "b", "u1", "y"), (3, "c", "u2", "z"))
    stored = stream.read_ingested(spark, target).collect()
    assert sorted((r.url, r.title, r.batch) for r in stored) == [("u1", "a", 0), ("u2", "c", 0)]
    assert len({r.run for r in stored}) == 2
