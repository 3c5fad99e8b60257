"""Streams of records with new, equal and changed articles."""

import datetime as dt

from newscheck.streaming import upserts

SCHEMA = "title string, url string, summary string, crawled_at timestamp_ntz, is_fake boolean, extra string, sequence long"


def _arrive(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_changes_come_out_once(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))
    day = dt.datetime(2025, 1, 2, 3)

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        upserts.upsert_articles(stream, target, checkpoint)
        rows = [(r.url, r.title, r.summary, r.sequence, r.change) for r in upserts.read_changes(spark, target).collect()]
        assert len(set(rows)) == len(rows)
        return set(rows)

    _arrive(spark, source, [("A", "u1", "s", day, True, "x", 1), ("B", "u2", None, None, None, "x", 2), ("", "u3", "s", day, True, "x", 3), ("N", None, "s", day, True, "x", 4)])
    first = run()
    assert first == {("u1", "A", "s", 1, "insert"), ("u2", "B", None, 2, "insert")}
    # equal (but for the time of crawl and a column the table does not have), changed, new; two of one url; one that is older
    _arrive(spark, source, [("A", "u1", "s", day + dt.timedelta(1), True, "y", 10), ("B", "u2", "more", None, None, "x", 11), ("B", "u2", "most", None, None, "x", 12), ("C", "u5", "", day, False, "x", 13)])
    second = run()
    assert second == first | {("u2", "B", "most", 12, "update"), ("u5", "C", None, 13, "insert")}
    _arrive(spark, source, [("A", "u1", "old", day, True, "x", 5), ("C", "u5", None, day, False, "x", 20), ("A2", "u1", "s", day, True, "x", 21)])
    third = run()
    assert third == second | {("u1", "A2", "s", 21, "update")}
    assert run() == third  # nothing has arrived
    now = {r.url: (r.title, r.summary, r.is_fake, r.crawled_at, r.n_changes) for r in upserts.current_articles(spark, target).collect()}
    assert now == {"u1": ("A2", "s", True, day, 2), "u2": ("B", "most", None, None, 2), "u5": ("C", None, False, day, 1)}


def test_nothing_stored(spark, tmp_path):
    assert upserts.current_articles(spark, str(tmp_path / "none")).collect() == []


def test_records_pass_the_state_as_they_are(spark, tmp_path):
    """All fields in one column, many urls to a batch of the Python worker."""
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "title string, url string, source string, summary string, content string, published_at timestamp_ntz, crawled_at timestamp_ntz, is_fake boolean, normalized_content string, sequence long"
    late = dt.datetime(2025, 1, 2, 3, 4, 5, 678901)
    rows = [("T\x01\n\"{}", "u1", "s", "[a, b]", "null", late, None, False, "ệ", 2**62), ("x", "u2", None, None, None, None, late, None, None, -1)]
    spark.createDataFrame(rows, schema).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    plan = upserts.changes(stream)._jdf.queryExecution().logical().toString()
    assert "FlatMapGroupsInPandasWithState" in plan and "record" in plan
    upserts.upsert_articles(stream, target, str(tmp_path / "state"))
    found = upserts.read_changes(spark, target).drop("run", "batch", "change").select(*[f.split()[0] for f in schema.split(", ")])
    assert {tuple(r) for r in found.collect()} == set(rows)
