"""Time zones of the process, zero vectors, deep pages."""

import datetime as dt
import time

from newscheck.operators.extract import SiteRules, Selector, extract_content
from newscheck.operators.neighbors import knn_graph
from newscheck.sources.articles import filter_articles


def test_filter_does_not_depend_on_the_process_zone(spark, monkeypatch):
    rows = [(1, dt.datetime(2024, 1, 1, 20)), (2, dt.datetime(2024, 1, 2)), (3, dt.datetime(2024, 1, 3, 0, 0))]
    at = [(i, t.isoformat()) for i, t in rows]
    frame = spark.createDataFrame(at, "id long, t string").selectExpr("id", "cast(t as timestamp_ntz) as crawled_at")
    monkeypatch.setenv("TZ", "Asia/Ho_Chi_Minh")
    time.tzset()
    try:
        kept = filter_articles(frame, start_date=dt.datetime(2024, 1, 2), end_date=dt.date(2024, 1, 2))
        assert [r.id for r in kept.select("id").collect()] == [2]
    finally:
        monkeypatch.undo()
        time.tzset()


def test_zero_and_null_vectors_have_cosine_zero(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), None])]
    frame = spark.createDataFrame(rows, "id long, v array<double>")
    found = {(r.vec_id, r.neighbour_id): r.cosine for r in knn_graph(frame, "id", "v", k=5).collect()}
    assert found[(1, 2)] == 1.0 and found[(1, 3)] == found[(4, 5)] == found[(3, 1)] == 0.0


def test_deep_pages_are_read(spark):
    html = "<div class='a'>" + "<li>x<b>" * 5000 + "<p>end</p></div>"
    frame = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    rules = SiteRules(card=Selector("div"), title=(Selector("b"),), container=(Selector("div", "a"),))
    assert "end" in extract_content(frame, rules).first().content
