"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from newscheck.plans.queries import QUERIES
from newscheck.session import build_session, clear_scratch

HEADLINE = (
    "read_articles_filtered clean_text remove_stopwords segment_words extract_page_content "
    "prepare_for_analysis length_describe length_kde source_label_crosstab dedup_url_title "
    "upsert_articles word_frequencies top_bigrams ngrams_by_label term_stats tfidf_vectors "
    "bm25_vectors top_weighted_terms_tfidf bm25_postings bm25_query_topk bm25_self_topk "
    "detect_vote detect_similar_articles index_save_load index_add_documents "
    "index_remove_documents svd_reduce pca_reduce knn_graph_cosine stream_ingest "
    "stream_index_update"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # start the JVM's and the Python workers' machinery before the clock runs
    QUERIES["knn_graph_cosine"](spark, sf_dir).count()
    QUERIES["daily_counts"](spark, sf_dir).count()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        clear_scratch(spark)
    result = {
        "metric": "headline_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir).removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
