"""Named queries over the test tables, one per operator.

Every query takes ``(spark, sf_dir)`` and returns a DataFrame over whole tables.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newscheck.functions import dates
from newscheck.functions.text import clean_text, ngrams, whitespace_words
from newscheck.operators import (
    bm25,
    detect,
    extract,
    ingest,
    neighbors,
    profile,
    reduce,
    running,
    segment,
    sites,
    vectors,
    words,
)
from newscheck.operators.terms import each_entry, term_stats
from newscheck.session import materialize, scratch_path, spread
from newscheck.sources import articles as art
from newscheck.sources import index_store, stores
from newscheck.streaming import articles as stream
from newscheck.streaming import upserts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TEXT = "normalized_content"
PAGE_RULES = extract.SiteRules(
    card=extract.Selector("article"),
    title=(extract.Selector("h1"),),
    summary=(extract.Selector("p"),),
    container=(extract.Selector("article"),),
)


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# inputs ----------------------------------------------------------------------


def _articles(spark: SparkSession, sf: str) -> DataFrame:
    return art.articles_from_corpus(spark, sf)


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    """The articles with their normalised text as a table, as ingest leaves them.

    For jobs that read the text several times: it is cleaned once.
    """
    return materialize(_articles(spark, sf), "articles")


def _prepared(articles: DataFrame) -> DataFrame:
    return art.prepare_for_analysis(articles, TEXT)


def _labelled(articles: DataFrame) -> DataFrame:
    return art.labelled_articles(articles, TEXT)


def _unlabelled(articles: DataFrame) -> DataFrame:
    return articles.where("is_fake is null")


def _docs(articles: DataFrame) -> DataFrame:
    return articles.select(F.col("id").alias("doc_id"), F.col(TEXT).alias("text"))


def _queries(articles: DataFrame) -> DataFrame:
    """Every article nobody has labelled asks for a verdict."""
    return _docs(_unlabelled(articles)).withColumnRenamed("doc_id", "query_id")


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _fitted(articles: DataFrame) -> bm25.BM25Index:
    return bm25.fit(_docs(_labelled(articles)))


def _fitted_on_all(articles: DataFrame) -> bm25.BM25Index:
    return bm25.fit(_docs(articles))


def _fakes(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of the articles labelled fake."""
    return _table(spark, sf, "labels").where("toxic = 1").select("doc_id")


def _stopwords(spark: SparkSession, sf: str) -> DataFrame:
    """Stopwords of the test tables: the 50 most frequent words of ``benchmark``."""
    cleaned = _table(spark, sf, "benchmark").select(clean_text(F.col("text")).alias("text"))
    terms = each_entry(cleaned, whitespace_words(F.col("text")), "term")
    counts = terms.groupBy("term").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "term").limit(50).select("term")


def _recrawled(articles: DataFrame) -> DataFrame:
    """All articles crawled twice: the second time with a summary and an empty source."""
    first = articles.drop("published_at").withColumn("sequence", F.col("id"))
    second = first.withColumns(
        {
            "sequence": F.col("id") + 1_000_000_000,
            "summary": F.concat(F.lit("again "), "source"),
            "source": F.when(F.col("is_fake"), "").otherwise(F.col("source")),
        }
    )
    return first.unionByName(second)


# sources and filters -----------------------------------------------------------


@query
def read_articles_filtered(spark, sf):
    found = art.filter_articles(
        _articles(spark, sf),
        start_date=dt.datetime(2024, 1, 2),
        end_date=dt.date(2024, 12, 31),
        sources=["src1", "src3", "src5", "src7", "src11"],
        is_fake=False,
    )
    return found.select("id", "title", "url", "source", "content", "crawled_at", "is_fake")


@query
def scan_by_id(spark, sf):
    return art.scan_by_id(_articles(spark, sf)).select("id", "title", "url", "source", "crawled_at", "is_fake")


@query
def csv_roundtrip(spark, sf):
    path = scratch_path(spark, "store")
    stores.write_crawl_store(_articles(spark, sf), path)
    return stores.read_crawl_store(spark, path)


@query
def stage_rows(spark, sf):
    staged = ingest.stage(_recrawled(_articles(spark, sf)), keep=["sequence"])
    return staged.select("sequence", "title", "url", "source", "summary", "content", "is_fake")


@query
def labeled_articles(spark, sf):
    return _labelled(_stored(spark, sf)).select("id", "source", TEXT, "is_fake")


# ingest --------------------------------------------------------------------------


def _merge(spark, sf, mode):
    articles = _stored(spark, sf)
    target = _labelled(articles).withColumn("is_fake", F.col("is_fake").cast("boolean"))
    merged = ingest.merge_articles(target, _recrawled(articles), "sequence", mode)
    return merged.select("id", "title", "url", "source", "summary", "crawled_at", "is_fake")


@query
def upsert_articles(spark, sf):
    return _merge(spark, sf, "upsert")


@query
def insert_ignore_articles(spark, sf):
    return _merge(spark, sf, "ignore")


@query
def dedup_url_title(spark, sf):
    rows = ingest.dedup_latest(_recrawled(_articles(spark, sf)), "sequence")
    return rows.select("sequence", "url", "title", "source", "summary")


@query
def dedup_keep_last(spark, sf):
    articles = _stored(spark, sf)
    old = _labelled(articles).withColumn("sequence", F.col("id"))
    new = articles.withColumn("sequence", F.col("id") + 1_000_000_000).drop("is_fake")
    rows = ingest.append_keep_last(old, new, "sequence", ("title", "content"))
    return rows.select("sequence", "title", "content", "is_fake")


@query
def dedup_keep_first(spark, sf):
    rows = ingest.dedup_first(_articles(spark, sf), "id", ("content",))
    return rows.select("id", "url", "content")


@query
def skip_known_urls(spark, sf):
    articles = _stored(spark, sf)
    return ingest.skip_known_urls(articles, _labelled(articles)).select("id", "url", "title")


@query
def tag_by_source(spark, sf):
    """Sites are the languages; a site is fake by default if it ever had a fake article."""
    documents = _table(spark, sf, "documents").select("doc_id", F.col("lang").alias("site"))
    rules = (
        documents.join(_table(spark, sf, "labels"), "doc_id", "left")
        .groupBy("site")
        .agg(
            F.concat(F.lit("site "), F.first("site")).alias("source"),
            F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("is_fake"),
        )
    )
    at = F.lit("2025-01-07T08:05:09").cast("timestamp_ntz")
    return ingest.tag_by_source(documents, rules, at)


@query
def parse_published_at(spark, sf):
    """Event times written the two ways article pages write them, and one way they do not."""
    ts = F.col("ts")
    text = (
        F.when(F.col("event_type") == "click", F.date_format(ts, "'Thứ ba, 'd/M/yyyy, H:mm' (GMT+7)'"))
        .when(F.col("event_type") == "error", F.date_format(ts, "d.M.yyyy H:mm"))
        .otherwise(F.date_format(ts, "yyyy-M-d H:mm:ss"))
    )
    events = _table(spark, sf, "events").select("event_id", text.alias("text"))
    return events.select(
        "event_id",
        dates.published_at(F.col("text")).alias("published_at"),
        dates.tolerant_time(F.col("text")).alias("cast_time"),
    )


# text ------------------------------------------------------------------------------


@query
def clean_texts(spark, sf):
    documents = spread(_table(spark, sf, "documents"))
    return documents.select("doc_id", clean_text(F.col("text")).alias("text"))


QUERIES["clean_text"] = QUERIES.pop("clean_texts")


@query
def remove_stopwords(spark, sf):
    return segment.remove_stopwords(_docs(_articles(spark, sf)), _stopwords(spark, sf))


@query
def normalize_text(spark, sf):
    turns = spread(_table(spark, sf, "conversations"))
    docs = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return segment.normalize(docs, stopwords=_stopwords(spark, sf))


def _lexicon(docs: DataFrame) -> DataFrame:
    """Runs of two or three words found in at least five documents."""
    runs = docs.select(whitespace_words(F.col("text")).alias("words"))
    runs = runs.select(ngrams(F.col("words"), 2, 3, segment.JOINT).alias("terms"))
    return term_stats(runs).where("df >= 5").select("term")


@query
def segment_words(spark, sf):
    docs = _docs(_stored(spark, sf))
    return segment.segment_words(docs, _lexicon(docs))


def _normalized(spark, sf):
    """All articles cleaned, segmented and without stopwords."""
    raw = _articles(spark, sf).select(F.col("id").alias("doc_id"), F.col("content").alias("text"))
    lexicon = _lexicon(raw.select("doc_id", clean_text(F.col("text")).alias("text")))
    return segment.normalize(raw, _stopwords(spark, sf), lexicon)


@query
def normalize_segmented(spark, sf):
    return _normalized(spark, sf)


@query
def extract_page_fields(spark, sf):
    return extract.extract_cards(spread(_table(spark, sf, "pages")), PAGE_RULES)


@query
def extract_page_content(spark, sf):
    return extract.extract_content(spread(_table(spark, sf, "pages")), PAGE_RULES)


SITE_RULES = {
    "blog": extract.SiteRules(
        card=extract.Selector("article"),
        title=(extract.Selector("h1"),),
        summary=(extract.Selector("p"),),
        date=(extract.Selector("span", "date"),),
        container=(extract.Selector("article"),),
    ),
    "m": extract.SiteRules(
        card=extract.Selector("body"),
        title=(extract.Selector("h2"), extract.Selector("h1")),
        date=(extract.Selector("time"),),
        date_attribute="datetime",
        container=(extract.Selector("div", "content"), extract.Selector("article")),
    ),
    "other": extract.SiteRules(
        card=extract.Selector("article"), title=(extract.Selector("h1"),), summary=(extract.Selector("p", "lead"),)
    ),
}


@query
def extract_sites(spark, sf):
    """Pages of three sites, two of which date their articles, each in its way."""
    pages = spread(_table(spark, sf, "pages"))
    site = F.regexp_extract("url", r"^https?://(blog|m)\.", 1)
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 90061)
    dates = (
        F.when(site == "blog", F.concat(F.lit('<span class="date">'), F.date_format(at, "d/M/yyyy, H:mm"), F.lit(" (GMT)</span>")))
        .when(site == "m", F.concat(F.lit('<time datetime="'), F.date_format(at, "y-M-d H:mm:ss"), F.lit('"></time>')))
        .otherwise("")
    )
    dated = pages.select(
        "page_id",
        "url",
        F.replace("html", F.lit("<article>"), F.concat(F.lit("<article>"), dates)).alias("html"),
        F.when(site == "", "other").otherwise(site).alias("site"),
    )
    found = sites.extract_sites(dated, SITE_RULES)
    card = F.get("cards", F.lit(0))
    return found.select(
        "page_id", "site", card["title"].alias("title"), card["summary"].alias("summary"), "content", "published_at", "error"
    )


# profile ---------------------------------------------------------------------------


@query
def prepare_for_analysis(spark, sf):
    return _prepared(_articles(spark, sf)).select(
        "id", "text_length", "word_count", "year", "month", "day", "day_of_week", "is_fake"
    )


@query
def load_for_analysis(spark, sf):
    chosen = {"start_date": dt.datetime(2024, 1, 3, 12), "sources": ["src2", "src4"]}
    loaded = art.load_for_analysis(_articles(spark, sf), TEXT, **chosen)
    return loaded.select("id", "source", "crawled_at", "is_fake", "word_count", "text_length")


@query
def summary_stats(spark, sf):
    return profile.summary_stats(_articles(spark, sf))


@query
def date_range(spark, sf):
    return profile.date_range(_articles(spark, sf))


@query
def distinct_sources(spark, sf):
    return profile.distinct_sources(_articles(spark, sf))


@query
def filter_options(spark, sf):
    options = profile.filter_options(_articles(spark, sf))
    return options.withColumn("sources", F.array_join("sources", ","))


@query
def label_counts(spark, sf):
    return profile.value_counts(_articles(spark, sf), "is_fake")


@query
def source_counts(spark, sf):
    return profile.value_counts(_articles(spark, sf), "source")


@query
def daily_counts(spark, sf):
    return profile.daily_counts(_table(spark, sf, "events"), "ts")


@query
def length_describe(spark, sf):
    return profile.length_describe(_articles(spark, sf), TEXT)


def _running_state(spark, sf):
    """The articles in three batches, each counted by itself."""
    prepared = _prepared(_articles(spark, sf))
    return running.add_states(*[running.batch_state(prepared.where(F.col("id") % 3 == k)) for k in range(3)])


@query
def running_summary(spark, sf):
    return running.summary(_running_state(spark, sf)).drop("estimated_sources")


@query
def running_lengths(spark, sf):
    return running.length_describe(_running_state(spark, sf))


@query
def source_label_crosstab(spark, sf):
    return profile.source_label_crosstab(_prepared(_articles(spark, sf)))


@query
def length_histogram(spark, sf):
    return profile.length_histogram(_prepared(_articles(spark, sf)))


@query
def length_kde(spark, sf):
    return profile.length_kde(_prepared(_articles(spark, sf)))


@query
def concat_text_by_label(spark, sf):
    return profile.joined_text(_prepared(_articles(spark, sf)), TEXT)


@query
def concat_text_all(spark, sf):
    return profile.joined_text(_prepared(_articles(spark, sf)), TEXT, by_label=False)


# words -----------------------------------------------------------------------------


@query
def word_frequencies(spark, sf):
    return words.word_frequencies(_prepared(_articles(spark, sf)), "content")


@query
def word_frequencies_by_label(spark, sf):
    return words.word_frequencies(_prepared(_articles(spark, sf)), "content", by_label=True)


@query
def word_frequencies_normalized(spark, sf):
    """The cloud of the normalised texts, without stopwords."""
    prepared = art.prepare_for_analysis(_articles(spark, sf), TEXT)
    return words.word_frequencies(prepared, TEXT, stopwords=_stopwords(spark, sf))


@query
def top_unigrams(spark, sf):
    return words.top_ngrams(_articles(spark, sf), TEXT, (1, 1))


@query
def top_bigrams(spark, sf):
    return words.top_ngrams(_articles(spark, sf), TEXT, (2, 2))


@query
def top_one_to_three_grams(spark, sf):
    return words.top_ngrams(_articles(spark, sf), TEXT, (1, 3), 100)


@query
def ngrams_by_label(spark, sf):
    return words.top_ngrams_by_label(_prepared(_articles(spark, sf)), TEXT, (1, 2))


# vectors -----------------------------------------------------------------------------


@query
def all_term_stats(spark, sf):
    docs = _docs(_articles(spark, sf))
    return term_stats(docs.select(whitespace_words(F.col("text")).alias("terms")))


QUERIES["term_stats"] = QUERIES.pop("all_term_stats")


@query
def auto_max_features(spark, sf):
    return vectors.auto_max_features(_articles(spark, sf), TEXT)


def _rounded(cells: DataFrame) -> DataFrame:
    return cells.select("doc_id", "term", "tf", F.round("weight", 6).alias("weight"))


@query
def tfidf_vectors(spark, sf):
    return _rounded(vectors.tfidf(_docs(_stored(spark, sf))).cells)


@query
def bm25_vectors(spark, sf):
    return _rounded(vectors.bm25_vectors(_docs(_stored(spark, sf))).cells)


def _top_terms(spark, sf, method):
    articles = _stored(spark, sf)
    labels = _prepared(articles).select(F.col("id").alias("doc_id"), "is_fake")
    weights = vectors.vectorize(_docs(articles), method, 5000)
    return vectors.top_weighted_terms(weights, labels)


@query
def top_weighted_terms_tfidf(spark, sf):
    return _top_terms(spark, sf, "tfidf")


@query
def top_weighted_terms_bm25(spark, sf):
    return _top_terms(spark, sf, "bm25")


@query
def matrix_stats(spark, sf):
    index = _fitted_on_all(_stored(spark, sf))
    return bm25.matrix_stats(index.counts, index.n_docs, index.vocab.count())


# index -------------------------------------------------------------------------------


@query
def bm25_vocab(spark, sf):
    return _fitted(_stored(spark, sf)).vocab


@query
def bm25_postings(spark, sf):
    return _rounded(bm25.postings(_fitted(_stored(spark, sf))))


@query
def doc_lengths(spark, sf):
    index = _fitted(_stored(spark, sf))
    lengths = index.counts.groupBy("doc_id").agg(F.first("dl").alias("dl"))
    return index.corpus.join(lengths, "doc_id", "left").select(
        "doc_id",
        F.coalesce("dl", F.lit(0)).alias("doc_length"),
        F.lit(round(index.average_length, 6)).alias("average_length"),
    )


@query
def bm25_query_topk(spark, sf):
    articles = _stored(spark, sf)
    return bm25.query_topk(_fitted(articles), _queries(articles))


@query
def bm25_self_topk(spark, sf):
    return bm25.self_topk(_fitted_on_all(_stored(spark, sf)))


@query
def bm25_transform_new(spark, sf):
    articles = _stored(spark, sf)
    return _rounded(bm25.transform(_fitted(articles), _docs(_unlabelled(articles))))


@query
def index_save_load(spark, sf):
    path = scratch_path(spark, "index")
    index_store.save_index(_fitted(_stored(spark, sf)), path)
    return _rounded(bm25.postings(index_store.load_index(spark, path)))


@query
def index_add_documents(spark, sf):
    articles = _stored(spark, sf)
    index = bm25.add_documents(_fitted(articles), _docs(_unlabelled(articles)))
    return _rounded(bm25.postings(index))


@query
def index_add_rebuild(spark, sf):
    articles = _stored(spark, sf)
    index = bm25.add_documents(_fitted(articles), _docs(_unlabelled(articles)), rebuild_vocab=True)
    return _rounded(bm25.postings(index))


@query
def index_remove_documents(spark, sf):
    index = bm25.remove_documents(_fitted_on_all(_stored(spark, sf)), _fakes(spark, sf))
    return _rounded(bm25.postings(index))


@query
def index_store_remove(spark, sf):
    """A stored index from which documents are removed by a batch."""
    path = scratch_path(spark, "index")
    index_store.save_index(_fitted_on_all(_stored(spark, sf)), path)
    index_store.remove_batch(path, _fakes(spark, sf), "fakes")
    return _rounded(bm25.postings(index_store.load_index(spark, path)))


@query
def index_lookup(spark, sf):
    return bm25.documents(_fitted_on_all(_stored(spark, sf)), _fakes(spark, sf))


@query
def index_lookup_embeddings(spark, sf):
    return _rounded(bm25.embeddings(_fitted_on_all(_stored(spark, sf)), _fakes(spark, sf)))


# detection ---------------------------------------------------------------------------


@query
def detect_vote(spark, sf):
    articles = _stored(spark, sf)
    labelled = _labelled(articles)
    return detect.detect(bm25.fit(_docs(labelled)), _queries(articles), labelled)


@query
def detect_normalized(spark, sf):
    """Verdicts on texts that are cleaned, segmented and without stopwords, on both sides."""
    normal = _normalized(spark, sf).select(F.col("doc_id").alias("id"), F.col("text").alias(TEXT))
    articles = materialize(_articles(spark, sf).drop(TEXT).join(normal, "id"), "articles")
    labelled = _labelled(articles)
    return detect.detect(bm25.fit(_docs(labelled)), _queries(articles), labelled)


@query
def detect_similar_articles(spark, sf):
    articles = _stored(spark, sf)
    labelled = _labelled(articles)
    hits = bm25.query_topk(bm25.fit(_docs(labelled)), _queries(articles))
    return detect.similar_articles(hits, labelled)


@query
def hybrid_interpret(spark, sf):
    """Answers for every document: full, partial or empty, depending on its labels."""
    documents = _table(spark, sf, "documents").select("doc_id", "n_chars")
    p = F.round(F.col("n_chars") % 1000 / 1000, 3)
    full = F.to_json(
        F.struct(
            F.col("toxic").alias("label"),
            F.when(F.col("toxic") == 1, "Fake").otherwise("Real").alias("label_text"),
            F.round(F.abs(p - 0.5) * 2, 3).alias("confidence"),
            p.alias("fake_probability"),
            F.round(1 - p, 3).alias("real_probability"),
        )
    )
    body = (
        F.when(F.col("toxic").isNull(), "{}")
        .when(F.col("quality") == 0, F.to_json(F.struct(p.alias("fake_probability"))))
        .otherwise(full)
    )
    answers = documents.join(_table(spark, sf, "labels"), "doc_id", "left").select("doc_id", body.alias("body"))
    return detect.interpret_results(answers)


# reduction and neighbours --------------------------------------------------------------


@query
def svd_reduce(spark, sf):
    weights = vectors.tfidf(_docs(_stored(spark, sf)))
    return reduce.reduce_dimensions(weights, 2, "svd")


@query
def pca_reduce(spark, sf):
    weights = vectors.tfidf(_docs(_stored(spark, sf)))
    return reduce.reduce_dimensions(weights, 3, "pca")


@query
def svd_before_umap(spark, sf):
    weights = vectors.tfidf(_docs(_stored(spark, sf)))
    return reduce.reduce_dimensions(weights, method="umap")


def _reducer(articles, method):
    index = _fitted(articles)
    weights = vectors.index_weights(index)
    return index, reduce.hybrid_reducer(weights, reduce.sparse_rows(weights), method)


@query
def reducer_fit(spark, sf):
    return reduce.component_table(spark, _reducer(_stored(spark, sf), "PCA")[1])


@query
def svd_explained_variance(spark, sf):
    weights = vectors.tfidf(_docs(_stored(spark, sf)))
    rows = reduce.sparse_rows(weights)
    fitted = reduce.fit_reducer(rows, weights.n_docs, weights.vocab.count(), 10, "svd")
    table = reduce.component_table(spark, fitted)
    return table.select("component", "singular_value", "explained_variance_ratio")


def _reduced_new(articles):
    index, fitted = _reducer(articles, "SVD")
    new = _docs(_unlabelled(articles))
    found = reduce.to_vectors(bm25.transform(index, new), "weight")
    return reduce.project(reduce.with_empty(found, new), fitted)


@query
def reduce_new_documents(spark, sf):
    return _reduced_new(_stored(spark, sf))


@query
def hybrid_payload(spark, sf):
    articles = _stored(spark, sf)
    return detect.hybrid_payload(_reduced_new(articles), _docs(_unlabelled(articles)), "any-model")


def _points(spark, sf, k, method, by_source=False):
    articles = _stored(spark, sf)
    reduced = reduce.reduce_dimensions(vectors.tfidf(_docs(articles)), k, method)
    return reduce.plot_points(reduced, _prepared(articles), by_source)


@query
def embedding_points(spark, sf):
    return _points(spark, sf, 2, "svd")


@query
def embedding_points_by_source(spark, sf):
    return _points(spark, sf, 3, "pca", by_source=True)


@query
def knn_graph_cosine(spark, sf):
    return neighbors.knn_graph(_table(spark, sf, "embeddings"), "vec_id", "embedding")


@query
def knn_graph_descent(spark, sf):
    return neighbors.knn_descent(_table(spark, sf, "embeddings"), "vec_id", "embedding")


@query
def pca_extended(spark, sf):
    """A reducer of the labelled articles takes in the others, which alone are read."""
    articles = _stored(spark, sf)
    index = _fitted(articles)
    fitted = reduce.fit_reducer(
        reduce.sparse_rows(vectors.index_weights(index)), index.n_docs, index.vocab.count(), 10, "pca"
    )
    new = _docs(_unlabelled(articles))
    found = reduce.to_vectors(bm25.transform(index, new), "weight")
    rows = materialize(reduce.with_empty(found, new), "rows")
    extended = reduce.extend_reducer(fitted, rows, rows.count())
    return reduce.component_table(spark, extended).select("component", "singular_value", "explained_variance_ratio")


# streams -------------------------------------------------------------------------------


def _document_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as files arrive, be the table one file or a folder of files.

    The bracket makes the path a pattern: a stream takes a plain path for a folder.
    """
    schema = _table(spark, sf, "documents").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/[d]ocuments.parquet")


@query
def stream_ingest(spark, sf):
    """The documents as crawl records; the address is the text's, so copies are known."""
    target, checkpoint = scratch_path(spark, "ingested"), scratch_path(spark, "stream")
    records = _document_stream(spark, sf).select(
        F.col("doc_id").alias("sequence"),
        F.substring("text", 1, 100).alias("title"),
        F.concat(F.lit("doc://"), F.md5("text")).alias("url"),
        "source",
        F.col("text").alias("content"),
    )
    stream.ingest_articles(records, target, checkpoint)
    return stream.read_ingested(spark, target).select("title", "url", "source", "content", "batch")


@query
def stream_index_update(spark, sf):
    """An index of the labelled articles takes in the stream of the others."""
    path, checkpoint = scratch_path(spark, "index"), scratch_path(spark, "stream")
    index_store.save_index(_fitted(_stored(spark, sf)), path)
    labels = _table(spark, sf, "labels").select("doc_id")
    new = _document_stream(spark, sf).join(labels, "doc_id", "left_anti")
    docs = new.select("doc_id", clean_text(F.col("text")).alias("text"))
    stream.maintain_index(docs, path, checkpoint)
    return _rounded(bm25.postings(index_store.load_index(spark, path)))


@query
def stream_upsert(spark, sf):
    """Articles crawled three times: some new, some changed, some as before each time."""
    source, target, checkpoint = (scratch_path(spark, name) for name in ("crawl", "changes", "stream"))
    first = _articles(spark, sf).where("title <> ''").select("id", "title", "url", "source", "content", "crawled_at")
    first = first.withColumns({"summary": F.lit(None).cast("string"), "sequence": F.col("id")})
    second = first.withColumns(
        {"sequence": F.col("id") + 1_000_000_000, "summary": F.when(F.col("id") % 3 == 0, "changed")}
    )
    third = second.withColumns(
        {
            "sequence": F.col("id") + 2_000_000_000,
            "title": F.when(F.col("id") % 5 == 0, F.concat(F.lit("again "), "title")).otherwise(F.col("title")),
        }
    )
    for records in (first.where("id % 2 = 0"), second, third):
        records.write.mode("append").parquet(source)
        upserts.upsert_articles(spark.readStream.schema(records.schema).parquet(source), target, checkpoint)
    return upserts.current_articles(spark, target).select("title", "url", "source", "summary", "n_changes")
