"""The operators of this subpackage as queries on the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newscheck.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@_query
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newscheck.llm import language

    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = language.train(docs.where(~held_out).select("text", "lang"))
    marked = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    return language.identify(marked, model).drop("text", "bits_per_byte")


@_query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newscheck.llm import packing

    return packing.pack(_table(spark, sf_dir, "documents"), default_tokenizer())


@_query
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newscheck.llm import bpe

    return bpe.encoded_digests(_table(spark, sf_dir, "documents"), default_tokenizer())


@_query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newscheck.llm import pii

    return pii.digest(pii.find(_table(spark, sf_dir, "documents").select("doc_id", "text")))


@_query
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newscheck.llm import ring

    placed = ring.assign(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


@_query
def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newscheck.llm import licenses

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.detect(licenses.phrase_places(docs))
    labels = F.array_union("base_labels", F.transform("licences", lambda d: d["label"]))
    return found.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.greatest(
            F.coalesce(F.array_max(F.transform("licences", lambda d: d["score"])), F.lit(0.0)),
            F.when(F.col("n_base") > 0, 0.8).otherwise(0.0),
        ).alias("score"),
    )


@_query
def op3_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newscheck.llm import mih

    return mih.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@_query
def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newscheck.llm import segtopk

    return segtopk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE["op4_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, x.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.e, x.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""


@_query
def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newscheck.llm import substring

    done = substring.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.array_join(words, " "), 256).alias("kept_sha256"))


@_query
def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newscheck.llm import jaccard

    return jaccard.similar_classes(_table(spark, sf_dir, "documents"), words=4, percent=85)


@_query
def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newscheck.llm import fim

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return fim.digests(fim.turn(materialize(fim.store(docs), "frames")))


@_query
def op12_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newscheck.llm import audit

    return audit.interactions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


ORACLE["op12_filters"] = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals,
    min(doc_id) OVER (PARTITION BY text) AS first_id
  FROM d
),
f AS (
  SELECT doc_id, part,
    len(words) < 200 AS a,
    100 * len(list_distinct(words)) < 50 * len(words) AS b,
    100 * capitals > 3 * length(text) AS c,
    regexp_matches(text, '[#$%&*|]') AS d,
    coalesce(first_id < doc_id, false) AS e
  FROM w
),
l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, map {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS fails,
    coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad
  FROM f LEFT JOIN l USING (doc_id)
),
g AS (SELECT part, fails, good, bad, count(*) AS n FROM m GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order
  FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
),
steps AS (SELECT filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM orders),
s AS (
  SELECT filter_order, step, filter_order[step] AS here,
    string_split(substr(filter_order, 1, step - 1), '') AS before
  FROM steps
),
c AS (
  SELECT g.part, s.filter_order, s.step, s.here, n, good, bad,
    g.fails[s.here] AS fail_here,
    len(list_filter(s.before, lambda x: x <> '' AND g.fails[x])) > 0 AS gone,
    len(list_filter(map_values(g.fails), lambda x: x)) AS n_fails
  FROM g, s
),
r AS (
  SELECT part, filter_order, step, here,
    CAST(coalesce(sum(n) FILTER (NOT gone AND NOT fail_here), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (NOT gone AND fail_here), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (gone AND fail_here), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (fail_here AND n_fails = 1), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(n) FILTER (NOT gone AND fail_here AND good), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(n) FILTER (NOT gone AND fail_here AND bad), 0) AS BIGINT) AS toxic_lost
  FROM c GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, here) AS BIGINT) AS shapley
FROM r
"""


@_query
def op13_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newscheck.llm import fmindex

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = fmindex.mark(docs, _table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
