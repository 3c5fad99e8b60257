"""A BM25 index on disk: parquet tables that only ever grow by batches.

``vocab``      the fixed vocabulary
``shifts``     per batch and term, what the batch adds to df and cf (or takes away)
``counts``     per batch, the term counts of its documents
``corpus``     per batch, the texts
``removed``    per batch, the documents it removes and the batches they came in
``sizes``      per batch, the number of documents it adds (or takes away)
``config``     one row

A batch is a directory ``batch=<name>``; writing it again replaces it, so a batch that
is delivered twice counts once. Its row in ``sizes`` goes first and comes last: without
it a batch is not read. A document that another batch has is not added again.
"""

from __future__ import annotations

from dataclasses import asdict

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newscheck.operators.bm25 import BM25Config, BM25Index, batch_counts
from newscheck.operators.terms import tasks_for
from newscheck.session import delete_path

_CONFIG = (
    "max_features int, k1 double, b double, min_df int, max_df double, stopwords array<string>"
)
_SCHEMAS = {
    "shifts": "term_id int, df long, cf long, batch string",
    "counts": "doc_id long, term_id int, tf int, dl long, batch string",
    "corpus": "doc_id long, text string, batch string",
    "removed": "doc_id long, from_batch string, batch string",
    "sizes": "n long, batch string",
}
# The batch that an index is saved as.
FIRST = "0"
# Up to so many removed documents are sent to the tasks (some MB).
SENT_IDS = 200_000


def _put(df: DataFrame, path: str, table: str, batch: str | int) -> DataFrame:
    place = f"{path}/{table}/batch={batch}"
    df.write.mode("overwrite").parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def _read(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of the store; empty if no batch has written it."""
    try:
        return spark.read.schema(_SCHEMAS[table]).parquet(f"{path}/{table}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _SCHEMAS[table])


def _complete(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The rows of all complete batches."""
    # one row per batch; not sent, all rows of a batch would meet in one task
    return _read(spark, path, table).join(F.broadcast(known_batches(spark, path)), "batch", "left_semi")


def _gone(spark: SparkSession, path: str) -> DataFrame:
    return _complete(spark, path, "removed").select("doc_id", F.col("from_batch").alias("batch"))


def _live(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Rows of the documents that were not removed since."""
    return _complete(spark, path, table).join(_gone(spark, path), ["doc_id", "batch"], "left_anti")


def _counts(spark: SparkSession, path: str, gone: DataFrame, n_gone: int, how: str) -> DataFrame:
    """Counts of all complete batches joined with the ``n_gone`` removed documents (``doc_id, batch``).

    If those are too many to be sent, counts are dealt by document into tasks of a bounded number of rows.
    """
    counts, keys = _complete(spark, path, "counts"), ["doc_id", "batch"]
    if n_gone <= SENT_IDS:
        return counts.join(F.broadcast(gone), keys, how)
    rows = _complete(spark, path, "shifts").where("df > 0").agg(F.sum("df")).first()[0] or 0
    # counts follow the removed documents; with fewer tasks than Spark's own number, or counts dealt out
    # before the join, Spark would deal both anew for it and make the tasks as few as their compressed size allows
    parts = max(tasks_for(spark, rows), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return counts.join(gone.repartition(parts, *keys), keys, how)


def save_index(index: BM25Index, path: str) -> None:
    """Write the index as the first batch of a new store."""
    spark = index.vocab.sparkSession
    spark.createDataFrame([asdict(index.config)], _CONFIG).write.parquet(f"{path}/config")
    index.vocab.select("term_id", "term").write.parquet(f"{path}/vocab")
    _put(index.counts, path, "counts", FIRST)
    corpus = _put(index.corpus.select("doc_id", "text"), path, "corpus", FIRST)
    _put(index.vocab.select("term_id", "df", "cf"), path, "shifts", FIRST)
    _put(corpus.agg(F.count("*").alias("n")), path, "sizes", FIRST)


def append_batch(path: str, docs: DataFrame, batch: str | int) -> None:
    """Add documents (``doc_id, text``) as a batch of that name; the vocabulary stays.

    Of the store only ids are read. Documents that another batch has are left out, and
    of a repeated ``doc_id`` the alphabetically first text stays.
    """
    spark = docs.sparkSession
    config = _read_config(spark, path)
    vocab = spark.read.parquet(f"{path}/vocab")
    delete_path(spark, f"{path}/sizes/batch={batch}")
    stored = _live(spark, path, "corpus").where(F.col("batch") != str(batch)).select("doc_id")
    new = docs.groupBy("doc_id").agg(F.min("text").alias("text")).join(stored, "doc_id", "left_anti")
    corpus = _put(new, path, "corpus", batch)
    counts = _put(batch_counts(corpus, vocab, config), path, "counts", batch)
    shifts = counts.groupBy("term_id").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    _put(shifts, path, "shifts", batch)
    _put(corpus.agg(F.count("*").alias("n")), path, "sizes", batch)


def remove_batch(path: str, ids: DataFrame, batch: str | int) -> None:
    """Remove the documents ``ids`` (``doc_id``) as a batch of that name; the vocabulary stays.

    Nothing stored is written again: the batch names the documents and takes their
    counts off. Unknown ids are passed over; a removed document can be added anew.
    """
    spark = ids.sparkSession
    delete_path(spark, f"{path}/sizes/batch={batch}")
    found = _live(spark, path, "corpus").join(ids.select("doc_id"), "doc_id", "left_semi")
    gone = _put(found.select("doc_id", F.col("batch").alias("from_batch")), path, "removed", batch)
    named = gone.withColumnRenamed("from_batch", "batch")
    lost = _counts(spark, path, named, gone.count(), "left_semi")
    shifts = lost.groupBy("term_id").agg((-F.count("*")).alias("df"), (-F.sum("tf")).alias("cf"))
    _put(shifts, path, "shifts", batch)
    _put(gone.agg((-F.count("*")).alias("n")), path, "sizes", batch)


def _read_config(spark: SparkSession, path: str) -> BM25Config:
    row = spark.read.schema(_CONFIG).parquet(f"{path}/config").first().asDict()
    return BM25Config(**{**row, "stopwords": tuple(row["stopwords"])})


def load_index(spark: SparkSession, path: str) -> BM25Index:
    """Read a store: all its complete batches."""
    sums = _complete(spark, path, "shifts")
    sums = sums.groupBy("term_id").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    vocab = spark.read.parquet(f"{path}/vocab").join(sums, "term_id", "left")
    vocab = vocab.select(
        "term_id",
        "term",
        F.coalesce("df", F.lit(0)).alias("df"),
        F.coalesce("cf", F.lit(0)).alias("cf"),
    )
    sizes = known_batches(spark, path)
    n_docs, n_gone = sizes.agg(F.sum("n"), F.sum(F.greatest(-F.col("n"), F.lit(0)))).first()
    counts = _counts(spark, path, _gone(spark, path), n_gone or 0, "left_anti")
    return BM25Index(
        config=_read_config(spark, path),
        corpus=_live(spark, path, "corpus").select("doc_id", "text"),
        vocab=vocab,
        counts=counts.select("doc_id", "term_id", "tf", "dl"),
        n_docs=n_docs,
        total_length=vocab.agg(F.sum("cf")).first()[0] or 0,
    )


def known_batches(spark: SparkSession, path: str) -> DataFrame:
    """``batch, n`` of the store; empty if there is none."""
    return _read(spark, path, "sizes").select("batch", "n")
