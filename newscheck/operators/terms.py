"""Term statistics, vocabularies and per-document term counts.

The building blocks of the BM25 index and of the TF-IDF / BM25 vectors. Every
function takes a table with a document id and an array column of terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newscheck.session import materialize

# A vocabulary up to this size is sent to every executor (a few MB); a larger one
# is joined by shuffle.
BROADCAST_TERMS = 200_000
# Rows of single terms that one task counts by document (some 100 bytes each there).
TASK_ROWS = 1 << 20


def tasks_for(spark: SparkSession, rows: int) -> int:
    """So many tasks that none has much more than :data:`TASK_ROWS` of ``rows``."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def each_entry(df: DataFrame, array: str | Column, name: str, *keep: str | Column) -> DataFrame:
    """One row per array entry that is not NULL, with the columns ``keep``.

    Written with explode_outer: for a plain explode Spark adds a filter on the array
    and moves it below earlier steps, where it computes the whole array once more.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def term_stats(docs: DataFrame, terms: str = "terms") -> DataFrame:
    """``term, df, cf``: documents holding the term, and its total occurrences.

    One pass and one shuffle. Each document contributes its distinct terms to df
    and all its terms to cf; both are summed before the shuffle, so a very
    frequent term costs one row per map task.
    """
    all_terms = F.struct(F.col(terms).alias("list"), F.lit(0).alias("first"))
    distinct = F.struct(F.array_distinct(terms).alias("list"), F.lit(1).alias("first"))
    lists = docs.select(F.inline(F.array(all_terms, distinct)))
    return (
        each_entry(lists, "list", "term", "first")
        .groupBy("term")
        .agg(F.sum("first").alias("df"), F.sum(1 - F.col("first")).alias("cf"))
    )


def dense_index(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """Number the rows ``start, start+1, ...`` in the given order, in parallel.

    The rows are sorted into ranges; each range counts on from the sizes of those
    before it, so no task sees more than its own range.
    """
    ranged = materialize(
        df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), name
    )
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    # one row per range: bounded by the number of shuffle partitions
    offsets = sizes.select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    within = F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1
    return (
        ranged.join(F.broadcast(offsets), "_range")
        .withColumn(name, (F.col("_before") + within + start).cast("long"))
        .drop("_range", "_before")
    )


def choose_vocabulary(
    stats: DataFrame, n_docs: int, min_df: int, max_df: float, max_features: int | None
) -> DataFrame:
    """``term_id, term, df, cf`` of the terms kept; ids follow the term order.

    A term is valid if it is in at least ``min_df`` documents and in at most the
    share ``max_df`` of them. Beyond ``max_features`` the most frequent terms stay
    (equal counts: alphabetical order).
    """
    valid = stats.where((F.col("df") >= min_df) & (F.col("df") <= int(n_docs * max_df)))
    kept = valid.orderBy(F.desc("cf"), "term").limit(max_features) if max_features else valid
    if max_features and max_features <= BROADCAST_TERMS:
        # few enough rows for one task to number them
        numbered = kept.withColumn("term_id", F.row_number().over(W.orderBy("term")) - 1)
    else:
        numbered = dense_index(kept, ["term"], "term_id")
    return numbered.select(F.col("term_id").cast("int").alias("term_id"), "term", "df", "cf")


def small_enough(vocab: DataFrame, max_features: int | None) -> DataFrame:
    """Mark a vocabulary for broadcast if its size bound allows it."""
    if max_features and max_features <= BROADCAST_TERMS:
        return F.broadcast(vocab)
    return vocab


def term_counts(
    docs: DataFrame,
    vocab: DataFrame,
    max_features: int | None,
    doc_id: str = "doc_id",
    terms: str = "terms",
    rows: int = 0,
) -> DataFrame:
    """``doc_id, term_id, tf, dl`` over the vocabulary; dl is the sum of a document's tf.

    Terms outside the vocabulary are dropped before the only shuffle, which goes by
    document: sizes are those of single documents, whatever the frequency of a term.
    ``rows`` is about how many that are; they set the number of tasks, so that a task
    does not grow with the table.
    """
    known = small_enough(vocab.select("term", "term_id"), max_features)
    return (
        each_entry(docs, terms, "term", F.col(doc_id).alias("doc_id"))
        .join(known, "term")
        .repartition(tasks_for(docs.sparkSession, rows), "doc_id")
        .groupBy("doc_id", "term_id")
        .agg(F.count("*").cast("int").alias("tf"))
        .withColumn("dl", F.sum("tf").over(W.partitionBy("doc_id")))
    )


def to_vectors(cells: DataFrame, weight: str, doc_id: str = "doc_id") -> DataFrame:
    """One sparse vector per document: ``doc_id, vec array<struct<i, v>>``."""
    cell = F.struct(F.col("term_id").alias("i"), F.col(weight).cast("double").alias("v"))
    return cells.groupBy(doc_id).agg(F.array_sort(F.collect_list(cell)).alias("vec"))
