"""CSV store of crawled records, and word lists."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns of the crawl store, in order. One site has no last column.
CRAWL_COLUMNS = (
    "title",
    "url",
    "source",
    "summary",
    "content",
    "published_at",
    "crawled_at",
    "is_fake",
    "normalized_content",
)
_TYPES = {"published_at": "timestamp_ntz", "crawled_at": "timestamp_ntz", "is_fake": "boolean"}
# Texts hold quotes, commas and line breaks, and their outer blanks count.
_CSV_OPTIONS = {
    "header": "true",
    "escape": '"',
    "multiLine": "true",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss[.SSSSSS]",
}


def crawl_schema(normalized: bool = True) -> T.StructType:
    names = CRAWL_COLUMNS if normalized else CRAWL_COLUMNS[:-1]
    return T.StructType.fromDDL(", ".join(f"{n} {_TYPES.get(n, 'string')}" for n in names))


def read_crawl_store(spark: SparkSession, path: str, normalized: bool = True) -> DataFrame:
    """The stored records, or an empty table with the same columns if there are none."""
    schema = crawl_schema(normalized)
    try:
        return spark.read.schema(schema).options(**_CSV_OPTIONS).csv(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_crawl_store(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write records once per batch, one file per partition."""
    names = [n for n in CRAWL_COLUMNS if n in records.columns]
    options = {k: v for k, v in _CSV_OPTIONS.items() if k != "multiLine"}
    records.select(*names).write.options(**options).mode(mode).csv(path)


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """One term per line: the distinct, trimmed, non-blank ``term``s."""
    term = F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("term")
    return spark.read.text(path).select(term).where(F.col("term") != "").distinct()
