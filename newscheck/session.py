"""Session settings and scratch tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_scratch: tempfile.TemporaryDirectory | None = None


def build_session(name: str = "newscheck", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the jobs assume (AQE, UTC)."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it gets a temporary folder
    that disappears with the process.
    """
    global _own_scratch
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/{spark.sparkContext.applicationId}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    if _own_scratch is None or not os.path.isdir(_own_scratch.name):
        _own_scratch = tempfile.TemporaryDirectory(prefix="newscheck-")
    return _own_scratch.name


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the scratch folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, place: str) -> None:
    """Delete a folder wherever it is stored; nothing happens if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables."""
    delete_path(spark, scratch_root(spark))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a parquet table and read it back.

    Used where a result is scanned several times. The table is in shared storage,
    so a lost executor costs a re-read and not a recomputation.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that nothing reads any more."""
    for table in tables:
        delete_path(table.sparkSession, table._scratch)


def spread(scan: DataFrame) -> DataFrame:
    """Split a scan that has fewer partitions than the cluster has cores.

    Tables of a few files would otherwise be parsed by a few tasks. A table with
    enough splits, as any large one, is returned untouched and is not shuffled.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
