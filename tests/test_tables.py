"""Tables that are folders of files give the rows of tables that are one file."""

import os

import pytest

from newscheck.plans.queries import QUERIES

SCALE = 3


@pytest.fixture(scope="module")
def folders(spark, sf_dir, tmp_path_factory):
    """The test tables, each as a folder of three files."""
    root = tmp_path_factory.mktemp("folders")
    for name in ("documents", "labels"):
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        table.repartition(SCALE).write.parquet(str(root / f"{name}.parquet"))
        assert sum(f.startswith("part-") for f in os.listdir(root / f"{name}.parquet")) == SCALE
    return str(root)


@pytest.mark.parametrize("name", ["stream_ingest", "stream_index_update"])
def test_streams_read_folders(spark, sf_dir, folders, name):
    rows = lambda sf: sorted(map(repr, QUERIES[name](spark, sf).collect()))
    found = rows(folders)
    assert found and found == rows(sf_dir)
