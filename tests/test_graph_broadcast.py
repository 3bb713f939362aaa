"""The registered path queries run where Spark refuses every broadcast, those that it decides on while running too."""

import pytest

import __spark_entry__

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["g11_irreducible_paths", "g11_path_counts", "g12_closed_cycles", "g11_irreducible_paths_limited"])
def test_runs_without_any_broadcast(spark, name):
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1b")
    try:
        assert not __spark_entry__.queries()[name](spark, SF_DIR).isEmpty()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
