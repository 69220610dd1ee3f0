"""Every query of the catalogue agrees with its SQL in DuckDB, whatever the number of shuffle partitions."""

from __future__ import annotations

import pytest

from tests.compare import check, spark_rows
from tidegrid import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_agrees_with_sql(spark, name):
    assert check(spark, SF, catalog.QUERIES[name], catalog.ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("name", ["training_set", "ordered_mean_by_role"])
def test_partitions_change_no_bit(spark, name):
    got = []
    for n in ("1", "4", "23"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(spark_rows(catalog.QUERIES[name](spark, SF)))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1] == got[2]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
