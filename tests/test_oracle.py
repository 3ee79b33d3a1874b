"""Every query against its SQL on the smallest test tables."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from bindings.queries import KEYS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events".split():
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def sorted_rows(table):
    names = sorted(table.column_names)
    return names, sorted(repr(row) for row in zip(*(table[n].to_pylist() for n in names)))


@pytest.mark.parametrize("key", KEYS)
def test_query_equals_sql(spark, con, key):
    assert sorted_rows(queries()[key](spark, SF).toArrow()) == sorted_rows(con.sql(oracle_sql()[key]).to_arrow_table())


@pytest.mark.parametrize("key", ["rfm_segments", "dedupe_keep_first", "global_rank", "monthly_revenue", "warehouse_clean",
                                 "new_vs_returning", "explorer_page", "segment_distribution"])
def test_partitioning_does_not_change_results(spark, key):
    found = []
    for parts in (1, 17):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        found.append(sorted_rows(queries()[key](spark, SF).toArrow()))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert found[0] == found[1]


def test_entry(spark):
    assert entry(spark).count() > 0
