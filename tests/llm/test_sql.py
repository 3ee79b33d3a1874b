"""Training-data queries that SQL can express, on the smallest test tables."""

import duckdb
import pytest

from tests.test_oracle import SF, sorted_rows
from tradeloom.llm.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in "documents embeddings pages".split():
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_equals_sql(spark, con, key):
    assert sorted_rows(QUERIES[key](spark, SF).toArrow()) == sorted_rows(con.sql(ORACLE[key]).to_arrow_table())
