"""Counts and bounds of stored tables from file footers and folder names, without reading a column.

Parquet keeps the row count and each column's bounds in its footers.  Spark can answer an aggregate from them if the
file source is the newer one, which is a matter of settings; they are made in a session of its own, so the
caller's stay as they are.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}


def _footers(spark: SparkSession, path: str) -> DataFrame:
    session = spark.newSession()
    for name, value in SETTINGS.items():
        session.conf.set(name, value)
    return session.read.parquet(path)


def row_count(spark: SparkSession, path: str) -> DataFrame:
    """One row: ``records``."""
    return _footers(spark, path).agg(F.count("*").alias("records"))


def bounds(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """One row: ``min_<column>`` and ``max_<column>`` and non-null ``count_<column>``; numbers and dates only, as footers may cut texts short."""
    stored = _footers(spark, path)
    kinds = dict(stored.dtypes)
    cut = [c for c in columns if kinds[c] not in ("date", "tinyint", "smallint", "int", "bigint", "float", "double", "boolean")]
    if cut:
        raise TypeError(f"footers have no exact bounds for {[f'{c} {kinds[c]}' for c in cut]}")
    return stored.agg(*(f(F.col(c)).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max), ("count", F.count))))


def folder_counts(spark: SparkSession, path: str, folder: str = "order_month") -> DataFrame:
    """Rows per value of the folder column, as :func:`tradeloom.sources.writers.write_warehouse` makes them."""
    return _footers(spark, path).groupBy(folder).agg(F.count("*").alias("records"))
