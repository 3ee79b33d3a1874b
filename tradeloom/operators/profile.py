"""Counts and domains that describe a table, each in one pass."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile(df: DataFrame) -> DataFrame:
    """One row per column: name, type, non-null count and null count."""
    counted = df.agg(F.count("*").alias("_rows"), *(F.count(F.col(f"`{c}`")).alias(c) for c in df.columns))
    types = F.create_map(*(F.lit(part) for pair in df.dtypes for part in pair))
    long = counted.unpivot("_rows", df.columns, "column_name", "non_null")
    return long.select(
        "column_name",
        types[F.col("column_name")].alias("data_type"),
        "non_null",
        (F.col("_rows") - F.col("non_null")).alias("nulls"),
    )


def null_counts(df: DataFrame) -> DataFrame:
    """Number of nulls per column."""
    return profile(df).select("column_name", "nulls")


def duplicate_count(df: DataFrame, key: str) -> DataFrame:
    """Rows minus distinct non-null keys."""
    return df.agg((F.count("*") - F.countDistinct(key)).alias("duplicates"))


def columns_equal(df: DataFrame, left: str, right: str) -> DataFrame:
    """Whether two columns hold the same value, null included, in every row."""
    same = F.coalesce(F.bool_and(F.col(left).eqNullSafe(F.col(right))), F.lit(True))
    return df.agg(same.alias("columns_equal"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values, null included, in no particular order."""
    return df.select(column).distinct()


def domain(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct non-null values."""
    return df.select(column).dropna().distinct().orderBy(column)


def date_bounds(df: DataFrame, date: str = "order_date") -> DataFrame:
    """First and last date."""
    return df.agg(F.min(date).alias("min_date"), F.max(date).alias("max_date"))
