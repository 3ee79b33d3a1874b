"""Table, warehouse and export outputs; every write replaces its target as a whole."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom import config
from tradeloom.functions.dates import month_of
from tradeloom.sources.readers import read_table

UNEVEN = 4.0  # a bucket may hold so many times the mean


def write_table(df: DataFrame, target: str, fmt: str = "parquet", **options) -> None:
    """Replace a path, a catalog table (``fmt='table'``) or a JDBC table."""
    writer = df.write.mode("overwrite")
    if fmt == "table":
        writer.options(**options).saveAsTable(target)
    elif fmt == "jdbc":
        writer.format("jdbc").options(**{"batchsize": config.JDBC_BATCH_ROWS, "dbtable": target, **options}).save()
    else:
        writer.format(fmt).options(**options).save(target)


def write_warehouse(df: DataFrame, target: str, fmt: str = "parquet") -> None:
    """Replace the warehouse, one folder per order month.

    The rebalance hint gathers a month into few files and lets AQE split a month that is
    too large for one task.
    """
    if fmt == "jdbc":
        raise ValueError("use write_table for JDBC targets")
    by_month = df.withColumn("order_month", month_of(F.col("order_date"))).hint("rebalance", "order_month")
    writer = by_month.write.mode("overwrite").partitionBy("order_month")
    if fmt == "table":
        writer.saveAsTable(target)
    else:
        writer.format(fmt).save(target)


def write_bucketed(df: DataFrame, table: str, path: str, keys: Sequence[str], buckets: int, uneven: float = UNEVEN) -> None:
    """Replace a catalog table stored in buckets of its join keys, for tables that are joined by them again and again.

    Joins by the keys then read the stored buckets without moving the rows.  A bucket is read by one task and cannot be split, so
    a table whose largest bucket holds more than ``uneven`` times the mean (a hot key) is refused: stored plainly, its
    joins are split at run time.
    """
    sizes = df.groupBy(F.pmod(F.hash(*keys), F.lit(buckets)).alias("bucket")).count()
    found = sizes.agg(F.max("count").alias("most"), F.sum("count").alias("rows")).first()
    if found["rows"] and found["most"] > uneven * max(found["rows"] / buckets, 1000):
        raise ValueError(f"the largest of {buckets} buckets holds {found['most']} of {found['rows']} rows; store the table without buckets")
    writer = df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
    writer.option("path", path).option("compression", "zstd").saveAsTable(table)


def export_csv(df: DataFrame, path: str, compression: str = "none") -> None:
    """CSV with a header, one part file per task; texts keep their outer spaces.

    Files with a ``compression`` (``gzip``) are several times smaller, but one task reads a whole file.
    """
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"').option("compression", compression)
    writer.options(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    """JSON Lines, one object per row, null fields kept, ISO dates."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def verify_write(spark: SparkSession, target: str, expected_rows: int, fmt: str = "parquet", n: int = 10) -> DataFrame:
    """Fail unless the stored row count is as expected; returns the first rows."""
    stored = read_table(spark, target, fmt)
    rows = stored.count()
    if rows != expected_rows:
        raise RuntimeError(f"{target} holds {rows} rows, expected {expected_rows}")
    return stored.limit(n)
