"""CSV, Parquet, table and JDBC inputs."""

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom import config
from tradeloom.functions.dates import as_of_date, month_of
from tradeloom.operators.cleaning import normalise_na


def read_raw(spark: SparkSession, path: str, schema: Mapping[str, str], row_order: str | None = None,
             tokens=config.NA_TOKENS, **options) -> DataFrame:
    """CSV with a header, columns matched by name; a further file whose header differs stops the job.

    Missing-value tokens become null in every column, numbers included; any other text
    that does not fit the type stops the job.  ``row_order`` names a column that keeps file order.
    """
    reader = spark.read.option("header", True).option("mode", "FAILFAST").option("escape", '"')
    reader = reader.option("enforceSchema", False).options(**options)
    text = reader.csv(path)
    if row_order:
        text = with_row_order(text, row_order)
    present = normalise_na(text, list(schema), tokens)
    extra = [row_order] if row_order else []
    return present.select(*(F.col(c).cast(t).alias(c) for c, t in schema.items()), *extra)


def with_row_order(df: DataFrame, out: str) -> DataFrame:
    """Add a sortable struct (file, block offset, row in the scan task) to a file scan.

    Splits may be scanned in any order, so the running row number alone is not file order.
    """
    return df.withColumn(out, F.struct(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_place"),
    ))


def read_table(spark: SparkSession, source: str, fmt: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """A whole table: a path in a file format, a catalog table (``fmt='table'``) or a JDBC table.

    A stated schema saves the job that would infer it from file footers.
    For JDBC the caller passes ``url`` and, for a parallel read, ``partitionColumn``,
    ``lowerBound``, ``upperBound`` and ``numPartitions``.
    """
    if fmt == "table":
        return spark.read.options(**options).table(source)
    if fmt == "jdbc":
        return spark.read.format("jdbc").options(dbtable=source, **options).load()
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema else reader).load(source)


def read_warehouse(spark: SparkSession, source: str, start=None, end=None, fmt: str = "parquet") -> DataFrame:
    """The stored warehouse; a date range also prunes the month partitions."""
    wide = read_table(spark, source, fmt)
    if start is not None:
        wide = wide.where((F.col("order_month") >= month_of(as_of_date(start))) & (F.col("order_date") >= as_of_date(start)))
    if end is not None:
        wide = wide.where((F.col("order_month") <= month_of(as_of_date(end))) & (F.col("order_date") <= as_of_date(end)))
    return wide.drop("order_month")
