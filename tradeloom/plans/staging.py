"""Raw CSV files to raw tables."""

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from tradeloom.schemas import RAW_SCHEMAS, row_column
from tradeloom.sources.readers import read_raw, read_table
from tradeloom.sources.writers import write_table


def stage(spark: SparkSession, csv_paths: Mapping[str, str], raw_root: str) -> dict[str, DataFrame]:
    """Load each CSV file, keep its row order and replace the raw table; returns the stored tables."""
    stored = {}
    for table, path in csv_paths.items():
        raw = read_raw(spark, path, RAW_SCHEMAS[table], row_order=row_column(table))
        target = f"{raw_root.rstrip('/')}/{table}"
        write_table(raw, target, compression="zstd")
        stored[table] = read_table(spark, target)
    return stored
