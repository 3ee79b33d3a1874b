"""The filters every mart accepts."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filter_sales(df: DataFrame, start=None, end=None, countries: Sequence[str] = (),
                 categories: Sequence[str] = ()) -> DataFrame:
    """Inclusive date range and optional country and category lists.

    Rows without an order date are never selected.  An empty list selects every row, those
    with a null value too; a non-empty list excludes null.
    """
    kept = df.where(F.col("order_date").isNotNull())
    if start is not None:
        kept = kept.where(F.col("order_date") >= F.lit(start).cast("date"))
    if end is not None:
        kept = kept.where(F.col("order_date") <= F.lit(end).cast("date"))
    if countries:
        kept = kept.where(F.col("CNTRY").isin(*countries))
    if categories:
        kept = kept.where(F.col("CAT").isin(*categories))
    return kept
