"""Imputation, ordered de-duplication, null and outlier filters."""

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradeloom import config
from tradeloom.functions.text import none_if_token
from tradeloom.operators.quantiles import SKETCH_ACCURACY, quantiles, scalar_struct


def normalise_na(df: DataFrame, columns: Sequence[str] | None = None, tokens=config.NA_TOKENS) -> DataFrame:
    """Turn missing-value tokens in text columns into null."""
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    chosen = [c for c in (columns or text) if c in text]
    return df.withColumns({c: none_if_token(F.col(c), tokens) for c in chosen})


def fill_text(df: DataFrame, columns: Sequence[str] = config.FILL_COLUMNS, value: str = config.FILL_TEXT) -> DataFrame:
    """Fill null (not empty) text with a constant."""
    return df.fillna(value, subset=list(columns))


def _without_nan(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Not-a-number counts as missing."""
    floats = [f.name for f in df.schema if f.name in columns and isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def medians(df: DataFrame, columns: Sequence[str], accuracy: int = SKETCH_ACCURACY, estimate: int | None = None) -> DataFrame:
    """One row with the median of every column, nulls skipped.

    Exact unless ``estimate`` gives the size of a quantile sketch (8 to 65,535): then one pass over ``df`` takes the
    value of a row whose rank is off by about 3 / ``estimate`` of the rows, and nothing is stored or moved but sketches.
    """
    numbers = _without_nan(df, columns)
    if estimate is None:
        found = quantiles(numbers, [(1, 2)], interpolated={c: c for c in columns}, accuracy=accuracy)
        return found.select(*(F.col(c)[0].alias(c) for c in columns))
    sketched = numbers.agg(*(F.kll_sketch_agg_double(F.col(c).cast("double"), estimate).alias(c) for c in columns))
    return sketched.select(*(
        F.when(F.kll_sketch_get_n_double(c) > 0, F.kll_sketch_get_quantile_double(c, F.lit(0.5))).alias(c) for c in columns
    ))


def fill_median(df: DataFrame, columns: Sequence[str] = config.MEDIAN_COLUMNS, accuracy: int = SKETCH_ACCURACY,
                estimate: int | None = None, found: DataFrame | None = None) -> DataFrame:
    """Fill null numbers with the column's median over all rows (see :func:`medians`); the result is a double.

    ``df`` is read three times, with an ``estimate`` twice: store it first if it is more than a scan.  Medians
    that are already ``found``, as one row, are taken as they are.
    """
    df = _without_nan(df, columns)
    middle = df.withColumn("_middle", scalar_struct(medians(df, columns, accuracy, estimate) if found is None else found))
    return middle.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col("_middle")[c]) for c in columns}).drop("_middle")


def keep_first(df: DataFrame, key: str | Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row per key in the given order; null keys form one group.

    Spark reduces every key to one candidate per input task before the shuffle (window group
    limit), so a key that holds a large share of the rows does not end up in one task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def keep_first_peers(df: DataFrame, key: str | Sequence[str], order: Sequence[str | Column], peers: str) -> DataFrame:
    """All rows per key that share the first place in the given order, and how many they are in ``peers``.

    Without an order all rows of a key share it.  As in :func:`keep_first`, few rows per key and task are moved.
    """
    of_key = Window.partitionBy(*([key] if isinstance(key, str) else key))
    if order:
        df = df.withColumn("_place", F.rank().over(of_key.orderBy(*order))).where("_place = 1").drop("_place")
    return df.withColumn(peers, F.count(F.lit(1)).over(of_key))


def require(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a null in any of the columns (all columns by default)."""
    return df.dropna("any", subset=list(columns) if columns is not None else None)


def filter_zscore(df: DataFrame, columns: Sequence[str] = config.OUTLIER_COLUMNS, limit: float = config.Z_LIMIT) -> DataFrame:
    """Keep rows whose population z-score is below the limit in every column.

    A null value or NaN, or a column without spread, fails the test.
    """
    df = _without_nan(df, columns)
    stats = df.agg(
        *(F.avg(c).alias(f"{c}_mean") for c in columns),
        *(F.stddev_pop(c).alias(f"{c}_sd") for c in columns),
    )
    known = F.col("_stats")
    inside = [
        F.abs(F.try_divide(F.col(c).cast("double") - known[f"{c}_mean"], known[f"{c}_sd"])) < F.lit(float(limit))
        for c in columns
    ]
    return df.withColumn("_stats", scalar_struct(stats)).where(reduce(and_, inside)).drop("_stats")
