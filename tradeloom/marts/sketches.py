"""Estimates that merge: distinct customers and orders, and quantiles of revenue and age, for any months and countries.

Exact distinct counts and quantiles need the sales rows for every new filter.  :func:`month_sketches` keeps a few kilobytes
per month and country instead; a range of months or a choice of countries is answered by merging those.  Exact marts stay the
default; these are for callers that accept the stated errors.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeloom.functions.dates import as_of_date, month_end

LG_BUCKETS = 12  # relative standard error of distinct counts: 1.04 / sqrt(2 ** 12), 1.6 percent
RANK_SIZE = 800  # error of a quantile's rank: about 0.4 percent of the rows
DISTINCT = {"customers": "CID", "orders": "sls_ord_num"}
VALUES = {"revenue": "Revenue", "age": "customer_age"}


def month_sketches(base: DataFrame, by: Sequence[str] = ("CNTRY",), lg_buckets: int = LG_BUCKETS, rank_size: int = RANK_SIZE) -> DataFrame:
    """A row per month (its last day) and group: row count and sketches of the columns that ``base`` has.

    Sketches of partial groups are merged before the shuffle, so a hot group costs one sketch per task.
    """
    distinct = {n: c for n, c in DISTINCT.items() if c in base.columns}
    values = {n: c for n, c in VALUES.items() if c in base.columns}
    return base.groupBy(month_end(F.col("order_date")).alias("month"), *by).agg(
        F.count("*").alias("rows"),
        *(F.hll_sketch_agg(c, lg_buckets).alias(f"{n}_distinct") for n, c in distinct.items()),
        *(F.kll_sketch_agg_double(F.col(c).cast("double"), rank_size).alias(f"{n}_ranks") for n, c in values.items()),
    )


def of_months(sketches: DataFrame, start=None, end=None) -> DataFrame:
    """The months whose last day lies in the range."""
    if start is not None:
        sketches = sketches.where(F.col("month") >= as_of_date(start))
    return sketches if end is None else sketches.where(F.col("month") <= as_of_date(end))


def distinct_estimates(sketches: DataFrame, by: Sequence[str] = (), lg_buckets: int = LG_BUCKETS) -> DataFrame:
    """Estimated distinct customers and orders (``<name>_estimate``) over all months and groups that are merged."""
    names = [c.removesuffix("_distinct") for c in sketches.columns if c.endswith("_distinct")]
    return sketches.groupBy(*by).agg(
        F.sum("rows").alias("rows"), *(F.hll_sketch_estimate(F.hll_union_agg(f"{n}_distinct")).alias(f"{n}_estimate") for n in names),
    )


def quantile_estimates(sketches: DataFrame, fractions: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Estimated quantiles (``<name>_quantiles``, an array in the order of ``fractions``); null where there is no value."""
    names = [c.removesuffix("_ranks") for c in sketches.columns if c.endswith("_ranks")]
    wanted = F.array(*(F.lit(float(f)) for f in fractions))
    merged = sketches.groupBy(*by).agg(*(F.kll_merge_agg_double(f"{n}_ranks").alias(n) for n in names))
    filled = lambda n: F.when(F.kll_sketch_get_n_double(n) > 0, F.kll_sketch_get_quantile_double(n, wanted))
    return merged.select(*by, *(filled(n).alias(f"{n}_quantiles") for n in names))
