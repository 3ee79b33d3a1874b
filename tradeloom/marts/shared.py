"""One pass over the sales rows that feeds several marts.

:func:`sales_cube` sums the rows per month, country, product and maintenance flag, with measures that merge: sums and counts,
never means.  Its size follows the domains, not the sales, and every mart below is a small group-by over it.
Distinct customers and orders do not merge this way; :mod:`tradeloom.marts.sketches` has estimates that do, and
the customer mart its own roll-up.
"""

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeloom import config
from tradeloom.functions.dates import month_end
from tradeloom.functions.numbers import total
from tradeloom.materialize import materialize, released
from tradeloom.operators.calendar import resample
from tradeloom.operators.hierarchy import hierarchy
from tradeloom.operators.ranking import top_k

CUBE_KEYS = ("CNTRY", "CAT", "SUBCAT", "prd_nm", "MAINTENANCE")
MEASURES = ("Revenue", "Profit", "Margin", "order_to_ship_days", "ship_delay")


def sales_cube(base: DataFrame) -> DataFrame:
    """Rows, sums and counts of each measure per month (its last day) and key; keys and measures that are absent are left out."""
    keys = [c for c in CUBE_KEYS if c in base.columns]
    measures = [c for c in MEASURES if c in base.columns]
    if not measures:
        raise ValueError(f"the base has none of {MEASURES}")
    return base.groupBy(month_end(F.col("order_date")).alias("order_date"), *keys).agg(
        F.count("*").alias("rows"),
        *(F.sum(c).alias(f"{c}_sum") for c in measures),
        *(F.count(c).alias(f"{c}_count") for c in measures),
    )


@contextmanager
def shared_cube(base: DataFrame) -> Iterator[DataFrame]:
    """The stored cube for the marts of a block; what was stored is deleted when the block ends.

    Marts are lazy and read the stored cube, so write or collect them inside the block.
    """
    with released(base.sparkSession):
        yield materialize(sales_cube(base))


def _mean(measure: str) -> Column:
    return F.try_divide(F.sum(f"{measure}_sum").cast("double"), F.sum(f"{measure}_count").cast("double"))


def sales_totals(cube: DataFrame) -> DataFrame:
    """One row: rows, revenue, unweighted mean row margin, mean revenue per row."""
    return cube.agg(
        total(F.col("rows")).alias("rows"), total(F.col("Revenue_sum")).alias("total_revenue"), _mean("Margin").alias("avg_margin"),
        _mean("Revenue").alias("avg_order_value"),
    )


def monthly_revenue(cube: DataFrame) -> DataFrame:
    """As :func:`tradeloom.marts.sales.monthly_revenue`."""
    return resample(cube, "order_date", "month", Revenue=total(F.col("Revenue_sum")))


def category_trend(cube: DataFrame) -> DataFrame:
    """As :func:`tradeloom.marts.sales.category_trend`."""
    known = cube.where(F.col("order_date").isNotNull() & F.col("CAT").isNotNull())
    return known.groupBy("order_date", "CAT").agg(total(F.col("Revenue_sum")).alias("Revenue"))


def country_top(cube: DataFrame, k: int = config.TOP_K) -> DataFrame:
    """As :func:`tradeloom.marts.sales.country_top`."""
    known = cube.where(F.col("CNTRY").isNotNull()).groupBy("CNTRY").agg(total(F.col("Revenue_sum")).alias("Revenue"))
    return top_k(known, "CNTRY", "Revenue", k)


def margin_by_category(cube: DataFrame) -> DataFrame:
    """As :func:`tradeloom.marts.products.margin_by_category`."""
    return cube.where(F.col("CAT").isNotNull()).groupBy("CAT").agg(_mean("Margin").alias("Margin"))


def product_hierarchy(cube: DataFrame, category: str | None = None) -> DataFrame:
    """As :func:`tradeloom.marts.products.product_hierarchy`."""
    chosen = cube if category is None else cube.where(F.col("CAT") == category)
    return hierarchy(chosen.withColumnRenamed("Revenue_sum", "Revenue"), ("CAT", "SUBCAT", "prd_nm"), "Revenue")


def fulfilment_time(cube: DataFrame) -> DataFrame:
    """As :func:`tradeloom.marts.operations.fulfilment_time`."""
    known = cube.dropna("any", subset=["MAINTENANCE", "CAT"])
    return known.groupBy("MAINTENANCE", "CAT").agg(_mean("order_to_ship_days").alias("order_to_ship_days"))


def country_ops(cube: DataFrame) -> DataFrame:
    """As :func:`tradeloom.marts.operations.country_ops`."""
    return cube.where(F.col("CNTRY").isNotNull()).groupBy("CNTRY").agg(
        *(_mean(c).alias(c) for c in ("order_to_ship_days", "ship_delay", "Margin"))
    )


def group_totals(cube: DataFrame, groupings: list[tuple[str, ...]]) -> DataFrame:
    """Revenue, profit and rows for several groupings of the cube at once (grouping sets), one result.

    ``grouping`` names the columns of the row's grouping, joined by commas; columns outside it are null.
    """
    names = sorted({c for g in groupings for c in g})
    sets = ", ".join("(" + ", ".join(f"`{c}`" for c in g) + ")" for g in groupings)
    out = "concat_ws(',', " + ", ".join(f"if(grouping(`{c}`) = 0, '{c}', null)" for c in names) + ")" if names else "''"
    return cube.sparkSession.sql(
        f"""SELECT {out} AS grouping, {''.join(f'`{c}`, ' for c in names)}sum(rows) AS rows,
            coalesce(sum(Revenue_sum), 0) AS Revenue, coalesce(sum(Profit_sum), 0) AS Profit
            FROM {{cube}} GROUP BY GROUPING SETS ({sets})""", cube=cube)
