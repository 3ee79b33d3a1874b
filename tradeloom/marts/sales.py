"""Revenue figures."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeloom import config
from tradeloom.functions.numbers import mean, total
from tradeloom.operators.calendar import by_bucket, resample
from tradeloom.operators.ranking import top_k


def sales_kpis(base: DataFrame) -> DataFrame:
    """One row: revenue, unweighted mean row margin, distinct customers, mean revenue per row."""
    return base.agg(
        total(F.col("Revenue")).alias("total_revenue"),
        F.avg("Margin").alias("avg_margin"),
        F.countDistinct("CID").alias("active_customers"),
        mean(F.col("Revenue")).alias("avg_order_value"),
    )


def monthly_revenue(base: DataFrame) -> DataFrame:
    """Revenue per month (labelled by its last day), months without sales as zero."""
    return resample(base, "order_date", "month", Revenue=total(F.col("Revenue")))


def revenue_by_country(base: DataFrame) -> DataFrame:
    return base.where(F.col("CNTRY").isNotNull()).groupBy("CNTRY").agg(total(F.col("Revenue")).alias("Revenue"))


def country_top(base: DataFrame, k: int = config.TOP_K) -> DataFrame:
    """The k countries with the largest revenue."""
    return top_k(revenue_by_country(base), "CNTRY", "Revenue", k)


def category_trend(base: DataFrame) -> DataFrame:
    """Revenue per month and category, only where there were sales."""
    return by_bucket(base, "order_date", "month", ["CAT"], Revenue=total(F.col("Revenue")))
