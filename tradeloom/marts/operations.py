"""Fulfilment, order density and country figures."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeloom.functions.dates import weekday
from tradeloom.functions.numbers import mean, total
from tradeloom.operators.calendar import resample


def fulfilment_time(base: DataFrame) -> DataFrame:
    """Mean days from order to shipment per maintenance flag and category."""
    return base.dropna("any", subset=["MAINTENANCE", "CAT"]).groupBy("MAINTENANCE", "CAT").agg(
        mean(F.col("order_to_ship_days")).alias("order_to_ship_days")
    )


def daily_orders(base: DataFrame) -> DataFrame:
    """Distinct orders per day, days without orders as zero."""
    return resample(base, "order_date", "day", orders=F.countDistinct("sls_ord_num"))


def order_density(base: DataFrame) -> DataFrame:
    """Daily distinct orders added up per weekday (Monday is 0) and month number."""
    date = F.col("order_date")
    return daily_orders(base).groupBy(weekday(date).alias("weekday"), F.month(date).alias("month")).agg(
        total(F.col("orders")).alias("orders")
    )


def country_ops(base: DataFrame) -> DataFrame:
    """Mean delivery delays and margin per country."""
    return base.where(F.col("CNTRY").isNotNull()).groupBy("CNTRY").agg(
        mean(F.col("order_to_ship_days")).alias("order_to_ship_days"),
        mean(F.col("ship_delay")).alias("ship_delay"),
        F.avg("Margin").alias("Margin"),
    )
