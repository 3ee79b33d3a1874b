"""Calendar buckets, with or without the empty ones."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BUCKETS = {
    # frequency: (bucket start of a date, step, label of a bucket)
    "day": (lambda d: d, "interval 1 day", lambda d: d),
    "month": (lambda d: F.trunc(d, "MM"), "interval 1 month", lambda d: F.last_day(d)),
}


def bucket_label(date: Column, freq: str) -> Column:
    """Label of a date's bucket: the day itself, or the last day of the month."""
    start, _, label = _BUCKETS[freq]
    return label(start(date))


def resample(df: DataFrame, date: str, freq: str, **measures: Column) -> DataFrame:
    """Aggregate per calendar bucket and add a zero row for every empty bucket in between.

    The rows are read once: empty buckets are generated from the distance of each
    aggregated bucket to the next.  That window sees one row per bucket, a number the calendar bounds.
    """
    start, step, label = _BUCKETS[freq]
    found = (
        df.where(F.col(date).isNotNull()).groupBy(start(F.col(date)).alias("_bucket"))
        .agg(*(m.alias(name) for name, m in measures.items()))
    )
    following = F.lead("_bucket").over(Window.orderBy("_bucket"))
    last_empty = F.coalesce((following - F.expr(step)).cast("date"), F.col("_bucket"))
    slots = found.withColumn("_last", last_empty).withColumn(
        "_slot", F.explode(F.sequence("_bucket", "_last", F.expr(step)))
    )
    filled = [
        F.when(F.col("_slot") == F.col("_bucket"), F.col(name)).otherwise(F.lit(0)).cast(found.schema[name].dataType).alias(name)
        for name in measures
    ]
    return slots.select(label(F.col("_slot")).alias(date), *filled)


def by_bucket(df: DataFrame, date: str, freq: str, keys=(), **measures: Column) -> DataFrame:
    """Aggregate per calendar bucket and key; only combinations that occur, null keys dropped."""
    known = df.dropna("any", subset=[date, *keys])
    return known.groupBy(bucket_label(F.col(date), freq).alias(date), *keys).agg(
        *(m.alias(name) for name, m in measures.items())
    )
