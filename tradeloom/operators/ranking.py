"""Global ranks and top-k groups."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeloom import config
from tradeloom.materialize import materialize

_ROW_BITS = 33  # low bits of monotonically_increasing_id: the row's place in its partition


def global_rank(df: DataFrame, key: str, tie: Sequence[str], out: str = "rank") -> DataFrame:
    """Add the row number 1..n by ``key``, ties broken by ``tie`` (together unique); null keys get null.

    Rows are range-partitioned by key *and* tie, so one value shared by most rows is
    still spread over partitions.  Each row stores its place in its partition; adding the number of
    rows in earlier partitions gives the rank without a global window.
    """
    order = [F.col(key).asc_nulls_last(), *(F.col(c).asc_nulls_last() for c in tie)]
    placed = materialize(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    )
    part = F.shiftright("_place", _ROW_BITS)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range partition: a few thousand at most, whatever the data size.
    offsets = (
        placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    )
    place = F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(out, F.when(F.col(key).isNotNull(), F.col("_offset") + place + 1))
        .drop("_part", "_place", "_offset")
    )


def top_k(df: DataFrame, key: str, measure: str, k: int = config.TOP_K) -> DataFrame:
    """The k rows with the largest measure; ties by key."""
    return df.where(F.col(measure).isNotNull()).orderBy(F.col(measure).desc(), F.col(key).asc()).limit(k)


def sort_nulls_last(column: str, ascending: bool = True) -> Column:
    return F.col(column).asc_nulls_last() if ascending else F.col(column).desc_nulls_last()
