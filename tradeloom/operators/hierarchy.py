"""Totals along a path of nested categories."""

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeloom.functions.numbers import total


def hierarchy(df: DataFrame, path: Sequence[str], measure: str) -> DataFrame:
    """Measure per node of every level (1 = outermost), without the grand total.

    A node whose own name or that of a node above it is null is left out, as null group keys are everywhere; its rows still
    count in the named nodes above it.
    Leaves are summed first, so the roll-up expands leaf rows and not the input rows.
    """
    depth = len(path)
    leaves = df.groupBy(*path).agg(F.sum(measure).alias(measure))
    nodes = leaves.rollup(*path).agg(total(F.col(measure)).alias(measure), F.grouping_id().alias("_gid"))
    level = F.lit(depth) - F.bit_count("_gid")
    named = reduce(and_, (F.col(c).isNotNull() | (level <= i) for i, c in enumerate(path)))
    return (
        nodes.where((F.col("_gid") < 2**depth - 1) & named)
        .select(*path, level.cast("int").alias("level"), F.col(measure).cast(leaves.schema[measure].dataType).alias(measure))
    )
