"""Measures, guarded ratios and binning."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradeloom import config


def percent_of(part: Column, whole: Column) -> Column:
    """``part`` as a percentage of ``whole``; null where ``whole`` is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double")) * F.lit(100.0)


def mean(col: Column) -> Column:
    """Mean as exact sum over count, so that decimal input gives the same digits in any row order."""
    return F.try_divide(F.sum(col).cast("double"), F.count(col).cast("double"))


def total(col: Column) -> Column:
    """Sum that is 0, not null, for a group without values."""
    return F.coalesce(F.sum(col), F.lit(0))


def floor_bin(col: Column, width: int) -> Column:
    """Lower bound of the bin of the given width."""
    return (F.floor(col / F.lit(width)) * F.lit(width)).cast("bigint")


def segment(score_sum: Column, ladder: Sequence[tuple[int, str]] = config.SEGMENT_LADDER,
            lowest: str = config.LOWEST_SEGMENT) -> Column:
    """Customer segment from the integer sum of the three scores."""
    first, *rest = ladder
    label = F.when(score_sum >= first[0], first[1])
    for minimum, name in rest:
        label = label.when(score_sum >= minimum, name)
    return F.when(score_sum.isNotNull(), label.otherwise(lowest))
