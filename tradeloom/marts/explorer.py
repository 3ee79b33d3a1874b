"""Sorted pages and whole exports of the base table."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeloom import config
from tradeloom.operators.ranking import sort_nulls_last
from tradeloom.plans.dashboard import DISPLAY_SUFFIX


def display_columns(base: DataFrame) -> DataFrame:
    """Show the display copy of each date under the date's own name."""
    copies = [c for c in base.columns if c.endswith(DISPLAY_SUFFIX)]
    shown = base.withColumns({c.removesuffix(DISPLAY_SUFFIX): F.col(c) for c in copies})
    return shown.drop(*copies)


def sorted_rows(base: DataFrame, sort: str, ascending: bool = True, tie: Sequence[str] = ()) -> DataFrame:
    """All rows in display form, nulls last in both directions; ``tie`` makes the order unique."""
    return display_columns(base).orderBy(sort_nulls_last(sort, ascending), *(F.col(c).asc_nulls_last() for c in tie))


def page(base: DataFrame, sort: str, ascending: bool = True, tie: Sequence[str] = (), rows: int = config.PAGE_ROWS) -> DataFrame:
    """The first rows of the sorted table."""
    return sorted_rows(base, sort, ascending, tie).limit(rows)


def record_count(base: DataFrame) -> DataFrame:
    return base.agg(F.count("*").alias("records"))
