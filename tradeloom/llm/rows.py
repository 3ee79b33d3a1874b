"""Keep a caller's columns apart from those an operator works with."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def boxed(df: DataFrame, *replaced: str) -> DataFrame:
    """All columns but the ``replaced`` ones as the single struct ``_row``, so that no name can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in replaced]).alias("_row"))


def unboxed(df: DataFrame, *added: str) -> DataFrame:
    return df.select("_row.*", *added)
