"""Margins, hierarchy and product characteristics."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeloom.functions.numbers import mean
from tradeloom.operators.cleaning import require
from tradeloom.operators.hierarchy import hierarchy

PATH = ("CAT", "SUBCAT", "prd_nm")
CHARACTERISTICS = ("prd_cost", "sls_price", "Margin", "sls_quantity")


def margin_by_category(base: DataFrame) -> DataFrame:
    """Unweighted mean row margin per category."""
    return base.where(F.col("CAT").isNotNull()).groupBy("CAT").agg(F.avg("Margin").alias("Margin"))


def product_hierarchy(base: DataFrame, category: str | None = None) -> DataFrame:
    """Revenue per category, subcategory and product, for all or one category."""
    chosen = base if category is None else base.where(F.col("CAT") == category)
    return hierarchy(chosen, PATH, "Revenue")


def product_characteristics(base: DataFrame) -> DataFrame:
    """Cost, price, margin and quantity of every row that has all of those present."""
    measures = [c for c in CHARACTERISTICS if c in base.columns]
    if len(measures) < 2:
        raise ValueError("product characteristics need at least two numeric columns")
    return require(base.select("prd_nm", *measures), measures)


def product_profile(base: DataFrame) -> DataFrame:
    """The same measures averaged per named product, a size that can be drawn."""
    rows = product_characteristics(base).where(F.col("prd_nm").isNotNull())
    measures = [c for c in rows.columns if c != "prd_nm"]
    return rows.groupBy("prd_nm").agg(F.count("*").alias("rows"), *(mean(F.col(c)).alias(c) for c in measures))
