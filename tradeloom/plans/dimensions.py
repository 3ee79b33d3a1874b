"""Conformed customer and product dimensions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeloom.functions.text import category_id, extract_int_key, product_code, strip_literal


def build_customer(cust: DataFrame, cust_info: DataFrame, loc: DataFrame, on_bad: str = "null") -> DataFrame:
    """Customers present in all three tables, matched on the digits of their keys.

    The three tables have a row per customer each, so they are sorted and merged: files that look small enough to
    broadcast one may hold millions of rows.
    """
    people = cust.withColumn("CID", extract_int_key(F.col("CID"), on_bad))
    info = cust_info.withColumnRenamed("cst_key", "CID").withColumn("CID", extract_int_key(F.col("CID"), on_bad))
    places = loc.withColumn("CID", extract_int_key(strip_literal(F.col("CID"), "-"), on_bad))
    return people.join(info.hint("merge"), "CID", "inner").join(places.hint("merge"), "CID", "inner")


def build_product(prd: DataFrame, cat: DataFrame) -> DataFrame:
    """Product versions with their category; a product without a category keeps nulls."""
    keyed = prd.withColumn("ID", category_id(F.col("prd_key")))
    return keyed.join(cat, "ID", "left").withColumn("prd_key", product_code(F.col("prd_key")))
