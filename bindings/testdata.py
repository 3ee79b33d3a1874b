"""The library's inputs, derived by Spark from the whole star-schema tables.

The retail source files are not part of the test data.  The six raw tables and the stored warehouse are
therefore expressed over ``customer nation part orders lineitem``: every row is kept, and rules on
the keys plant the faults that real files have (bad keys, spelling variants, broken dates, nulls, outliers).
"""

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.plans.dashboard import dashboard_base
from tradeloom.sources.readers import read_table

AS_OF = dt.date(2002, 1, 1)
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")


SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir.rstrip('/')}/{name}.parquet", schema=SCHEMAS[name])


def _one_of(number: Column, *choices: str | None) -> Column:
    """Choice by ``number`` modulo the number of choices."""
    picked = F.element_at(F.array(*(F.lit(c) for c in choices)), (number % len(choices) + 1).cast("int"))
    return picked.cast("string")


def _every(number: Column, n: int, remainder: int = 0) -> Column:
    return number % n == remainder


def _yyyymmdd(date: Column) -> Column:
    return F.date_format(date, "yyyyMMdd").cast("bigint")


def _gender(key: Column) -> Column:
    return _one_of(key, "MALE", " female ", "M", "Female", None)


def _birth_date(key: Column) -> Column:
    return F.date_add(F.lit("1940-01-01").cast("date"), (key * 37 % 25000).cast("int"))


def _country(nation: Column) -> Column:
    return (
        F.when(nation == "NATION_0", "us").when(nation == "NATION_1", "USA").when(nation == "NATION_2", "DE")
        .when(nation == "NATION_3", " Germeny ").when(nation == "NATION_4", "Germeny").when(nation != "NATION_24", nation)
    )


# --- the six raw tables --------------------------------------------------------------------------


def raw_cust(spark, sf_dir) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.when(_every(key, 40, 39), "walk-in").otherwise(F.col("c_name")).alias("CID"),
        F.when(_every(key, 23), "unknown").otherwise(_birth_date(key).cast("string")).alias("BDATE"),
        _gender(key).alias("GEN"),
        key.alias("_cust_row"),
    )


def raw_cust_info(spark, sf_dir) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.cast("double").alias("cst_id"),
        F.col("c_name").alias("cst_key"),
        F.when(~_every(key, 17), F.concat(F.lit("First"), (key % 100).cast("string"))).alias("cst_firstname"),
        F.col("c_mktsegment").alias("cst_lastname"),
        _one_of(key, "M", "S", None, "D").alias("cst_marital_status"),
        _one_of(key, "Male", "f", None).alias("cst_gndr"),
        F.date_add(F.lit("2010-01-01").cast("date"), (key % 1000).cast("int")).cast("string").alias("cst_create_date"),
        key.alias("_cust_info_row"),
    )


def raw_loc(spark, sf_dir) -> DataFrame:
    """One location per customer, two for some; a hyphen splits the digits of the key."""
    key = F.col("c_custkey")
    copies = F.explode(F.sequence(F.lit(0), _every(key, 100, 50).cast("int")))
    rows = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left"
    )
    return rows.withColumn("copy", copies).select(
        F.concat(F.substring("c_name", 1, 12), F.lit("-"), F.substr(F.col("c_name"), F.lit(13))).alias("CID"),
        _country(F.col("n_name")).alias("CNTRY"),
        (key * 2 + F.col("copy")).alias("_loc_row"),
    )


def _category_code(rename_medium: bool) -> Column:
    letters = F.substring("p_type", 1, 2)
    if rename_medium:  # the lookup spells one category differently, so its products stay unmatched
        letters = F.when(F.col("p_type") == "MEDIUM", "MD").otherwise(letters)
    return letters


def _brand_code() -> Column:
    return F.lpad(F.substr(F.col("p_brand"), F.lit(7)), 2, "0")


def raw_prd(spark, sf_dir) -> DataFrame:
    """One to three versions per part; only the latest has no end date."""
    key, version = F.col("p_partkey"), F.col("version")
    last = (key % 3).cast("int")
    return table(spark, sf_dir, "part").withColumn("version", F.explode(F.sequence(F.lit(0), last))).select(
        (key * 3 + version).alias("prd_id"),
        F.concat_ws("-", _category_code(False), _brand_code(), F.concat(F.lit("P"), key.cast("string"))).alias("prd_key"),
        F.col("p_name").alias("prd_nm"),
        F.when(~_every(key, 50), F.col("p_retailprice") - version * 10).alias("prd_cost"),
        _one_of(F.col("p_size"), "R ", "M ", "S ", "T ").alias("prd_line"),
        F.concat((version + 2011).cast("string"), F.lit("-07-01")).alias("prd_start_dt"),
        F.when(version < last, F.concat((version + 2012).cast("string"), F.lit("-06-30"))).alias("prd_end_dt"),
        (key * 3 + version).alias("_prd_row"),
    )


def raw_cat(spark, sf_dir) -> DataFrame:
    pairs = table(spark, sf_dir, "part").select("p_type", "p_brand").distinct()
    return pairs.select(
        F.concat_ws("_", _category_code(True), _brand_code()).alias("ID"),
        F.col("p_type").alias("CAT"),
        F.col("p_brand").alias("SUBCAT"),
        F.when(_brand_code().cast("int") % 2 == 0, "Yes").otherwise("No").alias("MAINTENANCE"),
    )


def raw_sales(spark, sf_dir) -> DataFrame:
    order, line = F.col("l_orderkey"), F.col("l_linenumber")
    ordered = F.col("o_orderdate").cast("date")
    order_dt = (
        F.when(_every(order, 11), 0).when(_every(order, 13), 20120145).when(_every(order, 17), 12345)
        .otherwise(_yyyymmdd(ordered))
    )
    rows = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    return rows.select(
        F.when(~_every(order, 500, 499), F.concat(F.lit("SO"), order.cast("string"))).alias("sls_ord_num"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("sls_prd_key"),
        F.col("o_custkey").alias("sls_cust_id"),
        order_dt.cast("bigint").alias("sls_order_dt"),
        _yyyymmdd(F.col("l_shipdate").cast("date")).alias("sls_ship_dt"),
        _yyyymmdd(F.date_add(ordered, 30)).alias("sls_due_dt"),
        F.when(line != 5, F.col("l_extendedprice")).alias("sls_sales"),
        (F.col("l_quantity") * F.when(_every(order, 97), 40).otherwise(1)).cast("bigint").alias("sls_quantity"),
        F.when(line != 3, F.col("l_extendedprice")).alias("sls_price"),
        F.struct("l_orderkey", *LINE_ORDER).alias("_sales_row"),
    )


# --- the stored warehouse that marts read -----------------------------------------------------------

_FROM_CUSTOMER = {"CNTRY"}
_FROM_PART = {"prd_cost", "CAT", "SUBCAT", "prd_nm", "MAINTENANCE"}


def warehouse(spark, sf_dir, *columns: str) -> DataFrame:
    """The requested warehouse columns over all line items.

    Every line has exactly one order, customer and part, so a table none of whose columns
    is requested need not be joined.
    """
    wanted = set(columns)
    order, key = F.col("l_orderkey"), F.col("o_custkey")
    ordered = F.col("o_orderdate").cast("date")
    rows = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    if wanted & _FROM_CUSTOMER:
        homes = table(spark, sf_dir, "customer").join(
            table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
        )
        rows = rows.join(homes, F.col("o_custkey") == F.col("c_custkey"))
    if wanted & _FROM_PART:
        rows = rows.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    price = F.when(F.col("l_linenumber") == 7, 0).otherwise(F.col("l_extendedprice"))
    known = {
        "sls_ord_num": order,
        "line": F.col("l_linenumber"),
        "prd_key": F.col("l_partkey"),
        "supplier": F.col("l_suppkey"),
        "CID": key,
        "order_date": ordered,
        "ship_date": F.col("l_shipdate").cast("date"),
        "due_date": F.date_add(ordered, 30),
        "birth_date": _birth_date(key),
        "GEN": _gender(key),
        "CNTRY": _country(F.col("n_name")),
        "sls_quantity": F.col("l_quantity").cast("int"),
        "sls_price": price.cast("decimal(18,2)"),
        "prd_cost": F.col("p_retailprice").cast("decimal(18,2)"),
        "CAT": F.col("p_type"),
        "SUBCAT": F.col("p_brand"),
        "prd_nm": F.col("p_name"),
        "MAINTENANCE": F.when(F.col("p_size") % 2 == 0, "Yes").otherwise("No"),
    }
    return rows.select(*(known[c].alias(c) for c in columns))


def base(spark, sf_dir, *columns: str) -> DataFrame:
    """Dashboard base over the requested warehouse columns."""
    return dashboard_base(warehouse(spark, sf_dir, *columns), AS_OF)
