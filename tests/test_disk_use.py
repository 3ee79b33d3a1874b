"""What steps leave on disk, and which dimensions pass through the driver."""

import time

import pytest
from pyspark.sql import functions as F

from tests.test_pipelines import AS_OF, raw  # noqa: F401
from tradeloom.materialize import discard, materialize, released, shared_dir
from tradeloom.plans.dimensions import build_customer, build_product
from tradeloom.plans.fact import build_fact
from tradeloom.plans.warehouse import build_warehouse, clean_warehouse


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {line for line in files.split("\n") if "/shuffle_" in line}


def _stored(spark):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
    folders = set()
    while found.hasNext():
        folders.add(found.next().getPath().getParent().toString().split(":")[-1])
    return folders


def test_stored_steps_leave_no_shuffle_files(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = _shuffle_files(spark), spark.conf.get(key, None)
    stored = materialize(spark.range(5000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        if not _shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before and spark.conf.get(key, None) == setting
    assert {r["k"]: r["count"] for r in stored.collect()} == {k: 5000 // 7 + (k < 5000 % 7) for k in range(7)}


def test_discard_deletes_one_stored_table(spark):
    with released(spark):
        gone, kept = materialize(spark.range(3)), materialize(spark.range(4))
        folders = [{f.rsplit("/", 1)[0].split(":")[-1].replace("//", "") for f in df.inputFiles()} for df in (gone, kept)]
        discard(gone)
        assert not folders[0] & _stored(spark) and folders[1] <= _stored(spark) and kept.count() == 4


def test_warehouse_deletes_its_steps(spark, raw):  # noqa: F811
    customer = build_customer(raw["cust"], raw["cust_info"], raw["loc"])
    before = _stored(spark)
    clean = build_warehouse(raw["sales"], customer, build_product(raw["prd"], raw["cat"]), as_of=AS_OF,
                            order=["_sales_row", "prd_id"], required=["sls_price"])
    left = _stored(spark) - before
    assert clean.count()
    sizes = [set(spark.read.parquet(folder).columns) for folder in left]
    # the sales are stored once, with those that had to be ranked again, besides a row of medians
    assert sum("sls_price" in columns and "sls_quantity" in columns for columns in sizes) == 2 and len(left) <= 4


@pytest.mark.parametrize("repeat", [None, "customer", "product"])
def test_warehouse_without_row_order_equals_the_cleaned_fact(raw, repeat):  # noqa: F811
    """The values decide as in the fact where customers or products share a place, also if the places are not shown."""
    customer = build_customer(raw["cust"], raw["cust_info"], raw["loc"])
    customer = customer.where("coalesce(CNTRY, '') <> 'DE '").withColumn("_cust_row", F.col("CID"))
    product = build_product(raw["prd"], raw["cat"]).withColumn("_prd_row", F.col("prd_id"))
    if repeat == "customer":
        customer = customer.unionByName(customer.withColumn("CNTRY", F.lit("FRANCE")))
    if repeat == "product":
        product = product.unionByName(product.withColumn("prd_cost", F.col("prd_cost") + 7))
    arguments = {"key": ["sls_ord_num", "prd_key"], "required": ["sls_price"]}
    early = build_warehouse(raw["sales"], customer, product, as_of=AS_OF, **arguments)
    late = clean_warehouse(build_fact(raw["sales"], customer, product), AS_OF, **arguments)
    rows = [sorted(map(repr, df.select(sorted(late.columns)).collect())) for df in (early, late)]
    assert rows[0] == rows[1] and rows[0]


def test_dimensions_of_many_rows_are_not_broadcast(spark):
    """Files of a few kilobytes, as most columns have one value."""
    sales = spark.range(1000).selectExpr("id % 10 as sls_cust_id", "concat('P', id % 10) as sls_prd_key")
    customer = spark.range(150_000).selectExpr("id as CID", "'a long name that all of them have' as cst_name")
    product = spark.range(150_000).selectExpr("concat('P', id) as prd_key", "'another name' as prd_nm")
    plan = lambda rows: build_fact(sales, customer.where(f"CID < {rows}"), product.limit(rows))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan(150_000) and plan(50).count("BroadcastHashJoin") >= 2
    key = "concat('C', id) as"
    columns = [f"{key} CID", "'1980-01-01' as BDATE"], [f"{key} cst_key", "'Ann' as cst_firstname"], [f"{key} CID", "'us' as CNTRY"]
    stored = [materialize(spark.range(1000).selectExpr(*c)) for c in columns]
    joined = build_customer(*stored)
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 1000
