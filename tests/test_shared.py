"""Results that several marts share, stored pages and estimates."""

import os

import pytest
from pyspark.sql import functions as F

from bindings import queries as q
from tradeloom.marts import pages, shared, sketches
from tradeloom.materialize import _application_dir

SF = "/root/testdata/sf0.001"


def stored_folders(spark):
    found = _application_dir(spark).removeprefix("file:").replace("//", "/")
    return {d for d, _, files in os.walk(found) if any(f.endswith(".parquet") for f in files)}


def test_four_marts_read_the_sales_once_and_leave_nothing(spark):
    rows = q.base(spark, SF, "order_date", "ship_date", "due_date", "CNTRY", "CAT", "SUBCAT", "prd_nm", "MAINTENANCE", *q.PROFIT)
    plan = shared.sales_cube(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1 and "Expand" not in plan
    before = stored_folders(spark)
    with shared.shared_cube(rows) as cube:
        marts = [shared.monthly_revenue(cube), shared.country_top(cube), shared.product_hierarchy(cube, "PROMO"), shared.country_ops(cube)]
        assert all("lineitem" not in m._jdf.queryExecution().executedPlan().toString() for m in marts)
        assert all(m.count() > 0 for m in marts) and len(stored_folders(spark)) > len(before)
    assert stored_folders(spark) == before


def test_cube_without_some_columns(spark):
    rows = spark.createDataFrame([(1.0, None), (2.0, None)], "Revenue double, order_date date")
    cube = shared.sales_cube(rows)
    assert cube.columns == ["order_date", "rows", "Revenue_sum", "Revenue_count"] and cube.first()["Revenue_sum"] == 3.0
    with pytest.raises(ValueError):
        shared.sales_cube(rows.select("order_date"))


@pytest.fixture(scope="module")
def numbers(spark):
    value = F.when(F.col("id") % 5 != 0, F.col("id") * 7919 % 40)  # ties, and nulls that come last
    return spark.range(0, 1000, 1, 6).select(value.alias("v"), F.col("id"), F.col("id").cast("string").alias("t"))


@pytest.mark.parametrize("ascending", [True, False])
def test_pages_follow_the_sorted_rows(spark, numbers, ascending):
    rows = sorted(([r["v"], r["id"]] for r in numbers.collect()), key=lambda r: (r[0] is None, (r[0] or 0) * (1 if ascending else -1), r[1]))
    built = pages.build_pages(numbers, "v", ascending, ["id"], ranges=6)
    assert built.rows == 1000 and len(built.counts) > 1
    for page in (1, 2, 17, 50, 51, 80):
        got = [[r["v"], r["id"]] for r in built.page(page, 20).collect()]
        assert got == rows[(page - 1) * 20 : page * 20]
    for at in (0, 19, 333, 799, 800, 990, 999):
        got = [[r["v"], r["id"]] for r in built.after(dict(zip(("v", "id"), rows[at])), 20).collect()]
        assert got == rows[at + 1 : at + 21]
    between = built.after({"v": 7, "id": 10**9}, 5)  # a row that is not there
    want = [r for r in rows if r[0] is None or (r[0] > 7 if ascending else r[0] < 7)][:5]
    assert [[r["v"], r["id"]] for r in between.collect()] == want
    with pytest.raises(ValueError):
        built.page(0)
    with pytest.raises(ValueError, match="id"):
        built.after({"v": 7})


def test_a_page_reads_the_ranges_it_covers(spark, numbers):
    built = pages.build_pages(numbers, "v", True, ["id"])
    plan = built.page(3, 20)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(_range" in plan.replace("isnotnull", "") or "_range#" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert "_place" in plan.split("PushedFilters:")[1].split("ReadSchema")[0]
    empty = pages.build_pages(numbers.limit(0), "v", True, ["id"])
    assert empty.rows == 0 and empty.page(1).count() == 0 and empty.after({"v": 1, "id": 1}).count() == 0


def test_sketches_merge(spark):
    rows = spark.range(200_000).selectExpr(
        "id % 30000 as CID", "id as sls_ord_num", "cast(id as double) as Revenue", "cast(null as int) as customer_age",
        "date_add(date'2020-01-01', cast(id % 700 as int)) as order_date", "if(id % 3 = 0, 'A', 'B') as CNTRY")
    stored = sketches.month_sketches(rows).persist()
    every = sketches.distinct_estimates(stored).first()
    assert every["rows"] == 200_000 and abs(every["customers_estimate"] - 30_000) < 0.05 * 30_000
    assert abs(every["orders_estimate"] - 200_000) < 0.05 * 200_000
    part = sketches.distinct_estimates(sketches.of_months(stored, "2020-06-01", "2020-12-31"), ["CNTRY"]).collect()
    exact = {r[0]: r[1] for r in rows.where("order_date between '2020-06-01' and '2020-12-31'").groupBy("CNTRY").agg(F.countDistinct("CID")).collect()}
    assert all(abs(r["customers_estimate"] - exact[r["CNTRY"]]) < 0.05 * exact[r["CNTRY"]] for r in part) and len(part) == 2
    quantiles = sketches.quantile_estimates(stored, [0.1, 0.5, 0.9]).first()
    assert all(abs(v / 200_000 - f) < 0.012 for v, f in zip(quantiles["revenue_quantiles"], (0.1, 0.5, 0.9)))
    assert quantiles["age_quantiles"] is None
    assert sketches.month_sketches(rows.limit(0)).count() == 0
