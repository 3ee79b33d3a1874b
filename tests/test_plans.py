"""What the physical plans must and must not contain."""

import re

import pytest

from bindings import queries as q
from tradeloom.marts import customers
from tradeloom.operators.quantiles import ROWS_PER_RANGE, _in_ranges, _ranges, _running_total
from tradeloom.plans.fact import build_fact

SF = "/root/testdata/sf0.001"

PLANS = {}


def plan_of(spark, key):
    if key not in PLANS:
        PLANS[key] = q.QUERIES[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    return PLANS[key]


@pytest.mark.parametrize("key", q.KEYS)
def test_everything_stays_in_spark_operators(spark, key):
    plan = plan_of(spark, key)
    for unwanted in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin", "Scan ExistingRDD"):
        assert unwanted not in plan, f"{key}: {unwanted}"


@pytest.mark.parametrize("key", q.KEYS)
def test_single_partition_windows_only_follow_an_aggregation(spark, key):
    """A window without a key may only see calendar buckets or partition counts."""
    plan = plan_of(spark, key).splitlines()
    for i, line in enumerate(plan):
        if re.search(r"Exchange SinglePartition", line) and any("Window" in above for above in plan[max(0, i - 3):i]):
            assert any("Aggregate" in below for below in plan[i + 1:i + 4]), f"{key}: {plan[i - 3:i + 4]}"


@pytest.mark.parametrize("distinct", [200_000, 2_000_000])
def test_ranges_of_a_running_total_do_not_grow(spark, distinct):
    """A task orders no more counted values when there are ten times as many."""
    values = spark.range(distinct).selectExpr(
        "'x' as _name", "cast(id * 7919 % 1000003 as double) + id / 1e7 as _v_min", "cast(null as decimal(38,0)) as _x_min",
        "cast(1 + id % 3 as bigint) as _rows")
    ranged = _in_ranges(values, ["_name"], _ranges(distinct, 1, 1))
    sizes = [r["count"] for r in ranged.groupBy("_range", "_name").count().collect()]
    assert max(sizes) <= 2 * ROWS_PER_RANGE and sum(sizes) == distinct
    total = _running_total(ranged, ["_name"])
    top, rows = total.agg({"_end": "max", "_rows": "sum"}).first()
    assert top == rows == sum(1 + i % 3 for i in range(distinct))


def test_scans_read_only_what_is_needed(spark):
    plan = plan_of(spark, "daily_orders")
    assert sorted(re.findall(r"ReadSchema: struct<([^>]*)>", plan)) == [
        "l_orderkey:bigint", "o_orderkey:bigint,o_orderdate:timestamp_ntz"]
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in plan_of(
        spark, "scan_filter_tables")


def test_top_k_does_not_sort_everything(spark):
    for key in ("country_top10", "explorer_page"):
        assert "TakeOrderedAndProject" in plan_of(spark, key)


def test_customer_numbers_use_hash_aggregation(spark):
    """Only the few attribute combinations per customer are aggregated by sorting."""
    plan = plan_of(spark, "customer_metrics")
    for line in plan.splitlines():
        if "SortAggregate" in line:
            assert "min_by" in line and "sum(" not in line


def test_hot_customer_is_split_in_the_fact_join(spark):
    """A customer with a third of the sales does not end up in one task."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        sales = spark.range(0, 150_000, 1, 6).selectExpr(
            "if(id % 3 = 0, 7, id % 5000) as sls_cust_id", "concat('P', id % 50) as sls_prd_key", "uuid() as note")
        people = spark.range(5000).selectExpr("id as CID", "concat('n', id) as name")
        customer = people.join(spark.range(5000).selectExpr("id as CID", "id % 7 as kind"), "CID")
        product = spark.range(50).selectExpr("concat('P', id) as prd_key", "id as prd_id")
        fact = build_fact(sales, customer, product)
        assert len(fact.collect()) == 150_000
        plan = fact._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "SortMergeJoin(skew=true) [CID" in plan


def test_small_dimensions_are_broadcast_by_size(spark):
    plan = q._fact(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"BroadcastHashJoin \[CID", plan) and re.search(r"BroadcastHashJoin \[prd_key", plan)


def test_customer_metrics_scan_the_sales_once(spark, monkeypatch):
    """The pass that stores the roll-up reads each table once, and nothing expands rows for distinct counts."""
    from tradeloom.marts import customers

    plans, store = [], customers.materialize
    monkeypatch.setattr(customers, "materialize", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or store(df))
    found = q.QUERIES["customer_metrics"](spark, SF)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 2 and plans[0].count("lineitem.parquet") == 1 and "lineitem" not in plans[1]
    assert not any("Expand" in p for p in plans)


def test_bucketed_sales_are_not_moved_for_the_customer_join(spark):
    """The rows of the stored buckets are joined where they are; a hot key is refused."""
    from tradeloom.materialize import new_path
    from tradeloom.sources.writers import write_bucketed

    sales = spark.range(0, 20_000, 1, 4).selectExpr("id % 700 as sls_cust_id", "concat('P', id % 50) as sls_prd_key", "id")
    write_bucketed(sales, "bucketed_sales", new_path(spark), ["sls_cust_id"], 6)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        customer = spark.range(700).selectExpr("id as CID", "concat('n', id) as name")
        fact = build_fact(spark.table("bucketed_sales"), customer, spark.range(50).selectExpr("concat('P', id) as prd_key", "id as prd_id"))
        plan = fact._jdf.queryExecution().executedPlan().toString().splitlines()
        assert fact.count() == 20_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE bucketed_sales")
    joined = next(i for i, line in enumerate(plan) if "SortMergeJoin [CID" in line or "ShuffledHashJoin [CID" in line)
    scan = next(i for i, line in enumerate(plan) if "Bucketed: true" in line)
    assert joined < scan and not any("Exchange" in line for line in plan[joined:scan])
    with pytest.raises(ValueError, match="largest"):
        write_bucketed(sales.selectExpr("if(id % 3 > 0, 1, sls_cust_id) as sls_cust_id"), "hot", new_path(spark), ["sls_cust_id"], 16)


def test_rollup_deals_its_rows_over_bounded_tasks(spark, monkeypatch, tmp_path):
    """A task groups no more sales rows when there are more of them, also where they come in one partition."""
    sizes = {}
    for rows in (1200, 5000):
        spark.range(rows, numPartitions=1).selectExpr(
            "id % 70 as CID", "id as sls_ord_num", "'c' as CAT", "'x' as CNTRY", "'M' as GEN", "id % 70 as customer_age",
            "date '2020-01-01' as order_date", "cast(1 as decimal(18,2)) as Revenue", "cast(1 as decimal(18,2)) as Profit",
        ).write.parquet(path := str(tmp_path / f"base {rows}"))
        base = spark.read.parquet(path)
        sizes[rows] = customers.input_bytes(base)
        assert sizes[rows] == sum(f.stat().st_size for f in (tmp_path / f"base {rows}").glob("part-*"))
        monkeypatch.setattr(customers, "BYTES_PER_TASK", 3000)
        rollup = customers.customer_rollup(base)
        plan = re.sub(r"#\d+L?", "#", rollup._jdf.queryExecution().executedPlan().toString())
        assert f"hashpartitioning(CID#, sls_ord_num#, {-(-sizes[rows] // 3000)})" in plan
        assert rollup.agg({"n": "sum"}).first()[0] == rows
    assert sizes[5000] > 2 * sizes[1200] > 6000
