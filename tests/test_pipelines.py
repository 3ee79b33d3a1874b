import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradeloom.marts import customers, explorer, operations, products, sales
from tradeloom.plans.dashboard import dashboard_base
from tradeloom.plans.dimensions import build_customer, build_product
from tradeloom.plans.fact import build_fact
from tradeloom.plans import warehouse
from tradeloom.plans.warehouse import build_warehouse, clean_warehouse

AS_OF = dt.date(2020, 1, 1)
D = dt.date


@pytest.fixture
def raw(spark):
    """Six raw tables with each kind of fault once."""
    make = spark.createDataFrame
    return {
        "cust": make([("NAS01", "1980-01-01", " male "), ("X2", "bad", "F"), ("none", "1970-01-01", "M"),
                      (None, "1970-01-01", "M"), ("4", "1990-06-01", "F")], "CID string, BDATE string, GEN string"),
        "cust_info": make([(1.0, "AW0001", "Ann", "Lee", "M", "Female", "2015-01-01"),
                           (2.0, "AW0002", None, "Ray", None, None, "2015-02-01"),
                           (3.0, "AW0003", "Cy", "Doe", "S", "m", "2015-03-01"),
                           (4.0, "AW0004", "Di", "Fox", "S", "m", "2015-03-01")],
                          "cst_id double, cst_key string, cst_firstname string, cst_lastname string, "
                          "cst_marital_status string, cst_gndr string, cst_create_date string"),
        "loc": make([("AW-00-01", "us"), ("AW-0002", None), ("AW-00-02", "DE "), ("AW-5", "FR"), ("A4", " de")],
                    "CID string, CNTRY string"),
        "prd": make([(1, "CO-PE-AB", "Pedal", 10.0, "R ", "2011-07-01", None),
                     (2, "AC-HE-CD", "Helmet", 20.0, "S ", "2011-07-01", "2012-06-30"),
                     (3, "AC-HE-CD", "Helmet", 30.0, "S ", "2012-07-01", None),
                     (4, "AC-HE-EF", "Lock", None, "S ", "2012-07-01", "2011-01-01")],
                    "prd_id bigint, prd_key string, prd_nm string, prd_cost double, prd_line string, "
                    "prd_start_dt string, prd_end_dt string"),
        "cat": make([("CO_PD", "Components", "Pedals", "No"), ("AC_HE", "Accessories", "Helmets", "Yes")],
                    "ID string, CAT string, SUBCAT string, MAINTENANCE string"),
        "sales": make([("SO1", "CD", 1, 20190105, 20190107, 20190110, 20.0, 1, 20.0, 0),
                       ("SO1", "EF", 1, 20190105, 20190107, 20190110, 5.0, 1, 5.0, 1),
                       ("SO2", "CD", 2, 20190301, 20190228, 20190401, None, 1, None, 2),
                       ("SO3", "CD", 9, 20190301, 20190302, 20190401, 20.0, 2, 20.0, 3),
                       ("SO4", "EF", 4, 0, 20190302, 20190401, 20.0, 2, 20.0, 4),
                       ("SO5", "EF", 4, 20190401, 20190402, 20190501, 8.0, 2, 4.0, 5),
                       ("SO6", "AB", 1, 20190401, 20190402, 20190501, 8.0, 2, 4.0, 6)],
                      "sls_ord_num string, sls_prd_key string, sls_cust_id bigint, sls_order_dt bigint, "
                      "sls_ship_dt bigint, sls_due_dt bigint, sls_sales double, sls_quantity bigint, "
                      "sls_price double, _sales_row bigint"),
    }


@pytest.fixture
def fact(raw):
    customer = build_customer(raw["cust"], raw["cust_info"], raw["loc"])
    return build_fact(raw["sales"], customer, build_product(raw["prd"], raw["cat"]))


def test_customer_dimension(raw):
    rows = build_customer(raw["cust"], raw["cust_info"], raw["loc"]).orderBy("CID", "CNTRY").collect()
    assert [(r.CID, r.CNTRY) for r in rows] == [(1, "us"), (2, None), (2, "DE "), (4, " de")]
    with pytest.raises(Exception, match="no integer key"):
        build_customer(raw["cust"], raw["cust_info"], raw["loc"], on_bad="fail").collect()


def test_product_dimension_keeps_orphans(raw):
    rows = build_product(raw["prd"], raw["cat"]).orderBy("prd_id").collect()
    assert [(r.prd_key, r.ID, r.CAT) for r in rows] == [
        ("AB", "CO_PE", None), ("CD", "AC_HE", "Accessories"), ("CD", "AC_HE", "Accessories"), ("EF", "AC_HE", "Accessories")]


def test_fact_fans_out_and_keeps_unknown_customers(fact):
    rows = fact.collect()
    # lines of SO2 meet two locations and two versions, SO1/CD and SO3 two versions
    count = {}
    for r in rows:
        count[(r.sls_ord_num, r.prd_key)] = count.get((r.sls_ord_num, r.prd_key), 0) + 1
    assert count == {("SO1", "CD"): 2, ("SO1", "EF"): 1, ("SO2", "CD"): 4, ("SO3", "CD"): 2, ("SO4", "EF"): 1,
                     ("SO5", "EF"): 1, ("SO6", "AB"): 1}
    assert {r.cst_firstname for r in rows if r.sls_ord_num == "SO3"} == {None}


def test_clashing_names_get_suffixes(spark):
    sales_rows = spark.createDataFrame([(1, "K", "s")], "sls_cust_id bigint, sls_prd_key string, note string")
    customer = spark.createDataFrame([(1, "c")], "CID bigint, note string")
    product = spark.createDataFrame([("K", "p")], "prd_key string, note string")
    assert build_fact(sales_rows, customer, product).select("note", "note_cust", "note_prd").first() == ("s", "c", "p")


def test_clean_warehouse_default_drops_open_ended_products(fact):
    clean = clean_warehouse(fact, AS_OF, order=["_sales_row", "prd_id"])
    rows = clean.collect()
    assert [r.sls_ord_num for r in sorted(rows, key=lambda r: r.sls_ord_num)] == ["SO1", "SO5"]
    first = next(r for r in rows if r.sls_ord_num == "SO1")
    assert (first.prd_id, first.GEN, first.CNTRY, first.is_active_product) == (2, "MALE", "US", False)
    assert (first.customer_age, first.order_to_ship_days, first.order_date_month) == (40, 2, "January")
    assert len(clean.columns) == 37 and "cst_id" in clean.columns  # an unknown customer keeps cst_id
    assert not {"cst_gndr", "full_category", "_sales_row"} & set(clean.columns)


def test_clean_warehouse_with_required_columns(fact):
    rows = clean_warehouse(fact, AS_OF, order=["_sales_row", "prd_id"], key=["sls_ord_num", "prd_key"],
                           required=["order_date", "CID"]).collect()
    found = {(r.sls_ord_num, r.prd_key): r for r in rows}
    assert set(found) == {("SO1", "CD"), ("SO1", "EF"), ("SO2", "CD"), ("SO3", "CD"), ("SO5", "EF"), ("SO6", "AB")}
    assert found["SO6", "AB"].is_active_product is True
    # medians over the joined rows, fan-out included: costs 20,20,20,20,30,30,30,30,10 and prices
    assert found["SO1", "EF"].prd_cost == 20.0
    assert found["SO2", "CD"].sls_price == 20.0 and found["SO2", "CD"].order_to_ship_days == -1
    assert found["SO2", "CD"].cst_firstname == "Not Specified" and found["SO2", "CD"].birth_date is None


def test_dates_may_be_parsed_before_the_joins(raw, fact):
    customer = build_customer(raw["cust"], raw["cust_info"], raw["loc"])
    early = build_warehouse(raw["sales"], customer, build_product(raw["prd"], raw["cat"]), as_of=AS_OF,
                            order=["_sales_row", "prd_id"], required=["CID"])
    late = clean_warehouse(fact, AS_OF, order=["_sales_row", "prd_id"], required=["CID"])
    assert sorted(map(repr, early.select(sorted(early.columns)).collect())) == sorted(
        map(repr, late.select(sorted(late.columns)).collect()))


def test_row_order_reaches_the_marts(fact):
    kept = clean_warehouse(fact, key=["sls_ord_num", "prd_key"], required=["order_date"], row_order="raw_row")
    assert not [c for c in kept.columns if c.startswith("_")]
    rows = dashboard_base(kept, dt.date(2020, 1, 1))
    first = rows.orderBy("raw_row").where("CID = 2 and CNTRY is not null").first()
    found = customers.customer_metrics(rows, dt.date(2020, 1, 1), ("raw_row",)).where("CID = 2").first()
    assert found.country == first.CNTRY
    assert [r.raw_row["_sales_row"] for r in rows.orderBy("raw_row").collect()] == sorted(
        r.raw_row["_sales_row"] for r in rows.collect())


def test_identifier_column_is_dropped_when_equal(fact):
    known = fact.where("CID <> 9")
    assert len(clean_warehouse(known, AS_OF, order=["_sales_row", "prd_id"]).columns) == 36


BASE = [
    # ord, CID, order, ship, due, GEN, CNTRY, birth, qty, price, cost, CAT, SUBCAT, name, maintenance
    (1, 10, D(2019, 1, 5), D(2019, 1, 7), D(2019, 1, 17), "MALE", "us", D(1980, 1, 1), 2, 10.0, 6.0, "A", "a", "p", "Yes"),
    (1, 10, D(2019, 1, 5), D(2019, 1, 9), D(2019, 1, 17), "MALE", "us", D(1980, 1, 1), 1, 0.0, 6.0, "B", "b", "q", "No"),
    (2, 10, D(2019, 3, 5), D(2019, 3, 6), D(2019, 3, 17), None, "USA", D(1980, 1, 1), 1, 30.0, 15.0, "A", "a", "r", "Yes"),
    (3, 11, D(2019, 3, 9), D(2019, 3, 8), D(2019, 3, 10), "m", None, None, 1, 50.0, 60.0, None, None, "s", None),
]
COLUMNS = (
    "sls_ord_num int, CID int, order_date date, ship_date date, due_date date, GEN string, CNTRY string, birth_date date, "
    "sls_quantity int, sls_price double, prd_cost double, CAT string, SUBCAT string, prd_nm string, MAINTENANCE string"
)


@pytest.fixture
def base(spark):
    return dashboard_base(spark.createDataFrame(BASE, COLUMNS), AS_OF)


def test_dashboard_base(base):
    rows = base.orderBy("sls_ord_num", "sls_price").collect()
    assert [(r.Revenue, r.Cost, r.Profit, r.Margin) for r in rows] == [
        (0.0, 6.0, -6.0, None), (20.0, 12.0, 8.0, 40.0), (30.0, 15.0, 15.0, 50.0), (50.0, 60.0, -10.0, -20.0)]
    assert [(r.GEN, r.CNTRY, r.customer_age) for r in rows[1:]] == [
        ("Male", "UNITED STATES", 40), (None, "UNITED STATES", 40), ("m", None, None)]
    assert [(r.order_to_ship_days, r.ship_delay) for r in rows[2:]] == [(1, 11), (-1, 2)]


def test_sales_mart(base):
    kpi = sales.sales_kpis(base).first()
    assert (kpi.total_revenue, kpi.active_customers, kpi.avg_order_value) == (100.0, 2, 25.0)
    assert kpi.avg_margin == pytest.approx(70 / 3)
    assert [tuple(r) for r in sales.monthly_revenue(base).orderBy("order_date").collect()] == [
        (D(2019, 1, 31), 20.0), (D(2019, 2, 28), 0.0), (D(2019, 3, 31), 80.0)]
    assert [tuple(r) for r in sales.country_top(base).collect()] == [("UNITED STATES", 50.0)]
    assert sorted(tuple(r) for r in sales.category_trend(base).collect()) == [
        (D(2019, 1, 31), "A", 20.0), (D(2019, 1, 31), "B", 0.0), (D(2019, 3, 31), "A", 30.0)]


def test_customer_metrics(base):
    ten, eleven = customers.customer_metrics(base, AS_OF).orderBy("CID").collect()
    assert (ten.total_orders, ten.unique_orders, ten.categories_bought, ten.gender, ten.country, ten.age) == (
        3, 2, 2, "Male", "UNITED STATES", 40)
    assert (ten.customer_lifespan_days, ten.recency_days, ten.total_revenue) == (59, 302, 50.0)
    assert ten.purchase_frequency == 3 / 60 and ten.profit_margin == pytest.approx(34.0)
    assert ten.revenue_std == pytest.approx(15.2752523)
    assert (eleven.revenue_std, eleven.country, eleven.categories_bought, eleven.age) == (None, None, 0, None)


def test_cohorts(base):
    rows = sorted(tuple(r) for r in customers.new_vs_returning(base).collect())
    assert rows == [(D(2019, 1, 31), "New", 1), (D(2019, 3, 31), "New", 1), (D(2019, 3, 31), "Returning", 1)]
    assert sorted(tuple(r) for r in customers.monthly_active(base).collect()) == [(D(2019, 1, 31), 1), (D(2019, 3, 31), 2)]


def test_segments_and_their_marts(spark):
    rows = [(100 + i, c, D(2019, 1 + c % 11, 1 + i % 27), D(2019, 12, 1), D(2019, 12, 2), ["MALE", "female", "M"][c % 3],
             "DE", D(1950 + c, 1, 1), 1, float(10 * c + i), 5.0, "A", "a", "p", "Yes")
            for c in range(1, 33) for i in range(1 + c % 7)]
    segments = customers.build_segments(dashboard_base(spark.createDataFrame(rows, COLUMNS), AS_OF), AS_OF)
    found = segments.collect()
    assert len(found) == 32
    assert {s for r in found for s in (r.recency_score, r.frequency_score, r.monetary_score)} == {1, 2, 3, 4, 5}
    for score, value in (("recency_score", lambda r: -r.recency_days), ("monetary_score", lambda r: r.total_revenue),
                         ("frequency_score", lambda r: (r.total_orders, r.CID))):
        ordered = sorted(found, key=value)
        assert [r[score] for r in ordered] == sorted(r[score] for r in ordered)
    assert {r.gender for r in found} == {"Male", "Female", "Other"}
    stats = customers.segment_stats(segments).collect()
    assert sum(r.customer_count for r in stats) == 32
    kpi = customers.customer_kpis(segments).first()
    assert kpi.champions == sum(r.segment == "Champions" for r in found)
    assert kpi.repeat_customers == sum(r.total_orders > 1 for r in found)
    spread = {r.segment: r for r in customers.segment_distribution(segments).collect()}
    assert spread["Champions"].max == max(r.total_revenue for r in found if r.segment == "Champions")
    by_age = customers.age_gender_revenue(segments).collect()
    assert sum(r.total_revenue for r in by_age) == pytest.approx(sum(r.total_revenue for r in found if r.gender != "Other"))
    assert all(r.age_bin % 5 == 0 for r in by_age)


def test_half_even_rounding(spark):
    rows = [("a", 1, 0.125, 0.375, 1, 1, 0.5)]
    stats = customers.segment_stats(spark.createDataFrame(
        rows, "segment string, CID int, total_revenue double, avg_order_value double, total_orders int, recency_days int, profit_margin double"))
    assert (stats.first().avg_revenue, stats.first().avg_order_value) == (0.12, 0.38)


def test_product_mart(base):
    assert {r.CAT: r.Margin for r in products.margin_by_category(base).collect()} == {"A": 45.0, "B": None}
    only = products.product_hierarchy(base, "A").collect()
    assert {(r.CAT, r.SUBCAT, r.prd_nm): r.Revenue for r in only} == {
        ("A", None, None): 50.0, ("A", "a", None): 50.0, ("A", "a", "p"): 20.0, ("A", "a", "r"): 30.0}
    assert products.product_characteristics(base).count() == 3
    assert {r.prd_nm: r.rows for r in products.product_profile(base).collect()} == {"p": 1, "r": 1, "s": 1}
    with pytest.raises(ValueError):
        products.product_characteristics(base.drop("Margin", "sls_price", "prd_cost"))


def test_operations_mart(base):
    assert {(r.MAINTENANCE, r.CAT): r.order_to_ship_days for r in operations.fulfilment_time(base).collect()} == {
        ("Yes", "A"): 1.5, ("No", "B"): 4.0}
    days = operations.daily_orders(base).collect()
    assert len(days) == 64 and sum(r.orders for r in days) == 3
    assert sum(r.orders for r in operations.order_density(base).collect()) == 3
    (row,) = operations.country_ops(base).collect()
    assert (row.CNTRY, row.order_to_ship_days, row.Margin) == ("UNITED STATES", pytest.approx(7 / 3), 45.0)


def test_explorer(base):
    up = explorer.page(base, "CAT", True, ["sls_ord_num", "sls_price"])
    down = explorer.page(base, "CAT", False, ["sls_ord_num", "sls_price"], rows=3)
    assert [r.CAT for r in up.collect()] == ["A", "A", "B", None]
    assert [r.CAT for r in down.collect()] == ["B", "A", "A"]
    assert not any(c.endswith("_display") for c in up.columns)
    assert explorer.record_count(base).first().records == 4


def test_marts_accept_empty_input(spark):
    empty = dashboard_base(spark.createDataFrame([], COLUMNS), AS_OF)
    assert sales.sales_kpis(empty).first().total_revenue == 0
    for mart in (sales.monthly_revenue, sales.country_top, sales.category_trend, customers.new_vs_returning,
                 customers.monthly_active, products.product_hierarchy, products.margin_by_category,
                 operations.fulfilment_time, operations.order_density, operations.country_ops, customers.age_by_gender):
        assert mart(empty).collect() == [], mart.__name__
    assert customers.build_segments(empty, AS_OF).collect() == []


def test_dates_may_be_timestamps_and_text_is_strict(spark):
    from tradeloom.functions.dates import parse_date

    df = spark.sql("SELECT TIMESTAMP '2013-07-01 10:00:00' AS order_date, TIMESTAMP_NTZ '2013-07-04 00:00:00' AS ship_date")
    assert [str(x) for x in dashboard_base(df).select("order_date", "ship_date").first()] == ["2013-07-01", "2013-07-04"]
    with pytest.raises(TypeError):
        dashboard_base(spark.sql("SELECT 20130701 AS order_date"))
    texts = spark.createDataFrame([("2013-07-1T",), ("2013-07-1 ",), ("2013-07-01",)], "d string")
    assert [r[0] is None for r in texts.select(parse_date(texts["d"])).collect()] == [True, True, False]


def test_nan_is_missing(spark):
    from tradeloom.operators.cleaning import fill_median, filter_zscore

    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (float("nan"),)], "x double")
    assert sorted(r[0] for r in fill_median(df, ["x"]).collect()) == [1.0, 2.0, 2.0, 3.0]
    assert filter_zscore(df, ["x"]).count() == 3


@pytest.mark.parametrize("kind", ["decimal(18,2)", "double"])
def test_merged_spread_equals_the_spread_of_the_rows(spark, kind):
    """Large amounts that hardly differ, a hot customer, single rows and missing amounts."""
    rng = np.random.default_rng(8)
    rows = [(1, i % 50, f"c{i % 4}", round(1e7 + float(rng.random()), 2)) for i in range(3000)]
    rows += [(2, i, "c", float(i)) for i in range(5)] + [(3, 1, "c", 7.5), (4, 1, "c", None), (None, 1, "c", 1.0), (5, None, None, 2.0), (5, None, None, 4.0)]
    df = spark.createDataFrame(rows, "CID long, sls_ord_num long, CAT string, amount double").repartition(5)
    df = df.selectExpr("CID", "sls_ord_num", "CAT", f"cast(amount as {kind}) as Revenue", f"cast(1 as {kind}) as Profit", "date'2020-01-05' as order_date",
                       "'X' as CNTRY", "'M' as GEN", "30 as customer_age")
    got = {r["CID"]: r for r in customers.customer_metrics(df, AS_OF).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    want = np.std([r[3] for r in rows if r[0] == 1], ddof=1)
    assert got[1]["revenue_std"] == pytest.approx(want, rel=1e-9 if kind != "double" else 1e-3)
    assert got[2]["revenue_std"] == pytest.approx(np.std(range(5), ddof=1))
    assert got[3]["revenue_std"] is None and got[4]["revenue_std"] is None and got[5]["revenue_std"] == pytest.approx(2**0.5)
    assert (got[1]["unique_orders"], got[1]["categories_bought"], got[1]["total_orders"]) == (50, 4, 3000)
    assert (got[5]["unique_orders"], got[5]["categories_bought"], got[4]["total_revenue"]) == (0, 0, 0)


def _all_rows(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


@pytest.mark.parametrize("key", ["sls_ord_num", ["sls_ord_num", "prd_key"]])
@pytest.mark.parametrize("order", [None, ["_sales_row", "prd_id"], ["sls_due_dt_parsed"]])
def test_warehouse_equals_the_cleaned_fact_with_repeated_rows(raw, key, order):
    """Sales, customers and products that repeat, share a place or have no key; orders that the tables share."""
    sales_rows = raw["sales"].withColumn("sls_due_dt_parsed", F.col("sls_due_dt"))
    moved = sales_rows.withColumn("sls_price", F.col("sls_price") + 1)
    lost = sales_rows.withColumn("sls_ord_num", F.lit(None).cast("string")).withColumn("sls_cust_id", F.lit(None).cast("bigint"))
    sales_rows = sales_rows.unionByName(sales_rows).unionByName(moved).unionByName(lost)
    customer = build_customer(raw["cust"], raw["cust_info"], raw["loc"])
    customer = customer.unionByName(customer.withColumn("CNTRY", F.lit("FRANCE"))).unionByName(customer.withColumn("CID", F.lit(None).cast("bigint")))
    product = build_product(raw["prd"], raw["cat"])
    product = product.unionByName(product.withColumn("prd_cost", F.col("prd_cost") + 7))
    early = build_warehouse(sales_rows, customer, product, as_of=AS_OF, key=key, order=order, required=["sls_price"], row_order="place")
    late = clean_warehouse(build_fact(sales_rows, customer, product), AS_OF, key=key, order=order, required=["sls_price"], row_order="place")
    assert early.columns == [c for c in early.columns if c in late.columns] and set(early.columns) == set(late.columns)
    assert _all_rows(early) == _all_rows(late)


def test_warehouse_stores_no_row_that_cannot_come_first(raw, monkeypatch):
    stored = []
    keep = warehouse.materialize
    monkeypatch.setattr(warehouse, "materialize", lambda df: stored.append(keep(df)) or stored[-1])
    customer = build_customer(raw["cust"], raw["cust_info"], raw["loc"])
    build_warehouse(raw["sales"], customer, build_product(raw["prd"], raw["cat"]), as_of=AS_OF, order=["_sales_row", "prd_id"])
    wide = [df.count() for df in stored if {"cst_firstname", "prd_nm", "sls_price"} <= set(df.columns)]
    # six orders; two locations of a customer, which no row order tells apart, stay until the values decide
    assert wide and max(wide) <= raw["sales"].select("sls_ord_num").distinct().count() + 1
