"""One query per operator, each over whole tables.

Results are cast to stated types so that another engine can be compared; only sums of doubles,
whose last digits depend on row order, are rounded.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindings import testdata as td
from bindings.testdata import AS_OF, base, table
from tradeloom import config
from tradeloom.functions import dates, numbers, text
from tradeloom.marts import customers, explorer, operations, pages, products, sales, shared, sketches
from tradeloom.materialize import materialize, new_path
from tradeloom.operators import cleaning, profile, ranking
from tradeloom.operators.filters import filter_sales
from tradeloom.plans import dashboard, warehouse
from tradeloom.plans.dimensions import build_customer, build_product
from tradeloom.plans.fact import build_fact
from tradeloom.plans.staging import stage
from tradeloom.plans.warehouse import build_warehouse, convert_dates
from tradeloom.sources import footers, readers, versions, writers

MONEY = "decimal(28,2)"


def typed(df: DataFrame, spec: str) -> DataFrame:
    """Select and cast: ``"name:type name:type"``; ``double~6`` also rounds."""
    columns = []
    for item in spec.split():
        name, kind = item.split(":")
        kind, _, digits = kind.partition("~")
        col = F.col(name).cast(kind)
        columns.append((F.round(col, int(digits)) if digits else col).alias(name))
    return df.select(*columns)


# --- scans, texts, dates, measures ------------------------------------------------------------------


def scan_filter_tables(spark, d):
    lines = table(spark, d, "lineitem").where(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    return typed(lines, "l_orderkey:bigint l_partkey:bigint l_quantity:double")


def na_tokens(spark, d):
    key = F.col("c_custkey")
    spelled = table(spark, d, "customer").select(
        key, td._one_of(key, "NA", "N/A", "", "null", "nan", "Nan", "na", "<NA>").alias("token"), "c_mktsegment"
    )
    return cleaning.normalise_na(spelled)


def extract_digits_key(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.extract_int_key(F.col("c_name")).alias("key")).unionByName(
        table(spark, d, "orders").select(
            F.col("o_orderkey").alias("c_custkey"), text.extract_int_key(F.col("o_orderstatus")).alias("key")
        )
    )


def strip_hyphen_key(spark, d):
    loc = td.raw_loc(spark, d)
    return loc.select("CID", text.extract_int_key(text.strip_literal(F.col("CID"), "-")).alias("key"))


def category_id_slice(spark, d):
    return td.raw_prd(spark, d).select("prd_id", text.category_id(F.col("prd_key")).alias("ID"))


def product_code_suffix(spark, d):
    return td.raw_prd(spark, d).select("prd_id", text.product_code(F.col("prd_key")).alias("code"))


def parse_yyyymmdd(spark, d):
    return td.raw_sales(spark, d).select(
        "sls_ord_num", "sls_prd_key", "sls_order_dt", dates.parse_yyyymmdd(F.col("sls_order_dt")).alias("order_date")
    )


def parse_iso_date(spark, d):
    return td.raw_cust(spark, d).select("BDATE", dates.parse_date(F.col("BDATE")).alias("birth_date"))


def timestamp_dates(spark, d):
    """Both timestamp types become dates, and the date filter sees them."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    stored = lines.select(
        F.col("l_orderkey").alias("sls_ord_num"), F.col("l_linenumber").alias("line"), F.col("o_orderdate").alias("order_date"),
        F.col("l_shipdate").cast("timestamp").alias("ship_date"),
    )
    kept = filter_sales(dashboard.dashboard_base(stored, AS_OF), "1997-03-01", "1998-02-28")
    return typed(kept, "sls_ord_num:bigint line:int order_date:date ship_date:date order_to_ship_days:bigint")


def dates_unbounded(spark, d):
    """Open ends such as 9999-12-31 stay dates when no bounds are asked for."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    raw = table(spark, d, "orders").select(
        key,
        F.when(key % 7 == 0, 99991231).when(key % 7 == 1, 16000101).otherwise(td._yyyymmdd(day)).cast("bigint").alias("sls_order_dt"),
        F.when(key % 5 == 0, "9999-12-31").when(key % 5 == 1, "1600-01-01").otherwise(day.cast("string")).alias("prd_end_dt"),
    )
    return convert_dates(raw, bounds=None)


def is_active_flag(spark, d):
    flag = dates.parse_date(F.col("prd_end_dt")).isNull()
    return td.raw_prd(spark, d).select("prd_id", flag.alias("is_active_product"))


def fill_constant(spark, d):
    info = td.raw_cust_info(spark, d).select("cst_key", "cst_firstname", "cst_lastname", "cst_marital_status")
    return cleaning.fill_text(info)


def upper_trim(spark, d):
    people = td.raw_cust(spark, d)
    return people.select("CID", "GEN", text.standardise_text(F.col("GEN")).alias("clean"))


def map_gender_code(spark, d):
    info = td.raw_cust_info(spark, d)
    mapped = text.map_values(F.col("cst_gndr"), config.GENDER_CODES, config.UNKNOWN)
    return info.select("cst_key", mapped.alias("cst_gndr"))


def map_country(spark, d):
    return td.raw_loc(spark, d).select("CID", "CNTRY", text.map_country(F.col("CNTRY")).alias("country"))


def map_gender_ci(spark, d):
    return td.raw_cust(spark, d).select("CID", "GEN", text.map_gender(F.col("GEN")).alias("gender"))


def gender_bucket(spark, d):
    return td.raw_cust(spark, d).select("CID", "GEN", text.gender_bucket(F.col("GEN")).alias("gender"))


def category_path(spark, d):
    product = build_product(td.raw_prd(spark, d), td.raw_cat(spark, d))
    return product.select("prd_id", text.category_path(F.col("CAT"), F.col("SUBCAT")).alias("full_category"))


def _ages(spark, d, rounding):
    key = F.col("c_custkey")
    age = dates.age_years(td._birth_date(key), AS_OF, rounding)
    return table(spark, d, "customer").select("c_custkey", age.alias("age"))


def age_floor_365(spark, d):
    return _ages(spark, d, "floor")


def age_trunc_365(spark, d):
    return _ages(spark, d, "trunc")


def order_ship_delay(spark, d):
    rows = base(spark, d, "sls_ord_num", "line", "order_date", "ship_date", "due_date")
    return typed(rows, "sls_ord_num:bigint line:int order_to_ship_days:bigint ship_delay:bigint")


def month_names(spark, d):
    rows = td.warehouse(spark, d, "sls_ord_num", "line", "order_date", "ship_date", "due_date", "birth_date")
    named = ["order_date", "ship_date", "due_date", "birth_date"]
    return rows.select("sls_ord_num", "line", *(dates.month_name(F.col(c)).alias(f"{c}_month") for c in named))


def month_names_texts(spark, d):
    """Month names of the dates that raw tables hold as text."""
    info, product = td.raw_cust_info(spark, d), td.raw_prd(spark, d)
    named = [
        convert_dates(df).select(
            F.lit(c).alias("field"), F.col(key).cast("bigint").alias("key"), dates.month_name(F.col(c)).alias("month")
        )
        for df, key, c in (
            (info, "cst_id", "customer_creation_date"), (product, "prd_id", "product_start_date"), (product, "prd_id", "product_end_date")
        )
    ]
    return named[0].unionByName(named[1]).unionByName(named[2])


def revenue_measures(spark, d):
    rows = base(spark, d, "sls_ord_num", "line", "sls_quantity", "sls_price", "prd_cost")
    return typed(rows, f"sls_ord_num:bigint line:int Revenue:{MONEY} Cost:{MONEY} Profit:{MONEY}")


def margin_safe(spark, d):
    rows = base(spark, d, "sls_ord_num", "line", "sls_quantity", "sls_price", "prd_cost")
    return typed(rows, "sls_ord_num:bigint line:int Margin:double")


# --- filters, cleaning, profiling -----------------------------------------------------------------------


def filter_date_range(spark, d):
    rows = base(spark, d, "sls_ord_num", "line", "order_date")
    return typed(filter_sales(rows, "1997-03-01", "1998-02-28"), "sls_ord_num:bigint line:int order_date:date")


def filter_in_list(spark, d):
    rows = base(spark, d, "sls_ord_num", "line", "order_date", "CNTRY", "CAT")
    chosen = filter_sales(rows, countries=["UNITED STATES", "GERMANY"], categories=["PROMO", "SMALL"])
    return typed(chosen, "sls_ord_num:bigint line:int CNTRY:string CAT:string")


def filter_domains(spark, d):
    rows = base(spark, d, "order_date", "CNTRY", "CAT")
    bounds = profile.date_bounds(rows)
    values = [
        profile.domain(rows, c).select(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("CNTRY", "CAT")
    ]
    limits = bounds.select(F.lit("order_date").alias("field"), F.explode(F.array("min_date", "max_date")).alias("value"))
    return values[0].unionByName(values[1]).unionByName(limits.withColumn("value", F.col("value").cast("string")))


def distinct_marital(spark, d):
    return profile.distinct_values(td.raw_cust_info(spark, d), "cst_marital_status")


def dropna_any(spark, d):
    rows = td.raw_sales(spark, d).drop("_sales_row")
    return cleaning.require(rows)


def median_fill(spark, d):
    return _median_filled(td.raw_sales(spark, d))


def median_estimates(spark, d):
    """Rows per column, and whether the estimated median has nearly the middle rank among them."""
    rows, names = td.raw_sales(spark, d), ["sls_sales", "sls_quantity"]
    found = cleaning.medians(rows, names, estimate=2000).select(*(F.col(c).alias(f"m_{c}") for c in names))
    parts = []
    for c in names:
        value = F.col(c).cast("double")
        known = rows.select(value.alias("v")).where("v is not null")
        middle = found.select(f"m_{c}").scalar()
        low, high = F.avg((F.col("v") < middle).cast("int")), F.avg((F.col("v") <= middle).cast("int"))
        parts.append(known.agg(F.lit(c).alias("column_name"), F.count("*").alias("known"), ((low <= 0.505) & (high >= 0.495)).alias("near")))
    return parts[0].unionByName(parts[1])


def median_fill_nan(spark, d):
    """Planted NaN counts as missing: it is filled and is no part of the median."""
    sales_ = F.when(F.col("sls_cust_id") % 10 == 3, float("nan")).otherwise(F.col("sls_sales"))
    return _median_filled(td.raw_sales(spark, d).withColumn("sls_sales", sales_))


def _median_filled(sales_rows):
    rows = materialize(sales_rows.select("sls_ord_num", "sls_prd_key", "sls_sales", "sls_price"))  # three passes
    return typed(
        cleaning.fill_median(rows, ["sls_sales", "sls_price"]),
        "sls_ord_num:string sls_prd_key:string sls_sales:double~4 sls_price:double~4",
    )


def zscore_filter(spark, d):
    return typed(cleaning.filter_zscore(table(spark, d, "events"), ["value"]), "event_id:bigint value:double")


def zscore_filter_nan(spark, d):
    """Planted NaN goes, as a null does, and leaves the statistics alone."""
    events = table(spark, d, "events").withColumn("value", F.when(F.col("event_id") % 13 == 5, float("nan")).otherwise(F.col("value")))
    return typed(cleaning.filter_zscore(events, ["value"]), "event_id:bigint value:double")


def duplicate_count(spark, d):
    return profile.duplicate_count(td.raw_sales(spark, d), "sls_ord_num")


def columns_equal(spark, d):
    rows = table(spark, d, "orders").join(
        table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")
    ).withColumn("digits", text.extract_int_key(F.col("c_name")))
    return profile.columns_equal(rows, "o_custkey", "digits")


def null_profile(spark, d):
    return null_profile_types(spark, d).drop("data_type")


def null_profile_types(spark, d):
    return profile.profile(td.raw_sales(spark, d).drop("_sales_row"))


def dedupe_keep_first(spark, d):
    first = cleaning.keep_first(table(spark, d, "lineitem"), "l_orderkey", td.LINE_ORDER)
    return typed(first, "l_orderkey:bigint l_linenumber:int l_partkey:bigint l_suppkey:bigint l_extendedprice:double")


# --- sources and sinks ---------------------------------------------------------------------------------------


def stage_csv(spark, d):
    """Customer information exported as CSV, staged again with its row order and read from the raw zone."""
    files, raw_root = new_path(spark), new_path(spark)
    writers.export_csv(_visible(td.raw_cust_info(spark, d)), files)
    return _visible(stage(spark, {"cust_info": files}, raw_root)["cust_info"])


def stage_all_csv(spark, d):
    """All six tables exported as CSV, staged again and joined into the wide fact."""
    raw_root, files = new_path(spark), {}
    for name, rows in (
        ("cust", td.raw_cust), ("cust_info", td.raw_cust_info), ("loc", td.raw_loc), ("prd", td.raw_prd), ("cat", td.raw_cat),
        ("sales", td.raw_sales),
    ):
        files[name] = new_path(spark)
        writers.export_csv(_visible(rows(spark, d)), files[name], compression="gzip")
    raw = stage(spark, files, raw_root)
    customer = build_customer(raw["cust"], raw["cust_info"], raw["loc"])
    return _visible(build_fact(raw["sales"], customer, build_product(raw["prd"], raw["cat"])))


def export_json(spark, d):
    target = new_path(spark)
    product = _visible(td.raw_prd(spark, d))
    writers.export_json(product, target)
    return readers.read_table(spark, target, "json", schema=product._jdf.schema().toDDL())


def warehouse_round_trip(spark, d):
    """Stored by order month; the date range prunes folders."""
    target = new_path(spark)
    writers.write_warehouse(td.warehouse(spark, d, "sls_ord_num", "line", "order_date", "sls_price"), target)
    return typed(
        readers.read_warehouse(spark, target, "1997-03-10", "1998-02-20"),
        "sls_ord_num:bigint line:int order_date:date sls_price:decimal(18,2)",
    )


# --- dimensions, fact, warehouse ----------------------------------------------------------------------------


def _visible(df):
    return df.drop(*(c for c in df.columns if c.startswith("_")))


def _customer(spark, d):
    return build_customer(td.raw_cust(spark, d), td.raw_cust_info(spark, d), td.raw_loc(spark, d))


def _product(spark, d):
    return build_product(td.raw_prd(spark, d), td.raw_cat(spark, d))


def customer_dim(spark, d):
    return _visible(_customer(spark, d))


def product_dim(spark, d):
    return _visible(_product(spark, d))


def _fact(spark, d):
    return build_fact(td.raw_sales(spark, d), _customer(spark, d), _product(spark, d))


def wide_fact(spark, d):
    return _visible(_fact(spark, d))


def wide_fact_bucketed(spark, d):
    """The wide fact from sales stored in buckets of the customer key."""
    name = f"sales_{new_path(spark).rsplit('/', 1)[-1]}"
    writers.write_bucketed(_visible(td.raw_sales(spark, d)), name, new_path(spark), ["sls_cust_id"], 8)
    return _visible(build_fact(spark.table(name), _customer(spark, d), _product(spark, d)))


def wide_fact_fanout(spark, d):
    keys = td.raw_sales(spark, d).select("sls_ord_num", "sls_prd_key", "sls_cust_id")
    customer = _customer(spark, d).select("CID")
    product = _product(spark, d).select("prd_key", "prd_id")
    return build_fact(keys, customer, product).groupBy("prd_key", "prd_id").agg(F.count("*").alias("sales_rows"))


def warehouse_clean(spark, d):
    return _rounded_prices(build_warehouse(td.raw_sales(spark, d), _customer(spark, d), _product(spark, d), as_of=AS_OF))


def warehouse_clean_active(spark, d):
    """The recommended call: open-ended products stay, lines are told apart."""
    lines = td.raw_sales(spark, d).withColumn("line", F.col("_sales_row.l_linenumber"))
    return _rounded_prices(build_warehouse(
        lines, _customer(spark, d), _product(spark, d), as_of=AS_OF, key=["sls_ord_num", "line", "prd_key"],
        required=["sls_ord_num", "CID", "order_date", "ship_date", "due_date", "CAT"],
    ))


def _rounded_prices(df):
    """Medians of two middle values may differ in the last bit between engines."""
    return df.withColumns({c: F.round(c, 4) for c in ("sls_sales", "sls_price", "prd_cost")})


def dashboard_base(spark, d):
    rows = base(
        spark, d, "sls_ord_num", "line", "prd_key", "CID", "order_date", "ship_date", "due_date", "birth_date", "GEN",
        "CNTRY", "sls_quantity", "sls_price", "prd_cost", "CAT", "SUBCAT", "prd_nm", "MAINTENANCE",
    )
    return typed(
        rows,
        "sls_ord_num:bigint line:int prd_key:bigint CID:bigint order_date:date ship_date:date due_date:date "
        "birth_date:date GEN:string CNTRY:string sls_quantity:int sls_price:decimal(18,2) prd_cost:decimal(18,2) "
        "CAT:string SUBCAT:string prd_nm:string MAINTENANCE:string customer_age:bigint "
        f"Revenue:{MONEY} Cost:{MONEY} Profit:{MONEY} Margin:double order_year_month:date "
        "order_to_ship_days:bigint ship_delay:bigint",
    )


# --- sales mart -------------------------------------------------------------------------------------------------

SALES = ("sls_quantity", "sls_price")
PROFIT = (*SALES, "prd_cost")


def sales_kpis(spark, d):
    return typed(
        sales.sales_kpis(base(spark, d, "CID", *PROFIT)),
        f"total_revenue:{MONEY} avg_margin:double~6 active_customers:bigint avg_order_value:double",
    )


def monthly_revenue(spark, d):
    return typed(sales.monthly_revenue(base(spark, d, "order_date", *SALES)), f"order_date:date Revenue:{MONEY}")


def country_top10(spark, d):
    return typed(sales.country_top(base(spark, d, "CNTRY", *SALES)), f"CNTRY:string Revenue:{MONEY}")


def category_trend(spark, d):
    rows = base(spark, d, "order_date", "CAT", *SALES)
    return typed(sales.category_trend(rows), f"order_date:date CAT:string Revenue:{MONEY}")


# --- customer mart ---------------------------------------------------------------------------------------------


def _rfm_rows(spark, d):
    return base(spark, d, "sls_ord_num", "CID", "order_date", "birth_date", "GEN", "CNTRY", "CAT", *PROFIT)


def _segments(spark, d):
    return customers.build_segments(_rfm_rows(spark, d), AS_OF)


METRICS = (
    "CID:bigint first_order:date last_order:date total_orders:bigint "
    f"total_revenue:{MONEY} avg_order_value:double revenue_std:double~4 total_profit:{MONEY} unique_orders:bigint "
    "categories_bought:bigint country:string gender:string age:bigint customer_lifespan_days:bigint "
    "recency_days:bigint purchase_frequency:double profit_margin:double"
)


def customer_metrics(spark, d):
    return typed(customers.customer_metrics(_rfm_rows(spark, d), AS_OF), METRICS)


def first_values(spark, d):
    """Attributes that change from row to row: the first known one in row order counts."""
    rows = base(spark, d, "sls_ord_num", "line", "CID", "order_date", "CAT", *PROFIT)
    order, line = F.col("sls_ord_num"), F.col("line")
    changing = rows.withColumns({
        "GEN": td._one_of(order, "Male", None, "Female", "M"),
        "CNTRY": td._one_of(order + line, None, None, "FRANCE", "SPAIN", "ITALY"),
        "customer_age": F.when(line % 3 != 0, order % 60),
    })
    found = customers.customer_metrics(changing, AS_OF, ("order_date", "sls_ord_num", "line"))
    return typed(found, "CID:bigint country:string gender:string age:bigint")


def rfm_scores(spark, d):
    metrics = materialize(customers.customer_metrics(_rfm_rows(spark, d), AS_OF))
    return typed(
        customers.rfm_scores(metrics),
        f"CID:bigint recency_days:bigint total_orders:bigint total_revenue:{MONEY} "
        "recency_score:int frequency_score:int monetary_score:int",
    )


def rfm_segments(spark, d):
    return typed(
        _segments(spark, d),
        f"CID:bigint total_orders:bigint total_revenue:{MONEY} gender:string recency_score:int frequency_score:int "
        "monetary_score:int rfm_score:double~6 segment:string",
    )


def customer_kpis(spark, d):
    return typed(
        customers.customer_kpis(_segments(spark, d)),
        f"champions:bigint champions_revenue:{MONEY} at_risk:bigint at_risk_revenue:{MONEY} avg_lifespan_days:double "
        "avg_lifespan_months:double repeat_customers:bigint repeat_rate:double",
    )


def segment_stats(spark, d):
    """Compared before the two-digit rounding; means of doubles keep six digits."""
    return typed(
        customers.segment_stats(_segments(spark, d), digits=None),
        f"segment:string customer_count:bigint avg_revenue:double total_segment_revenue:{MONEY} "
        "avg_order_value:double~6 avg_orders:double avg_recency:double avg_margin:double~6",
    )


def segment_stats_rounded(spark, d):
    return typed(
        customers.segment_stats(_segments(spark, d)),
        f"segment:string customer_count:bigint avg_revenue:double total_segment_revenue:{MONEY} avg_order_value:double "
        "avg_orders:double avg_recency:double avg_margin:double",
    )


def segment_distribution(spark, d):
    return typed(
        customers.segment_distribution(materialize(_segments(spark, d))),  # two passes
        "segment:string min:double~6 q1:double~6 median:double~6 q3:double~6 max:double~6",
    )


def age_gender_revenue(spark, d):
    return typed(
        customers.age_gender_revenue(_segments(spark, d)), f"age_bin:bigint gender:string total_revenue:{MONEY}"
    )


def age_by_gender(spark, d):
    rows = base(spark, d, "GEN", "CID", "birth_date")
    return typed(
        customers.age_by_gender(rows), "GEN:string min:double~6 q1:double~6 median:double~6 q3:double~6 max:double~6"
    )


def monthly_active(spark, d):
    return customers.monthly_active(base(spark, d, "CID", "order_date"))


def new_vs_returning(spark, d):
    return customers.new_vs_returning(base(spark, d, "CID", "order_date"))


def global_rank(spark, d):
    counts = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"))
    return typed(ranking.global_rank(counts, "orders", ["o_custkey"]), "o_custkey:bigint orders:bigint rank:bigint")


# --- product mart, operations mart, explorer -----------------------------------------------------------------------


def margin_by_category(spark, d):
    return typed(products.margin_by_category(base(spark, d, "CAT", *PROFIT)), "CAT:string Margin:double~6")


def product_hierarchy(spark, d):
    rows = base(spark, d, "CAT", "SUBCAT", "prd_nm", *SALES)
    return typed(
        products.product_hierarchy(rows), f"CAT:string SUBCAT:string prd_nm:string level:int Revenue:{MONEY}"
    )


def product_characteristics(spark, d):
    rows = base(spark, d, "prd_nm", *PROFIT)
    return typed(
        products.product_characteristics(rows),
        "prd_nm:string prd_cost:decimal(18,2) sls_price:decimal(18,2) Margin:double sls_quantity:int",
    )


def product_profile(spark, d):
    found = products.product_profile(base(spark, d, "prd_nm", *PROFIT))
    return typed(found, "prd_nm:string rows:bigint prd_cost:double sls_price:double Margin:double~6 sls_quantity:double")


def _unnamed(rows):
    """Some products without category, some without subcategory, some without name."""
    key = F.col("prd_key") % 50
    return rows.withColumns({
        c: F.when(key != at, F.col(c)) for at, c in ((7, "CAT"), (8, "SUBCAT"), (9, "prd_nm")) if c in rows.columns
    })


def product_hierarchy_nulls(spark, d):
    rows = _unnamed(base(spark, d, "prd_key", "CAT", "SUBCAT", "prd_nm", *SALES))
    return typed(
        products.product_hierarchy(rows), f"CAT:string SUBCAT:string prd_nm:string level:int Revenue:{MONEY}"
    )


def product_profile_nulls(spark, d):
    found = products.product_profile(_unnamed(base(spark, d, "prd_key", "prd_nm", *PROFIT)))
    return typed(found, "prd_nm:string rows:bigint prd_cost:double sls_price:double Margin:double~6 sls_quantity:double")


def fulfilment_time(spark, d):
    rows = base(spark, d, "MAINTENANCE", "CAT", "order_date", "ship_date")
    return operations.fulfilment_time(rows)


def daily_orders(spark, d):
    return operations.daily_orders(base(spark, d, "sls_ord_num", "order_date"))


def order_density_calendar(spark, d):
    return typed(
        operations.order_density(base(spark, d, "sls_ord_num", "order_date")), "weekday:int month:int orders:bigint"
    )


def country_ops(spark, d):
    rows = base(spark, d, "CNTRY", "order_date", "ship_date", "due_date", *PROFIT)
    return typed(
        operations.country_ops(rows), "CNTRY:string order_to_ship_days:double ship_delay:double Margin:double~6"
    )


def explorer_page(spark, d):
    rows = base(
        spark, d, "sls_ord_num", "line", "prd_key", "supplier", "order_date", "ship_date", "due_date", "CNTRY", "CAT", *SALES
    )
    tie = ["sls_ord_num", "line", "prd_key", "supplier", "sls_price", "ship_date"]
    return typed(
        explorer.page(rows, "Revenue", ascending=False, tie=tie),
        "sls_ord_num:bigint line:int prd_key:bigint order_date:date ship_date:date due_date:date CNTRY:string "
        f"CAT:string Revenue:{MONEY}",
    )


def explorer_page_ascending(spark, d):
    """Sorted by a value that most rows lack, which come last."""
    rows = base(spark, d, "sls_ord_num", "line", "prd_key", "supplier", "ship_date", "due_date", "sls_price")
    rows = rows.withColumn("ship_delay", F.when(F.col("sls_ord_num") % 2000 == 1, F.col("ship_delay")))
    tie = ["sls_ord_num", "line", "prd_key", "supplier", "sls_price", "ship_date"]
    return typed(
        explorer.page(rows, "ship_delay", tie=tie), "sls_ord_num:bigint line:int prd_key:bigint ship_delay:bigint"
    )


def row_count(spark, d):
    return explorer.record_count(td.warehouse(spark, d, "sls_ord_num"))


# --- versions, footers, pages ------------------------------------------------------------------------------------


def warehouse_replace(spark, d):
    """The third write fails its check, so the second version is what readers see."""
    root = new_path(spark)
    rows = td.warehouse(spark, d, "sls_ord_num", "line", "order_date", "sls_price")
    versions.replace(rows, root)
    versions.replace(versions.read(spark, root).where("year(order_date) = 1997"), root)
    try:
        versions.replace(rows.where("line > 3"), root, check=versions.expect_rows(-1))
    except RuntimeError:
        pass
    return typed(versions.read(spark, root), "sls_ord_num:bigint line:int order_date:date sls_price:decimal(18,2)")


def write_metrics(spark, d):
    """Null counts that the writing job took, next to the version it made."""
    raw = _visible(td.raw_sales(spark, d))
    found = versions.replace(raw, new_path(spark), metrics=versions.null_metrics(raw))
    return versions.null_report(spark, found)


def read_back_check(spark, d):
    target, rows = new_path(spark), td.raw_cat(spark, d)
    writers.write_table(rows, target)
    return writers.verify_write(spark, target, rows.count(), n=1_000_000)


def _stored_warehouse(spark, d):
    target = new_path(spark)
    writers.write_warehouse(td.warehouse(spark, d, "sls_ord_num", "order_date", "ship_date", "sls_quantity"), target)
    return target


def stored_bounds(spark, d):
    path = _stored_warehouse(spark, d)
    return footers.bounds(spark, path, ["order_date", "ship_date", "sls_quantity"])


def stored_month_counts(spark, d):
    return footers.folder_counts(spark, _stored_warehouse(spark, d))


PAGE_COLUMNS = ("sls_ord_num", "line", "prd_key", "supplier", "order_date", "ship_date", "due_date", "CNTRY", "CAT")
PAGE_TIE = ("sls_ord_num", "line", "prd_key", "supplier", "sls_price", "ship_date")
PAGE_TYPES = f"sls_ord_num:bigint line:int prd_key:bigint order_date:date ship_date:date due_date:date CNTRY:string CAT:string Revenue:{MONEY}"


def explorer_page_50(spark, d):
    rows = base(spark, d, *PAGE_COLUMNS, *SALES)
    return typed(pages.build_pages(rows, "Revenue", False, PAGE_TIE).page(50), PAGE_TYPES)


def explorer_page_50_ascending(spark, d):
    rows = base(spark, d, *PAGE_COLUMNS, *SALES)
    return typed(pages.build_pages(rows, "Revenue", True, PAGE_TIE).page(50), PAGE_TYPES)


def explorer_after_row(spark, d):
    """The hundred rows after a place that no row has, among values that most rows lack."""
    rows = base(spark, d, *PAGE_COLUMNS[:4], "ship_date", "due_date", "sls_price")
    rows = rows.withColumn("ship_delay", F.when(F.col("sls_ord_num") % 50 == 1, F.col("ship_delay")))
    found = pages.build_pages(rows, "ship_delay", False, PAGE_TIE)
    return typed(found.after({"ship_delay": None, "sls_ord_num": 300, **{c: None for c in PAGE_TIE[1:]}}),
                 "sls_ord_num:bigint line:int prd_key:bigint ship_delay:bigint")


# --- one pass for several marts, estimates -----------------------------------------------------------------------


def _cube(spark, d):
    rows = base(spark, d, "order_date", "ship_date", "due_date", "CNTRY", "CAT", "SUBCAT", "prd_nm", "MAINTENANCE", *PROFIT)
    return materialize(shared.sales_cube(rows))


def shared_marts(spark, d):
    """Seven results of the sales, product and operations marts from one scan of the sales."""
    cube = _cube(spark, d)
    text, none = lambda c: F.col(c).cast("string"), F.lit(None).cast("string")

    def rows(name, df, first, second, value, digits=6):
        return df.select(F.lit(name).alias("mart"), first.alias("k1"), second.alias("k2"), F.round(F.col(value).cast("double"), digits).alias("v"))

    parts = [
        rows("month", shared.monthly_revenue(cube), text("order_date"), none, "Revenue", 2),
        rows("trend", shared.category_trend(cube), text("order_date"), text("CAT"), "Revenue", 2),
        rows("country", shared.country_top(cube), text("CNTRY"), none, "Revenue", 2),
        rows("margin", shared.margin_by_category(cube), text("CAT"), none, "Margin"),
        rows("product", shared.product_hierarchy(cube).where("level = 2"), text("CAT"), text("SUBCAT"), "Revenue", 2),
        rows("fulfilment", shared.fulfilment_time(cube), text("MAINTENANCE"), text("CAT"), "order_to_ship_days"),
        rows("delay", shared.country_ops(cube), text("CNTRY"), none, "ship_delay"),
        rows("total", shared.sales_totals(cube), none, none, "avg_margin"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def grouped_totals(spark, d):
    found = shared.group_totals(_cube(spark, d), [("CNTRY",), ("CAT", "MAINTENANCE"), ()])
    return typed(found, f"grouping:string CNTRY:string CAT:string MAINTENANCE:string rows:bigint Revenue:{MONEY} Profit:{MONEY}")


def active_estimates(spark, d):
    """Exact distinct customers and orders per country since 1997, and whether the merged sketches are within five standard errors."""
    rows = base(spark, d, "sls_ord_num", "CID", "order_date", "CNTRY")
    since = rows.where("order_date >= date'1997-01-01' and CNTRY is not null")
    exact = since.groupBy("CNTRY").agg(F.countDistinct("CID").alias("customers"), F.countDistinct("sls_ord_num").alias("orders"))
    stored = sketches.of_months(materialize(sketches.month_sketches(rows)), "1997-01-01")
    error = 5 * 1.04 / 2 ** (sketches.LG_BUCKETS / 2)
    near = lambda c: F.abs(F.col(f"{c}_estimate") - F.col(c)) <= F.lit(error) * F.col(c) + 0.5
    met = exact.join(sketches.distinct_estimates(stored, ["CNTRY"]), "CNTRY")
    return met.select("CNTRY", "customers", "orders", near("customers").alias("customers_near"), near("orders").alias("orders_near"))


def quantile_estimates(spark, d):
    """Rows per gender, and whether estimated quartiles of the revenue have nearly the wanted rank among them."""
    rows = base(spark, d, "order_date", "GEN", *SALES).where("GEN is not null")
    stored = materialize(sketches.month_sketches(rows, ["GEN"]))
    found = sketches.quantile_estimates(stored, [0.25, 0.5, 0.75], ["GEN"])
    ranked = rows.select("GEN", F.col("Revenue").cast("double").alias("v")).join(found, "GEN")
    below = [F.avg((F.col("v") < F.col("revenue_quantiles")[i]).cast("int")) for i in range(3)]
    upto = [F.avg((F.col("v") <= F.col("revenue_quantiles")[i]).cast("int")) for i in range(3)]
    near = F.lit(True)
    for want, low, high in zip((0.25, 0.5, 0.75), below, upto):
        near = near & (low <= want + 0.012) & (high >= want - 0.012)
    return ranked.groupBy("GEN").agg(F.count("*").alias("sales_rows"), near.alias("quartiles_near"))


# --- guards ------------------------------------------------------------------------------------------------------


def column_guard(spark, d):
    """Without cost and shipment columns the base has no profit, margin or delay."""
    return dashboard.dashboard_base(td.warehouse(spark, d, "sls_ord_num", "line", "order_date", "sls_quantity", "sls_price"), AS_OF)


def empty_input(spark, d):
    """Marts over no rows: totals of 0, means that are null."""
    none = base(spark, d, "CID", "order_date", "ship_date", "due_date", "CNTRY", *PROFIT).where("order_date < date'1900-01-01'")
    kpis = typed(sales.sales_kpis(none), f"total_revenue:{MONEY} avg_margin:double active_customers:bigint avg_order_value:double")
    groups = operations.country_ops(none).agg(F.count("*").alias("countries"))
    months = sales.monthly_revenue(none).agg(F.count("*").alias("months"))
    return kpis.withColumns({"countries": groups.scalar(), "months": months.scalar()})


def warehouse_medians(spark, d):
    """First step of the cleaning: medians over the joined rows."""
    found = cleaning.medians(_fact(spark, d), ["sls_sales", "sls_price", "prd_cost"])
    return found.select(*(F.round(c, 4).alias(c) for c in found.columns))


def warehouse_first_rows(spark, d):
    """Second step: which joined row of each order number stays."""
    order = [c for c in warehouse.ROW_ORDER if c != "_cat_row"]
    kept = cleaning.keep_first(_fact(spark, d), "sls_ord_num", order)
    return kept.select("sls_ord_num", "prd_key", "prd_id", "CID", F.col("_sales_row.l_linenumber").alias("line"))


KEYS = (
    "age_by_gender age_floor_365 age_gender_revenue age_trunc_365 category_id_slice category_path category_trend "
    "columns_equal country_ops country_top10 customer_dim customer_kpis customer_metrics daily_orders dashboard_base dates_unbounded "
    "dedupe_keep_first distinct_marital dropna_any duplicate_count explorer_page explorer_page_ascending export_json extract_digits_key fill_constant "
    "filter_date_range filter_domains filter_in_list first_values fulfilment_time gender_bucket global_rank is_active_flag "
    "map_country map_gender_ci map_gender_code margin_by_category margin_safe median_fill median_fill_nan month_names month_names_texts monthly_active "
    "monthly_revenue na_tokens new_vs_returning null_profile null_profile_types order_density_calendar order_ship_delay parse_iso_date "
    "parse_yyyymmdd product_characteristics product_code_suffix product_dim product_hierarchy product_hierarchy_nulls product_profile product_profile_nulls revenue_measures "
    "rfm_scores rfm_segments row_count sales_kpis scan_filter_tables segment_distribution segment_stats segment_stats_rounded stage_all_csv stage_csv strip_hyphen_key "
    "timestamp_dates upper_trim warehouse_clean warehouse_clean_active warehouse_round_trip wide_fact wide_fact_fanout zscore_filter zscore_filter_nan "
    "warehouse_replace write_metrics read_back_check stored_bounds stored_month_counts explorer_page_50 explorer_page_50_ascending "
    "explorer_after_row shared_marts grouped_totals active_estimates quantile_estimates column_guard empty_input warehouse_medians "
    "warehouse_first_rows wide_fact_bucketed median_estimates"
).split()
QUERIES = {key: globals()[key] for key in KEYS}
