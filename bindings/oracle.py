"""The same results in SQL over the star-schema tables, for a side-by-side check."""

MONEY = "DECIMAL(28,2)"
AS_OF = "DATE '2002-01-01'"

GENDER = "CASE {k} % 5 WHEN 0 THEN 'MALE' WHEN 1 THEN ' female ' WHEN 2 THEN 'M' WHEN 3 THEN 'Female' END"
BIRTH = "(DATE '1940-01-01' + CAST({k} * 37 % 25000 AS INTEGER))"
COUNTRY = (
    "CASE n_name WHEN 'NATION_0' THEN 'us' WHEN 'NATION_1' THEN 'USA' WHEN 'NATION_2' THEN 'DE' "
    "WHEN 'NATION_3' THEN ' Germeny ' WHEN 'NATION_4' THEN 'Germeny' WHEN 'NATION_24' THEN NULL ELSE n_name END"
)
COUNTRY_LABEL = (
    "CASE WHEN upper({c}) IN ('US','USA','UNITED STATES') THEN 'UNITED STATES' "
    "WHEN upper({c}) IN ('DE','GERMENY','GERMANY') THEN 'GERMANY' ELSE upper({c}) END"
)
GENDER_LABEL = "CASE upper({c}) WHEN 'MALE' THEN 'Male' WHEN 'FEMALE' THEN 'Female' ELSE {c} END"
GENDER_BUCKET = "CASE upper(trim({c})) WHEN 'MALE' THEN 'Male' WHEN 'FEMALE' THEN 'Female' ELSE 'Other' END"
DIGITS = r"TRY_CAST(nullif(regexp_extract({c}, '\d+'), '') AS BIGINT)"
BRAND_CODE = "lpad(substr(p_brand, 7), 2, '0')"
MESSY = (
    "CASE WHEN {c} BETWEEN 10000000 AND 99999999 THEN CAST(try_strptime(CAST({c} AS VARCHAR), '%Y%m%d') AS DATE) END"
)

# --- raw tables ---------------------------------------------------------------------------------

RAW_CUST = f"""raw_cust AS (
  SELECT CASE WHEN c_custkey % 40 = 39 THEN 'walk-in' ELSE c_name END AS CID,
         CASE WHEN c_custkey % 23 = 0 THEN 'unknown' ELSE CAST({BIRTH.format(k='c_custkey')} AS VARCHAR) END AS BDATE,
         {GENDER.format(k='c_custkey')} AS GEN, c_custkey AS cust_row
  FROM customer)"""
RAW_INFO = """raw_info AS (
  SELECT CAST(c_custkey AS DOUBLE) AS cst_id, c_name AS cst_key,
         CASE WHEN c_custkey % 17 <> 0 THEN 'First' || CAST(c_custkey % 100 AS VARCHAR) END AS cst_firstname,
         c_mktsegment AS cst_lastname,
         CASE c_custkey % 4 WHEN 0 THEN 'M' WHEN 1 THEN 'S' WHEN 3 THEN 'D' END AS cst_marital_status,
         CASE c_custkey % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'f' END AS cst_gndr,
         CAST(DATE '2010-01-01' + CAST(c_custkey % 1000 AS INTEGER) AS VARCHAR) AS cst_create_date,
         c_custkey AS info_row
  FROM customer)"""
RAW_LOC = f"""raw_loc AS (
  SELECT substr(c_name, 1, 12) || '-' || substr(c_name, 13) AS CID, {COUNTRY} AS CNTRY,
         c_custkey * 2 + copy AS loc_row
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
  CROSS JOIN (SELECT unnest([0, 1]) AS copy)
  WHERE copy = 0 OR c_custkey % 100 = 50)"""
RAW_PRD = f"""raw_prd AS (
  SELECT p_partkey * 3 + version AS prd_id,
         substr(p_type, 1, 2) || '-' || {BRAND_CODE} || '-P' || CAST(p_partkey AS VARCHAR) AS prd_key,
         p_name AS prd_nm, CASE WHEN p_partkey % 50 <> 0 THEN p_retailprice - version * 10 END AS prd_cost,
         CASE p_size % 4 WHEN 0 THEN 'R ' WHEN 1 THEN 'M ' WHEN 2 THEN 'S ' ELSE 'T ' END AS prd_line,
         CAST(version + 2011 AS VARCHAR) || '-07-01' AS prd_start_dt,
         CASE WHEN version < p_partkey % 3 THEN CAST(version + 2012 AS VARCHAR) || '-06-30' END AS prd_end_dt
  FROM part CROSS JOIN (SELECT unnest([0, 1, 2]) AS version)
  WHERE version <= p_partkey % 3)"""
RAW_CAT = f"""raw_cat AS (
  SELECT DISTINCT CASE p_type WHEN 'MEDIUM' THEN 'MD' ELSE substr(p_type, 1, 2) END || '_' || {BRAND_CODE} AS ID,
         p_type AS CAT, p_brand AS SUBCAT,
         CASE WHEN CAST({BRAND_CODE} AS INTEGER) % 2 = 0 THEN 'Yes' ELSE 'No' END AS MAINTENANCE
  FROM part)"""
RAW_SALES = """raw_sales AS (
  SELECT CASE WHEN l_orderkey % 500 <> 499 THEN 'SO' || CAST(l_orderkey AS VARCHAR) END AS sls_ord_num,
         'P' || CAST(l_partkey AS VARCHAR) AS sls_prd_key, o_custkey AS sls_cust_id,
         CAST(CASE WHEN l_orderkey % 11 = 0 THEN 0 WHEN l_orderkey % 13 = 0 THEN 20120145
              WHEN l_orderkey % 17 = 0 THEN 12345
              ELSE CAST(strftime(o_orderdate, '%Y%m%d') AS BIGINT) END AS BIGINT) AS sls_order_dt,
         CAST(strftime(l_shipdate, '%Y%m%d') AS BIGINT) AS sls_ship_dt,
         CAST(strftime(CAST(o_orderdate AS DATE) + 30, '%Y%m%d') AS BIGINT) AS sls_due_dt,
         CASE WHEN l_linenumber <> 5 THEN l_extendedprice END AS sls_sales,
         CAST(l_quantity * CASE WHEN l_orderkey % 97 = 0 THEN 40 ELSE 1 END AS BIGINT) AS sls_quantity,
         CASE WHEN l_linenumber <> 3 THEN l_extendedprice END AS sls_price,
         l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
SALES_COLUMNS = (
    "sls_ord_num sls_prd_key sls_cust_id sls_order_dt sls_ship_dt sls_due_dt sls_sales sls_quantity sls_price".split()
)

CUSTOMER = f"""customer_dim AS (
  SELECT c.CID, BDATE, GEN, cst_id, cst_firstname, cst_lastname, cst_marital_status, cst_gndr, cst_create_date, CNTRY,
         cust_row, info_row, loc_row
  FROM (SELECT {DIGITS.format(c='CID')} AS CID, BDATE, GEN, cust_row FROM raw_cust) c
  JOIN (SELECT {DIGITS.format(c='cst_key')} AS CID, * EXCLUDE (cst_key) FROM raw_info) i ON c.CID = i.CID
  JOIN (SELECT {DIGITS.format(c="replace(CID, '-', '')")} AS CID, CNTRY, loc_row FROM raw_loc) l ON c.CID = l.CID)"""
PRODUCT = """product_dim AS (
  SELECT prd_id, substr(p.prd_key, 7) AS prd_key, prd_nm, prd_cost, prd_line, prd_start_dt, prd_end_dt, p.ID,
         CAT, SUBCAT, MAINTENANCE
  FROM (SELECT *, replace(substr(prd_key, 1, 5), '-', '_') AS ID FROM raw_prd) p LEFT JOIN raw_cat c ON p.ID = c.ID)"""
FACT = """fact AS (
  SELECT s.* EXCLUDE (sls_prd_key, sls_cust_id), s.sls_prd_key AS prd_key, s.sls_cust_id AS CID,
         c.* EXCLUDE (CID), p.* EXCLUDE (prd_key)
  FROM raw_sales s LEFT JOIN customer_dim c ON s.sls_cust_id = c.CID
  LEFT JOIN product_dim p ON s.sls_prd_key = p.prd_key)"""
FACT_TABLES = ", ".join([RAW_CUST, RAW_INFO, RAW_LOC, RAW_PRD, RAW_CAT, RAW_SALES, CUSTOMER, PRODUCT, FACT])
ROW_ORDER = (
    "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, "
    "cust_row, info_row, loc_row, prd_id"
)
FACT_KEPT = (
    "sls_ord_num prd_key CID sls_quantity prd_id prd_nm prd_line ID CAT SUBCAT MAINTENANCE".split()
)
DATES = {
    "order_date": MESSY.format(c="sls_order_dt"),
    "ship_date": MESSY.format(c="sls_ship_dt"),
    "due_date": MESSY.format(c="sls_due_dt"),
    "birth_date": "TRY_CAST(BDATE AS DATE)",
    "customer_creation_date": "TRY_CAST(cst_create_date AS DATE)",
    "product_start_date": "TRY_CAST(prd_start_dt AS DATE)",
    "product_end_date": "TRY_CAST(prd_end_dt AS DATE)",
}


def _clean(key: str, required: str | None, extra: str = "") -> str:
    dates = ",\n         ".join(f"{sql} AS {name}" for name, sql in DATES.items())
    visible = (
        ", ".join(FACT_KEPT) + ", GEN, CNTRY, cst_id, cst_firstname, cst_lastname, cst_marital_status, "
        "ROUND(sls_sales, 4) AS sls_sales, ROUND(sls_price, 4) AS sls_price, ROUND(prd_cost, 4) AS prd_cost, "
        "is_active_product, customer_age, order_to_ship_days, " + ", ".join(DATES) + ", "
        + ", ".join(f"monthname({d}) AS {d}_month" for d in DATES) + extra
    )
    not_null = " AND ".join(f"{c} IS NOT NULL" for c in (required.split() if required else _ALL_CLEAN))
    # Only numbers and keys are ranked; wide columns are taken for the rows that stay.
    narrow = ", ".join(dict.fromkeys((key + ", " + ROW_ORDER).split(", ")))
    within = lambda c: f"abs(({c} - (SELECT avg({c}) FROM filled)) / (SELECT stddev_pop({c}) FROM filled)) < 3"
    return f"""WITH {FACT_TABLES},
numbered AS MATERIALIZED (SELECT *, row_number() OVER () AS place FROM fact),
narrow AS (SELECT place, {narrow} FROM numbered),
first_rows AS MATERIALIZED (SELECT place FROM narrow QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {ROW_ORDER}) = 1),
filled AS MATERIALIZED (
  SELECT {', '.join(FACT_KEPT)}, cst_id, {ROW_ORDER.replace(', prd_id', '')},
         {dates},
         prd_end_dt IS NULL AS is_active_product,
         coalesce(sls_sales, (SELECT median(sls_sales) FROM numbered)) AS sls_sales,
         coalesce(sls_price, (SELECT median(sls_price) FROM numbered)) AS sls_price,
         coalesce(prd_cost, (SELECT median(prd_cost) FROM numbered)) AS prd_cost,
         coalesce(cst_firstname, 'Not Specified') AS cst_firstname,
         coalesce(cst_lastname, 'Not Specified') AS cst_lastname,
         coalesce(cst_marital_status, 'Not Specified') AS cst_marital_status,
         trim(upper(GEN)) AS GEN, trim(upper(CNTRY)) AS CNTRY
  FROM numbered WHERE place IN (SELECT place FROM first_rows)),
featured AS (
  SELECT *, CAST(floor(date_diff('day', birth_date, {AS_OF}) / 365.0) AS BIGINT) AS customer_age,
         date_diff('day', order_date, ship_date) AS order_to_ship_days
  FROM filled WHERE {within('sls_quantity')} AND {within('sls_price')})
SELECT {visible} FROM featured WHERE {not_null}"""


_ALL_CLEAN = [
    *FACT_KEPT, "GEN", "CNTRY", "cst_id", "cst_firstname", "cst_lastname", "cst_marital_status", "sls_sales", "sls_price",
    "prd_cost", "is_active_product", "customer_age", "order_to_ship_days", *DATES,
]

# --- dashboard base ---------------------------------------------------------------------------------

BASE = f"""base AS (
  SELECT *, Revenue - Cost AS Profit,
         CASE WHEN Revenue <> 0 THEN CAST(Revenue - Cost AS DOUBLE) / CAST(Revenue AS DOUBLE) * 100 END AS Margin
  FROM (
    SELECT l_orderkey AS sls_ord_num, l_linenumber AS line, l_partkey AS prd_key, l_suppkey AS supplier, o_custkey AS CID,
           CAST(o_orderdate AS DATE) AS order_date, CAST(l_shipdate AS DATE) AS ship_date,
           CAST(o_orderdate AS DATE) + 30 AS due_date, {BIRTH.format(k='o_custkey')} AS birth_date,
           {GENDER_LABEL.format(c='(' + GENDER.format(k='o_custkey') + ')')} AS GEN,
           {COUNTRY_LABEL.format(c='(' + COUNTRY + ')')} AS CNTRY,
           CAST(l_quantity AS INTEGER) AS sls_quantity,
           CAST(CASE WHEN l_linenumber = 7 THEN 0 ELSE l_extendedprice END AS DECIMAL(18,2)) AS sls_price,
           CAST(p_retailprice AS DECIMAL(18,2)) AS prd_cost,
           CAST(CAST(l_quantity AS INTEGER) * CAST(CASE WHEN l_linenumber = 7 THEN 0 ELSE l_extendedprice END
                AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS Revenue,
           CAST(CAST(l_quantity AS INTEGER) * CAST(p_retailprice AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS Cost,
           p_type AS CAT, p_brand AS SUBCAT, p_name AS prd_nm,
           CASE WHEN p_size % 2 = 0 THEN 'Yes' ELSE 'No' END AS MAINTENANCE,
           CAST(trunc(date_diff('day', {BIRTH.format(k='o_custkey')}, {AS_OF}) / 365.0) AS BIGINT) AS customer_age,
           date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS order_to_ship_days,
           date_diff('day', CAST(l_shipdate AS DATE), CAST(o_orderdate AS DATE) + 30) AS ship_delay
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN part ON l_partkey = p_partkey))"""

METRICS = f"""metrics AS (
  SELECT *, date_diff('day', first_order, last_order) AS customer_lifespan_days,
         date_diff('day', last_order, {AS_OF}) AS recency_days,
         total_orders / (date_diff('day', first_order, last_order) + 1) AS purchase_frequency,
         CAST(total_profit AS DOUBLE) / nullif(CAST(total_revenue AS DOUBLE), 0) * 100 AS profit_margin
  FROM (
    SELECT CID, min(order_date) AS first_order, max(order_date) AS last_order, count(order_date) AS total_orders,
           CAST(sum(Revenue) AS {MONEY}) AS total_revenue, CAST(sum(Revenue) AS DOUBLE) / count(Revenue) AS avg_order_value,
           stddev_samp(CAST(Revenue AS DOUBLE)) AS revenue_std, CAST(sum(Profit) AS {MONEY}) AS total_profit,
           count(DISTINCT sls_ord_num) AS unique_orders, count(DISTINCT CAT) AS categories_bought,
           min(CNTRY) AS country, min(GEN) AS gender, min(customer_age) AS age
    FROM base GROUP BY CID))"""


def _above(value: str, edges: str) -> str:
    return "(" + " + ".join(f"({value} > {edges}[{k}])::INTEGER" for k in (1, 2, 3, 4)) + ")"


RFM = f"""edges AS (
  SELECT quantile_cont(recency_days, [0.2, 0.4, 0.6, 0.8]) AS r,
         quantile_cont(CAST(total_revenue AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) AS m, count(*) AS n
  FROM metrics),
ranked AS (SELECT *, row_number() OVER (ORDER BY total_orders, CID) AS rk FROM metrics),
scored AS (
  SELECT *, 5 - {_above('recency_days', 'r')} AS recency_score,
         1 + {' + '.join(f'(5 * (rk - 1) > (n - 1) * {k})::INTEGER' for k in (1, 2, 3, 4))} AS frequency_score,
         1 + {_above('CAST(total_revenue AS DOUBLE)', 'm')} AS monetary_score
  FROM ranked, edges),
segments AS (
  SELECT * EXCLUDE (gender), {GENDER_BUCKET.format(c='gender')} AS gender, points / 3.0 AS rfm_score,
         CASE WHEN points >= 14 THEN 'Champions' WHEN points >= 12 THEN 'Loyal Customers'
              WHEN points >= 11 THEN 'Potential Loyalists' WHEN points >= 9 THEN 'New Customers'
              WHEN points >= 8 THEN 'Promising' WHEN points >= 6 THEN 'Need Attention'
              WHEN points >= 5 THEN 'About to Sleep' ELSE 'At Risk' END AS segment
  FROM (SELECT *, recency_score + frequency_score + monetary_score AS points FROM scored))"""
WITH_BASE = f"WITH {BASE} "
WITH_METRICS = f"WITH {BASE}, {METRICS} "
WITH_SEGMENTS = f"WITH {BASE}, {METRICS}, {RFM} "


def _five(group: str, value: str, source: str) -> str:
    points = ", ".join(
        f"ROUND(quantile_cont(CAST({value} AS DOUBLE), {p}), 6) AS {name}"
        for name, p in (("min", 0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("max", 1))
    )
    return f"SELECT {group}, {points} FROM {source} WHERE {group} IS NOT NULL GROUP BY {group}"


def _nulls() -> str:
    parts = [
        f"SELECT '{c}' AS column_name, count({c}) AS non_null, count(*) - count({c}) AS nulls FROM raw_sales"
        for c in SALES_COLUMNS
    ]
    return f"WITH {RAW_SALES} " + " UNION ALL ".join(parts)


def _gap_filled(start: str, step: str, measure: str, label: str, name: str, kind: str) -> str:
    return f"""{WITH_BASE}, found AS (SELECT {start} AS b, {measure} AS v FROM base GROUP BY 1),
spine AS (SELECT CAST(unnest(generate_series((SELECT min(b) FROM found)::TIMESTAMP, (SELECT max(b) FROM found)::TIMESTAMP,
          INTERVAL {step})) AS DATE) AS b)
SELECT {label} AS order_date, CAST(coalesce(v, 0) AS {kind}) AS {name} FROM spine LEFT JOIN found USING (b)"""


DAILY = _gap_filled("order_date", "1 DAY", "count(DISTINCT sls_ord_num)", "b", "orders", "BIGINT")

STATS = """customer_count, avg_revenue, total_segment_revenue, avg_order_value, avg_orders, avg_recency, avg_margin"""
SEGMENT_STATS = f"""SELECT segment, count(CID) AS customer_count, CAST(sum(total_revenue) AS DOUBLE) / count(*) AS avg_revenue,
        CAST(sum(total_revenue) AS {MONEY}) AS total_segment_revenue, avg(avg_order_value) AS avg_order_value,
        CAST(sum(total_orders) AS DOUBLE) / count(*) AS avg_orders, CAST(sum(recency_days) AS DOUBLE) / count(*) AS avg_recency,
        avg(profit_margin) AS avg_margin FROM segments GROUP BY segment"""
UNNAMED = """unnamed AS (SELECT * REPLACE (CASE WHEN prd_key % 50 <> 7 THEN CAT END AS CAT,
        CASE WHEN prd_key % 50 <> 8 THEN SUBCAT END AS SUBCAT, CASE WHEN prd_key % 50 <> 9 THEN prd_nm END AS prd_nm) FROM base)"""
SALES_TYPES = dict.fromkeys(SALES_COLUMNS, "bigint") | dict.fromkeys(("sls_ord_num", "sls_prd_key"), "string") | dict.fromkeys(
    ("sls_sales", "sls_price"), "double")

def _page(direction: str) -> str:
    return WITH_BASE + f"""SELECT sls_ord_num, line, prd_key, order_date, ship_date, due_date, CNTRY, CAT,
        CAST(Revenue AS {MONEY}) AS Revenue FROM base ORDER BY base.Revenue {direction} NULLS LAST, sls_ord_num, line, prd_key, supplier,
        sls_price, ship_date LIMIT 100 OFFSET 4900"""


ORACLE = {
    # scans, texts, dates, measures
    "scan_filter_tables": "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01'",
    "na_tokens": """SELECT c_custkey, CASE c_custkey % 8 WHEN 5 THEN 'Nan' WHEN 6 THEN 'na' END AS token, c_mktsegment
        FROM customer""",
    "extract_digits_key": f"""SELECT c_custkey, {DIGITS.format(c='c_name')} AS key FROM customer
        UNION ALL SELECT o_orderkey, {DIGITS.format(c='o_orderstatus')} FROM orders""",
    "strip_hyphen_key": f"""WITH {RAW_LOC} SELECT CID, {DIGITS.format(c="replace(CID, '-', '')")} AS key FROM raw_loc""",
    "category_id_slice": f"""WITH {RAW_PRD} SELECT prd_id, replace(left(prd_key, 5), '-', '_') AS ID FROM raw_prd""",
    "product_code_suffix": f"""WITH {RAW_PRD} SELECT prd_id, substr(prd_key, 7) AS code FROM raw_prd""",
    "parse_yyyymmdd": f"""WITH {RAW_SALES} SELECT sls_ord_num, sls_prd_key, sls_order_dt,
        {MESSY.format(c='sls_order_dt')} AS order_date FROM raw_sales""",
    "parse_iso_date": f"WITH {RAW_CUST} SELECT BDATE, TRY_CAST(BDATE AS DATE) AS birth_date FROM raw_cust",
    "timestamp_dates": """SELECT l_orderkey AS sls_ord_num, l_linenumber AS line, CAST(o_orderdate AS DATE) AS order_date,
        CAST(l_shipdate AS DATE) AS ship_date, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS order_to_ship_days
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-03-01' AND DATE '1998-02-28'""",
    "dates_unbounded": """SELECT o_orderkey,
        CASE o_orderkey % 7 WHEN 0 THEN DATE '9999-12-31' WHEN 1 THEN DATE '1600-01-01' ELSE CAST(o_orderdate AS DATE) END AS order_date,
        CASE o_orderkey % 5 WHEN 0 THEN DATE '9999-12-31' WHEN 1 THEN DATE '1600-01-01' ELSE CAST(o_orderdate AS DATE) END
        AS product_end_date FROM orders""",
    "is_active_flag": f"WITH {RAW_PRD} SELECT prd_id, prd_end_dt IS NULL AS is_active_product FROM raw_prd",
    "fill_constant": f"""WITH {RAW_INFO} SELECT cst_key, coalesce(cst_firstname, 'Not Specified') AS cst_firstname,
        coalesce(cst_lastname, 'Not Specified') AS cst_lastname,
        coalesce(cst_marital_status, 'Not Specified') AS cst_marital_status FROM raw_info""",
    "upper_trim": f"WITH {RAW_CUST} SELECT CID, GEN, trim(upper(GEN)) AS clean FROM raw_cust",
    "map_gender_code": f"""WITH {RAW_INFO} SELECT cst_key, CASE WHEN cst_gndr IN ('Male', 'm') THEN 'M'
        WHEN cst_gndr IN ('Female', 'f') THEN 'F' ELSE coalesce(cst_gndr, 'Unknown') END AS cst_gndr FROM raw_info""",
    "map_country": f"WITH {RAW_LOC} SELECT CID, CNTRY, {COUNTRY_LABEL.format(c='CNTRY')} AS country FROM raw_loc",
    "map_gender_ci": f"WITH {RAW_CUST} SELECT CID, GEN, {GENDER_LABEL.format(c='GEN')} AS gender FROM raw_cust",
    "gender_bucket": f"WITH {RAW_CUST} SELECT CID, GEN, {GENDER_BUCKET.format(c='GEN')} AS gender FROM raw_cust",
    "category_path": f"""WITH {RAW_PRD}, {RAW_CAT}, {PRODUCT}
        SELECT prd_id, CAT || ' > ' || SUBCAT AS full_category FROM product_dim""",
    "age_floor_365": f"""SELECT c_custkey,
        CAST(floor(date_diff('day', {BIRTH.format(k='c_custkey')}, {AS_OF}) / 365.0) AS BIGINT) AS age FROM customer""",
    "age_trunc_365": f"""SELECT c_custkey,
        CAST(trunc(date_diff('day', {BIRTH.format(k='c_custkey')}, {AS_OF}) / 365.0) AS BIGINT) AS age FROM customer""",
    "order_ship_delay": WITH_BASE + "SELECT sls_ord_num, line, order_to_ship_days, ship_delay FROM base",
    "month_names": WITH_BASE + """SELECT sls_ord_num, line, monthname(order_date) AS order_date_month,
        monthname(ship_date) AS ship_date_month, monthname(due_date) AS due_date_month,
        monthname(birth_date) AS birth_date_month FROM base""",
    "month_names_texts": f"""WITH {RAW_INFO}, {RAW_PRD}
        SELECT 'customer_creation_date' AS field, CAST(cst_id AS BIGINT) AS key, monthname(CAST(cst_create_date AS DATE)) AS month FROM raw_info
        UNION ALL SELECT 'product_start_date', prd_id, monthname(CAST(prd_start_dt AS DATE)) FROM raw_prd
        UNION ALL SELECT 'product_end_date', prd_id, monthname(CAST(prd_end_dt AS DATE)) FROM raw_prd""",
    "revenue_measures": WITH_BASE + f"""SELECT sls_ord_num, line, CAST(Revenue AS {MONEY}) AS Revenue,
        CAST(Cost AS {MONEY}) AS Cost, CAST(Profit AS {MONEY}) AS Profit FROM base""",
    "margin_safe": WITH_BASE + "SELECT sls_ord_num, line, Margin FROM base",
    # filters, cleaning, profiling
    "filter_date_range": WITH_BASE + """SELECT sls_ord_num, line, order_date FROM base
        WHERE order_date BETWEEN DATE '1997-03-01' AND DATE '1998-02-28'""",
    "filter_in_list": WITH_BASE + """SELECT sls_ord_num, line, CNTRY, CAT FROM base
        WHERE CNTRY IN ('UNITED STATES', 'GERMANY') AND CAT IN ('PROMO', 'SMALL')""",
    "filter_domains": WITH_BASE + """SELECT DISTINCT 'CNTRY' AS field, CNTRY AS value FROM base WHERE CNTRY IS NOT NULL
        UNION ALL SELECT DISTINCT 'CAT', CAT FROM base WHERE CAT IS NOT NULL
        UNION ALL SELECT 'order_date', CAST(min(order_date) AS VARCHAR) FROM base
        UNION ALL SELECT 'order_date', CAST(max(order_date) AS VARCHAR) FROM base""",
    "distinct_marital": f"WITH {RAW_INFO} SELECT DISTINCT cst_marital_status FROM raw_info",
    "dropna_any": f"""WITH {RAW_SALES} SELECT {', '.join(SALES_COLUMNS)} FROM raw_sales
        WHERE {' AND '.join(c + ' IS NOT NULL' for c in SALES_COLUMNS)}""",
    "median_fill": f"""WITH {RAW_SALES} SELECT sls_ord_num, sls_prd_key,
        ROUND(coalesce(sls_sales, (SELECT median(sls_sales) FROM raw_sales)), 4) AS sls_sales,
        ROUND(coalesce(sls_price, (SELECT median(sls_price) FROM raw_sales)), 4) AS sls_price FROM raw_sales""",
    "median_fill_nan": f"""WITH {RAW_SALES}, known AS (
        SELECT sls_ord_num, sls_prd_key, CASE WHEN sls_cust_id % 10 <> 3 THEN sls_sales END AS sls_sales, sls_price FROM raw_sales)
        SELECT sls_ord_num, sls_prd_key, ROUND(coalesce(sls_sales, (SELECT median(sls_sales) FROM known)), 4) AS sls_sales,
        ROUND(coalesce(sls_price, (SELECT median(sls_price) FROM known)), 4) AS sls_price FROM known""",
    "zscore_filter_nan": """WITH known AS (SELECT event_id, value FROM events WHERE event_id % 13 <> 5)
        SELECT event_id, value FROM known, (SELECT avg(value) AS mu, stddev_pop(value) AS sd FROM known)
        WHERE abs((value - mu) / sd) < 3""",
    "zscore_filter": """SELECT event_id, value FROM events, (SELECT avg(value) AS mu, stddev_pop(value) AS sd FROM events)
        WHERE abs((value - mu) / sd) < 3""",
    "duplicate_count": f"""WITH {RAW_SALES} SELECT count(*) - count(DISTINCT sls_ord_num) AS duplicates FROM raw_sales""",
    "columns_equal": f"""SELECT bool_and(o_custkey IS NOT DISTINCT FROM {DIGITS.format(c='c_name')}) AS columns_equal
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "null_profile": _nulls(),
    "null_profile_types": f"""SELECT *, CASE column_name {' '.join(f"WHEN '{c}' THEN '{t}'" for c, t in SALES_TYPES.items())} END
        AS data_type FROM ({_nulls()})""",
    "dedupe_keep_first": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice,
        l_quantity, l_shipdate) = 1""",
    # sources and sinks
    "stage_csv": f"WITH {RAW_INFO} SELECT * EXCLUDE (info_row) FROM raw_info",
    "stage_all_csv": f"""WITH {FACT_TABLES} SELECT * EXCLUDE (cust_row, info_row, loc_row, l_orderkey, l_linenumber, l_partkey,
        l_suppkey, l_extendedprice, l_quantity, l_shipdate) FROM fact""",
    "export_json": f"WITH {RAW_PRD} SELECT * FROM raw_prd",
    "warehouse_round_trip": WITH_BASE + """SELECT sls_ord_num, line, order_date, sls_price FROM base
        WHERE order_date BETWEEN DATE '1997-03-10' AND DATE '1998-02-20'""",
    # dimensions, fact, warehouse
    "customer_dim": f"""WITH {RAW_CUST}, {RAW_INFO}, {RAW_LOC}, {CUSTOMER}
        SELECT * EXCLUDE (cust_row, info_row, loc_row) FROM customer_dim""",
    "product_dim": f"WITH {RAW_PRD}, {RAW_CAT}, {PRODUCT} SELECT * FROM product_dim",
    "wide_fact": f"""WITH {FACT_TABLES} SELECT * EXCLUDE (cust_row, info_row, loc_row, l_orderkey, l_linenumber, l_partkey,
        l_suppkey, l_extendedprice, l_quantity, l_shipdate) FROM fact""",
    "wide_fact_fanout": f"WITH {FACT_TABLES} SELECT prd_key, prd_id, count(*) AS sales_rows FROM fact GROUP BY 1, 2",
    "warehouse_clean": _clean("sls_ord_num", None),
    "warehouse_clean_active": _clean(
        "sls_ord_num, l_linenumber, prd_key", "sls_ord_num CID order_date ship_date due_date CAT", ", l_linenumber AS line"
    ),
    "dashboard_base": WITH_BASE + f"""SELECT sls_ord_num, line, prd_key, CID, order_date, ship_date, due_date, birth_date, GEN,
        CNTRY, sls_quantity, sls_price, prd_cost, CAT, SUBCAT, prd_nm, MAINTENANCE, customer_age,
        CAST(Revenue AS {MONEY}) AS Revenue, CAST(Cost AS {MONEY}) AS Cost, CAST(Profit AS {MONEY}) AS Profit,
        Margin, CAST(date_trunc('month', order_date) AS DATE) AS order_year_month,
        order_to_ship_days, ship_delay FROM base""",
    # sales mart
    "sales_kpis": WITH_BASE + f"""SELECT CAST(sum(Revenue) AS {MONEY}) AS total_revenue, ROUND(avg(Margin), 6) AS avg_margin,
        count(DISTINCT CID) AS active_customers, CAST(sum(Revenue) AS DOUBLE) / count(Revenue) AS avg_order_value FROM base""",
    "monthly_revenue": _gap_filled(
        "CAST(date_trunc('month', order_date) AS DATE)", "1 MONTH", "sum(Revenue)", "last_day(b)", "Revenue", MONEY
    ),
    "country_top10": WITH_BASE + f"""SELECT CNTRY, CAST(sum(Revenue) AS {MONEY}) AS Revenue FROM base WHERE CNTRY IS NOT NULL
        GROUP BY CNTRY ORDER BY sum(Revenue) DESC, CNTRY LIMIT 10""",
    "category_trend": WITH_BASE + f"""SELECT last_day(order_date) AS order_date, CAT, CAST(sum(Revenue) AS {MONEY}) AS Revenue
        FROM base WHERE CAT IS NOT NULL GROUP BY 1, 2""",
    # customer mart
    "customer_metrics": WITH_METRICS + """SELECT * REPLACE (ROUND(revenue_std, 4) AS revenue_std) FROM metrics""",
    "first_values": WITH_BASE + """, changing AS (SELECT CID, order_date, sls_ord_num, line,
            CASE sls_ord_num % 4 WHEN 0 THEN 'Male' WHEN 2 THEN 'Female' WHEN 3 THEN 'M' END AS g,
            CASE (sls_ord_num + line) % 5 WHEN 2 THEN 'FRANCE' WHEN 3 THEN 'SPAIN' WHEN 4 THEN 'ITALY' END AS c,
            CASE WHEN line % 3 <> 0 THEN sls_ord_num % 60 END AS a FROM base)
        SELECT CID, first(c ORDER BY order_date, sls_ord_num, line, c) FILTER (WHERE c IS NOT NULL) AS country,
            first(g ORDER BY order_date, sls_ord_num, line, g) FILTER (WHERE g IS NOT NULL) AS gender,
            first(a ORDER BY order_date, sls_ord_num, line, a) FILTER (WHERE a IS NOT NULL) AS age
        FROM changing GROUP BY CID""",
    "rfm_scores": WITH_SEGMENTS + """SELECT CID, recency_days, total_orders, total_revenue,
        CAST(recency_score AS INTEGER) AS recency_score, CAST(frequency_score AS INTEGER) AS frequency_score,
        CAST(monetary_score AS INTEGER) AS monetary_score FROM scored""",
    "rfm_segments": WITH_SEGMENTS + """SELECT CID, total_orders, total_revenue, gender,
        CAST(recency_score AS INTEGER) AS recency_score, CAST(frequency_score AS INTEGER) AS frequency_score,
        CAST(monetary_score AS INTEGER) AS monetary_score, ROUND(CAST(rfm_score AS DOUBLE), 6) AS rfm_score, segment
        FROM segments""",
    "customer_kpis": WITH_SEGMENTS + f"""SELECT count(*) FILTER (segment = 'Champions') AS champions,
        CAST(coalesce(sum(total_revenue) FILTER (segment = 'Champions'), 0) AS {MONEY}) AS champions_revenue,
        count(*) FILTER (segment = 'At Risk') AS at_risk,
        CAST(coalesce(sum(total_revenue) FILTER (segment = 'At Risk'), 0) AS {MONEY}) AS at_risk_revenue,
        CAST(sum(customer_lifespan_days) AS DOUBLE) / count(*) AS avg_lifespan_days,
        CAST(sum(customer_lifespan_days) AS DOUBLE) / count(*) / 30 AS avg_lifespan_months,
        count(*) FILTER (total_orders > 1) AS repeat_customers,
        CAST(count(*) FILTER (total_orders > 1) AS DOUBLE) / count(*) * 100 AS repeat_rate FROM segments""",
    "segment_stats": WITH_SEGMENTS + f"""SELECT segment, count(CID) AS customer_count,
        CAST(sum(total_revenue) AS DOUBLE) / count(*) AS avg_revenue, CAST(sum(total_revenue) AS {MONEY}) AS total_segment_revenue,
        ROUND(avg(avg_order_value), 6) AS avg_order_value, CAST(sum(total_orders) AS DOUBLE) / count(*) AS avg_orders,
        CAST(sum(recency_days) AS DOUBLE) / count(*) AS avg_recency, ROUND(avg(profit_margin), 6) AS avg_margin
        FROM segments GROUP BY segment""",
    "segment_stats_rounded": WITH_SEGMENTS + f"""SELECT segment, customer_count, total_segment_revenue,
        {', '.join(f'round_even({c}, 2) AS {c}' for c in STATS.split(', ') if c.startswith('avg'))} FROM ({SEGMENT_STATS})""",
    "segment_distribution": WITH_SEGMENTS + _five("segment", "total_revenue", "segments"),
    "age_gender_revenue": WITH_SEGMENTS + f"""SELECT CAST(floor(age / 5.0) * 5 AS BIGINT) AS age_bin, gender,
        CAST(sum(total_revenue) AS {MONEY}) AS total_revenue FROM segments WHERE gender IN ('Male', 'Female')
        GROUP BY 1, 2""",
    "age_by_gender": WITH_BASE + _five("GEN", "customer_age", "base"),
    "monthly_active": WITH_BASE + """SELECT last_day(order_date) AS month, count(DISTINCT CID) AS active_customers
        FROM base GROUP BY 1""",
    "new_vs_returning": WITH_BASE + """, firsts AS (SELECT CID, min(order_date) AS first_date FROM base GROUP BY CID)
        SELECT last_day(order_date) AS order_date, CASE WHEN last_day(order_date) = last_day(first_date) THEN 'New'
        ELSE 'Returning' END AS customer_type, count(DISTINCT CID) AS customers
        FROM base JOIN firsts USING (CID) GROUP BY 1, 2""",
    "global_rank": """SELECT o_custkey, count(*) AS orders, row_number() OVER (ORDER BY count(*), o_custkey) AS rank
        FROM orders GROUP BY o_custkey""",
    # product mart, operations mart, explorer
    "margin_by_category": WITH_BASE + """SELECT CAT, ROUND(avg(Margin), 6) AS Margin FROM base WHERE CAT IS NOT NULL
        GROUP BY CAT""",
    "product_hierarchy": WITH_BASE + f"""SELECT CAT, SUBCAT, prd_nm,
        CAST(CASE grouping(CAT, SUBCAT, prd_nm) WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS INTEGER) AS level,
        CAST(sum(Revenue) AS {MONEY}) AS Revenue
        FROM base GROUP BY ROLLUP (CAT, SUBCAT, prd_nm) HAVING grouping(CAT, SUBCAT, prd_nm) < 7""",
    "product_hierarchy_nulls": WITH_BASE + ", " + UNNAMED + " " + " UNION ALL ".join(
        f"""SELECT CAT, {'SUBCAT' if level > 1 else 'NULL'} AS SUBCAT, {'prd_nm' if level > 2 else 'NULL'} AS prd_nm, {level} AS level,
        CAST(sum(Revenue) AS {MONEY}) AS Revenue FROM unnamed
        WHERE {' AND '.join(c + ' IS NOT NULL' for c in ('CAT', 'SUBCAT', 'prd_nm')[:level])}
        GROUP BY {', '.join(('CAT', 'SUBCAT', 'prd_nm')[:level])}""" for level in (1, 2, 3)),
    "product_profile_nulls": WITH_BASE + ", " + UNNAMED + """ SELECT prd_nm, count(*) AS rows,
        CAST(sum(prd_cost) AS DOUBLE) / count(*) AS prd_cost, CAST(sum(sls_price) AS DOUBLE) / count(*) AS sls_price,
        ROUND(avg(Margin), 6) AS Margin, CAST(sum(sls_quantity) AS DOUBLE) / count(*) AS sls_quantity
        FROM unnamed WHERE Margin IS NOT NULL AND prd_nm IS NOT NULL GROUP BY prd_nm""",
    "product_characteristics": WITH_BASE + """SELECT prd_nm, prd_cost, sls_price, Margin, sls_quantity
        FROM base WHERE Margin IS NOT NULL AND prd_cost IS NOT NULL AND sls_price IS NOT NULL
        AND sls_quantity IS NOT NULL""",
    "product_profile": WITH_BASE + """SELECT prd_nm, count(*) AS rows,
        CAST(sum(prd_cost) AS DOUBLE) / count(*) AS prd_cost, CAST(sum(sls_price) AS DOUBLE) / count(*) AS sls_price,
        ROUND(avg(Margin), 6) AS Margin, CAST(sum(sls_quantity) AS DOUBLE) / count(*) AS sls_quantity FROM base WHERE Margin IS NOT NULL GROUP BY prd_nm""",
    "fulfilment_time": WITH_BASE + """SELECT MAINTENANCE, CAT, CAST(sum(order_to_ship_days) AS DOUBLE) / count(order_to_ship_days)
        AS order_to_ship_days FROM base GROUP BY MAINTENANCE, CAT""",
    "daily_orders": DAILY,
    "order_density_calendar": f"""SELECT CAST(isodow(order_date) - 1 AS INTEGER) AS weekday,
        CAST(month(order_date) AS INTEGER) AS month, CAST(sum(orders) AS BIGINT) AS orders FROM ({DAILY}) GROUP BY 1, 2""",
    "country_ops": WITH_BASE + """SELECT CNTRY, CAST(sum(order_to_ship_days) AS DOUBLE) / count(*) AS order_to_ship_days,
        CAST(sum(ship_delay) AS DOUBLE) / count(*) AS ship_delay, ROUND(avg(Margin), 6) AS Margin
        FROM base WHERE CNTRY IS NOT NULL GROUP BY CNTRY""",
    "explorer_page": WITH_BASE + f"""SELECT sls_ord_num, line, prd_key, order_date, ship_date, due_date, CNTRY, CAT,
        CAST(Revenue AS {MONEY}) AS Revenue FROM base ORDER BY base.Revenue DESC NULLS LAST, sls_ord_num, line, prd_key, supplier,
        sls_price, ship_date LIMIT 100""",
    "explorer_page_ascending": WITH_BASE + """SELECT sls_ord_num, line, prd_key, CASE WHEN sls_ord_num % 2000 = 1 THEN ship_delay END AS ship_delay
        FROM base ORDER BY CASE WHEN sls_ord_num % 2000 = 1 THEN base.ship_delay END NULLS LAST, sls_ord_num, line, prd_key, supplier,
        sls_price, ship_date LIMIT 100""",
    "row_count": "SELECT count(*) AS records FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    # versions, footers, pages
    "warehouse_replace": WITH_BASE + "SELECT sls_ord_num, line, order_date, sls_price FROM base WHERE year(order_date) = 1997",
    "write_metrics": _nulls(),
    "read_back_check": f"WITH {RAW_CAT} SELECT * FROM raw_cat",
    "stored_bounds": WITH_BASE + "SELECT " + ", ".join(
        f"min({c}) AS min_{c}, max({c}) AS max_{c}, count({c}) AS count_{c}" for c in ("order_date", "ship_date", "sls_quantity")
    ) + " FROM base",
    "stored_month_counts": WITH_BASE + "SELECT CAST(date_trunc('month', order_date) AS DATE) AS order_month, count(*) AS records FROM base GROUP BY 1",
    "explorer_page_50": _page("DESC"),
    "explorer_page_50_ascending": _page("ASC"),
    "explorer_after_row": WITH_BASE + """SELECT sls_ord_num, line, prd_key, CASE WHEN sls_ord_num % 50 = 1 THEN ship_delay END AS ship_delay
        FROM base WHERE sls_ord_num % 50 <> 1 AND sls_ord_num > 300 ORDER BY sls_ord_num, line, prd_key, supplier, sls_price, ship_date LIMIT 100""",
}
# one pass for several marts, estimates, guards
ORACLE |= {
    "shared_marts": " UNION ALL ".join((
        f"SELECT 'month' AS mart, CAST(order_date AS VARCHAR) AS k1, CAST(NULL AS VARCHAR) AS k2, ROUND(CAST(Revenue AS DOUBLE), 2) AS v FROM ({ORACLE['monthly_revenue']})",
        f"SELECT 'trend', CAST(order_date AS VARCHAR), CAT, ROUND(CAST(Revenue AS DOUBLE), 2) FROM ({ORACLE['category_trend']})",
        f"SELECT 'country', CNTRY, NULL, ROUND(CAST(Revenue AS DOUBLE), 2) FROM ({ORACLE['country_top10']})",
        f"SELECT 'margin', CAT, NULL, Margin FROM ({ORACLE['margin_by_category']})",
        f"SELECT 'product', CAT, SUBCAT, ROUND(CAST(Revenue AS DOUBLE), 2) FROM ({ORACLE['product_hierarchy']}) WHERE level = 2",
        f"SELECT 'fulfilment', MAINTENANCE, CAT, ROUND(order_to_ship_days, 6) FROM ({ORACLE['fulfilment_time']})",
        f"SELECT 'delay', CNTRY, NULL, ROUND(ship_delay, 6) FROM ({ORACLE['country_ops']})",
        f"SELECT 'total', NULL, NULL, avg_margin FROM ({ORACLE['sales_kpis']})",
    )),
    "grouped_totals": WITH_BASE + f"""SELECT concat_ws(',', CASE WHEN grouping(CAT) = 0 THEN 'CAT' END, CASE WHEN grouping(CNTRY) = 0 THEN 'CNTRY' END,
            CASE WHEN grouping(MAINTENANCE) = 0 THEN 'MAINTENANCE' END) AS grouping, CNTRY, CAT, MAINTENANCE, count(*) AS rows,
        CAST(sum(Revenue) AS {MONEY}) AS Revenue, CAST(sum(Profit) AS {MONEY}) AS Profit
        FROM base GROUP BY GROUPING SETS ((CNTRY), (CAT, MAINTENANCE), ())""",
    "active_estimates": WITH_BASE + """SELECT CNTRY, count(DISTINCT CID) AS customers, count(DISTINCT sls_ord_num) AS orders, true AS customers_near,
        true AS orders_near FROM base WHERE order_date >= DATE '1997-01-01' AND CNTRY IS NOT NULL GROUP BY CNTRY""",
    "quantile_estimates": WITH_BASE + "SELECT GEN, count(*) AS sales_rows, true AS quartiles_near FROM base WHERE GEN IS NOT NULL GROUP BY GEN",
    "column_guard": WITH_BASE + """SELECT sls_ord_num, line, order_date, sls_quantity, sls_price, Revenue,
        CAST(date_trunc('month', order_date) AS DATE) AS order_year_month, order_date AS order_date_display FROM base""",
    "empty_input": f"""SELECT CAST(0 AS {MONEY}) AS total_revenue, CAST(NULL AS DOUBLE) AS avg_margin, count(*) AS active_customers,
        CAST(NULL AS DOUBLE) AS avg_order_value, count(*) AS countries, count(*) AS months FROM orders WHERE o_orderdate < DATE '1900-01-01'""",
    "warehouse_medians": f"""WITH {FACT_TABLES} SELECT ROUND(median(sls_sales), 4) AS sls_sales, ROUND(median(sls_price), 4) AS sls_price,
        ROUND(median(prd_cost), 4) AS prd_cost FROM fact""",
    "warehouse_first_rows": f"""WITH {FACT_TABLES} SELECT sls_ord_num, prd_key, prd_id, CID, l_linenumber AS line FROM fact
        QUALIFY row_number() OVER (PARTITION BY sls_ord_num ORDER BY {ROW_ORDER}) = 1""",
    "wide_fact_bucketed": ORACLE["wide_fact"],
    "median_estimates": f"""WITH {RAW_SALES} SELECT 'sls_sales' AS column_name, count(sls_sales) AS known, true AS near FROM raw_sales
        UNION ALL SELECT 'sls_quantity', count(sls_quantity), true FROM raw_sales""",
}
