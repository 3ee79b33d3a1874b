"""Fixed values that decide results. Every one of them can be overridden by argument."""

import datetime as dt

# --- fixed values: texts a delimited file may use for "missing" -------------
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# --- fixed values: spelling maps ---------------------------------------------
COUNTRY_MAP = {
    "US": "UNITED STATES",
    "USA": "UNITED STATES",
    "UNITED STATES": "UNITED STATES",
    "DE": "GERMANY",
    "GERMENY": "GERMANY",
    "GERMANY": "GERMANY",
}
GENDER_LABELS = {"MALE": "Male", "FEMALE": "Female"}
GENDER_CODES = {"Male": "M", "Female": "F", "m": "M", "f": "F"}

# --- fixed values: fills, limits and sizes ------------------------------------
FILL_TEXT = "Not Specified"
UNKNOWN = "Unknown"
OTHER = "Other"
Z_LIMIT = 3.0
TOP_K = 10
PAGE_ROWS = 100
SCORE_BINS = 5
AGE_BIN_YEARS = 5
DAYS_PER_YEAR = 365
DAYS_PER_MONTH = 30
JDBC_BATCH_ROWS = 1000

# Dates outside the nanosecond-timestamp range count as unparseable.
DATE_BOUNDS = (dt.date(1677, 9, 22), dt.date(2262, 4, 11))

# --- fixed values: lowest sum of the three scores that earns a segment ---------
SEGMENT_LADDER = (
    (14, "Champions"),
    (12, "Loyal Customers"),
    (11, "Potential Loyalists"),
    (9, "New Customers"),
    (8, "Promising"),
    (6, "Need Attention"),
    (5, "About to Sleep"),
)
LOWEST_SEGMENT = "At Risk"

# --- fixed values: column roles in the warehouse --------------------------------
MESSY_DATES = {"sls_order_dt": "order_date", "sls_ship_dt": "ship_date", "sls_due_dt": "due_date"}
TEXT_DATES = {
    "BDATE": "birth_date",
    "cst_create_date": "customer_creation_date",
    "prd_start_dt": "product_start_date",
    "prd_end_dt": "product_end_date",
}
DATE_COLUMNS = tuple(MESSY_DATES.values()) + tuple(TEXT_DATES.values())
MEDIAN_COLUMNS = ("sls_sales", "sls_price", "prd_cost")
FILL_COLUMNS = ("cst_firstname", "cst_lastname", "cst_marital_status")
OUTLIER_COLUMNS = ("sls_quantity", "sls_price")
