"""Column types of the six raw tables."""

RAW_SCHEMAS = {
    "cust": {"CID": "string", "BDATE": "string", "GEN": "string"},
    "cust_info": {
        "cst_id": "double",
        "cst_key": "string",
        "cst_firstname": "string",
        "cst_lastname": "string",
        "cst_marital_status": "string",
        "cst_gndr": "string",
        "cst_create_date": "string",
    },
    "loc": {"CID": "string", "CNTRY": "string"},
    "prd": {
        "prd_id": "bigint",
        "prd_key": "string",
        "prd_nm": "string",
        "prd_cost": "double",
        "prd_line": "string",
        "prd_start_dt": "string",
        "prd_end_dt": "string",
    },
    "cat": {"ID": "string", "CAT": "string", "SUBCAT": "string", "MAINTENANCE": "string"},
    "sales": {
        "sls_ord_num": "string",
        "sls_prd_key": "string",
        "sls_cust_id": "bigint",
        "sls_order_dt": "bigint",
        "sls_ship_dt": "bigint",
        "sls_due_dt": "bigint",
        "sls_sales": "double",
        "sls_quantity": "bigint",
        "sls_price": "double",
    },
}


def row_column(table: str) -> str:
    """Name of the column that keeps a raw table's row order."""
    return f"_{table}_row"
