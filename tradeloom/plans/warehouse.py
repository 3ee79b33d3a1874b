"""Wide fact to clean warehouse table."""

from collections.abc import Sequence
from functools import reduce
from itertools import takewhile
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeloom import config
from tradeloom.functions.dates import age_years, days_between, month_name, parse_date, parse_yyyymmdd
from tradeloom.functions.text import standardise_text
from tradeloom.materialize import compressed, discard, materialize
from tradeloom.operators.cleaning import (
    fill_median, fill_text, filter_zscore, keep_first, keep_first_peers, medians, require,
)
from tradeloom.operators.profile import columns_equal
from tradeloom.operators.quantiles import SKETCH_ACCURACY
from tradeloom.plans.fact import build_fact, by_rows, named_apart
from tradeloom.schemas import RAW_SCHEMAS, row_column

#: Columns whose values the cleaning changes.
CHANGED = {*config.MEDIAN_COLUMNS, *config.FILL_COLUMNS, "GEN", "CNTRY", "cst_id"}
PEERS = ("_sales_peers", "_customer_peers", "_product_peers")

ROW_ORDER = tuple(row_column(t) for t in ("sales", "cust", "cust_info", "loc", "prd", "cat") if t in RAW_SCHEMAS)


def convert_dates(df: DataFrame, bounds=config.DATE_BOUNDS) -> DataFrame:
    """Replace raw date columns by parsed ones; columns that are absent are skipped.

    Dates outside ``bounds`` become null; ``None`` keeps all years from 1000 to 9999.
    """
    for raw, clean in config.MESSY_DATES.items():
        if raw in df.columns:
            df = df.withColumn(clean, parse_yyyymmdd(F.col(raw), bounds)).drop(raw)
    for raw, clean in config.TEXT_DATES.items():
        if raw in df.columns:
            df = df.withColumn(clean, parse_date(F.col(raw), bounds=bounds)).drop(raw)
    return df


def build_warehouse(
    sales: DataFrame,
    customer: DataFrame,
    product: DataFrame,
    bounds=config.DATE_BOUNDS,
    as_of=None,
    key: str | Sequence[str] = "sls_ord_num",
    order: Sequence[str] | None = None,
    required: Sequence[str] | None = None,
    accuracy: int = SKETCH_ACCURACY,
    row_order: str | None = None,
    estimate: int | None = None,
) -> DataFrame:
    """Wide fact and its cleaning in one call, with the result of :func:`clean_warehouse` over :func:`build_fact`.

    Dates are parsed before the joins: once per customer and product, not once per joined row.

    Where the key is one of the sales rows and the order begins with their columns, the wide fact is never stored or moved: all its
    rows give the medians from a few narrow columns, and only what can come first is joined with everything.  A joined row
    that comes first in its key is made of sales that come first by their own part of the order and of the first versions of its
    customer and its product.  What shares a place is kept throughout, and the rest of the order decides on the joined rows.

    Every step is stored and what it was made of is deleted, so the disk holds one step's shuffles and few copies of the sales.
    """
    tables = named_apart(*(convert_dates(df, bounds) for df in (sales, customer, product)))
    fact = build_fact(*tables, store_dimensions=False)  # for its names
    places = _places(fact, order)
    names = [set(t.columns) for t in tables]
    keys = [key] if isinstance(key, str) else list(key)
    leading = list(takewhile(names[0].__contains__, places)) if all(isinstance(c, str) for c in (*keys, *places)) else []
    if not leading or not names[0].issuperset(keys) or CHANGED & {*keys, *places}:
        return clean_warehouse(build_fact(*tables), as_of, key, order, required, bounds, accuracy, row_order, estimate)
    sales, customer, product = map(compressed, tables)
    customer, product = by_rows(customer), by_rows(product)

    def numbers(table):
        return table.select(*(c for c in table.columns if c in {"CID", "prd_key", "cst_id", *config.MEDIAN_COLUMNS}))

    joined = compressed(build_fact(*map(numbers, (sales, customer, product)), store_dimensions=False).drop("prd_key"))
    middle = materialize(medians(joined, config.MEDIAN_COLUMNS, accuracy, estimate))  # one row
    same_identifier = _same_identifier(joined)
    discard(joined)

    def versions(table, at, peers):
        rest = [c for c in places if c in table.columns and c not in names[0]]
        first = compressed(keep_first_peers(table.where(F.col(at).isNotNull()), at, rest, peers))
        discard(table)
        return by_rows(first), not first.where(F.col(peers) > 1).isEmpty()

    (customer, customers_share), (product, products_share) = versions(customer, "CID", PEERS[1]), versions(product, "prd_key", PEERS[2])

    def alone(*peers):
        return reduce(and_, (F.coalesce(F.col(p), F.lit(1)) == 1 for p in peers))

    def unplaced(table, *peers):
        """Rows that are sure to be alone in their key need no places, unless the result shows them."""
        hidden = [c for c in table.columns if c in places and c.startswith("_")]
        return table.withColumns({c: F.when(~alone(*peers), F.col(c)) for c in hidden})

    lines = keep_first_peers(sales, keys, leading, PEERS[0])
    lines = compressed(lines if row_order or customers_share or products_share else unplaced(lines, PEERS[0]))
    discard(sales)
    steps = [product]

    def halfway(known):
        steps.append(compressed(known if row_order or products_share else unplaced(known, *PEERS[:2])))
        discard(lines, customer)
        return steps[-1]

    first = build_fact(lines, customer, product, store_dimensions=False, halfway=halfway)
    rows = materialize(_active(convert_dates(first.withColumn("_alone", alone(*PEERS)).drop(*PEERS), bounds)))
    discard(*steps)
    filled = _filled(rows, middle, same_identifier)
    shared = keep_first(filled.where("not _alone").drop("_alone"), key, _decided(filled.drop("_alone"), places))
    unique = filled.where("_alone").drop("_alone").unionByName(materialize(shared))
    return _featured(unique, as_of, required, row_order)


def clean_warehouse(
    fact: DataFrame,
    as_of=None,
    key: str | Sequence[str] = "sls_ord_num",
    order: Sequence[str] | None = None,
    required: Sequence[str] | None = None,
    bounds=config.DATE_BOUNDS,
    accuracy: int = SKETCH_ACCURACY,
    row_order: str | None = None,
    estimate: int | None = None,
) -> DataFrame:
    """Imputed, de-duplicated, outlier-free sales with date features.

    The order of the steps decides the result: medians are taken over the joined rows, the outlier
    statistics over the de-duplicated ones, and rows with nulls go last.  ``order`` says which row of a
    ``key`` comes first (raw row order by default); a name that ``fact`` lacks is an error.  By default a null in *any* column removes
    the row, which removes every product without an end date; pass ``required`` to keep them.

    ``row_order`` names a column that keeps the place of the row in the raw tables, for marts that need the
    first value in that order.  ``estimate`` fills with estimated medians (see :func:`tradeloom.operators.cleaning.medians`).
    """
    order = _places(fact, order)
    # Medians, the identifier check and the rows themselves all read the joined fact.
    joined = materialize(_active(convert_dates(fact, bounds)))
    filled = _filled(joined, medians(joined, config.MEDIAN_COLUMNS, accuracy, estimate), _same_identifier(joined))
    # De-duplicated rows are read for the outlier statistics and again for the filter.
    unique = materialize(keep_first(filled, key, _decided(filled, order)))
    return _featured(unique, as_of, required, row_order)


def _places(fact: DataFrame, order: Sequence[str] | None) -> list[str]:
    """The given order, then raw row order, which also decides between rows that are equal in the given one."""
    missing = [c for c in order or () if isinstance(c, str) and c not in fact.columns]
    if missing:
        raise ValueError(f"no such columns to order by: {missing}")
    order = [*(order or ()), *(c for c in ROW_ORDER if c in fact.columns and c not in [o for o in order or () if isinstance(o, str)])]
    if not order:
        raise ValueError("fact has no row order columns; pass order")
    return order


def _active(fact: DataFrame) -> DataFrame:
    return fact.withColumn("is_active_product", F.col("product_end_date").isNull())


def _filled(joined: DataFrame, middle: DataFrame, same_identifier: bool) -> DataFrame:
    filled = fill_text(fill_median(joined, found=middle)).withColumns({
        "GEN": standardise_text(F.col("GEN")),
        "CNTRY": standardise_text(F.col("CNTRY")),
    })
    return filled.drop("cst_id") if same_identifier else filled


def _decided(filled: DataFrame, order: Sequence) -> list:
    """Rows that agree in the order are told apart by their values, so the choice does not depend on partitions."""
    return [*order, F.xxhash64(*sorted(filled.columns))]


def _featured(unique: DataFrame, as_of, required: Sequence[str] | None, row_order: str | None) -> DataFrame:
    """Outlier-free rows with date features and without nulls."""
    typical = filter_zscore(unique)
    featured = typical.withColumns({
        "customer_age": age_years(F.col("birth_date"), as_of, "floor"),
        "order_to_ship_days": days_between(F.col("ship_date"), F.col("order_date")),
    })
    if row_order:
        featured = featured.withColumn(row_order, F.struct(*(c for c in ROW_ORDER if c in typical.columns)))
    featured = featured.drop("cst_gndr", *(c for c in typical.columns if c.startswith("_") and c != row_order))
    complete = require(featured, required)
    return complete.withColumns({f"{c}_month": month_name(F.col(c)) for c in config.DATE_COLUMNS})


def _same_identifier(joined: DataFrame) -> bool:
    """One boolean decides the output schema."""
    if "cst_id" not in joined.columns:
        return False
    ids = joined.select("CID", F.col("cst_id").try_cast("bigint").alias("cst_id"))
    return bool(columns_equal(ids, "CID", "cst_id").first()[0])
