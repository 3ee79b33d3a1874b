"""Sales with customer and product attributes."""

from collections.abc import Callable

from pyspark.sql import DataFrame

from tradeloom.materialize import materialize

BROADCAST_ROWS = 100_000  # a stored dimension with more rows is shuffled, whatever the size of its files
SALES_KEYS = {"sls_prd_key": "prd_key", "sls_cust_id": "CID"}


def build_fact(sales: DataFrame, customer: DataFrame, product: DataFrame, store_dimensions: bool = True,
               halfway: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Every sale, with nulls where customer or product is unknown.

    A product with several versions repeats the sale once per version.

    Dimensions are stored first: their size and rows are then known, so that a small one is broadcast, and a large one is
    shuffled for this join alone, which is what lets AQE split a key that holds a large share of the sales.
    (A customer dimension still partitioned by ``CID`` from its own joins would be joined without such a split.)  What is joined with the customers passes through ``halfway``, which may store it.
    """
    sales, customer, product = named_apart(sales, customer, product)
    if store_dimensions:
        customer, product = by_rows(materialize(customer)), by_rows(materialize(product))
    known = sales.join(customer, "CID", "left")
    return (halfway(known) if halfway else known).join(product, "prd_key", "left")


def by_rows(stored: DataFrame) -> DataFrame:
    """A stored table that a join does not broadcast if it has many rows.

    Spark judges a table by the size of its files, but a few megabytes can hold millions of rows whose columns have few values,
    and a broadcast table passes through the driver row by row.
    """
    return stored.hint("merge") if stored.count() > BROADCAST_ROWS else stored


def named_apart(sales: DataFrame, customer: DataFrame, product: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables with the column names that they have in the fact: shared keys, a suffix where names clash."""
    sales = sales.withColumnsRenamed(SALES_KEYS)
    customer = _suffix_clashes(customer, sales.columns, "CID", "_cust")
    return sales, customer, _suffix_clashes(product, sales.columns + customer.columns, "prd_key", "_prd")


def _suffix_clashes(right: DataFrame, taken: list[str], key: str, suffix: str) -> DataFrame:
    return right.withColumnsRenamed({c: c + suffix for c in right.columns if c in taken and c != key})
