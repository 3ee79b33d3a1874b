"""Clean warehouse to the base table of every mart."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradeloom import config
from tradeloom.functions.dates import age_years, days_between, month_of, parse_date
from tradeloom.functions.numbers import percent_of
from tradeloom.functions.text import map_country, map_gender

DISPLAY_SUFFIX = "_display"
DISPLAY_DATES = ("order_date", "ship_date", "due_date")


def _as_date(name: str, kind: T.DataType, bounds) -> Column:
    if isinstance(kind, T.DateType):
        return F.col(name)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.col(name).cast("date")
    if isinstance(kind, T.StringType):
        return parse_date(F.col(name), bounds=bounds)
    raise TypeError(f"{name} is {kind.simpleString()}, not a date, timestamp or text")


def dashboard_base(warehouse: DataFrame, as_of=None, bounds=config.DATE_BOUNDS) -> DataFrame:
    """Normalised texts plus revenue, cost, profit, margin, age and delay columns.

    Columns whose inputs are absent are left out, so a caller that selects fewer columns reads fewer.
    """
    types = {f.name: f.dataType for f in warehouse.schema}
    clean = {c: _as_date(c, types[c], bounds) for c in config.DATE_COLUMNS if c in types}
    if "CNTRY" in types:
        clean["CNTRY"] = map_country(F.col("CNTRY"))
    if "GEN" in types:
        clean["GEN"] = map_gender(F.col("GEN"))
    derived = _measures(types)
    if "birth_date" in types:
        derived["customer_age"] = age_years(F.col("birth_date"), as_of, "trunc")
    if "order_date" in types:
        derived["order_year_month"] = month_of(F.col("order_date"))
    if {"order_date", "ship_date"} <= types.keys():
        derived["order_to_ship_days"] = days_between(F.col("ship_date"), F.col("order_date"))
    if {"ship_date", "due_date"} <= types.keys():
        derived["ship_delay"] = days_between(F.col("due_date"), F.col("ship_date"))
    derived |= {c + DISPLAY_SUFFIX: F.col(c) for c in DISPLAY_DATES if c in types}
    normalised = warehouse.withColumns(clean) if clean else warehouse
    return normalised.withColumns(derived) if derived else normalised


def add_measures(df: DataFrame) -> DataFrame:
    """Revenue (quantity × price), Cost, Profit and Margin (percent, null without revenue)."""
    return df.withColumns(_measures({f.name: f.dataType for f in df.schema}))


def _measures(types: dict[str, T.DataType]) -> dict[str, Column]:
    found = {}
    if {"sls_quantity", "sls_price"} <= types.keys():
        found["Revenue"] = _money(F.col("sls_quantity") * F.col("sls_price"), types["sls_price"])
    if {"sls_quantity", "prd_cost"} <= types.keys():
        found["Cost"] = _money(F.col("sls_quantity") * F.col("prd_cost"), types["prd_cost"])
    if {"Revenue", "Cost"} <= found.keys():
        profit = found["Revenue"] - found["Cost"]
        exact = isinstance(types["sls_price"], T.DecimalType) and isinstance(types["prd_cost"], T.DecimalType)
        found["Profit"] = profit.cast("decimal(18,2)") if exact else profit
        found["Margin"] = percent_of(found["Profit"], found["Revenue"])
    return found


def _money(amount: Column, unit: T.DataType) -> Column:
    """Whole-cent decimals stay within 18 digits, which Spark sums as plain longs."""
    return amount.cast("decimal(18,2)") if isinstance(unit, T.DecimalType) and unit.scale <= 2 else amount
