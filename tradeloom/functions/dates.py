"""Date parsing, differences and calendar parts; every date is a ``DateType``."""

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradeloom import config

_ANY_FOUR_DIGIT_YEAR = (dt.date(1000, 1, 1), dt.date(9999, 12, 31))


def parse_yyyymmdd(col: Column, bounds=config.DATE_BOUNDS) -> Column:
    """Eight-digit integer such as 20130728; anything that is not a real date gives null.

    Plain integer arithmetic, with the bounds compared as integers too.
    """
    low, high = (int(d.strftime("%Y%m%d")) for d in bounds or _ANY_FOUR_DIGIT_YEAR)
    number = col.try_cast("bigint")
    year = F.call_function("div", number, F.lit(10000)).cast("int")
    month, day = (F.call_function("div", number, F.lit(100)) % 100).cast("int"), (number % 100).cast("int")
    first = F.make_date(year, month, F.lit(1))
    exists = (day >= 1) & (day <= F.dayofmonth(F.last_day(first)))
    return F.when(number.between(low, high) & month.between(1, 12), F.when(exists, F.date_add(first, day - 1)))


def parse_date(col: Column, fmt: str = "yyyy-MM-dd", bounds=config.DATE_BOUNDS) -> Column:
    """Text date in one fixed format; unparseable text gives null."""
    low, high = bounds or _ANY_FOUR_DIGIT_YEAR
    text = col.cast("string")
    if fmt == "yyyy-MM-dd":  # a cast parses this shape far faster than a date pattern, and text order is date order
        shaped = F.rlike(text, F.lit("^[0-9]{4}-[0-9]{2}-[0-9]{2}\\z"))
        return F.when(shaped & text.between(low.isoformat(), high.isoformat()), text.try_cast("date"))
    date = F.try_to_date(text, fmt)
    return F.when(date.between(F.lit(low), F.lit(high)), date)


def as_of_date(as_of=None) -> Column:
    """The day ages and recencies are measured from; today unless given."""
    return F.current_date() if as_of is None else F.lit(as_of).cast("date")


def days_between(end: Column, start: Column) -> Column:
    return F.datediff(end, start).cast("bigint")


def age_years(birth: Column, as_of=None, rounding: str = "floor") -> Column:
    """Age in 365-day years; ``rounding`` is ``floor`` (warehouse) or ``trunc`` (dashboard)."""
    years = F.datediff(as_of_date(as_of), birth) / F.lit(config.DAYS_PER_YEAR)
    if rounding == "floor":
        return F.floor(years).cast("bigint")
    if rounding == "trunc":
        return years.cast("bigint")
    raise ValueError(f"rounding must be 'floor' or 'trunc', not {rounding!r}")


def month_name(date: Column) -> Column:
    """Full English month name."""
    return F.date_format(date, "MMMM")


def month_of(date: Column) -> Column:
    """First day of the month, the month period of a date."""
    return F.trunc(date, "MM")


def month_end(date: Column) -> Column:
    """Last day of the month, the label of a monthly bucket."""
    return F.last_day(date)


def weekday(date: Column) -> Column:
    """Monday is 0."""
    return F.weekday(date)
