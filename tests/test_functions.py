import datetime as dt

import pytest
from pyspark.sql import functions as F

from tradeloom.functions import dates, numbers, text


def test_missing_tokens(one):
    assert one("string", ["NA", "N/A", "", "nan", "na", " NA", "x", None], text.none_if_token) == [
        None, None, None, None, "na", " NA", "x", None]


def test_integer_key(one):
    values = ["AW00011000", "x1y22", "none", "", None, "-7", "9" * 30]
    assert one("string", values, text.extract_int_key) == [11000, 1, None, None, None, 7, None]


def test_integer_key_can_fail(one):
    assert one("string", ["AW1"], lambda c: text.extract_int_key(c, "fail")) == [1]
    with pytest.raises(Exception, match="no integer key"):
        one("string", ["none"], lambda c: text.extract_int_key(c, "fail"))
    with pytest.raises(ValueError):
        text.extract_int_key(F.lit("x"), "ignore")


def test_hyphen_is_removed_before_the_digits_are_read(one):
    assert one("string", ["AW-00011-000", "--", None], lambda c: text.extract_int_key(text.strip_literal(c))) == [
        11000, None, None]


def test_product_key_parts(one):
    keys = ["AC-HE-HL-U509-R", "AC-HE", "", None]
    assert one("string", keys, text.category_id) == ["AC_HE", "AC_HE", "", None]
    assert one("string", keys, text.product_code) == ["HL-U509-R", "", "", None]


def test_standardise_strips_every_kind_of_space(one):
    assert one("string", [" ", "", None, "\tmale  ", "\x1fa　", "a b"], text.standardise_text) == [
        "", "", None, "MALE", "A", "A B"]


def test_value_maps(one):
    assert one("string", ["us", "USA", "Germeny", " us", "France", None], text.map_country) == [
        "UNITED STATES", "UNITED STATES", "GERMANY", " US", "FRANCE", None]
    assert one("string", ["MALE", "female", " male", "M", None], text.map_gender) == ["Male", "Female", " male", "M", None]
    assert one("string", ["MALE", " female\t", "M", "", None], text.gender_bucket) == [
        "Male", "Female", "Other", "Other", "Other"]
    codes = {"Male": "M", "Female": "F", "m": "M", "f": "F"}
    assert one("string", ["Male", "f", "MALE", None], lambda c: text.map_values(c, codes, "Unknown")) == [
        "M", "F", "MALE", "Unknown"]


def test_category_path_is_null_when_a_part_is(one):
    assert one("string", ["a", None], lambda c: text.category_path(c, F.lit("b"))) == ["a > b", None]


def test_messy_dates(one):
    values = [20130728, 0, 12345, 123456789, 20130145, -2011010, None, 99991231, 16770921, 20120229, 20130229]
    day = dt.date
    assert one("bigint", values, dates.parse_yyyymmdd) == [
        day(2013, 7, 28), None, None, None, None, None, None, None, None, day(2012, 2, 29), None]
    assert one("bigint", [99991231], lambda c: dates.parse_yyyymmdd(c, bounds=None)) == [day(9999, 12, 31)]
    assert one("double", [20130728.0, float("nan"), None], dates.parse_yyyymmdd) == [day(2013, 7, 28), None, None]
    assert one("string", ["20130728", "x", "2013072a"], dates.parse_yyyymmdd) == [day(2013, 7, 28), None, None]


def test_text_dates(one):
    values = ["2013-07-28", "28.07.2013", "", "2013-02-30", None, "9999-01-01"]
    assert one("string", values, dates.parse_date) == [dt.date(2013, 7, 28), None, None, None, None, None]
    assert one("string", ["2013-7-28", "2013", "2013-07-28T10", "2013-07", "abcd-ef-gh"], dates.parse_date) == [None] * 5
    assert one("string", ["28.07.2013", "2013-07-28"], lambda c: dates.parse_date(c, "dd.MM.yyyy")) == [
        dt.date(2013, 7, 28), None]
    assert one("date", [dt.date(2013, 7, 28), None], dates.parse_date) == [dt.date(2013, 7, 28), None]


def test_ages_floor_and_trunc_differ_below_zero(one):
    as_of = dt.date(2020, 1, 1)
    births = [as_of - dt.timedelta(days=n) for n in (400, 365, 364, 0)] + [as_of + dt.timedelta(days=400), None]
    assert one("date", births, lambda c: dates.age_years(c, as_of)) == [1, 1, 0, 0, -2, None]
    assert one("date", births, lambda c: dates.age_years(c, as_of, "trunc")) == [1, 1, 0, 0, -1, None]
    with pytest.raises(ValueError):
        dates.age_years(F.lit(None), as_of, "round")


def test_calendar_parts(one):
    days = [dt.date(2024, 2, 5), None]  # a Monday
    assert one("date", days, dates.weekday) == [0, None]
    assert one("date", days, dates.month_name) == ["February", None]
    assert one("date", days, dates.month_of) == [dt.date(2024, 2, 1), None]
    assert one("date", days, dates.month_end) == [dt.date(2024, 2, 29), None]
    assert one("date", days, lambda c: dates.days_between(F.lit("2024-02-01").cast("date"), c)) == [-4, None]


def test_ratios_and_bins(one):
    assert one("int", [4, 0, None], lambda c: numbers.percent_of(F.lit(1), c)) == [25.0, None, None]
    assert one("int", [4, 5, -1, None], lambda c: numbers.floor_bin(c, 5)) == [0, 5, -5, None]


def test_segment_ladder(one):
    assert one("int", [15, 14, 13, 12, 11, 10, 9, 8, 7, 6, 5, 4, 3, None], numbers.segment) == [
        "Champions", "Champions", "Loyal Customers", "Loyal Customers", "Potential Loyalists", "New Customers",
        "New Customers", "Promising", "Need Attention", "Need Attention", "About to Sleep", "At Risk", "At Risk", None]


def test_group_without_values(spark):
    df = spark.createDataFrame([("a", None), ("b", 2)], "k string, v int")
    found = {r.k: (r.t, r.m) for r in df.groupBy("k").agg(numbers.total(F.col("v")).alias("t"), numbers.mean(F.col("v")).alias("m")).collect()}
    assert found == {"a": (0, None), "b": (2, 2.0)}
