import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tradeloom.operators import calendar, cleaning, profile, ranking
from tradeloom.operators.filters import filter_sales
from tradeloom.operators.hierarchy import hierarchy

D = dt.date


def test_na_normalisation_touches_text_only(spark):
    df = spark.createDataFrame([("NA", 1, "null"), ("x", 2, "")], "a string, n int, b string")
    assert [tuple(r) for r in cleaning.normalise_na(df).orderBy("n").collect()] == [(None, 1, None), ("x", 2, None)]
    assert [r.b for r in cleaning.normalise_na(df, ["a"]).orderBy("n").collect()] == ["null", ""]


def test_constant_fill_leaves_empty_text(spark):
    df = spark.createDataFrame([("",), (None,), ("x",)], "cst_firstname string")
    assert [r[0] for r in cleaning.fill_text(df, ["cst_firstname"]).collect()] == ["", "Not Specified", "x"]


@pytest.mark.parametrize("parts", [1, 17])
def test_keep_first_null_keys_are_one_group(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    rows = [("a", 3, "z"), ("a", 1, "y"), (None, 9, "p"), (None, 5, "q"), ("b", 2, "x")] + [("hot", 1000 - i, str(i)) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, o int, v string").repartition(5)
    found = {r.k: r.v for r in cleaning.keep_first(df, "k", ["o"]).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert found == {"a": "y", None: "q", "b": "x", "hot": "899"}


def test_keep_first_reduces_before_the_shuffle(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 3)
    plan = cleaning.keep_first(df, "k", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_require(spark):
    df = spark.createDataFrame([(1, None), (2, 3), (None, 4)], "a int, b int")
    assert cleaning.require(df).count() == 1
    assert cleaning.require(df, ["a"]).count() == 2


def test_zscore_uses_population_deviation(spark):
    values = np.append(np.random.default_rng(1).normal(size=200), [9.0, -9.0]).tolist()
    df = spark.createDataFrame([(v, 1.0 + i % 3) for i, v in enumerate(values)], "a double, b double")
    z = np.abs((values - np.mean(values)) / np.std(values))
    kept = cleaning.filter_zscore(df, ["a", "b"])
    assert kept.columns == ["a", "b"]
    assert sorted(r.a for r in kept.collect()) == sorted(np.array(values)[z < 3].tolist())
    assert cleaning.filter_zscore(df.withColumn("b", F.lit(1.0)), ["b"]).count() == 0
    assert cleaning.filter_zscore(df.union(spark.createDataFrame([(None, 1.0)], df.schema)), ["a"]).count() == (z < 3).sum()


SERIES = [(D(2023, 1, 31), 5), (D(2023, 1, 1), 1), (D(2023, 4, 2), 7), (D(2024, 1, 9), 2), (None, 99)]


def test_monthly_resample_fills_gaps(spark):
    df = spark.createDataFrame(SERIES, "order_date date, v int")
    found = {r.order_date: r.v for r in calendar.resample(df, "order_date", "month", v=F.sum("v")).collect()}
    known = pd.DataFrame(SERIES[:-1], columns=["d", "v"]).assign(d=lambda x: pd.to_datetime(x.d))
    expected = known.set_index("d").resample("ME")["v"].sum()
    assert found == {k.date(): v for k, v in expected.items()}
    assert sum(found.values()) == 15 and len(found) == 13


def test_daily_resample_counts_distinct(spark):
    rows = [(D(2023, 2, 27), "a"), (D(2023, 2, 27), "a"), (D(2023, 2, 27), "b"), (D(2023, 3, 2), "c")]
    df = spark.createDataFrame(rows, "order_date date, o string")
    found = calendar.resample(df, "order_date", "day", n=F.countDistinct("o")).orderBy("order_date").collect()
    assert [(r.order_date.day, r.n) for r in found] == [(27, 2), (28, 0), (1, 0), (2, 1)]


def test_empty_series(spark):
    df = spark.createDataFrame([], "order_date date, v int")
    assert calendar.resample(df, "order_date", "month", v=F.sum("v")).collect() == []


def test_by_bucket_has_no_gaps_filled_and_no_null_keys(spark):
    df = spark.createDataFrame([(D(2023, 1, 3), "x", 1), (D(2023, 3, 1), "x", 2), (D(2023, 3, 2), None, 9)], "d date, c string, v int")
    found = calendar.by_bucket(df, "d", "month", ["c"], v=F.sum("v")).orderBy("d").collect()
    assert [tuple(r) for r in found] == [(D(2023, 1, 31), "x", 1), (D(2023, 3, 31), "x", 2)]


def test_hierarchy_levels_add_up(spark):
    rows = [("A", "a", "p", 1), ("A", "a", "q", 2), ("A", "b", "p", 4), ("B", "c", "r", 8)]
    found = hierarchy(spark.createDataFrame(rows, "x string, y string, z string, v int"), ["x", "y", "z"], "v").collect()
    totals = {level: sum(r.v for r in found if r.level == level) for level in (1, 2, 3)}
    assert totals == {1: 15, 2: 15, 3: 15}
    assert {(r.x, r.y, r.z): r.v for r in found}[("A", "a", None)] == 3
    assert (None, None, None) not in {(r.x, r.y, r.z) for r in found}


def test_hierarchy_leaves_unnamed_nodes_out(spark):
    rows = [("A", "a", None, 1), ("A", None, "q", 2), (None, "b", "p", 4), ("B", "c", "r", 8)]
    found = hierarchy(spark.createDataFrame(rows, "x string, y string, z string, v int"), ["x", "y", "z"], "v").collect()
    assert sorted(((r.level, r.x, r.y, r.z, r.v) for r in found), key=str) == [
        (1, "A", None, None, 3), (1, "B", None, None, 8), (2, "A", "a", None, 1), (2, "B", "c", None, 8), (3, "B", "c", "r", 8)]


def test_profiles(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (None, None)], "k int, t string")
    assert {r.column_name: (r.data_type, r.non_null, r.nulls) for r in profile.profile(df).collect()} == {
        "k": ("int", 2, 1), "t": ("string", 1, 2)}
    assert {r.column_name: r.nulls for r in profile.null_counts(df).collect()} == {"k": 1, "t": 2}
    assert profile.duplicate_count(df, "k").first()[0] == 2
    assert {r.t for r in profile.distinct_values(df, "t").collect()} == {"a", None}
    assert [r.t for r in profile.domain(df, "t").collect()] == ["a"]


def test_columns_equal(spark):
    df = spark.createDataFrame([(1, 1, 1), (None, None, 2)], "a int, b int, c int")
    assert profile.columns_equal(df, "a", "b").first()[0] is True
    assert profile.columns_equal(df, "a", "c").first()[0] is False
    assert profile.columns_equal(df.where("a > 9"), "a", "c").first()[0] is True


FILTER_ROWS = [
    (1, D(2023, 1, 1), "US", "x"), (2, D(2023, 1, 2), None, "x"), (3, D(2023, 1, 3), "DE", None), (4, None, "US", "x"),
]


@pytest.mark.parametrize("arguments, kept", [
    ({}, {1, 2, 3}),
    ({"start": "2023-01-02"}, {2, 3}),
    ({"start": D(2023, 1, 1), "end": D(2023, 1, 2)}, {1, 2}),
    ({"countries": ["US", "DE"]}, {1, 3}),
    ({"countries": ["DE"], "categories": ["x"]}, set()),
])
def test_filters(spark, arguments, kept):
    df = spark.createDataFrame(FILTER_ROWS, "i int, order_date date, CNTRY string, CAT string")
    assert {r.i for r in filter_sales(df, **arguments).collect()} == kept


def test_top_k_breaks_ties_by_key(spark):
    df = spark.createDataFrame([("d", 5), ("b", 5), ("c", 9), ("a", 1), ("e", None)], "k string, v int")
    assert [r.k for r in ranking.top_k(df, "k", "v", 2).collect()] == ["c", "b"]
    assert ranking.top_k(df, "k", "v").count() == 4
