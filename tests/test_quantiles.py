import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tradeloom.operators.cleaning import fill_median
from tradeloom.operators.quantiles import fifths, qcut, qcut_rank, quantiles
from tradeloom.operators.ranking import global_rank


def shuffled(spark, values, kind="double", parts=7, seed=0):
    rows = [(i, v) for i, v in enumerate(values)]
    np.random.default_rng(seed).shuffle(rows)
    return spark.createDataFrame([(int(i), v) for i, v in rows], f"id bigint, v {kind}").repartition(parts)


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 53, 1203])
def test_interpolated_points_match_numpy(spark, n):
    values = np.random.default_rng(n).normal(size=n).round(2)
    found = quantiles(shuffled(spark, values.tolist()), fifths(), interpolated={"q": "v"}).first().q
    assert found == pytest.approx(np.quantile(values, [0, 0.2, 0.4, 0.6, 0.8, 1]).tolist(), abs=1e-12)


def test_large_column_beyond_the_sketch(spark):
    """With a coarse sketch the brackets are real ranges and the second pass decides."""
    df = spark.range(0, 200_000, 1, 13).select((F.xxhash64("id") % 100_000_007).cast("double").alias("v"))
    values = np.array([r.v for r in df.collect()])
    found = quantiles(df, fifths(), interpolated={"q": "v"}, accuracy=200).first().q
    assert found == pytest.approx(np.quantile(values, [0, 0.2, 0.4, 0.6, 0.8, 1]).tolist(), rel=1e-15)


def test_values_spread_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr("tradeloom.operators.quantiles.ROWS_PER_RANGE", 50)
    df = spark.range(0, 20_000, 1, 5).select((F.xxhash64("id") % 9973).cast("double").alias("v"), (F.col("id") % 3).alias("g"))
    rows = df.collect()
    found = {r.g: r.q for r in quantiles(df, fifths(), interpolated={"q": "v"}, by=["g"], accuracy=100).collect()}
    for g in range(3):
        expected = np.quantile([r.v for r in rows if r.g == g], [0, 0.2, 0.4, 0.6, 0.8, 1])
        assert found[g] == pytest.approx(expected.tolist(), rel=1e-15)


def test_one_value_holds_most_rows(spark):
    values = [5.0] * 700 + np.arange(300.0).tolist()
    df = shuffled(spark, values)
    found = quantiles(df, [(1, 2), (9, 10)], interpolated={"q": "v"}, accuracy=100).first().q
    assert found == pytest.approx(np.quantile(values, [0.5, 0.9]).tolist())


def test_groups_nulls_and_several_columns(spark):
    rows = [("a", 1.0, 4), ("a", 2.0, None), ("a", None, 6), ("b", 7.0, 1), (None, 3.0, 3)]
    df = spark.createDataFrame(rows, "g string, x double, y int")
    found = quantiles(df, [(1, 2)], interpolated={"x": "x", "y": "y"}, by=["g"])
    assert {r.g: (r.x, r.y) for r in found.where("g is not null").collect()} == {"a": ([1.5], [5.0]), "b": ([7.0], [1.0])}


def test_empty_input_gives_null(spark):
    empty = spark.createDataFrame([], "v double")
    assert quantiles(empty, [(1, 2)], interpolated={"q": "v"}).first().q is None


@pytest.mark.parametrize("n", [12, 13, 14, 52, 98])
def test_qcut_matches_pandas(spark, n):
    values = np.random.default_rng(n).integers(0, 10_000, n).astype(float)
    expected = pd.qcut(pd.Series(values), 5, labels=[1, 2, 3, 4, 5]).astype(int).tolist()
    df = shuffled(spark, values.tolist())
    assert [r.s for r in qcut(df, "v", "s").orderBy("id").collect()] == expected
    assert [6 - r.s for r in qcut(df, "v", "s", descending=True).orderBy("id").collect()] == expected


def test_repeated_edges_raise_or_merge(spark):
    df = shuffled(spark, [1.0] * 8 + [2.0, 3.0])
    with pytest.raises(Exception, match="unique"):
        qcut(df, "v", "s").collect()
    merged = [r.s for r in qcut(df, "v", "s", duplicates="drop").orderBy("id").collect()]
    codes = pd.qcut(pd.Series([1.0] * 8 + [2.0, 3.0]), 5, labels=False, duplicates="drop")
    assert merged == (codes + 1).tolist()


@pytest.mark.parametrize("n", [5, 7, 8, 9, 102, 503, 1204])
def test_rank_then_cut_matches_pandas(spark, n):
    counts = np.random.default_rng(n).poisson(2, n)
    expected = pd.qcut(pd.Series(counts).rank(method="first"), 5, labels=[1, 2, 3, 4, 5]).astype(int).tolist()
    df = shuffled(spark, [int(c) for c in counts], "bigint")
    assert [r.s for r in qcut_rank(df, "v", "id", "s").orderBy("id").collect()] == expected


def test_rank_cut_with_wide_tie_keys(spark):
    ids = [-(2**62), -5, 0, 3, 2**40, 2**62, 2**62 + 1]
    df = spark.createDataFrame([(i, 1) for i in ids], "id bigint, v bigint")
    expected = pd.qcut(pd.Series(range(7)), 5, labels=[1, 2, 3, 4, 5]).astype(int).tolist()
    assert [r.s for r in qcut_rank(df, "v", "id", "s").orderBy("id").collect()] == expected


@pytest.mark.parametrize("parts", [1, 17])
def test_global_rank_with_a_hot_value(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        values = [3] * 400 + list(range(200)) + [None] * 5
        df = shuffled(spark, values, "bigint")
        found = {r.id: r.rank for r in global_rank(df, "v", ["id"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    expected = pd.Series(values, dtype="float").rank(method="first")
    assert [found[i] for i in range(600)] == expected[:600].astype(int).tolist()
    assert [found[i] for i in range(600, 605)] == [None] * 5


def test_median_fill_uses_all_rows(spark):
    df = spark.createDataFrame([(1.0,), (None,), (4.0,), (10.0,), (3.0,)], "x double")
    assert sorted(r.x for r in fill_median(df, ["x"]).collect()) == [1.0, 3.0, 3.5, 4.0, 10.0]
