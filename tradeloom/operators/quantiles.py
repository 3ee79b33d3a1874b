"""Exact quantiles and quantile scores for columns of any size.

``percentile`` buffers every distinct value of a group in one task.  Here a sketch first
brackets each wanted position; a second pass counts rows per distinct value inside the
brackets and only per gap outside them.  These counts are dealt into ranges of values of a fixed
size, summed range by range and shifted by the totals of the ranges before, so that no task orders a
share of the data.  The answer is exact: a position that a bracket should miss stops the job.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeloom import config
from tradeloom.materialize import materialize

Fraction = tuple[int, int]

SKETCH_ACCURACY = 10_000
ROWS_PER_RANGE = 100_000  # counted values that one task orders; decides the work per task, not the result
_MISSED = "a quantile fell outside its sketch bracket; raise the accuracy"


def quantiles(
    df: DataFrame,
    fractions: Sequence[Fraction],
    interpolated: Mapping[str, str] | None = None,
    positional: Mapping[str, str] | None = None,
    by: Sequence[str] = (),
    accuracy: int = SKETCH_ACCURACY,
) -> DataFrame:
    """One row (per group) with one array per requested name, one entry per fraction.

    ``interpolated`` and ``positional`` map names to SQL expressions.  Interpolated entries are doubles interpolated between the two neighbours of position
    ``(n-1)*num/den``; positional entries are the ``decimal(38,0)`` value at the floor of that
    position.  Nulls are skipped.
    """
    interpolated, positional = dict(interpolated or {}), dict(positional or {})
    by = list(by)
    fractions = sorted(fractions, key=lambda f: f[0] / f[1])
    entries = [f"named_struct('_name', '{n}', '_v', double({e}), '_x', cast(null as decimal(38,0)))" for n, e in interpolated.items()]
    entries += [f"named_struct('_name', '{n}', '_v', double({e}), '_x', cast({e} as decimal(38,0)))" for n, e in positional.items()]
    values = df.selectExpr(*by, f"inline(array({', '.join(entries)}))").where("_v is not null")

    keys = [*by, "_name"]
    brackets = _sketch_brackets(values, fractions, keys, accuracy)
    if by:
        # Stored, so that the planner picks the join from its size (one row per name and group).
        brackets = materialize(brackets)
        rows = brackets.agg(F.sum("_n")).first()[0] or 0
        located = values.join(brackets, keys)
    else:
        edges = brackets.collect()  # one row per requested name
        rows = sum(r["_n"] for r in edges)
        located = _with_brackets(values, edges)

    counted = _count_by_value(located, len(fractions), keys)
    ranges = _ranges(rows, len(fractions), accuracy)
    running = _running_total(_in_ranges(counted, keys, ranges), keys) if ranges > 1 else _short_total(counted, keys)
    picked = _pick(running, fractions, keys)

    wide = [F.expr(f"max(case when _name = '{name}' then _linear end) as {name}") for name in interpolated]
    wide += [F.expr(f"max(case when _name = '{name}' then _exact end) as {name}") for name in positional]
    return picked.groupBy(*by).agg(*wide)


def _sketch_brackets(values: DataFrame, fractions, keys, accuracy) -> DataFrame:
    """Rows per key and, per fraction, a value range that holds the wanted position."""
    slack = 3.0 / accuracy
    edges = [min(max(num / den + side * slack, 0.0), 1.0) for num, den in fractions for side in (-1, 1)]
    sketch = F.percentile_approx("_v", F.lit(edges), F.lit(accuracy))
    return values.groupBy(*keys).agg(F.count("_v").alias("_n"), sketch.alias("_b"))


def _with_brackets(values: DataFrame, edges) -> DataFrame:
    """Give each row the row count and brackets of its name, which are few, as constants."""
    found = F.lit(None).cast("struct<_n:bigint,_b:array<double>>")
    for r in edges:
        known = F.struct(F.lit(r["_n"]).cast("long").alias("_n"), F.array(*map(F.lit, r["_b"])).alias("_b"))
        found = F.when(F.col("_name") == r["_name"], known).otherwise(found)
    return values.withColumn("_k", found).select("*", "_k._n", "_k._b").drop("_k")


def _count_by_value(located: DataFrame, targets: int, keys) -> DataFrame:
    """Row counts per distinct value inside a bracket and per gap between brackets."""
    inside = " or ".join(f"_v between _b[{2 * t}] and _b[{2 * t + 1}]" for t in range(targets))
    passed = " + ".join(f"int(_v > _b[{2 * t + 1}])" for t in range(targets))
    located = located.selectExpr(
        *keys, "_n", "_v", "_x", f"case when not ({inside}) then {passed} end as _gap"
    )
    return located.groupBy(
        *keys, "_n", "_gap", F.expr("case when _gap is null then _v end"), F.expr("case when _gap is null then _x end")
    ).agg(
        F.count("*").alias("_rows"),
        F.min("_v").alias("_v_min"), F.max("_v").alias("_v_max"),
        F.min("_x").alias("_x_min"), F.max("_x").alias("_x_max"),
    )


def _ranges(rows: int, targets: int, accuracy: int) -> int:
    """How many ranges hold at most about ``ROWS_PER_RANGE`` values each, from the share of rows inside brackets."""
    share = min(1.0, targets * 8 / accuracy)  # twice the slack of an edge, plus the sketch's own error
    return int(rows * share) // ROWS_PER_RANGE + 1


def _in_ranges(counted: DataFrame, keys, ranges: int) -> DataFrame:
    """The counted values with the number of their range; stored, as two passes must see the same ranges."""
    return materialize(counted.repartitionByRange(ranges, *keys, "_v_min", "_x_min").withColumn("_range", F.spark_partition_id()))


def _short_total(counted: DataFrame, keys) -> DataFrame:
    """Add ``_end`` to counted values that fit one range: nothing is stored and no totals of ranges are needed."""
    so_far = Window.partitionBy(*keys).orderBy("_v_min", "_x_min").rowsBetween(Window.unboundedPreceding, 0)
    return counted.withColumn("_end", F.sum("_rows").over(so_far))


def _running_total(ranged: DataFrame, keys) -> DataFrame:
    """Add ``_end``, the rows of a key up to and including this value.

    A range is small whatever the key, and the window over the ranges' totals sees one row per range and key.
    """
    inside = Window.partitionBy("_range", *keys).orderBy("_v_min", "_x_min").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range", *keys).agg(F.sum("_rows").alias("_total"))
    shifts = totals.select("_range", *keys, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_shift"))
    return (
        ranged.withColumn("_end", F.sum("_rows").over(inside))
        .join(shifts, ["_range", *keys])
        .withColumn("_end", F.col("_end") + F.col("_shift")).drop("_range", "_shift")
    )


def _pick(located: DataFrame, fractions, keys) -> DataFrame:
    """Values at the wanted positions as one interpolated and one positional array per key."""
    points = [f"(_n - 1) * {num / den!r}D" for num, den in fractions]
    picks = []
    for i, ((num, den), point) in enumerate(zip(fractions, points)):
        picks += [
            F.expr(f"{_value_at(f'floor({point})', '_v')} as _lo{i}"),
            F.expr(f"{_value_at(f'ceil({point})', '_v')} as _hi{i}"),
            F.expr(f"{_value_at(f'(_n - 1) * {num} div {den}', '_x')} as _ex{i}"),
        ]
    linear = ", ".join(f"_lo{i} + (_hi{i} - _lo{i}) * ({p} - floor({p}))" for i, p in enumerate(points))
    exact = ", ".join(f"_ex{i}" for i in range(len(fractions)))
    return located.groupBy(*keys, "_n").agg(*picks).selectExpr(
        *keys, f"array({linear}) as _linear", f"array({exact}) as _exact"
    )


def _value_at(position: str, value: str) -> str:
    """The value of the row that holds a position; later rows only offer larger values."""
    return f"""min(case when _end > {position} then
        case when _end - _rows >= {position} or _gap is null then {value}_min
             when _end - 1 = {position} then {value}_max
             else raise_error('{_MISSED}') end end)"""


def scalar_struct(one_row: DataFrame) -> Column:
    """A one-row frame as a struct that other rows can read; no join is involved."""
    return one_row.select(F.struct(*one_row.columns).alias("s")).scalar()


def fifths(bins: int = config.SCORE_BINS) -> list[Fraction]:
    """All edges of an equal-frequency cut, outer edges included."""
    return [(k, bins) for k in range(bins + 1)]


def score_by_edges(value: str, edges: str, bins: int = config.SCORE_BINS,
                   descending: bool = False, duplicates: str = "raise") -> Column:
    """Bin number 1..bins of right-closed quantile bins; equal values share a bin.

    ``edges`` holds all ``bins + 1`` edges.  ``duplicates='raise'`` stops on repeated edges,
    ``'drop'`` merges the empty bins.
    """
    if duplicates == "raise":
        passed = " + ".join(f"int(double({value}) > {edges}[{k}])" for k in range(1, bins))
        repeated = f"size(array_distinct({edges})) < {bins + 1}"
        passed = f"case when {repeated} then int(raise_error('quantile edges must be unique')) else {passed} end"
    elif duplicates == "drop":
        inner = f"slice(array_distinct({edges}), 2, greatest(size(array_distinct({edges})) - 2, 0))"
        passed = f"size(filter({inner}, e -> double({value}) > e))"
    else:
        raise ValueError(f"duplicates must be 'raise' or 'drop', not {duplicates!r}")
    score = f"{bins} - ({passed})" if descending else f"1 + ({passed})"
    return F.expr(f"int(case when {value} is not null then {score} end)")


def score_by_position(value: str, cuts: str, bins: int = config.SCORE_BINS) -> Column:
    """Bin number of a unique value given the values at all ``bins + 1`` cut positions."""
    passed = " + ".join(f"int({value} > {cuts}[{k}])" for k in range(1, bins))
    return F.expr(f"int(case when {value} is not null then 1 + {passed} end)")


def qcut(df: DataFrame, column: str, out: str, bins: int = config.SCORE_BINS,
         descending: bool = False, duplicates: str = "raise", accuracy: int = SKETCH_ACCURACY) -> DataFrame:
    """Add the equal-frequency bin number of a numeric column."""
    cuts = quantiles(df, fifths(bins), interpolated={"edges": column}, accuracy=accuracy)
    score = score_by_edges(column, "_cuts.edges", bins, descending, duplicates)
    return df.withColumn("_cuts", scalar_struct(cuts)).withColumn(out, score).drop("_cuts")


def with_first_rank_order(df: DataFrame, column: str, tie: str, out: str) -> DataFrame:
    """Add one whole number that orders rows by ``column``, then by ``tie``; both integers, ``tie`` unique."""
    number = "decimal(20,0)"
    span = df.agg(
        F.expr(f"cast(min({tie}) as {number}) as low"),
        F.expr(f"cast(cast(max({tie}) as {number}) - cast(min({tie}) as {number}) + 1 as {number}) as width"),
    )
    order = f"cast(cast({column} as decimal(17,0)) * _span.width + (cast({tie} as {number}) - _span.low) as decimal(38,0))"
    return df.withColumn("_span", scalar_struct(span)).withColumn(out, F.expr(order)).drop("_span")


def qcut_rank(df: DataFrame, column: str, tie: str, out: str, bins: int = config.SCORE_BINS,
              accuracy: int = SKETCH_ACCURACY) -> DataFrame:
    """Add the equal-frequency bin number of the row's rank, ties broken by ``tie``.

    Only the rows at the cut positions are located; no row needs its own rank.
    """
    ordered = with_first_rank_order(df, column, tie, "_order")
    cuts = quantiles(ordered, fifths(bins), positional={"cuts": "_order"}, accuracy=accuracy)
    score = score_by_position("_order", "_cuts.cuts", bins)
    return ordered.withColumn("_cuts", scalar_struct(cuts)).withColumn(out, score).drop("_cuts", "_order")
