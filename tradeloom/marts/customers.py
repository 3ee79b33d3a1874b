"""Customer metrics, recency-frequency-monetary scores and cohorts."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradeloom import config
from tradeloom.functions.dates import as_of_date, days_between, month_end
from tradeloom.functions.numbers import floor_bin, mean, percent_of, segment, total
from tradeloom.functions.text import gender_bucket
from tradeloom.materialize import input_bytes, materialize
from tradeloom.operators.quantiles import (
    SKETCH_ACCURACY, fifths, quantiles, scalar_struct, score_by_edges, score_by_position, with_first_rank_order,
)

FIVE_NUMBERS = {"min": (0, 1), "q1": (1, 4), "median": (1, 2), "q3": (3, 4), "max": (1, 1)}


_HALF = 10**5  # unscaled amounts are squared in two halves
BYTES_PER_TASK = 4 << 20  # of input files, a few hundred thousand sales rows; decides the memory of a task, not the result

#: What a roll-up groups by: coarser groups are made from it without the sales rows.
ROLLUP_KEYS = ("CID", "sls_ord_num", "CAT", "CNTRY", "GEN", "customer_age")


def customer_rollup(base: DataFrame, order: Sequence[str] = ("order_date",)) -> DataFrame:
    """One pass over the sales rows: mergeable measures per customer, order, category and attributes.

    Counts, sums, bounds and the first place in ``order`` merge as they are.  The spread of the revenue merges
    through moments: for decimals the exact sum of the squares of the unscaled numbers, for doubles the squared distances
    from each group's own mean.  Rows without customer are left out.

    Almost every row is a group of its own, so the tables of groups are as large as what a task reads.  The rows
    are therefore dealt, lines of an order together, over a task per :data:`BYTES_PER_TASK` of the files that ``base`` reads.
    """
    base = base.where(F.col("CID").isNotNull())
    tasks = -(-input_bytes(base) // BYTES_PER_TASK)
    if tasks:
        base = base.repartition(tasks, "CID", "sls_ord_num")
    place = F.min(order[0]) if len(order) == 1 else F.min(F.struct(*order))
    revenue, scale = F.col("Revenue"), _scale(base)
    if scale is None:
        value = revenue.cast("double")
        spread = (F.var_pop(value) * F.count(value)).alias("m2")
    else:
        # squares in two halves of the unscaled number, as plain whole numbers; a sum that does not fit stops the job
        units = (revenue.cast(f"decimal(18,{scale})") * F.lit(10**scale).cast(f"decimal({scale + 1},0)")).cast("long")
        low = F.pmod(units, F.lit(_HALF))
        high = F.try_divide(units - low, F.lit(_HALF)).cast("long")
        parts = F.sum(high * high), F.sum(high * low), F.sum(low * low)
        wide = [p.cast("decimal(38,0)") for p in parts]
        spread = (wide[0] * F.lit(_HALF**2) + wide[1] * F.lit(2 * _HALF) + wide[2]).cast("decimal(38,0)").alias("s2")
    return base.groupBy(*ROLLUP_KEYS).agg(
        F.min("order_date").alias("first_order"), F.max("order_date").alias("last_order"),
        F.count("order_date").alias("orders"), F.sum("Revenue").alias("revenue"), F.sum("Profit").alias("profit"),
        F.count("Revenue").alias("n"), place.alias("place"), spread,
    )


def _scale(base: DataFrame) -> int | None:
    """Decimal places of the revenue; none for other types."""
    kind = base.schema["Revenue"].dataType
    return kind.scale if isinstance(kind, T.DecimalType) else None


def _spread(scale: int | None) -> Column:
    """Sample standard deviation from merged moments; null below two values."""
    n = F.sum("n").cast("double")
    if scale is None:
        deviations = F.sum("m2")
    else:
        # n * s2 - s1 * s1 loses nothing in decimals; only where these products pass 38 digits are they taken in doubles
        s1 = (F.sum("revenue").cast(f"decimal(38,{scale})") * F.lit(10**scale).cast(f"decimal({scale + 1},0)")).cast("decimal(38,0)")
        product = lambda a, b: F.try_multiply(a, b).cast("decimal(38,0)")
        exact = F.try_subtract(product(F.sum("n").cast("decimal(19,0)"), F.sum("s2").cast("decimal(38,0)")), product(s1, s1))
        rough = n * F.sum("s2").cast("double") - s1.cast("double") * s1.cast("double")
        deviations = F.try_divide(F.coalesce(exact.cast("double"), F.greatest(rough, F.lit(0.0))), n * F.lit(float(10 ** (2 * scale))))
    return F.when(F.sum("n") > 1, F.sqrt(deviations / (n - 1)))


def customer_metrics(base: DataFrame, as_of=None, order: Sequence[str] = ("order_date",)) -> DataFrame:
    """One row per customer, from one pass over ``base`` that stores a roll-up.

    Country, gender and age are the first non-null values in ``order``; between rows in the same
    place the smallest value counts.  ``total_orders`` counts rows, ``unique_orders`` order numbers.
    """
    return metrics_of_rollup(materialize(customer_rollup(base, order)), as_of, _scale(base))


def metrics_of_rollup(rollup: DataFrame, as_of=None, scale: int | None = 2) -> DataFrame:
    """Customer metrics from a stored :func:`customer_rollup`.

    A hot customer's groups are spread: they meet per order, per category and per combination of
    attributes before anything is summed per customer.  The three results are partitioned by customer.
    """
    sums = ("n", "m2" if scale is None else "s2", "orders", "revenue", "profit")
    if scale is None:  # distances from each group's own mean become distances from the customer's
        means = rollup.groupBy("CID").agg(F.try_divide(F.sum("revenue"), F.sum("n").cast("double")).alias("_mean"))
        off = F.try_divide(F.col("revenue"), F.col("n").cast("double")) - F.col("_mean")
        rollup = rollup.join(means, "CID").withColumn("m2", F.col("m2") + F.col("n") * off * off).drop("_mean")
    per_order = rollup.groupBy("CID", "sls_ord_num").agg(
        F.min("first_order").alias("first_order"), F.max("last_order").alias("last_order"),
        *(F.sum(c).alias(c) for c in sums),
    )
    measured = per_order.groupBy("CID").agg(
        F.min("first_order").alias("first_order"),
        F.max("last_order").alias("last_order"),
        F.sum("orders").alias("total_orders"),
        total(F.col("revenue")).alias("total_revenue"),
        F.try_divide(F.sum("revenue").cast("double"), F.sum("n").cast("double")).alias("avg_order_value"),
        _spread(scale).alias("revenue_std"),
        total(F.col("profit")).alias("total_profit"),
        F.count("sls_ord_num").alias("unique_orders"),
    )
    bought = rollup.select("CID", "CAT").distinct().groupBy("CID").agg(F.count("CAT").alias("categories_bought"))
    attributes = _first_values(rollup, {"CNTRY": "country", "GEN": "gender", "customer_age": "age"}, ["place"])
    lifespan = days_between(F.col("last_order"), F.col("first_order"))
    return measured.join(bought, "CID").join(attributes, "CID").select(
        "*",
        lifespan.alias("customer_lifespan_days"),
        days_between(as_of_date(as_of), F.col("last_order")).alias("recency_days"),
        (F.col("total_orders") / (lifespan + 1)).alias("purchase_frequency"),
        percent_of(F.col("total_profit"), F.col("total_revenue")).alias("profit_margin"),
    )


def _first_values(base: DataFrame, names: Mapping[str, str], order: Sequence[str]) -> DataFrame:
    """First non-null value per customer and column.

    A customer has few combinations of attributes: their earliest places are found by hash
    aggregation, and only these are compared text by text.
    """
    place = F.min(order[0]) if len(order) == 1 else F.min(F.struct(*order))
    combinations = base.groupBy("CID", *names).agg(place.alias("_place"))
    return combinations.groupBy("CID").agg(*(
        F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("_place", c))).alias(name) for c, name in names.items()
    ))


def rfm_scores(metrics: DataFrame, bins: int = config.SCORE_BINS, duplicates: str = "raise",
               accuracy: int = SKETCH_ACCURACY) -> DataFrame:
    """Add recency, frequency and monetary scores 1..bins.

    ``metrics`` is read for its cut points and again for the scores: store or persist it first.
    Recency and revenue are cut at interpolated quantiles, order counts at ranks with ties by ``CID``.
    """
    ordered = with_first_rank_order(metrics, "total_orders", "CID", "_order")
    cuts = quantiles(
        ordered,
        fifths(bins),
        interpolated={"recency": "recency_days", "monetary": "total_revenue"},
        positional={"frequency": "_order"},
        accuracy=accuracy,
    )
    return ordered.withColumn("_cuts", scalar_struct(cuts)).withColumns({
        "recency_score": score_by_edges("recency_days", "_cuts.recency", bins, True, duplicates),
        "frequency_score": score_by_position("_order", "_cuts.frequency", bins),
        "monetary_score": score_by_edges("total_revenue", "_cuts.monetary", bins, False, duplicates),
    }).drop("_cuts", "_order")


def build_segments(base: DataFrame, as_of=None, order: Sequence[str] = ("order_date",), duplicates: str = "raise",
                   accuracy: int = SKETCH_ACCURACY) -> DataFrame:
    """Customer metrics, stored once, with scores and segments."""
    return rfm_segments(materialize(customer_metrics(base, as_of, order)), duplicates, accuracy)


def rfm_segments(metrics: DataFrame, duplicates: str = "raise", accuracy: int = SKETCH_ACCURACY) -> DataFrame:
    """Scores plus their mean, the segment and the gender bucket."""
    points = F.col("recency_score") + F.col("frequency_score") + F.col("monetary_score")
    return rfm_scores(metrics, duplicates=duplicates, accuracy=accuracy).withColumns({
        "rfm_score": points / F.lit(3),
        "segment": segment(points),
        "gender": gender_bucket(F.col("gender")),
    })


def customer_kpis(segments: DataFrame) -> DataFrame:
    """One row: champions and at-risk customers, mean lifespan, repeat customers and rate."""
    def revenue_of(name: str) -> Column:
        return total(F.when(F.col("segment") == name, F.col("total_revenue")))

    def count_of(name: str) -> Column:
        return F.count_if(F.col("segment") == name)

    repeat = F.count_if(F.col("total_orders") > 1)
    lifespan = mean(F.col("customer_lifespan_days"))
    return segments.agg(
        count_of("Champions").alias("champions"),
        revenue_of("Champions").alias("champions_revenue"),
        count_of(config.LOWEST_SEGMENT).alias("at_risk"),
        revenue_of(config.LOWEST_SEGMENT).alias("at_risk_revenue"),
        lifespan.alias("avg_lifespan_days"),
        (lifespan / F.lit(config.DAYS_PER_MONTH)).alias("avg_lifespan_months"),
        repeat.alias("repeat_customers"),
        percent_of(repeat, F.count("*")).alias("repeat_rate"),
    )


def segment_stats(segments: DataFrame, digits: int | None = 2) -> DataFrame:
    """Means and totals per segment, rounded half-even."""
    stats = segments.groupBy("segment").agg(
        F.count("CID").alias("customer_count"),
        mean(F.col("total_revenue")).alias("avg_revenue"),
        total(F.col("total_revenue")).alias("total_segment_revenue"),
        mean(F.col("avg_order_value")).alias("avg_order_value"),
        mean(F.col("total_orders")).alias("avg_orders"),
        mean(F.col("recency_days")).alias("avg_recency"),
        mean(F.col("profit_margin")).alias("avg_margin"),
    )
    if digits is None:
        return stats
    return stats.withColumns({c: F.bround(c, digits) for c in stats.columns if c not in ("segment", "customer_count")})


def five_numbers(df: DataFrame, group: str, value: str, accuracy: int = SKETCH_ACCURACY) -> DataFrame:
    """Exact minimum, quartiles and maximum of a column per group; null groups dropped."""
    found = quantiles(df.where(F.col(group).isNotNull()), list(FIVE_NUMBERS.values()),
                      interpolated={"points": value}, by=[group], accuracy=accuracy)
    return found.select(group, *(F.col("points")[i].alias(name) for i, name in enumerate(FIVE_NUMBERS)))


def segment_distribution(segments: DataFrame, accuracy: int = SKETCH_ACCURACY) -> DataFrame:
    """Spread of customer revenue per segment."""
    return five_numbers(segments, "segment", "total_revenue", accuracy)


def age_by_gender(base: DataFrame, accuracy: int = SKETCH_ACCURACY) -> DataFrame:
    """Spread of customer age over the sales rows per gender value."""
    return five_numbers(base, "GEN", "customer_age", accuracy)


def age_gender_revenue(segments: DataFrame, width: int = config.AGE_BIN_YEARS) -> DataFrame:
    """Revenue per age bin for male and female customers."""
    known = segments.where(F.col("gender").isin("Male", "Female") & F.col("age").isNotNull())
    return known.groupBy(floor_bin(F.col("age"), width).alias("age_bin"), "gender").agg(
        total(F.col("total_revenue")).alias("total_revenue")
    )


def _active_months(base: DataFrame) -> DataFrame:
    """Each customer's months with an order, once."""
    return base.where(F.col("CID").isNotNull() & F.col("order_date").isNotNull()).select(
        "CID", month_end(F.col("order_date")).alias("order_date")
    ).distinct()


def monthly_active(base: DataFrame) -> DataFrame:
    """Distinct customers per month."""
    return _active_months(base).groupBy(F.col("order_date").alias("month")).agg(F.count("CID").alias("active_customers"))


def new_vs_returning(base: DataFrame) -> DataFrame:
    """Distinct customers per month, new (month of the first order) or returning.

    The type depends on customer and month alone, so the window runs over a customer's months, not
    over its orders.
    """
    months = _active_months(base)
    first = F.min("order_date").over(Window.partitionBy("CID"))
    kind = F.when(F.col("order_date") == F.col("_first"), "New").otherwise("Returning")
    return months.withColumn("_first", first).groupBy("order_date", kind.alias("customer_type")).agg(
        F.count("CID").alias("customers")
    )
