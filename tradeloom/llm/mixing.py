"""Mix sources to target weights by Pareto order sampling (built-in functions only).

A source's target is its share of the mix, limited to ``max_copies`` times its size; what a limit frees goes to the others by
weight.  Target over size is the number of copies of every document: the whole part is certain, the rest is the chance
``p`` of one more copy, shifted by a document's weight.  A document draws ``u`` from its id and ranks by the ratio of odds
``u / (1 - u)`` to ``p / (1 - p)``; the lowest ranks are taken until the words missing to the target are reached.  The
document at the edge is left out if it would pass the target; a further round offers the gap to smaller documents.

A source is never sorted as a whole: histograms of the ranks find the edge digit by digit, and only the last, small bucket is
ordered.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeloom.llm.rows import boxed, unboxed
from tradeloom.materialize import materialize
from tradeloom.operators.ranking import global_rank

SIZE_PATTERN = r"[^\x20\x09-\x0D]+"
RANK_BITS, DIGIT_BITS = 50, 10
EDGE_ROWS = 5_000  # a bucket with no more rows is ordered by one window
ROUNDS = 4
ALMOST_ONE = 1.0 - 2.0**-20


def words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(SIZE_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, max_copies: float) -> DataFrame:
    """Add ``target`` to one row per source (``source``, ``source_size``): limited shares of ``share`` of all words.

    Weights repeat along the sources in code point order, null last.  A source's limit over its weight says when it is
    reached as all shares rise together, so one pass in that order finds who is limited.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights)).cast("int"))
    rows = sizes.withColumn("weight", weight)
    rows = rows.withColumn("limit", F.lit(float(max_copies)) * F.col("source_size"))
    order = [F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({
        "_rest": F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)),
        "_open": F.sum("weight").over(onward),
    }).withColumn("_level", F.col("_rest") / F.col("_open"))
    # the first source that its limit does not bind sets the level of all from there on
    free = F.min(F.when(F.col("_level") * F.col("weight") <= F.col("limit"), F.struct(*_order_key(), "_level"))).over(whole)
    bound = free.isNull() | (F.struct(*_order_key()) < F.struct(free["k1"], free["k2"], free["k3"]))
    level = free["_level"]
    return rows.withColumn("target", F.when(bound, F.col("limit")).otherwise(level * F.col("weight"))).drop(
        "_rest", "_open", "_level", "limit", "weight"
    )


def _order_key() -> list[Column]:
    return [(F.col("limit") / F.col("weight")).alias("k1"), F.col("source").isNull().alias("k2"),
            F.coalesce("source", F.lit("")).alias("k3")]


def log_weight(size: Column) -> Column:
    """Whole-number weight of a document that grows with the logarithm of its size: its number of decimal digits."""
    return F.length(size.cast("string")).cast("long")


def _draw(doc_id: Column, text: Column, seed: int) -> Column:
    """Reproducible number in (0, 1); documents without id draw by their text."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.coalesce(text, F.lit(""))))
    return _uniform(F.concat(key, F.lit(f":{seed}")))


def _uniform(key: Column) -> Column:
    bits = F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(float(2**48))


def _apart(sized: DataFrame, repeated: DataFrame) -> DataFrame:
    """Give rows that draw alike draws of their own, from the first draw and the row's number among them.

    The numbers come from a ranking by range, so a group that holds a third of all rows is spread over tasks.  Which of the
    rows gets which number does not matter, as they agree in all that the mix looks at; they are stored so that a row
    keeps its number.
    """
    stored = materialize(sized.withColumn("_n", F.monotonically_increasing_id()))
    alike = F.xxhash64(F.col("_source").isNull(), "_source", "size", "_u")
    groups = repeated.select(alike.alias("_alike"))
    rows = stored.select("_n", "_u", alike.alias("_alike")).join(groups, "_alike", "left_semi")
    ranked = materialize(global_rank(rows, "_alike", ["_n"], "_at"))
    firsts = ranked.groupBy("_alike").agg(F.min("_at").alias("_first"))
    number = F.col("_at") - F.col("_first")
    own = F.when(number == 0, F.col("_u")).otherwise(_uniform(F.concat_ws(":", F.col("_u").cast("string"), number)))
    draws = materialize(ranked.join(firsts, "_alike").select("_n", own.alias("_own")))
    return stored.join(draws, "_n", "left").withColumn("_u", F.coalesce("_own", "_u")).drop("_n", "_own")


def _edges(rows: DataFrame, gaps: DataFrame) -> DataFrame:
    """Per source the largest rank such that all rows up to it fill no more than ``gap``: ``(key, gap, edge, got)``."""
    active = rows.join(gaps.where("gap > 0"), "key").where("size <= gap and size > 0")
    state, shift = None, RANK_BITS
    while state is None or (shift > 0 and not state.where(f"crossing and n > {EDGE_ROWS}").isEmpty()):
        shift -= DIGIT_BITS
        if state is not None:
            active = rows.join(state.where("crossing").select("key", "gap", "prefix", "below"), "key").where(
                f"size <= gap and size > 0 and shiftright(rank, {shift + DIGIT_BITS}) = prefix"
            )
        else:
            active = active.withColumns({"below": F.lit(0).cast("long")})
        digits = active.groupBy("key", "gap", "below", F.shiftright("rank", shift).alias("bucket")).agg(
            F.sum("size").alias("words"), F.count("*").alias("n")
        )
        up_to = F.col("below") + F.sum("words").over(Window.partitionBy("key").orderBy("bucket"))
        digits = digits.withColumn("up_to", up_to).withColumn("crossing", F.col("up_to") > F.col("gap"))
        found = digits.groupBy("key", "gap").agg(
            F.min(F.when(F.col("crossing"), F.struct("bucket", (F.col("up_to") - F.col("words")).alias("below"), "n"))).alias("c"),
            F.max("up_to").alias("all"),
        ).select(
            "key", "gap", F.col("c").isNotNull().alias("crossing"), F.col("c.bucket").alias("prefix"),
            F.coalesce("c.below", "all").alias("below"), F.coalesce("c.n", F.lit(0)).alias("n"),
        )
        if state is not None:
            found = found.unionByName(state.where("not crossing"))
        state = materialize(found)
    last = rows.join(state.where("crossing"), "key").where(
        f"size <= gap and size > 0 and shiftright(rank, {shift}) = prefix"
    )
    cumulative = F.col("below") + F.sum("size").over(Window.partitionBy("key").orderBy("rank"))
    inside = last.withColumn("up_to", cumulative).where("up_to <= gap").groupBy("key").agg(
        F.max("rank").alias("rank"), F.max("up_to").alias("up_to")
    )
    edge = F.when(~F.col("crossing"), F.lit(2**RANK_BITS)).otherwise(
        F.coalesce("rank", F.shiftleft("prefix", shift) - 1)
    )
    return state.join(inside, "key", "left").select(
        "key", "gap", edge.alias("edge"), F.coalesce("up_to", "below").alias("got")
    )


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_copies: float = 2.0,
    doc_weight=log_weight, seed: int = 0, doc_id: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """Add ``size``, ``source_size``, ``target`` and ``copies`` (long, how often the mix takes the row) to every row.

    ``doc_weight`` maps the size column to a positive whole number; the chance of the extra copy is proportional to it
    (``None``: equal chances).  A null source is a source of its own; null and empty texts have size 0 and take part only
    with certain copies.  Rows that agree in id, source and size are numbered and draw one by one; with them the rows are stored
    once.  An empty table stays empty.  Columns of the added names are replaced.
    """
    added = ("size", "source_size", "target", "copies")
    of = lambda c: F.col("_row")[c]
    sized = boxed(docs, *added).withColumns({
        "size": words(of(text)), "_u": _draw(of(doc_id), of(text), seed), "_source": of(source),
    }).withColumn("_w", doc_weight(F.col("size")) if doc_weight else F.lit(1).cast("long"))
    table = materialize(sized.select("_source", "size", "_u", "_w"))
    repeated = materialize(table.groupBy("_source", "size", "_u").count().where("count > 1 and size > 0").drop("count"))
    if not repeated.isEmpty():
        sized = _apart(sized, repeated)
        table = materialize(sized.select("_source", "size", "_u", "_w"))
    totals = table.groupBy(F.col("_source").alias("source")).agg(
        F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("_w")).alias("weighted")
    )
    plan = targets(totals, weights, share, max_copies)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = materialize(plan.withColumn("whole", F.floor(ratio)).withColumn("part", ratio - F.col("whole")).withColumn(
        "key", F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce("source", F.lit("")))
    ))
    rows = materialize(_ranked(table, plan).where("part > 0").select("key", "size", "rank"))
    gaps = plan.select("key", F.floor(F.col("target") - F.col("whole") * F.col("source_size")).alias("gap"))
    found = []
    for _ in range(ROUNDS):
        edges = materialize(_edges(rows, gaps))
        found.append(edges.select("key", F.struct("gap", "edge").alias("limit")))
        gaps = edges.select("key", (F.col("gap") - F.col("got")).alias("gap"))
        done = edges.select(F.col("key"), F.col("gap").alias("limit"), "edge")
        rows = materialize(
            rows.join(done, "key").where("not (size <= limit and rank <= edge)").select("key", "size", "rank")
        )
    limits = found[0]
    for more in found[1:]:
        limits = limits.unionByName(more)
    limits = limits.groupBy("key").agg(F.collect_list("limit").alias("limits"))
    decided = _ranked(sized, materialize(plan.join(limits, "key", "left")))
    extra = F.exists(F.coalesce("limits", F.array().cast("array<struct<gap:bigint,edge:bigint>>")),
                     lambda x: (F.col("size") <= x["gap"]) & (F.col("rank") <= x["edge"]) & (F.col("size") > 0))
    return unboxed(decided.withColumn("copies", F.col("whole") + extra.cast("long")), *added)


def _ranked(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Join the plan of the row's source and add ``rank``: the Pareto ratio mapped to whole numbers below 2^RANK_BITS."""
    rows = rows.withColumn(
        "key", F.concat(F.when(F.col("_source").isNull(), "n").otherwise("s"), F.coalesce("_source", F.lit("")))
    )
    rows = rows.join(plan.drop("source"), "key")
    p = F.col("part") * F.col("_w") * F.col("source_size") / F.col("weighted")
    p = F.least(F.greatest(p, F.lit(2.0**-40)), F.lit(ALMOST_ONE))
    odds = (F.col("_u") * (1 - p)) / ((1 - F.col("_u")) * p)
    rank = F.floor(odds / (1 + odds) * F.lit(float(2**RANK_BITS)))
    return rows.withColumn("rank", F.when(F.col("weighted") > 0, rank).otherwise(F.lit(0)))
