"""URL filter by the ratio of two character language models (built-in functions only).

URLs that a rule decides are the training data: allowed ones train the model of accepted URLs, blocked ones the model
of rejected URLs.  Each model is a variable-order Markov chain over a small alphabet: the chance of the next symbol is
interpolated from contexts of three symbols down to none by Witten-Bell weights, so a long context counts as far as
it was seen.  A URL scores the mean over its symbols of ln P(accepted) - ln P(rejected); the cut between allow and block
is calibrated on labelled URLs that the models did not see.

The model has one row per possible gram, 31^4 of them whatever the input, so it is broadcast; sums of a URL's symbols
are formed in the task that read it.
"""

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeloom.llm.rows import boxed, unboxed
from tradeloom.materialize import materialize

ORDER = 3
SYMBOLS = 31  # other, 26 letters, digit, '/', '.', '-'
HELD_OUT = 5  # one labelled URL in so many calibrates the cut
BINS, BIN_WIDTH = 800, 0.01  # of the calibration histogram, around 0
_EDGE = 28  # stands before the first symbol


def _symbol_table() -> Column:
    code = {c: i + 1 for i, c in enumerate(string.ascii_lowercase)}
    code |= {c.upper(): i for c, i in code.items()} | dict.fromkeys(string.digits, 27) | {"/": 28, ".": 29, "-": 30}
    return F.array(*[F.lit(code.get(chr(i), 0)) for i in range(128)])


def host_of(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """Text between the host and ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[str]) -> Column:
    """The longest of ``rules`` (host, then path) that fits the host or a parent domain and starts the path; else null."""
    fits = []
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        domain, slash, rest = rule.partition("/")
        on_host = (host == domain) | F.endswith(host, F.lit("." + domain))
        fits.append(F.when(on_host & F.startswith(path, F.lit(slash + rest)), F.lit(rule)))
    return F.coalesce(*fits, F.lit(None).cast("string"))


def with_grams(urls: DataFrame, url: str, out: str = "_grams") -> DataFrame:
    """Add the codes of all grams of ``ORDER + 1`` symbols, one for each character."""
    characters = F.filter(F.split(F.coalesce(F.col(url), F.lit("")), ""), lambda c: c != "")
    coded = urls.withColumn(
        "_codes", F.transform(characters, lambda c: F.coalesce(F.get(_symbol_table(), F.ascii(c)), F.lit(0)))
    )

    # the codes beside themselves, shifted: the time stays in proportion to the length
    edge = lambda n: F.array_repeat(F.lit(_EDGE), n)
    shifted = [F.concat(edge(back), "_codes").alias(f"c{back}") for back in range(ORDER, -1, -1)]
    beside = F.slice(F.arrays_zip(*shifted), F.lit(1), F.size("_codes"))

    def gram(c):
        total = F.lit(0)
        for back in range(ORDER, -1, -1):
            total = total * SYMBOLS + c[f"c{back}"]
        return total

    return coded.withColumn(out, F.transform(beside, gram)).drop("_codes")


def fit(labelled: DataFrame) -> DataFrame:
    """Model ``(g, delta)``: ln P(accepted) - ln P(rejected) of every possible gram.

    ``labelled`` has ``_grams`` and boolean ``_allow``.
    """
    spark = labelled.sparkSession
    counts = materialize(
        labelled.select(F.explode("_grams").alias("g"), "_allow").groupBy("g")
        .agg(F.count_if("_allow").alias("a"), F.count_if(~F.col("_allow")).alias("r"))
    )
    lower = None
    for order in range(ORDER + 1):
        grams = counts.groupBy((F.col("g") % SYMBOLS ** (order + 1)).cast("long").alias("id")).agg(
            F.sum("a").alias("a"), F.sum("r").alias("r")
        )
        contexts = grams.groupBy(F.floor(F.col("id") / SYMBOLS).alias("context")).agg(
            *[f(c).alias(n + c) for c in "ar" for f, n in ((F.sum, "n_"), (lambda x: F.count_if(F.col(x) > 0), "t_"))]
        )
        grid = spark.range(SYMBOLS ** (order + 1)).withColumn("context", F.floor(F.col("id") / SYMBOLS))
        grid = grid.join(grams, "id", "left").join(contexts, "context", "left")
        if lower is None:
            grid = grid.withColumns({"q_a": F.lit(1.0 / SYMBOLS), "q_r": F.lit(1.0 / SYMBOLS)})
        else:
            grid = grid.withColumn("suffix", F.col("id") % SYMBOLS**order).join(
                lower.select(F.col("id").alias("suffix"), F.col("p_a").alias("q_a"), F.col("p_r").alias("q_r")), "suffix"
            )
        grid = grid.select("id", *[
            F.when(F.coalesce(f"n_{c}", F.lit(0)) == 0, F.col(f"q_{c}"))
            .otherwise((F.coalesce(c, F.lit(0)) + F.col(f"t_{c}") * F.col(f"q_{c}")) / (F.col(f"n_{c}") + F.col(f"t_{c}")))
            .alias(f"p_{c}")
            for c in "ar"
        ])
        lower = materialize(grid) if order == ORDER - 1 else grid
    return materialize(lower.select(F.col("id").alias("g"), (F.log("p_a") - F.log("p_r")).cast("float").alias("delta")))


def mean_ratio(urls: DataFrame, url: str, model: DataFrame) -> DataFrame:
    """Length-normalised log-likelihood difference of each distinct URL with characters: ``(url, _score)``."""
    grams = with_grams(urls.select(url), url).select(url, F.explode("_grams").alias("g"))
    return grams.join(F.broadcast(model), "g").groupBy(url).agg(F.avg("delta").alias("_score"))


def calibrate(scored: DataFrame) -> float:
    """Cut with the fewest errors in both classes' shares; the one nearest to 0 of equals, 0 if a class has no rows.

    ``scored`` has ``_score`` and ``_allow``; only a histogram of fixed size reaches the driver.
    """
    half = BINS // 2
    place = F.least(F.greatest(F.floor(F.col("_score") / BIN_WIDTH), F.lit(-half)), F.lit(half))
    histogram = scored.groupBy(place.alias("bin")).agg(
        F.count_if("_allow").alias("a"), F.count_if(~F.col("_allow")).alias("r")
    ).collect()
    accepted, rejected = sum(x["a"] for x in histogram), sum(x["r"] for x in histogram)
    if not accepted or not rejected:
        return 0.0
    by_bin = {x["bin"]: (x["a"] / accepted, x["r"] / rejected) for x in histogram}
    lost, passed, best = 0.0, 1.0, None
    for b in range(-half, half + 2):  # everything below bin b is blocked
        if best is None or (round(lost + passed, 9), abs(b)) < best[:2]:
            best = (round(lost + passed, 9), abs(b), b)
        a, r = by_bin.get(b, (0.0, 0.0))
        lost, passed = lost + a, passed - r
    return best[2] * BIN_WIDTH


def judge(urls: DataFrame, allow: list[str], block: list[str], url: str = "url") -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``score`` and ``verdict`` ('allow' or 'block') to every row.

    A fitting rule decides; otherwise the calibrated score does.  Null URLs and those without ``://`` have empty host
    and path; a URL without characters scores 0.  Without labelled URLs of both kinds the cut is 0; without any the
    models agree, all scores are 0 and all URLs pass.  Columns of the same names in the input are replaced.
    """
    added = ("host", "path", "rule", "score", "verdict")
    rows = boxed(urls, *added).withColumn("_url", F.col("_row")[url])
    rows = rows.withColumns({"host": host_of(F.col("_url")), "path": path_of(F.col("_url"))})
    rows = rows.withColumn("rule", matching_rule(F.col("host"), F.col("path"), [*allow, *block]))
    rows = rows.withColumn("_allow", F.when(F.col("rule").isNotNull(), F.col("rule").isin(list(allow))))
    labelled = rows.where(F.col("rule").isNotNull()).select(
        "_url", "_allow", F.coalesce(F.crc32("_url") % HELD_OUT == 0, F.lit(False)).alias("_fold")
    )
    model = fit(with_grams(labelled.where(~F.col("_fold")), "_url"))
    held_out = labelled.where("_fold")
    cut = calibrate(held_out.join(mean_ratio(held_out.distinct(), "_url", model), "_url"))
    scores = mean_ratio(rows.select("_url").distinct(), "_url", model)
    scored = rows.join(scores, "_url", "left").withColumn("score", F.coalesce("_score", F.lit(0.0)))
    by_score = F.when(F.col("score") >= cut, F.lit("allow")).otherwise(F.lit("block"))
    by_rule = F.when(F.col("_allow"), F.lit("allow")).otherwise(F.lit("block"))
    verdict = F.when(F.col("rule").isNotNull(), by_rule).otherwise(by_score)
    return unboxed(scored.withColumn("verdict", verdict), *added)
