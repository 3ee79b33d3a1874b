"""Secret scan: fixed patterns plus a battery of randomness tests (built-in functions only).

Patterns find assignments, access keys and long hex runs.  Besides, every other run of letters, digits and ``+ / _ -`` with
at least ``MIN_RUN`` characters, one letter and one digit is a candidate, also where it reaches beyond a pattern's span.  Its encoding is inferred from the characters it uses
(hex, base 32, 36, 62 or 64), and its evidence is the log likelihood ratio of uniform draws from that alphabet against ordinary
text, a chain in which the class of character (lower, upper, digit, sign) before decides on the next symbol.  The chain starts
from fixed values (classes change with chance ``ORDINARY_CHANGE``) and is fitted on all candidates, each by its chance to be
ordinary, so that secrets do not teach it.  Under the chain the ratio has mean 1, so its inverse, times the number of alphabets,
is a p-value.  Three tests ask whether the symbols could be uniform draws at all: chi-squared of the counts, runs above and below
the middle, and serial correlation of neighbours; the p-value is divided by theirs, so what looks uneven needs more evidence.
Per band of lengths the Benjamini-Hochberg rule over all candidates of all documents sets the p-value that counts, so
short runs, of which there are many, need more evidence.

Positions are code points; starts are sums of the lengths of what stands before a match.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeloom.llm.rows import boxed, unboxed
from tradeloom.materialize import materialize

# fixed values: the patterns of the result's contract
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run of 20 or more characters: shorter runs fail as a whole
HEX = r"[0-9a-f]{24,}"
MIN_VALUE = 6
KINDS = ("assign", "access", "hex", "random")

MIN_RUN = 20
CANDIDATE = rf"[A-Za-z0-9+/_-]{{{MIN_RUN},}}={{0,2}}"
ALPHABETS = (  # the first that holds all characters is the encoding
    ("0123456789abcdef", 16), ("0123456789ABCDEF", 16), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 32),
    ("0123456789abcdefghijklmnopqrstuvwxyz", 36), ("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", 36),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 62),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 64),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", 64),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_", 66),
)
SYMBOLS = ALPHABETS[-1][0]
CLASSES = [0 if c.isupper() else 1 if c.islower() else 2 if c.isdigit() else 3 for c in SYMBOLS]
ORDINARY_CHANGE = 0.15
FIRST = (0.25, 0.5, 0.2, 0.05)  # chances of the class of the first symbol
LETTERS = (90, 16, 32, 42, 140, 15, 18, 32, 75, 4, 8, 45, 27, 75, 60, 25, 6, 66, 68, 72, 45, 13, 12, 3, 9, 6)  # a to z, of European texts
PRIOR_SYMBOLS = 500  # what the fixed values of a class count for when the chain is fitted
LEAST_P = 1e-300
FALSE_DISCOVERIES = 0.01
BANDS = (24, 32, 48, 96)  # upper ends of the length bands; the last is open
STEP, STEPS = 0.25, 800  # of the histogram of -ln p

_SPAN = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"
_RUN = "array<struct<start:bigint,kind:int,end:bigint,value:string,band:int>>"


def _spans(text: Column, pattern: str, kind: int, group: int = 0, at_least: int = 0) -> Column:
    """All leftmost matches in order as structs; those whose ``group`` is shorter than ``at_least`` are dropped."""
    none = F.array().cast(_SPAN)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), value.alias("value"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("found"))

    def step(state, part):
        begin = state["at"] + F.length(part["gap"])
        end = begin + F.length(part["whole"])
        span = F.struct(begin.cast("bigint").alias("start"), F.lit(kind).alias("kind"), end.cast("bigint").alias("end"),
                        part["value"].alias("value"))
        return F.struct(
            F.coalesce(end, begin).cast("bigint").alias("at"),
            F.when(F.length(part["value"]) >= at_least, F.concat(state["found"], F.array(span)))
            .otherwise(state["found"]).cast(_SPAN).alias("found"),
        )

    return F.when(F.rlike(text, F.lit(pattern)), F.aggregate(parts, start, step, lambda s: s["found"])).otherwise(none)


def _normal_tail(z: Column) -> Column:
    """P(Z > z), by the logistic approximation (error below 0.0002)."""
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used, also inside functions of elements."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _neighbours(values: Column) -> Column:
    return F.arrays_zip(F.slice(values, F.lit(1), F.size(values) - 1).alias("a"), F.slice(values, F.lit(2), F.size(values) - 1).alias("b"))


def ordinary(counts: dict[tuple[int, int], float] | None = None) -> list[float]:
    """Log chances of each symbol after each class, and last of a first symbol, row by row.

    ``counts`` of (row, symbol) are added to the fixed values.
    """
    counts, chances = counts or {}, []
    for row in range(5):
        fixed = []
        for i, (symbol, kind) in enumerate(zip(SYMBOLS, CLASSES)):
            by_kind = FIRST[kind] if row == 4 else 1 - ORDINARY_CHANGE if row == kind else ORDINARY_CHANGE / 3
            alike = LETTERS[ord(symbol.lower()) - 97] / sum(LETTERS) if kind < 2 else 1 / CLASSES.count(kind)
            fixed.append(by_kind * alike)
        total = sum(counts.get((row, i), 0.0) for i in range(len(SYMBOLS)))
        chances += [math.log((PRIOR_SYMBOLS * p + counts.get((row, i), 0.0)) / (PRIOR_SYMBOLS + total)) for i, p in enumerate(fixed)]
    return chances


def _places(symbols: Column) -> Column:
    return F.transform(symbols, lambda c: F.instr(F.lit(SYMBOLS), c) - 1)


def _rows(places: Column) -> Column:
    """The row of the chain and the symbol for each symbol of a candidate."""
    kinds = F.array(*[F.lit(k) for k in CLASSES])
    return F.transform(places, lambda at, i: F.struct(
        F.when(i == 0, 4).otherwise(F.get(kinds, F.get(places, F.greatest(i - 1, F.lit(0))))).alias("row"), at.alias("symbol")))


def _evidence(token: Column, model: list[float]) -> Column:
    """-ln of the p-value against ordinary text, the tests of randomness included; in time proportional to the length."""
    chances = F.array(*[F.lit(float(x)) for x in model])

    def encoded(body):
        alphabet = F.lit(None).cast("string")
        for symbols, _ in reversed(ALPHABETS):
            alphabet = F.when(F.length(F.translate(body, symbols, "")) == 0, F.lit(symbols)).otherwise(alphabet)
        return F.struct(body.alias("body"), alphabet.alias("alphabet"), _characters(body).alias("symbols"))

    def valued(x):
        values = F.transform(x["symbols"], lambda c: F.instr(x["alphabet"], c) - 1)
        counts = F.transform(F.array_distinct(x["symbols"]), lambda c: (F.length(x["body"]) - F.length(F.replace(x["body"], c, F.lit("")))).cast("double"))
        return F.struct(
            F.length(x["alphabet"]).cast("double").alias("k"), F.length(x["body"]).cast("double").alias("n"),
            F.aggregate(counts, F.lit(0.0), lambda s, c: s + c * c).alias("squares"), values.alias("values"),
            _places(x["symbols"]).alias("places"),
        )

    def judged(x):
        k, n = x["k"], x["n"]
        spread = 2 / (9 * (k - 1))
        chi = F.greatest(x["squares"] * k / n - n, F.lit(0.0))
        p_chi = _normal_tail((F.pow(chi / (k - 1), F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread))
        changes = F.aggregate(_neighbours(x["values"]), F.lit(0.0), lambda s, p: s + ((p["a"] * 2 >= k) != (p["b"] * 2 >= k)).cast("double"))
        p_runs = 2 * _normal_tail(F.abs(changes - (n - 1) / 2) / (F.sqrt(n - 1) / 2))
        serial = F.aggregate(_neighbours(x["values"]), F.lit(0.0), lambda s, p: s + (p["a"] - (k - 1) / 2) * (p["b"] - (k - 1) / 2))
        p_serial = 2 * _normal_tail(F.abs(serial * 12 / (k * k - 1)) / F.sqrt(n - 1))
        p_uniform = F.greatest(F.least(3 * F.least(p_chi, p_runs, p_serial), F.lit(1.0)), F.lit(LEAST_P))
        likely = F.aggregate(_rows(x["places"]), F.lit(0.0), lambda s, r: s + F.get(chances, r["row"] * len(SYMBOLS) + r["symbol"]))
        return -n * F.log(k) - likely - math.log(len(ALPHABETS)) + F.log(p_uniform)

    return _let(F.regexp_replace(token, "=+$", ""), lambda b: _let(encoded(b), lambda x: _let(valued(x), judged)))


def _band(length: Column) -> Column:
    band = F.lit(len(BANDS))
    for i, end in reversed(list(enumerate(BANDS))):
        band = F.when(length < end, F.lit(i)).otherwise(band)
    return band


def _scanned(docs: DataFrame, text: str) -> DataFrame:
    """Add ``_base`` (spans of the patterns) and ``_found`` (candidates not inside one of those, with their bands)."""
    rows = boxed(docs, "spans").withColumn("_text", F.coalesce(F.col("_row")[text], F.lit("")))
    base = F.concat(_spans(F.col("_text"), ASSIGN, 0, 2, MIN_VALUE), _spans(F.col("_text"), ACCESS, 1), _spans(F.col("_text"), HEX, 2))
    mixed = lambda s: F.rlike(s["value"], F.lit("[0-9]")) & F.rlike(s["value"], F.lit("[A-Za-z]"))

    none = F.array().cast(_RUN)

    def banded(x):
        # one pass over both by start: a candidate is known already if a pattern's span from there or before reaches its end
        both = F.array_sort(F.concat(
            F.transform(x["base"], lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("run"), s["end"].alias("end"), F.lit("").alias("value"))),
            F.transform(x["runs"], lambda s: F.struct(s["start"].alias("start"), F.lit(1).alias("run"), s["end"].alias("end"), s["value"].alias("value"))),
        ))
        start = F.struct(F.lit(0).cast("bigint").alias("reach"), none.alias("found"))

        def step(state, s):
            span = F.struct(s["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), s["end"].alias("end"),
                            s["value"].alias("value"), _band(s["end"] - s["start"]).alias("band"))
            return F.struct(
                F.when(s["run"] == 0, F.greatest(state["reach"], s["end"])).otherwise(state["reach"]).cast("bigint").alias("reach"),
                F.when((s["run"] == 1) & (s["end"] > state["reach"]), F.concat(state["found"], F.array(span)))
                .otherwise(state["found"]).cast(_RUN).alias("found"),
            )

        return F.struct(x["base"].alias("base"), F.aggregate(both, start, step, lambda s: s["found"]).alias("found"))

    # both arrays are bound before the function of each candidate uses them: as columns they would be found anew for each
    runs = F.filter(_spans(F.col("_text"), CANDIDATE, 3), mixed)
    rows = rows.withColumn("_scan", _let(F.struct(base.alias("base"), runs.alias("runs")), banded))
    return rows.select("_row", F.col("_scan.base").alias("_base"), F.col("_scan.found").alias("_found"))


def fit(docs: DataFrame, text: str = "text") -> tuple[list[float], list[float]]:
    """The chain of ordinary text, and the evidence that a candidate needs in each length band, over all candidates.

    Only counts of a fixed number of cells reach the driver.
    """
    found = materialize(_scanned(docs.select(F.col(text).alias("text")), "text").select(F.explode("_found").alias("c")).select("c.band", "c.value"))
    first = found.withColumn("ordinary", 1 / (1 + F.exp(F.least(_evidence(F.col("value"), ordinary()), F.lit(500.0)))))
    body = F.regexp_replace("value", "=+$", "")
    cells = first.select("ordinary", F.explode(_let(_places(_characters(body)), _rows)).alias("r")).groupBy("r.row", "r.symbol").agg(
        F.sum("ordinary").alias("n")).collect()
    model = ordinary({(x["row"], x["symbol"]): x["n"] for x in cells})
    step = F.floor(F.greatest(F.least(_evidence(F.col("value"), model), F.lit(STEP * STEPS)), F.lit(0.0)) / STEP)
    cells = found.groupBy("band", step.alias("step")).count().collect()
    needed = []
    for band in range(len(BANDS) + 1):
        by_step = {x["step"]: x["count"] for x in cells if x["band"] == band}
        total, n, cut = sum(by_step.values()), 0, math.inf
        for step in range(STEPS, -1, -1):
            n += by_step.get(step, 0)
            if n and math.exp(-step * STEP) * total <= FALSE_DISCOVERIES * n:
                cut = step * STEP
        needed.append(cut)
    return model, needed


def find(docs: DataFrame, fitted: tuple[list[float], list[float]], text: str = "text") -> DataFrame:
    """Add ``spans``: all spans as ``array<struct<start, kind, end>>``, by start, then kind (index into ``KINDS``).

    Null texts have no span.  A column of that name is replaced.
    """
    model, needed = fitted
    limits = F.array(*[F.lit(float(x)) for x in needed])
    added = F.filter("_found", lambda c: F.floor(F.least(_evidence(c["value"], model), F.lit(STEP * STEPS)) / STEP) * STEP >= F.get(limits, c["band"]))
    places = lambda a: F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return unboxed(_scanned(docs, text).withColumn("spans", F.array_sort(F.concat(places("_base"), places(added)))), "spans")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """:func:`fit` over all rows, then :func:`find`; an empty table has no candidates and stays empty."""
    return find(docs, fit(docs, text), text)


def span_text(spans: Column) -> Column:
    """``kind:start:end`` joined by commas; empty without spans."""
    name = lambda k: F.get(F.array(*[F.lit(x) for x in KINDS]), k)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Replace every span by ``mark``; overlapping spans become one mark.  Takes the ``spans`` column away."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(state, span):
        piece = F.substring(F.col(text), (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int"))
        return F.when(span["start"] >= state["at"], F.struct(
            span["end"].alias("at"), F.concat(state["parts"], F.array(piece, F.lit(mark))).alias("parts")
        )).otherwise(F.struct(F.greatest(state["at"], span["end"]).alias("at"), state["parts"].alias("parts")))

    done = F.aggregate("spans", start, step, lambda s: F.concat(
        F.array_join(s["parts"], ""), F.substring(F.col(text), (s["at"] + 1).cast("int"), F.length(text))
    ))
    return docs.withColumn(text, F.when(F.size("spans") > 0, done).otherwise(F.col(text))).drop("spans")
