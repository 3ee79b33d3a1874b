"""Any page of a sorted table, without sorting it again.

:func:`build_pages` sorts once: rows are dealt into ranges of the whole order, ties included, each range is sorted and stored
in a folder of its own, and every row stores its place in its range.  A page by number then reads the places it covers in one or
two ranges, and a page after a given row finds that row's range from the ranges' last rows.
"""

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeloom import config
from tradeloom.marts.explorer import display_columns
from tradeloom.materialize import new_path
from tradeloom.operators.ranking import _ROW_BITS, sort_nulls_last


@dataclass(frozen=True)
class SortedPages:
    """A sorted store; ``counts`` has the rows of each range, ``last`` the keys of each range's last row."""

    stored: DataFrame
    order: tuple[tuple[str, bool], ...]
    counts: tuple[tuple[int, int], ...]
    last: tuple[tuple, ...]
    columns: tuple[str, ...]

    @property
    def rows(self) -> int:
        return sum(n for _, n in self.counts)

    def page(self, number: int, rows: int = config.PAGE_ROWS) -> DataFrame:
        """Page ``number`` (from 1); beyond the end there are no rows."""
        if number < 1:
            raise ValueError("pages count from 1")
        return self._slice((number - 1) * rows, rows)

    def _slice(self, start: int, rows: int) -> DataFrame:
        wanted, before = F.lit(False), 0
        for part, n in self.counts:
            low, high = max(start - before, 0), min(start + rows - before, n)
            if low < high:
                wanted = wanted | ((F.col("_range") == part) & F.col("_place").between(low, high - 1))
            before += n
        return self.stored.where(wanted).orderBy("_range", "_place").select(*self.columns)

    def after(self, row: Mapping[str, object], rows: int = config.PAGE_ROWS) -> DataFrame:
        """The rows that follow one with these values in the sort and tie columns, which need not exist."""
        missing = [c for c, _ in self.order if c not in row]
        if missing:
            raise ValueError(f"the cursor lacks {missing}")
        key = [row[c] for c, _ in self.order]
        # every range whose last row does not come after the cursor is passed over
        first = next((i for i, last in enumerate(self.last) if _comes_after(last, key, self.order)), len(self.last))
        chosen, held = [], 0
        for part, n in self.counts[first:]:
            chosen.append(part)
            held += n if len(chosen) > 1 else 0  # of the first range perhaps only its last row follows
            if held >= rows:
                break
        follows = self.stored.where(F.col("_range").isin(chosen) & _after(key, self.order, self.stored))
        return follows.orderBy("_range", "_place").limit(rows).select(*self.columns)


def _comes_after(left, right, order) -> bool:
    """Whether one key comes after another: nulls last in both directions."""
    for a, b, (_, ascending) in zip(left, right, order):
        if a is None or b is None:
            if (a is None) != (b is None):
                return a is None
        elif a != b:
            return (a > b) == ascending
    return False


def _after(key, order, df: DataFrame) -> Column:
    cases, same = [], F.lit(True)
    for value, (name, ascending) in zip(key, order):
        column, given = F.col(f"`{name}`"), F.lit(value).cast(df.schema[name].dataType)
        if value is not None:
            cases.append(same & ((column > given if ascending else column < given) | column.isNull()))
        same = same & column.eqNullSafe(given)
    return reduce(or_, cases, F.lit(False))


def build_pages(base: DataFrame, sort: str, ascending: bool = True, tie: Sequence[str] = (), ranges: int | None = None) -> SortedPages:
    """Sort the display form of ``base`` once and store it; ``tie`` must make the order unique for stable pages.

    Spark chooses the number of ranges by their size unless ``ranges`` is given.
    Lives as long as other stored results: until ``release`` or the end of a ``released`` block.
    """
    shown = display_columns(base)
    keys = ((sort, ascending), *((c, True) for c in tie))
    order = [sort_nulls_last(f"`{c}`", up) for c, up in keys]
    spark, path = base.sparkSession, new_path(base.sparkSession)
    # the range of a row and its place there are told from the id of the stage that writes
    dealt = shown.repartitionByRange(ranges, *order) if ranges else shown.repartitionByRange(*order)
    placed = dealt.sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = placed.withColumns({
        "_range": F.shiftright("_id", _ROW_BITS).cast("int"), "_place": F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)),
    }).drop("_id")
    placed.write.partitionBy("_range").parquet(path)
    stored = spark.read.schema(placed.schema).parquet(path)
    ends = stored.groupBy("_range").agg(F.count("*").alias("n"), F.max_by(F.struct(*(f"`{c}`" for c, _ in keys)), "_place").alias("last"))
    found = sorted(ends.collect(), key=lambda r: r["_range"])  # a row per range
    return SortedPages(
        stored, keys, tuple((r["_range"], r["n"]) for r in found), tuple(tuple(r["last"]) for r in found), tuple(shown.columns),
    )
