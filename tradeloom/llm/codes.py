"""Vector code compression: product codes whose nearest entries come from a lexicographic trie.

A vector is scaled to whole numbers and cut into equal consecutive parts; each position has a codebook of a few entries, learned
in rounds of assignment and averaging.  Equal parts are counted once.  The distinct parts of a position, in
lexicographic order, are the leaves of a trie over their components.  A depth-first walk keeps, for each prefix, the squared
distances of all entries summed so far, so parts that share a prefix share that work; small subtrees are finished level by level
with all their nodes at once.  At a leaf the smallest distance names the entry, and the leaf counts as often as its part occurs.

On Spark the distinct parts are dealt by range, so each task holds a stretch of the trie and what leaves a task
are the counts and sums of its entries, a table of fixed size.  All arithmetic is on whole numbers, so results are exact.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradeloom.materialize import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LARGEST = 2**27  # of a scaled component, so that sums of squares stay whole numbers of 64 bits
SUBTREE = 4096  # leaves below which a subtree is walked level by level


def _branches(rows: np.ndarray, low: int, high: int, depth: int) -> list[tuple[int, int, bool]]:
    """Children of a node as stretches of sorted rows: large ones alone, small neighbours together up to ``SUBTREE`` rows."""
    edges = [low, *(np.flatnonzero(np.diff(rows[low:high, depth])) + low + 1).tolist(), high]
    out = []
    for first, last in zip(edges, edges[1:]):
        if last - first > SUBTREE:
            out.append((first, last, True))
        elif out and not out[-1][2] and last - out[-1][0] <= SUBTREE:
            out[-1] = (out[-1][0], last, False)
        else:
            out.append((first, last, False))
    return out


def _levels(rows: np.ndarray, entries: np.ndarray, depth: int, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Walk a small subtree level by level: a node's sums are those of its parent and one more component."""
    new, node_of, sums = np.zeros(len(rows), bool), np.zeros(len(rows), np.int64), shared[None, :]
    new[0] = True
    for level in range(depth, rows.shape[1]):
        column = rows[:, level]
        new[1:] |= column[1:] != column[:-1]
        heads = np.flatnonzero(new)
        sums = sums[node_of[heads]] + (column[heads, None] - entries[:, level]) ** 2
        node_of = np.cumsum(new) - 1
    best = sums.argmin(1)
    return best[node_of], sums[np.arange(len(best)), best][node_of]


def walk(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry (ties to the lower index) and squared distance of distinct rows in lexicographic order."""
    nearest, error = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
    stack = [(0, len(rows), 0, np.zeros(len(entries), np.int64))] if len(rows) else []
    while stack:
        low, high, depth, shared = stack.pop()
        if high - low <= SUBTREE or depth == rows.shape[1]:
            nearest[low:high], error[low:high] = _levels(rows[low:high], entries, depth, shared)
            continue
        for first, last, large in reversed(_branches(rows, low, high, depth)):  # so that the first comes off first
            step = (rows[first, depth] - entries[:, depth]) ** 2 if large else 0
            stack.append((first, last, depth + large, shared + step))
    return nearest, error


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows in lexicographic order, the place of each row among them, and how often each occurs."""
    order = np.lexsort(rows.T[::-1])
    ordered = rows[order]
    new = np.append(True, (ordered[1:] != ordered[:-1]).any(1))
    back = np.empty(len(rows), np.int64)
    back[order] = np.cumsum(new) - 1
    return ordered[new], back, np.diff(np.append(np.flatnonzero(new), len(rows)))


def _scaled(vector, scale: int):
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def _padded(column: pa.Array, parts: int) -> np.ndarray:
    """``(rows, parts, width)`` of a list column; zeros fill up the last part."""
    size = len(column.flatten()) // max(1, len(column))
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)
    width = -(-size // parts)
    out = np.zeros((len(column), parts * width), np.int64)
    out[:, :size] = values
    return out.reshape(len(column), parts, width)


def distinct_parts(rows: DataFrame, parts: int = PARTS) -> DataFrame:
    """``(position, part, n)`` in lexicographic order, counted per batch before rows are moved."""

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            cut = _padded(batch.column(0), parts)
            for position in range(parts):
                unique, _, counts = _distinct(cut[:, position])
                edges = np.arange(0, unique.size + 1, unique.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(unique), position, np.int32)),
                    pa.ListArray.from_arrays(edges, pa.array(unique.ravel().astype(np.int32))), pa.array(counts.astype(np.int64)),
                ], ["position", "part", "n"])

    counted = rows.select("values").mapInArrow(run, "position int, part array<int>, n long")
    # the aggregate finds its rows together, as they are dealt by the same columns
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, as the work is large for its bytes
    dealt = counted.repartitionByRange(tasks, "position", "part").groupBy("position", "part").agg(F.sum("n").alias("n"))
    return materialize(dealt.sortWithinPartitions("position", "part"))


def _stretches(batches):
    """``(position, sorted rows, counts)`` of a task's stretch of the trie, a batch at a time."""
    for batch in batches:
        positions, counts = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        edges = np.append(np.flatnonzero(np.diff(positions, prepend=-1)), len(positions))
        for low, high in zip(edges[:-1], edges[1:]):
            flat = batch.column(1).slice(low, high - low).flatten().to_numpy().astype(np.int64)
            yield int(positions[low]), flat.reshape(high - low, -1), counts[low:high]


def learn(distinct: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks ``(parts, entries, width)`` after some rounds; an entry that no part is nearest to stays."""
    books = books.copy()
    parts, entries, width = books.shape
    for _ in range(rounds):

        def run(batches, books=books):
            sums, counts = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
            for position, rows, n in _stretches(batches):
                nearest, _ = walk(rows, books[position])
                np.add.at(sums[position], nearest, rows * n[:, None])
                np.add.at(counts[position], nearest, n)
            position, entry = np.nonzero(counts)
            edges = np.arange(0, len(position) * width + 1, width, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array(position), pa.array(entry), pa.array(counts[position, entry]),
                pa.ListArray.from_arrays(edges, pa.array(sums[position, entry].ravel())),
            ], ["position", "entry", "n", "sums"])

        told = distinct.mapInArrow(run, "position long, entry long, n long, sums array<long>")
        told = told.select("position", "entry", "n", F.posexplode("sums").alias("at", "total"))
        # as many rows as the codebooks have components; collected at once, as an iterator starts a job per partition
        for r in told.groupBy("position", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
            books[r["position"], r["entry"], r["at"]] = r["total"] // r["n"]
    return books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _encoded(rows: DataFrame, books: np.ndarray, names: tuple[str, str]) -> DataFrame:
    parts = len(books)

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            cut = _padded(batch.column(1), parts)
            codes, errors = np.empty((len(cut), parts), np.uint8), np.zeros(len(cut), np.int64)
            for position in range(parts):
                unique, back, _ = _distinct(cut[:, position])
                nearest, error = walk(unique, books[position])
                codes[:, position] = nearest[back]
                errors += error[back]
            text = codes.tobytes().hex()
            listed = [text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(listed), pa.array(errors)], ["_row", *names])

    schema = T.StructType([rows.schema["_row"]]).add(names[0], "string").add(names[1], "long")
    return rows.mapInArrow(run, schema)


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
    id_col: str = "vec_id", vector: str = "embedding",
) -> tuple[DataFrame, np.ndarray]:
    """Rows with ``code`` (two hex digits a part) and ``error`` added, and the codebooks.

    Components become ``floor(scale * x)``.  Rows go whose vector is null, empty or holds null or non-finite components, and rows of
    another vector size than the row of smallest id (ties: the smallest array) has, as one codebook has one size.  A size that the
    parts do not divide is filled up with zeros.  The codebooks start as the vectors of the smallest ids, null ids
    last, ties by the scaled vector; with fewer rows than ``entries`` there are fewer entries.  Repeated rows count as often as they occur.
    No rows give none and empty codebooks.  Scaled components beyond ``LARGEST`` stop the job, as their squares
    would not fit.  Columns of the added names are replaced.
    """
    names = ("code", "error")
    finite = F.forall(F.col(f"`{vector}`"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    usable = vectors.where(F.coalesce(finite, F.lit(False)) & (F.size(F.col(f"`{vector}`")) > 0))
    kept = F.struct(*[F.col(f"`{c}`") for c in vectors.columns if c not in names])
    rows = usable.select(kept.alias("_row"), F.col(f"`{id_col}`").alias("_id"), _scaled(F.col(f"`{vector}`"), scale).alias("values"))
    fits = F.forall("values", lambda x: F.abs(x) <= LARGEST)
    rows = rows.withColumn("values", F.when(fits, F.col("values")).otherwise(F.raise_error(F.lit(f"a scaled component is beyond {LARGEST}"))))
    order = (F.col("_id").asc_nulls_last(), F.col("values"))
    first = rows.orderBy(*order).select(F.size("values")).first()
    size = first[0] if first else 0
    rows = rows.where(F.size("values") == size)
    initial = [r[0] for r in rows.orderBy(*order).limit(entries).select("values").collect()]
    start = np.array(initial, np.int64).reshape(len(initial), size)
    width = -(-size // parts)
    books = np.zeros((len(start), parts * width), np.int64)
    books[:, :size] = start
    books = books.reshape(len(start), parts, width).transpose(1, 0, 2)
    if len(start):
        books = learn(distinct_parts(rows, parts), books, rounds)
    return _encoded(rows.select("_row", "values"), books, names).select("_row.*", *names), books


def with_group_error(coded: DataFrame, group: str, name: str) -> DataFrame:
    """Add the sum of ``error`` over all rows of the same ``group``, nulls together; one row per group is joined."""
    kept = coded.drop(name)
    totals = kept.groupBy(F.col(f"`{group}`").alias("_group")).agg(F.sum("error").alias(name))
    return kept.join(totals, F.col(f"`{group}`").eqNullSafe(F.col("_group")), "left").drop("_group")
