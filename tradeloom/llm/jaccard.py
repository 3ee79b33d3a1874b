"""Self-join of texts on the Jaccard similarity of word shingles, by partitioning the universe of shingles.

A document is the set of its distinct shingles.  Sizes fall into bands, and a family of segments belongs to each band: two sets
with similarity ``t`` of which the smaller is in the band differ in at most ``H`` shingles, so of ``H + 1`` segments, into
which a hash deals all shingles, at least one holds the same subset in both.  Every set is indexed under the subset of each
segment, in its own family and, near the lower edge of its band, in the one below.

A segment whose subset is empty or tiny matches many sets.  The first segments of a family therefore also index the subsets
with one shingle deleted: asking there with one deletion allowed counts twice in the pigeonhole, so a set may skip a segment.
Each set chooses what to skip by the cost it expects, the number of sets that share a subset of that size.

Equal sets are one class, named by a hash: however many copies there are in however many tasks, a class is found, sketched
and compared once.  Classes meet by sorting on subset and name over range partitions, which splits any subset that many share.  Sets that
share a subset are first compared by parity sketches: a bit per hash value, flipped by each shingle, so two sketches differ
in no more bits than the sets in shingles.  Pairs that may still link connect clusters.  In clusters whole sets are compared, as
bit sets, each set being sent once; a cluster that is too large for one comparison is dealt into overlapping ranges of
size, and a range that is still too large into blocks of which each two meet in a task of their own.  A task returns
what is connected and no pairs, however many there are.  The links that count are all found on the
whole sets.  Shingles are told apart by 64 bits.
"""

import functools
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeloom.llm.graph import components, smallest_reached
from tradeloom.materialize import materialize
from tradeloom.operators.ranking import global_rank

WORDS, PERCENT = 3, 90  # the contract of op10; the pipeline passes its own
BAND_RATIO = 1.5
SHARED = 0.05  # expected chance that another set of the band agrees in a shingle of a subset
BAND_SHARE = 0.05  # expected share of all sets in a band
SMALL_BUCKET = 8
BLOCK_ROWS = 2048  # of one side of a comparison of sketches
BLOCK_SHINGLES = 1 << 20  # of the sets that one side of a comparison holds
BLOCK_SETS = 4096  # that one side of a comparison holds
HELD_PAIRS = 1 << 20  # of which a comparison knows the common size at a time
COMMON = 20  # a shingle that more than one in so many sets of a comparison hold is compared by bit sets
LEVELS = 4
BIT_COLUMNS = 1 << 14
BITMAP_WORDS = 1 << 18
_SLICE = 1 << 22
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M2
    x = (x ^ (x >> np.uint64(29))) * _M3
    return x ^ (x >> np.uint64(32))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``words`` words; of the whole sequence if it has fewer.

    A-Z count as lower case; words end at ASCII space.  Empty without words.
    """
    data, parts, at = text.encode("utf-8", "surrogatepass").lower(), [], 0
    while at < len(data):  # a long text is never held as one list of words
        gap = _SPACE.search(data, at + _SLICE) if at + _SLICE < len(data) else None
        end = gap.start() if gap else len(data)
        found = data[at:end].split()
        parts.append(np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found)))
        at = end
    hashes = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    if not len(hashes):
        return hashes
    width = min(words, len(hashes))
    total = np.full(len(hashes) - width + 1, width, np.uint64)
    for i in range(width):
        total = _mix(total * _M1 + hashes[i : len(hashes) - width + 1 + i])
    return np.unique(total)


@functools.lru_cache(maxsize=None)
def bands(percent: int) -> tuple[list[int], list[int]]:
    """Lower and upper ends of the size bands, up to sets of 2^40 shingles."""
    low, high = [1], []
    while low[-1] < 2**40:
        high.append(max(low[-1] * 100 // percent, int(low[-1] * BAND_RATIO)))
        low.append(high[-1] + 1)
    return low, high


@functools.lru_cache(maxsize=512)
def _family(band: int, percent: int):
    """Number of segments, ends of their hash ranges and a number of each segment; no segment if only equal sets link."""
    low, high = bands(percent)
    largest = high[band] * 100 // percent
    most = (100 - percent) * (high[band] + largest) // (100 + percent)
    if not most:
        return 0, None, None, largest
    count = most + 1
    ends = np.array([-(-(i << 64) // count) for i in range(1, count)], np.uint64)
    return count, ends, _mix(np.arange(count, dtype=np.uint64) + np.uint64(band + 1 << 40)), largest


def _subsets(hashes, values, sums, band, percent):
    """Keys of all segments' subsets, their sizes, and for the first segments the keys with one shingle deleted."""
    count, ends, salt, _ = _family(band, percent)
    if not count:
        return np.empty(0, np.uint64), np.empty(0, np.int64), []
    cuts = np.concatenate([[0], np.searchsorted(hashes, ends), [len(hashes)]])
    subset = sums[cuts[1:]] - sums[cuts[:-1]]
    deleted = [_mix((subset[i] - values[cuts[i] : cuts[i + 1]]) ^ salt[i]) for i in range(min(count, 2 if count <= 8 else 1))]
    return _mix(subset ^ salt), np.diff(cuts), deleted


def _skipped(sizes: np.ndarray, deletable: int, others: float) -> tuple[list[int], list[int]]:
    """Segments to skip, and as many in which one deletion is allowed, as long as that lowers the expected cost."""
    alike = lambda n: others * SHARED ** np.maximum(n, 0)
    exact = alike(sizes)
    if exact.max(initial=0.0) <= 1.0:
        return [], []
    more = 1 + sizes[:deletable] + sizes[:deletable] * alike(sizes[:deletable] - 1)  # besides the exact ones
    skipped, widened = [], []
    for i in np.argsort(more):
        cost = exact.copy()
        cost[[int(i), *skipped, *widened]] = -1.0
        worst = int(cost.argmax())
        if int(i) in skipped or cost[worst] <= more[i]:
            continue
        skipped.append(worst)
        widened.append(int(i))
    return skipped, widened


def _sketch(hashes: np.ndarray) -> np.ndarray:
    """Parity of the number of hashes at each of ``2^k`` places, at least as many as hashes."""
    places = 1 << max(6, (len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.uint64)


def _folded(sketch: np.ndarray, words: int) -> np.ndarray:
    while len(sketch) > words:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def _may_link(sizes: np.ndarray, sketches: list[np.ndarray], percent: int):
    """Places of the pairs that the sketches cannot tell to differ too much, some at a time."""
    words = min(map(len, sketches))
    bits, left, right, held = np.stack([_folded(x, words) for x in sketches]), [], [], 0
    for i in range(len(bits) - 1):
        apart = np.bitwise_count(bits[i] ^ bits[i + 1 :]).sum(1, dtype=np.int64)
        both, small, large = sizes[i] + sizes[i + 1 :], np.minimum(sizes[i], sizes[i + 1 :]), np.maximum(sizes[i], sizes[i + 1 :])
        near = np.flatnonzero((apart * (100 + percent) <= (100 - percent) * both) & (100 * small >= percent * large)) + i + 1
        if len(near):
            left.append(np.full(len(near), i))
            right.append(near)
            held += len(near)
        if held >= HELD_PAIRS:
            yield np.concatenate(left), np.concatenate(right)
            left, right, held = [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right)


def signatures(text: str, words: int, percent: int, others: float):
    """``(size, check, check2, asked, listed, sketch)``: subset keys to ask with and those only to be found by."""
    hashes = shingles(text, words)
    if not len(hashes):
        return 0, 0, 0, hashes, hashes, hashes
    values = _mix(hashes * _M1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
    checks = int(sums[-1].view(np.int64)), int(np.bitwise_xor.reduce(_mix(values)).view(np.int64))
    return len(hashes), *checks, *_keys(hashes, values, sums, percent, others), _sketch(hashes)


def _keys(hashes, values, sums, percent, others):
    low, _ = bands(percent)
    band = int(np.searchsorted(low, len(hashes), side="right")) - 1
    keys, sizes, deleted = _subsets(hashes, values, sums, band, percent)
    skipped, widened = _skipped(sizes, len(deleted), others) if len(keys) else ([], [])
    asks = np.ones(len(keys), bool)
    asks[skipped] = False
    asked = [keys[asks], *(deleted[i] for i in widened)]
    listed = [keys[~asks], *(d for i, d in enumerate(deleted) if i not in widened)]
    if band and len(hashes) <= _family(band - 1, percent)[3]:
        keys, _, deleted = _subsets(hashes, values, sums, band - 1, percent)
        listed += [keys, *deleted]
    return np.concatenate(asked), np.concatenate(listed)


SIGNED = "n long, c1 long, c2 long, asked array<long>, listed array<long>, sketch array<long>"


def _signed(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Sizes, checks and keys.  A set that the task has met before repeats no keys."""
    others = max(1.0, docs.count() * BAND_SHARE)

    def lists(arrays):
        ends = np.cumsum([0, *map(len, arrays)])
        flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))

    def run(batches):
        met, none = set(), np.empty(0, np.uint64)
        for batch in batches:
            rows = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                row = signatures(value.as_py() or "", words, percent, others)
                if key is None or row[:3] in met:
                    row = (*row[:3], none, none, none)
                if key is not None:  # a row without id is no node, so it indexes nothing for others
                    met.add(row[:3])
                rows.append(row)
                if len(met) > 500_000:
                    met.clear()
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns, *(lists([r[i] for r in rows]) for i in (3, 4, 5))],
                ["id", "n", "c1", "c2", "asked", "listed", "sketch"],
            )

    return docs.mapInArrow(run, f"id long, {SIGNED}")


def _bucket_pairs(batches):
    """From rows sorted by key and id: pairs of small buckets and members of large ones; a repeated row counts once.

    The first and last bucket of a partition may go on elsewhere, so their members are kept too.
    """

    def out(kind, key, a, b):
        table = np.unique(np.stack([np.full(len(a), kind), key if kind else np.zeros(len(a), np.int64), a, b]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in table], ["kind", "key", "a", "b"])

    def settle(key, ids, asks, edge_first, edge_last):
        new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])]))
        key, ids, asks = key[new], ids[new], np.logical_or.reduceat(asks, new)
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(key)]]))
        large = np.repeat(sizes > SMALL_BUCKET, sizes)
        left, right = [], []
        for distance in range(1, min(SMALL_BUCKET, int(sizes.max()))):
            a = np.flatnonzero((key[:-distance] == key[distance:]) & ~large[:-distance])
            left.append(a)
            right.append(a + distance)
        a, b = (np.concatenate([np.empty(0, np.int64), *x]) for x in (left, right))
        good = (asks[a] | asks[b]) & (ids[a] != ids[b])
        if good.any():
            a, b = ids[a[good]], ids[b[good]]
            yield out(0, None, np.minimum(a, b), np.maximum(a, b))
        kept = large.copy()
        if edge_first:
            kept[: sizes[0]] = True
        if edge_last:
            kept[starts[-1] :] = True
        if kept.any():
            yield out(1, key[kept], ids[kept], asks[kept].astype(np.int64))

    held, begun = None, False
    for batch in batches:
        new = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)]
        if not len(new[0]):
            continue
        held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
        whole = int(np.searchsorted(held[0], held[0][-1]))
        if whole:
            yield from settle(*[x[:whole] for x in held], not begun, False)
            begun, held = True, [x[whole:] for x in held]
    if held is not None:
        yield from settle(*held, not begun, True)


def _maybe_among(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Drop most rows whose id is not ``wanted`` before they are shuffled, by a bitmap of fixed size (2 MB).

    The more ids are wanted the less it drops; the exact join that follows decides.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(BITMAP_WORDS * 64))
    bits = wanted.select(bit("id").alias("bit")).groupBy(F.shiftright("bit", 6).alias("id")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")
    )
    every = wanted.sparkSession.range(BITMAP_WORDS).join(bits, "id", "left")
    bitmap = materialize(every.agg(
        F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("all")
    ).select(F.transform("all", lambda x: x["bits"]).alias("bits"))).scalar()
    word = F.get(bitmap, F.shiftright(bit(column), 6).cast("int"))
    return rows.where(word.bitwiseAND(_power(bit(column))) != 0)


def _power(bit):
    """The bit's value in its word."""
    return F.get(F.array(*[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)]), F.pmod(bit, F.lit(64)).cast("int"))


def _clusters(met: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """``(id, cluster)``: sets connected by pairs that share a bucket and may link by their sketches.

    ``sketches`` has ``id``, ``n`` and ``sketch``.
    """
    end = lambda c: sketches.select(F.col("id").alias(c), F.col("n").alias("n_" + c), F.col("sketch").alias("s_" + c))
    pairs = materialize(met.where("kind = 0").select("a", "b").distinct()).join(end("a"), "a").join(end("b"), "b")

    def near(batches):
        for batch in batches:
            a, b, n_a, n_b = (batch.column(c).to_numpy() for c in ("a", "b", "n_a", "n_b"))
            one, two = batch.column("s_a"), batch.column("s_b")
            kept = [i for i in range(len(a)) if any(True for _ in _may_link(
                np.array([n_a[i], n_b[i]]), [np.asarray(x[i].values, np.int64).view(np.uint64) for x in (one, two)], percent))]
            yield pa.RecordBatch.from_arrays([pa.array(a[kept]), pa.array(b[kept])], ["a", "b"])

    close = pairs.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(near, "a long, b long")
    members = materialize(met.where("kind = 1").groupBy("key", F.col("a").alias("id")).agg((F.max("b") == 1).alias("asks")))
    large = materialize(members.groupBy("key").agg(F.max("asks").alias("any"), F.count("*").alias("total")).where("any and total > 1"))
    rows = members.select("key", "id").join(large.select("key", F.ceil(F.col("total") / BLOCK_ROWS).alias("blocks")), "key")
    rows = rows.select("key", "id", "blocks", F.pmod(F.xxhash64("id", "key"), F.col("blocks")).alias("block"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    group = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    side = F.when(F.col("block") == F.col("other"), 2).otherwise((F.col("block") < F.col("other")).cast("int"))
    rows = rows.select(group.alias("group"), "id", side.alias("side")).join(sketches, "id")
    dealt = rows.select("group", "id", "side", "n", F.col("sketch").alias("values")).repartition("group").sortWithinPartitions("group")
    alike = dealt.mapInArrow(_connected(lambda n, x: _may_link(n, x, percent)), "a long, b long")
    return materialize(components(materialize(close.unionByName(alike))).withColumnRenamed("component", "cluster"))


def _bit_sets(owner: np.ndarray, column: np.ndarray, count: int) -> list[np.ndarray]:
    """Bit sets of ``count`` arrays over the columns ``0, 1, ...`` that they own, some columns at a time."""
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total, parts = int(column[-1]) + 1 if len(column) else 0, []
    most = min(BIT_COLUMNS, max(64, 16 * HELD_PAIRS // count))
    for start in range(0, total, most):
        a, b = np.searchsorted(column, [start, start + most])
        flags = np.zeros((count, -(-min(most, total - start) // 64) * 64), bool)
        flags[owner[a:b], column[a:b] - start] = True
        parts.append(np.packbits(flags, axis=1).view(np.uint64))
    return parts


def _common(arrays: list[np.ndarray]):
    """Sizes of all pairwise intersections, a block of arrays at a time: the first one's place, and a row per array with its
    intersections with all (those with arrays before it are not counted).

    Hashes that many arrays hold are compared by bit sets, the others through the lists of the arrays that hold them.
    """
    count = len(arrays)
    owner = np.repeat(np.arange(count), [len(x) for x in arrays])
    _, column, often = np.unique(np.concatenate(arrays), return_inverse=True, return_counts=True)
    dense = (often > 1) & (often * COMMON > count)
    among = dense[column]
    bits = _bit_sets(owner[among], (np.cumsum(dense) - 1)[column[among]], count)
    listed = (often[column] > 1) & ~among
    owner, column = owner[listed], column[listed]
    order = np.argsort(column, kind="stable")  # of one column by array, as the arrays follow each other
    owner, column = owner[order], column[order]
    later = np.searchsorted(column, column, side="right") - np.arange(len(column)) - 1
    places = np.argsort(owner, kind="stable")
    begins = np.searchsorted(owner[places], np.arange(count + 1))
    pairs = np.concatenate([[0], np.cumsum(later[places])])[begins]  # that the arrays before have
    first = 0
    while first < count:
        few = int(np.searchsorted(pairs, pairs[first] + HELD_PAIRS, side="right")) - 1
        last = min(count, first + max(1, HELD_PAIRS // count), max(first + 1, few))
        held = places[begins[first] : begins[last]]
        times = later[held]
        others = owner[np.repeat(held + 1 - np.cumsum(times) + times, times) + np.arange(times.sum())]
        cells = np.repeat((owner[held] - first) * count, times) + others
        sizes = np.bincount(cells, minlength=(last - first) * count).reshape(-1, count)
        for i in range(first, last):
            for part in bits:
                sizes[i - first, i:] += np.bitwise_count(part[i] & part[i:]).sum(1, dtype=np.int64)
        yield first, sizes
        first = last


def _links(sizes: np.ndarray, arrays: list[np.ndarray], percent: int):
    """Places of the pairs that link, some at a time."""
    for first, common in _common(arrays):
        both = sizes[first : first + len(common), None] + sizes[None, :] - common
        a, b = np.nonzero(np.triu(100 * common >= percent * both, first + 1))
        yield a + first, b


def _connected(pairs):
    """From rows sorted by group: what ``pairs`` connects inside each, as ``(a, b)`` with ``b`` the smallest id.

    ``pairs`` gives places some at a time, so that not all pairs of a group are ever held.  Rows are group, id, side, size and an array; in a group of two sides only pairs across count.
    """

    def settle(rows):
        if len(rows) < 2:
            return
        ids, sides, sizes = (np.array([r[i] for r in rows]) for i in range(3))
        unique, place = np.unique(ids, return_inverse=True)
        lowest = unique
        for a, b in pairs(sizes, [r[3] for r in rows]):
            across = (sides[a] != sides[b]) | (sides[a] == 2)
            known = np.flatnonzero(lowest < unique)  # earlier pairs take part as one from each id to the lowest
            lowest = smallest_reached(unique, np.concatenate([place[a[across]], known]),
                                      np.concatenate([place[b[across]], np.searchsorted(unique, lowest[known])]))
        moved = lowest < unique
        if moved.any():
            yield pa.RecordBatch.from_arrays([pa.array(unique[moved]), pa.array(lowest[moved])], ["a", "b"])

    def run(batches):
        current, rows = None, []
        for batch in batches:
            groups, ids, sides, sizes = (batch.column(i).to_numpy() for i in range(4))
            ends, flat = batch.column(4).offsets.to_numpy(), batch.column(4).values.to_numpy().view(np.uint64)
            for i, group in enumerate(groups):
                if group != current:
                    yield from settle(rows)
                    current, rows = group, []
                rows.append((ids[i], sides[i], sizes[i], flat[ends[i] : ends[i + 1]].copy()))
        yield from settle(rows)

    return run


def _dealt(clusters: DataFrame, percent: int) -> DataFrame:
    """``(id, n, groups)``: the comparisons that a set takes part in; ``side`` 2 means with all others there.

    ``clusters`` has ``cluster``, ``id`` and ``n`` of one set of each class.

    Sizes of linked sets lie in the same or neighbouring levels, so a range of levels also gets the lowest of the next.
    """
    level = F.floor(F.log("n") / math.log(100 / percent) + 1e-9)
    rows = materialize(clusters.withColumn("level", level))
    needed = F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_SETS)).alias("blocks")
    large = materialize(rows.groupBy("cluster").agg(needed).where("blocks > 1").select("cluster", F.lit(True).alias("large")))
    own = F.floor(F.col("level") / LEVELS)
    ranges = F.when(F.col("large") & (F.col("level") % LEVELS == 0), F.array(own, own - 1)).when(F.col("large"), F.array(own))
    rows = materialize(rows.join(large, "cluster", "left").withColumn("range", F.explode(F.coalesce(ranges, F.array(F.lit(-2).cast("long"))))))
    blocks = materialize(rows.groupBy("cluster", "range").agg(needed))
    rows = rows.join(blocks, ["cluster", "range"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))

    def group(other):
        own = F.col("block")
        return F.struct(
            F.xxhash64("cluster", "range", F.least(own, other), F.greatest(own, other)).alias("group"),
            F.when(own == other, 2).otherwise((own < other).cast("int")).alias("side"),
        )

    each = rows.select("id", "n", F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), group).alias("groups"))
    return materialize(each.groupBy("id", "n").agg(F.flatten(F.collect_list("groups")).alias("groups")))


def _within(docs: DataFrame, dealt: DataFrame, words: int, percent: int) -> DataFrame:
    """Edges ``(a, b)`` that connect what is linked inside the clusters."""

    def out(rows):
        ends = np.cumsum([0, *(len(r[3]) for r in rows)])
        flat = np.concatenate([np.empty(0, np.uint64), *(r[3] for r in rows)]).view(np.int64)
        return pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
            pa.array([r[1] for r in rows], pa.int32()), pa.array([len(r[3]) for r in rows], pa.int64()),
            pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
        ], ["group", "id", "side", "n", "values"])

    def run(batches):
        for batch in batches:
            rows, held = [], 0
            for key, text, n, groups in zip(*(batch.column(i) for i in range(4))):
                hashes = shingles(text.as_py() or "", words)
                if len(hashes) != n.as_py():  # another text of the same id
                    continue
                for g in groups.as_py():  # a set goes to many groups, so a batch is cut by what it holds
                    rows.append((g["group"], g["side"], key.as_py(), hashes))
                    held += len(hashes)
                    if held >= BLOCK_SHINGLES:
                        yield out(rows)
                        rows, held = [], 0
            yield out(rows)

    near = _maybe_among(docs, "id", dealt).join(dealt, "id").select("id", "text", "n", "groups")
    sets = near.mapInArrow(run, "group long, id long, side int, n long, values array<long>")
    return sets.repartition("group").sortWithinPartitions("group").mapInArrow(
        _connected(lambda n, x: _links(n, x, percent)), "a long, b long")


def join(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``(id, n_shingles, component_id)``, a row per row of ``docs``.

    Two documents link when ``100 * intersection >= percent * union``; a component is all that links reach and is named by its
    smallest id.  Null or empty texts and texts without words have size 0 and link with nothing, as do rows without id, whose
    component is null.  Rows that share an id are one node.  Other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    signed = materialize(_signed(rows, words, percent))
    sized = signed.select("id", "n", "c1", "c2")
    same = ["n", "c1", "c2"]
    copied = materialize(sized.where("n > 0 and id is not null").groupBy(*same).agg(
        F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last"))
    equal = sized.where("n > 0 and id is not null").join(copied, same).select(
        F.col("id").alias("a"), F.col("first").alias("b"))
    named = signed.where("n > 0 and id is not null").withColumn("node", F.xxhash64("n", "c1", "c2"))
    keys = named.select("node", F.explode("asked").alias("key"), F.lit(True).alias("asks")).unionByName(
        named.select("node", F.explode("listed").alias("key"), F.lit(False).alias("asks")))
    dealt = keys.select("key", F.col("node").alias("id"), "asks").repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    met = materialize(dealt.mapInArrow(_bucket_pairs, "kind long, key long, a long, b long"))
    sketched = named.where("size(sketch) > 0").groupBy(F.col("node").alias("id"), "n", "c1", "c2")
    sketches = materialize(sketched.agg(F.any_value("sketch").alias("sketch")).select("id", "n", "sketch"))
    clusters = _clusters(met, sketches, percent).withColumnRenamed("id", "node")
    # a class is compared by the text of its smallest id
    clusters = named.select("node", "id", *same).join(clusters, "node").groupBy("cluster", *same).agg(F.min("id").alias("id"))
    dealt = _dealt(clusters.select("cluster", "id", "n"), percent)
    links = materialize(equal.unionByName(_within(rows, dealt, words, percent)))
    labels = components(links)
    return sized.join(labels, "id", "left").select(
        "id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` of which one stays per component, that with the smallest id; rows without id stay.

    Rows equal in id and text are one document, of which any one stays.  Different texts under one id are documents of
    their own: each may stay or go, and of those in one component that with the smallest id, then text digest, stays.
    """
    digest = F.coalesce(F.sha2(F.col(f"`{text}`"), 256), F.lit("null"))
    named = docs.where(F.col(f"`{id_col}`").isNotNull())
    keys = named.select(F.col(f"`{id_col}`").cast("long").alias("_id"), digest.alias("_digest"))
    several = keys.groupBy("_id").agg(F.min("_digest").alias("low"), F.max("_digest").alias("high")).where("low < high")
    if several.isEmpty():
        kept = join(named, id_col, text, words, percent).where("id = component_id").select(F.col("id").alias(id_col)).distinct()
        one_each = named.join(kept.withColumn(id_col, F.col(id_col).cast(docs.schema[id_col].dataType)), id_col, "left_semi")
        one_each = one_each.dropDuplicates([id_col])
    else:
        # numbers in the order of id and digest are the nodes, so the smallest number of a component is its survivor
        numbers = materialize(global_rank(keys.distinct(), "_id", ["_digest"], "_node"))
        box = named.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
        own = F.col("_row")[id_col].cast("long"), F.coalesce(F.sha2(F.col("_row")[text], 256), F.lit("null"))
        rows = materialize(box.withColumn("_id", own[0]).withColumn("_digest", own[1]).join(numbers, ["_id", "_digest"]))
        kept = join(rows.select("_node", F.col("_row")[text].alias("text")), "_node", "text", words, percent)
        kept = kept.where("id = component_id").select(F.col("id").alias("_node")).distinct()
        one_each = rows.join(kept, "_node", "left_semi").dropDuplicates(["_node"]).select("_row.*")
    return one_each.select(*docs.columns).unionByName(docs.where(F.col(f"`{id_col}`").isNull()))
