"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample and every vector is put into one of its leaves.  A query walks the tree through a
priority queue: the node with the highest expected inner product (centre plus spread) is opened next, and leaves are visited
in the order in which they leave the queue.  How many leaves is calibrated: the true neighbours of a bounded set of
queries are found among all rows, and the walk is widened until it meets enough of them.

On Spark, neighbouring leaves share a part of bounded size.  Index rows and chunks of queries are shuffled to the parts, a
task holds one part at a time and streams the chunks past it, and what it finds is merged per chunk.
"""

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradeloom.llm.embed_dedup import is_usable
from tradeloom.materialize import materialize

BRANCH, DEPTH, LEAF_ROWS, PART_ROWS = 8, 40, 256, 2048
SAMPLE_ROWS, SAMPLE_VALUES, LEAF_SAMPLE = 32_768, 2**22, 16  # the tree is fitted on so many rows and numbers at most
LLOYD = 8
SPREADS = 2.0  # standard deviations above the centre at which a node's best member is expected
CALIBRATION = 256  # queries whose true neighbours are found
RECALL = 0.95
CHUNK_QUERIES, LANE_QUERIES = 256, 65_536
SEED = 29
_ROUNDING = 1e-12
_MOVED = "part long, lane int, kind int, chunk long, ids array<long>, places array<int>, numbers array<{}>"
_FOUND = "chunk long, queries array<long>, ids array<long>, scores array<double>"


class Tree:
    """Nodes in preorder; the children of a node are listed, a leaf has its number and no children."""

    def __init__(self):
        self.centre, self.spread, self.children, self.leaf, self.leaves = [], [], [], [], 0

    def add(self, rows: np.ndarray, share: int, rng: np.random.Generator, depth: int = 0) -> int:
        """Grow the subtree over ``rows``: nodes with more than ``share`` rows are split by k-means, down to ``DEPTH``."""
        node, centre = len(self.centre), rows.mean(0)
        self.centre.append(centre)
        self.spread.append(np.sqrt(((rows - centre) ** 2).mean()))
        self.children.append([])
        groups = _split(rows, min(BRANCH, -(-len(rows) // share)), rng) if len(rows) > share and depth < DEPTH else []
        self.leaf.append(-1 if groups else self.leaves)
        self.leaves += not groups
        for group in groups:
            self.children[node].append(self.add(group, share, rng, depth + 1))
        return node

    def packed(self) -> "Tree":
        self.centre, self.spread, self.leaf = np.array(self.centre), np.array(self.spread), np.array(self.leaf)
        return self

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row: from the root always to the nearest child."""
        out, open_ = np.empty(len(rows), np.int64), [(0, np.arange(len(rows)))]
        while open_:
            node, own = open_.pop()
            if self.leaf[node] >= 0:
                out[own] = self.leaf[node]
                continue
            children = np.array(self.children[node])
            nearest = _nearest_centre(rows[own], self.centre[children])
            open_ += [(child, own[nearest == i]) for i, child in enumerate(children) if (nearest == i).any()]
        return out

    def walk(self, queries: np.ndarray, width: int) -> np.ndarray:
        """The first ``width`` leaves of each query, best bin first."""
        norms = np.sqrt((queries**2).sum(1))
        hopes = -(queries @ self.centre.T + SPREADS * norms[:, None] * self.spread)
        out = np.empty((len(queries), min(width, self.leaves)), np.int64)
        leaf, children = self.leaf.tolist(), self.children
        for row, hope in zip(out, hopes):
            hope, queue, seen = hope.tolist(), [(0.0, 0)], 0
            while seen < len(row):
                _, node = heapq.heappop(queue)
                if leaf[node] >= 0:
                    row[seen] = leaf[node]
                    seen += 1
                for child in children[node]:
                    heapq.heappush(queue, (hope[child], child))
        return out


def _nearest_centre(rows, centres):
    return ((centres**2).sum(1) - 2 * (rows @ centres.T)).argmin(1)


def _split(rows, k, rng):
    """Groups of Lloyd's k-means from distinct random rows; none if the rows cannot be told apart."""
    centres = np.unique(rows[rng.choice(len(rows), min(len(rows), 4 * k), replace=False)], axis=0)
    centres = centres[rng.permutation(len(centres))[:k]]
    for _ in range(LLOYD):
        own = _nearest_centre(rows, centres)
        used = np.unique(own)
        centres = np.stack([rows[own == i].mean(0) for i in used])
    own = _nearest_centre(rows, centres)
    groups = [rows[own == i] for i in np.unique(own)]
    return groups if len(groups) > 1 else []


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def best(asked, owners, rows, ids, k, visited=None):
    """``(place of the query, id, score)``: the ``k`` largest inner products, ties to the smaller id, ordered by query and rank.

    The matrix product only chooses; scores are summed in the order of the components, so equal vectors have equal scores.
    """
    scores = asked @ rows.T
    scores[(owners[:, None] == ids[None, :]) | np.isnan(scores)] = -np.inf
    if visited is not None:
        scores[~visited] = -np.inf
    keep = min(k, len(ids))
    edge = np.partition(scores, len(ids) - keep, axis=1)[:, len(ids) - keep]
    reach = np.sqrt((asked**2).sum(1)) * np.sqrt((rows**2).sum(1).max(initial=0.0))
    query, row = np.nonzero((scores >= (edge - _ROUNDING * reach)[:, None]) & (scores > -np.inf))
    exact = np.zeros(len(query))
    for left, right in zip(asked.T, rows.T):
        exact += left[query] * right[row]
    return _first(query, ids[row], exact, k)


def _first(query, ids, scores, k):
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    return query[rank < k], ids[rank < k], scores[rank < k]


def fit(rows: DataFrame, count: int, size: int) -> Tree | None:
    """Tree over a sample of ``(id, vector)`` by hash, of about ``SAMPLE_ROWS`` rows at most; no rows give no tree."""
    if not count:
        return None
    most = max(2 * LEAF_SAMPLE, min(SAMPLE_ROWS, SAMPLE_VALUES // size))
    part = min(1.0, most / count)
    drawn = rows if part == 1.0 else rows.where(F.pmod(F.xxhash64("id", "vector"), F.lit(2**30)) < int(part * 2**30))
    sample = drawn.select("id", "vector").toArrow()
    if not len(sample):
        sample = rows.orderBy("id").limit(1).select("id", "vector").toArrow()
    values = _matrix(sample.column("vector").combine_chunks(), size)
    values = values[np.lexsort((*values.T[:8], sample.column("id").to_numpy()))]  # the order of a collect is not fixed
    tree = Tree()
    tree.add(values, max(LEAF_SAMPLE, round(LEAF_ROWS * len(values) / count)), np.random.default_rng(SEED))
    return tree.packed()


def _assigned(rows: DataFrame, tree: Tree, size: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            leaves = tree.assign(_matrix(batch.column(1), size))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves.astype(np.int32))], ["id", "vector", "leaf"])

    kind = rows.schema["vector"].dataType.simpleString()
    return rows.mapInArrow(run, f"id long, vector {kind}, leaf int")


def truth(assigned: DataFrame, asked: np.ndarray, owners: np.ndarray, k: int) -> DataFrame:
    """``(query, id, score, leaf)``: the true neighbours, among all rows, of a bounded set of queries."""
    size = asked.shape[1]

    def run(batches):
        held = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        for batch in batches:
            if len(batch):
                ids = batch.column(0).to_numpy()
                query, found, score = best(asked, owners, _matrix(batch.column(1), size), ids, k)
                order = np.argsort(ids, kind="stable")
                leaf = batch.column(2).to_numpy()[order[np.searchsorted(ids[order], found)]]
                held = tuple(np.concatenate(x) for x in zip(held, (query, found, score, leaf)))
                order = np.lexsort((held[1], -held[2], held[0]))
                held = tuple(x[order] for x in held)
                first = np.arange(len(order)) - np.searchsorted(held[0], held[0]) < k
                held = tuple(x[first] for x in held)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["query", "id", "score", "leaf"])

    found = assigned.mapInArrow(run, "query long, id long, score double, leaf long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def calibrate(assigned: DataFrame, tree: Tree, queries: DataFrame, asked: int, size: int, k: int, recall: float) -> int:
    """Number of leaves to visit: widened until the mean recall, less twice its standard error, reaches ``recall``.

    The error only matters while some queries are not part of the calibration.
    """
    part = min(1.0, CALIBRATION / asked)
    drawn = queries if part == 1.0 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(2**30)) < int(part * 2**30))
    drawn = drawn.toArrow()
    if not len(drawn):
        return tree.leaves
    values, owners = _matrix(drawn.column("vector").combine_chunks(), size), drawn.column("query_id").to_numpy()
    true = truth(assigned, values, owners, k).toArrow()
    if not len(true):
        return tree.leaves
    query, leaf = true.column("query").to_numpy(), true.column("leaf").to_numpy()
    place = np.argsort(tree.walk(values, tree.leaves), axis=1)[query, leaf]  # when the walk reaches each neighbour
    width = 1
    while width < tree.leaves:
        met = np.bincount(query, place < width, len(values))[np.unique(query)] / np.bincount(query)[np.unique(query)]
        if met.mean() - (2 * met.std() / np.sqrt(len(met)) if part < 1.0 else 0.0) >= recall:
            break
        width += max(1, width // 8)
    return min(width, tree.leaves)


def _parts(assigned: DataFrame, tree: Tree) -> tuple[np.ndarray, np.ndarray, int]:
    """First part and number of parts of each leaf, and the number of all; small neighbouring leaves share one."""
    rows = np.zeros(tree.leaves, np.int64)
    for r in assigned.groupBy("leaf").count().collect():  # a row per leaf of the bounded tree
        rows[r["leaf"]] = r["count"]
    first, many, part, filled = np.zeros(tree.leaves, np.int64), np.maximum(1, -(-rows // PART_ROWS)), 0, 0
    for leaf, n in enumerate(rows):
        if filled and filled + n > PART_ROWS:
            part, filled = part + 1, 0
        first[leaf] = part
        filled += n
        if many[leaf] > 1:
            part, filled = part + many[leaf], 0
    return first, many, int(part + bool(filled))


def _moved_rows(assigned: DataFrame, first, many, kind: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids, leaf = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            part = first[leaf] + (ids * 0x9E3779B1 >> 8) % many[leaf]
            ones, none = np.arange(len(ids) + 1, dtype=np.int32), np.zeros(len(ids), np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(part), pa.array(none.astype(np.int32)), pa.array(none),
                pa.ListArray.from_arrays(ones, batch.column(0)), pa.ListArray.from_arrays(ones, pa.array(leaf)), batch.column(1),
            ], ["part", "kind", "chunk", "ids", "places", "numbers"])

    return assigned.mapInArrow(run, _MOVED.format(kind).replace("lane int, ", ""))


def _moved_queries(queries: DataFrame, tree: Tree, first, many, width: int, size: int, kind: str) -> DataFrame:
    """A row per chunk of queries and part that any of them visits, with those queries and the leaves each visits there."""
    arrow = pa.float32() if kind == "float" else pa.float64()
    listed = lambda values, type_: pa.array([values], pa.list_(type_))

    def run(batches):
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start in range(0, len(batch), CHUNK_QUERIES):
                piece = batch.slice(start, CHUNK_QUERIES)
                owners, values = piece.column(0).to_numpy(), _matrix(piece.column(1), size)
                walks = tree.walk(values, width)
                query, leaf = np.repeat(np.arange(len(walks)), walks.shape[1]), walks.ravel()
                blocks = many[leaf]
                within = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                query, part, leaf = np.repeat(query, blocks), np.repeat(first[leaf], blocks) + within, np.repeat(leaf, blocks)
                order = np.lexsort((query, part))
                query, part, leaf = query[order], part[order], leaf[order]
                edges = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
                for low, high in zip(edges[:-1], edges[1:]):
                    own, counts = np.unique(query[low:high], return_counts=True)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([part[low]]), pa.array([1], pa.int32()), pa.array([chunk]), listed(owners[own], pa.int64()),
                        listed(np.concatenate([counts, leaf[low:high]]), pa.int32()), listed(values[own].ravel(), arrow),
                    ], ["part", "kind", "chunk", "ids", "places", "numbers"])
                chunk += 1

    return queries.mapInArrow(run, _MOVED.format(kind).replace("lane int, ", ""))


def _search(size: int, k: int):
    """Hold the rows of one part and answer the chunks that follow them."""

    def answer(held, owners, places, numbers, chunk):
        ids, leaves, rows = held
        asked, counts = numbers.reshape(-1, size), places[: len(owners)]
        names, at = np.unique(leaves, return_inverse=True)
        visits, query = places[len(owners) :], np.repeat(np.arange(len(owners)), counts)
        known = np.searchsorted(names, visits).clip(max=max(len(names) - 1, 0))
        there = names[known] == visits if len(names) else np.zeros(len(visits), bool)
        wanted = np.zeros((len(owners), len(names)), bool)
        wanted[query[there], known[there]] = True
        if not wanted.any():
            return None
        query, found, scores = best(asked, owners, rows, ids, k, wanted[:, at])
        listed = lambda x: pa.array([x], pa.list_(pa.from_numpy_dtype(x.dtype)))
        return pa.RecordBatch.from_arrays(
            [pa.array([chunk]), listed(owners[query]), listed(found), listed(scores)], ["chunk", "queries", "ids", "scores"]
        )

    def run(batches):
        key, pieces, held = None, [], None
        for batch in batches:
            names = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            part, lane, kind, chunk = (names[n].to_numpy() for n in ("part", "lane", "kind", "chunk"))
            starts = np.flatnonzero((np.diff(part, prepend=-1) != 0) | (np.diff(lane, prepend=-1) != 0) | (kind == 1) | (np.diff(kind, prepend=-1) != 0))
            for low, high in zip(starts, [*starts[1:], len(batch)]):
                if (part[low], lane[low]) != key:
                    key, pieces, held = (part[low], lane[low]), [], None
                ids, places = (names[n].slice(low, high - low).flatten().to_numpy() for n in ("ids", "places"))
                numbers = names["numbers"].slice(low, high - low).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                if kind[low] == 0:
                    pieces.append((ids, places, numbers.reshape(-1, size)))
                elif pieces:
                    held = held or tuple(np.concatenate(x) for x in zip(*pieces))
                    out = answer(held, ids, places, numbers, chunk[low])
                    if out is not None:
                        yield out

    return run


def _merge(k: int):
    """The best of each query of a chunk over all parts; the rows of a chunk follow each other."""

    def rows(query, ids, scores):
        rank = np.arange(len(query)) - np.searchsorted(query, query) + 1
        return pa.RecordBatch.from_arrays(
            [pa.array(query), pa.array(rank.astype(np.int32)), pa.array(ids), pa.array(scores)], ["query_id", "rank", "id", "score"]
        )

    def run(batches):
        now, pieces = None, []
        reduced = lambda: _first(*(np.concatenate(x) for x in zip(*pieces)), k)
        for batch in batches:
            chunks = batch.column(0).to_pylist()
            for i, chunk in enumerate(chunks):
                if chunk != now and pieces:
                    yield rows(*reduced())
                    pieces = []
                now = chunk
                pieces.append(tuple(batch.column(c).slice(i, 1).flatten().to_numpy() for c in (1, 2, 3)))
                if len(pieces) > 64:
                    pieces = [reduced()]
        if pieces:
            yield rows(*reduced())

    return run


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = RECALL, id_col: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``(query_id, rank, id, score)``: about ``recall`` of each query's ``k`` rows of largest inner product, in doubles.

    ``queries`` has the columns of ``vectors``.  Scores are exact, ties go to the smaller id.  A query does not find rows of its
    own id.  Vectors that are null, empty, zero or hold null or non-finite components, rows with a null id, and vectors of another
    size than most rows have (of equally common sizes the smallest) take no part.  Rows equal in id and vector count once;
    different vectors under one id are rows of their own, and as a query the smallest of them asks.  Of equal vectors only the ``k + 1``
    smallest ids are indexed: no other can be among the first ``k``.  Fewer than ``k`` rows give all that are visited,
    no rows give none.  Inner products must be within the range of doubles; one that is not a number is not found.
    """
    element = vectors.schema[vector].dataType.elementType.simpleString()
    kind = element if element == "float" else "double"
    usable = lambda df, name: df.where(is_usable(F.col(f"`{vector}`")) & F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("long").alias(name), F.col(f"`{vector}`").cast(f"array<{kind}>").alias("vector"))
    copies = Window.partitionBy("vector").orderBy("id")
    rows = usable(vectors, "id").distinct().withColumn("_n", F.row_number().over(copies)).where(F.col("_n") <= k + 1).drop("_n")
    rows = materialize(rows)
    common = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    count, size = (common["count"], common["size"]) if common else (0, 0)
    rows = rows.where(F.size("vector") == size)
    asked = usable(queries, "query_id").where(F.size("vector") == size).groupBy("query_id").agg(F.min("vector").alias("vector"))
    asked = materialize(asked)
    number = asked.count()
    tree = fit(rows, count, size)
    if not number or tree is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, id long, score double")
    assigned = materialize(_assigned(rows, tree, size))
    width = calibrate(assigned, tree, asked, number, size, k, recall)
    first, many, _ = _parts(assigned, tree)
    lanes = -(-number // LANE_QUERIES)
    tasks = min(-(-number // CHUNK_QUERIES), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    index = _moved_rows(assigned, first, many, kind).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    chunks = _moved_queries(asked.repartition(tasks, "query_id"), tree, first, many, width, size, kind)
    chunks = chunks.withColumn("lane", F.pmod(F.xxhash64("chunk"), F.lit(lanes)).cast("int"))
    meeting = index.unionByName(chunks).select("part", "lane", "kind", "chunk", "ids", "places", "numbers")
    meeting = meeting.repartition("part", "lane").sortWithinPartitions("part", "lane", "kind")
    found = meeting.mapInArrow(_search(size, k), _FOUND).repartition("chunk").sortWithinPartitions("chunk")
    return found.mapInArrow(_merge(k), "query_id long, rank int, id long, score double")
