"""Exact top-k inner products on an impact-ordered index, score at a time.

The index deals the vectors into blocks.  In a block every non-zero component is a posting, and its impact, the size of the
component, is quantised to its power of two; postings of one quantised impact form a segment, kept in descending order.
A search adds segment after segment to the scores of all vectors in the block.  What is still unread of a vector can
change its score by no more than the largest unread impact times the query's weights there.  Once these bounds prove for a
query that few vectors can be among its best, that query leaves; the others read on.  Possible members are scored again exactly.

Blocks and parts of the queries meet in pairs of bounded size, so the index is copied once per ``QUERY_PART`` queries; each
pair gives ``k`` rows a query, of which the best are kept.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradeloom.materialize import materialize

BLOCK_ROWS = 8192
QUERY_PART, QUERY_ROWS = 32768, 512  # queries that travel to a block together, and those that read it side by side
FEW = 32  # reading stops when at most one vector in so many (or 4 k) is a possible member
_EXACT = 2**53
SEGMENT = "size int, block int, level int, ids array<long>, row array<int>, dim array<int>, value array<long>"


def build(vectors: DataFrame) -> DataFrame:
    """Index of ``(id, values)`` with integer arrays: a row per block and segment; the head of a block has level 99.

    Every vector is indexed.  The head lists the ids, so a vector of zeros is found too.
    """
    rows = vectors.count()
    blocks = max(1, -(-rows // BLOCK_ROWS))
    dealt = vectors.select(
        F.size("values").alias("size"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", "values"
    )

    def segments(key, frame):
        size, block = key
        matrix = np.array(frame["values"].tolist(), np.int64).reshape(len(frame), size)
        row, dim = np.nonzero(matrix)
        value = matrix[row, dim]
        level = np.frexp(np.abs(value).astype(float))[1]
        empty = np.empty(0, np.int64)
        out = [(size, block, 99, frame["id"].to_numpy(), empty, empty, empty)]
        for at in np.unique(level)[::-1]:
            own = level == at
            out.append((size, block, int(at), empty, row[own], dim[own], value[own]))
        return pd.DataFrame(out, columns=["size", "block", "level", "ids", "row", "dim", "value"])

    return materialize(dealt.groupBy("size", "block").applyInPandas(segments, SEGMENT))


def _members(postings, ids, asked, owners, k: int):
    """Places in the block that may be among the ``k`` best of each query, and the number of postings each query read.

    ``postings`` has per segment its level and the place, dimension and value of each posting, largest impacts first.
    """
    members, reads = [None] * len(asked), np.zeros(len(asked), np.int64)
    active, weight = np.arange(len(asked)), asked.astype(float)
    own = owners[:, None] == ids[None, :]
    scores = np.where(own, -np.inf, 0.0)
    unread = np.repeat(np.abs(weight).sum(1)[:, None], len(ids), axis=1)
    keep = min(k, len(ids))
    for i, (_, row, dim, value) in enumerate(postings):
        rows, at = np.unique(row, return_inverse=True)
        part, read = np.zeros((len(rows), asked.shape[1])), np.zeros((len(rows), asked.shape[1]))
        part[at, dim], read[at, dim] = value, 1.0
        touched = slice(None) if len(rows) == len(ids) else rows
        scores[:, touched] += weight @ part.T
        unread[:, touched] -= np.abs(weight) @ read.T
        reads[active] += len(row)
        limit = 2.0 ** postings[i + 1][0] if i + 1 < len(postings) else 0.0
        slack = limit * unread
        sure = np.partition(scores - slack, len(ids) - keep, axis=1)[:, len(ids) - keep]
        possible = (scores + slack >= sure[:, None]) & ~own
        done = (possible.sum(1) <= max(4 * k, len(ids) // FEW)) | (limit == 0.0)
        for q in np.flatnonzero(done):
            members[active[q]] = np.flatnonzero(possible[q])
        if done.any():
            active, weight, own, scores, unread = (x[~done] for x in (active, weight, own, scores, unread))
        if not len(active):
            break
    return members, reads


def _search(k: int):
    def run(key, index, queries):
        names = ["query_id", "id", "score"]
        if not len(index) or not len(queries):
            return pd.DataFrame({n: np.empty(0, np.int64) for n in names})
        size = int(key[0])
        segments = index.sort_values("level", ascending=False)
        ids = np.asarray(segments["ids"].iloc[0], np.int64)
        matrix, postings = np.zeros((len(ids), size), np.int64), []
        for level, row, dim, value in segments[["level", "row", "dim", "value"]].iloc[1:].itertuples(index=False):
            matrix[row, dim] = value
            postings.append((level, row, dim, value))
        largest = np.abs(matrix.astype(float)).max(initial=0.0)
        out = []
        for at in range(0, len(queries), QUERY_ROWS):
            part = queries.iloc[at : at + QUERY_ROWS]
            asked, owners = np.array(part["values"].tolist(), np.int64).reshape(len(part), size), part["query_id"].to_numpy()
            # doubles then hold every sum exactly, and bounds are proofs
            exact = largest * np.abs(asked.astype(float)).sum(1).max(initial=0.0) < _EXACT
            members = _members(postings, ids, asked, owners, k)[0] if exact and postings else [np.flatnonzero(ids != q) for q in owners]
            for q, places in enumerate(members):
                own_scores = matrix[places] @ asked[q] if exact else (matrix[places].astype(object) @ asked[q].astype(object))
                order = np.lexsort((ids[places], -own_scores.astype(np.int64)))[:k]
                out += [(owners[q], ids[places[o]], int(own_scores[o])) for o in order]
        return pd.DataFrame(out, columns=names).astype("int64")

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``(query_id, rank, id, score)``: for each query its ``k`` highest inner products, ties to the smaller id.

    ``vectors`` has a long ``id`` and an integer array ``values``; ``queries`` the same as ``query_id`` and ``values``.  A query
    does not find rows of its own id.  Vectors of another size, and rows with a null id, null values or a null among them, take no
    part; equal rows count once.  Rows of one id with different vectors all take part: a query id's best are taken over all its
    vectors, and an id may then be found more than once.  Scores are whole numbers of 64 bits.  Fewer than ``k`` rows give them
    all; no rows give none.
    """
    whole = lambda c: F.col(c).isNotNull() & F.coalesce(F.forall("values", lambda x: x.isNotNull()), F.lit(False))
    rows = vectors.where(whole("id")).select("id", F.col("values").cast("array<long>").alias("values")).distinct()
    asked = materialize(queries.where(whole("query_id")).select(
        "query_id", F.col("values").cast("array<long>").alias("values")).distinct())
    index = build(materialize(rows))
    chunks = max(1, -(-asked.count() // QUERY_PART))
    places = materialize(index.select("size", "block").distinct())
    per_chunk = index.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    chunk = F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int")
    per_block = asked.select(F.size("values").alias("size"), chunk.alias("chunk"), "query_id", "values").join(places, "size")
    keys = ("size", "block", "chunk")
    found = per_chunk.groupBy(*keys).cogroup(per_block.groupBy(*keys)).applyInPandas(
        _search(k), "query_id long, id long, score long"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
