"""Nearest neighbours: order, ties and exact scores against brute force, and recall."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from tests.test_oracle import SF
from tradeloom.llm import neighbours
from tradeloom.llm.queries import QUERIES


def brute(rows, asked, k):
    """``rows``: (id, vector) distinct; the first ``k`` by product and id."""
    out = {}
    for q, v in asked.items():
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q)[:k]
        out |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(best)}
    return out


def collected(df):
    return {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in df.collect()}


def test_all_leaves_equal_brute_force_on_awkward_rows(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.integers(-3, 4, 6)]) for i in range(300)]  # many ties
    vectors += [(i, [2.0, 1.0, 0.0, 0.0, 1.0, 3.0]) for i in range(400, 480)]  # more copies than neighbours
    odd = [(900, None), (901, [0.0] * 6), (902, [float("nan")] * 6), (903, [1.0, None] * 3), (904, []), (905, [1.0, 2.0]), (None, [9.0] * 6)]
    df = spark.createDataFrame([(*r, "x", 0.5) for r in [*vectors, *vectors[::7], *odd]], "vec_id long, embedding array<double>, rank string, score double")
    df = df.repartition(4)
    got = collected(neighbours.nearest(df, df.where("vec_id % 20 = 0"), k=5, recall=1.1))  # never reached: every leaf is visited
    live = [(i, v) for i, v in vectors if any(v)]
    assert got == brute(live, {i: v for i, v in live if i % 20 == 0}, 5)
    few = neighbours.nearest(df.where("vec_id < 4"), df.where("vec_id = 1"), k=20)
    assert few.count() == 3
    assert neighbours.nearest(df.limit(0), df).count() == 0 == neighbours.nearest(df, df.limit(0)).count()


def test_parts_lanes_and_blocks_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, [float(x) for x in rng.standard_normal(8)]) for i in range(600)], "vec_id long, embedding array<float>")
    whole = collected(neighbours.nearest(df, df.where("vec_id % 10 = 0"), k=4))
    monkeypatch.setattr(neighbours, "PART_ROWS", 50)  # leaves of up to 256 rows are cut into blocks
    monkeypatch.setattr(neighbours, "LANE_QUERIES", 16)
    monkeypatch.setattr(neighbours, "CHUNK_QUERIES", 7)
    assert collected(neighbours.nearest(df, df.where("vec_id % 10 = 0"), k=4)) == whole


def test_walk_opens_the_best_bin_first():
    rng = np.random.default_rng(3)
    rows = rng.standard_normal((2000, 8))
    tree = neighbours.Tree()
    tree.add(rows, 50, rng)
    tree.packed()
    leaves = tree.assign(rows)
    assert len(np.unique(leaves)) == tree.leaves > 30
    walks = tree.walk(rows[:40], tree.leaves)
    assert (np.sort(walks, axis=1) == np.arange(tree.leaves)).all()
    own = (walks[:, :1] == leaves[:40, None]).mean()
    assert own > 0.3  # a row's own leaf usually comes first, by chance once in tree.leaves


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_query_recall(spark, sf):
    table = pq.read_table(f"{sf}/embeddings.parquet")
    ids, matrix = table["vec_id"].to_numpy(), np.array(table["embedding"].to_pylist(), float)
    found = QUERIES["op11_nearest"](spark, sf).toPandas().sort_values(["query_id", "rank"])
    assert sorted(found["query_id"].unique()) == sorted(i for i in ids if i % 20 == 0)
    hits = 0
    for query, rows in found.groupby("query_id"):
        products = matrix @ matrix[ids == query][0]
        products[ids == query] = -np.inf
        assert list(rows["rank"]) == list(range(1, 21))
        at = [int(np.flatnonzero(ids == i)[0]) for i in rows["vec_id"]]
        assert np.allclose(products[at], rows["score"], rtol=0, atol=1e-12)
        assert list(zip(-rows["score"], rows["vec_id"])) == sorted(zip(-rows["score"], rows["vec_id"]))
        hits += len(set(ids[np.argsort(-products)[:20]]) & set(rows["vec_id"]))
    assert hits / len(found) >= 0.9
