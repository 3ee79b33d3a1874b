"""Vector codes against plain rounds of assignment, and the trie against all distances."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_oracle import SF
from tradeloom.llm import codes
from tradeloom.llm.queries import QUERIES


def plain(rows, parts=8, entries=16, rounds=6):
    """``rows``: (id, integers) by id; codes, errors and codebooks without any sharing."""
    width = -(-len(rows[0][1]) // parts)
    cut = np.zeros((len(rows), parts * width), np.int64)
    cut[:, : len(rows[0][1])] = [v for _, v in rows]
    cut = cut.reshape(len(rows), parts, width)
    books = cut[:entries].transpose(1, 0, 2).copy()
    for step in range(rounds + 1):
        distance = ((cut[:, :, None, :] - books[None]) ** 2).sum(3)
        nearest = distance.argmin(2)
        if step < rounds:
            for p in range(parts):
                for e in range(books.shape[1]):
                    own = cut[nearest[:, p] == e, p]
                    if len(own):
                        books[p, e] = own.sum(0) // len(own)
    return ["".join(f"{e:02x}" for e in row) for row in nearest], distance.min(2).sum(1), books


@pytest.mark.parametrize("subtree", [1, 8, 4096])
@pytest.mark.parametrize("values,width", [(2, 3), (4, 8), (2000, 2), (1, 1)])
def test_walk_equals_all_distances(monkeypatch, subtree, values, width):
    monkeypatch.setattr(codes, "SUBTREE", subtree)
    rng = np.random.default_rng(values)
    rows, back, counts = codes._distinct(rng.integers(-values, values, (700, width)))
    assert (np.unique(rows, axis=0) == rows).all() and counts.sum() == len(back) == 700
    entries = rng.integers(-values, values, (5, width))
    distance = ((rows[:, None] - entries[None]) ** 2).sum(2)
    nearest, error = codes.walk(rows, entries)
    assert (nearest == distance.argmin(1)).all() and (error == distance.min(1)).all()
    assert len(codes.walk(rows[:0], entries)[0]) == 0


@pytest.mark.parametrize("size,rows", [(16, 300), (13, 40), (3, 9)])
def test_rows_equal_plain_rounds(spark, size, rows):
    rng = np.random.default_rng(size)
    vectors = [(i, [float(x) for x in rng.standard_normal(size).round(2)], i % 3 or None) for i in range(rows)]
    vectors += [(1000 + i, vectors[5][1], 7) for i in range(60)]  # a large group of copies
    odd = [(-1, None, 1), (-2, [float("nan")] * size, 1), (-3, [float("inf")] * size, 1), (-4, [1.0] * (size - 1) + [None], 1), (-5, [], 1), (2000, [0.5], 1)]
    df = spark.createDataFrame([(*r, "old", "kept") for r in [*vectors, *odd]], "vec_id long, embedding array<double>, label int, code string, part string")
    coded, books = codes.compress(df.repartition(4))
    got = {r["vec_id"]: r for r in codes.with_group_error(coded, "label", "label_error").collect()}
    whole = [(i, np.floor(4096 * np.array(v)).astype(np.int64)) for i, v, _ in vectors]
    want, errors, learned = plain(whole)
    assert sorted(got) == sorted(i for i, _, _ in vectors) and (books == learned).all()
    totals = {}
    for (_, _, label), error in zip(vectors, errors):
        totals[label] = totals.get(label, 0) + int(error)
    for (i, _, label), code, error in zip(vectors, want, errors):
        assert (got[i]["code"], got[i]["error"], got[i]["label_error"], got[i]["part"]) == (code, error, totals[label], "kept")


def test_empty_repeated_and_extreme_rows(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0]), (None, [1.0, 2.0]), (3, [5.0, -1.0])], "vec_id long, embedding array<float>")
    coded, books = codes.compress(df, parts=2, entries=2)
    assert books[:, 0].ravel().tolist() == [5 * 4096, -4096] and coded.count() == 3  # null ids come last
    none, books = codes.compress(df.limit(0))
    assert none.count() == 0 and books.size == 0 and codes.books_digest(books) == hashlib.sha256(b"").hexdigest()
    with pytest.raises(Exception, match="beyond"):
        codes.compress(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>"))


def test_copies_count_before_they_move(spark):
    """However many rows are equal, a batch sends one row for each position."""
    df = spark.range(20_000).selectExpr("array(1L, 2L, 3L, 4L) AS values").coalesce(1)
    distinct = codes.distinct_parts(df, parts=2)
    assert sorted((r["position"], list(r["part"]), r["n"]) for r in distinct.collect()) == [(0, [1, 2], 20_000), (1, [3, 4], 20_000)]


def test_query(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    want, errors, books = plain([(r["vec_id"], np.floor(4096 * np.array(r["embedding"])).astype(np.int64)) for r in table])
    got = {r["vec_id"]: r for r in QUERIES["op13_vector_codes"](spark, SF).collect()}
    for row, code, error in zip(table, want, errors):
        r = got[row["vec_id"]]
        assert (r["code"], r["error"], r["codebooks_sha256"]) == (code, error, codes.books_digest(books))


def test_a_round_takes_few_jobs_on_any_number_of_partitions(spark):
    """Totals come back at once: with a job per partition a round over many partitions is mostly waiting."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(64)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    scaled = vectors.select(codes._scaled(F.col("embedding"), 64).alias("values"))
    start = np.array([r[0] for r in scaled.limit(4).collect()], np.int64).reshape(4, 4, 2).transpose(1, 0, 2)
    settings = {"spark.sql.shuffle.partitions": "20", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        distinct = codes.distinct_parts(scaled, 4)
        spark.sparkContext.setJobGroup("codes-rounds", "rounds")
        codes.learn(distinct, start, 2)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("codes-rounds")
        assert 0 < len(jobs) <= 2 * 3
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
