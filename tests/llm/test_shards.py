"""Archives that do not depend on how Spark dealt the rows, and a search in which queries leave one by one."""

import collections

import numpy as np
import pytest

from pyspark.sql import functions as F

from tradeloom.llm import topk, warc
from tradeloom.materialize import new_path

SHARD = 400_000


@pytest.fixture(scope="module")
def pages(spark):
    """20,000 rows: a third without id, a third the same row, the rest of ids and payloads that partly repeat."""
    i = F.col("id")
    third = lambda null, same, other: F.when(i % 3 == 0, null).when(i % 3 == 1, same).otherwise(other)
    return spark.range(20_000).select(
        third(F.lit(None), F.lit(7), i).cast("long").alias("page_id"),
        third(F.concat(F.lit("n"), i), F.lit("u"), F.concat(F.lit("u"), i % 5)).alias("url"),
        third(F.repeat(F.lit("x"), (i % 90).cast("int")), F.lit(None), F.repeat(F.lit("y"), (i % 200).cast("int"))).alias("html"),
    )


def test_archives_do_not_depend_on_partitions(spark, pages):
    found, records = [], []
    for parts in (3, 5, 50):
        path = new_path(spark)
        manifest = warc.write(pages.repartition(parts), path, roll_bytes=20_000, shard_bytes=SHARD)
        found.append(sorted((r["file"], r["records"], r["bytes"]) for r in manifest.collect()))
        files = spark.read.format("binaryFile").load(f"{path}/part-*").select(F.sha1("content").alias("sha1"))
        records.append(sorted(r["sha1"] for r in files.collect()))
    assert found[0] == found[1] == found[2] and records[0] == records[1] == records[2]
    shards = {f.split("-")[1] for f, _, _ in found[0]}
    assert len(shards) > 20 and sum(n for _, n, _ in found[0]) == 20_000
    assert max(n for _, n, _ in found[0]) < 20_000 / 20  # neither the rows without id nor the repeated row share a task
    got = warc.read(spark, path).select("page_id", "url", F.decode("payload", "utf-8").alias("html"), "record_type", "refers_to").collect()
    rows = [(r["page_id"], r["url"], r["html"] or "") for r in pages.collect()]
    assert collections.Counter((r["page_id"], r["url"]) for r in got) == collections.Counter(r[:2] for r in rows)
    first = {}
    for page, _, html in rows:
        if page is not None:
            first[html] = min(page, first.get(html, page))
    want = collections.Counter(
        (p, u, h, "response", None) if p is None or p == first[h] else (p, u, None, "revisit", first[h]) for p, u, h in rows
    )
    assert collections.Counter(tuple(r) for r in got) == want


def test_text_ids_and_extra_columns(spark):
    rows = [("b", "u", "one", 1), ("a", "u", "one", 2), (None, None, None, 3), ("é", "u", "two", 4), ("\U0001f600", "u", "two", 5), ("￿", "u", "two", 6)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string, shard int")
    path = new_path(spark)
    assert warc.write(pages, path, shard_bytes=1).count() == 6  # a shard a record
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.read(spark, path, id_type="string").collect()}
    assert got == {"a": ("response", None), "b": ("revisit", "a"), None: ("response", None), "é": ("response", None),
                   "￿": ("revisit", "é"), "\U0001f600": ("revisit", "é")}


def _best(ids, vectors, query, own, k):
    order = sorted((-int(v @ query), i) for i, v in zip(ids, vectors) if i != own)
    return [(i, -s) for s, i in order[:k]]


def test_queries_leave_when_their_own_proof_holds():
    """Some queries read few postings, others nearly all; what each keeps holds its true best."""
    rng = np.random.default_rng(5)
    ids = np.arange(2000)
    vectors = rng.integers(-40, 40, (2000, 16))
    vectors[:40] *= 100  # large impacts in few dimensions decide most queries early
    asked = np.vstack([vectors[:20], rng.integers(-3, 3, (20, 16))]).astype(np.int64)
    level = np.frexp(np.abs(vectors).astype(float))[1]
    postings = []
    for at in np.unique(level[vectors != 0])[::-1]:
        row, dim = np.nonzero((level == at) & (vectors != 0))
        postings.append((int(at), row, dim, vectors[row, dim]))
    members, reads = topk._members(postings, ids, asked, np.full(40, -1), 5)
    for q, places in enumerate(members):
        assert {i for i, _ in _best(ids, vectors, asked[q], -1, 5)} <= set(places.tolist())
    assert reads.min() < reads.max() <= (vectors != 0).sum()


@pytest.mark.parametrize("part, rows, block", [(7, 3, 50), (32768, 512, 8192)])
def test_parts_of_queries_and_blocks(spark, monkeypatch, part, rows, block):
    monkeypatch.setattr(topk, "QUERY_PART", part)
    monkeypatch.setattr(topk, "QUERY_ROWS", rows)
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    rng = np.random.default_rng(6)
    vectors = rng.integers(-9, 9, (400, 6))
    vectors[100:200] = vectors[3]  # ties
    df = spark.createDataFrame([(i, [int(x) for x in v]) for i, v in enumerate(vectors)], "id long, values array<long>")
    got = collections.defaultdict(list)
    for r in topk.top_k(df, df.where("id % 8 = 3").withColumnRenamed("id", "query_id"), 5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["id"], r["score"]))
    assert dict(got) == {q: _best(range(400), vectors, vectors[q], q, 5) for q in range(3, 400, 8)}
