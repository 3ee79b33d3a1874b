"""Comparisons of many sets in one task hold neither all sizes nor all pairs."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_near_copies import edited_copies, lowest_linked
from tests.llm.test_operators import docs_of, near_copies
from tradeloom.llm import jaccard


def groups_of_sets(count, alike, rng):
    """Sets of about 90 hashes; ``alike`` neighbours share most of them, all share a few."""
    pool = np.unique(rng.integers(0, 2**64, 100 * (count // alike + 1), dtype=np.uint64))
    for i in range(count):
        own = pool[100 * (i // alike) :][: int(rng.integers(70, 100))]
        yield np.unique(np.concatenate([own, pool[-5:], rng.choice(pool, 3)]))


def brute(arrays, percent):
    found = set()
    for i, x in enumerate(arrays):
        for k in range(i + 1, len(arrays)):
            common = len(np.intersect1d(x, arrays[k], assume_unique=True))
            if 100 * common >= percent * (len(x) + len(arrays[k]) - common):
                found.add((i, k))
    return found


@pytest.mark.parametrize("settings", [{}, {"HELD_PAIRS": 64}, {"HELD_PAIRS": 64, "BIT_COLUMNS": 64, "COMMON": 2}, {"COMMON": 10_000}])
def test_links_in_blocks_equal_brute_force(monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(jaccard, name, value)
    arrays = list(groups_of_sets(130, 6, np.random.default_rng(5)))
    sizes = np.array([len(x) for x in arrays])
    found = [(int(a), int(b)) for some in jaccard._links(sizes, arrays, 80) for a, b in zip(*some)]
    assert len(found) == len(set(found)) and set(found) == brute(arrays, 80) and found


def test_memory_of_links_does_not_grow_with_the_square():
    arrays = list(groups_of_sets(4000, 7, np.random.default_rng(6)))
    sizes = np.array([len(x) for x in arrays])
    tracemalloc.start()
    links = sum(len(a) for a, _ in jaccard._links(sizes, arrays, 80))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert links > 1000 and peak < 100e6  # a matrix of all sizes alone is 128 MB


def test_pairs_that_may_link_come_some_at_a_time(monkeypatch):
    monkeypatch.setattr(jaccard, "HELD_PAIRS", 300)
    sketches = [jaccard._sketch(np.arange(64, dtype=np.uint64))] * 200
    some = list(jaccard._may_link(np.full(200, 64), sketches, 80))
    assert sum(len(a) for a, _ in some) == 200 * 199 // 2 and max(len(a) for a, _ in some) < 500


def test_blocks_of_pairs_connect_what_all_pairs_connect(monkeypatch):
    monkeypatch.setattr(jaccard, "HELD_PAIRS", 50)
    arrays = list(groups_of_sets(90, 9, np.random.default_rng(7)))
    rows = pa.RecordBatch.from_arrays([
        pa.array([1] * 90, pa.int64()), pa.array(range(89, -1, -1), pa.int64()), pa.array([2] * 90, pa.int32()),
        pa.array([len(x) for x in arrays], pa.int64()), pa.array([x.view(np.int64) for x in arrays], pa.list_(pa.int64())),
    ], ["group", "id", "side", "n", "values"])
    got = [x for batch in jaccard._connected(lambda n, x: jaccard._links(n, x, 80))([rows]) for x in batch.to_pylist()]
    label = {i: i for i in range(90)}
    for _ in range(90):
        for a, b in brute(arrays, 80):
            label[89 - a] = label[89 - b] = min(label[89 - a], label[89 - b])
    assert {x["a"]: x["b"] for x in got} == {k: v for k, v in label.items() if k != v}


def test_join_with_blocks_of_few_sets_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 3)
    rows = near_copies()[::3] + [(10_000 + r[0], *r[1:]) for r in edited_copies()]
    label, _ = lowest_linked(rows, 5, 80)
    assert {r["id"]: r["component_id"] for r in jaccard.join(docs_of(spark, rows), words=5, percent=80).collect()} == label
