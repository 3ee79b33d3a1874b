"""Fill-in-middle cuts against a regular expression, and the way back."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.test_oracle import SF
from tradeloom.llm import infill
from tradeloom.llm.queries import QUERIES

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def expected(doc_id, text, seed=42):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    one, two, kind, order = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    low, high = sorted((one % (len(units) + 1), two % (len(units) + 1)))
    p, m, s = ("".join(units[a:b]) for a, b in ((0, low), (low, high), (high, None)))
    if not text or re.search("<[PSM]>", text) or kind % 100 >= 50:
        return len(units), "plain", None, None, text
    if order % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([" ", "\n", "\x0b", "a", "é", "\U0001f600", "\x85", "\xa0", "word", "b" * 70, " " * 70, "long " * 40]), max_size=40))
def test_every_cut_equals_the_expression(parts):
    text = "".join(parts)
    data, units = text.encode(), UNIT.findall(text)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(infill, "MOST", 100)  # words and white space run over chunks
        counted = infill.Counted(data, {})
    assert counted.units == len(units)
    for n in range(len(units) + 1):
        head = "".join(units[:n])
        assert counted.cut(n) == (len(head.encode()), len(head))


def test_chunks_follow_the_content(monkeypatch):
    rng = np.random.default_rng(4)
    shared = rng.integers(97, 123, 20_000, np.uint8).tobytes()
    ends = infill.chunk_ends(shared)
    assert ends[-1] == len(shared) and max(np.diff([0, *ends])) <= infill.MOST and len(ends) > 10
    moved = [e - 777 for e in infill.chunk_ends(b"x" * 777 + shared)]
    assert len(set(moved) & set(ends)) > 0.8 * len(ends)  # a passage shares its chunks wherever it stands
    monkeypatch.setattr(infill, "SLICE", 1000)
    assert infill.chunk_ends(shared) == ends
    assert infill.chunk_ends(b"") == [] and infill.chunk_ends(b"a") == [1]


def test_a_shared_chunk_is_summarised_once_and_a_full_cache_changes_nothing(monkeypatch):
    text = b"some words in a passage that all of them hold " * 2000
    calls = []
    plain = infill.summary
    monkeypatch.setattr(infill, "summary", lambda chunk: calls.append(chunk) or plain(chunk))
    cache = {}
    first = infill.Counted(text, cache)
    seen = len(calls)
    assert infill.Counted(text, cache).words == first.words and len(calls) == seen
    monkeypatch.setattr(infill, "CACHE", 2)
    assert infill.Counted(text, {}).words == first.words


def test_rows(spark):
    rows = [(i, f"word{i} " * (i % 9) + "end" + " " * (i % 3)) for i in range(200)]
    rows += [(500, None), (501, ""), (502, " \n "), (None, "no id at all here"), (503, "has <M> inside"), (1, "again"), (1, "again"),
             (504, "lorem ipsum  dolor\t" * 40_000), (505, "x" * 300_000), (506, "\x00 é \U0001f600 <P <S>"[:-1]), (507, "<P")]
    df = spark.createDataFrame([(*r, "old", "kept") for r in rows], "doc_id long, text string, form string, parts string").repartition(3)
    got = infill.transform(df).withColumn("again", infill.restored(infill.F.col("output"), infill.F.col("form"))).collect()
    assert len(got) == len(rows) and all(r["again"] == (r["text"] or "") and r["parts"] == "kept" for r in got)
    key = lambda r: tuple(str(x) for x in r)
    want = [(i, t, *expected(i, t)) for i, t in rows]
    assert sorted(((r["doc_id"], r["text"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got), key=key) == sorted(want, key=key)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    none = infill.transform(df.limit(0))
    assert none.count() == 0 and none.columns == ["doc_id", "text", "parts", "n", "form", "prefix_chars", "middle_chars", "output"]


def test_query_over_whole_texts(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = QUERIES["op12_fill_in_middle"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        n, form, prefix, middle, output = expected(r["doc_id"], texts[r["doc_id"]])
        assert tuple(r) == (r["doc_id"], n, form, prefix, middle, sha(output), sha(texts[r["doc_id"]] or ""))
