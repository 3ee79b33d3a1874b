"""Each stage of the pipeline on what its predecessor kept."""

import re

import corpus_pipeline
from tests.llm.test_operators import SECRETS, brute_spans, docs_of
from tradeloom.llm import langid
from tradeloom.materialize import materialize


def test_stages(spark):
    words = "the house and the garden are green and the river is near the old stone bridge of this town".split()
    rows = [(i, " ".join(words[(i * 7 + j * (i % 5 + 1)) % len(words)] + str(i * (j % 3 == 0)) for j in range(30)), "en", f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s0") for i in range(10)]  # copies
    rows += [(200 + i, f"{' '.join(rows[20 + i][1].split()[::-1])} number{i} {t}", "en", "s1") for i, t in enumerate(SECRETS) if t and len(t) < 200]
    rows += [(300, None, "en", "s2"), (301, "123 456", "en", "s2")]
    docs = docs_of(spark, rows)
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], "")))
    assert all(x.columns == docs.columns for x in out[:-1])
    ids = [{r["doc_id"] for r in x.collect()} for x in out]
    assert ids[1] == ids[0] - {300, 301} and langid.UNKNOWN == "und"
    assert ids[2] == ids[1] - {100 + i for i in range(10)}
    assert ids[3] == ids[2]
    texts = {r["doc_id"]: r["text"] for r in out[3].collect()}
    before = {r["doc_id"]: r["text"] for r in out[2].collect()}
    for key, text in texts.items():
        assert not brute_spans(text) and (text == before[key] or brute_spans(before[key]) or "[SECRET]" in text)
        assert re.sub(r"\s", "", text)
    copies = [r["doc_id"] for r in out[4].collect()]
    assert set(copies) <= ids[3] and max(copies.count(k) for k in set(copies)) <= 2
    pieces = out[5].collect()
    assert sorted(r["doc_id"] for r in pieces if r["piece"] == 0) == sorted(copies)
    used = {}
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0)
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(used.values()) <= 1024
