"""Near copies at the figures of the pipeline's stage: runs of five words, similarity 0.8."""

import itertools
import re

import numpy as np

import corpus_pipeline
from tests.llm.test_operators import docs_of, near_copies
from tradeloom.llm import jaccard


def shingle_set(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def lowest_linked(rows, words, percent):
    """Brute force: smallest id that links reach, and the links."""
    sets = {r[0]: shingle_set(r[1], words) for r in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2)
             if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    label, moved = {k: k for k in sets}, True
    while moved:
        moved = False
        for a, b in links:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                moved = True
    return label, links


def edited_copies():
    rng = np.random.default_rng(12)
    words, rows = [f"w{i}" for i in range(2000)], []
    for i in range(8):
        text = [str(w) for w in rng.choice(words, 200)]
        rows.append((10 * i, " ".join(text), "en", "a"))
        rows.append((10 * i + 1, " ".join(text + [f"tail{i}x{j}" for j in range(23 + 3 * i)]), "en", "a"))
        scattered = list(text)
        for at in (30, 75, 120, 165):
            scattered[at] = f"edit{i}x{at}"
        rows.append((10 * i + 2, " ".join(scattered), "en", "a"))
        rows.append((10 * i + 3, " ".join(text[:100] + [f"far{i}x{j}" for j in range(100)]), "en", "a"))
    return rows


def test_join_at_the_stage_figures_equals_brute_force(spark):
    rows = near_copies()[::3] + [(10_000 + r[0], *r[1:]) for r in edited_copies()]
    label, links = lowest_linked(rows, 5, 80)
    got = {r["id"]: r["component_id"] for r in jaccard.join(docs_of(spark, rows), words=5, percent=80).collect()}
    assert got == label and len(links) > 100


def test_stage_drops_edited_copies(spark):
    rows = edited_copies()
    label, _ = lowest_linked(rows, 5, 80)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs_of(spark, rows), "").collect()}
    assert kept == {k for k in label if label[k] == k} == {r[0] for r in rows if r[0] % 10 in (0, 3)}
    strict, _ = lowest_linked(rows, 3, 90)
    assert len({k for k in strict if strict[k] == k}) > len(kept)  # the contract of op10 would keep some of them


def test_row_without_id_does_not_hide_its_copies(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(None, text), (5, text), (6, text + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r["id"]: r["component_id"] for r in jaccard.join(docs).collect()}
    assert got == {None: None, 5: 5, 6: 5}
    assert {r["doc_id"] for r in jaccard.dedup(docs).collect()} == {None, 5}


def test_different_texts_of_one_id_are_kept_apart(spark):
    """Nothing is lost under a repeated id, in the operator and in the stage; equal rows still count once."""
    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    rows = [(1, a, "en", "x"), (1, b, "en", "x"), (1, b, "en", "x"), (2, b, "en", "x"), (2, c, "en", "x"), (3, a + " tail", "en", "x"),
            (4, None, "en", "x"), (4, "", "en", "x"), (None, a, "en", "x")]
    docs = docs_of(spark, rows)
    want = sorted([("1", a), ("1", b), ("2", c), ("4", "None"), ("4", ""), ("None", a)])
    for kept in (jaccard.dedup(docs, words=5, percent=80), corpus_pipeline.drop_near_duplicates(spark, docs, "")):
        assert kept.columns == docs.columns
        assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept.collect()) == want


def test_equal_sets_are_compared_once_on_any_number_of_tasks(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(i, text, "en", "a") for i in range(3, 803)] + [(1000 + i, f"{text} x{i % 5}", "en", "a") for i in range(200)]
    rows += [(5000 + i, " ".join(f"z{i}y{j}" for j in range(50)), "en", "a") for i in range(20)]
    compared, dealt = [], jaccard._dealt
    monkeypatch.setattr(jaccard, "_dealt", lambda clusters, percent: compared.append(clusters.count()) or dealt(clusters, percent))
    for tasks in (4, 32):
        got = {r["id"]: r["component_id"] for r in jaccard.join(docs_of(spark, rows).repartition(tasks)).collect()}
        assert got == {r[0]: 3 if r[0] < 5000 else r[0] for r in rows}
    assert compared == [6, 6]
