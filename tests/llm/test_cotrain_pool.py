"""Co-training sees every unlabelled document."""

import zlib

import numpy as np
import pytest

from tests.llm.test_operators import docs_of
from tradeloom.llm import cotrain


def test_limits_take_the_wanted_rows():
    rng = np.random.default_rng(15)
    z, draw = np.concatenate([rng.normal(0, 3, 5000), np.full(5000, 1.0)]), rng.random(10_000)
    histogram = np.bincount(cotrain._bins(z), minlength=2 * cotrain.FARTHEST * cotrain.BINS_PER_UNIT + 1)
    for bad, good in ((300, 200), (4000, 4000), (0, 50), (5000, 5000)):
        label = cotrain._judged(z, draw, cotrain._limits(histogram, bad, good))
        assert abs((label == 0).sum() - bad) <= 150 and abs((label == 1).sum() - good) <= 150
        if bad < 4000:
            assert bad == 0 or z[label == 0].max() <= np.sort(z)[bad] + 1 / cotrain.BINS_PER_UNIT


@pytest.mark.parametrize("slopes", [32, 0])
def test_share_of_all_unlabelled_documents_teaches(spark, monkeypatch, slopes):
    monkeypatch.setattr(cotrain, "STEPS", 3)
    monkeypatch.setattr(cotrain, "SLOPES", slopes)
    rng = np.random.default_rng(16)
    good, bad = [f"good{i}" for i in range(300)], [f"bad{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(good if i % 3 else bad, 12)), "en", f"s{i % 3}") for i in range(12_000)]
    rows += [(None, "good1 good2", "en", "s1")] * 10
    labels = spark.createDataFrame([(i, int(bool(i % 3))) for i in range(300)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(cotrain, "_calibrated", lambda z, target: seen.append(pools[0]) or (1.0, 0.0))
    pools, make = [], cotrain._Unlabelled
    monkeypatch.setattr(cotrain, "_Unlabelled", lambda rows: pools.append(make(rows)) or pools[-1])
    cotrain.fit(docs_of(spark, rows), labels)
    pool = seen[0]
    assert pool.count == 11_710
    wanted = cotrain.ROUNDS * int(cotrain.SHARE * pool.count)  # 5,000 documents would give 1,000
    assert all(abs(n - wanted) <= 0.1 * wanted for n in pool.taught) and wanted > 2000


def test_repeated_labelled_id_is_one_row(spark, monkeypatch):
    rows = [(i, f"word{i} text", "en", "a") for i in range(20)] + [(3, f"another {j}", "en", "b") for j in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, quality int")
    seen = {}
    monkeypatch.setattr(cotrain, "co_train", lambda text, meta, labels, held, pool: seen.update(labels=labels, sizes=text[2], pool=pool.count))
    cotrain.fit(docs_of(spark, rows), labels)
    assert len(seen["labels"]) == len(seen["sizes"]) == 10 and seen["pool"] == 10


def test_labels_beyond_the_bound_are_unlabelled(spark, monkeypatch):
    rows = [(i, f"word{i} text", "en", "a") for i in range(50)] + [(None, "no id", "en", "a")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    seen = {}
    monkeypatch.setattr(cotrain, "co_train", lambda text, meta, labels, held, pool: seen.update(labels=labels, pool=pool.count))
    cotrain.fit(docs_of(spark, rows), labels, labelled=12)
    assert len(seen["labels"]) == 12 and seen["pool"] + 12 == len(rows)


def plain(docs, labels, steps):
    """Co-training on dense rows: ``docs`` are (id, text, lang, source, key)."""
    widths = cotrain.TEXT_FEATURES, cotrain.META_FEATURES
    views = [np.zeros((len(docs), w)) for w in widths]
    for i, (_, text, lang, source, _) in enumerate(docs):
        for view, (place, value) in zip(views, (cotrain.text_features(text), cotrain.meta_features(text, lang, source))):
            view[i, place] = value
    own = np.array([d[0] in labels for d in docs])
    held = own & np.array([zlib.crc32(str(d[0]).encode()) % 5 == 0 for d in docs])
    target = np.array([labels.get(d[0], 0) for d in docs], float)
    keys = np.array([d[4] for d in docs])
    given = [np.full(len(docs), -1) for _ in views]  # what view k was taught
    said = [np.full(len(docs), -1) for _ in views]  # what view k has labelled
    models = [(np.zeros(w), 0.0) for w in widths]
    for turn in range(cotrain.ROUNDS + 1):
        for k, view in enumerate(views):
            weights, bias = models[k]
            squared, squared_bias = np.full(widths[k], 1e-8), 1e-8
            learned = (own & ~held) | (given[k] >= 0)
            wanted = np.where(given[k] >= 0, given[k], target)
            for _ in range(steps):
                error = learned * (1 / (1 + np.exp(-(view @ weights + bias))) - wanted)
                slope, slope_bias = view.T @ error / learned.sum() + cotrain.DECAY * weights, error.sum() / learned.sum()
                squared, squared_bias = squared + slope**2, squared_bias + slope_bias**2
                weights = weights - cotrain.RATE * slope / np.sqrt(squared)
                bias = bias - cotrain.RATE * slope_bias / np.sqrt(squared_bias)
            models[k] = weights, bias
        if turn < cotrain.ROUNDS:
            take, share = int(cotrain.SHARE * (~own).sum()), target[own & ~held].mean()
            for k, view in enumerate(views):
                z, open_ = view @ models[k][0] + models[k][1], ~own & (said[k] < 0)
                histogram = np.bincount(cotrain._bins(z[open_]), minlength=2 * cotrain.FARTHEST * cotrain.BINS_PER_UNIT + 1)
                limits = cotrain._limits(histogram, round(take * (1 - share)), round(take * share))
                label = np.where(open_, cotrain._judged(z, cotrain._draws(keys, turn), limits), -1)
                said[k] = np.where(label >= 0, label, said[k])
                given[1 - k] = np.where(label >= 0, label, given[1 - k])
    return models


def test_models_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cotrain, "STEPS", 8)
    rng = np.random.default_rng(17)
    words = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(rng.choice(words[: 50] if i % 2 else words[30:], 9)), "en", f"s{(i + i // 7) % 2}") for i in range(400)]
    labels = {i: i % 2 for i in range(0, 90)}
    df = docs_of(spark, rows)
    keyed = df.selectExpr("doc_id", "text", "lang", "source", "xxhash64(doc_id, text)").collect()
    monkeypatch.setattr(cotrain, "_calibrated", lambda z, target: (1.0, 0.0))
    got = cotrain.fit(df, spark.createDataFrame(list(labels.items()), "doc_id long, quality int"))
    want = plain([tuple(r) for r in keyed], labels, 8)
    for (weights, bias, _, _), (expected, expected_bias) in zip(got, want):
        assert np.allclose(weights, expected, atol=1e-4) and abs(bias - expected_bias) < 1e-4


def test_metadata_features_encode_a_text_once_and_keep_their_places():
    class Text(str):
        encoded = 0

        def encode(self, *args):
            Text.encoded += 1
            return super().encode(*args)

    texts = ["", "a", "One two\nTHREE", "é" * 7 + " x", "\ud800 y", "w " * 1023, "w " * 1024, "line\n" * 64, "A" * 8191 + "\n" * 3]
    for text in texts:
        n, lines, words = max(len(text), 1), text.count("\n") + 1, text.count(" ") + 1
        raw = text.encode("utf-8", "surrogatepass")
        letters = sum(65 <= b <= 90 or 97 <= b <= 122 or b > 127 for b in raw)
        upper = sum(65 <= b <= 90 for b in raw)
        facts = ["source=s", "lang=None", f"length={int(np.log2(n))}", f"lines={int(np.log2(lines))}", f"line={int(np.log2(n / lines))}",
                 f"word={min(int(n / words), 20)}", f"letters={int(20 * min(letters / n, 1.0))}", f"upper={int(20 * upper / n)}"]
        places, values = cotrain.meta_features(Text(text), None, "s")
        assert places.tolist() == sorted({zlib.crc32(f.encode()) % cotrain.META_FEATURES for f in facts})
        assert (values == 1 / np.sqrt(cotrain.FACTS)).all() and len(values) == len(places)
    assert Text.encoded <= len(texts)


def test_a_step_takes_as_many_tasks_as_its_words_need(spark, monkeypatch):
    """Not one per stored file of each round; the sums are the same in any number of tasks."""
    rows = [(i, f"word{i} word{i % 7} text", "en", "a") for i in range(4_000)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    seen = {}
    monkeypatch.setattr(cotrain, "co_train", lambda text, meta, labels, held, pool: seen.update(rows=(text, meta), pool=pool))
    cotrain.fit(docs_of(spark, rows).repartition(16), labels)
    views = [cotrain._View(*r, w) for r, w in zip(seen["rows"], (cotrain.TEXT_FEATURES, cotrain.META_FEATURES))]
    for _ in range(3):
        seen["pool"].teach(views, 0.5)
    tracker, sums = spark.sparkContext.statusTracker(), []
    for words in (cotrain.WORDS_PER_TASK, seen["pool"].words // 3):
        monkeypatch.setattr(cotrain, "WORDS_PER_TASK", words)
        spark.sparkContext.setJobGroup(f"step {words}", "")
        sums.append(seen["pool"].slopes(views))
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(f"step {words}")]
        tasks = [tracker.getStageInfo(s).numTasks for j in jobs for s in j.stageIds]
        assert tasks == [1] if words > 1 << 20 else len(tasks) == 1 and 2 <= tasks[0] <= 4
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for (slope, bias), (other, other_bias) in zip(*sums):
        assert np.allclose(slope, other) and np.isclose(bias, other_bias) and np.abs(slope).sum() > 0
