"""Quality classifier by co-training on two views of a document.

One view sees the words of the text, the other the page's metadata: source, language, length, lines and how its characters
divide.  Both are logistic regressions that start from the labelled documents; in each round each view labels those of all
unlabelled documents that it is surest of, for the other to learn from.  Labelled documents that no view learned from
calibrate the two scores, whose log-odds are then averaged.  All documents are scored, whole.

Only the labelled sample is bounded (``LABELLED`` ids, the first by a hash of the id) and reaches the driver.  Unlabelled
documents stay on Spark as features: in each round a histogram of their scores gives the limits of the confident share, what
passes them is stored, and each gradient step adds up the slopes of the stored rows, an array of fixed size per task.  A model
is an array of fixed size that travels with the tasks.
"""

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tradeloom.materialize import materialize

LABELLED = 5_000
TEXT_FEATURES, META_FEATURES = 1 << 15, 1 << 10
ROUNDS, SHARE = 4, 0.05  # each round, each view labels this share of the unlabelled documents
STEPS, RATE, DECAY = 40, 0.5, 1e-4
HELD_OUT = 5  # one labelled document in so many calibrates
FACTS = 8  # metadata of a document
BINS_PER_UNIT, FARTHEST = 512, 30  # of the histogram of log-odds
SLICE_ROWS, SLICE_WORDS = 250, 1 << 18  # of a block of stored documents
WORDS_PER_TASK = 1 << 22  # of the taught documents, in each gradient step: fewer would not pay for the start of a task
SLOPES, GROUPS = 32, 16  # more slopes than that are added up in groups before they reach the driver


def word_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and how often they occur; empty for a text without words."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    return np.unique(np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % TEXT_FEATURES, return_counts=True)


def text_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and their damped counts, of length one."""
    places, counts = word_counts(text)
    values = np.log1p(counts)
    return places, values / max(np.sqrt((values**2).sum()), 1e-12)


def meta_features(text: str | None, lang, source) -> tuple[np.ndarray, np.ndarray]:
    """Hashed metadata: names, and bins of length, lines and shares of kinds of characters."""
    text = text or ""
    n, lines, words = max(len(text), 1), text.count("\n") + 1, text.count(" ") + 1
    encoded = text.encode("utf-8", "surrogatepass")
    letters, upper = len(encoded.translate(None, _NOT_LETTERS)), len(encoded.translate(None, _NOT_UPPER))
    facts = (
        f"source={source}", f"lang={lang}", f"length={n.bit_length() - 1}", f"lines={lines.bit_length() - 1}",
        f"line={int(math.log2(n / lines))}", f"word={min(int(n / words), 20)}", f"letters={int(20 * min(letters / n, 1.0))}",
        f"upper={int(20 * upper / n)}",
    )
    places = np.array(sorted({zlib.crc32(f.encode()) % META_FEATURES for f in facts}), np.int64)  # few: no array work
    return places, np.full(len(places), 1 / np.sqrt(FACTS))


_NOT_LETTERS = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122 or b > 127))
_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)


class _View:
    """Sparse rows of one view and a logistic regression on them."""

    def __init__(self, places, values, sizes, width):
        # numbers of the kind that numpy counts by, so that no call converts them again
        self.place, self.value, self.width, self.count = places.astype(np.intp), values, width, len(sizes)
        self.row = np.repeat(np.arange(len(sizes)), sizes)
        self.weights, self.bias = np.zeros(width), 0.0

    def scores(self):
        return np.bincount(self.row, self.value * self.weights.take(self.place), self.count) + self.bias

    def start(self):
        self.squared, self.squared_bias = np.full(self.width, 1e-8), 1e-8

    def slope(self, target, weight):
        """Sums of the errors over all rows by weight, and of the bias."""
        error = weight * (_chance(self.scores()) - target)
        return np.bincount(self.place, self.value * error.take(self.row), self.width), error.sum()

    def step(self, slope, slope_bias):
        """A gradient step with a rate per weight."""
        slope = slope + DECAY * self.weights
        self.squared += slope**2
        self.squared_bias += slope_bias**2
        self.weights = self.weights - RATE * slope / np.sqrt(self.squared)
        self.bias -= RATE * slope_bias / np.sqrt(self.squared_bias)


def _chance(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _calibrated(z, target):
    """Slope and shift that make the scores log-odds of the held-out labels (Newton steps, damped)."""
    a, b = 1.0, 0.0
    if len(np.unique(target)) < 2:
        return a, b
    for _ in range(50):
        p = _chance(a * z + b)
        w = p * (1 - p) + 1e-6
        slope = np.array([((p - target) * z).sum() + 1e-3 * (a - 1), (p - target).sum()])
        bend = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum()]])
        a, b = np.array([a, b]) - np.linalg.solve(bend, slope)
    return float(a), float(b)


#: A block of documents in one row: keys, then sizes, places and values of the text view, sizes and places of the metadata.
_POOL = "n long, keys binary, sizes binary, places binary, numbers binary, fact_sizes binary, facts binary"
_TAUGHT = "view int, n long, labels binary, sizes binary, places binary, numbers binary"


def _one_row(names, *values):
    arrays = [pa.array([v], pa.int32() if n == "view" else pa.int64()) if isinstance(v, int) else pa.array([v.tobytes()], pa.binary()) for n, v in zip(names, values)]
    return pa.RecordBatch.from_arrays(arrays, names)


def _names(schema):
    return [column.split()[0] for column in schema.split(", ")]


def _packed(batches):
    """Features of unlabelled documents as blocks, so that a block is unpacked at once however often it is read."""
    keys, words, facts, held = [], [], [], 0

    def block():
        sizes, fact_sizes = (np.array([len(r[0]) for r in rows], "<u4") for rows in (words, facts))
        places, numbers = (np.concatenate([r[i] for r in words]).astype(kind) for i, kind in enumerate(("<u2", "<f4")))
        return _one_row(_names(_POOL), len(keys), np.array(keys, "<i8"), sizes, places, numbers, fact_sizes, np.concatenate([r[0] for r in facts]).astype("<u2"))

    for batch in batches:
        for key, text, lang, source in zip(*(batch.column(c) for c in ("_key", "text", "lang", "source"))):
            text = text.as_py()
            keys.append(key.as_py())
            words.append(text_features(text))
            facts.append(meta_features(text, lang.as_py(), source.as_py()))
            held += len(words[-1][0])
            if len(keys) == SLICE_ROWS or held > SLICE_WORDS:
                yield block()
                keys, words, facts, held = [], [], [], 0
    if keys:
        yield block()


def _blocks(batches):
    """The columns of each block: numbers as they are, bytes for :func:`_array`."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}


def _array(block, name):
    return np.frombuffer(block[name], {"keys": "<i8", "labels": "u1", "numbers": "<f4"}.get(name, "<u4" if name.endswith("sizes") else "<u2"))


def _rows_of(block, k):
    """Places, values and sizes of the rows of one view."""
    if k == 0:
        return _array(block, "places"), _array(block, "numbers"), _array(block, "sizes")
    facts = _array(block, "facts")
    return facts, np.full(len(facts), 1 / np.sqrt(FACTS)), _array(block, "fact_sizes")


def _view(k, rows, model):
    view = _View(*rows, (TEXT_FEATURES, META_FEATURES)[k])
    view.weights, view.bias = model
    return view


def _bins(z):
    return np.floor((np.clip(z, -FARTHEST, FARTHEST) + FARTHEST) * BINS_PER_UNIT).astype(np.int64)


def _draws(keys, turn):
    """Reproducible numbers in [0, 1), new in each round."""
    x = keys.view(np.uint64) + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(2**53)


def _limits(histogram, bad, good):
    """Lowest and highest bins: the last of each, and the share of it that counts."""

    def edge(counts, wanted):
        total = np.cumsum(counts)
        if wanted <= 0 or not total[-1]:
            return -1, 0.0
        at = int(np.searchsorted(total, min(wanted, total[-1])))
        return at, float((min(wanted, total[-1]) - (total[at] - counts[at])) / counts[at])

    low, high = edge(histogram, bad), edge(histogram[::-1], good)
    return *low, len(histogram) - 1 - high[0], high[1]


def _judged(z, draw, limits):
    """1 and 0 for what passes the limits, else -1; rows of an edge bin count by their draw."""
    low, low_share, high, high_share = limits
    bins = _bins(z)
    good = (bins > high) | ((bins == high) & (draw >= 1 - high_share))
    bad = (bins < low) | ((bins == low) & (draw < low_share))
    return np.where(good, 1, np.where(bad, 0, -1))


class _Unlabelled:
    """All unlabelled documents, and those that a view taught the other."""

    def __init__(self, rows: DataFrame):
        self.rows, self.count = rows, rows.agg(F.sum("n")).first()[0] or 0
        self.rounds, self.tables, self.words, self.taught = [], None, 0, [0, 0]

    def teach(self, views, share):
        """Each view labels the rows that it is surest of and that it has not labelled yet."""
        models, past = [(v.weights, v.bias) for v in views], list(self.rounds)
        take = int(SHARE * self.count)
        if not take:
            return

        def free(block, k, rows):
            """Log-odds by view ``k`` and which rows it has not labelled."""
            view, open_ = _view(k, rows, models[k]), np.ones(block["n"], bool)
            z = view.scores()
            for turn, (old, limits) in enumerate(past):
                view.weights, view.bias = old[k]
                open_ &= _judged(view.scores(), _draws(_array(block, "keys"), turn), limits[k]) < 0
            return z, open_

        def count(batches):
            total = np.zeros((2, 2 * FARTHEST * BINS_PER_UNIT + 1), np.int64)
            for block in _blocks(batches):
                for k in range(2):
                    z, open_ = free(block, k, _rows_of(block, k))
                    total[k] += np.bincount(_bins(z[open_]), minlength=total.shape[1])
            k, at = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(total[k, at])], ["k", "bin", "n"])

        cells = self.rows.mapInArrow(count, "k int, bin int, n long").groupBy("k", "bin").agg(F.sum("n").alias("n")).toArrow()
        histogram = np.zeros((2, 2 * FARTHEST * BINS_PER_UNIT + 1), np.int64)
        histogram[cells.column("k").to_numpy(), cells.column("bin").to_numpy()] = cells.column("n").to_numpy()
        limits = [_limits(h, round(take * (1 - share)), round(take * share)) for h in histogram]

        def pick(batches):
            chosen = [], []  # labels, sizes, places and values for each view to learn from

            def taught(k):
                parts = [np.concatenate(x) for x in zip(*chosen[k])]
                chosen[k].clear()
                return _one_row(_names(_TAUGHT), k, len(parts[0]), *(x.astype(kind) for x, kind in zip(parts, ("u1", "<u4", "<u2", "<f4"))))

            for block in _blocks(batches):
                draw, rows = _draws(_array(block, "keys"), len(past)), [_rows_of(block, k) for k in range(2)]
                for k in range(2):
                    z, open_ = free(block, k, rows[k])
                    label = np.where(open_, _judged(z, draw, limits[k]), -1)
                    place, value, sizes = rows[1 - k]
                    own = np.repeat(label >= 0, sizes)
                    if (label >= 0).any():
                        chosen[1 - k].append((label[label >= 0], sizes[label >= 0], place[own], value[own]))
                    if sum(len(x[2]) for x in chosen[1 - k]) > SLICE_WORDS:
                        yield taught(1 - k)
            for k in range(2):
                if chosen[k]:
                    yield taught(k)

        new = materialize(self.rows.mapInArrow(pick, _TAUGHT))
        for row in new.groupBy("view").agg(F.sum("n").alias("n"), F.sum(F.octet_length("places")).alias("bytes")).collect():
            self.taught[row["view"]] += row["n"]
            self.words += row["bytes"] // 2
        self.tables = new if self.tables is None else self.tables.unionByName(new)
        self.rounds.append((models, limits))

    def slopes(self, views):
        """Sums of the errors of each view over the rows that the other taught it."""
        widths = [v.width for v in views]
        if self.tables is None:
            return [(np.zeros(w), 0.0) for w in widths]
        models = [(v.weights, v.bias) for v in views]

        def run(batches):
            total = [np.zeros(w + 1) for w in widths]
            for block in _blocks(batches):
                k = block["view"]
                view = _view(k, (_array(block, "places"), _array(block, "numbers"), _array(block, "sizes")), models[k])
                slope, bias = view.slope(_array(block, "labels").astype(float), np.ones(block["n"]))
                total[k][:-1] += slope
                total[k][-1] += bias
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % GROUPS], pa.int32()),
                                              pa.array([np.concatenate(total).tobytes()], pa.binary())], ["part", "sums"])

        def add(batches):
            total = {}
            for batch in batches:
                for part, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    total[part] = total.get(part, 0.0) + np.frombuffer(sums)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["part", "sums"])

        tasks = max(-(-self.words // WORDS_PER_TASK), 1)  # by what they read, however many files each round left
        parts = self.tables.coalesce(tasks).mapInArrow(run, "part int, sums binary")
        if tasks > SLOPES:
            parts = parts.repartition(GROUPS, "part").mapInArrow(add, "part int, sums binary")
        total = np.zeros(sum(widths) + 2)
        for sums in parts.toArrow().column("sums").to_pylist():
            total += np.frombuffer(sums)
        text, meta = total[: widths[0] + 1], total[widths[0] + 1 :]
        return [(text[:-1], text[-1]), (meta[:-1], meta[-1])]


def co_train(text_rows, meta_rows, labels: np.ndarray, held_out: np.ndarray, unlabelled: _Unlabelled):
    """Fitted views and their calibrations; rows of labelled documents are ``(places, values, sizes)``."""
    views = [_View(*text_rows, TEXT_FEATURES), _View(*meta_rows, META_FEATURES)]
    weight, target = (~held_out).astype(float), labels.astype(float)
    for turn in range(ROUNDS + 1 if weight.any() else 0):
        for view in views:
            view.start()
        for _ in range(STEPS):
            more = unlabelled.slopes(views)
            for view, (slope, bias), taught in zip(views, more, unlabelled.taught):
                own, own_bias = view.slope(target, weight)
                total = weight.sum() + taught
                view.step((own + slope) / total, (own_bias + bias) / total)
        if turn < ROUNDS:  # what a view is surest of teaches the other
            unlabelled.teach(views, labels[~held_out].mean())
    scales = [_calibrated(v.scores()[held_out], target[held_out]) for v in views]
    return [(v.weights, v.bias, *s) for v, s in zip(views, scales)]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", labelled: int = LABELLED):
    """Fit both views.  Null labels and their ids are left out; of several labels of an id the smallest counts,
    of several rows of a labelled id the first by text, language and source.

    Every other row is unlabelled: those whose id has no label, those whose label lies beyond the bound, and those without id.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(
        F.min(label).cast("int").alias("_label"))
    chosen = F.broadcast(materialize(known.orderBy(F.xxhash64("_id"), "_id").limit(labelled)))  # at most ``labelled`` rows
    every = docs.select(F.col(id_col).alias("_id"), "text", "lang", "source")
    # one row per chosen id, so that a repeated id counts once and its rows stay on Spark
    rows = every.join(chosen, "_id").groupBy("_id", "_label").agg(F.min(F.struct("text", "lang", "source")).alias("_row"))
    rows = rows.select("_id", "_label", "_row.*")
    rows = rows.withColumn("_check", F.crc32(F.col("_id").cast("string")) % HELD_OUT == 0)

    def features(batches):
        for batch in batches:
            texts, langs, sources = (batch.column(c).to_pylist() for c in ("text", "lang", "source"))
            of_text = [text_features(t) for t in texts]
            of_meta = [meta_features(*x) for x in zip(texts, langs, sources)]
            columns = [batch.column("_id"), batch.column("_label"), batch.column("_check")]
            columns += [pa.array([r[0].astype(np.int32) for r in x], pa.list_(pa.int32())) for x in (of_text, of_meta)]
            columns += [pa.array([r[1].astype(np.float32) for r in x], pa.list_(pa.float32())) for x in (of_text, of_meta)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "label", "held", "tp", "mp", "tv", "mv"])

    kind = docs.schema[id_col].dataType.simpleString()
    table = rows.mapInArrow(features, f"id {kind}, label int, held boolean, tp array<int>, mp array<int>, tv array<float>, mv array<float>")
    found = table.orderBy("id", F.xxhash64("tp")).toArrow()

    def flat(places, values):
        lists = found.column(places).combine_chunks(), found.column(values).combine_chunks()
        sizes = np.diff(lists[0].offsets.to_numpy())
        return lists[0].flatten().to_numpy(), lists[1].flatten().to_numpy(), sizes

    # the few chosen ids go to the rows, so no row moves; a null id matches none of them
    free = every.join(chosen, "_id", "left_anti").withColumn("_key", F.xxhash64("_id", "text"))
    free = free.drop("_id").mapInArrow(_packed, _POOL)
    labels_of, held = found.column("label").to_numpy(), found.column("held").to_numpy(zero_copy_only=False)
    return co_train(flat("tp", "tv"), flat("mp", "mv"), labels_of, held.astype(bool), _Unlabelled(materialize(free)))


def score(docs: DataFrame, models, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Add ``text_score``, ``meta_score``, ``score`` (chance of label 1 by both) and ``label_pred`` (0 or 1).

    Null and empty texts are scored by their metadata and the text view's bias.  Without labels all scores are 0.5 and
    the prediction is 1, so nothing is rejected.  Columns of the added names are replaced.
    """
    added = ("text_score", "meta_score", "score", "label_pred")
    kept = docs.drop(*added)
    at = [kept.columns.index(c) for c in (text, lang, source)]
    names = kept.columns

    def run(batches):
        for batch in batches:
            odds = np.empty((2, batch.num_rows))
            for i, (body, language, origin) in enumerate(zip(*(batch.column(c) for c in at))):
                body = body.as_py()
                rows = text_features(body), meta_features(body, language.as_py(), origin.as_py())
                for k, ((place, value), (weights, bias, slope, shift)) in enumerate(zip(rows, models)):
                    odds[k, i] = slope * ((weights[place] * value).sum() + bias) + shift
            both = odds.mean(0)
            values = [pa.array(_chance(x)) for x in (*odds, both)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *values, pa.array((both >= 0).astype(np.int32))], [*names, *added])

    kinds = [DoubleType()] * 3 + [IntegerType()]
    schema = StructType([*kept.schema.fields, *(StructField(n, k) for n, k in zip(added, kinds))])
    return kept.mapInArrow(run, schema)
