"""Language identification by unigrams over pieces, summed over all segmentations.

A language is a distribution over the pieces of a fixed public vocabulary of byte strings.  The chance of a word is the sum
over every way to cut it into pieces, which a forward pass finds; a text is the product of its words.  Words are the
lower-cased runs of letters, each with a space before it; runs of more than ``CUT`` letters count as several words.

Training gathers every word of every learned document with its count per language (one shuffle of distinct words), then
runs expectation-maximisation: a forward-backward pass over the words gives the expected use of each piece.  The
model has at most one number per piece and language and travels with the tasks.  Words of one length are handled
together as arrays; a task scores a word once.
"""

import base64
import re

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tradeloom.materialize import materialize

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
CUT = 24
ROUNDS = 2
STRENGTH = 20.0  # weight of the distribution of all languages in each language's own, in pieces
FLOOR = 1e-3  # share of that distribution that is even over the vocabulary
UNKNOWN = "und"
_SCALE = 8.0  # probabilities are scaled by this per byte to stay in the range of doubles
_LEAST = 1e-300
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(rf"[^\W\d_]{{1,{CUT}}}")
_GAP = re.compile(r"[\W\d_]")
_SLICE, _CACHE, _CHUNK = 1 << 20, 300_000, 400_000


def _words(text: str):
    """Lists of words of slices that end between words, so that a long text is never held as one list."""
    text = text.lower()
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + _SLICE) if at + _SLICE < len(text) else None
        end = gap.start() if gap else len(text)
        yield _WORD.findall(text, at, end)
        at = end


class Pieces:
    """Finds the vocabulary's pieces at every place of many words at once."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            tokens = [base64.b64decode(line.split()[0]) for line in lines]
        self.size = len(tokens)
        self.longest = max(map(len, tokens))
        self.powers = np.ones(CUT * 4 + 2, np.uint64)
        np.multiply.accumulate(np.full(len(self.powers) - 1, _BASE), out=self.powers[1:])
        by_length: dict[int, list[int]] = {}
        for i, token in enumerate(tokens):
            by_length.setdefault(len(token), []).append(i)
        self.known = {}
        for n, ids in by_length.items():
            if n >= len(self.powers):
                continue
            codes = self._prefixes(np.frombuffer(b"".join(tokens[i] for i in ids), np.uint8).reshape(-1, n))[:, n]
            order = np.argsort(codes)
            self.known[n] = codes[order], np.asarray(ids, np.int32)[order]

    def _prefixes(self, letters):
        out = np.zeros((len(letters), letters.shape[1] + 1), np.uint64)
        for j in range(letters.shape[1]):
            out[:, j + 1] = out[:, j] * _BASE + letters[:, j].astype(np.uint64) + np.uint64(1)
        return out

    def groups(self, words: list[str]):
        """``(rows, n, table)`` for each byte length ``n``: ``table[i, l]`` are the piece ids at ``i`` of length ``l``."""
        coded = [b" " + w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        for n in np.unique(sizes):
            rows = np.flatnonzero(sizes == n)
            letters = np.frombuffer(b"".join([coded[r] for r in rows]), np.uint8).reshape(-1, n)
            prefix, table = self._prefixes(letters), {}
            for width, (codes, ids) in self.known.items():
                for i in range(n - width + 1):
                    code = prefix[:, i + width] - prefix[:, i] * self.powers[width]
                    place = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                    hit = codes[place] == code
                    if hit.any():
                        table[i, width] = np.where(hit, ids[place], self.size)
            yield rows, int(n), table


def _forward(table, n, chance, count):
    """``ahead[j]``: scaled chance of the first ``j`` bytes, summed over segmentations; ``chance(ids, width)``."""
    ahead = [None] * (n + 1)
    ahead[0] = np.ones(count)
    for j in range(1, n + 1):
        total = 0.0
        for i in range(j):
            if (i, j - i) in table:
                total = total + ahead[i] * chance(table[i, j - i], j - i)
        ahead[j] = total + np.zeros(count)
    return ahead


def _scaled(model):
    """Probabilities with an impossible piece appended."""
    return np.concatenate([model, np.zeros((len(model), 1))], axis=1)


def log_chances(words: list[str], pieces: Pieces, model: np.ndarray) -> np.ndarray:
    """ln P of each word in each language."""
    out, table_of = np.empty((len(words), len(model))), _scaled(model)
    for rows, n, table in pieces.groups(words):
        for k, chances in enumerate(table_of):
            ahead = _forward(table, n, lambda ids, width, c=chances: c[ids] * _SCALE**width, len(rows))
            out[rows, k] = np.log(ahead[n] + _LEAST) - n * np.log(_SCALE)
    return out


def expected_counts(words: list[str], counts: np.ndarray, pieces: Pieces, chances: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in words of one language."""
    out, chances = np.zeros(pieces.size + 1), np.append(chances, 0.0)
    for rows, n, table in pieces.groups(words):
        weight = {key: chances[ids] * _SCALE ** key[1] for key, ids in table.items()}
        ahead = [np.ones(len(rows))]
        for j in range(1, n + 1):
            ahead.append(sum((ahead[i] * weight[i, j - i] for i in range(j) if (i, j - i) in weight), np.zeros(len(rows))))
        behind = [None] * n + [np.ones(len(rows))]
        for i in range(n - 1, -1, -1):
            behind[i] = sum((behind[j] * weight[i, j - i] for j in range(i + 1, n + 1) if (i, j - i) in weight), np.zeros(len(rows)))
        share = counts[rows] / (ahead[n] + _LEAST)
        for (i, width), ids in table.items():
            out += np.bincount(ids, ahead[i] * weight[i, width] * behind[i + width] * share, pieces.size + 1)
    return out[:-1]


def word_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """``(lang, word, n)`` over all rows with a text and a language."""

    def gather(batches):
        held: dict[tuple[str, str], int] = {}

        def rows():
            return pa.RecordBatch.from_arrays([
                pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.string()),
                pa.array(list(held.values()), pa.int64()),
            ], ["lang", "word", "n"])

        for batch in batches:
            for language, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                for words in _words(value.as_py()):
                    for word in words:
                        held[language, word] = held.get((language, word), 0) + 1
                if len(held) > _CACHE:
                    yield rows()
                    held.clear()
        if held:
            yield rows()

    learned = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(lang, text)
    return learned.mapInArrow(gather, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Model:
    """Languages, their priors and their piece probabilities."""

    def __init__(self, languages: list[str], priors: np.ndarray, chances: np.ndarray, vocabulary: str):
        self.languages, self.priors, self.chances, self.vocabulary = languages, priors, chances, vocabulary


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", vocabulary: str = VOCABULARY, rounds: int = ROUNDS) -> Model:
    """Learn from every row with a text and a language; without any the model has no language."""
    words = materialize(word_counts(docs, text, lang))
    seen = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).groupBy(F.col(lang).alias("lang")).count().collect()
    shares = {r["lang"]: r["count"] for r in seen}
    languages = sorted(shares)
    size = Pieces(vocabulary).size
    chances = np.full((len(languages), size), 1.0 / size)
    for _ in range(rounds if languages else 0):

        def expect(batches, chances=chances):
            pieces, total = Pieces(vocabulary), np.zeros_like(chances)
            held, rows = [], 0

            def use(frames):
                for language, group in pd.concat(frames).groupby("lang"):
                    k = languages.index(language)
                    total[k] += expected_counts(group["word"].tolist(), group["n"].to_numpy(np.float64), pieces, chances[k])

            for batch in batches:
                held, rows = [*held, batch], rows + len(batch)
                if rows > _CHUNK // 4:
                    use(held)
                    held, rows = [], 0
            if held:
                use(held)
            k, piece = np.nonzero(total)
            yield pd.DataFrame({"k": k, "piece": piece, "n": total[k, piece]})

        counted = words.mapInPandas(expect, "k long, piece long, n double").groupBy("k", "piece").agg(F.sum("n").alias("n")).toPandas()
        found = np.zeros_like(chances)
        found[counted["k"], counted["piece"]] = counted["n"]
        common = (1 - FLOOR) * found.sum(0) / max(found.sum(), 1.0) + FLOOR / size
        chances = (found + STRENGTH * common) / (found.sum(1, keepdims=True) + STRENGTH)
    priors = np.array([shares[x] for x in languages], float)
    return Model(languages, np.log(priors / priors.sum()) if languages else priors, chances, vocabulary)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score``, the posterior of that language given the whole text.

    A text that is null or has no letter gets ``und`` and score 0, as does every text if the model has no language.
    Equal posteriors go to the first language by code point.  Columns of the added names are replaced.
    """
    kept = docs.drop("lang_pred", "score")
    place = kept.columns.index(text)
    names = kept.columns

    def run(batches):
        pieces = Pieces(model.vocabulary)
        table, known = np.empty((0, len(model.languages))), _Index()
        for batch in batches:
            labels, scores = [], []
            ids, docs_of, letters = [], [], []

            def settle():
                nonlocal table, known
                if known.fresh:
                    table = np.concatenate([table, log_chances(known.fresh, pieces, model.chances)])
                    known.fresh = []
                totals = np.tile(model.priors, (len(letters), 1))
                if ids:
                    starts = np.cumsum([0, *map(len, ids[:-1])])
                    np.add.at(totals, docs_of, np.add.reduceat(table[np.concatenate(ids)], starts))
                best = totals.argmax(1) if len(model.languages) else np.zeros(len(letters), int)
                for row, has, k in zip(totals, letters, best):
                    labels.append(model.languages[k] if has and model.languages else UNKNOWN)
                    scores.append(float(1 / np.exp(row - row[k]).sum()) if has and model.languages else 0.0)
                ids.clear(), docs_of.clear(), letters.clear()
                if len(known) > _CACHE:
                    known, table = _Index(), np.empty((0, len(model.languages)))

            waiting = 0
            for value in batch.column(place):
                value, has = value.as_py() or "", False
                for words in _words(value):
                    has = has or any(c.isalpha() for w in words for c in w)
                    if words:
                        ids.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
                        docs_of.append(len(letters))
                        waiting += len(words)
                letters.append(has)
                if waiting > _CHUNK:
                    settle()
                    waiting = 0
            settle()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"]
            )

    schema = StructType([*kept.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return kept.mapInArrow(run, schema)


class _Index(dict):
    """Numbers words in the order of their first use."""

    def __init__(self):
        super().__init__()
        self.fresh = []

    def __missing__(self, word):
        self[word] = number = len(self)
        self.fresh.append(word)
        return number
