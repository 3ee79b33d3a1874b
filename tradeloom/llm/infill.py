"""Fill-in-middle documents: prefix, middle and suffix cut at token ends, found without scanning a text twice.

A rolling hash cuts each text into chunks where its content says so, so texts that share passages share chunks.  A chunk's
boundary summary (words, characters, whether it begins and ends inside a word) is kept in a cache by its content; the cache
compares whole chunks, so a hash that collides cannot mix them up.  A document's token count is the sum of its chunks'
counts, less the words that run over a boundary, and the running sums tell which chunk holds a cut; only that chunk is searched.

The unit is a word with the white space before it; white space that ends the text is a unit too.
"""

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradeloom.llm.rows import unboxed

SEED, RATE, SPM = 42, 50, 80  # draws of 100: below RATE a document is changed, below SPM its suffix goes first
PREFIX, SUFFIX, MIDDLE = MARKS = "<P>", "<S>", "<M>"
MASK, LEAST, MOST = 511, 64, 4096  # a chunk ends where the hash's low bits are 0, about every 512 bytes, within these sizes
WINDOW = 32  # bytes that a rolling hash covers
SLICE = 1 << 20  # bytes hashed at a time
CACHE = 1 << 15  # chunks kept per task
_SPACE = b" \t\n\x0b\x0c\r"  # what bytes.split() splits at
_INNER = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that begin no character


@functools.lru_cache(maxsize=1)
def _gear() -> np.ndarray:
    return np.random.default_rng(WINDOW).integers(0, 2**32, 256, np.uint32)


def _rolled(data: np.ndarray) -> np.ndarray:
    """The hash at each byte: the sum of the last ``WINDOW`` bytes' numbers, each shifted by its age."""
    out, width = _gear()[data], 1
    while width < WINDOW:
        older = np.zeros_like(out)
        older[width:] = out[:-width] << np.uint32(width)
        out, width = out + older, 2 * width
    return out


def chunk_ends(data: bytes) -> list[int]:
    """Where the chunks of ``data`` end; the last end is its length."""
    wanted = []
    for start in range(0, len(data), SLICE) if len(data) > LEAST else ():
        before = min(start, WINDOW - 1)
        hashes = _rolled(np.frombuffer(data, np.uint8, min(SLICE, len(data) - start) + before, start - before))
        # the high bits depend on the most bytes
        wanted += (np.flatnonzero((hashes[before:] >> np.uint32(16)) & np.uint32(MASK) == 0) + (start + 1)).tolist()
    ends, last = [], 0
    for end in [*wanted, len(data)]:
        while end - last > MOST:
            last += MOST
            ends.append(last)
        if end - last >= LEAST or end == len(data) > last:
            ends.append(end)
            last = end
    return ends


def summary(chunk: bytes) -> tuple[int, int, bool, bool]:
    """Words, characters, and whether the first and the last byte belong to a word."""
    return len(chunk.split()), len(chunk.translate(None, _INNER)), chunk[:1] not in _SPACE, chunk[-1:] not in _SPACE


class Counted:
    """The chunks of one text with running sums of word ends and characters."""

    def __init__(self, data: bytes, cache: dict[bytes, tuple]):
        self.data, self.ends = data, chunk_ends(data)
        self.words, self.chars = [], []  # before the end of each chunk
        words = chars = last = 0
        inside = False  # the chunk before ended in a word
        for end in self.ends:
            chunk = data[last:end]
            known = cache.get(chunk)
            if known is None:
                if len(cache) >= CACHE:
                    cache.clear()
                known = cache[chunk] = summary(chunk)
            if inside and known[2]:
                words -= 1  # the word goes on, so it did not end with the chunk before
                self.words[-1] -= 1
            words, chars, inside, last = words + known[0], chars + known[1], known[3], end
            self.words.append(words)
            self.chars.append(chars)
        self.units = words + bool(data and not inside)

    def cut(self, units: int) -> tuple[int, int]:
        """Bytes and characters of the first ``units`` units."""
        if not units:
            return 0, 0
        if units > (self.words[-1] if self.words else 0):
            return len(self.data), self.chars[-1]
        at = int(np.searchsorted(self.words, units))
        start, chars, before = (self.ends[at - 1], self.chars[at - 1], self.words[at - 1]) if at else (0, 0, 0)
        chunk = self.data[start : self.ends[at]]
        spaces = np.isin(np.frombuffer(chunk, np.uint8), np.frombuffer(_SPACE, np.uint8))
        # a word that runs over a boundary counts where it ends
        stops = np.flatnonzero(~spaces & np.append(spaces[1:], True))
        length = int(stops[units - before - 1]) + 1
        return start + length, chars + len(chunk[:length].translate(None, _INNER))


def _draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the seed and the decimal id; a null id counts as no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(
    docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Add ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` to every row.

    ``n`` counts the units.  The form is ``plain`` (the text unchanged) for empty texts, texts that hold a mark and the share not
    drawn, else ``spm`` (suffix, prefix, middle) or ``psm``.  The draws depend on the seed and the id alone, so repeated
    rows get the same cuts; a null id is drawn as one without digits, a null text counts as empty, and the two lengths, in
    code points, are null for ``plain``.  No rows give none.  Columns of the added names are replaced.
    """
    added = ("n", "form", "prefix_chars", "middle_chars", "output")
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in added])
    whole, draws = F.coalesce(F.col(f"`{text}`"), F.lit("")), F.array(*_draws(F.col(f"`{id_col}`"), seed))
    rows = docs.select(kept.alias("_row"), whole.alias("_text"), draws.alias("_draws"))

    def run(batches):
        cache: dict[bytes, tuple] = {}
        marks = [m.encode() for m in MARKS]
        for batch in batches:
            draws = batch.column(2).flatten().to_numpy().reshape(-1, 4).tolist()
            counts, forms, before, inner, outputs = [], [], [], [], []
            for value, (one, two, kind, order) in zip(batch.column(1), draws):
                data = value.as_buffer().to_pybytes() if value.as_buffer() else b""
                counted = Counted(data, cache)
                counts.append(counted.units)
                if not data or kind % 100 >= rate or any(m in data for m in marks):
                    forms.append("plain"), before.append(None), inner.append(None), outputs.append(data)
                    continue
                first, second = sorted((one % (counted.units + 1), two % (counted.units + 1)))
                (low, low_chars), (high, high_chars) = counted.cut(first), counted.cut(second)
                prefix, middle, suffix = (m + part for m, part in zip((marks[0], marks[2], marks[1]), (data[:low], data[low:high], data[high:])))
                forms.append("spm" if order % 100 < spm else "psm")
                outputs.append(suffix + prefix + middle if forms[-1] == "spm" else prefix + suffix + middle)
                before.append(low_chars), inner.append(high_chars - low_chars)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(counts, pa.int64()), pa.array(forms, pa.string()), pa.array(before, pa.int64()),
                pa.array(inner, pa.int64()), pa.array(outputs, pa.binary()).cast(pa.string()),
            ], ["_row", *added])

    schema = T.StructType([rows.schema["_row"]])
    for name, kind in zip(added, ("long", "string", "long", "long", "string")):
        schema.add(name, kind)
    return unboxed(rows.mapInArrow(run, schema), *added)


def restored(output: Column, form: Column) -> Column:
    """The text that :func:`transform` gave this output and form; marks in it can only be those that were added."""
    parts = F.split(output, "<[PSM]>", -1)  # nothing, then the two or three pieces in their order
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
    )
