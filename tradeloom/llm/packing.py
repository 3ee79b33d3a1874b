"""Pack token sequences by minimum bin slack.

Every text is tokenized once, where it is read; what is stored per piece is a small row.  Which pieces share a sequence
depends on lengths alone, so the plan is made from the histogram of lengths, which has at most ``capacity`` rows: while
pieces are left, the longest opens a sequence and a bitset subset-sum over the available lengths finds the fullest
combination for the rest; it is removed as often as the counts allow.  Pieces of a length are numbered per
task and offset by the counts of earlier tasks, and that number says which sequence and place the plan gives them.
"""

import functools
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradeloom.materialize import materialize

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: The same vocabulary as ranks; ``None`` for tokenizers without one.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SPECIAL = "<|endoftext|>"  # the tokenizer knows it as one id, the ranks do not
END_ID = 2
CAPACITY = 1024


@functools.lru_cache(maxsize=2)
def _encoder(tokenizer: str, ranks: str | None):
    """Function from text to a list of ids.

    The rank file gives the same ids four times as fast; texts with the special token, and any that the faster
    library refuses, go through the tokenizer itself.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokenizer)
    exact = lambda text: slow.encode(text, add_special_tokens=False).ids
    if ranks is None:
        return exact
    import base64

    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(text):
        if SPECIAL in text:
            return exact(text)
        try:
            return fast.encode_ordinary(text)
        except Exception:  # the pattern library gives up on some extreme texts
            return exact(text)

    return encode


PIECES = "piece int, start long, length long, ids_crc32 long, part int, number long"


def pieces(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID,
    tokenizer: str = TOKENIZER, ranks: str | None = RANKS, with_ids: bool = False,
) -> DataFrame:
    """Tokenize, end with ``end_id`` and cut: one row per piece of at most ``capacity`` tokens.

    Only a document that is longer is cut; its first piece takes the remainder, all others are full.  ``number`` counts the pieces
    of a length within the task ``part``.  A null text counts as empty and is one piece, the end id.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        encode = _encoder(tokenizer, ranks)
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            ids, out = batch.column(0), {k: [] for k in ("row", "piece", "start", "length", "crc", "number", "ids")}
            for row, text_value in enumerate(batch.column(1)):
                tokens = np.asarray([*encode(text_value.as_py() or ""), end_id], dtype="<u4")
                cuts = [0, *range(len(tokens) % capacity or capacity, len(tokens) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    cut = tokens[a:b]
                    for key, value in zip(out, (row, piece, a, b - a, zlib.crc32(cut.tobytes()), seen[b - a])):
                        out[key].append(value)
                    if with_ids:
                        out["ids"].append(cut.astype(np.int32))
                    seen[b - a] += 1
            columns = [ids.take(pa.array(out["row"], pa.int64())), pa.array(out["piece"], pa.int32())]
            columns += [pa.array(out[k], pa.int64()) for k in ("start", "length", "crc")]
            columns += [pa.array([part] * len(out["row"]), pa.int32()), pa.array(out["number"], pa.int64())]
            names = [id_col, "piece", "start", "length", "ids_crc32", "part", "number"]
            if with_ids:
                columns, names = [*columns, pa.array(out["ids"], pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"`{id_col}` {id_type}, {PIECES}" + (", ids array<int>" if with_ids else "")
    return docs.select(id_col, text).mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """Slots ``(length, first, count, sequence, offset)``: pieces number ``first`` on of a length go to sequences from
    ``sequence`` on, each to ``offset``."""
    left, taken, slots, sequence = dict(counts), dict.fromkeys(counts, 0), [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        combination = [longest, *_fullest(left, capacity - longest)]
        left[longest] += 1
        uses = {n: combination.count(n) for n in combination}
        times = min(left[n] // k for n, k in uses.items())
        offset = 0
        for n in combination:
            slots.append((n, taken[n], times, sequence, offset))
            taken[n] += times
            offset += n
        for n, k in uses.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
        sequence += times
    return pd.DataFrame(slots, columns=["length", "first", "count", "sequence", "offset"], dtype="int64")


def _fullest(available: dict[int, int], room: int) -> list[int]:
    """Lengths (with repeats, within their counts) whose sum is the largest that fits into ``room``."""
    reached, items = [1], []
    mask = (1 << (room + 1)) - 1
    for n in sorted((n for n, k in available.items() if k and n <= room), reverse=True):
        many, step = min(available[n], room // n), 1
        while many and not reached[-1] >> room & 1:  # a count as a sum of powers of two
            step = min(step, many)
            items.append((n, step))
            reached.append((reached[-1] | reached[-1] << n * step) & mask)
            many, step = many - step, step * 2
    total, chosen = reached[-1].bit_length() - 1, []
    for (n, times), before in zip(reversed(items), reversed(reached[:-1])):
        if not before >> total & 1:
            chosen += [n] * times
            total -= n * times
    return chosen


def pack(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID,
    tokenizer: str = TOKENIZER, ranks: str | None = RANKS, with_ids: bool = False,
) -> DataFrame:
    """:func:`pieces` with ``sequence_id`` and ``offset``, which is gapless from 0 in every sequence.

    Null ids and repeated rows are packed like any others; an empty table gives none.  Other columns are left out.
    """
    stored = materialize(pieces(docs, id_col, text, capacity, end_id, tokenizer, ranks, with_ids))
    per_task = materialize(stored.groupBy("part", "length").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = plan(counts, capacity).sort_values(["length", "first"])
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    numbered = stored.join(per_task.select("part", "length", earlier.alias("before")), ["part", "length"])
    columns = [c for c in stored.columns if c not in ("part", "number")]
    numbered = numbered.select(*columns, (F.col("before") + F.col("number")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    table = {name: slots[name].to_numpy() for name in slots}
    starts = np.searchsorted(table["length"], np.arange(capacity + 2))

    def place(batches):
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["sequence_id"].to_numpy()
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for n in np.unique(length):
                rows, (a, b) = length == n, starts[n : n + 2]
                slot = a + np.searchsorted(table["first"][a:b], rank[rows], side="right") - 1
                sequence[rows] = table["sequence"][slot] + rank[rows] - table["first"][slot]
                offset[rows] = table["offset"][slot]
            yield batch.assign(sequence_id=sequence, offset=offset)

    return numbered.mapInPandas(place, numbered.schema)
