"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosine, distributed components.

Each table cuts the space by ``bits`` random planes; vectors of one label on the same side of all of them share a bucket.  The
number of bits follows the size of the largest label, so that a bucket holds few unrelated vectors at any size, and
the number of tables follows from the bits so that a pair at the threshold is missed with chance ``MISS``.

Equal vectors of a label are compared as one, with the number of ids that hold them.  Vectors are first scaled by a power of two,
which leaves every cosine as it is and keeps norms of very large and very small components finite.

A bucket is compared in blocks of bounded size, each pair of blocks in a task of its own, so a large group of copies is
spread.  A pair counts in the first table where it meets, hence once.  What leaves a task is one row per vector: its links
and the smallest id it is connected with there; pairs are never written.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeloom.llm.graph import components, smallest_reached
from tradeloom.llm.rows import boxed, unboxed
from tradeloom.materialize import materialize

THRESHOLD = 0.98
MISS = 1e-9
SPARE_BITS = 3
BLOCK = 512
SEED = 17


def is_usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _scaled(vector: Column) -> Column:
    """Divided by a power of two near the largest component, so no product over- or underflows; digits stay."""
    exponent = F.floor(F.log2(F.array_max(F.transform(vector, F.abs)))).cast("double")
    scale = F.pow(F.lit(2.0), F.least(F.greatest(exponent, F.lit(-1000.0)), F.lit(1000.0)))
    return F.zip_with(vector, F.array_repeat(scale, F.size(vector)), lambda x, by: x / by)


def tables_for(bits: int, threshold: float, miss: float) -> int:
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(miss) / math.log1p(-agree)))


def _signed(vectors: DataFrame, bits: int, tables: int) -> DataFrame:
    """Add ``codes``, one number per table."""

    def run(batches):
        planes, weights = {}, 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("vector"))
            sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)
            codes, ends = np.empty((len(sizes), tables), np.int64), np.cumsum(sizes)
            for n in np.unique(sizes):
                if n not in planes:
                    planes[n] = np.random.default_rng([SEED, int(n)]).standard_normal((n, tables * bits))
                rows = np.flatnonzero(sizes == n)
                matrix = flat[(ends[rows] - n)[:, None] + np.arange(n)]
                sides = (matrix @ planes[n] >= 0).reshape(len(rows), tables, bits)
                codes[rows] = sides @ weights
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, tables), pa.int32()), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, listed], [*batch.schema.names, "codes"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return vectors.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in kinds.items()) + ", codes array<long>")


def _compare(threshold: float):
    """Compare the members of each group of a sorted stream of rows; groups are bounded, so little is carried over."""

    def pairs(group, matrix, norms):
        """Places of pairs in the same group, by distance for small groups and by product for others."""
        edges = np.flatnonzero(np.diff(group)) + 1
        starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(group)]])
        sizes = ends - starts
        for distance in range(1, min(int(sizes.max()), 16)):
            a = np.flatnonzero(group[:-distance] == group[distance:])
            small = np.repeat(sizes <= 16, sizes)[a]
            a = a[small]
            cosine = np.einsum("ij,ij->i", matrix[a], matrix[a + distance]) / (norms[a] * norms[a + distance])
            yield a[cosine >= threshold], a[cosine >= threshold] + distance
        for start, end in zip(starts[sizes > 16], ends[sizes > 16]):
            part = slice(start, end)
            cosine = (matrix[part] @ matrix[part].T) / np.outer(norms[part], norms[part])
            a, b = np.nonzero(np.triu(cosine >= threshold, 1))
            yield a + start, b + start

    def settle(table):
        sizes = np.diff(table.column("vector").combine_chunks().offsets.to_numpy())
        ids, labels, weights = (table.column(c).to_numpy() for c in ("id", "label", "weight"))
        group, block, at = (table.column(c).to_numpy() for c in ("group", "block", "at"))
        halves = table.column("cross").to_numpy(zero_copy_only=False)
        codes = table.column("codes").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        found = [], []
        for n in np.unique(sizes):
            rows = np.flatnonzero(sizes == n)
            picked = table.column("vector").take(pa.array(rows)).combine_chunks()
            matrix = picked.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), n)
            norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
            for a, b in pairs(group[rows], matrix, norms):
                a, b = rows[a], rows[b]
                keep = (ids[a] != ids[b]) & (labels[a] == labels[b]) & (~halves[a] | (block[a] != block[b]))
                a, b = a[keep], b[keep]
                if len(a):
                    first = np.concatenate([
                        (codes[a[i : i + 65536]] == codes[b[i : i + 65536]]).argmax(1) for i in range(0, len(a), 65536)
                    ])
                    keep = first == at[a]
                    found[0].append(a[keep])
                    found[1].append(b[keep])
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in found)
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, a, weights[b])
        np.add.at(links, b, weights[a])
        rows = np.flatnonzero(links)
        unique, place = np.unique(ids, return_inverse=True)
        lowest = smallest_reached(unique, place[a], place[b])[place]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[rows]), pa.array(links[rows]), pa.array(lowest[rows])], ["id", "n_links", "lowest"]
        )

    def run(batches):
        held = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            group = held.column("group").to_numpy()
            whole = int(np.searchsorted(-(group != group[-1]).astype(int), 0)) if len(group) else 0
            if whole:
                yield settle(held.slice(0, whole).combine_chunks())
                held = held.slice(whole)
        if held is not None and len(held):
            yield settle(held.combine_chunks())

    return run


def links(vectors: DataFrame, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """``(id, n_links, lowest)`` parts: links found in a task and the smallest id reached there.

    ``vectors`` has a long ``id``, a long ``label``, a ``vector`` of doubles that :func:`is_usable` and a long ``weight``, what
    a link to it counts; ids are not null, and rows of one id do not link.
    """
    # the size of a label in rows that are compared: copies make no bucket larger
    largest = vectors.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    bits = min(40, max(4, math.ceil(math.log2(largest + 1)) + SPARE_BITS))
    tables = tables_for(bits, threshold, miss)
    signed = materialize(_signed(vectors, bits, tables))
    bucket = F.xxhash64("label", F.size("vector"), "at", "code").alias("bucket")
    keys = signed.select("id", "label", "vector", F.posexplode("codes").alias("at", "code")).select(bucket)
    shared = materialize(keys.groupBy("bucket").count().where("count > 1"))
    members = signed.select("id", "label", "vector", "weight", "codes", F.posexplode("codes").alias("at", "code")).select(
        "id", "label", "vector", "weight", "codes", "at", bucket
    ).join(shared, "bucket")
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    members = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id", "at"), F.col("blocks")).cast("int"))
    # a member goes to every pair of blocks that holds its own
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other"))
    members = members.select(
        "id", "label", "vector", "weight", "codes", "at", "block", (F.col("blocks") > 1).alias("many"),
        (F.col("block") != F.col("other")).alias("cross"), group.alias("group"),
    ).drop("many")
    dealt = members.repartition("group").sortWithinPartitions("group")
    return materialize(dealt.mapInArrow(_compare(threshold), "id long, n_links long, lowest long"))


def dedup(
    vectors: DataFrame, threshold: float = THRESHOLD, miss: float = MISS, id_col: str = "vec_id",
    vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """Add ``n_links``, ``component_id`` and ``kept`` to every row.

    Vectors link if their labels are equal and not null, their sizes agree and the cosine, in doubles, reaches the threshold.
    Vectors that are null, empty, zero or hold null or non-finite components, and rows without id, link with
    nothing: they are components of their own and kept.  Rows equal in id, label and vector count once; ids are the
    nodes, so rows of one id share its component and the sum of its links.  Columns of the added names are replaced.
    """
    added = ("n_links", "component_id", "kept")
    usable = vectors.where(is_usable(F.col(vector)) & F.col(label).isNotNull() & F.col(id_col).isNotNull())
    doubles = F.col(vector).cast("array<double>")
    usable = materialize(usable.select(
        F.col(id_col).cast("long").alias("id"), F.col(label).cast("long").alias("label"), _scaled(doubles).alias("vector"),
    ).distinct().withColumns({"h1": F.xxhash64("label", "vector"), "h2": F.xxhash64("vector", "label")}))
    # a class is all ids that hold equal vectors; the vectors of an id that has several are classes of their own
    several = materialize(usable.groupBy("id").count().where("count > 1").select("id", F.col("id").alias("alone")))
    same = ["label", "h1", "h2", "shared", "alone"]
    rows = usable.join(several, "id", "left").withColumn("shared", F.col("alone").isNull())
    rows = rows.withColumn("alone", F.coalesce("alone", F.lit(0).cast("long")))
    classes = materialize(rows.groupBy(*same).agg(
        F.min("id").alias("first"), F.count("*").alias("weight"), F.any_value("vector").alias("vector")))
    found = links(classes.select(F.col("first").alias("id"), "label", "vector", "weight"), threshold, miss)
    members = rows.select("id", *same).join(classes.select(*same, "first", "weight"), same)
    grouped = components(found.select(F.col("id").alias("a"), F.col("lowest").alias("b")))
    totals = found.groupBy(F.col("id").alias("first")).agg(F.sum("n_links").alias("n_links"))
    per_class = classes.select("first", (F.col("weight") - 1).alias("n_links")).unionByName(totals).groupBy("first").agg(
        F.sum("n_links").alias("n_links"))
    nodes = members.select("id", "first").distinct().join(per_class, "first", "left").join(
        grouped.withColumnRenamed("id", "first"), "first", "left"
    ).select(F.col("id").alias("_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
             F.coalesce("component", "first").alias("component_id"))
    own = F.col("_row")[id_col].cast("long")
    joined = boxed(vectors, *added).join(nodes, own == F.col("_id"), "left")
    joined = joined.withColumns({
        "n_links": F.coalesce("n_links", F.lit(0).cast("long")), "component_id": F.coalesce("component_id", own),
    })
    return unboxed(joined.withColumn("kept", F.coalesce(own == F.col("component_id"), F.lit(True))), *added)
