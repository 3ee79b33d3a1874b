"""Connected components of a distributed edge table."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeloom.materialize import materialize


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id for every id that has an edge: ``(id, component)``.

    ``edges`` has long columns ``a`` and ``b``; direction, repeats and self-loops do not matter.  Each round hooks
    every id to its smallest neighbour, shortens those pointers until they end in roots, and keeps the edges between
    different roots.  Every round is stored in the shared folder, nothing is gathered on the driver.
    """
    left = materialize(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    rounds = []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("root")).select(
            "id", F.least("id", "root").alias("root")
        )
        parents = _shorten(materialize(parents))
        rounds.append(parents)
        at = lambda end: parents.select(F.col("id").alias(end), F.col("root").alias("root_" + end))
        left = materialize(
            left.join(at("a"), "a").join(at("b"), "b").where("root_a <> root_b")
            .select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct()
        )
    if not rounds:
        return left.select(F.col("a").alias("id"), F.col("b").alias("component"))
    labels = rounds[0].withColumnRenamed("root", "component")
    for parents in rounds[1:]:
        further = parents.select(F.col("id").alias("component"), F.col("root").alias("further"))
        labels = labels.join(further, "component", "left").select(
            "id", F.coalesce("further", "component").alias("component")
        )
    return labels


def _shorten(parents: DataFrame) -> DataFrame:
    """Pointer jumping until every pointer ends in a root (logarithmic in the longest path)."""
    while True:
        above = parents.where("id <> root").select(F.col("id").alias("root"), F.col("root").alias("above"))
        if above.join(parents.where("id <> root").select("root").distinct(), "root", "left_semi").isEmpty():
            return parents
        parents = materialize(
            parents.join(above, "root", "left").select("id", F.coalesce("above", "root").alias("root"))
        )


def smallest_reached(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Within a task: the smallest id connected with each of ``ids`` by the pairs of places ``a``, ``b``."""
    label = ids.copy()
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        if (new == label).all():
            return label
        label = new
