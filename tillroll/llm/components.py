"""Connected components of a graph given as a table of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.sources.shared import stage


def _mark(links: DataFrame) -> tuple:
    row = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(links.agg(F.count(F.lit(1)), F.sum(row)).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a link (a, b); root is the smallest node reachable.

    Alternating star steps: every node first hands its larger neighbours to its smallest one,
    then its smaller ones; links turn into stars in rounds that grow with the logarithm of the
    longest path. Each round is written to the shared folder; there is no bound on rounds.
    Rows with nulls, loops and repeated links are ignored."""
    ordered = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = stage(ordered.distinct(), "links")
    mark = _mark(links)
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.min("b").alias("m"))
        smallest = smallest.select(F.col("a").alias("n"), F.least("m", "a").alias("m"))
        # A node's larger neighbours: `links` read from its smaller end.
        large = links.join(smallest, F.col("b") == F.col("n")).select("a", F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(lowest.withColumnRenamed("a", "n"), F.col("a") == F.col("n")).where(F.col("b") != F.col("m"))
        small = lowest.select("a", F.col("m").alias("b")).unionByName(
            moved.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        )
        links = stage(small.distinct(), "links")
        now = _mark(links)
        if now == mark:
            break
        mark = now
    roots = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer links with the same components: (node, smallest node) per component, in memory.
    Labels shrink along the links and then along themselves until nothing changes."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]
