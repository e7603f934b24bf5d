"""Connected components: of an edge table by star contraction, of arrays within one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.core import cut_lineage


def _hook(pairs: DataFrame) -> DataFrame:
    """Rows (a, b, low): low is the smallest of a and all its partners.

    The minimum is aggregated before the shuffle and joined back with one row per ``a``, so a hub
    is never gathered; the join side of a hub can be split.
    """
    low = pairs.groupBy("a").agg(F.min("b").alias("low"))
    return pairs.join(low, "a").withColumn("low", F.least("a", "low"))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (columns a, b); root is the smallest node.

    Large-star joins the larger neighbours of a node to the smallest one, small-star the node and
    its smaller neighbours; the two alternate until nothing changes, a number of rounds that grows
    with the logarithm of the number of nodes. Each round is checkpointed. Repeated edges and
    loops are allowed; a node that occurs only in loops is its own root; null ends are ignored.
    """
    rows = edges.where("a IS NOT NULL AND b IS NOT NULL")
    loops = rows.select(F.col("a").alias("node")).union(rows.select("b")).distinct()
    current = cut_lineage(
        rows.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct())
    state = _state(current)
    while state[0]:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _hook(both).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        small = _hook(large.distinct())
        moved = small.select(F.col("b").alias("a"), F.col("low").alias("b")).union(
            small.select("a", F.col("low").alias("b")))
        current = cut_lineage(moved.where("a <> b").distinct())
        before, state = state, _state(current)
        if state == before:
            break
    roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return loops.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def settle(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest label reachable over the links a-b."""
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links with the same components as the links a-b."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    label = settle(np.arange(len(nodes)), at[: len(a)], at[len(a) :])
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]
