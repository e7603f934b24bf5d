"""Mutual information from nearest-neighbour distances, as sorted runs instead of search trees.

In one dimension the k-th neighbour of a value lies within k places of the sorted order, and the
number of values within its distance is the difference of two positions. Both come from range
sorted partitions: each is handed the borders of its neighbours, or the counts of those before it.
In two dimensions the neighbours come from the exact nearest-neighbour join under the larger of
the two coordinate distances.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.core import cut_lineage
from tablewright.operators.knn import nearest_neighbours

ROWS_PER_PART = 250_000


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of the logarithm of the gamma function for positive numbers."""
    x = np.asarray(x, dtype=float).copy()
    out = np.zeros_like(x)
    for _ in range(6):
        small = x < 6
        out[small] -= 1 / x[small]
        x[small] += 1
    z = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z / 240)))


def _sorted_parts(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows in contiguous sorted partitions, written once, with the number of their partition."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                -(-df.count() // ROWS_PER_PART))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return cut_lineage(ranged.withColumn("part", F.spark_partition_id()))


def _whole(batches: Iterator[pd.DataFrame]) -> pd.DataFrame | None:
    held = [b for b in batches if len(b)]
    return pd.concat(held, ignore_index=True) if held else None


def _runs(key: list[np.ndarray]) -> np.ndarray:
    """First places of the runs of equal keys, and the end."""
    new = np.zeros(len(key[0]), bool)
    new[0] = True
    for k in key:
        new[1:] |= k[1:] != k[:-1]
    return np.r_[np.flatnonzero(new), len(new)]


def _kth_distance(x: np.ndarray, n: np.ndarray, total: int, k: int) -> np.ndarray:
    """Distance to the k-th neighbour of each value of one sorted run of (value, copies).

    Values beyond the run are unknown: only the first and last k points may miss neighbours.
    """
    k = min(k, total - 1)
    copies = np.minimum(n, k + 1)
    points = np.repeat(x, copies)
    at = np.cumsum(copies) - copies
    padded = np.r_[np.full(k, -np.inf), points, np.full(k, np.inf)]
    best = np.full(len(x), np.inf)
    for j in range(k + 1):
        low, high = padded[at + k - j], padded[at + 2 * k - j]
        best = np.minimum(best, np.maximum(x - low, high - x))
    return best


def class_distances(cells: DataFrame, k: int) -> DataFrame:
    """Add ``d``, the distance to the k-th neighbour within (f, c), to rows f, c, v, n, total.

    A partition is handed the k points before and after it; the driver sees 2 k rows for each.
    """
    staged = _sorted_parts(cells, ["f", "c", "v"])

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = _whole(batches)
        if rows is not None:
            few = rows if len(rows) <= 2 * k else pd.concat([rows[:k], rows[-k:]])
            yield few.assign(last=np.arange(len(few)) >= len(few) - k, first=np.arange(len(few)) < k)

    border = staged.mapInPandas(
        ends, "f int, c string, v double, n long, total long, part int, last boolean, first boolean"
    ).toPandas().sort_values(["part", "f", "c", "v"], kind="stable")

    def distances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = _whole(batches)
        if rows is None:
            return
        part = rows["part"].iloc[0]
        before = border[(border["part"] < part) & border["last"]][-k:]
        after = border[(border["part"] > part) & border["first"]][:k]
        own = pd.concat([before, rows, after])[["f", "c", "v", "n", "total"]]
        d = np.empty(len(own))
        edge = _runs([own["f"].to_numpy(), own["c"].to_numpy()])
        x, n, total = (own[c].to_numpy() for c in ("v", "n", "total"))
        for a, b in zip(edge, edge[1:]):
            d[a:b] = _kth_distance(x[a:b], n[a:b], int(total[a]), k)
        yield rows.drop(columns="part").assign(d=d[len(before) : len(before) + len(rows)])

    return staged.mapInPandas(
        distances, "f int, c string, v double, n long, total long, d double")


def counts_within(values: DataFrame, asked: DataFrame) -> DataFrame:
    """Number ``m`` of points nearer than ``d`` to each asked value, itself and its copies included.

    ``values`` has f, v, n; ``asked`` has f, id, v, d. Values and the two ends of every interval
    are sorted together; running counts within a partition and the counts of the partitions before
    it give the position of each end. An end keeps off the value at distance ``d`` by rounding.
    """
    slack = F.least(F.greatest(F.abs("v"), F.col("d")) * 1e-12, F.col("d") / 2)
    reach = F.col("d") - slack
    none = F.lit(None).cast("string").alias("id")
    events = values.select("f", F.col("v").alias("at"), F.lit(1).alias("kind"), "n", none, F.lit(0).alias("sign"))
    ends = asked.select("f", "id", F.inline(F.array(
        F.struct((F.col("v") - reach).alias("at"), F.lit(0).alias("kind"), F.lit(-1).alias("sign")),
        F.struct((F.col("v") + reach).alias("at"), F.lit(2).alias("kind"), F.lit(1).alias("sign")))))
    events = events.unionByName(ends.select("f", "at", "kind", F.lit(0).cast("long").alias("n"), "id", "sign"))
    staged = _sorted_parts(events, ["f", "at", "kind"])
    sums = staged.groupBy("part", "f").agg(F.sum("n").alias("n")).orderBy("part").collect()
    start: dict[tuple[int, int], int] = {}  # one entry per partition and column in it
    seen: dict[int, int] = {}
    for r in sums:
        start[r["part"], r["f"]] = seen.get(r["f"], 0)
        seen[r["f"]] = seen.get(r["f"], 0) + r["n"]

    def positions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: dict[int, int] = {}
        for batch in batches:
            if not len(batch):
                continue
            part = int(batch["part"].iloc[0])
            n, f = batch["n"].to_numpy(), batch["f"].to_numpy()
            edge = _runs([f])
            count = np.empty(len(batch), np.int64)
            for a, b in zip(edge, edge[1:]):
                c = int(f[a])
                past = done.get(c, start[part, c])
                count[a:b] = past + np.cumsum(n[a:b])
                done[c] = int(count[b - 1])
            hit = batch["kind"].to_numpy() != 1
            yield pd.DataFrame({"f": f[hit], "id": batch["id"].to_numpy()[hit],
                                "m": count[hit] * batch["sign"].to_numpy()[hit]})

    return staged.mapInPandas(positions, "f int, id string, m long").groupBy("f", "id").agg(
        F.sum("m").alias("m"))


def _digamma_sums(rows: DataFrame, columns: list[str]) -> DataFrame:
    """By f: number of points and the sum over them of the digamma of each column."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = batch["n"].to_numpy().astype(float)
            yield pd.DataFrame({"f": batch["f"], "n": n, **{
                c: n * digamma(batch[c].to_numpy()) for c in columns}})

    schema = ", ".join(["f int", "n double", *[f"{c} double" for c in columns]])
    return rows.select("f", "n", *columns).mapInPandas(run, schema).groupBy("f").agg(
        *[F.sum(c).alias(c) for c in ("n", *columns)])


def class_information(rows: DataFrame, k: int = 3) -> dict[int, float]:
    """Mutual information (nats) of a continuous ``v`` and a class ``c`` for each ``f`` of the rows.

    Points alone in their class are left out; a class of fewer than k + 1 points uses all it has.
    """
    cells = rows.groupBy("f", "c", "v").agg(F.count(F.lit(1)).alias("n"))
    sizes = cells.groupBy("f", "c").agg(F.sum("n").alias("total"))
    cells = cells.join(sizes, ["f", "c"]).where(F.col("total") > 1).select("f", "c", "v", "n", "total")
    with_d = cut_lineage(class_distances(cells, k).withColumn(
        "id", F.concat_ws("\u0000", F.format_string("%a", "v"), "c")))
    values = with_d.groupBy("f", "v").agg(F.sum("n").alias("n"))
    counted = counts_within(values, with_d.select("f", "id", "v", "d"))
    joined = with_d.join(counted, ["f", "id"]).withColumn(
        "k", F.least(F.col("total") - 1, F.lit(k)))
    sums = _digamma_sums(joined, ["k", "total", "m"]).collect()
    return {r["f"]: max(0.0, float(digamma(np.array([r["n"]]))[0]) + (r["k"] - r["total"] - r["m"]) / r["n"])
            for r in sums}


def pair_information(df: DataFrame, x: Column, y: Column, k: int = 3, seed: int = 42) -> float:
    """Mutual information (nats) of two continuous columns.

    Both are divided by their standard deviation. Equal points are one cell with a count; the
    distance of the k-th neighbour is the larger of the two coordinate distances.
    """
    rows = df.select(x.cast("double").alias("x"), y.cast("double").alias("y"))
    spread = rows.agg(F.stddev_pop("x"), F.stddev_pop("y"), F.count(F.lit(1))).first()
    if spread[2] <= k or not spread[0] or not spread[1]:
        return 0.0
    cells = cut_lineage(
        rows.select((F.col("x") / spread[0]).alias("x"), (F.col("y") / spread[1]).alias("y"))
        .groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("tid", F.monotonically_increasing_id()))
    train = cells.select("tid", F.array("x", "y").alias("x"), F.col("n").cast("double").alias("y"))
    near = nearest_neighbours(
        train.select(F.col("tid").alias("qid"), "x"), train, k + 1, math.inf, seed)
    seen = F.sum("y").over(Window.partitionBy("qid").orderBy("place"))
    reach = near.withColumn("seen", seen).where(F.col("seen") > k).groupBy("qid").agg(
        F.min("dist").alias("d"))
    with_d = cut_lineage(cells.join(reach, F.col("tid") == F.col("qid")).select(
        "x", "y", "n", "d", F.col("tid").cast("string").alias("id")))
    sides = [with_d.select(F.lit(i).alias("f"), F.col(c).alias("v"), "n", "d", "id")
             for i, c in enumerate(("x", "y"))]
    both = sides[0].unionByName(sides[1])
    values = both.groupBy("f", "v").agg(F.sum("n").alias("n"))
    counted = counts_within(values, both)
    joined = both.join(counted, ["f", "id"])
    sums = _digamma_sums(joined, ["m"]).collect()
    n = sums[0]["n"]
    lead = digamma(np.array([n, float(k)])).sum()
    return max(0.0, float(lead - sum(r["m"] for r in sums) / n))
