"""Exact k-nearest-neighbour join over cells of training rows.

In up to BOX_DIMENSIONS dimensions the cells are the leaves of a k-d tree of a sample, with the
boxes of the rows they hold; above, training rows are assigned to the nearest of a few pivots. A
query first searches its own cell, which bounds its k-th distance; the distance to a box, or the
triangle inequality, then names the only other cells that can hold a closer row, and of those only
rows within the bound are kept. Cells are cut into chunks of bounded size, and every (cell, chunk)
pair with a slice of its queries is one small Arrow group, so neither a crowded cell nor a popular
query region ends up in one task. Only k candidates per query and chunk are shuffled on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.core import cut_lineage, local_rows

#: Training rows and queries of a group, which a task holds whole: two megabytes each at 64 numbers.
CHUNK_ROWS = 4_096
QUERY_ROWS = 4_096
#: Distances held at once; rows of (query, cell) handed on at once.
BLOCK_PAIRS, PAIRS_AT_ONCE = 250_000, 4_096
MAX_PIVOTS = 1_024
#: Dimensions up to which cells are boxes; rows wanted in a box, boxes at most, sample rows for each.
BOX_DIMENSIONS, BOX_ROWS, MAX_BOXES, BOX_SAMPLE = 8, 1_500, 16_384, 16
CANDIDATES = "qid long, dist double, tid long, y double"


def _distances(a: np.ndarray, b: np.ndarray, power: float) -> np.ndarray:
    if power == 2.0 and a.shape[1] > BOX_DIMENSIONS:
        squared = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
        near = np.sqrt(np.maximum(squared, 0.0))
        # cancellation makes tiny distances inexact; recompute those few directly
        i, j = np.nonzero(squared < 1e-6 * ((a * a).sum(1)[:, None] + 1e-300))
        near[i, j] = np.sqrt(((a[i] - b[j]) ** 2).sum(1))
        return near
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        _add_gap(total, np.abs(a[:, j, None] - b[None, :, j]), power)
    return _root(total, power)


def _add_gap(total: np.ndarray, gap: np.ndarray, power: float) -> None:
    """Take the gap of one more coordinate into ``total``."""
    if np.isinf(power):
        np.maximum(total, gap, out=total)
    elif power == 1.0:
        total += gap
    else:
        total += gap * gap if power == 2.0 else gap**power


def _root(total: np.ndarray, power: float) -> np.ndarray:
    if np.isinf(power) or power == 1.0:
        return total
    return np.sqrt(total) if power == 2.0 else total ** (1.0 / power)


def _nearest_pivot(df: DataFrame, pivots: np.ndarray, power: float) -> DataFrame:
    """Add the nearest pivot (``cell``) and the distance to it (``own``)."""
    names = [*df.columns, "cell", "own"]
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
        + ["cell int", "own double"]
    )
    step = max(1, BLOCK_PAIRS // max(1, len(pivots)))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            for i in range(0, len(batch), step):
                part = batch.iloc[i : i + step]
                d = _distances(np.stack(part["x"].to_numpy()), pivots, power)
                cell = d.argmin(1)
                yield part.assign(cell=cell.astype("int32"), own=d[np.arange(len(d)), cell])[names]

    return df.mapInPandas(assign, schema)


def _search(
    queries: DataFrame, train: DataFrame, sizes: dict[int, int], k: int, power: float,
    chunk_rows: int, query_rows: int,
) -> DataFrame:
    """Best k training rows per query and chunk.

    ``queries`` has ``qid, x, cell`` and, if a bound is known, ``reach``; ``train`` has ``tid, x,
    y, cell``; ``sizes`` is the number of its rows by cell. The queries of a crowded cell are cut
    into slices, and the chunks of that cell are repeated once per slice.
    """
    load = {r["cell"]: r["count"] for r in queries.groupBy("cell").count().collect()}
    plan = F.broadcast(local_rows(  # a row per cell
        train.sparkSession,
        [(c, -(-n // chunk_rows), -(-load[c] // query_rows)) for c, n in sizes.items() if c in load],
        "cell int, chunks int, slices int"))
    asked = queries.join(plan, "cell").select(
        *queries.columns, F.pmod(F.xxhash64("qid"), "slices").cast("int").alias("slice"),
        F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    placed = train.join(plan, "cell").select(
        *train.columns, F.pmod(F.xxhash64("tid"), "chunks").cast("int").alias("chunk"),
        F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    return pair_chunks(asked, placed, k, power)


def pair_chunks(asked: DataFrame, placed: DataFrame, k: int, power: float) -> DataFrame:
    """Best k rows of each (cell, chunk, slice) for each query of it, within ``reach`` if given."""

    def best(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if q.empty or t.empty:
            return pd.DataFrame(columns=["qid", "dist", "tid", "y"])
        t = t.sort_values("tid", kind="stable")
        points, tid, y = np.stack(t["x"].to_numpy()), t["tid"].to_numpy(), t["y"].to_numpy()
        asked_points, qid = np.stack(q["x"].to_numpy()), q["qid"].to_numpy()
        reach = q["reach"].to_numpy() if "reach" in q else np.full(len(q), np.inf)
        step, found = max(1, BLOCK_PAIRS // len(tid)), []
        for start in range(0, len(q), step):
            d = _distances(asked_points[start : start + step], points, power)
            limit = reach[start : start + step]
            wide = np.isinf(limit)
            if len(tid) > k and wide.any():
                limit = limit.copy()
                limit[wide] = np.partition(d[wide], k - 1, axis=1)[:, k - 1]
            row, at = np.nonzero(d <= limit[:, None])
            near = d[row, at]
            order = np.lexsort((at, near, row))  # equal distances by tid
            row, at, near = row[order], at[order], near[order]
            own = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, at, near = row[own], at[own], near[own]
            found.append(pd.DataFrame(
                {"qid": qid[row + start], "dist": near, "tid": tid[at], "y": y[at]}))
        return pd.concat(found)

    keys = ["cell", "chunk", "slice"]
    return asked.groupBy(*keys).cogroup(placed.groupBy(*keys)).applyInPandas(best, CANDIDATES)


def _keep_best(candidates: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy("dist", "tid")
    return candidates.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def choose_pivots(train: DataFrame, n: int, wanted: int, seed: int) -> np.ndarray:
    """A deterministic sample of training rows, chosen by hash of the row id."""
    share = min(1.0, 4.0 * wanted / max(n, 1))
    limit = int(share * 2**31)
    picked = (
        train.where(F.pmod(F.xxhash64("tid", F.lit(seed)), F.lit(2**31)) <= limit)
        .select("x", F.xxhash64("tid", F.lit(seed)).alias("h"))
        .orderBy("h")
        .limit(wanted)
        .collect()
    )
    if not picked:
        picked = train.select("x").limit(1).collect()
    return np.array([r["x"] for r in picked], dtype=float)


def nearest_neighbours(
    queries: DataFrame,
    train: DataFrame,
    k: int,
    power: float = 2.0,
    seed: int = 42,
    chunk_rows: int = CHUNK_ROWS,
    query_rows: int = QUERY_ROWS,
    pivots: int | None = None,
) -> DataFrame:
    """Rows ``qid, place, dist, tid, y``: the exact k nearest training rows of every query.

    ``queries`` has ``qid long, x array<double>``; ``train`` has ``tid long, x, y double``. Equal
    distances are ordered by ``tid``.
    """
    n_train = train.count()
    one = train.select(F.size("x").alias("n")).first()
    if one and one["n"] <= BOX_DIMENSIONS:
        wanted = pivots or max(1, min(MAX_BOXES, n_train // BOX_ROWS))
        cells = _Boxes(choose_pivots(train, n_train, BOX_SAMPLE * wanted, seed), wanted, power)
    else:
        wanted = pivots or max(1, min(MAX_PIVOTS, int((n_train / 1_000) ** 0.5) * 4))
        cells = _Voronoi(choose_pivots(train, n_train, wanted, seed), power)
    placed = cells.hold(train.select("tid", "x", "y"))
    asked = cells.place(queries.select("qid", "x"))
    candidates = _search(asked, placed, cells.sizes, k, power, chunk_rows, query_rows)
    first = cut_lineage(_keep_best(candidates, k))
    if len(cells.sizes) <= 1:
        return first.select("qid", "place", "dist", "tid", "y")
    bound = first.groupBy("qid").agg(
        F.count(F.lit(1)).alias("found"), F.max("dist").alias("reach")
    )
    bounded = asked.select("qid", "x", "cell").join(bound, "qid", "left").select(
        "qid", "x", "cell", F.when(F.col("found") >= k, F.col("reach")).alias("reach"))

    def other_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), cells.rows_at_once):
                part = batch.iloc[i : i + cells.rows_at_once]
                x, qid = np.stack(part["x"].to_numpy()), part["qid"].to_numpy()
                reach = part["reach"].astype(float).fillna(np.inf).to_numpy()
                row, cell, reach = cells.others(x, part["cell"].to_numpy(), reach, k)
                for j in range(0, len(row), PAIRS_AT_ONCE):
                    own = row[j : j + PAIRS_AT_ONCE]
                    yield pd.DataFrame({
                        "qid": qid[own], "x": list(x[own]),
                        "cell": cell[j : j + PAIRS_AT_ONCE].astype("int32"), "reach": reach[own]})

    more = cut_lineage(bounded.mapInPandas(
        other_cells, "qid long, x array<double>, cell int, reach double"))
    second = _search(more, placed, cells.sizes, k, power, chunk_rows, query_rows)
    union = first.select("qid", "dist", "tid", "y").unionByName(second)
    return _keep_best(union, k).select("qid", "place", "dist", "tid", "y")


def _slack(reach: np.ndarray) -> np.ndarray:
    """A bound that rounding of a distance does not cross."""
    return reach * (1 + 1e-9) + 1e-300


class _Voronoi:
    """Cells of the rows nearest to a pivot."""

    def __init__(self, pivots: np.ndarray, power: float):
        self.pivots, self.power, self.sizes = pivots, power, {}
        self.rows_at_once = max(1, BLOCK_PAIRS // max(1, len(pivots)))

    def place(self, rows: DataFrame) -> DataFrame:
        return cut_lineage(_nearest_pivot(rows, self.pivots, self.power).drop("own"))

    def hold(self, train: DataFrame) -> DataFrame:
        """The rows with their cells, whose sizes and radii are noted."""
        placed = cut_lineage(_nearest_pivot(train, self.pivots, self.power))
        found = placed.groupBy("cell").agg(
            F.count(F.lit(1)).alias("n"), F.max("own").alias("far")).collect()
        self.sizes = {r["cell"]: r["n"] for r in found}
        self.ids = np.array([r["cell"] for r in found], dtype=int)
        self.far = np.array([r["far"] for r in found], dtype=float)
        return placed.drop("own")

    def others(self, x: np.ndarray, cell: np.ndarray, reach: np.ndarray, k: int) -> tuple:
        """Pairs (row, cell) of other cells that can hold rows within ``reach``, and the bound."""
        d = _distances(x, self.pivots[self.ids], self.power)
        near = d - self.far[None, :] <= reach[:, None] + 1e-9 * (1.0 + d)
        near &= self.ids[None, :] != cell[:, None]
        row, at = np.nonzero(near)
        return row, self.ids[at], _slack(reach + 1e-9 * (1.0 + reach))


class _Boxes:
    """Cells that are the leaves of a k-d tree, each with the box of its rows."""

    rows_at_once = 1_000

    def __init__(self, sample: np.ndarray, leaves: int, power: float):
        """Cut the sample at medians of the widest coordinate, until its parts are small."""
        self.power, self.sizes = power, {}
        most = -(-len(sample) // leaves)
        column, cut, child, parent, waiting = [0], [0.0], [-1], [-1], [(0, sample)]
        while waiting:
            node, points = waiting.pop()
            width = points.max(axis=0) - points.min(axis=0)
            if len(points) <= most or not width.max() > 0:
                continue
            c = int(width.argmax())
            own = np.sort(points[:, c])
            at = own[(len(own) - 1) // 2]
            if at == own[-1]:
                at = own[own < at][-1]
            column[node], cut[node], child[node] = c, float(at), len(child)
            low = points[:, c] <= at
            for side in (low, ~low):
                waiting.append((len(child), points[side]))
                column.append(0), cut.append(0.0), child.append(-1), parent.append(node)
        self.column, self.cut, self.child, self.parent = map(np.array, (column, cut, child, parent))

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(x), dtype=int), np.arange(len(x))
        while True:
            inner = self.child[node] >= 0
            if not inner.any():
                return node
            right = ~(x[rows, self.column[node]] <= self.cut[node])
            node = np.where(inner, self.child[node] + right, node)

    def place(self, rows: DataFrame) -> DataFrame:
        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    x = np.stack(batch["x"].to_numpy())
                    yield batch.assign(cell=self.leaf(x).astype("int32"))

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        return cut_lineage(rows.mapInPandas(assign, f"{schema}, cell int"))

    def hold(self, train: DataFrame) -> DataFrame:
        """The rows with their cells, whose sizes and boxes are noted, also those of inner nodes."""
        placed = self.place(train)
        one = placed.select(F.size("x").alias("n")).first()
        dims = range(one["n"] if one else 0)
        found = placed.groupBy("cell").agg(
            F.count(F.lit(1)).alias("n"),
            F.array(*[F.min(F.col("x")[j]) for j in dims]).alias("low"),
            F.array(*[F.max(F.col("x")[j]) for j in dims]).alias("high")).collect()
        self.sizes = {r["cell"]: r["n"] for r in found}
        self.n = np.zeros(len(self.cut), dtype=np.int64)
        self.low = np.full((len(self.cut), len(dims)), np.inf)
        self.high = -self.low
        for r in found:
            self.n[r["cell"]], self.low[r["cell"]], self.high[r["cell"]] = r["n"], r["low"], r["high"]
        for node in range(len(self.cut) - 1, 0, -1):  # children come after their parents
            up = self.parent[node]
            self.n[up] += self.n[node]
            self.low[up] = np.minimum(self.low[up], self.low[node])
            self.high[up] = np.maximum(self.high[up], self.high[node])
        return placed

    def _norm(self, gaps: np.ndarray) -> np.ndarray:
        total = np.zeros(len(gaps))
        for j in range(gaps.shape[1]):
            _add_gap(total, gaps[:, j], self.power)
        return _root(total, self.power)

    def others(self, x: np.ndarray, cell: np.ndarray, reach: np.ndarray, k: int) -> tuple:
        """Pairs (row, cell) of other cells that can hold rows within ``reach``, and the bound.

        Where no bound is known, the far corner of the smallest box of k rows around is one.
        """
        node = cell.astype(int)
        while (few := (self.n[node] < k) & (node > 0)).any():
            node = np.where(few, self.parent[node], node)
        corner = np.maximum(np.abs(x - self.low[node]), np.abs(x - self.high[node]))
        far = np.where(self.n[node] >= k, self._norm(corner), np.inf)
        reach = _slack(np.where(np.isinf(reach), far, reach))
        row, node = np.arange(len(x)), np.zeros(len(x), dtype=int)
        found = []
        while len(row):
            gaps = np.maximum(np.maximum(self.low[node] - x[row], x[row] - self.high[node]), 0.0)
            near = (self._norm(gaps) <= reach[row]) & (self.n[node] > 0)
            row, node = row[near], node[near]
            inner = self.child[node] >= 0
            done = ~inner & (node != cell[row])
            found.append((row[done], node[done]))
            row, left = row[inner], self.child[node[inner]]
            row, node = np.r_[row, row], np.r_[left, left + 1]
        rows, cells = (np.concatenate(c) if c else np.zeros(0, int) for c in zip(*found))
        return rows, cells, reach


class NearestNeighbours(Estimator):
    """Nearest-neighbour learner; the training rows are the model.

    ``algorithm`` is ``exact`` or, for many dimensions, ``projection``: an index of which training
    rows, taken as queries, found ``recall`` of their true neighbours.
    """

    def __init__(self, k: int, weights: str, power: float, n_classes: int | None, seed: int,
                 algorithm: str = "exact", recall: float = 0.9):
        super().__init__()
        if algorithm not in ("exact", "projection"):
            raise ValueError("algorithm must be 'exact' or 'projection'")
        self.k, self.weights, self.power = k, weights, power
        self.n_classes, self.seed = n_classes, seed
        self.algorithm, self.recall = algorithm, recall

    def _fit(self, dataset: DataFrame) -> NearestNeighboursModel:
        rows = cut_lineage(dataset.select(
            F.monotonically_increasing_id().alias("tid"),
            vector_to_array("features").alias("x"),
            F.col("label").cast("double").alias("y"),
        ))
        index = None
        if self.algorithm == "projection":
            from tablewright.operators.projection_index import build_index, calibrate

            index = build_index(rows, self.power, seed=self.seed)
            asked = rows.select(F.col("tid").alias("qid"), "x")
            index = calibrate(index, asked, rows, self.k + 1, self.recall)  # itself and k others
        return NearestNeighboursModel(self, rows, index)


class NearestNeighboursModel(Model):
    def __init__(self, settings: NearestNeighbours, train: DataFrame, index=None):
        super().__init__()
        self.settings, self.train, self.index = settings, train, index

    def neighbours(self, queries: DataFrame) -> DataFrame:
        s = self.settings
        if self.index is None:
            return nearest_neighbours(queries, self.train, s.k, s.power, s.seed)
        from tablewright.operators.projection_index import search

        return search(self.index, queries, s.k)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        s = self.settings
        rows = cut_lineage(dataset.withColumn("_qid", F.monotonically_increasing_id()))
        found = self.neighbours(
            rows.select(F.col("_qid").alias("qid"), vector_to_array("features").alias("x")))
        weight = F.lit(1.0)
        if s.weights == "distance":
            # a neighbour at distance zero outweighs all others
            zero = F.max((F.col("dist") == 0).cast("int")).over(Window.partitionBy("qid"))
            found = found.withColumn("_zero", zero)
            weight = F.when(
                F.col("_zero") == 1, (F.col("dist") == 0).cast("double")
            ).otherwise(1.0 / F.col("dist"))
        found = found.withColumn("w", weight)
        if s.n_classes is None:
            scored = found.groupBy("qid").agg(
                (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("prediction")
            )
        else:
            shares = [
                F.sum(F.when(F.col("y") == float(c), F.col("w")).otherwise(0.0)) / F.sum("w")
                for c in range(s.n_classes)
            ]
            probability = F.array(*shares)
            scored = found.groupBy("qid").agg(probability.alias("probability"))
            best = F.array_position("probability", F.array_max("probability")) - 1
            scored = scored.withColumn("prediction", best.cast("double"))
        return rows.join(scored.withColumnRenamed("qid", "_qid"), "_qid", "left").drop("_qid")
