"""Approximate nearest neighbours in many dimensions: a written index of random projections.

Each table of the index projects all rows to a few random directions and assigns them to the
nearest of some pivots there. A query looks into the cells whose pivots are nearest in every table
(multi-probe) and ranks what it finds by the true distance. How many cells it takes is measured:
probes are doubled until a sample of queries, compared with all rows, has the wanted recall.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.core import cut_lineage, ensure_checkpoint_dir, local_rows
from tablewright.operators.knn import CHUNK_ROWS, QUERY_ROWS, _distances, choose_pivots, pair_chunks

#: Directions of a projection, rows aimed at in a cell, and cells of a table at most: pivots travel
#: to every task, larger cells are cut into chunks.
WIDTH, CELL_ROWS, MAX_CELLS = 16, 2_000, 16_384
#: Queries whose neighbours among all rows are found to measure the recall.
SAMPLE = 200


@dataclass
class ProjectionIndex:
    """Directions (dimension x width) and pivots of each table, and the written rows and cells.

    ``rows`` has cell, chunk, tid, x, y, each row once per table; ``cells`` has cell and chunks, at
    most MAX_CELLS rows per table. Both lie below ``path``.
    """

    path: str
    directions: list[np.ndarray]
    pivots: list[np.ndarray]
    power: float
    n: int
    rows: DataFrame | None = None
    cells: DataFrame | None = None
    probes: int = 1
    recall: float | None = None
    measured: tuple[tuple[int, float], ...] = ()

    @property
    def most_probes(self) -> int:
        return max(len(p) for p in self.pivots)


def _cells_of(points: np.ndarray, tables: list[tuple], probes: int) -> np.ndarray:
    """The ``probes`` nearest cells in every table, numbered over all tables, row by row."""
    found, first = [], 0
    for directions, pivots in tables:
        d = _distances(points @ directions, pivots, 2.0)
        take = min(probes, len(pivots))
        near = np.argpartition(d, take - 1, axis=1)[:, :take] if take < len(pivots) else np.broadcast_to(
            np.arange(len(pivots)), d.shape)
        found.append(near + first)
        first += len(pivots)
    return np.hstack(found)


def _placed(df: DataFrame, index: ProjectionIndex, probes: int, columns: list[str]) -> DataFrame:
    """One row per cell looked into: the columns and ``cell``."""
    fields = [df.schema[c] for c in columns]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["cell int"])
    tables = list(zip(index.directions, index.pivots))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 2_000):
                part = batch.iloc[start : start + 2_000]
                cells = _cells_of(np.stack(part["x"].to_numpy()), tables, probes)
                out = part.loc[part.index.repeat(cells.shape[1])].copy()
                out["cell"] = cells.ravel().astype("int32")
                yield out[[*columns, "cell"]]

    return df.select(*columns).mapInPandas(run, schema)


def build_index(
    train: DataFrame, power: float = 2.0, tables: int = 3, width: int = WIDTH, seed: int = 42,
    cells: int | None = None, chunk_rows: int = CHUNK_ROWS, path: str | None = None,
) -> ProjectionIndex:
    """Write an index of ``train`` (tid long, x array<double>, y double), every row in each table.

    Pivots are a sample of rows chosen by hash, one per CELL_ROWS rows and at most MAX_CELLS. A
    cell above ``chunk_rows`` rows is cut into chunks, so copies of one point do not make one task.
    """
    spark = train.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark)}/projections-{uuid.uuid4().hex}"
    n = train.count()
    if not n:
        raise ValueError("there are no rows to index")
    wanted = cells or max(1, min(MAX_CELLS, n // CELL_ROWS))
    rng = np.random.default_rng(seed)
    directions, pivots = [], []
    for t in range(tables):
        sample = choose_pivots(train, n, wanted, seed + t)
        dimension = sample.shape[1]
        directions.append(rng.standard_normal((dimension, min(width, dimension)))
                          / np.sqrt(min(width, dimension)))
        pivots.append(sample @ directions[-1])
    index = ProjectionIndex(path, directions, pivots, power, n)
    placed = cut_lineage(_placed(train, index, 1, ["tid", "x", "y"]))
    sizes = placed.groupBy("cell").agg(
        F.ceil(F.count(F.lit(1)) / chunk_rows).cast("int").alias("chunks"))
    sizes.write.mode("overwrite").parquet(f"{path}/cells")
    index.cells = spark.read.parquet(f"{path}/cells")
    own = F.pmod(F.xxhash64("tid"), F.col("chunks")).cast("int")
    placed.join(F.broadcast(index.cells), "cell").select(
        "cell", own.alias("chunk"), "tid", "x", "y").write.mode("overwrite").parquet(f"{path}/rows")
    index.rows = spark.read.parquet(f"{path}/rows")
    return index


def search(
    index: ProjectionIndex, queries: DataFrame, k: int, probes: int | None = None,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """Rows ``qid, place, dist, tid, y``: the k nearest of the rows found for each query.

    ``queries`` has ``qid long, x array<double>``. Queries of a crowded cell are cut into slices;
    every chunk of its rows meets every slice in a small group, from which k rows go on.
    """
    asked = cut_lineage(_placed(queries, index, probes or index.probes, ["qid", "x"]))
    slices = asked.groupBy("cell").agg(
        F.ceil(F.count(F.lit(1)) / query_rows).cast("int").alias("slices"))
    load = F.broadcast(cut_lineage(index.cells.join(slices, "cell")))  # one row per cell
    asked = asked.join(load, "cell").select(
        "qid", "x", "cell", F.pmod(F.xxhash64("qid"), F.col("slices")).cast("int").alias("slice"),
        F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    rows = index.rows.join(load, "cell").select(
        "tid", "x", "y", "cell", "chunk",
        F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    found = pair_chunks(asked, rows, k, index.power).dropDuplicates(["qid", "tid"])
    best = Window.partitionBy("qid").orderBy("dist", "tid")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select(
        "qid", "place", "dist", "tid", "y")


def nearest_of_all(queries: DataFrame, train: DataFrame, k: int, power: float) -> DataFrame:
    """(qid, reach): distance of the k-th nearest row, by comparing SAMPLE queries with all rows."""
    sample = queries.orderBy(F.xxhash64("qid"), "qid").limit(SAMPLE).collect()
    ids = np.array([r["qid"] for r in sample])
    points = np.array([r["x"] for r in sample], dtype=float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((len(ids), 0))
        for batch in batches:
            if len(batch):
                own = _distances(points, np.stack(batch["x"].to_numpy()), power)
                held = np.sort(np.hstack([held, own]), axis=1)[:, :k]
        yield pd.DataFrame({"qid": np.repeat(ids, held.shape[1]), "dist": held.ravel()})

    near = train.select("x").mapInPandas(run, "qid long, dist double")
    place = F.row_number().over(Window.partitionBy("qid").orderBy("dist"))
    return near.withColumn("place", place).where(F.col("place") <= k).groupBy("qid").agg(
        F.max("dist").alias("reach"), F.count(F.lit(1)).alias("k"))


def recall_of(found: DataFrame, nearest: DataFrame) -> float:
    """Share of the true neighbours that were found, ties counting as found."""
    hits = nearest.join(found, "qid", "left").groupBy("qid", "k").agg(
        F.count(F.when(F.col("dist") <= F.col("reach") * (1 + 1e-9) + 1e-300, 1)).alias("hits"))
    row = hits.agg(F.sum(F.least("hits", "k")), F.sum("k")).first()
    return row[0] / row[1] if row[1] else 1.0


def calibrate(
    index: ProjectionIndex, queries: DataFrame, train: DataFrame, k: int, recall: float = 0.9
) -> ProjectionIndex:
    """Set ``probes`` to the least power of two with the wanted recall on a sample of queries.

    All cells probed is the exact search, so the recall is always reached. Every step is noted in
    ``measured`` and written to the index as the table ``recall``.
    """
    nearest = cut_lineage(nearest_of_all(queries, train, k, index.power))
    sample = cut_lineage(queries.join(F.broadcast(nearest.select("qid")), "qid").select("qid", "x"))
    probes, steps = 1, []
    while True:
        got = recall_of(search(index, sample, k, probes), nearest)
        steps.append((probes, float(got)))
        if got >= recall or probes >= index.most_probes:
            break
        probes = min(2 * probes, index.most_probes)
    index.probes, index.recall, index.measured = probes, float(got), tuple(steps)
    local_rows(train.sparkSession, steps, "probes int, recall double").coalesce(1).write.mode(
        "overwrite").parquet(f"{index.path}/recall")
    return index
