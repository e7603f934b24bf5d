"""The projection index against all rows: recall, exactness with all probes, hot points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.core import MULTICLASS, REGRESSION, TaskSpec
from tablewright.operators import projection_index as pi
from tablewright.operators import training
from tablewright.persistence import load_fitted, save_fitted


def points(spark, n=1500, dimension=48, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((20, dimension)) * 3
    x = centres[rng.integers(0, 20, n)] + rng.standard_normal((n, dimension))
    x[: n // 3] = x[0]  # a third of all rows are one point
    rows = [(i, [float(v) for v in p], float(i % 5)) for i, p in enumerate(x)]
    return x, spark.createDataFrame(rows, "tid long, x array<double>, y double")


@pytest.mark.parametrize("power", [2.0, 1.0])
def test_recall_is_measured_and_reached(spark, power):
    x, train = points(spark)
    queries = train.where("tid % 7 = 0").select(F.col("tid").alias("qid"), "x")
    index = pi.build_index(train, power, cells=40, chunk_rows=60)
    assert index.rows.count() == 3 * 1500 and index.rows.agg(F.max("chunk")).first()[0] > 3
    index = pi.calibrate(index, queries, train, 8, 0.9)
    assert index.recall >= 0.9 and index.probes < 40
    written = spark.read.parquet(f"{index.path}/recall").orderBy("probes").collect()
    assert [tuple(r) for r in written] == list(index.measured) and written[-1].recall == index.recall
    hits = total = 0
    reach = {}
    for q in range(0, 1500, 7):
        d = (np.abs(x - x[q]) ** power).sum(1) ** (1 / power)
        reach[q] = np.sort(d)[7]
    for r in pi.search(index, queries, 8, query_rows=11).collect():
        total += 1
        d = (np.abs(x[r.tid] - x[r.qid]) ** power).sum() ** (1 / power)
        assert abs(d - r.dist) < 1e-6 and r.y == r.tid % 5
        hits += r.dist <= reach[r.qid] + 1e-9
    assert total == 8 * len(reach) and hits / total >= 0.88


def test_all_probes_are_exact(spark):
    x, train = points(spark, 300, 10, 3)
    queries = spark.createDataFrame(
        [(i, [float(v) for v in p]) for i, p in enumerate(np.random.default_rng(5).normal(size=(20, 10)))],
        "qid long, x array<double>")
    index = pi.build_index(train, cells=12)
    found = pi.search(index, queries, 5, index.most_probes).collect()
    for q in queries.collect():
        d = np.sqrt(((x - np.array(q.x)) ** 2).sum(1))
        order = np.lexsort((np.arange(300), d.round(9)))[:5]
        assert [r.tid for r in sorted(found, key=lambda r: r.place) if r.qid == q.qid] == order.tolist()
    with pytest.raises(ValueError, match="no rows"):
        pi.build_index(train.limit(0))


def test_learners_with_the_index(spark, tmp_path):
    rng = np.random.default_rng(2)
    names = [f"f{i}" for i in range(12)]
    data = rng.normal(size=(600, 12))
    kind = (data[:, 0] > 0).astype(int) + (data[:, 1] > 0).astype(int)
    rows = spark.createDataFrame(
        [(i, *map(float, p), int(c), float(p[0] * 3)) for i, (p, c) in enumerate(
            zip(data * np.r_[4, 4, np.ones(10)], kind))],
        "id long, " + ", ".join(f"{n} double" for n in names) + ", c int, y double")
    params = {"n_neighbors": 5, "algorithm": "projection"}
    for model, task in (("knn_classifier", TaskSpec("c", MULTICLASS)), ("knn_regressor", TaskSpec("y", REGRESSION))):
        data_ = training.training_set(rows, names, task, ["id"], 2)
        run = training.train_model(data_, model, params)
        exact = training.train_model(data_, model, {"n_neighbors": 5})
        assert abs(run.mean_score - exact.mean_score) < 0.05 and run.model.index.recall >= 0.9
    save_fitted(run.model, str(tmp_path / "near"), spark)
    again = load_fitted(str(tmp_path / "near"), spark)
    a = training.predict(run.model, rows, names).select("id", "prediction")
    assert a.exceptAll(training.predict(again, rows, names).select("id", "prediction")).count() == 0
