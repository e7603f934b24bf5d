"""Linear classifiers of all folds fitted together, against Spark's learners."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.core import BINARY, TaskSpec
from tablewright.operators import linear_fits, training


@pytest.fixture(scope="module")
def data(spark):
    i = F.col("id")
    rows = spark.range(900).select(
        "id", (i * 37 % 101).cast("double").alias("a"), ((i * 11 % 53) * 1000).cast("double").alias("b"),
        F.lit(3.0).alias("same"), (i % 7).alias("c"),
        F.when((i * 37 % 101) + (i * 11 % 53) + (i * i % 31) > 90, "yes").otherwise("no").alias("k"))
    return training.training_set(rows, ["a", "b", "same", "c"], TaskSpec("k", BINARY), ["id"], 3)


def jobs(spark) -> int:
    return max(spark.sparkContext.statusTracker().getJobIdsForGroup(None), default=-1)


@pytest.mark.parametrize("model, params", [
    ("logistic_regression", {"max_iter": 50}),
    ("logistic_regression", {"class_weight": "balanced", "C": 0.01}),
    ("logistic_regression", {"penalty": None, "max_iter": 30}),
    ("svc", {"C": 1.0}),
    ("svc", {"class_weight": "balanced"}),
])
def test_every_fold_has_the_model_of_spark(data, model, params):
    learner = data.learner(model, params, 42)
    learner.setMaxIter(6)
    for out, fitted in zip([1, None], linear_fits.fit_together(data, learner, [1, None])):
        own = learner.fit(data.rows if out is None else data.rows.where(F.col("fold") != out))
        assert type(fitted) is type(own)
        assert np.allclose(fitted.coefficients.toArray(), own.coefficients.toArray(), rtol=1e-6, atol=1e-12)
        assert fitted.intercept == pytest.approx(own.intercept, rel=1e-6)


def test_a_step_of_all_folds_is_one_job(spark, data):
    before = jobs(spark)
    run = training.train_model(data, "svc", {"C": 1.0})
    assert len(run.cv_scores) == 3 and run.mean_score > 0.8
    assert len(run.model.coefficients) == 4
    assert jobs(spark) - before < 400  # a job for each evaluation of each fold would be over a thousand


def test_rows_of_one_class_and_infinite_values_are_left_to_spark(spark, data):
    rows = spark.range(40).select(
        "id", F.col("id").cast("double").alias("a"), F.when(F.col("id") == 7, "x").otherwise("y").alias("k"))
    few = training.training_set(rows, ["a"], TaskSpec("k", BINARY), ["id"], 2)
    assert few.fit_folds("logistic_regression", {}, 42, False) is None
    assert len(training.cross_validate(few, "logistic_regression", {"max_iter": 5})[0]) == 2
    wide = rows.withColumn("k", F.when(F.col("id") % 2 == 0, "x").otherwise("y"))
    odd = training.training_set(
        wide.withColumn("a", F.when(F.col("id") == 3, F.lit(float("inf"))).otherwise(F.col("a"))),
        ["a"], TaskSpec("k", BINARY), ["id"], 2)
    assert odd.fit_folds("svc", {}, 42, False) is None
    assert data.fit_folds("random_forest", {"n_estimators": 2}, 42, False) is None
    assert not linear_fits.takes(data.learner("logistic_regression", {"penalty": "l1"}, 42), 2, 4)


def test_blocks_hold_every_row_once_whatever_their_order(spark, data, monkeypatch):
    monkeypatch.setattr(linear_fits, "BLOCK_ROWS", 64)
    blocks = linear_fits.block_rows(data.rows.repartition(5, "label"), True, data.n)
    moments = linear_fits.fold_moments(blocks)
    total = moments[0]
    for k in (1, 2):
        total = linear_fits._merged(total, moments[k])
    weight = data.rows.agg(F.sum("weight")).first()[0]
    assert total[0] == pytest.approx(weight) and sum(total[4]) == pytest.approx(weight)
    read = blocks.map(linear_fits._read).collect()
    assert sum(z.shape[1] for _, z, _ in read) == data.n == 900
    assert max(z.shape[1] for _, z, _ in read) <= 64
