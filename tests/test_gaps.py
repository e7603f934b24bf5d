"""Training and prediction on rows that lack features."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.core import BINARY, MULTICLASS, REGRESSION, TaskSpec
from tablewright.operators import gaps, training
from tablewright.persistence import load_fitted, save_fitted


def rows_with_gaps(spark, n=900):
    i = F.col("id")
    a, b = (i * 37 % 101).cast("double"), (i * 11 % 53).cast("double")
    lost_a, lost_b = i % 6 == 1, i % 5 == 2
    return spark.range(n).select(
        "id", F.when(~lost_a, a).alias("a"),
        F.when(lost_b, F.lit(float("nan"))).otherwise(b).alias("b"),
        F.lit(None).cast("double").alias("empty"), (i % 3).alias("whole"),
        # gaps of a behave like large values of a, gaps of b like small values of b
        (F.when(lost_a | (a > 60), 10.0).otherwise(0.0)
         + F.when(lost_b | (b < 20), 0.0).otherwise(5.0)).alias("y"),
        F.when(lost_a | (a > 60), "yes").otherwise("no").alias("k"),
        F.when(lost_a, "gap").when(a > 60, "yes").otherwise("no").alias("m"),
    )


FEATURES = ["a", "b", "empty", "whole"]


def test_sides_follow_the_folds(spark):
    rows = rows_with_gaps(spark)
    data = training.training_set(rows, FEATURES, TaskSpec("y", REGRESSION), ["id"], 3, missing="learn")
    assert data.n == 900 and data.gaps.side == {
        "a": "above", "b": "below", "empty": "below", "whole": "below"}
    assert data.gaps.gaps == {"a": 150, "b": 180, "empty": 900, "whole": 0}
    assert data.gaps.value["a"] > 100 and data.gaps.value["b"] < 0
    classes = training.training_set(
        rows, FEATURES, TaskSpec("k", BINARY), ["id"], 3, missing="learn")
    assert classes.gaps.side["a"] == "above"


def test_loss_equals_a_tree_fitted_by_hand():
    """Fold losses from counts equal those of splits tried one by one on the rows."""
    rng = np.random.default_rng(0)
    for _ in range(20):
        bins, fold = rng.integers(0, 5, 60), rng.integers(0, 3, 60)
        y = rng.normal(size=60) + 2 * (bins > 2)
        n, sums, squares = np.zeros((3, 5)), np.zeros((3, 5, 1)), np.zeros((3, 5))
        np.add.at(n, (fold, bins), 1)
        np.add.at(sums, (fold, bins, 0), y)
        np.add.at(squares, (fold, bins), y * y)
        order = rng.permutation(5).tolist()
        place = np.argsort(order)[bins]
        want = 0.0
        for k in range(3):
            train, held = fold != k, fold == k
            options = []
            for cut in range(4):
                low = place <= cut
                if (train & low).any() and (train & ~low).any():
                    means = y[train & low].mean(), y[train & ~low].mean()
                    error = sum(((y[train & s] - m) ** 2).sum() for s, m in zip((low, ~low), means))
                    options.append((error, cut, means))
            _, cut, means = min(options)
            low = place <= cut
            want += sum(((y[held & s] - m) ** 2).sum() for s, m in zip((low, ~low), means))
        assert np.isclose(gaps._fold_loss(n, sums, squares, order), want)


@pytest.mark.parametrize("model", ["xgboost", "random_forest", "extra_trees"])
def test_every_row_is_predicted(spark, model, tmp_path):
    rows = rows_with_gaps(spark)
    task = TaskSpec("y", REGRESSION)
    data = training.training_set(rows, FEATURES, task, ["id"], 3, missing="learn")
    run = training.train_model(data, model, {"n_estimators": 10, "max_depth": 3, "max_features": None})
    assert run.mean_score > 0.95
    scored = training.predict(run.model, rows, FEATURES)
    assert scored.count() == 900 and scored.where("prediction IS NULL").count() == 0
    assert scored.where(F.abs(F.col("prediction") - F.col("y")) > 2.5).count() < 20
    save_fitted(run.model, str(tmp_path / model), spark)
    again = training.predict(load_fitted(str(tmp_path / model), spark), rows, FEATURES)
    assert again.exceptAll(scored).count() == 0


def test_ensembles_and_classes(spark):
    rows = rows_with_gaps(spark, 400)
    task = TaskSpec("m", MULTICLASS)
    data = training.training_set(rows, FEATURES, task, ["id"], 2, missing="learn")
    configs = [{"model_type": "random_forest", "hyperparameters": {"n_estimators": 5}},
               {"model_type": "extra_trees", "hyperparameters": {"n_estimators": 3}}]
    stacked = training.train_stacking(data, configs, meta_params={"max_iter": 20})
    seeds = training.train_seed_ensemble(
        rows, FEATURES, task, ["id"], "random_forest", {"n_estimators": 5}, 2, 2, missing="learn")
    for run in (stacked, seeds):
        scored = training.predict(run.model, rows, FEATURES, data.classes)
        assert scored.where("predicted_class IS NULL").count() == 0
        assert scored.where("predicted_class = m").count() > 360


def test_learners_that_need_all_features_refuse(spark):
    data = training.training_set(
        rows_with_gaps(spark, 200), ["a"], TaskSpec("y", REGRESSION), ["id"], 2, missing="learn")
    with pytest.raises(ValueError, match="trees do"):
        training.train_model(data, "linear_regression")
    with pytest.raises(ValueError, match="missing must be"):
        training.training_set(
            rows_with_gaps(spark, 9), ["a"], TaskSpec("y", REGRESSION), ["id"], 2, missing="guess")
