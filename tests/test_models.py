"""Training, ensembles, nearest neighbours, evaluation and error analysis of fitted models."""

import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.core import BINARY, MULTICLASS, REGRESSION, TaskSpec
from tablewright.operators import errors, evaluation, knn, models, training
from tablewright.streaming.scoring import start_scoring

FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    i = F.col("id")
    a, b = (i * 37 % 101).cast("double"), (i * 11 % 53).cast("double")
    return spark.range(600).select(
        "id", a.alias("a"), b.alias("b"), (a * 2 - b).alias("y"),
        F.when(a + b > 75, "yes").otherwise("no").alias("k"),
        F.when(a > 66, "x").when(a > 33, "z").otherwise("w").alias("m"),
    )


@pytest.fixture(scope="module")
def binary(rows):
    return training.training_set(rows, FEATURES, TaskSpec("k", BINARY), ["id"], 3)


def test_every_family_has_a_learner():
    for f in models.FAMILIES.values():
        for task in f.tasks:
            assert models.make_learner(f.name, task, n_rows=10, n_features=2) is not None
    with pytest.raises(ValueError, match="Unknown model"):
        models.family("oracle")
    with pytest.raises(ValueError, match="does not support"):
        models.make_learner("svc", REGRESSION)


def test_cross_validation_and_prediction(rows, binary, tmp_path):
    run = training.train_model(
        binary, "random_forest", {"n_estimators": 8, "class_weight": "balanced"},
        keep_predictions=True,
    )
    assert run.mean_score > 0.85 and len(run.cv_scores) == 3
    assert run.out_of_fold.select("row_key").distinct().count() == 600
    training.save_model(run.model, str(tmp_path / "m"))
    again = training.load_model(str(tmp_path / "m"))
    scored = training.predict(again, rows, FEATURES, binary.classes)
    assert {"predicted_class", "probability"} <= set(scored.columns)
    assert scored.where(F.col("predicted_class") == F.col("k")).count() > 540
    with pytest.raises(ValueError, match="must be numeric"):
        training.predict(again, rows, ["a", "k"])


def test_multiclass_boosting_has_probabilities(rows):
    data = training.training_set(rows, FEATURES, TaskSpec("m", MULTICLASS), ["id"], 2)
    run = training.train_model(data, "lightgbm", {"n_estimators": 3, "max_depth": 3},
                               keep_predictions=True)
    assert run.mean_score > 0.9
    total = run.out_of_fold.select(
        F.aggregate("probability", F.lit(0.0), lambda x, y: x + y).alias("t")
    )
    assert total.where(F.abs(F.col("t") - 1) > 1e-9).isEmpty()


def test_linear_regression_is_exact(rows):
    data = training.training_set(rows, FEATURES, TaskSpec("y", REGRESSION), ["id"], 2)
    runs = training.tune(
        data, [{"model_type": "linear_regression"}, {"model_type": "knn_regressor"}]
    )
    assert runs[0].model_type == "linear_regression" and runs[0].mean_score > 0.999999
    found = evaluation.permutation_importance(
        rows.withColumn("label", F.col("y")),
        lambda d: training.apply_model(runs[0].model, d), FEATURES, ["id"], REGRESSION, repeats=2,
    )
    drops = {r["feature"]: r["importance"] for r in found.collect()}
    assert drops["a"] > drops["b"] > 0.1


def test_stacking_and_seeds(rows, binary):
    run = training.train_stacking(
        binary,
        [
            {"model_type": "random_forest", "hyperparameters": {"n_estimators": 4}},
            {"model_type": "logistic_regression", "hyperparameters": {"max_iter": 20}},
        ],
    )
    assert len(run.components) == 2 and run.mean_score > 0.85
    scored = run.model.transform(binary.rows)
    assert scored.count() == 600 and "prediction" in scored.columns
    seeds = training.train_seed_ensemble(
        rows, FEATURES, TaskSpec("k", BINARY), ["id"], "random_forest", {"n_estimators": 3},
        n_seeds=2, folds=2,
    )
    assert len(seeds.cv_scores) == 2
    assert training.score(seeds.model.transform(binary.rows), binary.task) > 0.9


@pytest.mark.parametrize("pivots", [1, 9])
@pytest.mark.parametrize("power", [1.0, 2.0])
def test_nearest_neighbours_are_exact(spark, pivots, power):
    rng = np.random.default_rng(1)
    points = rng.integers(0, 12, (500, 3)).astype(float)
    points[:170] = 4.0  # a third of the rows are copies
    frame = pd.DataFrame({"tid": range(500), "x": points.tolist(), "y": points[:, 0]})
    train = spark.createDataFrame(frame, "tid long, x array<double>, y double")
    queries = train.where("tid % 5 = 0").selectExpr("tid as qid", "x")
    found = knn.nearest_neighbours(
        queries, train, 6, power, chunk_rows=40, query_rows=20, pivots=pivots
    ).toPandas()
    for q in range(0, 500, 5):
        d = (np.abs(points - points[q]) ** power).sum(1) ** (1 / power)
        order = np.lexsort((np.arange(500), d.round(9)))[:6]
        mine = found[found["qid"] == q].sort_values("place")
        assert np.allclose(mine["dist"], d[order], atol=1e-9)
        assert list(mine["tid"]) == list(order)


def test_insights_of_a_model(binary):
    run = training.train_model(binary, "logistic_regression", keep_predictions=True)
    assert [f for f, _ in evaluation.builtin_importances(run.model, FEATURES)] == FEATURES
    assert set(errors.top_features(run.model, FEATURES, 1)) <= set(FEATURES)
    report = evaluation.evaluate(run.out_of_fold, BINARY, [0.0, 1.0])
    assert report["probability_metrics"].first()["roc_auc"] > 0.9


def test_leaf_rules_follow_leaf_order():
    text = (
        "DecisionTreeClassificationModel: depth=2\n"
        "  If (feature 0 <= 1.5)\n   Predict: 0.0\n"
        "  Else (feature 0 > 1.5)\n   If (feature 1 <= 2.0)\n    Predict: 1.0\n"
        "   Else (feature 1 > 2.0)\n    Predict: 0.0\n"
    )
    assert errors.leaf_rules(text, ["a", "b"]) == [
        "a <= 1.50", "a > 1.50 AND b <= 2.00", "a > 1.50 AND b > 2.00"
    ]


def test_significance_special_cases():
    assert errors.paired_t_test(5, 0.0, 0.0)[0] == 1.0
    assert errors.paired_t_test(5, 0.1, 0.0)[0] == 0.0
    p, low, high, verdict = errors.paired_t_test(5, 0.05, 0.01)
    assert p < 0.05 and low < 0.05 < high and verdict.startswith("B is")


def test_fold_scores_must_match(spark):
    scores = spark.createDataFrame(
        [("a", 0, 0.5), ("a", 1, 0.6), ("b", 0, 0.7)], "run_id string, fold int, score double"
    )
    with pytest.raises(ValueError, match="same folds"):
        errors.compare_fold_scores(scores, "a", "b")


def test_stream_scoring(spark, rows, binary, tmp_path):
    model = binary.learner("random_forest", {"n_estimators": 3}, 1).fit(binary.rows)
    source = str(tmp_path / "in")
    rows.select("id", "a", "b").write.parquet(source)
    stream = spark.readStream.schema("id long, a double, b double").parquet(source)
    query = start_scoring(
        stream, model, FEATURES, binary.classes, str(tmp_path / "out"), str(tmp_path / "cp")
    )
    query.awaitTermination(60)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 600 and "predicted_class" in out.columns


def test_dense_matrix_has_a_bound(spark):
    df = spark.range(50).select(F.col("id").alias("label"), (F.col("id") + 1).alias("prediction"))
    assert evaluation.confusion_matrix(df).count() == 51 * 51
    with pytest.raises(ValueError, match="more than 20 labels"):
        evaluation.confusion_matrix(df, most_labels=20)
    assert evaluation.confusion_matrix(df, dense=False, most_labels=20).count() == 50


@pytest.mark.parametrize("power, dims", [(2.0, 3), (np.inf, 2), (1.0, 1), (3.0, 2), (2.0, 12)])
def test_neighbours_by_boxes_and_pivots(spark, monkeypatch, power, dims):
    """Gaps, copies, far queries and cells of fewer than k rows; few cells are searched for a query."""
    rng = np.random.default_rng(2)
    points = np.r_[rng.normal(size=(900, dims)), np.full((60, dims), 5.0),
                   100 + rng.normal(size=(40, dims)) * 1e-7].round(6)
    asked = np.r_[points[::7], rng.normal(size=(40, dims)) * 30]
    train = spark.createDataFrame(pd.DataFrame(
        {"tid": range(1_000), "x": points.tolist(), "y": points[:, 0]}), "tid long, x array<double>, y double")
    queries = spark.createDataFrame(pd.DataFrame(
        {"qid": range(len(asked)), "x": asked.tolist()}), "qid long, x array<double>")
    seen, pairs = [], knn.pair_chunks
    monkeypatch.setattr(knn, "pair_chunks", lambda q, t, *a: seen.append(q.count()) or pairs(q, t, *a))
    found = knn.nearest_neighbours(queries, train, 7, power, pivots=150).toPandas()
    gaps = np.abs(points[None] - asked[:, None])
    d = gaps.max(2) if np.isinf(power) else (gaps**power).sum(2) ** (1 / power)
    for q in range(len(asked)):
        mine = found[found["qid"] == q].sort_values("place")
        order = np.lexsort((np.arange(1_000), d[q].round(9)))[:7]
        assert np.allclose(mine["dist"], d[q][order], atol=1e-9)
        assert set(mine["tid"]) <= set(np.flatnonzero(d[q] <= d[q][order[-1]] + 1e-9))
    if dims <= 2:  # pivots bound these worse
        assert sum(seen) < 30 * len(asked)


def test_training_set_has_parts_for_its_rows(spark, monkeypatch):
    """Not one for each shuffle partition; and folds do not wait for each other on few rows."""
    monkeypatch.setattr(training, "PART_ROWS", 20)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    rows = spark.range(300).selectExpr("id", "double(id % 7) x", "id % 2 c", "id * 2.0 y")
    try:
        for task, parts in ((TaskSpec("c", BINARY), 15), (TaskSpec("y", REGRESSION), 15)):
            data = training.training_set(rows, ["x"], task, ["id"], 3)
            assert data.rows.rdd.getNumPartitions() == parts and data.n == 300
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    waiting, fit = threading.Barrier(4, timeout=60), training.TrainingSet.fit
    monkeypatch.setattr(training.TrainingSet, "fit", lambda *a: (waiting.wait(), fit(*a))[1])
    run = training.train_model(data, "linear_regression", parallelism=1)
    assert len(run.cv_scores) == 3 and run.model is not None


def test_groups_of_neighbours_stay_small(spark, monkeypatch):
    """A crowded cell and its queries are cut into groups of a few megabytes, which a worker holds whole."""
    sizes = []

    def watch(asked, placed, k, power):
        for rows in (asked, placed):
            sizes.append(rows.groupBy("cell", "chunk", "slice").count().agg({"count": "max"}).first()[0])
        return search(asked, placed, k, power)

    search = knn.pair_chunks
    monkeypatch.setattr(knn, "pair_chunks", watch)
    rows = spark.range(12_000).select(
        F.col("id"), F.array(*[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1.0 for i in range(64)]).alias("x"))
    queries, train = rows.select(F.col("id").alias("qid"), "x"), rows.select(
        F.col("id").alias("tid"), "x", F.lit(0.0).alias("y"))
    found = knn.nearest_neighbours(queries, train, 1, pivots=1)
    assert found.where("qid = tid AND dist = 0").count() == 12_000
    assert max(sizes) * 64 * 8 < 4 << 20
