"""No row, column, class or pair may disappear: cases that once lost some."""

import math

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tablewright.core import TaskSpec
from tablewright.operators import association, errors, evaluation, splits, temporal, training


def gappy(spark):
    return spark.range(200).select(
        "id", F.when(F.col("id") % 10 != 0, F.col("id").cast("double")).alias("x"),
        (F.col("id") * 2.0).alias("y"))


def test_every_row_gets_a_prediction(spark):
    df = gappy(spark)
    model = LinearRegression(featuresCol="features", labelCol="y").fit(
        training.assemble(df.where("x IS NOT NULL"), ["x"]))
    out = training.predict(model, df, ["x"])
    assert out.count() == 200 and out.columns == ["id", "x", "y", "prediction"]
    assert out.where("prediction IS NULL").count() == 20 == out.where("x IS NULL").count()


def test_training_says_what_it_leaves_out(spark):
    df, task = gappy(spark), TaskSpec("y", "regression")
    with pytest.raises(ValueError, match="20 rows"):
        training.training_set(df, ["x"], task, ["id"], folds=2)
    assert training.training_set(df, ["x"], task, ["id"], folds=2, missing="drop").n == 180


def test_all_categories_are_segments(spark):
    df = spark.range(60).select(
        F.concat(F.lit("c"), F.col("id") % 12).alias("c"), F.lit(1).alias("label"),
        (F.col("id") % 2).cast("int").alias("prediction"))
    found = errors.segment_metrics(df, ["c"], errors.error_flag(), n_bins=4)
    assert found.count() == 12
    assert errors.segment_metrics(df, ["c"], errors.error_flag(), top_values=3).count() == 3


def test_slices_use_rows_with_missing_features(spark):
    df = spark.range(400).select(
        F.when(F.col("id") % 4 != 0, F.col("id").cast("double")).alias("x"), F.lit(1).alias("label"),
        (F.col("id") % 4 != 0).cast("int").alias("prediction"))
    found = errors.slice_discovery(df, ["x"], "binary")
    assert any("x missing" in row[2] and row[5] == 100 for row in found)


def test_twelve_columns_in_time(spark):
    df = spark.range(30).select(
        F.date_add(F.lit("2024-01-01"), F.col("id").cast("int")).alias("day"),
        *[(F.col("id") * k).cast("double").alias(f"v{k}") for k in range(1, 13)])
    assert temporal.temporal_patterns(df, "day").count() == 12


def test_dense_matrix_of_many_labels(spark):
    df = spark.range(2_100).select(
        F.col("id").cast("int").alias("label"), F.col("id").cast("int").alias("prediction"))
    assert evaluation.confusion_matrix(df).count() == 2_100**2
    assert evaluation.confusion_matrix(df, dense=False).count() == 2_100


def test_unknown_labels_are_refused(spark):
    df = spark.createDataFrame(
        [("a", [0.5, 0.5]), ("z", [0.5, 0.5])], "label string, probability array<double>")
    with pytest.raises(Exception, match="not among the classes"):
        evaluation.log_loss(df, ["a", "b"]).collect()
    known = evaluation.log_loss(df.where("label = 'a'"), ["a", "b"]).first()[0]
    assert math.isclose(known, math.log(2))


def test_coarse_keys_still_give_validation_rows_and_all_folds(spark):
    df = spark.range(10_000).select((F.col("id") % 4).alias("k"), F.lit("c").alias("t"))
    split = splits.stratified_split(df, "t", ["k"], 0.2, 42)
    counts = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert counts["validation"] == 2_500 and counts["train"] == 7_500
    folds = splits.assign_folds(df, ["k"], 3, 42, "t").groupBy("fold").count().collect()
    assert len(folds) >= 2 and sum(r["count"] for r in folds) == 10_000


def test_correlation_of_large_offsets_and_leading_gaps(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((4_000, 5)) + 1.7e9
    x[:, 1] = x[:, 0] + rng.standard_normal(4_000) * 0.3
    rows = [[None if i < 1_500 and j < 2 else float(v) for j, v in enumerate(r)]
            for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, ", ".join(f"c{j} double" for j in range(5)))
    df = df.coalesce(1)
    many = association.pairwise_correlations(df, df.columns)
    few = association.pairwise_correlations(df, ["c0", "c1"])
    want = np.corrcoef(x[1_500:, 0], x[1_500:, 1])[0, 1]
    assert len(many) == 10
    assert math.isclose(many[("c0", "c1")], want, abs_tol=1e-6)
    assert math.isclose(few[("c0", "c1")], many[("c0", "c1")], abs_tol=1e-9)


def test_load_table_returns_rows_with_nulls(spark, tmp_path):
    from tablewright.plans.profile_plans import load_table

    orders = spark.createDataFrame(
        [(1, "O", None), (2, None, 2.5), (None, "F", 1.0)], "o_orderkey long, s string, p double")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    found = load_table(spark, str(tmp_path))
    assert found.schema.simpleString() == orders.schema.simpleString()
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, orders.collect()), key=repr)


def test_history_of_one_large_workspace(spark, monkeypatch):
    """A workspace with nine of ten runs is cut into ranges, the others are windows of their own."""
    from tablewright.operators import runs

    i = F.col("id")
    df = spark.range(3_000).select(
        F.when(i % 10 != 0, "big").when(i % 20 == 0, None).otherwise((i % 7).cast("string")).alias("workspace"),
        i.alias("run_id"), F.when(i % 13 != 0, (i * 7919 % 997).cast("double")).alias("score"),
        (i * 31 % 503).alias("created_at")).repartition(7)
    whole = runs.optimization_history(df)
    assert "rangepartitioning" not in whole._jdf.queryExecution().toString().lower()
    monkeypatch.setattr(runs, "LARGE_WORKSPACE", 200)
    cut = runs.optimization_history(df)
    assert cut.count() == whole.count() == 3_000 and cut.exceptAll(whole).count() == 0
    low = runs.optimization_history(df, metric="rmse")
    assert low.where("best_so_far > score").count() == 0
