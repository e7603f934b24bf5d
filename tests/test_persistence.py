"""Fitted objects written, and read in a new session, must give the same rows."""

import os
import subprocess
import sys

from pyspark.sql import functions as F

from tablewright.core import BINARY, TaskSpec
from tablewright.operators import training
from tablewright.operators.features import engineer_features
from tablewright.persistence import load_fitted, save_fitted

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def people(spark):
    return spark.range(120).select(
        "id", (F.col("id") % 7).cast("double").alias("x"),
        F.when(F.col("id") % 5 != 0, F.col("id") * 1.5).alias("z"),
        F.concat(F.lit("city"), F.col("id") % 6).alias("city"),
        (F.col("id") % 3).cast("int").alias("fold"), (F.col("id") % 2).cast("int").alias("late"))


CHAIN = [
    {"type": "impute_numeric", "columns": ["z"], "strategy": "median"},
    {"type": "standard_scale", "columns": ["x"]},
    {"type": "target_encode", "columns": ["city"], "target_column": "late", "fold_column": "fold"},
]


def test_chain_in_a_new_session(spark, tmp_path):
    train = people(spark)
    encoded, model = engineer_features(train, CHAIN)
    save_fitted(model, f"{tmp_path}/chain", spark)
    train.write.parquet(f"{tmp_path}/rows")
    want = sorted(map(tuple, encoded.collect()))
    assert sorted(map(tuple, load_fitted(f"{tmp_path}/chain", spark).transform(train).collect())) == want
    script = (
        "from pyspark.sql import SparkSession\n"
        "from tablewright.persistence import load_fitted\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false')"
        ".getOrCreate()\n"
        f"rows = spark.read.parquet('{tmp_path}/rows')\n"
        f"out = load_fitted('{tmp_path}/chain', spark).transform(rows)\n"
        f"out.write.parquet('{tmp_path}/out')\n"
    )
    subprocess.run([sys.executable, "-c", script], check=True, cwd=ROOT, timeout=180)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == want


def test_out_of_fold_encoding_scores_new_rows(spark):
    train = people(spark)
    _, model = engineer_features(train, CHAIN[2:])
    new = train.drop("fold")
    plain, _ = engineer_features(train, [{k: v for k, v in CHAIN[2].items() if k != "fold_column"}])
    want = {r["id"]: r["city"] for r in plain.collect()}
    assert {r["id"]: r["city"] for r in model.transform(new).collect()} == want
    odd = model.transform(train.withColumn("fold", F.lit(99))).collect()
    assert {r["id"]: r["city"] for r in odd} == want


def test_models_and_ensembles(spark, tmp_path):
    rows = people(spark).drop("z")
    data = training.training_set(rows, ["x", "fold"], TaskSpec("late", BINARY), ["id"], folds=2)
    configs = [{"model_type": "logistic_regression"}, {"model_type": "random_forest"}]
    near = training.train_model(data, "knn_classifier", {"n_neighbors": 3}).model
    stack = training.train_stacking(data, configs).model
    seeds = training.train_seed_ensemble(
        rows, ["x", "fold"], TaskSpec("late", BINARY), ["id"], "random_forest", n_seeds=2,
        folds=2).model
    vectors = training.assemble(rows, ["x", "fold"])
    for name, model in (("near", near), ("stack", stack), ("seeds", seeds)):
        save_fitted(model, f"{tmp_path}/{name}", spark)
        again = load_fitted(f"{tmp_path}/{name}", spark)
        one, other = (
            sorted((r["id"], r["prediction"]) for r in m.transform(vectors).select(
                "id", "prediction").collect()) for m in (model, again))
        assert one == other and len(one) == 120
