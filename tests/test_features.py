"""Feature operations: semantics, errors, reuse of fitted stages."""

import math

import pytest
from pyspark.sql import functions as F

from tablewright.operators.features import (
    auto_preprocess,
    engineer_features,
    feature_pipeline,
    operation_names,
    summary,
)
from tablewright.operators.features.grouped import string_codes
from tablewright.operators.features.scalar import likeliest_lambdas


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [
            (1, "a", 1.0, 10.0, 1), (2, "b", 2.0, None, 0), (3, None, 3.0, 30.0, 1),
            (4, "a", None, 40.0, 0), (5, "c", 5.0, 50.0, 1), (6, "b", 6.0, 60.0, 0),
        ],
        "id int, k string, x double, y double, target int",
    )


def values(df, column):
    return [r[column] for r in df.orderBy("id").select(column).collect()]


def test_unknown_operation_and_columns(people):
    with pytest.raises(ValueError, match="Supported: bin_numeric"):
        engineer_features(people, [{"type": "magic"}])
    with pytest.raises(ValueError, match="columns not found"):
        engineer_features(people, [{"type": "drop_columns", "columns": ["nope"]}])
    for bad in (
        {"type": "impute_numeric", "columns": ["x"], "strategy": "guess"},
        {"type": "impute_categorical", "columns": ["k"], "strategy": "guess"},
        {"type": "groupby_aggregate", "group_column": "k", "agg_column": "x", "agg_func": "sum"},
        {"type": "categorical_interaction", "columns": ["k"]},
        {"type": "feature_select", "target_column": "target", "method": "luck"},
    ):
        with pytest.raises(ValueError):
            engineer_features(people, [bad])
    assert len(operation_names()) == 19


def test_missing_becomes_nan_category(people):
    out, _ = engineer_features(people, [{"type": "label_encode", "columns": ["k"]}])
    assert values(out, "k") == [0, 1, 3, 0, 2, 1]
    out, _ = engineer_features(people, [{"type": "one_hot_encode", "columns": ["k"]}])
    assert out.columns == ["id", "x", "y", "target", "k_a", "k_b", "k_c"]
    assert out.where("id = 3").select("k_a", "k_b", "k_c").first() == (0, 0, 0)


def test_sparse_one_hot(people):
    filled = people.fillna("z", ["k"])
    out, _ = engineer_features(
        filled, [{"type": "one_hot_encode", "columns": ["k"], "sparse": True}]
    )
    assert "k_vec" in out.columns and "k" not in out.columns


def test_statistics_come_from_training_rows(spark, people):
    chain = [
        {"type": "impute_numeric", "columns": ["x"], "strategy": "median"},
        {"type": "standard_scale", "columns": ["y"]},
        {"type": "target_encode", "columns": ["k"], "target_column": "target"},
    ]
    model = feature_pipeline(chain).fit(people)
    fresh = spark.createDataFrame(
        [(9, "a", None, 38.0, None), (10, "unseen", 1.0, None, None)], people.schema
    )
    out = model.transform(fresh)
    assert values(out, "x") == [3.0, 1.0]
    assert values(out, "y")[0] == pytest.approx(0.0) and values(out, "y")[1] is None
    weight = 1 / (1 + math.exp(-0.1))
    assert values(out, "k") == [pytest.approx(0.5 * (1 - weight) + 0.5 * weight), None]


def test_rank_of_training_values_elsewhere(people):
    _, model = engineer_features(people, [{"type": "rank_transform", "columns": ["x"]}])
    assert values(model.transform(people.where("id > 4")), "x") == [4.0, 5.0]
    assert values(model.transform(people), "x") == [1.0, 2.0, 3.0, None, 4.0, 5.0]


@pytest.mark.parametrize("limit", [100, 2])
def test_codes_in_one_task_and_sorted(people, limit):
    codes = string_codes(people.where("k is not null"), F.col("k"), in_one_task=limit)
    found = {r["text"]: r["code"] for r in codes.table.collect()}
    assert found == {"a": 0, "b": 1, "c": 2}


def test_bins_and_polynomials(people):
    out, _ = engineer_features(
        people, [{"type": "bin_numeric", "columns": ["y"], "n_bins": 2}]
    )
    assert values(out, "y") == [0.0, None, 0.0, 1.0, 1.0, 1.0]
    out, _ = engineer_features(
        people,
        [{"type": "polynomial_features", "columns": ["x", "y"], "interaction_only": True}],
    )
    assert out.columns == ["id", "k", "target", "x", "y", "x y"]
    out, _ = engineer_features(
        people, [{"type": "bin_numeric", "columns": ["x"], "n_bins": 2, "strategy": "kmeans"}]
    )
    assert values(out, "x") == [0.0, 0.0, 0.0, None, 1.0, 1.0]


def test_power_transform_finds_log(spark):
    df = spark.range(1, 2_000).select(F.exp(F.col("id") % 50 / 10.0).alias("v"))
    assert abs(likeliest_lambdas(df, ["v"], "box-cox")["v"]) < 0.2
    with pytest.raises(ValueError, match="positive"):
        engineer_features(
            df.select((F.col("v") - 5).alias("v")),
            [{"type": "power_transform", "columns": ["v"], "method": "box-cox"}],
        )


def test_summary_and_auto(people):
    chain = [{"type": "log_transform", "columns": ["y"]}]
    out, _ = engineer_features(people, chain)
    report = summary(people, out, chain)
    assert report["new_shape"] == [6, 5] and report["operations_applied"] == ["log_transform"]
    df, _, steps = auto_preprocess(people.withColumn("same", F.lit("s")), "target")
    assert steps == [
        "impute_numeric_median", "impute_categorical_mode", "drop_constant_columns",
        "one_hot_encode",
    ]
    assert df.where("x is null or y is null").isEmpty() and "same" not in df.columns


def test_statistics_of_one_group_share_a_join(spark):
    """Five statistics of a group are one lookup; one that reads an earlier result is a lookup of its own."""
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 5.0), (None, 7.0)], "g int, x double")
    base = {"type": "groupby_aggregate", "group_column": "g", "agg_column": "x"}
    configs = [{**base, "agg_func": f} for f in ("mean", "std", "count", "min", "max")]
    out, model = engineer_features(df, [*configs, {**base, "agg_column": "g_max_x", "agg_func": "min"}])
    assert len(model.stages) == 2
    assert out.columns == ["g", "x", "g_mean_x", "g_std_x", "g_count_x", "g_min_x", "g_max_x", "g_min_g_max_x"]
    assert sorted(out.collect(), key=lambda r: r.x) == [
        (1, 2.0, 3.0, 2.0**0.5, 2, 2.0, 4.0, 4.0), (1, 4.0, 3.0, 2.0**0.5, 2, 2.0, 4.0, 4.0),
        (2, 5.0, 5.0, None, 1, 5.0, 5.0, 5.0), (None, 7.0, None, None, None, None, None, None)]
