"""Association, normality and special functions against direct computations."""

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.core import resolve_task
from tablewright.functions.special import f_upper_tail, t_quantile, t_two_sided
from tablewright.operators import association, issues, normality, profile, temporal


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(3)
    n = 600
    a = rng.normal(size=n).round(1)
    pdf = pd.DataFrame(
        {
            "a": a,
            "b": (a * 2 + rng.normal(size=n)).round(1),
            "c": rng.integers(0, 5, n).astype(float),
            "d": rng.normal(100, 5, n),
            "fixed": 3.0,
        }
    )
    pdf.loc[pdf.index % 7 == 0, "b"] = np.nan
    return pdf, spark.createDataFrame(pdf).replace(float("nan"), None)


def test_pearson_both_ways(numbers):
    pdf, df = numbers
    expected = pdf.corr()
    pairs = list(combinations(pdf.columns, 2))
    for found in (
        association._corr_of_pairs(df, pairs),
        {p: association._corr_of_pairs(df, [p])[p] for p in pairs},
    ):
        for (x, y), r in found.items():
            if "fixed" in (x, y):
                assert r is None
            else:
                assert math.isclose(r, expected.loc[x, y], abs_tol=1e-9)


def _tau(x, y):
    keep = ~(np.isnan(x) | np.isnan(y))
    x, y = x[keep], y[keep]
    dx, dy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    return (dx * dy).sum() / math.sqrt((dx**2).sum() * (dy**2).sum())


@pytest.mark.parametrize("bucket", [100_000, 7])
def test_kendall_and_spearman(numbers, bucket):
    pdf, df = numbers
    for x, y in (("a", "b"), ("a", "c"), ("c", "d")):
        tau = association.kendall_tau(df, x, y, codes_per_bucket=bucket)
        assert math.isclose(tau, _tau(pdf[x].to_numpy(), pdf[y].to_numpy()), abs_tol=1e-9)
    found = association.spearman_correlations(df, ["a", "b", "c"])
    for (x, y), r in found.items():
        both = pdf[[x, y]].dropna().rank()
        assert math.isclose(r, both.corr().iloc[0, 1], abs_tol=1e-9)


def test_unknown_method(numbers):
    with pytest.raises(ValueError, match="Unsupported"):
        association.compute_correlations(numbers[1], "a", "cosine")


def test_vif_of_a_combination(spark):
    df = spark.range(500).select(
        (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 23).cast("double").alias("b"),
        (F.col("id") % 17 * 2 + F.col("id") % 23).cast("double").alias("mix"),
        (F.col("id") % 2).alias("y"), F.lit(1.0).alias("fixed"),
    )
    found = {r["feature"]: r["vif"] for r in association.variance_inflation(df, "y").collect()}
    assert math.isclose(found["mix"], 10_000, rel_tol=1e-6) and found["fixed"] == float("inf")


def test_special_functions():
    assert math.isclose(t_two_sided(2.0, 10), 0.07338803, abs_tol=1e-7)
    assert math.isclose(f_upper_tail(3.0, 2, 20), 0.07253815028640571, abs_tol=1e-9)
    assert math.isclose(t_quantile(0.975, 4), 2.7764451, abs_tol=1e-6)


def test_normality_small(spark):
    values = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    w, p = normality.shapiro_wilk(np.array(values, dtype=float))
    assert math.isclose(w, 0.79, abs_tol=0.005) and math.isclose(p, 0.0067, abs_tol=0.0002)
    df = spark.createDataFrame([(float(v), 1.0) for v in values], "x double, few double").where(
        "x > 0"
    )
    row = normality.test_normality(df, ["x"]).first()
    assert row["test"] == "shapiro_wilk" and row["is_normal"] is False
    short = normality.test_normality(df.limit(3), ["x"]).first()
    assert short["test"] == "insufficient_data"


def test_anderson_darling_matches_definition(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(10, 2, 6_000).round(2)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    row = normality.test_normality(df).first()
    z = np.sort((x - x.mean()) / x.std(ddof=1))
    cdf = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])
    i = np.arange(1, len(z) + 1)
    expected = -len(z) - np.mean((2 * i - 1) * (np.log(cdf) + np.log(1 - cdf[::-1])))
    assert row["test"] == "anderson_darling"
    assert math.isclose(row["statistic"], expected, rel_tol=1e-6)


def test_shapiro_wilk_of_many_rows(spark):
    rng = np.random.default_rng(6)
    x = np.r_[rng.normal(10, 2, 5_200).round(1), np.full(1_300, 11.0)]  # one value fills many blocks
    df = spark.createDataFrame(pd.DataFrame({"x": x, "one": 3.0}))
    found = {r["column"]: r for r in normality.test_normality(df, method="shapiro_wilk").collect()}
    w, p = normality.shapiro_wilk(x)
    assert found["x"]["test"] == "shapiro_wilk" and found["x"]["n_valid"] == 6_500
    assert math.isclose(found["x"]["statistic"], w, rel_tol=1e-10)
    assert math.isclose(found["x"]["p_value"], p, abs_tol=1e-9)
    assert found["one"]["statistic"] == 1.0 and found["one"]["is_normal"]


def test_few_dates(spark):
    df = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2)], "d string, v int")
    assert temporal.temporal_patterns(df, "d").first()["status"] == "insufficient_valid_dates"
    found = temporal.detect_timestamp_columns(df).collect()
    assert [r["column"] for r in found] == ["d"]


def test_trend(spark):
    df = spark.range(50).select(
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("d"),
        (F.col("id") * 10).alias("v"),
    )
    row = temporal.temporal_patterns(df, "d").first()
    assert row["has_trend"] and math.isclose(row["slope"], 10.0)
    verdict = temporal.temporal_recommendation(temporal.temporal_patterns(df, "d")).first()
    assert verdict["recommendation"] == "temporal_split_recommended"


def test_profile_and_issue_errors(spark, numbers):
    _, df = numbers
    with pytest.raises(ValueError, match="Available columns"):
        profile.profile_dataset(df, "nope")
    assert resolve_task(df, "d").task == "regression"
    assert resolve_task(df, "c").task == "multiclass_classification"
    tables = profile.profile_dataset(df, "c")
    assert tables["numeric"].count() == 5 and tables["class_balance"].count() == 1
    found = {r["issue"] for r in issues.detect_data_issues(df, "c").collect()}
    assert {"constant", "near_constant", "class_imbalance"} <= found


def test_majority_values_under_skew(spark):
    df = spark.range(1_000).select(
        F.when(F.col("id") % 50 == 0, F.col("id").cast("string")).otherwise("x").alias("s"),
        F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id") + 10).alias("half"),
    )
    assert issues.majority_values(df, ["s", "half"]) == {"s": ("x", 0.98)}


def test_class_pairs_in_blocks(spark):
    rng = np.random.default_rng(4)
    rows = [(int(k), float(rng.normal(k % 7, 1)), float(rng.normal())) for k in range(130)
            for _ in range(1 + k % 4)]
    df = spark.createDataFrame(rows, "k int, x double, y double").selectExpr("string(k) k", "x", "y")
    one, many = (
        {r.feature: r.separability for r in association.separability(df, "k", block).collect()}
        for block in (1_000, 9))
    pdf = pd.DataFrame(rows, columns=["k", "x", "y"])
    for c in ("x", "y"):
        m = pdf.groupby("k")[c].agg(["size", "mean", "var"])
        m = m[m["size"] > 1].to_numpy()
        want = np.mean([(a[1] - b[1]) ** 2 / (a[2] + b[2]) for a, b in combinations(m, 2)])
        assert math.isclose(one[c], want, rel_tol=1e-9) and math.isclose(many[c], want, rel_tol=1e-9)


def test_class_pairs_from_sums(spark, monkeypatch):
    """Variances over many magnitudes, and classes without any; no pair is visited."""
    rng = np.random.default_rng(9)
    rows = [(f"c{k}", float(1e6 + rng.normal(k % 5, 1) + s * w))
            for k in range(300) for w in [0.0 if k % 10 == 0 else 10.0 ** rng.uniform(-4, 5)]
            for s in rng.normal(size=3).tolist()]
    rows += [(f"z{k}", float(k)) for k in range(5) for _ in range(2)] + [("alone", 1.0)]
    df = spark.createDataFrame(rows, "k string, x double")
    want, pairs = 0.0, 0
    m = pd.DataFrame(rows, columns=["k", "x"]).groupby("k")["x"].agg(["size", "mean", "var"])
    for a, b in combinations(m[m["size"] > 1].to_numpy(), 2):
        if a[2] + b[2] > 0:
            want, pairs = want + (a[1] - b[1]) ** 2 / (a[2] + b[2]), pairs + 1
    monkeypatch.setattr(association, "_ratio_sums", lambda *_: 1 / 0)
    found = association.separability(df, "k", 20).first().separability
    assert math.isclose(found, want / pairs, rel_tol=1e-8)


def test_rates_give_the_reciprocal():
    s = np.geomspace(1e-9, 1e9, 500)
    c, t = association._rates(1e-9, 1e9)
    assert np.allclose((c * np.exp(-t * s[:, None])).sum(1) * s, 1, rtol=1e-13, atol=0)
