"""Neighbour estimates of mutual information against brute force over all pairs of rows."""

import math

import numpy as np
import pandas as pd
import pytest

from tablewright.operators import association, neighbour_information as ni


def psi(x):
    h = 1e-5
    return (math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h)


def plain_class(c, v, k=3):
    count = pd.Series(c).map(pd.Series(c).value_counts()).to_numpy()
    keep = count > 1
    c, v, count = c[keep], v[keep], count[keep]
    own_k, m = [], []
    for i in range(len(v)):
        same = np.sort(np.abs(v[c == c[i]] - v[i]))
        kk = min(k, len(same) - 1)
        d = same[kk]
        gap = np.abs(v - v[i])
        own_k.append(psi(kk))
        m.append(psi((gap < d * (1 - 1e-9)).sum() if d else (gap == 0).sum()))
    return max(0, psi(len(v)) + np.mean(own_k) - np.mean([psi(x) for x in count]) - np.mean(m))


def plain_pair(x, y, k=3):
    x, y = x / x.std(), y / y.std()
    out = []
    for i in range(len(x)):
        a, b = np.abs(x - x[i]), np.abs(y - y[i])
        d = np.sort(np.maximum(a, b))[k]
        for gap in (a, b):
            out.append(psi((gap < d * (1 - 1e-9)).sum() if d else (gap == 0).sum()))
    return max(0, psi(len(x)) + psi(k) - 2 * np.mean(out))


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(7)
    n = 500
    kind = rng.choice(["a", "b", "c", "c", "c"], n).astype(object)
    kind[0], kind[1], kind[2] = "alone", "two", "two"
    shift = pd.Series(kind).map({"a": 0.0, "b": 1.5, "c": 3.0}).fillna(9.0).to_numpy()
    x = shift + rng.normal(size=n)
    tied = np.where(rng.random(n) < 0.4, 1.25, np.round(x, 1))
    pdf = pd.DataFrame({"kind": kind, "x": x, "tied": tied, "noise": rng.normal(size=n) * 1e6,
                        "y": x * x + rng.normal(size=n) / 4})
    return pdf, spark.createDataFrame(pdf)


def test_digamma():
    x = np.array([1.0, 2.0, 3.5, 6.0, 10.0, 1e6])
    assert np.allclose(ni.digamma(x), [psi(v) for v in x[:5]] + [math.log(1e6) - 0.5e-6], atol=1e-8)


@pytest.mark.parametrize("rows", [ni.ROWS_PER_PART, 20])
def test_class_target(numbers, monkeypatch, rows):
    """With twenty rows a partition, neighbours and counts reach over several borders."""
    monkeypatch.setattr(ni, "ROWS_PER_PART", rows)
    pdf, df = numbers
    found = association.mutual_information(
        df, "kind", features=["x", "tied", "noise"], method="neighbours")
    got = {r.feature: r.mi for r in found.collect()}
    for c in ("x", "tied", "noise"):
        assert math.isclose(got[c], plain_class(pdf["kind"].to_numpy(), pdf[c].to_numpy()), abs_tol=1e-6)
    assert got["x"] > 0.4 > 0.1 > got["noise"]


def test_continuous_target(numbers):
    pdf, df = numbers
    found = association.mutual_information(
        df, "y", "regression", features=["x", "tied", "noise", "kind"], method="neighbours")
    got = {r.feature: r.mi for r in found.collect()}
    for c in ("x", "tied", "noise"):
        assert math.isclose(got[c], plain_pair(pdf[c].to_numpy(), pdf["y"].to_numpy()), abs_tol=1e-6)
    assert math.isclose(got["kind"], plain_class(pdf["kind"].to_numpy(), pdf["y"].to_numpy()), abs_tol=1e-6)


def test_constant_columns_and_methods(spark, numbers):
    _, df = numbers
    flat = spark.createDataFrame([(1.0, 2.0, "a")] * 6 + [(1.0, 3.0, "b")] * 6, "x double, y double, c string")
    assert association.mutual_information(flat, "y", "regression", features=["x"],
                                          method="neighbours").first().mi == 0
    assert association.mutual_information(flat, "c", features=["x"], method="neighbours").first().mi == 0
    with pytest.raises(ValueError, match="method"):
        association.mutual_information(df, "kind", method="guess")
