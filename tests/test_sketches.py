"""Stored sketches merged with new rows against the profile of all rows."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.operators import sketches


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(9)
    n = 30_000
    pdf = pd.DataFrame({
        "big": 1e9 + rng.normal(size=n), "few": rng.integers(0, 9, n), "id": np.arange(n),
        "word": rng.choice([f"w{i}" for i in range(700)], n), "part": rng.integers(0, 5, n)})
    pdf.loc[rng.random(n) < 0.1, "big"] = np.nan
    return pdf, spark.createDataFrame(pdf)


def test_merged_equals_profile_of_all(spark, rows, tmp_path):
    pdf, df = rows
    path = str(tmp_path / "kept")
    for k in range(4):
        sketches.store_sketches(df.where(F.col("part") == k).drop("part"), path, f"b{k}")
    sketches.store_sketches(df.where("part = 2").drop("part"), path, "b2")  # again: no double count
    stored = sketches.load_sketches(spark, path)
    assert stored.count() == 16
    found = {r.column: r for r in sketches.profile_with_stored(
        df.where("part = 4").drop("part"), stored, "b4").collect()}
    for c in ("big", "few", "id"):
        v = pdf[c].dropna()
        r = found[c]
        assert (r.n_rows, r.n, r.min, r.max) == (30_000, len(v), v.min(), v.max())
        assert math.isclose(r.mean, v.mean(), rel_tol=1e-12) and math.isclose(r.std, v.std(), rel_tol=1e-6)
        assert abs(r.n_unique - v.nunique()) <= sketches.DISTINCT_ERROR * v.nunique()
        for p, q in zip((0.25, 0.5, 0.75), r.quantiles):
            low, high = np.quantile(v, [p - sketches.RANK_ERROR, p + sketches.RANK_ERROR])
            assert low <= q <= high
        assert math.isclose(r.missing_pct, 100 * pdf[c].isna().mean(), abs_tol=1e-9)
    word = found["word"]
    assert word.mean is None and word.quantiles is None and abs(word.n_unique - 700) <= 21


def test_empty_batches_and_missing_columns(spark, rows):
    _, df = rows
    none = sketches.batch_sketches(df.limit(0).select("big", "word"), "none")
    some = sketches.batch_sketches(df.where("part = 1").select("big"), "some")
    found = {r.column: r for r in sketches.merged_profile(none.unionByName(some)).collect()}
    n = df.where("part = 1").count()
    assert found["big"].n_rows == n and found["word"].n == 0 and found["word"].missing_pct == 100
    assert found["word"].quantiles is None and found["big"].quantiles is not None
    with pytest.raises(ValueError, match="not found"):
        sketches.batch_sketches(df, "x", ["nothing"])
