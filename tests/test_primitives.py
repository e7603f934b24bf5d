"""Order statistics, ranks, indexes and lookups: independent of partitioning and skew."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.functions.expressions import interpolated_bucket
from tablewright.operators import order_stats, ordering
from tablewright.operators.lookup import attach, build_lookup
from tablewright.operators.order_stats import exact_quantiles
from tablewright.operators.ordering import (
    average_rank,
    average_ranks,
    global_row_index,
    lagged_products,
    value_prefix,
)

PARTITIONS = [1, 4, 37]


def skewed(spark, n=4_000, parts=4):
    """A third of the rows share one value, some are missing."""
    i = F.col("id")
    value = (
        F.when(i % 3 == 0, F.lit(7.0))
        .when(i % 11 == 0, F.lit(None))
        .otherwise((i * 7919 % 1009).cast("double") / 10)
    )
    return spark.range(n).select("id", value.alias("x")).repartition(parts)


@pytest.mark.parametrize("parts", PARTITIONS)
@pytest.mark.parametrize(
    "options", [{}, {"accuracy": 50, "list_limit": 30, "small": 5}]
)
def test_quantiles_match_pandas(spark, parts, options):
    df = skewed(spark, parts=parts)
    points = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    found = exact_quantiles(df, ["x"], points, **options)["x"]
    expected = df.toPandas()["x"].quantile(points)
    assert np.allclose([found.quantile(p) for p in points], expected, atol=1e-9)


def test_quantiles_of_nothing(spark):
    df = spark.range(5).select(F.lit(None).cast("double").alias("x"))
    assert exact_quantiles(df, ["x"], [0.5])["x"].quantile(0.5) is None


@pytest.mark.parametrize("parts", PARTITIONS)
@pytest.mark.parametrize("per_bucket", [100_000, 200])
def test_ranks_match_pandas(spark, parts, per_bucket):
    df = skewed(spark, parts=parts)
    out = average_ranks(df, "x", "r", per_bucket).toPandas().sort_values("id")
    assert np.allclose(out["r"], out["x"].rank(), equal_nan=True)
    table = value_prefix(df, F.col("x"), rows_per_bucket=per_bucket, dense=True).table
    table = table.withColumn("r", average_rank()).toPandas().set_index("value").sort_index()
    assert list(table["distinct_before"]) == list(range(len(table)))
    expected = pd.Series(out["x"].rank().values, out["x"].values).dropna().groupby(level=0).first()
    assert np.allclose(table["r"], expected)


@pytest.mark.parametrize("parts", PARTITIONS)
def test_index_and_lag(spark, parts):
    df = skewed(spark, parts=parts).withColumn("t", F.floor(F.col("id") / 1500))
    indexed = global_row_index(df, [F.col("t"), F.col("id")])
    out = indexed.table.toPandas().sort_values(["t", "id"])
    assert list(out["row_index"]) == list(range(4_000)) and indexed.n == 4_000
    x = out["x"].dropna().to_numpy()
    total, pairs = lagged_products(indexed, ["x"], {"x": 1.5})["x"]
    assert pairs == len(x) - 1
    assert np.isclose(total, ((x[:-1] - 1.5) * (x[1:] - 1.5)).sum())


@pytest.mark.parametrize("shuffle", [False, True])
def test_lookup_keeps_every_row(spark, shuffle):
    df = skewed(spark)
    table = df.where("x is not null").groupBy("x").agg(F.count("*").alias("n"))
    lookup = build_lookup(table, ["x"], weight="n", force_shuffle=shuffle)
    out = attach(df, lookup, ["x"])
    assert out.columns == ["id", "x", "n"] and out.count() == 4_000
    pdf = out.toPandas()
    assert (pdf["n"].isna() == pdf["x"].isna()).all()
    counts = pdf["x"].value_counts()
    known = pdf.dropna()
    assert (known["n"] == known["x"].map(counts)).all()
    if shuffle:
        assert lookup.hot == [(7.0,)]


def test_more_ranges_than_a_list_holds(spark):
    """20,000 values in ranges of two: over 4,096 ranges by two cuts, ranks and sums unchanged."""
    i = F.col("id")
    heavy = F.when(i % 3 == 0, 500.5).otherwise((i * 7919 % 20_011).cast("double"))
    df = spark.range(30_000).select("id", heavy.alias("x"), (i % 5).alias("m"))
    found = ordering.column_prefixes(df, [F.col("x"), F.col("x") / 2], {"m": F.col("m")}, 2)
    plan = found._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan
    rows = df.toPandas()
    per = rows.groupby("x").agg(n=("x", "size"), m=("m", "sum")).sort_index()
    for c in (0, 1):
        got = found.where(F.col("c") == c).toPandas().sort_values("value")
        assert np.allclose(got["value"] * (c + 1), per.index)
        for name in ("n", "m"):
            assert (got[name].to_numpy() == per[name].to_numpy()).all()
            assert (got[f"before_{name}"].to_numpy() == per[name].cumsum().to_numpy() - per[name].to_numpy()).all()
    long = df.select(F.lit(0).alias("c"), F.col("x").alias("value"), (F.col("x") / 2_500).cast("int")
                     .cast("long").alias("coarse"))
    placed = ordering._fine_ranges(long, 1_024).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("d"),
        F.min("value").alias("lo"), F.max("value").alias("hi")).orderBy("lo").collect()
    assert len(placed) > 4_096 and max(r.d for r in placed) < 60  # bounded by distinct values
    assert all(a.hi < b.lo and a.bucket < b.bucket for a, b in zip(placed, placed[1:]))


def test_window_sorts_no_single_partition(spark):
    """Ranking a large range must not fall back to one unpartitioned window."""
    df = spark.range(5_000).select((F.col("id") * 7919 % 5_003).cast("double").alias("x"))
    plan = average_ranks(df, "x", "r", 500)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_zones_are_found_by_bisection(spark):
    """Thirty intervals are no thirty comparisons for each value; borders, signed zeros and NaN fall right."""
    finite = [(10.0 * i, 10.0 * i + 3.0) for i in range(30)]
    odd = [-math.inf, math.inf, math.nan, None, -0.0, 0.0, 3.0, math.nextafter(3.0, 9.0), -5e-324, 293.0, 294.0]
    values = odd + [k / 2 for k in range(-5, 620)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for intervals in (finite, [(-math.inf, -1.0), (4.0, 7.0)], [(7.0, math.inf)]):
        found = order_stats._zoned_rows(df, {"x": F.col("x")}, {"x": intervals})

        def zone(v):
            for i, (lo, hi) in enumerate(intervals):
                if v < lo:
                    return 2 * i
                if v <= hi:
                    return 2 * i + 1
            return 2 * len(intervals)

        wanted = sorted((zone(v), v + 0.0 if zone(v) % 2 else None) for v in values if v is not None)
        got = sorted((r["z"], r["v"]) for r in found.collect())
        assert repr(got) == repr(wanted)
        if intervals is finite:
            assert found._jdf.queryExecution().optimizedPlan().toString().count("<=") < 10


def test_buckets_are_found_by_bisection(spark):
    edges = [float(e) for e in range(15)]
    values = [-1.0, -0.0, 0.0, 0.5, 7.0, 13.5, 14.0, 15.0, math.inf, -math.inf, math.nan, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for closed in ("left", "right"):
        bucket = interpolated_bucket(F.col("x"), edges, closed)
        wanted = [None if v is None else 15 if v != v else
                  sum(v > e if closed == "right" else v >= e for e in edges) for v in values]
        assert [r[0] for r in df.select(bucket).collect()] == wanted
        assert " + " not in df.select(bucket)._jdf.queryExecution().optimizedPlan().toString()
