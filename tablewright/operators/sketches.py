"""Column profiles that are kept and merged: new rows are profiled alone, the stored rest is not read.

A stored row sums up one column of one batch of rows: exact counts, moments and range, and two
mergeable sketches for what cannot be added up exactly, distinct values and quantiles. Merging is
an aggregate over these rows, so a profile costs nothing per row of old data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.core import col, numeric_columns, require_columns

#: Size of the quantile sketch: a rank is off by 0.2 % of the rows at most in 99 of 100 cases.
QUANTILE_K, RANK_ERROR = 4_096, 0.002
#: Registers of the distinct sketch as a power of two: about 0.8 % standard error.
DISTINCT_BITS, DISTINCT_ERROR = 14, 0.03
COLUMNS_PER_JOB = 20


def batch_sketches(df: DataFrame, batch: str, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column of a batch of rows: counts, moments and sketches.

    Numeric columns have moments, range and a quantile sketch, others NULL there; every column has
    its rows, its missing values and a distinct sketch. NaN counts as missing.
    """
    names = list(columns or df.columns)
    require_columns(df, names)
    numeric = set(numeric_columns(df))
    out = None
    for start in range(0, len(names), COLUMNS_PER_JOB):
        group = names[start : start + COLUMNS_PER_JOB]
        structs = [_sketch_of(c, c in numeric).alias(f"s{i}") for i, c in enumerate(group)]
        rows = df.agg(*structs).select(F.inline(F.array(*[F.col(f"s{i}") for i in range(len(group))])))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("batch", F.lit(batch))


def _sketch_of(c: str, numeric: bool) -> Column:
    value = col(c)
    if numeric:
        value = value.cast("double")
        value = F.when(~F.isnan(value), value)
        text = (F.when(value.isNotNull(), col(c))).cast("string")
    else:
        text = value.cast("string")
    none = F.lit(None).cast("double")
    return F.struct(
        F.lit(c).alias("column"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count(value).alias("n"),
        (F.avg(value) if numeric else none).alias("mean"),
        (F.var_pop(value) * F.count(value) if numeric else none).alias("squares"),
        (F.min(value) if numeric else none).alias("min"),
        (F.max(value) if numeric else none).alias("max"),
        F.hll_sketch_agg(text, DISTINCT_BITS).alias("distinct"),
        (F.kll_sketch_agg_double(value, QUANTILE_K) if numeric else F.lit(None).cast("binary"))
        .alias("quantiles"),
    )


def store_sketches(df: DataFrame, path: str, batch: str, columns: Sequence[str] | None = None) -> None:
    """Add the sketches of a batch to the table at ``path``; a batch stored again replaces itself."""
    batch_sketches(df, batch, columns).coalesce(1).write.partitionBy("batch").option(
        "partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def load_sketches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("batch", F.col("batch").cast("string"))


def merged_profile(
    sketches: DataFrame, probabilities: Sequence[float] = (0.25, 0.5, 0.75)
) -> DataFrame:
    """Profile of all batches: one row per column.

    Counts, mean, standard deviation and range are exact; ``n_unique`` and ``quantiles`` (a value
    per probability) are estimates within DISTINCT_ERROR and RANK_ERROR. A column that some batches
    lack is missing in their rows.
    """
    total = sketches.groupBy("batch").agg(F.max("n_rows").alias("r")).agg(F.sum("r").alias("all_rows"))
    n = F.col("n").cast("double")
    first = sketches.groupBy("column").agg(
        (F.sum(n * F.col("mean")) / F.sum(F.when(F.col("mean").isNotNull(), n))).alias("centre"))
    joined = sketches.join(F.broadcast(first), "column")  # one row per column
    apart = F.col("mean") - F.col("centre")
    merged = joined.groupBy("column").agg(
        F.sum("n").alias("n"), F.first("centre").alias("mean"),
        F.sum(F.col("squares") + n * apart * apart).alias("squares"),
        F.min("min").alias("min"), F.max("max").alias("max"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("n_unique"),
        F.kll_merge_agg_double("quantiles").alias("_quantiles"),
        F.count("quantiles").alias("_sketched"))
    asked = F.array(*[F.lit(float(p)) for p in probabilities])
    return merged.crossJoin(F.broadcast(total)).select(  # a single row of totals
        "column", F.col("all_rows").alias("n_rows"), "n",
        (100 * (1 - F.col("n") / F.col("all_rows"))).alias("missing_pct"),
        "mean", F.when(F.col("n") > 1, F.sqrt(F.col("squares") / (F.col("n") - 1))).alias("std"),
        "min", "max", "n_unique",
        F.when((F.col("_sketched") > 0) & (F.col("n") > 0),
               F.kll_sketch_get_quantile_double("_quantiles", asked)).alias("quantiles"))


def profile_with_stored(
    new: DataFrame, stored: DataFrame, batch: str = "new",
    probabilities: Sequence[float] = (0.25, 0.5, 0.75),
) -> DataFrame:
    """Profile of stored batches and new rows together; only the new rows are read."""
    names = [r["column"] for r in stored.select("column").distinct().collect()]
    own = batch_sketches(new, batch, [c for c in new.columns if c in names])
    kept = stored.where(F.col("batch") != batch)
    return merged_profile(kept.unionByName(own), probabilities)
