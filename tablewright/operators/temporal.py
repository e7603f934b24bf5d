"""Timestamp detection, trend and autocorrelation over time-ordered rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.core import categorical_columns, col, local_rows, numeric_columns, require_columns
from tablewright.functions.expressions import safe_corr
from tablewright.functions.special import correlation_p_value
from tablewright.operators.ordering import global_row_index, lagged_products

# fixed values: date layouts tried in this order
DATE_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
    "MMM d, yyyy",
    "d MMM yyyy",
    "yyyyMMdd",
)


def parse_date(c: Column) -> Column:
    """First layout that fits the text, else NULL."""
    text = F.trim(c.cast("string"))
    return F.coalesce(
        text.try_cast("timestamp_ntz"),
        *[F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in DATE_FORMATS],
    )


def _is_time(df: DataFrame, column: str) -> bool:
    return isinstance(
        df.schema[column].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)
    )


def detect_timestamp_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Non-numeric columns of which more than 80 % of the values are dates; one aggregate."""
    names = list(columns or categorical_columns(df))
    schema = "column string, success_rate double, min_date string, max_date string"
    if not names:
        return local_rows(df.sparkSession, [], schema)
    exprs = []
    for i, c in enumerate(names):
        parsed = col(c).cast("timestamp_ntz") if _is_time(df, c) else parse_date(col(c))
        exprs += [
            F.count(col(c)).alias(f"n{i}"),
            F.count(parsed).alias(f"k{i}"),
            F.min(parsed).cast("string").alias(f"lo{i}"),
            F.max(parsed).cast("string").alias(f"hi{i}"),
        ]
    r = df.agg(*exprs).first()
    rows = [
        (c, r[f"k{i}"] / r[f"n{i}"], r[f"lo{i}"], r[f"hi{i}"])
        for i, c in enumerate(names)
        if r[f"n{i}"] and r[f"k{i}"] / r[f"n{i}"] > 0.8
    ]
    return local_rows(df.sparkSession, rows, schema)


def sample_values(df: DataFrame, column: str, k: int = 3) -> DataFrame:
    """A few non-null values of a column as text."""
    return df.where(col(column).isNotNull()).select(col(column).cast("string")).limit(k)


def temporal_patterns(
    df: DataFrame,
    temporal: str,
    tie_break: Sequence[str] = (),
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Trend against the time-ordered row number and lag-1 autocorrelation, per numeric column.

    ``tie_break`` columns order rows with equal times. Fewer than ten valid dates give a single
    row with ``status`` ``insufficient_valid_dates``.
    """
    require_columns(df, [temporal, *tie_break])
    schema = (
        "column string, slope double, r_squared double, p_value double, has_trend boolean, "
        "autocorrelation double, n_valid_dates long, status string"
    )
    spark = df.sparkSession
    names = [c for c in (columns or numeric_columns(df)) if c not in (temporal, *tie_break)]
    when = col(temporal) if _is_time(df, temporal) else parse_date(col(temporal))
    rows = df.select(
        when.alias("_when"),
        *[col(t).alias(f"_tie{i}") for i, t in enumerate(tie_break)],
        *[col(c).cast("double").alias(c) for c in names],
    ).where(F.col("_when").isNotNull())
    if not names:
        return local_rows(spark, [], schema)
    order = [F.col("_when"), *[F.col(f"_tie{i}") for i in range(len(tie_break))]]
    indexed = global_row_index(rows, order)
    if indexed.n < 10:
        return local_rows(
            spark,
            [(None, None, None, None, None, None, indexed.n, "insufficient_valid_dates")],
            schema,
        )
    index = F.col("row_index").cast("double")
    exprs = []
    for i, c in enumerate(names):
        x = col(c)
        exprs += [
            F.count(x).alias(f"n{i}"),
            F.regr_slope(x, index).alias(f"slope{i}"),
            safe_corr(index, x).alias(f"r{i}"),
            F.avg(x).alias(f"mean{i}"),
            F.var_pop(x).alias(f"var{i}"),
        ]
    stats = indexed.table.agg(*exprs).first()
    lagged = lagged_products(
        indexed, names, {c: stats[f"mean{i}"] or 0.0 for i, c in enumerate(names)}
    )
    out = []
    for i, c in enumerate(names):
        n, r = stats[f"n{i}"], stats[f"r{i}"]
        slope = r2 = p = trend = auto = None
        if n >= 10 and r is not None and math.isfinite(r):
            slope, r2 = stats[f"slope{i}"], r * r
            p = correlation_p_value(r, n)
            trend = abs(r) > 0.3 and p < 0.05
        if n >= 20 and stats[f"var{i}"]:
            total, pairs = lagged[c]
            auto = total / pairs / stats[f"var{i}"]
        out.append((c, slope, r2, p, trend, auto, indexed.n, "ok"))
    return local_rows(spark, out, schema)


def temporal_recommendation(patterns: DataFrame) -> DataFrame:
    """Overall verdict of ``temporal_patterns``."""
    moving = F.coalesce(F.max(F.col("has_trend")), F.lit(False))
    sticky = F.coalesce(F.max(F.abs("autocorrelation") > 0.3), F.lit(False))
    return patterns.agg(
        moving.alias("has_trend"),
        sticky.alias("has_autocorrelation"),
        F.when(moving | sticky, "temporal_split_recommended")
        .otherwise("temporal_split_not_needed")
        .alias("recommendation"),
    )
