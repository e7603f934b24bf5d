"""Data-quality problems as rows ``issue, column, other, value, detail``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.core import (
    categorical_columns,
    col,
    local_rows,
    numeric_columns,
    require_columns,
    small_cardinality,
)
from tablewright.operators.association import pairwise_correlations
from tablewright.operators.profile import cardinalities, chunks, class_balance, missing_shares

SCHEMA = "issue string, column string, other string, value double, detail string"
HIGH_CARDINALITY = 50


def class_imbalance(df: DataFrame, target: str) -> DataFrame:
    """Class balance of the target; a continuous target is reported as balanced."""
    require_columns(df, [target])
    if target in numeric_columns(df) and small_cardinality(df, target, 20) is None:
        return local_rows(
            df.sparkSession,
            [("class_imbalance", target, None, 1.0, "none")],
            SCHEMA,
        )
    return class_balance(df, target).select(
        F.lit("class_imbalance").alias("issue"),
        F.lit(target).alias("column"),
        F.concat_ws(" / ", "minority_class", "majority_class").alias("other"),
        F.col("minority_ratio").alias("value"),
        F.col("severity").alias("detail"),
    )


def multicollinear_pairs(df: DataFrame, target: str, threshold: float = 0.9) -> DataFrame:
    features = numeric_columns(df, exclude=[target])
    rows = [
        ("multicollinearity", a, b, abs(r), None)
        for (a, b), r in pairwise_correlations(df, features).items()
        if r is not None and abs(r) > threshold
    ]
    rows.sort(key=lambda r: (-r[3], r[1], r[2]))
    return local_rows(df.sparkSession, rows, SCHEMA)


def high_cardinality_columns(
    df: DataFrame, target: str, limit: int = HIGH_CARDINALITY
) -> DataFrame:
    """Categorical features with more than ``limit`` values.

    A sketch selects the candidates; exact counts are taken only for columns near or above it.
    """
    names = categorical_columns(df, exclude=[target])
    rough = cardinalities(df, names, approximate=True) if names else {}
    candidates = [c for c in names if rough[c] > limit * 0.7]
    exact = cardinalities(df, candidates) if candidates else {}
    rows = [
        ("high_cardinality", c, None, float(n), None) for c, n in exact.items() if n > limit
    ]
    return local_rows(df.sparkSession, rows, SCHEMA)


def constant_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with at most one non-null value: minimum equals maximum, no distinct needed."""
    found = []
    for group in chunks(list(columns), 100):
        row = df.agg(
            *[
                F.coalesce(F.min(col(c)) == F.max(col(c)), F.lit(True)).alias(f"k{i}")
                for i, c in enumerate(group)
            ]
        ).first()
        found += [c for i, c in enumerate(group) if row[f"k{i}"]]
    return found


def _short_hash(c: str):
    """52 bits of the value's hash, which the sketch can hold as a double."""
    return F.shiftright(F.xxhash64(col(c)), 12)


def majority_values(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[str, float]]:
    """Value and share of columns in which one value holds more than half of the non-null rows.

    Such a value owns the median of any ordering, so the sketch median of a hash names the only
    candidate and one more aggregate counts it. No values are shuffled.
    """
    names = list(columns)
    if not names:
        return {}
    hashes = df.agg(
        *[
            F.percentile_approx(
                F.when(col(c).isNotNull(), _short_hash(c)), 0.5, 1_000
            ).alias(f"h{i}")
            for i, c in enumerate(names)
        ]
    ).first()
    exprs = []
    for i, c in enumerate(names):
        hit = _short_hash(c) == F.lit(hashes[f"h{i}"]).cast("long")
        hit = hit & col(c).isNotNull()
        exprs += [
            F.max(F.when(hit, col(c).cast("string"))).alias(f"v{i}"),
            (F.count(F.when(hit, 1)) / F.count(col(c))).alias(f"s{i}"),
        ]
    row = df.agg(*exprs).first()
    return {
        c: (row[f"v{i}"], row[f"s{i}"])
        for i, c in enumerate(names)
        if row[f"s{i}"] is not None and row[f"s{i}"] > 0.5
    }


def near_constant_columns(
    df: DataFrame, columns: Sequence[str], threshold: float = 0.95
) -> DataFrame:
    if threshold < 0.5:
        raise ValueError("near_constant_columns needs a threshold of at least 0.5")
    rows = [
        ("near_constant", c, None, share * 100, value)
        for c, (value, share) in majority_values(df, columns).items()
        if share > threshold
    ]
    return local_rows(df.sparkSession, rows, SCHEMA)


def leakage_suspects(df: DataFrame, target: str, threshold: float = 0.95) -> DataFrame:
    """Numeric features that almost determine a numeric target."""
    rows = []
    if target in numeric_columns(df):
        features = numeric_columns(df, exclude=[target])
        found = pairwise_correlations(df, features, against=target)
        rows = [
            ("leakage", a, target, abs(r), None)
            for (a, _), r in found.items()
            if r is not None and abs(r) > threshold
        ]
        rows.sort(key=lambda r: (-r[3], r[1]))
    return local_rows(df.sparkSession, rows, SCHEMA)


def missing_heavy_columns(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    rows = [
        ("missing_heavy", c, None, m * 100, None)
        for c, m in missing_shares(df).items()
        if m > threshold
    ]
    return local_rows(df.sparkSession, rows, SCHEMA)


def constant_features(df: DataFrame, target: str) -> DataFrame:
    features = [c for c in numeric_columns(df) + categorical_columns(df) if c != target]
    rows = [("constant", c, None, None, None) for c in constant_columns(df, features)]
    return local_rows(df.sparkSession, rows, SCHEMA)


def detect_data_issues(df: DataFrame, target: str) -> DataFrame:
    """Union of all detectors."""
    require_columns(df, [target])
    features = [c for c in numeric_columns(df) + categorical_columns(df) if c != target]
    parts = [
        class_imbalance(df, target),
        multicollinear_pairs(df, target),
        high_cardinality_columns(df, target),
        constant_features(df, target),
        near_constant_columns(df, features),
        leakage_suspects(df, target),
        missing_heavy_columns(df),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
