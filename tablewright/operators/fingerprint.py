"""Dataset fingerprint: size, feature mix, issues, target shape, complexity and quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.core import (
    categorical_columns,
    local_rows,
    numeric_columns,
    require_columns,
    resolve_task,
)
from tablewright.operators.association import (
    compute_correlations,
    missing_pattern,
    mutual_information,
    variance_inflation,
)
from tablewright.operators.issues import HIGH_CARDINALITY
from tablewright.operators.profile import (
    cardinalities,
    class_distribution,
    missing_shares,
    numeric_moments,
)
from tablewright.operators.temporal import temporal_patterns, temporal_recommendation

SCHEMA = (
    "size_class string, task string, feature_mix string, n_rows long, n_cols int, issues string, "
    "numeric_ratio double, missing_pct_overall double, n_classes long, minority_ratio double, "
    "target_entropy double, target_skewness double, high_cardinality_ratio double"
)


def size_class(n: int) -> str:
    return "small" if n < 1_000 else "medium" if n < 100_000 else "large"


def feature_mix(numeric: int, categorical: int) -> str:
    total = numeric + categorical
    if total == 0:
        return "unknown"
    if categorical <= 0:
        return "all_numeric"
    if numeric <= 0:
        return "all_categorical"
    if numeric / total > 0.7:
        return "mostly_numeric"
    if categorical / total > 0.7:
        return "mostly_categorical"
    return "mixed"


def complexity_score() -> Column:
    """1 to 5 from size, signal, missing values, cardinality and imbalance."""

    def point(condition: Column) -> Column:
        return F.when(condition, 1).otherwise(0)

    return F.least(
        F.lit(5),
        1
        + point(F.col("n_cols") > 50)
        + point(F.col("n_rows") > 100_000)
        + point(F.col("signal_type").isin("weak", "nonlinear"))
        + point(F.col("missing_pct_overall") > 10)
        + point(F.col("high_cardinality_ratio") > 0.3)
        + point(F.col("minority_ratio") < 0.2),
    )


def quality_score() -> Column:
    """1 minus penalties for missing values, imbalance and cardinality, not below 0."""
    minority = F.when(
        F.col("minority_ratio") < 0.5, (0.5 - F.col("minority_ratio")) * 0.4
    ).otherwise(0.0)
    score = (
        1.0
        - F.least(F.col("missing_pct_overall") / 50, F.lit(0.3))
        - minority
        - F.least(F.col("high_cardinality_ratio") * 0.2, F.lit(0.1))
    )
    return F.round(F.greatest(F.lit(0.0), score), 4)


def dataset_fingerprint(
    df: DataFrame, target: str, task: str = "auto", eda: DataFrame | None = None
) -> DataFrame:
    """One row with the core fields, optional ``eda_fields`` columns and the two scores."""
    require_columns(df, [target])
    spec = resolve_task(df, target, task)
    numeric = numeric_columns(df, exclude=[target])
    categorical = categorical_columns(df, exclude=[target])
    shares = missing_shares(df)
    n_rows = df.count()
    missing = round(sum(shares.values()) / len(shares) * 100, 4)
    issues = ["missing_values"] if missing > 5 else []

    n_classes = minority = entropy = skewness = None
    if spec.is_classification:
        c = F.col("count").cast("double")
        r = (
            class_distribution(df, target)
            .agg(
                F.count(F.lit(1)).alias("k"),
                F.max("count").alias("hi"),
                F.min("count").alias("lo"),
                F.sum(c).alias("n"),
                F.sum(c * F.log(c)).alias("nlogn"),
                F.log(F.sum(c)).alias("logn"),
            )
            .first()
        )
        n_classes = r["k"]
        if n_classes >= 2:
            minority = round(r["lo"] / r["hi"], 4)
            if minority < 0.2:
                issues.append("class_imbalance")
        entropy = round(r["logn"] - r["nlogn"] / r["n"], 4) if r["n"] else None
    elif target in numeric_columns(df):
        skew = numeric_moments(df, [target])[target]["skew"]
        skewness = None if skew is None else round(skew, 4)

    wide = 0
    if categorical:
        rough = cardinalities(df, categorical, approximate=True)
        near = [c for c in categorical if HIGH_CARDINALITY * 0.7 < rough[c] <= 200]
        exact = cardinalities(df, near) if near else {}
        wide = sum(1 for c in categorical if exact.get(c, rough[c]) > HIGH_CARDINALITY)
    total = len(numeric) + len(categorical)
    row = (
        size_class(n_rows), spec.task, feature_mix(len(numeric), len(categorical)), n_rows,
        len(df.columns), ",".join(issues), round(len(numeric) / total, 4) if total else 0.0,
        missing, n_classes, minority, entropy, skewness,
        round(wide / len(categorical), 4) if categorical else 0.0,
    )
    out = local_rows(df.sparkSession, [row], SCHEMA)
    if eda is None:
        out = out.withColumn("signal_type", F.lit(None).cast("string"))
        scored = out.withColumn("complexity_score", complexity_score())
        return scored.drop("signal_type").withColumn("data_quality_score", quality_score())
    # two single-row tables
    out = out.withColumn("_k", F.lit(1)).join(eda.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return out.withColumn("complexity_score", complexity_score()).withColumn(
        "data_quality_score", quality_score()
    )


def signal_type(linear: Column, nonlinear: Column) -> Column:
    strong, curved = F.coalesce(linear, F.lit(0.0)) > 0.5, F.coalesce(nonlinear, F.lit(0.0)) > 0.1
    return (
        F.when(strong & curved, "mixed")
        .when(strong, "linear")
        .when(curved, "nonlinear")
        .otherwise("weak")
    )


def redundancy_level(n_high: Column, n_severe: Column) -> Column:
    return F.when(n_severe > 0, "severe").when(n_high > 0, "moderate").otherwise("low")


def eda_fields(
    correlations: DataFrame | None = None,
    information: DataFrame | None = None,
    inflation: DataFrame | None = None,
    pattern: str | None = None,
    temporal: DataFrame | None = None,
    spark=None,
) -> DataFrame:
    """Condense finished EDA tables (one row per column or pair) into fingerprint columns."""
    tables = [t for t in (correlations, information, inflation, temporal) if t is not None]
    spark = spark or tables[0].sparkSession
    linear = nonlinear = informative = high = severe = None
    moving = False
    if correlations is not None:
        linear = correlations.where("kind = 'target'").agg(
            F.round(F.max(F.abs("correlation")), 4)
        ).first()[0]
    if information is not None:
        r = information.agg(
            F.round(F.max("mi"), 4), F.sum(F.col("informative").cast("long"))
        ).first()
        nonlinear, informative = r[0], r[1]
    if inflation is not None:
        r = inflation.agg(
            F.sum(F.col("high").cast("long")), F.sum(F.col("severe").cast("long"))
        ).first()
        high, severe = r[0] or 0, r[1] or 0
    if temporal is not None:
        verdict = temporal_recommendation(temporal).first()
        moving = verdict["has_trend"] or verdict["has_autocorrelation"]
    base = local_rows(
        spark,
        [(linear, nonlinear, informative, high, severe, pattern or "unknown", moving)],
        "max_linear_signal double, max_nonlinear_signal double, n_informative_features long, "
        "n_redundant_pairs long, n_severe long, missing_pattern string, is_temporal boolean",
    )
    return (
        base.withColumn(
            "signal_type", signal_type(F.col("max_linear_signal"), F.col("max_nonlinear_signal"))
        )
        .withColumn(
            "redundancy_level",
            F.when(
                F.col("n_redundant_pairs").isNotNull(),
                redundancy_level(F.col("n_redundant_pairs"), F.col("n_severe")),
            ),
        )
        .drop("n_severe")
    )


def full_fingerprint(
    df: DataFrame, target: str, task: str = "auto", temporal: str | None = None
) -> DataFrame:
    """Fingerprint enriched by correlations, mutual information, VIF and missing patterns."""
    spec = resolve_task(df, target, task)
    fields = eda_fields(
        compute_correlations(df, target, include_matrix=False),
        mutual_information(df, target, spec.task),
        variance_inflation(df, target),
        missing_pattern(df),
        temporal_patterns(df, temporal) if temporal else None,
    )
    return dataset_fingerprint(df, target, spec.task, fields)


def light_fingerprint(
    df: DataFrame, target: str, task: str = "auto", variant: str = "file"
) -> DataFrame:
    """Six-field fingerprint.

    ``file`` flags missing values by their overall mean, ``profile`` by any single column above
    5 % and adds class imbalance; both count features without the target.
    """
    if variant not in ("file", "profile"):
        raise ValueError("variant must be 'file' or 'profile'")
    spec = resolve_task(df, target, task)
    shares = missing_shares(df)
    n_rows = df.count()
    issues = []
    if variant == "file":
        if sum(shares.values()) / len(shares) > 0.05:
            issues.append("missing_values")
    else:
        if any(s * 100 > 5 for s in shares.values()):
            issues.append("missing_values")
        if spec.is_classification:
            r = class_distribution(df, target).agg(F.min("count") / F.max("count")).first()[0]
            if (r or 0.0) < 0.5:
                issues.append("class_imbalance")
    numeric = numeric_columns(df, exclude=[target])
    categorical = categorical_columns(df, exclude=[target])
    row = (
        size_class(n_rows), spec.task, feature_mix(len(numeric), len(categorical)), n_rows,
        len(df.columns), ",".join(issues),
    )
    return local_rows(
        df.sparkSession,
        [row],
        "size_class string, task string, feature_mix string, n_rows long, n_cols int, "
        "issues string",
    )


def fingerprint_from_eda(fingerprint: DataFrame) -> DataFrame:
    """Reduce a rich fingerprint to the fields used for matching; absent ones become NULL."""
    wanted = {
        "size_class": "string", "task": "string", "feature_mix": "string", "n_rows": "long",
        "n_cols": "int", "issues": "string", "signal_type": "string", "complexity_score": "int",
        "missing_pattern": "string", "redundancy_level": "string",
    }
    return fingerprint.select(
        *[
            F.col(c) if c in fingerprint.columns else F.lit(None).cast(t).alias(c)
            for c, t in wanted.items()
        ]
    )
