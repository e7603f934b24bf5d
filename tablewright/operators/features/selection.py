"""Feature selection and automatic preprocessing."""

from __future__ import annotations

from typing import Any

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.core import (
    REGRESSION,
    as_double,
    categorical_columns,
    col,
    numeric_columns,
    require_columns,
)
from tablewright.operators.association import mutual_information
from tablewright.operators.features.base import FeatureOperation, feature_operation, operation
from tablewright.operators.profile import cardinalities, missing_shares
from tablewright.operators.issues import constant_columns

LOW_CARDINALITY = 15


@feature_operation("feature_select")
def feature_select(params: dict[str, Any]) -> FeatureOperation:
    target, method = params.get("target_column", ""), params.get("method", "mutual_info")
    if method not in ("mutual_info", "variance_threshold"):
        raise ValueError(
            f"feature_select: unknown method '{method}'. "
            "Use 'mutual_info' or 'variance_threshold'."
        )

    def learn(df: DataFrame):
        numeric = numeric_columns(df, exclude=[target])
        other = [c for c in df.columns if c != target and c not in numeric]
        if method == "mutual_info":
            fractional = isinstance(
                df.schema[target].dataType, (T.FloatType, T.DoubleType, T.DecimalType)
            )
            task = REGRESSION if fractional else "multiclass_classification"
            scores = mutual_information(
                df, target, task, top_n=params.get("k", 10), features=numeric
            )
            keep = [r["feature"] for r in scores.orderBy(F.desc("mi"), "feature").collect()]
            keep = [*keep, target, *other]
        else:
            threshold = params.get("threshold", 0.0)
            r = df.agg(*[F.var_pop(as_double(c)).alias(f"v{i}") for i, c in enumerate(numeric)])
            variance = r.first() if numeric else []
            chosen = [c for c, v in zip(numeric, variance) if v is not None and v > threshold]
            keep = [*chosen, *other, target]
        return lambda d: d.select(*[col(c) for c in keep])

    return FeatureOperation("feature_select", learn, [target])


def auto_preprocess(df: DataFrame, target: str) -> tuple[DataFrame, PipelineModel, list[str]]:
    """Impute, drop constants, one-hot encode narrow and label-encode wide categoricals.

    One profiling round decides the stages. Returns the result, the fitted stages and the names of
    the applied steps.
    """
    require_columns(df, [target])
    numeric = numeric_columns(df, exclude=[target])
    categorical = categorical_columns(df, exclude=[target])
    gaps = {c for c, m in missing_shares(df).items() if m > 0}
    constant = constant_columns(df, numeric + categorical)
    configs: list[dict[str, Any]] = []
    applied = []

    fill_numeric = [c for c in numeric if c in gaps]
    if fill_numeric:
        configs.append({"type": "impute_numeric", "columns": fill_numeric, "strategy": "median"})
        applied.append("impute_numeric_median")
    fill_categorical = [c for c in categorical if c in gaps]
    if fill_categorical:
        configs.append({"type": "impute_categorical", "columns": fill_categorical})
        applied.append("impute_categorical_mode")
    if constant:
        configs.append({"type": "drop_columns", "columns": constant})
        applied.append("drop_constant_columns")
        categorical = [c for c in categorical if c not in constant]
    if categorical:
        rough = cardinalities(df, categorical, approximate=True)
        near = [c for c in categorical if rough[c] < 3 * LOW_CARDINALITY]
        exact = cardinalities(df, near) if near else {}
        narrow = [c for c in categorical if exact.get(c, rough[c]) < LOW_CARDINALITY]
        wide = [c for c in categorical if c not in narrow]
        if narrow:
            configs.append({"type": "one_hot_encode", "columns": narrow})
            applied.append("one_hot_encode")
        if wide:
            configs.append({"type": "label_encode", "columns": wide})
            applied.append("label_encode_high_cardinality")
    model = Pipeline(stages=[operation(c) for c in configs]).fit(df)
    return model.transform(df), model, applied
