"""Feature operations, registered by name and composed into pipelines."""

from tablewright.operators.features import grouped, scalar, selection
from tablewright.operators.features.base import (
    FeatureOperation,
    engineer_features,
    feature_operation,
    feature_pipeline,
    operation,
    operation_names,
    summary,
)
from tablewright.operators.features.selection import auto_preprocess

__all__ = [
    "FeatureOperation", "auto_preprocess", "engineer_features", "feature_operation",
    "feature_pipeline", "grouped", "operation", "operation_names", "scalar", "selection",
    "summary",
]
