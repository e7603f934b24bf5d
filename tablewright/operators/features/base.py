"""Feature operations as pyspark.ml stages: fit on one table, apply to any other."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.sql import DataFrame

from tablewright.core import require_columns

_OPERATIONS: dict[str, Callable[[dict[str, Any]], Estimator]] = {}


class FittedOperation(Transformer):
    """Holds what was learnt (values, edges or a lookup table) as one DataFrame function."""

    def __init__(self, apply: Callable[[DataFrame], DataFrame]):
        super().__init__()
        self._apply = apply

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self._apply(dataset)


class FeatureOperation(Estimator):
    """An operation with its parameters; ``learn`` inspects the data and returns the function."""

    def __init__(
        self,
        name: str,
        learn: Callable[[DataFrame], Callable[[DataFrame], DataFrame]],
        columns: list[str],
    ):
        super().__init__()
        self.name = name
        self._learn = learn
        self._columns = columns

    def _fit(self, dataset: DataFrame) -> FittedOperation:
        require_columns(dataset, self._columns, f"Operation '{self.name}'")
        return FittedOperation(self._learn(dataset))


def feature_operation(name: str):
    """Register a factory ``params -> FeatureOperation`` under an operation name."""

    def register(factory: Callable[[dict[str, Any]], Estimator]):
        _OPERATIONS[name] = factory
        return factory

    return register


def operation(config: dict[str, Any]) -> Estimator:
    kind = config.get("type", "")
    if kind not in _OPERATIONS:
        raise ValueError(
            f"Unknown operation type '{kind}'. Supported: {', '.join(sorted(_OPERATIONS))}"
        )
    return _OPERATIONS[kind]({k: v for k, v in config.items() if k != "type"})


def operation_names() -> list[str]:
    return sorted(_OPERATIONS)


def _joint(configs: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """The operations, with successive statistics of one group as one, so rows are shuffled once.

    One that reads or replaces what an earlier one makes stays on its own.
    """
    out: list[dict[str, Any]] = []
    made: set[str] = set()
    for c in configs:
        group, value = c.get("group_column", ""), c.get("agg_column", "")
        name = c.get("new_name", f"{group}_{c.get('agg_func', 'mean')}_{value}")
        same = c.get("type") == "groupby_aggregate" and "more" not in c
        if (same and made and out[-1]["group_column"] == group
                and not made & {group, value, name} and name not in (group, value)):
            out[-1] = {**out[-1], "more": [*out[-1].get("more", []), c]}
            made.add(name)
        else:
            out.append(c)
            made = {name} if same and group else set()
    return out


def feature_pipeline(configs: list[dict[str, Any]]) -> Pipeline:
    return Pipeline(stages=[operation(c) for c in _joint(configs)])


def engineer_features(
    df: DataFrame, configs: list[dict[str, Any]]
) -> tuple[DataFrame, PipelineModel]:
    """Fit the chain on ``df`` and apply it; reuse the returned model on validation data."""
    model = feature_pipeline(configs).fit(df)
    return model.transform(df), model


def summary(before: DataFrame, after: DataFrame, configs: list[dict[str, Any]]) -> dict[str, Any]:
    """Shape and columns after a chain, and the operations applied."""
    return {
        "new_shape": [after.count(), len(after.columns)],
        "new_columns": after.columns,
        "added_columns": [c for c in after.columns if c not in before.columns],
        "operations_applied": [c["type"] for c in configs],
    }
