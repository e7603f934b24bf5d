"""Model catalogue: hyperparameter spaces and the Spark learners that stand behind them."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import Estimator
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession

from tablewright.core import BINARY, MULTICLASS, REGRESSION, local_rows
from tablewright.operators.knn import NearestNeighbours

CLASSIFICATION = (BINARY, MULTICLASS)
EVERY_TASK = (BINARY, MULTICLASS, REGRESSION)
#: Families whose splits can send missing features to one side.
TREES = ("xgboost", "lightgbm", "catboost", "random_forest", "extra_trees")


@dataclass(frozen=True)
class Hyperparameter:
    name: str
    kind: str
    default: Any
    low: float | None = None
    high: float | None = None
    choices: tuple = ()
    log_scale: bool = False


@dataclass(frozen=True)
class Family:
    name: str
    learner: str
    tasks: tuple[str, ...]
    parameters: tuple[Hyperparameter, ...] = field(default=())
    probabilities: bool = True


def _int(name, default, low, high):
    return Hyperparameter(name, "int", default, low, high)


def _float(name, default, low, high, log=False):
    return Hyperparameter(name, "float", default, low, high, log_scale=log)


def _choice(name, default, *choices):
    return Hyperparameter(name, "categorical", default, choices=choices)


# fixed values: search spaces and defaults of the supported families
_BOOSTING = (
    _int("n_estimators", 300, 50, 2000),
    _int("max_depth", 6, 2, 15),
    _float("learning_rate", 0.1, 0.001, 1.0, log=True),
    _float("subsample", 0.8, 0.5, 1.0),
    _float("colsample_bytree", 0.8, 0.3, 1.0),
    _int("min_child_weight", 1, 1, 20),
    _float("gamma", 0.0, 0.0, 5.0),
)
_FOREST = (
    _int("n_estimators", 200, 50, 1000),
    _int("max_depth", 10, 2, 30),
    _int("min_samples_leaf", 1, 1, 20),
    _choice("max_features", "sqrt", "sqrt", "log2", 0.5, 0.8, None),
    _choice("class_weight", None, "balanced", None),
)
_NEIGHBOURS = (
    _int("n_neighbors", 5, 1, 50),
    _choice("weights", "uniform", "uniform", "distance"),
    _choice("metric", "minkowski", "minkowski", "euclidean", "manhattan"),
    _choice("algorithm", "exact", "exact", "projection"),
)

FAMILIES = {
    f.name: f
    for f in (
        Family("xgboost", "gradient-boosted trees", EVERY_TASK, _BOOSTING),
        Family(
            "lightgbm", "gradient-boosted trees", EVERY_TASK,
            (
                _int("n_estimators", 300, 50, 2000),
                _int("max_depth", -1, -1, 15),
                _float("learning_rate", 0.1, 0.001, 1.0, log=True),
                _float("subsample", 0.8, 0.5, 1.0),
                _float("colsample_bytree", 0.8, 0.3, 1.0),
                _int("min_child_samples", 20, 5, 100),
            ),
        ),
        Family(
            "catboost", "gradient-boosted trees", EVERY_TASK,
            (
                _int("iterations", 500, 50, 2000),
                _int("depth", 6, 2, 12),
                _float("learning_rate", 0.1, 0.001, 1.0, log=True),
                _float("subsample", 0.8, 0.5, 1.0),
                _float("colsample_bylevel", 0.8, 0.3, 1.0),
                _int("min_data_in_leaf", 1, 1, 100),
            ),
        ),
        Family(
            "random_forest", "random forest", EVERY_TASK,
            (*_FOREST, Hyperparameter("bootstrap", "bool", True)),
        ),
        Family("extra_trees", "random forest without bootstrap", EVERY_TASK, _FOREST),
        Family(
            "logistic_regression", "logistic regression", CLASSIFICATION,
            (
                _float("C", 1.0, 0.001, 100.0, log=True),
                _choice("penalty", "l2", "l1", "l2", "elasticnet", None),
                _int("max_iter", 1000, 100, 5000),
                _choice("class_weight", None, "balanced", None),
            ),
        ),
        Family(
            "svc", "linear support vector classifier", CLASSIFICATION,
            (
                _float("C", 1.0, 0.01, 100.0, log=True),
                _choice("kernel", "linear", "linear"),
                _choice("class_weight", None, "balanced", None),
            ),
            probabilities=False,
        ),
        Family(
            "knn_classifier", "nearest-neighbour join", CLASSIFICATION,
            (*_NEIGHBOURS, _int("p", 2, 1, 3)),
        ),
        Family(
            "mlp_classifier", "multilayer perceptron", CLASSIFICATION,
            (
                _choice(
                    "hidden_layer_sizes", (100,), (64,), (128,), (100, 50), (128, 64),
                    (256, 128, 64),
                ),
                _float("learning_rate_init", 0.001, 0.0001, 0.1, log=True),
                _int("max_iter", 500, 100, 2000),
            ),
        ),
        Family("linear_regression", "linear regression", (REGRESSION,), probabilities=False),
        Family(
            "elasticnet", "linear regression with elastic net", (REGRESSION,),
            (
                _float("alpha", 1.0, 0.001, 100.0, log=True),
                _float("l1_ratio", 0.5, 0.0, 1.0),
                _int("max_iter", 1000, 100, 5000),
            ),
            probabilities=False,
        ),
        Family(
            "knn_regressor", "nearest-neighbour join", (REGRESSION,), _NEIGHBOURS,
            probabilities=False,
        ),
    )
}


def family(name: str) -> Family:
    if name not in FAMILIES:
        raise ValueError(f"Unknown model '{name}'. Available: {', '.join(sorted(FAMILIES))}")
    return FAMILIES[name]


def default_parameters(name: str) -> dict[str, Any]:
    return {p.name: p.default for p in family(name).parameters}


def available_models(spark: SparkSession, task: str | None = None) -> DataFrame:
    """Catalogue rows, one per model and hyperparameter (models without any have one row)."""
    rows = []
    for f in FAMILIES.values():
        if task and task not in f.tasks:
            continue
        for p in f.parameters or (None,):
            rows.append(
                (
                    f.name, f.learner, ",".join(f.tasks), f.probabilities,
                    p.name if p else None, p.kind if p else None,
                    str(p.default) if p else None,
                    None if p is None or p.low is None else float(p.low),
                    None if p is None or p.high is None else float(p.high),
                    ",".join(map(str, p.choices)) if p else None,
                    p.log_scale if p else None,
                )
            )
    return local_rows(
        spark,
        rows,
        "model string, learner string, tasks string, probabilities boolean, parameter string, "
        "kind string, default_value string, low double, high double, choices string, "
        "log_scale boolean",
    )


def _subset(value: Any) -> str:
    if value is None:
        return "all"
    return value if isinstance(value, str) else str(float(value))


def _boosted(task: str, p: dict[str, Any], seed: int) -> Estimator:
    depth = p.get("max_depth", p.get("depth", 6))
    shared = dict(
        featuresCol="features", labelCol="label",
        maxIter=int(p.get("n_estimators", p.get("iterations", 100))),
        maxDepth=int(depth) if depth and depth > 0 else 6,
        stepSize=float(p.get("learning_rate", 0.1)),
        subsamplingRate=float(p.get("subsample", 1.0)),
        featureSubsetStrategy=_subset(p.get("colsample_bytree", p.get("colsample_bylevel", 1.0))),
        minInstancesPerNode=int(
            p.get("min_child_weight", p.get("min_child_samples", p.get("min_data_in_leaf", 1)))
        ),
        minInfoGain=float(p.get("gamma", 0.0)),
        seed=seed,
    )
    if task == REGRESSION:
        return GBTRegressor(**shared)
    base = GBTClassifier(**shared)
    return base if task == BINARY else OneVsRest(classifier=base, parallelism=2)


def _forest(task: str, p: dict[str, Any], seed: int, bootstrap: bool) -> Estimator:
    shared = dict(
        featuresCol="features", labelCol="label",
        numTrees=int(p.get("n_estimators", 200)),
        maxDepth=min(int(p.get("max_depth") or 30), 30),
        minInstancesPerNode=int(p.get("min_samples_leaf", 1)),
        featureSubsetStrategy=_subset(p.get("max_features", "sqrt")),
        bootstrap=bootstrap,
        seed=seed,
    )
    if task == REGRESSION:
        return RandomForestRegressor(**shared)
    if p.get("class_weight") == "balanced":
        shared["weightCol"] = "weight"
    return RandomForestClassifier(**shared)


def make_learner(
    name: str,
    task: str,
    parameters: dict[str, Any] | None = None,
    seed: int = 42,
    n_rows: int = 1,
    n_features: int = 1,
    n_classes: int = 2,
) -> Estimator:
    """Spark estimator over ``features`` / ``label`` (and ``weight`` when classes are balanced)."""
    spec = family(name)
    if task not in spec.tasks:
        raise ValueError(f"Model '{name}' does not support task type '{task}'")
    p = {**default_parameters(name), **(parameters or {})}
    weight = {"weightCol": "weight"} if p.get("class_weight") == "balanced" else {}
    if name in ("xgboost", "lightgbm", "catboost"):
        return _boosted(task, p, seed)
    if name in ("random_forest", "extra_trees"):
        return _forest(task, p, seed, name == "random_forest" and p.get("bootstrap", True))
    if name == "logistic_regression":
        penalty = p.get("penalty", "l2")
        mix = {"l1": 1.0, "elasticnet": float(p.get("l1_ratio", 0.5))}.get(penalty, 0.0)
        strength = 0.0 if penalty is None else 1.0 / (float(p["C"]) * max(n_rows, 1))
        return LogisticRegression(
            featuresCol="features", labelCol="label", regParam=strength, elasticNetParam=mix,
            maxIter=int(p["max_iter"]), standardization=False, **weight,
        )
    if name == "svc":
        if p.get("kernel", "linear") != "linear":
            raise ValueError("svc: only the linear kernel is available")
        base = LinearSVC(
            featuresCol="features", labelCol="label",
            regParam=1.0 / (float(p["C"]) * max(n_rows, 1)), **weight,
        )
        return base if task == BINARY else OneVsRest(classifier=base, parallelism=2)
    if name == "mlp_classifier":
        return MultilayerPerceptronClassifier(
            featuresCol="features", labelCol="label", maxIter=int(p["max_iter"]),
            layers=[n_features, *p["hidden_layer_sizes"], n_classes],
            stepSize=float(p["learning_rate_init"]), seed=seed,
        )
    if name == "linear_regression":
        return LinearRegression(featuresCol="features", labelCol="label", solver="normal")
    if name == "elasticnet":
        return LinearRegression(
            featuresCol="features", labelCol="label", regParam=float(p["alpha"]),
            elasticNetParam=float(p["l1_ratio"]), maxIter=int(p["max_iter"]),
            standardization=False,
        )
    power = {"manhattan": 1.0, "euclidean": 2.0}.get(p["metric"], float(p.get("p", 2)))
    return NearestNeighbours(
        k=int(p["n_neighbors"]), weights=p["weights"], power=power,
        n_classes=None if task == REGRESSION else n_classes, seed=seed,
        algorithm=p["algorithm"], recall=float(p.get("recall", 0.9)),
    )
