"""Cross-validated training, candidate search, prediction and ensembles on pyspark.ml."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.ml import Model, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.core import (
    REGRESSION,
    TaskSpec,
    as_double,
    col,
    cut_lineage,
    local_rows,
    numeric_columns,
    require_columns,
)
from tablewright.functions.expressions import majority_vote, mean_vote
from tablewright.operators import linear_fits
from tablewright.operators.gaps import GapDirections, learn_directions
from tablewright.operators.models import TREES, make_learner
from tablewright.operators.splits import assign_folds, row_key

MAX_CLASSES = 1_000
#: Rows of a partition of a training set; iterative learners run a job over all of them per step.
PART_ROWS = 100_000
#: Rows up to which all fits of a model run at once: there a step takes longer to start than to run.
SMALL_ROWS = 2_000_000


@dataclass
class TrainingSet:
    """Assembled, fold-assigned and materialised rows, shared by all fits on them."""

    rows: DataFrame
    features: list[str]
    task: TaskSpec
    classes: list
    n: int
    folds: int
    gaps: GapDirections | None = None

    def learner(self, model: str, params: dict[str, Any] | None, seed: int):
        if self.gaps is not None and model not in TREES:
            raise ValueError(f"'{model}' does not take missing features; trees do: {TREES}")
        return make_learner(
            model, self.task.task, params, seed, self.n, len(self.features), len(self.classes)
        )

    def fit(self, model: str, params: dict[str, Any] | None, seed: int, rows: DataFrame | None = None):
        """A fitted model of these or of some of these rows, with the sides of missing features."""
        fitted = self.learner(model, params, seed).fit(self.rows if rows is None else rows)
        return fitted if self.gaps is None else GapModel(fitted, self.gaps)

    def fit_folds(
        self, model: str, params: dict[str, Any] | None, seed: int, whole: bool
    ) -> list | None:
        """The model of each fold's other rows and, if ``whole``, of all rows; None if only ``fit`` can."""
        learner = self.learner(model, params, seed)
        if self.gaps is not None or not linear_fits.takes(
                learner, len(self.classes), len(self.features)):
            return None
        return linear_fits.fit_together(
            self, learner, [*range(self.folds), *([None] if whole else [])])


@dataclass
class GapModel:
    """A tree model together with the sides to which missing features go."""

    model: Model
    gaps: GapDirections

    def transform(self, rows: DataFrame) -> DataFrame:
        return apply_model(self.model, rows)


def target_classes(df: DataFrame, target: str) -> list:
    """Sorted class labels."""
    found = df.select(col(target)).where(col(target).isNotNull()).distinct()
    labels = [r[0] for r in found.limit(MAX_CLASSES + 1).collect()]
    if len(labels) > MAX_CLASSES:
        raise ValueError(f"'{target}' has more than {MAX_CLASSES} values; it is not a class label")
    return sorted(labels)


def encode_label(df: DataFrame, task: TaskSpec, classes: Sequence) -> DataFrame:
    """Add ``label``: the class index, or the target value for regression."""
    if not task.is_classification:
        return df.withColumn("label", as_double(task.target))
    index = None
    for i, c in enumerate(classes):
        hit = col(task.target) == F.lit(c)
        index = F.when(hit, float(i)) if index is None else index.when(hit, float(i))
    return df.withColumn("label", index)


def any_missing(features: Sequence[str]) -> Column:
    """Whether a row lacks one of the features (NULL or NaN)."""
    missing = F.lit(False)
    for f in features:
        missing = missing | as_double(f).isNull() | F.isnan(as_double(f))
    return missing


def numeric_features(df: DataFrame, features: Sequence[str]) -> None:
    require_columns(df, features)
    text = [f for f in features if f not in numeric_columns(df)]
    if text:
        raise ValueError(f"feature columns must be numeric; encode first: {text}")


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add the feature vector; no row is left out, a missing feature is an error when read."""
    numeric_features(df, features)
    return VectorAssembler(
        inputCols=list(features), outputCol="features", handleInvalid="error"
    ).transform(df)


def training_set(
    df: DataFrame,
    features: Sequence[str],
    task: TaskSpec,
    key: Sequence[str],
    folds: int = 5,
    seed: int = 42,
    missing: str = "error",
) -> TrainingSet:
    """Fold-assigned feature vectors, written once and then read by every fit.

    ``missing`` says what happens to labelled rows without a value in some feature: ``error``
    counts them and refuses, ``drop`` leaves them out before folds and weights are made, ``learn``
    keeps them for tree learners: every feature sends its gaps below or above all its values,
    whichever gave the better fold score, and models keep these sides for new rows.
    """
    require_columns(df, [*features, task.target, *key])
    if missing not in ("error", "drop", "learn"):
        raise ValueError("missing must be 'error', 'drop' or 'learn'")
    numeric_features(df, features)
    if missing == "drop":
        df = df.where(~any_missing(features))
    classes = target_classes(df, task.target) if task.is_classification else []
    labelled = encode_label(df, task, classes).where(F.col("label").isNotNull())
    seen = labelled.groupBy(F.col("label") if task.is_classification else F.lit(0).alias("label")).agg(
        F.count(F.lit(1)).alias("count"), F.count_if(any_missing(features)).alias("gaps")).collect()
    gaps = sum(r["gaps"] for r in seen)
    if missing == "error" and gaps:
        raise ValueError(
            f"{gaps} rows lack a feature; impute them first or pass missing='drop' or 'learn'")
    assigned = assign_folds(
        labelled, key, folds, seed, task.target if task.is_classification else None
    )
    directions = None
    keyed = assigned.withColumn("row_key", row_key(key))  # a feature may be part of the key
    if missing == "learn":
        directions = learn_directions(assigned, features, task.is_classification)
        keyed = directions.fill(keyed)
    rows = assemble(keyed, features)
    balance = F.lit(1.0)
    if task.is_classification:
        counts = {r["label"]: r["count"] for r in seen}
        total = sum(counts.values())
        weights = None
        for c, n in counts.items():
            w = total / (len(counts) * n)
            same = F.col("label") == F.lit(c)
            weights = F.when(same, w) if weights is None else weights.when(same, w)
        balance = weights if weights is not None else balance
    # every fit scans these rows many times: spread them evenly by key before writing them, in no
    # more parts than the cores or the rows need, as each step of a fit pays for each part
    parts = max(
        df.sparkSession.sparkContext.defaultParallelism, -(-sum(r["count"] for r in seen) // PART_ROWS))
    rows = cut_lineage(
        rows.select(
            "row_key", "features", "label", "fold", balance.alias("weight")
        ).repartition(parts, "row_key")
    )
    return TrainingSet(rows, list(features), task, classes, rows.count(), folds, directions)


def softmax(raw):
    """Class shares from raw scores, for learners without probabilities (an approximation)."""
    top = F.array_max(raw)
    powers = F.transform(raw, lambda r: F.exp(r - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, b: a + b)
    return F.transform(powers, lambda e: e / total)


def apply_model(model: Model, rows: DataFrame) -> DataFrame:
    """Add ``prediction`` and, where the learner offers it, ``probability`` as an array."""
    if isinstance(model, GapModel):
        model = model.model
    out = model.transform(rows)
    if "probability" in out.columns:
        if isinstance(out.schema["probability"].dataType, VectorUDT):
            out = out.withColumn("probability", vector_to_array("probability"))
    elif "rawPrediction" in out.columns and hasattr(model, "models"):
        out = out.withColumn("probability", softmax(vector_to_array("rawPrediction")))
    return out.drop("rawPrediction")


def score(predictions: DataFrame, task: TaskSpec) -> float:
    """Accuracy or r2 in one aggregate."""
    if task.is_classification:
        same = (F.col("label") == F.col("prediction")).cast("double")
        return predictions.agg(F.avg(same)).first()[0]
    e = F.col("label") - F.col("prediction")
    r = predictions.agg(F.avg(e * e).alias("mse"), F.var_pop("label").alias("var")).first()
    return 1.0 - r["mse"] / r["var"] if r["var"] else 0.0


@dataclass
class Run:
    """One trained configuration with its fold scores and final model."""

    run_id: str
    model_type: str
    hyperparameters: dict[str, Any]
    metric: str
    cv_scores: list[float]
    model: Any
    training_time: float = 0.0
    components: list[tuple[str, float, float]] = field(default_factory=list)
    out_of_fold: DataFrame | None = None

    @property
    def mean_score(self) -> float:
        return float(np.mean(self.cv_scores))

    @property
    def std_score(self) -> float:
        return float(np.std(self.cv_scores))


def run_table(spark, runs: Sequence[Run]) -> DataFrame:
    rows = [
        (r.run_id, r.model_type, json.dumps(r.hyperparameters, default=str, sort_keys=True),
         r.metric, r.mean_score, r.std_score, len(r.cv_scores), r.training_time)
        for r in runs
    ]
    return local_rows(
        spark,
        rows,
        "run_id string, model_type string, hyperparameters string, metric string, "
        "mean_score double, std_score double, n_folds int, training_time double",
    )


def fold_scores(spark, runs: Sequence[Run]) -> DataFrame:
    rows = [(r.run_id, i, float(s)) for r in runs for i, s in enumerate(r.cv_scores)]
    return local_rows(spark, rows, "run_id string, fold int, score double")


def _parallel(tasks: Sequence[Callable[[], Any]], parallelism: int) -> list:
    """Run independent Spark jobs from a small driver pool; the work itself is on executors."""
    if parallelism <= 1:
        return [t() for t in tasks]
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        return list(pool.map(lambda t: t(), tasks))


def cross_validate(
    data: TrainingSet, model: str, params: dict[str, Any] | None = None, seed: int = 42,
    parallelism: int = 2, keep_predictions: bool = False,
) -> tuple[list[float], DataFrame | None]:
    """Score per fold; optionally the out-of-fold predictions of all rows."""
    scores, predictions, _ = _fits(data, model, params, seed, parallelism, keep_predictions, False)
    return scores, predictions


def _fits(
    data: TrainingSet, model: str, params: dict[str, Any] | None, seed: int, parallelism: int,
    keep_predictions: bool, whole: bool,
) -> tuple[list[float], DataFrame | None, Any]:
    """The folds of ``cross_validate`` and, if ``whole``, a fit on all rows beside them."""
    if data.n <= SMALL_ROWS:
        parallelism = data.folds + 1
    together = data.fit_folds(model, params, seed, whole)

    def one(fold: int):
        held_out = data.rows.where(F.col("fold") == fold)
        fitted = together[fold] if together else data.fit(
            model, params, seed, data.rows.where(F.col("fold") != fold))
        predicted = apply_model(fitted, held_out)
        return score(predicted, data.task), predicted

    work = [lambda f=f: one(f) for f in range(data.folds)]
    if whole:
        work.append(lambda: together[-1] if together else data.fit(model, params, seed))
    results = _parallel(work, parallelism)
    fitted = results.pop() if whole else None
    predictions = None
    if keep_predictions:
        columns = [c for c in ("row_key", "fold", "label", "prediction", "probability")
                   if c in results[0][1].columns]
        predictions = results[0][1].select(*columns)
        for _, p in results[1:]:
            predictions = predictions.unionByName(p.select(*columns))
    return [s for s, _ in results], predictions, fitted


def train_model(
    data: TrainingSet, model: str, params: dict[str, Any] | None = None, seed: int = 42,
    parallelism: int = 2, run_id: str | None = None, keep_predictions: bool = False,
) -> Run:
    """k-fold scores, then a final fit on all rows."""
    start = time.time()
    scores, predictions, fitted = _fits(
        data, model, params, seed, parallelism, keep_predictions, True)
    metric = "accuracy" if data.task.is_classification else "r2"
    return Run(
        run_id or f"run_{uuid.uuid4().hex[:8]}_{model}", model, params or {}, metric, scores,
        fitted, time.time() - start, out_of_fold=predictions,
    )


def tune(
    data: TrainingSet, configs: Sequence[dict[str, Any]], parallelism: int = 2, seed: int = 42,
    stop_when: Callable[[list[Run]], bool] | None = None,
) -> list[Run]:
    """Train candidate configurations on the same folds, a few at a time, best first."""

    def one(at: int) -> Run:
        c = configs[at]
        return train_model(data, c["model_type"], c.get("hyperparameters"), seed, 1,
                           f"run_{at + 1:03d}_{c['model_type']}")

    done: list[Run] = []
    size = max(parallelism, 1) if stop_when else max(len(configs), 1)
    for start in range(0, len(configs), size):
        batch = range(start, min(start + size, len(configs)))
        done += _parallel([lambda at=at: one(at) for at in batch], parallelism)
        if stop_when and stop_when(done):
            break
    return sorted(done, key=lambda r: (-r.mean_score, r.run_id))


def gaps_of(model: Any) -> GapDirections | None:
    """The sides of missing features that a model or the members of an ensemble were trained with."""
    for member in (model, *getattr(model, "base", ()), *getattr(model, "members", ())):
        if isinstance(member, GapModel):
            return member.gaps
    return None


def predict(model: Model, df: DataFrame, features: Sequence[str], classes: Sequence = ()):
    """Score new rows; stateless, so ``df`` may also be a stream.

    Every row comes back. One that lacks a feature has no prediction (NULL), unless the model was
    trained with ``missing='learn'``: then every row is predicted.
    """
    numeric_features(df, features)
    held = df.withColumns({f"_x{i}": as_double(f) for i, f in enumerate(features)})
    names = [f"_x{i}" for i in range(len(features))]
    gaps = gaps_of(model)
    if gaps is not None:
        held = gaps.fill(held, dict(zip(features, names)))
    held = held.withColumn("_gap", any_missing(names)).withColumns(
        {n: F.coalesce(F.nanvl(F.col(n), F.lit(0.0)), F.lit(0.0)) for n in names})
    out = apply_model(model, assemble(held, names)).drop("features", *names)
    results = [c for c in ("prediction", "probability") if c in out.columns]
    out = out.withColumns({c: F.when(~F.col("_gap"), F.col(c)) for c in results}).drop("_gap")
    if classes:
        names = F.array(*[F.lit(c) for c in classes])
        out = out.withColumn("predicted_class", F.element_at(names, F.col("prediction").cast("int") + 1))
    return out


def save_model(model: Model, path: str) -> None:
    PipelineModel(stages=[model]).write().overwrite().save(path)


def load_model(path: str) -> Model:
    return PipelineModel.load(path).stages[0]


def _wide_predictions(data: TrainingSet, parts: Sequence[DataFrame]) -> DataFrame:
    """Join out-of-fold class predictions of several models by row key (unique)."""
    wide = data.rows.select("row_key", "label", "fold", "weight")
    for i, p in enumerate(parts):
        wide = wide.join(p.select("row_key", F.col("prediction").alias(f"m{i}")), "row_key")
    return wide


@dataclass
class StackedModel:
    """Base models, whose predictions are the features of the meta-learner."""

    base: list[Model]
    meta: Model

    def transform(self, rows: DataFrame) -> DataFrame:
        out = rows
        for i, m in enumerate(self.base):
            scored = apply_model(m, out).withColumnRenamed("prediction", f"m{i}")
            out = scored.drop("probability")
        stacked = out.drop("features")
        names = [f"m{i}" for i in range(len(self.base))]
        return apply_model(self.meta, assemble(stacked, names)).drop(*names)


def train_stacking(
    data: TrainingSet, configs: Sequence[dict[str, Any]], meta: str = "logistic_regression",
    meta_params: dict[str, Any] | None = None, seed: int = 42, parallelism: int = 2,
) -> Run:
    """Out-of-fold class predictions of the base models train a meta-learner on the same folds."""
    if not configs:
        raise ValueError("stacking needs at least one base model")
    start = time.time()
    parts, components, base = [], [], []
    for c in configs:
        name, params = c["model_type"], c.get("hyperparameters")
        scores, oof = cross_validate(data, name, params, seed, parallelism, True)
        parts.append(oof)
        components.append((name, float(np.mean(scores)), float(np.std(scores))))
        base.append(data.fit(name, params, seed))
    wide = cut_lineage(_wide_predictions(data, parts))
    names = [f"m{i}" for i in range(len(parts))]
    stacked = assemble(wide, names).select("row_key", "features", "label", "fold", "weight")
    level_two = TrainingSet(stacked, names, data.task, data.classes, data.n, data.folds)
    scores, _ = cross_validate(level_two, meta, meta_params, seed, parallelism)
    fitted = level_two.learner(meta, meta_params, seed).fit(stacked)
    label = "+".join(c["model_type"] for c in configs)
    return Run(
        f"ens_{uuid.uuid4().hex[:8]}_stacking", f"stacking({label})", {"meta_learner": meta},
        "accuracy" if data.task.is_classification else "r2", scores,
        StackedModel(base, fitted), time.time() - start, components,
    )


@dataclass
class SeedModel:
    """Same learner under several seeds; probabilities (or values) are averaged."""

    members: list[Model]
    classification: bool

    def transform(self, rows: DataFrame) -> DataFrame:
        out = rows
        names = []
        for i, m in enumerate(self.members):
            scored = apply_model(m, out)
            use = "probability" if "probability" in scored.columns else "prediction"
            names.append((f"s{i}", use))
            out = scored.withColumn(f"s{i}", F.col(use)).drop("prediction", "probability")
        columns = [F.col(n) for n, _ in names]
        if self.classification and names[0][1] == "probability":
            size = len(columns)
            summed = columns[0]
            for c in columns[1:]:
                summed = F.zip_with(summed, c, lambda a, b: a + b)
            probability = F.transform(summed, lambda p: p / size)
            best = F.array_position(F.col("probability"), F.array_max("probability")) - 1
            out = out.withColumn("probability", probability).withColumn(
                "prediction", best.cast("double")
            )
        elif self.classification:
            out = out.withColumn("prediction", majority_vote(columns))
        else:
            out = out.withColumn("prediction", mean_vote(columns))
        return out.drop(*[n for n, _ in names])


def train_seed_ensemble(
    df: DataFrame, features: Sequence[str], task: TaskSpec, key: Sequence[str], model: str,
    params: dict[str, Any] | None = None, n_seeds: int = 5, folds: int = 5, parallelism: int = 2,
    missing: str = "error",
) -> Run:
    """The same configuration under seeds 1..n, each with its own folds."""
    start = time.time()
    scores, members = [], []
    for seed in range(1, n_seeds + 1):
        data = training_set(df, features, task, key, folds, seed, missing)
        fold_scores_, _ = cross_validate(data, model, params, seed, parallelism)
        scores.append(float(np.mean(fold_scores_)))
        members.append(data.fit(model, params, seed))
    return Run(
        f"ens_{uuid.uuid4().hex[:8]}_seed", f"seed_ensemble({model})", params or {},
        "accuracy" if task.is_classification else "r2", scores,
        SeedModel(members, task.is_classification), time.time() - start,
    )


@dataclass
class HillClimb:
    selected: list[str]
    weights: dict[str, float]
    ensemble_score: float
    individual_scores: dict[str, float]
    steps: list[tuple[int, str, float]]


def hill_climb(
    predictions: DataFrame, models: Sequence[str], task: str, label: str = "label",
    max_size: int = 5,
) -> HillClimb:
    """Greedy ensemble over a wide table with one prediction column per model.

    Every round scores all remaining candidates in a single aggregate and adds the best one as
    long as the score strictly improves.
    """
    if not models:
        raise ValueError("at least one model is required")
    regression = task == REGRESSION
    y = col(label)

    def metric(members: Sequence[str]):
        votes = [col(m) for m in members]
        if regression:
            e = as_double(label) - mean_vote(votes)
            return 1 - F.avg(e * e) / F.var_pop(as_double(label))
        return F.avg((majority_vote(votes) == y).cast("double"))

    def score_all(groups: Sequence[Sequence[str]]) -> list[float]:
        return list(
            predictions.agg(*[metric(g).alias(f"s{i}") for i, g in enumerate(groups)]).first()
        )

    single = dict(zip(models, score_all([[m] for m in models])))
    best = max(models, key=lambda m: single[m])
    selected, top = [best], single[best]
    steps = [(1, best, top)]
    remaining = [m for m in models if m != best]
    while len(selected) < max_size and remaining:
        scores = score_all([[*selected, m] for m in remaining])
        i = max(range(len(remaining)), key=lambda j: scores[j])
        if scores[i] <= top:
            break
        top = scores[i]
        selected.append(remaining.pop(i))
        steps.append((len(selected), selected[-1], top))
    return HillClimb(selected, {m: 1 / len(selected) for m in selected}, top, single, steps)


def combine_predictions(df: DataFrame, models: Sequence[str], task: str) -> DataFrame:
    """Add ``prediction``: majority vote (first model wins ties) or mean of model columns."""
    votes = [col(m) for m in models]
    combined = mean_vote(votes) if task == REGRESSION else majority_vote(votes)
    return df.withColumn("prediction", combined)
