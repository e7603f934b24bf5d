"""Run history tables: best-so-far, comparisons, strategies and the model registry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.core import (
    col,
    cut_lineage,
    fits_broadcast,
    local_rows,
    measured_size,
    require_columns,
)
from tablewright.operators.ordering import global_row_index

# fixed values: metric names and their preference order
LOWER_IS_BETTER = ("rmse", "mse", "mae", "log_loss")
METRIC_PREFERENCE = ("accuracy", "r2", "f1_macro", "roc_auc", "rmse")

#: Runs above which a workspace is spread over several windows.
LARGE_WORKSPACE = 1_000_000


def lower_is_better(metric: Column) -> Column:
    return metric.isin(*LOWER_IS_BETTER)


def primary_metric(metrics: Sequence[str]) -> str:
    """Preferred metric among those available, else the first one by name."""
    for m in METRIC_PREFERENCE:
        if m in metrics:
            return m
    return min(metrics, default="score")


def metric_directions(df: DataFrame, metric: str = "metric") -> DataFrame:
    """Distinct metric names with direction and place in the preference order."""
    place = F.array_position(F.array(*[F.lit(m) for m in METRIC_PREFERENCE]), F.col("metric"))
    return (
        df.select(col(metric).alias("metric"))
        .distinct()
        .withColumn("lower_is_better", lower_is_better(F.col("metric")))
        .withColumn("preference", F.when(place > 0, place.cast("int")))
    )


def optimization_history(
    runs: DataFrame,
    workspace: str = "workspace",
    run_id: str = "run_id",
    score: str = "score",
    created_at: str = "created_at",
    metric: str = "score",
) -> DataFrame:
    """Runs with ``run_index`` (1-based per workspace), ``best_so_far`` and ``is_best``.

    Each workspace is a window of its own. Only those measured to have more than LARGE_WORKSPACE
    runs are range-sorted, so that their runs spread over many windows; what earlier ranges
    contribute is then one row per workspace and range.
    """
    sign = -1.0 if metric in LOWER_IS_BETTER else 1.0
    scored = runs.withColumn("_good", col(score).cast("double") * F.lit(sign))
    order = [col(created_at), col(run_id)]

    def shown(rows: DataFrame, index: Column, best: Column, previous: Column) -> DataFrame:
        improved = F.col("_good").isNotNull() & (previous.isNull() | (F.col("_good") > previous))
        return rows.select(
            *[col(c) for c in runs.columns], index.alias("run_index"),
            (best * F.lit(sign)).alias("best_so_far"), improved.alias("is_best"))

    def whole(rows: DataFrame) -> DataFrame:
        here = Window.partitionBy(col(workspace)).orderBy(*order)
        marked = rows.withColumn("_index", F.row_number().over(here).cast("long")).withColumn(
            "_best", F.max("_good").over(here.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        ).withColumn("_previous", F.max("_good").over(here.rowsBetween(Window.unboundedPreceding, -1)))
        return shown(marked, F.col("_index"), F.col("_best"), F.col("_previous"))

    large = cut_lineage(
        runs.groupBy(col(workspace).alias("_large")).agg(F.count(F.lit(1)).alias("_runs"))
        .where(F.col("_runs") > LARGE_WORKSPACE).select("_large"))
    n, size = measured_size(large)
    if not n:
        return whole(scored)
    if fits_broadcast(n, size):
        large = F.broadcast(large)
    known = col(workspace).eqNullSafe(F.col("_large"))
    return whole(scored.join(large, known, "left_anti")).unionByName(
        _ranged_history(scored.join(large, known, "left_semi"), workspace, order, shown))


def _ranged_history(rows: DataFrame, workspace: str, order: list[Column], shown) -> DataFrame:
    """The history of large workspaces, from ranges of all their runs in order."""
    indexed = global_row_index(rows, [col(workspace), *order]).table
    here = Window.partitionBy(col(workspace), F.col("part")).orderBy("row_index")
    up_to, before = (
        here.rowsBetween(Window.unboundedPreceding, Window.currentRow),
        here.rowsBetween(Window.unboundedPreceding, -1),
    )
    earlier = (
        Window.partitionBy("_w").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    ranges = (
        indexed.groupBy(col(workspace).alias("_w"), F.col("part").alias("_part"))
        .agg(F.max("_good").alias("_top"), F.count(F.lit(1)).alias("_n"))
        .select(
            "_w", "_part",
            F.max("_top").over(earlier).alias("_top_before"),
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n_before"),
        )
    )
    joined = indexed.withColumn("_index", F.row_number().over(here)).withColumn(
        "_best", F.max("_good").over(up_to)
    ).withColumn("_previous", F.max("_good").over(before))
    joined = joined.join(
        ranges, (col(workspace).eqNullSafe(F.col("_w"))) & (F.col("part") == F.col("_part"))
    )
    return shown(
        joined, F.col("_index") + F.col("_n_before"), F.greatest("_best", "_top_before"),
        F.greatest("_previous", "_top_before"))


def best_runs(
    runs: DataFrame,
    workspace: str = "workspace",
    run_id: str = "run_id",
    score: str = "score",
    created_at: str = "created_at",
    metric: str = "score",
) -> DataFrame:
    """Best run per workspace; of equal scores the earliest stays. One aggregate, no window."""
    sign = -1.0 if metric in LOWER_IS_BETTER else 1.0
    # the smallest struct is the best score, then the earliest time, then the smallest id
    key = F.struct(
        (-col(score).cast("double") * F.lit(sign)).alias("k"), col(created_at), col(run_id)
    )
    value = F.struct(col(run_id).alias("best_run_id"), col(score).alias("best_score"))
    return (
        runs.where(col(score).isNotNull())
        .groupBy(col(workspace).alias("workspace"))
        .agg(F.min_by(value, key).alias("b"))
        .select("workspace", "b.best_run_id", "b.best_score")
    )


def compare_runs(
    metrics: DataFrame, run_ids: Sequence, primary: str | None = None
) -> DataFrame:
    """Metrics of selected runs in long form with the delta to the best run.

    ``metrics`` has ``run_id, metric, value``. Unknown runs are ignored. The chosen runs and their
    metrics are a handful of rows, read with a pushed-down filter.
    """
    if not run_ids:
        raise ValueError("at least one run_id is required")
    chosen = metrics.where(F.col("run_id").isin(*run_ids)).groupBy("run_id", "metric").agg(
        F.max("value").cast("double").alias("value")
    ).collect()
    if not chosen:
        raise ValueError("no valid runs found for comparison")
    table: dict = {}
    for r in chosen:
        table.setdefault(r["run_id"], {})[r["metric"]] = r["value"]
    primary = primary or primary_metric({m for v in table.values() for m in v})
    sign = -1.0 if primary in LOWER_IS_BETTER else 1.0
    ordered = [r for r in run_ids if r in table]
    best = max(ordered, key=lambda r: sign * table[r].get(primary, -sign * float("inf")))
    rows = []
    for r in ordered:
        for m, v in sorted(table[r].items()):
            top = table[best].get(m)
            delta = None if top is None or v is None else round(v - top, 6)
            rows.append((str(r), m, v, delta, r == best, primary))
    return local_rows(
        metrics.sparkSession,
        rows,
        "run_id string, metric string, value double, delta_to_best double, is_best boolean, "
        "primary_metric string",
    )


def score_trajectory(
    runs: DataFrame,
    last: int = 5,
    workspace: str = "workspace",
    run_id: str = "run_id",
    score: str = "score",
    created_at: str = "created_at",
    model: str = "model_type",
) -> DataFrame:
    """The last runs per workspace, newest first; the rank filter limits rows before the shuffle."""
    w = Window.partitionBy(col(workspace)).orderBy(col(created_at).desc(), col(run_id).desc())
    return (
        runs.withColumn("recency", F.row_number().over(w))
        .where(F.col("recency") <= last)
        .select(
            col(workspace).alias("workspace"), col(run_id).alias("run_id"),
            col(model).alias("model_type"), col(score).alias("score"), "recency",
        )
    )


def strategy_sequences(
    runs: DataFrame,
    workspace: str = "workspace",
    run_id: str = "run_id",
    score: str = "score",
    created_at: str = "created_at",
    model: str = "model_type",
    metric: str = "score",
) -> DataFrame:
    """Per workspace: first model, best model and score, number of runs, runs until the best.

    Two partial aggregations; the model path itself stays in rows (``strategy_path``).
    """
    sign = -1.0 if metric in LOWER_IS_BETTER else 1.0
    moment = F.struct(col(created_at).alias("t"), col(run_id).alias("r"))
    good = F.struct(
        (-col(score).cast("double") * F.lit(sign)).alias("k"),
        col(created_at).alias("t"), col(run_id).alias("r"),
    )
    summary = runs.groupBy(col(workspace).alias("workspace")).agg(
        F.min_by(col(model), moment).alias("baseline_model"),
        F.min_by(col(model), F.when(col(score).isNotNull(), good)).alias("final_model"),
        F.min_by(col(score), F.when(col(score).isNotNull(), good)).alias("final_score"),
        F.min(F.when(col(score).isNotNull(), good)).alias("_at"),
        F.count(F.lit(1)).alias("total_runs"),
    )
    marks = summary.select(F.col("workspace").alias("_w"), F.col("_at"))
    reached = (
        runs.join(marks, col(workspace).eqNullSafe(F.col("_w")))
        .where(
            (col(created_at) < F.col("_at.t"))
            | ((col(created_at) == F.col("_at.t")) & (col(run_id) <= F.col("_at.r")))
        )
        .groupBy(F.col("_w"))
        .agg(F.count(F.lit(1)).alias("runs_to_best"))
    )
    return summary.join(
        reached, F.col("workspace").eqNullSafe(F.col("_w")), "left"
    ).select(
        "workspace", "baseline_model", "final_model", "final_score", "total_runs",
        F.coalesce("runs_to_best", "total_runs").alias("runs_to_best"),
    )


def strategy_path(runs: DataFrame, model: str = "model_type", **columns) -> DataFrame:
    """The optimisation path as rows ``workspace, run_index, model_type``."""
    workspace = columns.get("workspace", "workspace")
    history = optimization_history(runs, **columns)
    return history.select(
        col(workspace).alias("workspace"), "run_index", col(model).alias("model_type")
    )


def past_strategies(strategies: DataFrame, date: str = "date", limit: int = 10) -> DataFrame:
    """The newest strategies, without any filtering (a top-k report)."""
    others = [col(c) for c in strategies.columns if c != date]
    return strategies.orderBy(col(date).desc(), *others).limit(limit)


def upsert_strategies(
    library: DataFrame, updates: DataFrame, keys: Sequence[str], updated_at: str
) -> DataFrame:
    """Latest entry per archetype; algebraic, so a frequent archetype is combined map-side."""
    require_columns(library, [*keys, updated_at])
    others = [c for c in library.columns if c not in keys]
    both = library.unionByName(updates)
    order = F.struct(col(updated_at), *[col(c) for c in others if c != updated_at])
    latest = F.max_by(F.struct(*[col(c) for c in others]), order)
    return both.groupBy(*[col(k) for k in keys]).agg(latest.alias("_l")).select(
        *[col(k) for k in keys], *[F.col("_l")[c].alias(c) for c in others]
    )


def archetype(size_class: Column, task: Column, mix: Column) -> Column:
    """Readable archetype of a fingerprint."""
    return F.concat(
        F.initcap(size_class), F.lit(" "), F.translate(task, "_", " "), F.lit(", "),
        F.translate(mix, "_", " "), F.lit(" features"),
    )


def next_model_id(registry: DataFrame) -> int:
    return (registry.agg(F.max("id")).first()[0] or 0) + 1


def register_model(registry: DataFrame, entry: dict) -> DataFrame:
    """Registry with the new entry appended under the next id; the newest is the current best."""
    row = {**entry, "id": next_model_id(registry)}
    added = registry.sparkSession.range(1).select(
        *[F.lit(row.get(f.name)).cast(f.dataType).alias(f.name) for f in registry.schema.fields]
    )
    return registry.unionByName(added)


def list_models(registry: DataFrame) -> DataFrame:
    return registry.orderBy("id")


def get_model(registry: DataFrame, model_id: int) -> DataFrame:
    found = registry.where(F.col("id") == F.lit(model_id))
    if found.isEmpty():
        raise ValueError(f"Model #{model_id} not found in registry")
    return found


def current_best(registry: DataFrame) -> DataFrame:
    """The newest entry."""
    row = F.max_by(F.struct(*[col(c) for c in registry.columns]), F.col("id"))
    return registry.agg(row.alias("m")).select("m.*")
