"""Metrics and curves over a predictions table (``label``, ``prediction``, ``probability``)."""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.core import BINARY, REGRESSION, as_double, col, local_rows, require_columns
from tablewright.functions.expressions import keyed_hash
from tablewright.operators.ordering import PrefixTable, global_row_index, value_prefix
from tablewright.operators.splits import row_key

PROBABILITY_FLOOR = float(np.finfo(np.float64).eps)


def confusion_cells(df: DataFrame, label: str = "label", prediction: str = "prediction"):
    """Occupied cells ``label, prediction, n``; every classification metric derives from them."""
    kind = df.schema[label].dataType
    return df.groupBy(
        col(label).alias("label"), col(prediction).cast(kind).alias("prediction")
    ).agg(F.count(F.lit(1)).alias("n"))


def _safe(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator != 0, numerator / denominator).otherwise(0.0)


def per_class_metrics(cells: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class over all labels seen on either side."""
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(zero)
    as_label = F.struct(
        F.col("label").alias("class"), F.col("n").alias("support"),
        zero.alias("predicted"), hit.alias("hits"),
    )
    as_prediction = F.struct(
        F.col("prediction").alias("class"), zero.alias("support"),
        F.col("n").alias("predicted"), zero.alias("hits"),
    )
    sums = (
        cells.select(F.inline(F.array(as_label, as_prediction)))
        .groupBy("class")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    )
    return sums.select(
        "class",
        _safe(F.col("hits"), F.col("predicted")).alias("precision"),
        _safe(F.col("hits"), F.col("support")).alias("recall"),
        _safe(2 * F.col("hits"), F.col("support") + F.col("predicted")).alias("f1"),
        "support",
        "hits",
    )


def classification_metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Accuracy and macro / weighted averages in one row."""
    per_class = per_class_metrics(confusion_cells(df, label, prediction))
    total = F.sum("support")
    return per_class.agg(
        (F.sum("hits") / total).alias("accuracy"),
        F.avg("f1").alias("f1_macro"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        (F.sum(F.col("f1") * F.col("support")) / total).alias("f1_weighted"),
    )


def classification_report(
    df: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Per-class rows followed by ``macro avg`` and ``weighted avg``."""
    per_class = per_class_metrics(confusion_cells(df, label, prediction)).drop("hits")
    names = ("precision", "recall", "f1")
    support = F.col("support")
    macro = per_class.agg(*[F.avg(m).alias(m) for m in names], F.sum("support").alias("support"))
    weighted = per_class.agg(
        *[(F.sum(F.col(m) * support) / F.sum(support)).alias(m) for m in names],
        F.sum("support").alias("support"),
    )
    return (
        per_class.withColumn("class", F.col("class").cast("string"))
        .unionByName(macro.withColumn("class", F.lit("macro avg")))
        .unionByName(weighted.withColumn("class", F.lit("weighted avg")))
    )


def confusion_matrix(
    df: DataFrame, label: str = "label", prediction: str = "prediction", dense: bool = True,
    most_labels: int | None = None,
) -> DataFrame:
    """All label pairs with their counts, zeros included; only occupied ones if not ``dense``.

    The dense form has the square of the number of labels as its rows, by its definition; with
    ``most_labels`` it is refused above that number. The other form takes any number.
    """
    cells = confusion_cells(df, label, prediction)
    if not dense:
        return cells
    labels = cells.select(F.explode(F.array("label", "prediction")).alias("label")).distinct()
    if most_labels is not None and labels.limit(most_labels + 1).count() > most_labels:
        raise ValueError(f"more than {most_labels} labels: pass dense=False or a larger most_labels")
    grid = labels.crossJoin(labels.withColumnRenamed("label", "prediction"))
    return grid.join(cells, ["label", "prediction"], "left").select(
        "label", "prediction", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def log_loss(
    df: DataFrame, classes: Sequence, label: str = "label", probability: str = "probability"
) -> DataFrame:
    """Mean negative log probability of the true class; ``classes`` orders the probabilities.

    A label outside ``classes`` is an error when the result is computed; rows without a label do
    not count.
    """
    index: Column | None = None
    for i, c in enumerate(classes):
        hit = col(label) == F.lit(c)
        index = F.when(hit, i + 1) if index is None else index.when(hit, i + 1)
    strange = F.raise_error(F.concat(F.lit("label not among the classes: "),
                                     col(label).cast("string"))).cast("int")
    index = F.when(col(label).isNull(), None).otherwise(F.coalesce(index, strange))
    p = F.element_at(col(probability), index)
    p = F.greatest(F.lit(PROBABILITY_FLOOR), F.least(F.lit(1 - PROBABILITY_FLOOR), p))
    return df.agg((-F.avg(F.log(p))).alias("log_loss"))


def score_table(df: DataFrame, score: Column, positive: Column, **options) -> PrefixTable:
    """Distinct scores with positives and negatives at and below each of them."""
    pos = F.when(positive, 1).otherwise(0)
    return value_prefix(df, score, {"pos": pos, "neg": 1 - pos}, **options)


def roc_auc(df: DataFrame, score: Column, positive: Column) -> float | None:
    """Exact, tie-aware area under the ROC curve from the rank sum over distinct scores."""
    t = score_table(df, score, positive)
    p, n = float(t.totals["pos"]), float(t.totals["neg"])
    if p == 0 or n == 0:
        return None
    wins = F.col("pos").cast("double") * (F.col("before_neg") + F.col("neg") / 2.0)
    return t.table.agg(F.sum(wins)).first()[0] / (p * n)


def roc_auc_ovr(
    df: DataFrame, classes: Sequence, label: str = "label", probability: str = "probability"
) -> float:
    """Macro average of the one-vs-rest areas."""
    areas = [
        roc_auc(df, F.element_at(col(probability), i + 1), col(label) == F.lit(c))
        for i, c in enumerate(classes)
    ]
    return float(np.mean(areas))


def roc_curve(
    df: DataFrame, score: Column, positive: Column, drop_collinear: bool = False
) -> DataFrame:
    """``threshold, fpr, tpr`` for every distinct score and the start point (NULL threshold).

    ``drop_collinear`` removes points on a straight line between their neighbours, by joining
    each point to the next lower score through its dense rank.
    """
    t = score_table(df, score, positive, dense=drop_collinear)
    p, n = float(t.totals["pos"]), float(t.totals["neg"])
    if p == 0 or n == 0:
        raise ValueError("a ROC curve needs both classes")
    points = t.table
    if drop_collinear:
        steps = points.select(
            (F.col("distinct_before") + 1).alias("distinct_before"),
            F.col("pos").alias("next_pos"),
            F.col("neg").alias("next_neg"),
        )
        bends = (F.col("pos") != F.col("next_pos")) | (F.col("neg") != F.col("next_neg"))
        points = points.join(steps, "distinct_before", "left").where(
            bends | F.col("next_pos").isNull()
        )
    curve = points.select(
        F.col("value").alias("threshold"),
        ((F.lit(n) - F.col("before_neg")) / n).alias("fpr"),
        ((F.lit(p) - F.col("before_pos")) / p).alias("tpr"),
    )
    start = local_rows(df.sparkSession, [(None, 0.0, 0.0)],
                       "threshold double, fpr double, tpr double")
    return curve.unionByName(start)


def pr_curve(df: DataFrame, score: Column, positive: Column) -> DataFrame:
    """``threshold, precision, recall`` per distinct score and the end point (1, 0)."""
    t = score_table(df, score, positive)
    p, n = float(t.totals["pos"]), float(t.totals["neg"])
    tp = F.lit(p) - F.col("before_pos")
    fp = F.lit(n) - F.col("before_neg")
    curve = t.table.select(
        F.col("value").alias("threshold"),
        (tp / (tp + fp)).alias("precision"),
        (tp / F.lit(p)).alias("recall"),
    )
    end = local_rows(df.sparkSession, [(None, 1.0, 0.0)],
                     "threshold double, precision double, recall double")
    return curve.unionByName(end)


def average_precision(df: DataFrame, score: Column, positive: Column) -> float | None:
    t = score_table(df, score, positive)
    p, n = float(t.totals["pos"]), float(t.totals["neg"])
    if p == 0:
        return None
    tp = F.lit(p) - F.col("before_pos")
    fp = F.lit(n) - F.col("before_neg")
    return t.table.agg(F.sum(F.col("pos") / p * tp / (tp + fp))).first()[0]


def average_precision_macro(
    df: DataFrame, classes: Sequence, label: str = "label", probability: str = "probability"
) -> float:
    return float(np.mean([
        average_precision(df, F.element_at(col(probability), i + 1), col(label) == F.lit(c))
        for i, c in enumerate(classes)
    ]))


def regression_metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """r2, rmse, mae, mape (percent, over non-zero labels) and explained variance; one aggregate."""
    y, e = as_double(label), as_double(label) - as_double(prediction)
    sums = df.agg(
        F.count(e).alias("n"),
        F.avg(e * e).alias("mse"),
        F.avg(F.abs(e)).alias("mae"),
        F.var_pop(y).alias("var_y"),
        F.var_pop(e).alias("var_e"),
        F.avg(F.when(y != 0, F.abs(e / y))).alias("ape"),
    )

    def explained(loss: str) -> Column:
        return (
            F.when(F.col("var_y") != 0, 1 - F.col(loss) / F.col("var_y"))
            .when(F.col(loss) == 0, 1.0)
            .otherwise(0.0)
        )

    return sums.select(
        explained("mse").alias("r2"),
        F.sqrt("mse").alias("rmse"),
        "mae",
        F.coalesce(F.col("ape") * 100, F.lit(float("inf"))).alias("mape"),
        explained("var_e").alias("explained_variance"),
    )


def prediction_metrics(df: DataFrame, task: str) -> DataFrame:
    """Compact scores of a prediction run: accuracy and F1, or r2, rmse and mae."""
    if task == REGRESSION:
        return regression_metrics(df).select("r2", "rmse", "mae")
    if task == BINARY:
        per_class = per_class_metrics(confusion_cells(df))
        # binary F1 is that of the larger label
        return per_class.agg(
            (F.sum("hits") / F.sum("support")).alias("accuracy"),
            F.max(F.struct("class", "f1"))["f1"].alias("f1"),
        )
    return classification_metrics(df).select("accuracy", F.col("f1_macro").alias("f1"))


def prediction_summary(df: DataFrame, task: str) -> DataFrame:
    """Distribution of predictions: class counts with mean confidence, or moments."""
    if task != REGRESSION:
        confidence = (
            F.avg(F.array_max("probability")) if "probability" in df.columns else F.lit(None)
        )
        return df.groupBy(F.col("prediction").cast("string").alias("prediction")).agg(
            F.count(F.lit(1)).alias("n"), confidence.cast("double").alias("mean_probability")
        )
    from tablewright.operators.order_stats import medians

    middle = medians(df, ["prediction"])["prediction"]
    p = as_double("prediction")
    return df.agg(
        F.avg(p).alias("mean"),
        F.lit(middle).cast("double").alias("median"),
        F.stddev_samp(p).alias("std"),
        F.min(p).alias("min"),
        F.max(p).alias("max"),
    )


def evaluate(df: DataFrame, task: str, classes: Sequence | None = None) -> dict[str, DataFrame]:
    """All metric tables of a predictions table."""
    require_columns(df, ["label", "prediction"])
    if task == REGRESSION:
        return {"metrics": regression_metrics(df)}
    out = {
        "metrics": classification_metrics(df),
        "report": classification_report(df),
        "confusion_matrix": confusion_matrix(df),
    }
    if "probability" in df.columns and classes:
        area = (
            roc_auc(df, F.element_at("probability", 2), F.col("label") == F.lit(classes[1]))
            if task == BINARY
            else roc_auc_ovr(df, classes)
        )
        out["probability_metrics"] = log_loss(df, classes).withColumn(
            "roc_auc" if task == BINARY else "roc_auc_ovr", F.lit(area).cast("double")
        )
    return out


def builtin_importances(model, features: Sequence[str]) -> list[tuple[str, float]]:
    """Impurity importances or absolute coefficients (mean over classes) of a fitted model."""
    if hasattr(model, "featureImportances"):
        raw = model.featureImportances.toArray()
    elif hasattr(model, "coefficientMatrix"):
        raw = np.abs(model.coefficientMatrix.toArray()).mean(axis=0)
    elif hasattr(model, "coefficients"):
        raw = np.abs(model.coefficients.toArray())
    elif hasattr(model, "models"):
        parts = [dict(builtin_importances(m, features)) for m in model.models]
        raw = np.array([np.mean([p[f] for p in parts]) for f in features])
    else:
        raise ValueError("the model has neither importances nor coefficients; use permutation")
    return [(f, float(v)) for f, v in zip(features, raw)]


def bijections(n: int, repeats: int, seed: int) -> list[tuple[int, int]]:
    """(a, b) of the maps i -> (a i + b) mod n, one for each repeat; a and n have no common factor.

    ``a`` is the first such number from a start that depends on seed and repeat. Products stay
    below 2^63 for tables of up to 10^12 rows.
    """
    found = []
    for r in range(repeats):
        a = 65_537 + 7_919 * (r + 1) + seed
        while math.gcd(a, n) != 1:
            a += 1
        found.append((a, (seed + 1) * (r + 1) % max(n, 1)))
    return found


def permutation_importance(
    df: DataFrame,
    predict: Callable[[DataFrame], DataFrame],
    features: Sequence[str],
    key: Sequence[str],
    task: str,
    label: str = "label",
    repeats: int = 10,
    seed: int = 42,
) -> DataFrame:
    """Mean drop of the score when one feature is shuffled.

    ``predict`` adds a ``prediction`` column from a vector column ``features``. Rows are put into
    the order of a hash of their (unique) keys once. Each repeat pairs place i with place
    (a i + b) mod n, a keyed bijection; one join on the place brings the partners of all repeats,
    each feature takes its value from the partner, and all features are scored in one job.
    """
    base = df.select(
        keyed_hash(row_key(key), seed).alias("_h"),
        row_key(key).alias("_key"),
        col(label).alias("label"),
        F.array(*[as_double(f) for f in features]).alias("_x"),
    )
    order = [F.col("_h"), F.col("_key")]
    indexed = global_row_index(base, order)
    rows = indexed.table.select("row_index", "label", "_x")

    def score(scored: DataFrame, groups: list[str]) -> DataFrame:
        if task == REGRESSION:
            e = F.col("label") - F.col("prediction")
            return scored.groupBy(*groups).agg(
                (1 - F.avg(e * e) / F.var_pop("label")).alias("score")
            )
        same = F.col("label") == F.col("prediction")
        if task == BINARY:
            return scored.groupBy(*groups).agg(F.avg(same.cast("double")).alias("score"))
        cells = scored.groupBy(*groups, "label", "prediction").agg(F.count(F.lit(1)).alias("n"))
        zero = F.lit(0).cast("long")
        sums = (
            cells.select(
                *groups,
                F.inline(
                    F.array(
                        F.struct(F.col("label").alias("c"), F.col("n").alias("s"),
                                 zero.alias("p"),
                                 F.when(same, F.col("n")).otherwise(zero).alias("h")),
                        F.struct(F.col("prediction").cast("double").alias("c"), zero.alias("s"),
                                 F.col("n").alias("p"), zero.alias("h")),
                    )
                ),
            )
            .groupBy(*groups, "c")
            .agg(F.sum("s").alias("s"), F.sum("p").alias("p"), F.sum("h").alias("h"))
        )
        f1 = _safe(2 * F.col("h"), F.col("s") + F.col("p"))
        return sums.groupBy(*groups).agg((F.sum(f1 * F.col("s")) / F.sum("s")).alias("score"))

    plain = predict(rows.withColumn("features", array_to_vector("_x")))
    baseline = score(plain.withColumn("_all", F.lit(1)), ["_all"]).first()["score"]
    drops = {f: 0.0 for f in features}
    partners = F.array(*[
        F.struct(F.lit(r).alias("repeat"),
                 F.pmod(F.col("row_index") * F.lit(a) + F.lit(b), F.lit(indexed.n)).alias("partner"))
        for r, (a, b) in enumerate(bijections(indexed.n, repeats, seed))])
    others = rows.select(F.col("row_index").alias("partner"), F.col("_x").alias("_other"))
    paired = rows.select("label", "_x", F.inline(partners)).join(others, "partner")
    swapped = [
        F.struct(
            F.lit(j).alias("feature"),
            F.array(
                *[(F.col("_other") if i == j else F.col("_x"))[i]
                  for i in range(len(features))]
            ).alias("x"),
        )
        for j in range(len(features))
    ]
    exploded = paired.select("repeat", "label", F.inline(F.array(*swapped)))
    scored = predict(exploded.withColumn("features", array_to_vector("x")))
    for row in score(scored, ["repeat", "feature"]).collect():
        drops[features[row["feature"]]] += baseline - row["score"]
    return local_rows(
        df.sparkSession,
        [(f, d / repeats) for f, d in drops.items()],
        "feature string, importance double",
    )


def threshold_counts(df: DataFrame, score: Column, positive: Column, thresholds: Sequence[float]):
    """tp, fp, fn per threshold in one aggregate."""
    exprs = []
    for i, t in enumerate(thresholds):
        chosen = score >= F.lit(t)
        exprs += [
            F.count(F.when(chosen & positive, 1)).alias(f"tp{i}"),
            F.count(F.when(chosen & ~positive, 1)).alias(f"fp{i}"),
            F.count(F.when(~chosen & positive, 1)).alias(f"fn{i}"),
        ]
    r = df.agg(*exprs).first()
    return [(t, r[f"tp{i}"], r[f"fp{i}"], r[f"fn{i}"]) for i, t in enumerate(thresholds)]


def add_all(columns: Sequence[Column]) -> Column:
    return functools.reduce(operator.add, columns)
