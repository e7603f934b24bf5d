"""Metrics and curves over pseudo-predictions."""

from pyspark.sql import functions as F

from tablewright.core import BINARY, MULTICLASS, REGRESSION, local_rows
from tablewright.operators import evaluation
from tablewright.plans.base import (
    BINARY_PREDICTIONS,
    CLASS_PREDICTIONS,
    CLASSES,
    REGRESSION_PREDICTIONS,
    binary_predictions,
    class_predictions,
    plan,
    r,
    regression_predictions,
    rounded,
)

PER_CLASS = """k AS (SELECT label, prediction, count(*) AS n FROM mc GROUP BY 1, 2),
 c AS (SELECT class, sum(s) AS support, sum(p) AS predicted, sum(h) AS hits FROM (
 SELECT label AS class, n AS s, 0 AS p, CASE WHEN label = prediction THEN n ELSE 0 END AS h FROM k
 UNION ALL SELECT prediction, 0, n, 0 FROM k) GROUP BY 1),
 m AS (SELECT class, CAST(support AS BIGINT) AS support, hits,
 CASE WHEN predicted = 0 THEN 0 ELSE hits * 1.0e0 / predicted END AS precision,
 CASE WHEN support = 0 THEN 0 ELSE hits * 1.0e0 / support END AS recall,
 2.0e0 * hits / (support + predicted) AS f1 FROM c)"""


@plan(
    "classification_metrics", "G1",
    f"""WITH {CLASS_PREDICTIONS}, {PER_CLASS} SELECT {r('sum(hits) * 1.0e0 / sum(support)')}
 AS accuracy, {r('avg(f1)')} AS f1_macro, {r('avg(precision)')} AS precision_macro,
 {r('avg(recall)')} AS recall_macro, {r('sum(f1 * support) / sum(support)')} AS f1_weighted
 FROM m""",
)
def classification_metrics(spark, folder):
    out = evaluation.classification_metrics(class_predictions(spark, folder))
    return rounded(out, *out.columns)


@plan(
    "confusion_matrix", "G2",
    f"""WITH {CLASS_PREDICTIONS}, l AS (SELECT label AS v FROM mc UNION SELECT prediction FROM mc)
 SELECT a.v AS label, b.v AS prediction, (SELECT count(*) FROM mc WHERE label = a.v AND
 prediction = b.v) AS n FROM l a, l b""",
)
def confusion_matrix(spark, folder):
    return evaluation.confusion_matrix(class_predictions(spark, folder))


@plan(
    "classification_report", "G3",
    f"""WITH {CLASS_PREDICTIONS}, {PER_CLASS}, o AS (SELECT class, precision, recall, f1, support
 FROM m UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1),
 CAST(sum(support) AS BIGINT) FROM m UNION ALL SELECT 'weighted avg',
 sum(precision * support) / sum(support), sum(recall * support) / sum(support),
 sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM m)
 SELECT class, {r('precision')} AS precision, {r('recall')} AS recall, {r('f1')} AS f1, support
 FROM o""",
)
def classification_report(spark, folder):
    out = evaluation.classification_report(class_predictions(spark, folder))
    return rounded(out, "precision", "recall", "f1")


@plan(
    "f1_per_class", "G4",
    f"WITH {CLASS_PREDICTIONS}, {PER_CLASS} SELECT class, {r('f1')} AS f1 FROM m",
)
def f1_per_class(spark, folder):
    cells = evaluation.confusion_cells(class_predictions(spark, folder))
    return rounded(evaluation.per_class_metrics(cells).select("class", "f1"), "f1")


_CLIPPED = "-avg(ln(greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, p))))"


@plan(
    "log_loss", "G5",
    f"""WITH {CLASS_PREDICTIONS}, p AS (SELECT CASE label """
    + " ".join(f"WHEN '{c}' THEN p{i}" for i, c in enumerate(CLASSES))
    + f" END AS p FROM mc) SELECT {r(_CLIPPED)} AS log_loss FROM p",
)
def log_loss(spark, folder):
    out = evaluation.log_loss(class_predictions(spark, folder), CLASSES)
    return rounded(out, "log_loss")


def _auc(score, positive, source):
    return (
        f"(SELECT (sum(CASE WHEN {positive} THEN rk ELSE 0 END) - max(p) * (max(p) + 1) / 2.0e0) "
        f"/ (max(p) * 1.0e0 * max(n)) FROM (SELECT *, rank() OVER (ORDER BY {score}) + "
        f"(count(*) OVER (PARTITION BY {score}) - 1) / 2.0e0 AS rk, "
        f"count(*) FILTER (WHERE {positive}) OVER () AS p, "
        f"count(*) FILTER (WHERE NOT ({positive})) OVER () AS n FROM {source}))"
    )


@plan(
    "roc_auc_binary", "G6 H1",
    f"WITH {BINARY_PREDICTIONS} SELECT {r(_auc('score', 'label = 1', 'pred'), 8)} AS roc_auc",
)
def roc_auc_binary(spark, folder):
    df = binary_predictions(spark, folder)
    area = evaluation.roc_auc(df, F.col("score"), F.col("label") == 1)
    return rounded(local_rows(spark, [(area,)], "roc_auc double"), "roc_auc", digits=8)


@plan(
    "roc_auc_one_vs_rest", "G6",
    f"WITH {CLASS_PREDICTIONS} SELECT "
    + r(
        "(" + " + ".join(
            _auc(f"p{i}", f"label = '{c}'", "mc") for i, c in enumerate(CLASSES)
        ) + f") / {len(CLASSES)}.0e0", 8,
    )
    + " AS roc_auc_ovr",
)
def roc_auc_one_vs_rest(spark, folder):
    area = evaluation.roc_auc_ovr(class_predictions(spark, folder), CLASSES)
    return rounded(local_rows(spark, [(area,)], "roc_auc_ovr double"), "roc_auc_ovr", digits=8)


@plan(
    "regression_metrics", "G7",
    f"""WITH {REGRESSION_PREDICTIONS}, e AS (SELECT label AS y, label - prediction AS e FROM reg)
 SELECT {r('1 - avg(e * e) / var_pop(y)')} AS r2, {r('sqrt(avg(e * e))')} AS rmse,
 {r('avg(abs(e))')} AS mae, {r('avg(CASE WHEN y <> 0 THEN abs(e / y) END) * 100')} AS mape,
 {r('1 - var_pop(e) / var_pop(y)')} AS explained_variance FROM e""",
)
def regression_metrics(spark, folder):
    out = evaluation.regression_metrics(regression_predictions(spark, folder))
    return rounded(out, *out.columns)


_STEPS = """s AS (SELECT score AS threshold, sum(label) AS pos, sum(1 - label) AS neg FROM pred
 GROUP BY 1), w AS (SELECT threshold, pos, neg, sum(pos) OVER (ORDER BY threshold DESC) AS tp,
 sum(neg) OVER (ORDER BY threshold DESC) AS fp, lead(pos) OVER (ORDER BY threshold DESC) AS np,
 lead(neg) OVER (ORDER BY threshold DESC) AS nn, (SELECT sum(pos) FROM s) AS p,
 (SELECT sum(neg) FROM s) AS n FROM s)"""


@plan(
    "roc_curve", "G10 H1",
    f"""WITH {BINARY_PREDICTIONS}, {_STEPS} SELECT threshold, {r('fp / n', 8)} AS fpr,
 {r('tp / p', 8)} AS tpr FROM w UNION ALL SELECT NULL, 0.0e0, 0.0e0""",
)
def roc_curve(spark, folder):
    df = binary_predictions(spark, folder)
    out = evaluation.roc_curve(df, F.col("score"), F.col("label") == 1)
    return rounded(out, "fpr", "tpr", digits=8)


@plan(
    "roc_curve_corners", "G10",
    f"""WITH {BINARY_PREDICTIONS}, {_STEPS}, z AS (SELECT *, lag(pos) OVER (ORDER BY threshold)
 AS later_pos, lag(neg) OVER (ORDER BY threshold) AS later_neg FROM w)
 SELECT threshold, {r('fp / n', 8)} AS fpr, {r('tp / p', 8)} AS tpr FROM z
 WHERE np IS NULL OR np <> pos OR nn <> neg UNION ALL SELECT NULL, 0.0e0, 0.0e0""",
)
def roc_curve_corners(spark, folder):
    df = binary_predictions(spark, folder)
    out = evaluation.roc_curve(df, F.col("score"), F.col("label") == 1, drop_collinear=True)
    return rounded(out, "fpr", "tpr", digits=8)


@plan(
    "pr_curve", "G11",
    f"""WITH {BINARY_PREDICTIONS}, {_STEPS} SELECT threshold, {r('tp / (tp + fp)', 8)}
 AS precision, {r('tp / p', 8)} AS recall FROM w UNION ALL SELECT NULL, 1.0e0, 0.0e0""",
)
def pr_curve(spark, folder):
    df = binary_predictions(spark, folder)
    out = evaluation.pr_curve(df, F.col("score"), F.col("label") == 1)
    return rounded(out, "precision", "recall", digits=8)


def _ap(i, c):
    return f"""(SELECT sum(pos / p * tp / (tp + fp)) FROM (SELECT pos, sum(pos) OVER w AS tp,
 sum(neg) OVER w AS fp, sum(pos) OVER () AS p FROM (SELECT p{i} AS t,
 sum(CASE WHEN label = '{c}' THEN 1 ELSE 0 END) AS pos,
 sum(CASE WHEN label = '{c}' THEN 0 ELSE 1 END) AS neg FROM mc GROUP BY 1)
 WINDOW w AS (ORDER BY t DESC)))"""


@plan(
    "average_precision", "G11",
    f"WITH {BINARY_PREDICTIONS}, {_STEPS}, {CLASS_PREDICTIONS} SELECT "
    f"{r('(SELECT sum(pos / p * tp / (tp + fp)) FROM w)', 8)} AS binary_ap, "
    + r("(" + " + ".join(_ap(i, c) for i, c in enumerate(CLASSES)) + ") / 5.0e0", 8)
    + " AS macro_ap",
)
def average_precision(spark, folder):
    binary = evaluation.average_precision(
        binary_predictions(spark, folder), F.col("score"), F.col("label") == 1
    )
    macro = evaluation.average_precision_macro(class_predictions(spark, folder), CLASSES)
    out = local_rows(spark, [(binary, macro)], "binary_ap double, macro_ap double")
    return rounded(out, "binary_ap", "macro_ap", digits=8)


@plan(
    "prediction_metrics", "F11",
    f"""WITH {CLASS_PREDICTIONS}, {PER_CLASS}, {BINARY_PREDICTIONS}, {REGRESSION_PREDICTIONS}
 SELECT 'multiclass' AS task, {r('sum(hits) * 1.0e0 / sum(support)')} AS a, {r('avg(f1)')} AS b
 FROM m UNION ALL SELECT 'binary', {r('avg(CASE WHEN label = prediction THEN 1.0e0 ELSE 0 END)')},
 {r('2.0e0 * sum(label * prediction) / (sum(label) + sum(prediction))')} FROM pred
 UNION ALL SELECT 'regression', {r('''1 - avg((label - prediction) * (label - prediction)) /
 var_pop(label)''')}, {r('avg(abs(label - prediction))')} FROM reg""",
)
def prediction_metrics(spark, folder):
    rows = []
    for name, task, df in (
        ("multiclass", MULTICLASS, class_predictions(spark, folder)),
        ("binary", BINARY, binary_predictions(spark, folder)),
        ("regression", REGRESSION, regression_predictions(spark, folder)),
    ):
        found = evaluation.prediction_metrics(df, task).first()
        rows.append((name, found[0], found[-1]))
    return rounded(local_rows(spark, rows, "task string, a double, b double"), "a", "b")


@plan(
    "prediction_summary", "F12",
    f"""WITH {BINARY_PREDICTIONS} SELECT CAST(prediction AS VARCHAR) AS prediction, count(*) AS n,
 {r('avg(greatest(score, 1 - score))')} AS mean_probability FROM pred GROUP BY 1""",
)
def prediction_summary(spark, folder):
    out = evaluation.prediction_summary(binary_predictions(spark, folder), BINARY)
    return rounded(out, "mean_probability")


@plan(
    "prediction_summary_regression", "F12",
    f"""WITH {REGRESSION_PREDICTIONS} SELECT {r('avg(prediction)')} AS mean,
 {r('median(prediction)')} AS median, {r('stddev_samp(prediction)')} AS std,
 {r('min(prediction)')} AS min, {r('max(prediction)')} AS max FROM reg""",
)
def prediction_summary_regression(spark, folder):
    out = evaluation.prediction_summary(regression_predictions(spark, folder), REGRESSION)
    return rounded(out, *out.columns)
