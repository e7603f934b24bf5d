"""Segments, confusion patterns, significance and insights over pseudo-predictions."""

from pyspark.sql import functions as F

from tablewright.core import BINARY, MULTICLASS, REGRESSION, local_rows
from tablewright.operators import errors
from tablewright.plans.base import (
    BINARY_PREDICTIONS,
    CLASS_PREDICTIONS,
    REGRESSION_PREDICTIONS,
    binary_predictions,
    class_predictions,
    plan,
    r,
    regression_predictions,
    rounded,
    sql_quantile,
    table,
)


def _bin(c, source, n=4):
    inner = " + ".join(
        f"(CASE WHEN {c} > {sql_quantile(source, c, k / n)} THEN 1 ELSE 0 END)"
        for k in range(1, n)
    )
    return f"CASE WHEN {c} IS NOT NULL THEN {inner} END"


# continuous columns here have no repeated quartile, so bins keep their plain numbers
def _segments(columns, metric, source):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST(b AS INTEGER) AS bin, avg(m) AS metric, "
        f"count(*) AS count FROM (SELECT {_bin(c, source)} AS b, {metric} AS m FROM {source}) "
        f"WHERE b IS NOT NULL GROUP BY b HAVING count(*) >= 2"
        for c in columns
    )


ERROR = "CASE WHEN label = prediction THEN 0.0e0 ELSE 1.0e0 END"
KEEP = ("feature", "bin", "metric", "count")


@plan(
    "segment_error_rates", "I1 I2",
    f"""WITH {CLASS_PREDICTIONS}, s AS ({_segments(('value', 'user_id'), ERROR, 'mc')}
 UNION ALL SELECT 'label', CAST(NULL AS INTEGER), avg({ERROR}), count(*)
 FROM mc GROUP BY label HAVING count(*) >= 2)
 SELECT feature, bin, {r('metric')} AS metric, count FROM s""",
)
def segment_error_rates(spark, folder):
    df = class_predictions(spark, folder)
    out = errors.segment_metrics(df, ["value", "user_id", "label"], errors.error_flag())
    return rounded(out.select(*KEEP), "metric")


@plan(
    "segment_mean_error", "I1 I2",
    f"""WITH {REGRESSION_PREDICTIONS}, s AS (
 {_segments(('prediction', 'user_id'), 'abs(label - prediction)', 'reg')})
 SELECT feature, bin, {r('metric')} AS metric, count FROM s""",
)
def segment_mean_error(spark, folder):
    found = errors.analyze_errors(
        regression_predictions(spark, folder), REGRESSION, ["prediction", "user_id"]
    )
    return rounded(found["error_by_segment"].select(*KEEP), "metric")


@plan(
    "confusion_patterns", "I3",
    f"""WITH {CLASS_PREDICTIONS} SELECT label, prediction, count(*) AS n FROM mc
 WHERE label <> prediction GROUP BY 1, 2 ORDER BY n DESC, label, prediction LIMIT 5""",
)
def confusion_patterns(spark, folder):
    return errors.confusion_patterns(class_predictions(spark, folder))


@plan(
    "confidence_bands", "I4",
    f"""WITH {CLASS_PREDICTIONS} SELECT CASE WHEN top < 0.5 THEN 'low' WHEN top < 0.8 THEN
 'medium' ELSE 'high' END AS band, count(*) AS count, {r(f'avg({ERROR})')} AS error_rate
 FROM (SELECT *, greatest(p0, p1, p2, p3, p4) AS top FROM mc) GROUP BY 1""",
)
def confidence_bands(spark, folder):
    return rounded(errors.confidence_bands(class_predictions(spark, folder)), "error_rate")


@plan(
    "residual_statistics", "I5",
    f"""WITH {REGRESSION_PREDICTIONS}, e AS (SELECT label - prediction AS e FROM reg)
 SELECT {r('avg(e)')} AS mean, {r('stddev_pop(e)')} AS std, {r('skewness(e)')} AS skew,
 {r('avg(abs(e))')} AS mae FROM e""",
)
def residual_statistics(spark, folder):
    out = errors.residual_statistics(regression_predictions(spark, folder))
    return rounded(out, *out.columns)


@plan(
    "identify_segments", "I7",
    f"""WITH {REGRESSION_PREDICTIONS}, o AS (SELECT -avg(abs(label - prediction)) AS o FROM reg),
 s AS ({_segments(('prediction', 'user_id'), '-abs(label - prediction)', 'reg')}),
 d AS (SELECT *, (metric - o) * 100 / (abs(o) + 1e-10) AS delta FROM s, o)
 SELECT feature, bin, {r('metric')} AS metric, count, {r('delta', 3)} AS delta_pct,
 CASE WHEN delta > 0 THEN 'high' ELSE 'low' END AS performance, {r('o')} AS overall_metric
 FROM d WHERE abs(delta) > 5""",
)
def identify_segments(spark, folder):
    out = errors.identify_segments(
        regression_predictions(spark, folder), REGRESSION, ["prediction", "user_id"]
    ).select(*KEEP, "delta_pct", "performance", "overall_metric")
    return rounded(rounded(out, "metric", "overall_metric"), "delta_pct", digits=3)


@plan(
    "identify_segments_classes", "I7",
    f"""WITH {CLASS_PREDICTIONS}, o AS (SELECT avg(1 - {ERROR}) AS o FROM mc),
 s AS ({_segments(('value', 'user_id'), f'1 - {ERROR}', 'mc')})
 SELECT feature, bin, {r('metric')} AS metric, count, {r('(metric - o) * 100', 3)} AS delta_pct
 FROM s, o WHERE abs((metric - o) * 100) > 0.5""",
)
def identify_segments_classes(spark, folder):
    out = errors.identify_segments(
        class_predictions(spark, folder), MULTICLASS, ["value", "user_id"], threshold_pct=0.5
    ).select(*KEEP, "delta_pct")
    return rounded(rounded(out, "metric"), "delta_pct", digits=3)


_FOLDS = """f AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'a' ELSE 'b' END AS run_id,
 o_orderpriority AS fold, avg(o_totalprice) AS score FROM orders
 GROUP BY 1, 2), d AS (SELECT b.score - a.score AS d FROM f a JOIN f b USING (fold)
 WHERE a.run_id = 'a' AND b.run_id = 'b')"""


@plan(
    "fold_score_differences", "I8",
    f"""WITH {_FOLDS} SELECT 'paired_t_test' AS test_name, count(*) AS n,
 {r('avg(d)')} AS mean_diff, {r('stddev_samp(d)')} AS std_diff FROM d""",
)
def fold_score_differences(spark, folder):
    return rounded(
        _fold_test(spark, folder).select("test_name", "n", "mean_diff", "std_diff"),
        "mean_diff", "std_diff",
    )


@plan("fold_score_significance", "I8")
def fold_score_significance(spark, folder):
    return _fold_test(spark, folder)


def _fold_test(spark, folder):
    scores = (
        table(spark, folder, "orders")
        .groupBy(
            F.when(F.col("o_orderstatus") == "F", "a").otherwise("b").alias("run_id"),
            F.col("o_orderpriority").alias("fold"),
        )
        .agg(F.avg("o_totalprice").alias("score"))
    )
    return errors.compare_fold_scores(scores, "a", "b")


def _insights(spark, rows):
    out = local_rows(spark, rows, errors.INSIGHT_SCHEMA)
    return out.select(
        "category", "current_metric", "target_metric", "sample_count", "estimated_impact",
        "confidence",
    )


# wrong more often for large values, so that the profile has something to find
SKEWED = f"""{BINARY_PREDICTIONS}, sk AS (SELECT event_id, value, user_id, score, label,
 CASE WHEN value > 60 AND event_id % 3 <> 0 THEN 1 - label ELSE label END AS prediction,
 greatest(score, 1 - score) AS top FROM pred)"""
_WRONG = "CASE WHEN label <> prediction THEN 1.0e0 ELSE 0 END"


def _skewed(spark, folder):
    flip = (F.col("value") > 60) & (F.col("event_id") % 3 != 0)
    return binary_predictions(spark, folder).withColumn(
        "prediction", F.when(flip, 1 - F.col("label")).otherwise(F.col("label"))
    )


@plan(
    "error_profile", "I9",
    f"""WITH {SKEWED}, c AS (SELECT corr({_WRONG}, value) AS cr, avg({_WRONG}) AS rate,
 sum({_WRONG}) AS wrong FROM sk) SELECT 'error_profiling' AS category, {r('abs(cr)')}
 AS current_metric, CAST(NULL AS DOUBLE) AS target_metric, CAST(wrong AS BIGINT) AS sample_count,
 {r('abs(cr) * rate')} AS estimated_impact, CASE WHEN abs(cr) > 0.3 THEN 'high' ELSE 'medium' END
 AS confidence FROM c WHERE abs(cr) >= 0.1""",
)
def error_profile(spark, folder):
    out = _insights(spark, errors.error_profile(_skewed(spark, folder), ["value", "user_id"]))
    return rounded(out, "current_metric", "estimated_impact")


@plan(
    "residual_profile", "I10",
    f"""WITH {REGRESSION_PREDICTIONS}, e AS (SELECT abs(label - prediction) AS e, label, user_id
 FROM reg), c AS (SELECT corr(label, e) AS cr, count(*) AS n, avg(e) AS mae FROM e UNION ALL
 SELECT corr(user_id, e), count(*), avg(e) FROM e) SELECT 'error_profiling' AS category,
 {r('abs(cr)')} AS current_metric, CAST(NULL AS DOUBLE) AS target_metric, n AS sample_count,
 {r('abs(cr) * mae')} AS estimated_impact, CASE WHEN abs(cr) > 0.3 THEN 'high' ELSE 'medium' END
 AS confidence FROM c WHERE abs(cr) >= 0.1""",
)
def residual_profile(spark, folder):
    out = _insights(
        spark,
        errors.residual_profile(regression_predictions(spark, folder), ["label", "user_id"]),
    )
    return rounded(out, "current_metric", "estimated_impact")


@plan(
    "overconfidence", "I11",
    f"""WITH {SKEWED}, t AS (SELECT top, CASE WHEN top >= 0.9 AND event_id % 4 = 0 THEN 1 - label
 ELSE prediction END AS prediction, label FROM sk),
 o AS (SELECT avg({_WRONG}) AS o, count(*) AS total FROM t),
 b AS (SELECT CASE WHEN top < 0.5 THEN 0 WHEN top < 0.65 THEN 1 WHEN top < 0.8 THEN 2
 WHEN top < 0.95 THEN 3 ELSE 4 END AS band, count(*) AS n, avg({_WRONG}) AS rate FROM t GROUP BY 1)
 SELECT 'confidence' AS category, {r('rate')} AS current_metric, {r('o')} AS target_metric,
 n AS sample_count, {r('(rate - o) * n / total')} AS estimated_impact,
 CASE WHEN n > 20 THEN 'high' ELSE 'medium' END AS confidence
 FROM b, o WHERE n >= 5 AND rate > o * 1.2e0""",
)
def overconfidence(spark, folder):
    sure = (F.array_max("probability") >= 0.9) & (F.col("event_id") % 4 == 0)
    df = _skewed(spark, folder).withColumn(
        "prediction", F.when(sure, 1 - F.col("label")).otherwise(F.col("prediction"))
    )
    out = _insights(spark, errors.overconfidence(df))
    return rounded(out, "current_metric", "target_metric", "estimated_impact")


@plan(
    "threshold_sweep", "I12",
    f"""WITH {BINARY_PREDICTIONS}, t AS (SELECT round(0.10 + 0.05 * k, 2)::DOUBLE AS t
 FROM range(17) x(k)), f AS (SELECT t, 2.0e0 * sum(CASE WHEN score >= t AND label = 1 THEN 1 ELSE 0
 END) / (sum(CASE WHEN score >= t THEN 1 ELSE 0 END) + sum(label)) AS f1 FROM pred, t GROUP BY t),
 b AS (SELECT t, f1 FROM f ORDER BY f1 DESC, t LIMIT 1), h AS (SELECT f1 AS half FROM f
 WHERE t = 0.5) SELECT 'threshold' AS category, {r('half')} AS current_metric, {r('f1')}
 AS target_metric, (SELECT count(*) FROM pred) AS sample_count, {r('f1 - half')}
 AS estimated_impact, 'high' AS confidence FROM b, h WHERE abs(t - 0.5) >= 0.0499e0
 AND f1 - half >= 0.005""",
)
def threshold_sweep(spark, folder):
    out = _insights(spark, errors.threshold_sweep(binary_predictions(spark, folder), 1))
    return rounded(out, "current_metric", "target_metric", "estimated_impact")


@plan(
    "prediction_ranges", "I13",
    f"""WITH reg AS (SELECT value AS label, value * 0.6e0 AS prediction FROM events),
 o AS (SELECT avg(abs(label - prediction)) AS o,
 count(*) AS total FROM reg), s AS ({_segments(('prediction',), 'abs(label - prediction)', 'reg')})
 SELECT 'error_profiling' AS category, {r('metric')} AS current_metric, {r('o')} AS target_metric,
 count AS sample_count, {r('(metric - o) * count / total')} AS estimated_impact,
 CASE WHEN count > 20 THEN 'high' ELSE 'medium' END AS confidence
 FROM s, o WHERE count >= 5 AND metric > o * 1.3e0""",
)
def prediction_ranges(spark, folder):
    df = table(spark, folder, "events").select(
        F.col("value").alias("label"), (F.col("value") * 0.6).alias("prediction")
    )
    out = _insights(spark, errors.prediction_ranges(df))
    return rounded(out, "current_metric", "target_metric", "estimated_impact")


@plan(
    "slice_discovery_of_a_rule", "I14",
    f"""WITH e AS (SELECT event_id % 20 AS step, CASE WHEN event_id % 20 < 4 OR event_id % 20 >= 17
 THEN 1 ELSE 0 END AS wrong FROM events), o AS (SELECT avg(wrong) AS o, count(*) AS n FROM e),
 leaves AS (SELECT CASE WHEN step < 4 THEN 'step <= 3.50' ELSE 'step > 3.50 AND step > 16.50' END AS rule,
 avg(wrong) AS rate, count(*) AS c FROM e WHERE wrong = 1 GROUP BY 1)
 SELECT rule, {r('rate')} AS current_metric, {r('o')} AS target_metric, c AS sample_count,
 {r('(rate - o) * c / n')} AS estimated_impact FROM leaves, o""",
)
def slice_discovery_of_a_rule(spark, folder):
    """Errors at both ends of a feature with twenty values; the tree has to find both slices."""
    step = F.col("event_id") % 20
    df = table(spark, folder, "events").select(
        step.alias("step"), F.lit(0).alias("label"),
        F.when((step < 4) | (step >= 17), 1).otherwise(0).alias("prediction"))
    found = local_rows(spark, errors.slice_discovery(df, ["step"], BINARY), errors.INSIGHT_SCHEMA)
    rule = F.regexp_extract("description", "^rows with (.*?):", 1).alias("rule")
    return rounded(found.select(rule, "current_metric", "target_metric", "sample_count", "estimated_impact"),
                   "current_metric", "target_metric", "estimated_impact")


@plan("slice_discovery", "I14")
def slice_discovery(spark, folder):
    rows = errors.slice_discovery(_skewed(spark, folder), ["value", "user_id"], BINARY)
    return local_rows(spark, rows, errors.INSIGHT_SCHEMA)


@plan("slice_discovery_regression", "I14")
def slice_discovery_regression(spark, folder):
    rows = errors.slice_discovery(
        regression_predictions(spark, folder), ["label", "user_id"], REGRESSION
    )
    return local_rows(spark, rows, errors.INSIGHT_SCHEMA)


@plan("analyze_run_deep", "I9 I11 I12 I14 I15")
def analyze_run_deep(spark, folder):
    return errors.analyze_run_deep(_skewed(spark, folder), BINARY, ["value", "user_id"])


@plan(
    "rank_insights", "I15",
    f"""SELECT CAST(row_number() OVER (ORDER BY impact DESC, category, description) AS INTEGER)
 AS rank, category, description, {r('impact')} AS estimated_impact FROM (SELECT event_type
 AS category, CAST(user_id AS VARCHAR) AS description, avg(value) AS impact FROM events
 GROUP BY 1, 2) QUALIFY row_number() OVER (ORDER BY impact DESC, category, description) <= 15""",
)
def rank_insights(spark, folder):
    rows = (
        table(spark, folder, "events")
        .groupBy(
            F.col("event_type").alias("category"),
            F.col("user_id").cast("string").alias("description"),
        )
        .agg(F.avg("value").alias("estimated_impact"))
    )
    out = errors.rank_insights(rows).select(
        "rank", "category", "description", "estimated_impact"
    )
    return rounded(out, "estimated_impact")
