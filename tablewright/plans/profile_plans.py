"""Sources, profiles and data issues."""

from pyspark.sql import functions as F

from tablewright.core import local_rows, resolve_task
from tablewright.operators import issues, profile, sketches
from tablewright.operators.order_stats import exact_quantiles
from tablewright.operators.profile import cardinalities
from tablewright.plans.base import (
    LI,
    LI_NUMERIC,
    lineitem_nulls,
    plan,
    r,
    rounded,
    scratch,
    sql_quantile,
    table,
)
from tablewright.sources.tables import load_table as read_table
from tablewright.sources.tables import preview, write_table

CATEGORICAL = ("l_returnflag", "l_linestatus")
EVERY = (*LI_NUMERIC, *CATEGORICAL, "l_shipdate")


def _union(parts):
    return " UNION ALL ".join(parts)


def _outliers(c: str) -> str:
    return (
        f"(SELECT count(*) FROM li, (SELECT {sql_quantile('li', c, 0.25)} AS q1, "
        f"{sql_quantile('li', c, 0.75)} AS q3) WHERE {c} < q1 - 1.5e0 * (q3 - q1) "
        f"OR {c} > q3 + 1.5e0 * (q3 - q1))"
    )


@plan(
    "load_table", "A1",
    "SELECT * FROM orders",
)
def load_table(spark, folder):
    """Orders written as CSV and read back with a schema; every row as the CSV gives it."""
    orders = read_table(spark, f"{folder}/orders.parquet")
    path = f"{scratch(spark)}/orders.csv"
    write_table(orders, path, "csv")
    schema = ", ".join(f"{n} {t}" for n, t in orders.dtypes)
    return read_table(spark, path, schema=schema, encoding="UTF-8", multi_line=False)


@plan(
    "load_csv_detected", "A1",
    """SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority || chr(10) || '"é"; '
 || CASE WHEN o_orderkey % 3 = 0 THEN chr(10) || chr(10) ELSE 'x' END AS note FROM orders""",
)
def load_csv_detected(spark, folder):
    """Orders as semicolon-separated Latin-1 text with line breaks and quotes inside fields, of
    which separator, encoding, layout and types are detected."""
    orders = read_table(spark, f"{folder}/orders.parquet")
    tail = F.when(F.col("o_orderkey") % 3 == 0, "\n\n").otherwise("x")
    noted = orders.select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate",
        F.concat("o_orderpriority", F.lit('\n"é"; '), tail).alias("note"))
    path = f"{scratch(spark)}/orders.csv"
    noted.write.options(header=True, sep=";", encoding="ISO-8859-1", escape="\"",
                        ignoreTrailingWhiteSpace=False).csv(path)
    found = read_table(spark, path)
    return found.select(*[F.col(n).cast(t).alias(n) for n, t in noted.dtypes])


@plan("preview", "A2", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
def preview_orders(spark, folder):
    return preview(table(spark, folder, "orders"), 5, [F.col("o_orderkey")])


@plan(
    "profile_numeric", "B1 B3 B5 B6 B7",
    f"WITH {LI} " + _union(
        f"SELECT '{c}' AS \"column\", {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std, "
        f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, "
        f"{r(sql_quantile('li', c, 0.5))} AS median, "
        f"{r(f'avg(CASE WHEN {c} IS NULL THEN 1.0e0 ELSE 0 END) * 100')} AS missing_pct, "
        f"count(DISTINCT {c}) AS n_unique, {_outliers(c)} AS outlier_count FROM li"
        for c in LI_NUMERIC
    ),
)
def profile_numeric(spark, folder):
    out = profile.profile_numeric(lineitem_nulls(spark, folder), LI_NUMERIC)
    return rounded(out, "mean", "std", "median", "missing_pct")


def _top(columns, k, source):
    return _union(
        f"SELECT * FROM (SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, "
        f"count(*) AS count, CAST(row_number() OVER (ORDER BY count(*) DESC, "
        f"CAST({c} AS VARCHAR)) AS INTEGER) AS rank FROM {source} WHERE {c} IS NOT NULL "
        f"GROUP BY {c}) WHERE rank <= {k}"
        for c in columns
    )


@plan("profile_categorical", "B4", _top(("p_brand", "p_type", "p_name"), 10, "part"))
def profile_categorical(spark, folder):
    return profile.profile_categorical(
        table(spark, folder, "part"), ["p_brand", "p_type", "p_name"]
    )


@plan(
    "missing_percentages", "B5",
    f"WITH {LI} " + _union(
        f"SELECT '{c}' AS \"column\", "
        f"{r(f'avg(CASE WHEN {c} IS NULL THEN 1.0e0 ELSE 0 END) * 100')} AS missing_pct FROM li"
        for c in EVERY
    ),
)
def missing_percentages(spark, folder):
    return rounded(profile.missing_percentages(lineitem_nulls(spark, folder)), "missing_pct")


_KEPT = ("l_quantity", "l_extendedprice", "l_discount", "l_partkey")


@plan(
    "profile_from_sketches", "B6 B11",
    f"WITH {LI} " + _union(
        f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count({c}) AS n, {r(f'avg({c})')} AS mean, "
        f"{r(f'stddev_samp({c})')} AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, "
        f"{r(f'avg(CASE WHEN {c} IS NULL THEN 1.0e0 ELSE 0 END) * 100')} AS missing_pct, "
        "true AS n_unique_close, true AS median_close FROM li"
        for c in _KEPT
    ),
)
def profile_from_sketches(spark, folder):
    """Three stored batches and new rows; the estimates are checked against exact figures."""
    li = lineitem_nulls(spark, folder).select("l_linenumber", *_KEPT)
    part = F.pmod("l_linenumber", F.lit(4))
    path = f"{scratch(spark)}/sketches"
    for k in range(3):
        sketches.store_sketches(li.where(part == k).select(*_KEPT), path, str(k))
    found = sketches.profile_with_stored(
        li.where(part == 3).select(*_KEPT), sketches.load_sketches(spark, path), probabilities=(0.5,))
    unique = cardinalities(li, _KEPT)
    near = exact_quantiles(li, _KEPT, [0.5 - sketches.RANK_ERROR, 0.5 + sketches.RANK_ERROR])
    bounds = local_rows(spark, [
        (c, unique[c], near[c].quantile(0.5 - sketches.RANK_ERROR), near[c].quantile(0.5 + sketches.RANK_ERROR))
        for c in _KEPT], "column string, exact long, low double, high double")
    median = F.element_at("quantiles", 1)
    judged = found.join(F.broadcast(bounds), "column").select(
        "column", "n_rows", "n", "mean", "std", "min", "max", "missing_pct",
        (F.abs(F.col("n_unique") - F.col("exact")) <= F.col("exact") * sketches.DISTINCT_ERROR)
        .alias("n_unique_close"),
        ((median >= F.col("low")) & (median <= F.col("high"))).alias("median_close"))
    return rounded(judged, "mean", "std", "missing_pct")


@plan(
    "column_cardinality", "B6",
    f"WITH {LI} " + _union(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_unique FROM li" for c in EVERY
    ),
)
def column_cardinality(spark, folder):
    return profile.column_cardinality(lineitem_nulls(spark, folder))


@plan(
    "task_type", "B2",
    "SELECT 'l_returnflag' AS target, 'multiclass_classification' AS task UNION ALL "
    "SELECT 'l_linestatus', CASE WHEN (SELECT count(DISTINCT l_linestatus) FROM lineitem) = 2 "
    "THEN 'binary_classification' ELSE 'multiclass_classification' END UNION ALL "
    "SELECT 'l_extendedprice', CASE WHEN (SELECT count(DISTINCT l_extendedprice) FROM lineitem) "
    "> 20 THEN 'regression' ELSE 'multiclass_classification' END",
)
def task_type(spark, folder):
    df = lineitem_nulls(spark, folder)
    rows = [
        (c, resolve_task(df, c).task) for c in ("l_returnflag", "l_linestatus", "l_extendedprice")
    ]
    return local_rows(spark, rows, "target string, task string")


def _balance(target, source):
    return (
        f"SELECT count(*) AS num_classes, max(n) AS majority_count, min(n) AS minority_count, "
        f"(SELECT c FROM k ORDER BY n DESC, c LIMIT 1) AS majority_class, "
        f"(SELECT c FROM k ORDER BY n, c DESC LIMIT 1) AS minority_class, "
        f"{r('min(n) / max(n)')} AS minority_ratio, CASE WHEN min(n) / max(n) >= 0.8 THEN 'none' "
        f"WHEN min(n) / max(n) >= 0.5 THEN 'mild' WHEN min(n) / max(n) >= 0.2 THEN 'moderate' "
        f"ELSE 'severe' END AS severity FROM k"
    )


@plan(
    "class_balance", "B8",
    "WITH k AS (SELECT CAST(quality * 10 + toxic AS VARCHAR) AS c, count(*) AS n FROM labels "
    "GROUP BY 1) " + _balance("c", "k"),
)
def class_balance(spark, folder):
    labels = table(spark, folder, "labels").withColumn(
        "c", F.col("quality") * 10 + F.col("toxic")
    )
    return rounded(profile.class_balance(labels, "c"), "minority_ratio")


@plan(
    "class_distribution", "B8",
    "SELECT CAST(o_orderpriority AS VARCHAR) AS class, count(*) AS count FROM orders GROUP BY 1",
)
def class_distribution(spark, folder):
    return profile.class_distribution(table(spark, folder, "orders"), "o_orderpriority")


@plan(
    "recommend_preprocessing", "B9",
    f"""WITH {LI}, m AS (SELECT avg(CASE WHEN l_discount IS NULL THEN 100.0e0 ELSE 0 END) AS d,
 avg(CASE WHEN l_tax IS NULL THEN 100.0e0 ELSE 0 END) AS t FROM li),
 rules AS (
 SELECT 1 AS k, 'drop_mostly_missing' AS rule, concat_ws(', ', CASE WHEN d > 50 THEN 'l_discount'
 END, CASE WHEN t > 50 THEN 'l_tax' END) AS columns FROM m WHERE d > 50 OR t > 50
 UNION ALL SELECT 2, 'impute', concat_ws(', ', CASE WHEN d > 5 AND d <= 50 THEN 'l_discount' END,
 CASE WHEN t > 5 AND t <= 50 THEN 'l_tax' END) FROM m
 WHERE (d > 5 AND d <= 50) OR (t > 5 AND t <= 50)
 UNION ALL SELECT 4, 'scale_numeric', ''
 UNION ALL SELECT 5, 'target_encode', 'l_shipdate' FROM (SELECT count(DISTINCT l_shipdate) AS n
 FROM li) WHERE n > 50
 UNION ALL SELECT 6, 'one_hot_encode', 'l_returnflag, l_linestatus'
 FROM (SELECT count(DISTINCT l_returnflag) AS a, count(DISTINCT l_linestatus) AS b FROM li)
 WHERE a BETWEEN 2 AND 10 AND b BETWEEN 2 AND 10)
 SELECT CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS position, rule, columns FROM rules""",
)
def recommend_preprocessing(spark, folder):
    return profile.recommend_preprocessing(lineitem_nulls(spark, folder), "l_returnflag")


_TYPES = (
    ("o_orderkey", "bigint", "numeric"), ("o_custkey", "bigint", "numeric"),
    ("o_orderstatus", "string", "categorical"), ("o_totalprice", "double", "numeric"),
    ("o_orderdate", "timestamp_ntz", "categorical"), ("o_orderpriority", "string", "categorical"),
)


@plan(
    "table_overview", "B10",
    _union(
        f"SELECT {i} AS position, '{c}' AS \"column\", '{t}' AS dtype, '{k}' AS feature_type, "
        f"count(*) AS n_rows, 6 AS n_cols FROM orders"
        for i, (c, t, k) in enumerate(_TYPES)
    ),
)
def table_overview(spark, folder):
    return profile.table_overview(table(spark, folder, "orders"))


@plan(
    "column_stats", "B11",
    f"WITH {LI} SELECT 'l_tax' AS \"column\", 'double' AS dtype, "
    "count(DISTINCT l_tax) AS unique_count, count(*) - count(l_tax) AS missing_count, "
    f"{r('(count(*) - count(l_tax)) * 100.0e0 / count(*)')} AS missing_pct, "
    f"count(*) AS total_count, {r('avg(l_tax)')} AS mean, {r('stddev_samp(l_tax)')} AS std, "
    f"min(l_tax) AS min, max(l_tax) AS max, {r(sql_quantile('li', 'l_tax', 0.25))} AS p25, "
    f"{r(sql_quantile('li', 'l_tax', 0.5))} AS p50, "
    f"{r(sql_quantile('li', 'l_tax', 0.75))} AS p75, {r('skewness(l_tax)')} AS skew, "
    f"{r('kurtosis(l_tax)')} AS kurtosis FROM li",
)
def column_stats(spark, folder):
    out = profile.column_stats(lineitem_nulls(spark, folder), "l_tax")
    return rounded(out, "missing_pct", "mean", "std", "p25", "p50", "p75", "skew", "kurtosis")


@plan("column_value_stats", "B12", _top(("p_type",), 20, "part"))
def column_value_stats(spark, folder):
    return profile.column_value_stats(table(spark, folder, "part"), "p_type")


# lineitem with one column for every detector to find
ISSUES = f"""{LI}, iss AS (SELECT l_quantity, l_extendedprice, l_extendedprice * 2 + l_quantity
 AS price_copy, l_discount, 1 AS fixed, CASE WHEN l_orderkey % 50 = 0 THEN 'b' ELSE 'a' END
 AS rare, CASE WHEN l_partkey % 3 = 0 THEN l_quantity END AS gappy, l_returnflag,
 CAST(l_suppkey AS VARCHAR) AS supplier FROM li)"""
ISSUE_FEATURES = (
    "l_quantity", "price_copy", "l_discount", "fixed", "rare", "gappy", "l_returnflag", "supplier"
)
ROW = "issue, \"column\", other, value, detail"
EMPTY = "CAST(NULL AS VARCHAR)"


def issue_table(spark, folder):
    li = lineitem_nulls(spark, folder)
    return li.select(
        "l_quantity", "l_extendedprice",
        (F.col("l_extendedprice") * 2 + F.col("l_quantity")).alias("price_copy"), "l_discount",
        F.lit(1).alias("fixed"),
        F.when(F.col("l_orderkey") % 50 == 0, "b").otherwise("a").alias("rare"),
        F.when(F.col("l_partkey") % 3 == 0, F.col("l_quantity")).alias("gappy"),
        "l_returnflag", F.col("l_suppkey").cast("string").alias("supplier"),
    )


_NUMERIC = ("l_quantity", "price_copy", "l_discount", "fixed", "gappy")
_IMBALANCE = f"""SELECT 'class_imbalance' AS issue, 'l_extendedprice' AS "column", {EMPTY} AS other,
 1.0e0 AS value, 'none' AS detail"""
_PAIRS = _union(
    f"SELECT 'multicollinearity' AS issue, '{a}' AS \"column\", '{b}' AS other, "
    f"abs(c) AS value, {EMPTY} AS detail FROM (SELECT corr({a}, {b}) AS c FROM iss) "
    f"WHERE isfinite(c) AND abs(c) > 0.9"
    for i, a in enumerate(_NUMERIC) for b in _NUMERIC[i + 1:]
    if "fixed" not in (a, b)
)
_HIGH = _union(
    f"SELECT 'high_cardinality' AS issue, '{c}' AS \"column\", {EMPTY} AS other, "
    f"CAST(n AS DOUBLE) AS value, {EMPTY} AS detail FROM (SELECT count(DISTINCT {c}) AS n "
    f"FROM iss) WHERE n > 50"
    for c in ("rare", "l_returnflag", "supplier")
)
_CONSTANT = _union(
    f"SELECT 'constant' AS issue, '{c}' AS \"column\", {EMPTY} AS other, "
    f"CAST(NULL AS DOUBLE) AS value, {EMPTY} AS detail FROM (SELECT count(DISTINCT {c}) AS n "
    f"FROM iss) WHERE n <= 1"
    for c in ISSUE_FEATURES
)
_NEAR = _union(
    f"SELECT 'near_constant' AS issue, '{c}' AS \"column\", {EMPTY} AS other, "
    f"n * 100.0e0 / total AS value, v AS detail FROM (SELECT CAST({c} AS VARCHAR) AS v, "
    f"count(*) AS n, sum(count(*)) OVER () AS total FROM iss WHERE {c} IS NOT NULL GROUP BY {c}) "
    f"WHERE n * 1.0e0 / total > 0.95"
    for c in ISSUE_FEATURES
)
_LEAK = _union(
    f"SELECT 'leakage' AS issue, '{c}' AS \"column\", 'l_extendedprice' AS other, "
    f"abs(c) AS value, {EMPTY} AS detail FROM (SELECT corr({c}, l_extendedprice) AS c FROM iss) "
    f"WHERE isfinite(c) AND abs(c) > 0.95"
    for c in _NUMERIC if c != "fixed"
)
_HEAVY = _union(
    f"SELECT 'missing_heavy' AS issue, '{c}' AS \"column\", {EMPTY} AS other, m * 100 AS value, "
    f"{EMPTY} AS detail FROM (SELECT avg(CASE WHEN {c} IS NULL THEN 1.0e0 ELSE 0 END) AS m "
    f"FROM iss) WHERE m > 0.5"
    for c in (*ISSUE_FEATURES, "l_extendedprice")
)


def _issue_sql(body):
    return (
        f"WITH {ISSUES} SELECT issue, \"column\", other, {r('value')} AS value, detail "
        f"FROM ({body})"
    )


def _issue(name, covers, body, function):
    @plan(name, covers, _issue_sql(body))
    def run(spark, folder):
        return rounded(function(issue_table(spark, folder)), "value")


_issue("multicollinear_pairs", "C3", _PAIRS,
       lambda d: issues.multicollinear_pairs(d, "l_extendedprice"))
_issue("high_cardinality_columns", "C4", _HIGH,
       lambda d: issues.high_cardinality_columns(d, "l_extendedprice"))
_issue("constant_features", "C5", _CONSTANT,
       lambda d: issues.constant_features(d, "l_extendedprice"))
_issue("near_constant_columns", "C6", _NEAR,
       lambda d: issues.near_constant_columns(d, ISSUE_FEATURES))
_issue("leakage_suspects", "C7", _LEAK,
       lambda d: issues.leakage_suspects(d, "l_extendedprice"))
_issue("missing_heavy_columns", "C8", _HEAVY, issues.missing_heavy_columns)
_issue(
    "detect_data_issues", "C1 C2 C3 C4 C5 C6 C7 C8",
    " UNION ALL ".join(
        f"({p})" for p in (_IMBALANCE, _PAIRS, _HIGH, _CONSTANT, _NEAR, _LEAK, _HEAVY)
    ),
    lambda d: issues.detect_data_issues(d, "l_extendedprice"),
)


@plan(
    "class_imbalance", "C2",
    f"""WITH k AS (SELECT CAST(toxic AS VARCHAR) AS c, count(*) AS n FROM labels GROUP BY 1),
 b AS ({_balance('c', 'k')}) SELECT 'class_imbalance' AS issue, 'toxic' AS "column",
 minority_class || ' / ' || majority_class AS other, minority_ratio AS value,
 severity AS detail FROM b""",
)
def class_imbalance(spark, folder):
    return rounded(issues.class_imbalance(table(spark, folder, "labels"), "toxic"), "value")
