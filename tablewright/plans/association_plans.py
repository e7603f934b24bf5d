"""Associations, missing patterns, normality, temporal patterns and fingerprints."""

from itertools import combinations

from pyspark.sql import functions as F

from tablewright.core import local_rows
from tablewright.operators import association, fingerprint, normality, temporal
from tablewright.plans.base import (
    LI,
    LI_NUMERIC,
    lineitem_nulls,
    plan,
    r,
    rounded,
    sql_quantile,
    table,
)


def _union(parts):
    return " UNION ALL ".join(parts)


SOME = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@plan(
    "pearson_correlations", "D1",
    f"WITH {LI}, c AS ("
    + _union(
        f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS v FROM li"
        for a, b in combinations(LI_NUMERIC, 2)
    )
    + f"""), out AS (SELECT 'pair' AS kind, a AS feature_1, b AS feature_2, v FROM c
 UNION ALL SELECT 'target', CASE WHEN a = 'l_extendedprice' THEN b ELSE a END, 'l_extendedprice',
 v FROM c WHERE 'l_extendedprice' IN (a, b) UNION ALL SELECT 'matrix', a, b, v FROM c
 UNION ALL SELECT 'matrix', b, a, v FROM c UNION ALL
 SELECT 'matrix', a, a, 1.0e0 FROM (SELECT a FROM c UNION SELECT b FROM c))
 SELECT kind, feature_1, feature_2, {r('v')} AS correlation FROM out""",
)
def pearson_correlations(spark, folder):
    out = association.compute_correlations(lineitem_nulls(spark, folder), "l_extendedprice")
    return rounded(out, "correlation")


def _rank(c, rows):
    return (
        f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0e0)"
    )


@plan(
    "spearman_correlations", "D2 H1",
    f"WITH {LI}, c AS ("
    + _union(
        f"SELECT '{a}' AS a, '{b}' AS b, (SELECT corr(x, y) FROM (SELECT {_rank(a, 'li')} AS x, "
        f"{_rank(b, 'li')} AS y FROM li WHERE {a} IS NOT NULL AND {b} IS NOT NULL)) AS v"
        for a, b in combinations(SOME, 2)
    )
    + f"""), out AS (SELECT 'pair' AS kind, a AS feature_1, b AS feature_2, v FROM c
 UNION ALL SELECT 'target', CASE WHEN a = 'l_extendedprice' THEN b ELSE a END, 'l_extendedprice',
 v FROM c WHERE 'l_extendedprice' IN (a, b))
 SELECT kind, feature_1, feature_2, {r('v')} AS correlation FROM out""",
)
def spearman_correlations(spark, folder):
    out = association.compute_correlations(
        lineitem_nulls(spark, folder), "l_extendedprice", "spearman", False, SOME
    )
    return rounded(out, "correlation")


# five columns with gaps in different rows, and one without
_GAPPED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_suppkey")
_GAPS_LI = "g AS (SELECT l_partkey, " + ", ".join(
    f"CASE WHEN (l_orderkey + l_linenumber) % {5 + 2 * i} <> 0 THEN {c} END AS {c}"
    for i, c in enumerate(_GAPPED)) + " FROM lineitem)"


@plan(
    "spearman_gapped_columns", "D2 H1",
    f"WITH {_GAPS_LI}, c AS ("
    + _union(
        f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, (SELECT corr(x, y) FROM (SELECT "
        f"{_rank(a, 'g')} AS x, {_rank(b, 'g')} AS y FROM g WHERE {a} IS NOT NULL AND {b} IS NOT NULL)) AS v"
        for a, b in combinations(("l_partkey", *_GAPPED), 2)
    )
    + f") SELECT feature_1, feature_2, {r('v')} AS correlation FROM c",
)
def spearman_gapped_columns(spark, folder):
    """All pairs of six columns of which five have gaps, each ranked among the rows of the pair."""
    rows = table(spark, folder, "lineitem").select("l_partkey", *[
        F.when((F.col("l_orderkey") + F.col("l_linenumber")) % (5 + 2 * i) != 0, F.col(c)).alias(c)
        for i, c in enumerate(_GAPPED)])
    found = association.spearman_correlations(rows, ["l_partkey", *_GAPPED])
    return rounded(local_rows(
        spark, [(a, b, v) for (a, b), v in found.items()],
        "feature_1 string, feature_2 string, correlation double"), "correlation")


KENDALL = ("l_quantity", "l_discount", "l_linenumber")


def _tau(a, b):
    cells = (
        f"(SELECT {a} AS x, {b} AS y, count(*) AS n FROM li WHERE {a} IS NOT NULL "
        f"AND {b} IS NOT NULL GROUP BY ALL)"
    )
    return f"""(SELECT s / sqrt((n0 - tx) * (n0 - ty)) FROM
 (SELECT sum(CAST(p.n AS DOUBLE) * q.n * sign(p.x - q.x) * sign(p.y - q.y)) / 2 AS s
  FROM {cells} AS p, {cells} AS q),
 (SELECT sum(n) * (sum(n) - 1) / 2.0e0 AS n0 FROM {cells}),
 (SELECT sum(g * (g - 1) / 2.0e0) AS tx FROM (SELECT sum(n) AS g FROM {cells} GROUP BY x)),
 (SELECT sum(g * (g - 1) / 2.0e0) AS ty FROM (SELECT sum(n) AS g FROM {cells} GROUP BY y)))"""


@plan(
    "kendall_correlations", "D3",
    f"WITH {LI}, c AS ("
    + _union(
        f"SELECT '{a}' AS a, '{b}' AS b, {_tau(a, b)} AS v" for a, b in combinations(KENDALL, 2)
    )
    + f"""), out AS (SELECT 'pair' AS kind, a AS feature_1, b AS feature_2, v FROM c
 UNION ALL SELECT 'target', CASE WHEN a = 'l_quantity' THEN b ELSE a END, 'l_quantity',
 v FROM c WHERE 'l_quantity' IN (a, b))
 SELECT kind, feature_1, feature_2, {r('v')} AS correlation FROM out""",
)
def kendall_correlations(spark, folder):
    out = association.compute_correlations(
        lineitem_nulls(spark, folder), "l_quantity", "kendall", False, KENDALL
    )
    return rounded(out, "correlation")


def _mi_sql(feature, target, source):
    cells = f"SELECT {feature} AS x, {target} AS y FROM {source}"
    return f"""SELECT '{feature}' AS feature, greatest(
 (SELECT ln(CAST(count(*) AS DOUBLE)) FROM {source}) +
 ((SELECT sum(n * ln(CAST(n AS DOUBLE))) FROM (SELECT count(*) AS n FROM ({cells}) GROUP BY x, y))
 - (SELECT sum(n * ln(CAST(n AS DOUBLE))) FROM (SELECT count(*) AS n FROM ({cells}) GROUP BY x))
 - (SELECT sum(n * ln(CAST(n AS DOUBLE))) FROM (SELECT count(*) AS n FROM ({cells}) GROUP BY y)))
 / (SELECT count(*) FROM {source}), 0.0e0) AS mi"""


@plan(
    "mutual_information_discrete", "D4",
    f"SELECT feature, {r('mi')} AS mi, {r('mi')} > 0.01 AS informative FROM ("
    + _union(_mi_sql(f, "p_type", "part") for f in ("p_brand", "p_name"))
    + ")",
)
def mutual_information_discrete(spark, folder):
    part = table(spark, folder, "part").select("p_brand", "p_name", "p_type")
    return rounded(association.mutual_information(part, "p_type"), "mi")


BINS = 8


def _binned(c, fill=None):
    filled = c if fill is None else f"coalesce(CAST({c} AS DOUBLE), {fill})"
    return " + ".join(
        f"(CASE WHEN {filled} > {sql_quantile('li', c, k / BINS)} THEN 1 ELSE 0 END)"
        for k in range(1, BINS)
    )


# heavy quantiles may repeat, which only repeats a comparison and leaves the classes unchanged
@plan("mutual_information_neighbours", "D4")
def mutual_information_neighbours(spark, folder):
    """Continuous columns of orders with the price, and order status as a class, by neighbours."""
    orders = table(spark, folder, "orders")
    price = association.mutual_information(
        orders, "o_totalprice", "regression", features=["o_custkey", "o_orderstatus", "o_orderpriority"],
        method="neighbours")
    status = association.mutual_information(
        orders, "o_orderstatus", features=["o_totalprice", "o_custkey", "o_orderpriority"],
        method="neighbours")
    return rounded(price.withColumn("target", F.lit("o_totalprice")).unionByName(
        status.withColumn("target", F.lit("o_orderstatus"))), "mi")


@plan(
    "mutual_information_binned", "D4",
    f"WITH {LI}, b AS (SELECT {_binned('l_extendedprice')} AS target_bin, "
    + ", ".join(
        f"{_binned(c, sql_quantile('li', c, 0.5))} AS {c}_bin" for c in ("l_quantity", "l_tax")
    )
    + ", l_returnflag FROM li) "
    + f"SELECT replace(feature, '_bin', '') AS feature, {r('mi', 3)} AS mi, "
    f"{r('mi')} > 0.01 AS informative FROM ("
    + _union(
        _mi_sql(f, "target_bin", "b") for f in ("l_quantity_bin", "l_tax_bin", "l_returnflag")
    )
    + ")",
)
def mutual_information_binned(spark, folder):
    li = lineitem_nulls(spark, folder).select(
        "l_extendedprice", "l_quantity", "l_tax", "l_returnflag"
    )
    out = association.mutual_information(li, "l_extendedprice", "regression", bins=BINS)
    return rounded(out, "mi", digits=3)


def _cramer(a, b, source):
    return f"""SELECT '{a}' AS feature_1, '{b}' AS feature_2,
 (SELECT sqrt(CASE WHEN ra = 2 AND rb = 2 THEN yates ELSE chi END / (n * (least(ra, rb) - 1)))
 FROM (SELECT sum(pow(coalesce(o, 0) - e, 2) / e) AS chi,
 sum(pow(abs(coalesce(o, 0) - e) - least(0.5e0, abs(coalesce(o, 0) - e)), 2) / e) AS yates,
 max(n) AS n, count(DISTINCT a) AS ra, count(DISTINCT b) AS rb FROM
 (SELECT ka.a, kb.b, ka.na * kb.nb * 1.0e0 / t.n AS e, t.n AS n FROM
 (SELECT {a} AS a, count(*) AS na FROM {source} GROUP BY 1) ka,
 (SELECT {b} AS b, count(*) AS nb FROM {source} GROUP BY 1) kb,
 (SELECT count(*) AS n FROM {source}) t) g LEFT JOIN
 (SELECT {a} AS a, {b} AS b, count(*) AS o FROM {source} GROUP BY 1, 2) k USING (a, b)))
 AS cramers_v"""


@plan(
    "cramers_v_pairs", "D5",
    f"SELECT feature_1, feature_2, {r('cramers_v')} AS cramers_v FROM ("
    + _union(
        _cramer(a, b, "t0") for a, b in combinations(("p_name", "p_brand", "p_type", "big"), 2)
    ).replace("t0", "(SELECT *, CASE WHEN p_size > 25 THEN 'y' ELSE 'n' END AS big FROM part)")
    + ")",
)
def cramers_v_pairs(spark, folder):
    part = table(spark, folder, "part").select(
        "p_name", "p_brand", "p_type",
        F.when(F.col("p_size") > 25, "y").otherwise("n").alias("big"),
    )
    return rounded(association.cramers_v(part), "cramers_v")


@plan(
    "cramers_v_two_by_two", "D5",
    f"SELECT feature_1, feature_2, {r('cramers_v', 5)} AS cramers_v FROM ("
    + _cramer("big", "l_linestatus", "t0").replace(
        "t0",
        "(SELECT l_linestatus, CASE WHEN l_quantity > 25 AND l_linestatus = 'F' OR "
        "l_tax > 0.06 THEN 'y' ELSE 'n' END AS big FROM lineitem)",
    )
    + ")",
)
def cramers_v_two_by_two(spark, folder):
    big = (
        (F.col("l_quantity") > 25) & (F.col("l_linestatus") == "F")
    ) | (F.col("l_tax") > 0.06)
    li = table(spark, folder, "lineitem").select(
        F.when(big, "y").otherwise("n").alias("big"), "l_linestatus"
    )
    return rounded(association.cramers_v(li, "l_linestatus"), "cramers_v", digits=5)


def _filled(columns, extra):
    return (
        "f AS (SELECT " + ", ".join(
            f"coalesce(CAST({c} AS DOUBLE), {sql_quantile('li', c, 0.5)}) AS {c}" for c in columns
        ) + f", {extra} FROM li)"
    )


ANOVA = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@plan(
    "anova_f", "D6",
    f"WITH {LI}, {_filled(ANOVA, 'l_returnflag')} " + _union(
        f"SELECT '{c}' AS feature, {r('f', 3)} AS f_statistic FROM (SELECT "
        f"(sum(n * pow(m - (SELECT avg({c}) FROM f), 2)) / (count(*) - 1)) / "
        f"(sum(n * v) / (sum(n) - count(*))) AS f FROM (SELECT count(*) AS n, avg({c}) AS m, "
        f"var_pop({c}) AS v FROM f GROUP BY l_returnflag))"
        for c in ANOVA
    ),
)
def anova_f(spark, folder):
    li = lineitem_nulls(spark, folder).select(*ANOVA, "l_returnflag")
    out = association.anova_scores(li, "l_returnflag").select("feature", "f_statistic")
    return rounded(out, "f_statistic", digits=3)


@plan("anova_p_values", "D6")
def anova_p_values(spark, folder):
    return association.anova_scores(lineitem_nulls(spark, folder), "l_returnflag")


@plan(
    "variance_inflation_pair", "D7",
    f"WITH {LI}, {_filled(('l_quantity', 'l_tax'), 'l_returnflag')}, v AS (SELECT "
    "1 / (1 - least(pow(corr(l_quantity, l_tax), 2), 0.9999e0)) AS v FROM f) "
    f"SELECT c AS feature, {r('v')} AS vif, v > 10 AS high, v > 50 AS severe FROM v, "
    "(VALUES ('l_quantity'), ('l_tax')) AS t(c)",
)
def variance_inflation_pair(spark, folder):
    li = lineitem_nulls(spark, folder).select("l_quantity", "l_tax", "l_returnflag")
    return rounded(association.variance_inflation(li, "l_returnflag"), "vif")


_THREE = ("l_quantity", "l_tax", "l_extendedprice")


def _vif_of(a, b, c):
    """From the correlations of three columns: 1 / (1 - R squared of ``a`` on the others)."""
    explained = (f"(pow(corr({a}, {b}), 2) + pow(corr({a}, {c}), 2) - 2 * corr({a}, {b}) * corr({a}, {c}) "
                 f"* corr({b}, {c})) / (1 - pow(corr({b}, {c}), 2))")
    return f"SELECT '{a}' AS feature, 1 / (1 - least({explained}, 0.9999e0)) AS v FROM f"


@plan(
    "variance_inflation_triple", "D7",
    f"WITH {LI}, {_filled(_THREE, 'l_returnflag')}, w AS ("
    + _union(_vif_of(*(_THREE[i:] + _THREE[:i])) for i in range(3))
    + f") SELECT feature, {r('v')} AS vif, v > 10 AS high, v > 50 AS severe FROM w",
)
def variance_inflation_triple(spark, folder):
    li = lineitem_nulls(spark, folder).select(*_THREE, "l_returnflag")
    return rounded(association.variance_inflation(li, "l_returnflag"), "vif")


@plan("variance_inflation", "D7")
def variance_inflation(spark, folder):
    li = lineitem_nulls(spark, folder).withColumn(
        "net", F.col("l_extendedprice") * 0.9 + F.col("l_quantity") * 100
    )
    return association.variance_inflation(li, "l_returnflag")


@plan(
    "detect_timestamp_columns", "D8",
    """WITH d AS (SELECT CAST(o_orderdate AS VARCHAR) AS iso, strftime(o_orderdate, '%m/%d/%Y')
 AS us, o_orderpriority FROM orders),
 p AS (SELECT 'iso' AS "column", count(iso) AS n, count(TRY_CAST(iso AS TIMESTAMP)) AS k,
 min(TRY_CAST(iso AS TIMESTAMP)) AS lo, max(TRY_CAST(iso AS TIMESTAMP)) AS hi FROM d
 UNION ALL SELECT 'us', count(us), count(try_strptime(us, '%m/%d/%Y')),
 min(try_strptime(us, '%m/%d/%Y')), max(try_strptime(us, '%m/%d/%Y')) FROM d
 UNION ALL SELECT 'o_orderpriority', count(*), count(TRY_CAST(o_orderpriority AS TIMESTAMP)),
 NULL, NULL FROM d)
 SELECT "column", k / n AS success_rate, strftime(lo, '%Y-%m-%d %H:%M:%S') AS min_date,
 strftime(hi, '%Y-%m-%d %H:%M:%S') AS max_date FROM p WHERE k / n > 0.8""",
)
def detect_timestamp_columns(spark, folder):
    orders = table(spark, folder, "orders").select(
        F.col("o_orderdate").cast("string").alias("iso"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("us"), "o_orderpriority",
    )
    return temporal.detect_timestamp_columns(orders)


_GAPS = [(a, b) for a in ("l_discount", "l_tax") for b in LI_NUMERIC if a != b]


@plan(
    "missing_patterns", "D9",
    f"WITH {LI}, c AS (" + _union(
        f"SELECT '{a}' AS a, '{b}' AS b, corr(CASE WHEN {a} IS NULL THEN 1.0e0 ELSE 0 END, {b}) "
        f"AS v, count({b}) AS n FROM li"
        for a, b in _GAPS
    ) + f"""), ok AS (SELECT * FROM c WHERE isfinite(v) AND n >= 10),
 top AS (SELECT max(abs(v)) AS m FROM ok)
 SELECT a AS missing_column, b AS correlated_with, {r('v')} AS correlation,
 CASE WHEN m < 0.1 THEN 'MCAR' WHEN m < 0.5 THEN 'MAR' ELSE 'MNAR' END AS pattern,
 {r('m')} AS max_correlation FROM ok, top WHERE abs(v) > 0.1 ORDER BY abs(v) DESC LIMIT 20""",
)
def missing_patterns(spark, folder):
    out = association.missing_patterns(lineitem_nulls(spark, folder))
    return rounded(out, "correlation", "max_correlation")


_AD = ("l_quantity", "l_extendedprice", "l_tax")


def _normal(z):
    """The normal distribution by its power series; terms (-1)^k z^(2k+1) / (2^k k! (2k+1))."""
    return ("(0.5e0 + list_sum(list_transform(range(0, 70), lambda k: CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END "
            f"* pow({z}, 2 * k + 1) / (pow(2.0e0, k) * gamma(CAST(k + 1 AS DOUBLE)) * (2 * k + 1))))"
            " / sqrt(2 * pi()))")


def _anderson(c):
    """A-squared over sorted places."""
    return f"""SELECT '{c}' AS "column", n AS n_valid, {r('-n - s / n', 2)} AS statistic,
 -n - s / n < round(0.787 / (1.0e0 + 4.0e0 / n - 25.0e0 / n / n), 3) AS is_normal FROM
 (SELECT count(*) AS n, sum((2 * i - 1) * ln(p) + (2 * (SELECT count({c}) FROM li) + 1 - 2 * i) * ln(1 - p)) AS s
 FROM (SELECT i, {_normal('z')} AS p FROM (SELECT ({c} - m) / d AS z,
 row_number() OVER (ORDER BY {c}) AS i FROM li, (SELECT avg({c}) AS m, stddev_samp({c}) AS d FROM li)
 WHERE {c} IS NOT NULL)))"""


@plan(
    "normality_anderson_darling", "D11",
    f"WITH {LI} " + _union(_anderson(c) for c in _AD),
)
def normality_anderson_darling(spark, folder):
    found = normality.test_normality(
        lineitem_nulls(spark, folder), list(_AD), method="anderson_darling")
    return rounded(found.select("column", "n_valid", "statistic", "is_normal"), "statistic", digits=2)


def _poly(coefficients, x):
    """Horner form, highest power first."""
    out = f"({coefficients[0]!r}e0)"
    for c in coefficients[1:]:
        out = f"({out} * {x} + ({c!r}e0))"
    return out


# fixed values: published coefficients of the approximation for more than five values
_SHAPIRO = f"""idx AS (SELECT row_number() OVER (ORDER BY s_acctbal) AS i, CAST(s_acctbal AS DOUBLE) AS x,
 count(*) OVER () AS n FROM supplier),
 halves AS (SELECT i, x, n, (i - 0.375e0) / (n + 0.25e0) AS p, -6.0e0 AS lo, 6.0e0 AS hi, 0 AS step FROM idx
 UNION ALL SELECT i, x, n, p, CASE WHEN {_normal('mid')} < p THEN mid ELSE lo END,
 CASE WHEN {_normal('mid')} < p THEN hi ELSE mid END, step + 1
 FROM (SELECT *, (lo + hi) / 2 AS mid FROM halves) WHERE step < 52),
 m AS (SELECT i, x, n, (lo + hi) / 2 AS m FROM halves WHERE step = 52),
 ends AS (SELECT n, 1 / sqrt(n) AS u, sum(m * m) AS ssq, max(m) AS m1, max(m) FILTER (WHERE i = n - 1) AS m2,
 avg(x) AS centre FROM m GROUP BY n),
 tails AS (SELECT *, m1 / sqrt(ssq) + {_poly([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0], 'u')} AS a1,
 m2 / sqrt(ssq) + {_poly([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0], 'u')} AS a2 FROM ends),
 scaled AS (SELECT *, sqrt((ssq - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) AS d FROM tails),
 w AS (SELECT t.n, pow(sum(x * CASE WHEN i = t.n THEN a1 WHEN i = 1 THEN -a1 WHEN i = t.n - 1 THEN a2
 WHEN i = 2 THEN -a2 ELSE m / d END), 2) / sum(pow(x - centre, 2)) AS w FROM m, scaled t GROUP BY t.n),
 z AS (SELECT n, w, CASE WHEN n <= 11 THEN (-ln(-2.273e0 + 0.459e0 * n - ln(1 - w))
 - {_poly([-0.0006714, 0.025054, -0.39978, 0.5440], 'n')}) / exp({_poly([-0.0020322, 0.062767, -0.77857, 1.3822], 'n')})
 ELSE (ln(1 - w) - {_poly([0.0038915, -0.083751, -0.31082, -1.5861], 'ln(n)')})
 / exp({_poly([0.0030302, -0.082676, -0.4803], 'ln(n)')}) END AS z FROM w)"""


@plan(
    "normality_shapiro_wilk", "D10",
    f"""WITH RECURSIVE {_SHAPIRO} SELECT 's_acctbal' AS "column", n AS n_valid, {r('w', 6)} AS statistic,
 {r('1 - ' + _normal('z'))} AS p_value, 1 - {_normal('z')} > 0.05 AS is_normal FROM z""",
)
def normality_shapiro_wilk(spark, folder):
    found = normality.test_normality(
        table(spark, folder, "supplier").select("s_acctbal"), method="shapiro_wilk")
    return rounded(rounded(found.select("column", "n_valid", "statistic", "p_value", "is_normal"),
                           "statistic", digits=6), "p_value")


_EVENTS = """e AS (SELECT CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS DOUBLE) AS i,
 value, CASE WHEN event_id % 11 <> 0 THEN value + user_id END AS gappy FROM events)"""


def _temporal_sql(c):
    return f"""SELECT '{c}' AS "column", {r(f'regr_slope({c}, i)', 6)} AS slope,
 {r(f'pow(corr(i, {c}), 2)')} AS r_squared,
 (SELECT {r(f'avg(p) / (SELECT var_pop({c}) FROM e)')} FROM (SELECT ({c} - m) * (lead({c}) OVER
 (ORDER BY i) - m) AS p FROM e, (SELECT avg({c}) AS m FROM e) WHERE {c} IS NOT NULL))
 AS autocorrelation, count(*) AS n_valid_dates, 'ok' AS status FROM e"""


@plan(
    "temporal_patterns", "D12 D13 H2 H3",
    f"WITH {_EVENTS} " + _union(_temporal_sql(c) for c in ("value", "gappy")),
)
def temporal_patterns(spark, folder):
    events = table(spark, folder, "events").select(
        "ts", "event_id", "value",
        F.when(F.col("event_id") % 11 != 0, F.col("value") + F.col("user_id")).alias("gappy"),
    )
    out = temporal.temporal_patterns(events, "ts", ["event_id"]).drop("p_value", "has_trend")
    return rounded(rounded(out, "slope", digits=6), "r_squared", "autocorrelation")


@plan("temporal_recommendation", "D12")
def temporal_recommendation(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderdate", "o_orderkey", "o_totalprice")
    return temporal.temporal_recommendation(
        temporal.temporal_patterns(orders, "o_orderdate", ["o_orderkey"])
    )


SEP = ("l_quantity", "l_extendedprice", "l_tax")


def _fisher(c):
    return f"""SELECT '{c}' AS feature, avg(pow(a.m - b.m, 2) / (a.v + b.v)) AS s FROM
 (SELECT l_returnflag AS k, avg({c}) AS m, var_samp({c}) AS v FROM li GROUP BY 1) a JOIN
 (SELECT l_returnflag AS k, avg({c}) AS m, var_samp({c}) AS v FROM li GROUP BY 1) b
 ON a.k < b.k"""


@plan(
    "separability", "D14",
    f"WITH {LI} SELECT feature, {r('s', 8)} AS separability FROM ("
    + _union(_fisher(c) for c in SEP) + ")",
)
def separability(spark, folder):
    li = lineitem_nulls(spark, folder).select(*SEP, "l_returnflag")
    return rounded(association.separability(li, "l_returnflag"), "separability", digits=8)


@plan(
    "separability_many_classes", "D14",
    f"""WITH k AS (SELECT o_custkey AS c, count(*) AS n, avg(o_totalprice) AS m,
 var_samp(o_totalprice) AS v, avg(o_orderkey) AS m2, var_samp(o_orderkey) AS v2
 FROM orders GROUP BY o_custkey HAVING count(*) > 1)
 SELECT feature, {r('s', 6)} AS separability FROM (SELECT 'o_totalprice' AS feature,
 avg(pow(a.m - b.m, 2) / (a.v + b.v)) AS s FROM k a JOIN k b ON a.c < b.c
 UNION ALL SELECT 'o_orderkey', avg(pow(a.m2 - b.m2, 2) / (a.v2 + b.v2)) FROM k a JOIN k b ON a.c < b.c)""",
)
def separability_many_classes(spark, folder):
    """Customers as classes of their orders: more classes than are compared pair by pair."""
    orders = table(spark, folder, "orders").select("o_custkey", "o_totalprice", "o_orderkey")
    named = orders.withColumn("o_custkey", F.col("o_custkey").cast("string"))
    return rounded(association.separability(named, "o_custkey", block=100), "separability", digits=6)


@plan(
    "separability_summary", "D14",
    f"WITH {LI}, s AS (" + _union(_fisher(c) for c in SEP) + f"""), m AS
 (SELECT avg(round(s, 4)) AS m FROM s) SELECT m AS mean_separability,
 (SELECT count(DISTINCT l_returnflag) FROM li) AS n_classes, CASE WHEN m > 2 THEN 'easy'
 WHEN m > 0.5 THEN 'moderate' WHEN m > 0.1 THEN 'hard' ELSE 'very_hard' END AS difficulty
 FROM m""",
)
def separability_summary(spark, folder):
    li = lineitem_nulls(spark, folder).select(*SEP, "l_returnflag")
    return association.separability_summary(li, "l_returnflag")


_FINGER = f"""{LI}, base AS (SELECT count(*) AS n_rows,
 round((avg(CASE WHEN l_discount IS NULL THEN 1.0e0 ELSE 0 END) +
 avg(CASE WHEN l_tax IS NULL THEN 1.0e0 ELSE 0 END)) / 11 * 100, 4) AS miss FROM li),
 cls AS (SELECT count(*) AS k, round(min(n) / max(n), 4) AS ratio,
 round(ln(CAST(sum(n) AS DOUBLE)) - sum(n * ln(CAST(n AS DOUBLE))) / sum(n), 4) AS ent
 FROM (SELECT count(*) AS n FROM li GROUP BY l_returnflag))"""
_SIZE = (
    "CASE WHEN n_rows < 1000 THEN 'small' WHEN n_rows < 100000 THEN 'medium' ELSE 'large' END"
)


@plan(
    "dataset_fingerprint", "D15 D17 D18",
    f"""WITH {_FINGER}, w AS (SELECT round(sum(CASE WHEN n > 50 THEN 1 ELSE 0 END) / 2.0e0, 4)
 AS hc FROM (SELECT count(DISTINCT l_linestatus) AS n FROM li UNION ALL
 SELECT count(DISTINCT l_shipdate) FROM li))
 SELECT {_SIZE} AS size_class, 'multiclass_classification' AS task, 'mostly_numeric'
 AS feature_mix, n_rows, 11 AS n_cols, concat_ws(',', CASE WHEN miss > 5 THEN 'missing_values'
 END, CASE WHEN ratio < 0.2 THEN 'class_imbalance' END) AS issues, 0.8e0 AS numeric_ratio,
 miss AS missing_pct_overall, k AS n_classes, ratio AS minority_ratio, ent AS target_entropy,
 CAST(NULL AS DOUBLE) AS target_skewness, hc AS high_cardinality_ratio,
 CAST(least(5, 1 + CASE WHEN n_rows > 100000 THEN 1 ELSE 0 END + CASE WHEN miss > 10 THEN 1
 ELSE 0 END + CASE WHEN hc > 0.3 THEN 1 ELSE 0 END + CASE WHEN ratio < 0.2 THEN 1 ELSE 0 END)
 AS INTEGER) AS complexity_score,
 {r('''greatest(0.0e0, 1.0e0 - least(miss / 50, 0.3e0) - CASE WHEN ratio < 0.5
 THEN (0.5e0 - ratio) * 0.4e0 ELSE 0 END - least(hc * 0.2e0, 0.1e0))''')}
 AS data_quality_score FROM base, cls, w""",
)
def dataset_fingerprint(spark, folder):
    out = fingerprint.dataset_fingerprint(lineitem_nulls(spark, folder), "l_returnflag")
    return rounded(out, "data_quality_score")


@plan(
    "light_fingerprint_profile", "D19",
    f"""WITH {LI}, base AS (SELECT count(*) AS n_rows, avg(CASE WHEN l_discount IS NULL THEN 1.0e0
 ELSE 0 END) AS d, avg(CASE WHEN l_tax IS NULL THEN 1.0e0 ELSE 0 END) AS t FROM li),
 c AS (SELECT min(n) / max(n) AS ratio FROM (SELECT count(*) AS n FROM li GROUP BY l_returnflag))
 SELECT {_SIZE} AS size_class, 'multiclass_classification' AS task, 'mostly_numeric'
 AS feature_mix, n_rows, 11 AS n_cols, concat_ws(',', CASE WHEN d > 0.05 OR t > 0.05 THEN
 'missing_values' END, CASE WHEN ratio < 0.5 THEN 'class_imbalance' END) AS issues
 FROM base, c""",
)
def light_fingerprint_profile(spark, folder):
    return fingerprint.light_fingerprint(
        lineitem_nulls(spark, folder), "l_returnflag", variant="profile"
    )


@plan(
    "light_fingerprint_file", "D19",
    f"""WITH {LI}, base AS (SELECT count(*) AS n_rows, (avg(CASE WHEN l_discount IS NULL THEN
 1.0e0 ELSE 0 END) + avg(CASE WHEN l_tax IS NULL THEN 1.0e0 ELSE 0 END)) / 11 AS m FROM li)
 SELECT {_SIZE} AS size_class, 'regression' AS task, 'mixed' AS feature_mix, n_rows,
 11 AS n_cols, CASE WHEN m > 0.05 THEN 'missing_values' ELSE '' END AS issues FROM base""",
)
def light_fingerprint_file(spark, folder):
    return fingerprint.light_fingerprint(lineitem_nulls(spark, folder), "l_extendedprice")


@plan(
    "eda_signal_fields", "D16",
    f"""WITH {LI}, c AS (SELECT round(greatest(abs(corr(twin, l_extendedprice)),
 abs(corr(l_quantity, l_extendedprice))), 4) AS linear,
 pow(corr(twin, l_quantity), 2) AS shared FROM (SELECT *, l_extendedprice * 3 AS twin FROM li)),
 v AS (SELECT CASE WHEN 1 / (1 - least(shared, 0.9999e0)) > 10 THEN 2 ELSE 0 END AS high,
 CASE WHEN 1 / (1 - least(shared, 0.9999e0)) > 50 THEN 2 ELSE 0 END AS severe FROM c)
 SELECT linear AS max_linear_signal, CAST(NULL AS DOUBLE) AS max_nonlinear_signal,
 CAST(NULL AS BIGINT) AS n_informative_features, CAST(high AS BIGINT) AS n_redundant_pairs,
 'MNAR' AS missing_pattern, false AS is_temporal, CASE WHEN linear > 0.5 THEN 'linear'
 ELSE 'weak' END AS signal_type, CASE WHEN severe > 0 THEN 'severe' WHEN high > 0 THEN 'moderate'
 ELSE 'low' END AS redundancy_level FROM c, v""",
)
def eda_signal_fields(spark, folder):
    full = lineitem_nulls(spark, folder)
    li = full.select(
        "l_quantity", "l_extendedprice", (F.col("l_extendedprice") * 3).alias("twin")
    )
    return fingerprint.eda_fields(
        association.compute_correlations(li, "l_extendedprice", include_matrix=False),
        inflation=association.variance_inflation(li, "l_extendedprice"),
        pattern=association.missing_pattern(full),
    )


@plan("full_fingerprint", "D15 D16 D17 D18 D19")
def full_fingerprint(spark, folder):
    li = lineitem_nulls(spark, folder).drop("l_shipdate")
    return fingerprint.fingerprint_from_eda(fingerprint.full_fingerprint(li, "l_returnflag"))
