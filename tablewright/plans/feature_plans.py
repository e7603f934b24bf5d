"""Feature operations."""

from pyspark.sql import functions as F

from tablewright.operators.features import auto_preprocess, engineer_features
from tablewright.operators.splits import assign_folds
from tablewright.plans.base import (
    LI,
    lineitem_nulls,
    plan,
    r,
    rounded,
    scratch,
    sql_quantile,
    table,
)
from tablewright.sources.tables import load_table as read_table
from tablewright.sources.tables import write_table


def _apply(df, *configs):
    return engineer_features(df, list(configs))[0]


ORDERS = ("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus")


def _orders(spark, folder):
    return table(spark, folder, "orders").select(*ORDERS)


@plan(
    "one_hot_encode", "E1",
    "SELECT o_orderkey, o_totalprice, "
    + ", ".join(
        f"CAST(coalesce(o_orderstatus = '{v}', false) AS INTEGER) AS \"o_orderstatus_{v}\""
        for v in ("F", "O", "P")
    )
    + " FROM orders",
)
def one_hot_encode(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return _apply(df, {"type": "one_hot_encode", "columns": ["o_orderstatus"]})


def _codes(text, source):
    return (
        f"(SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT "
        f"{text} AS v FROM {source}))"
    )


@plan(
    "label_encode", "E2",
    f"""WITH t AS (SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE
 o_orderpriority END AS priority FROM orders), k AS {_codes("coalesce(priority, 'nan')", 't')}
 SELECT o_orderkey, code AS priority FROM t JOIN k ON k.v = coalesce(priority, 'nan')""",
)
def label_encode(spark, folder):
    priority = F.when(F.col("o_custkey") % 10 != 0, F.col("o_orderpriority"))
    df = table(spark, folder, "orders").select("o_orderkey", priority.alias("priority"))
    return _apply(df, {"type": "label_encode", "columns": ["priority"]})


def _impute(strategy, fill):
    @plan(
        f"impute_numeric_{strategy}", "E3",
        f"WITH {LI} SELECT l_orderkey, l_linenumber, "
        f"{r(f'coalesce(l_discount, {fill})', 6)} AS l_discount FROM li",
    )
    def run(spark, folder):
        df = lineitem_nulls(spark, folder).select("l_orderkey", "l_linenumber", "l_discount")
        out = _apply(
            df, {"type": "impute_numeric", "columns": ["l_discount"], "strategy": strategy}
        )
        return rounded(out, "l_discount", digits=6)


_impute("mean", "(SELECT avg(l_discount) FROM li)")
_impute("median", sql_quantile("li", "l_discount", 0.5))
_impute("zero", "0.0e0")


@plan(
    "impute_categorical", "E4",
    """WITH t AS (SELECT o_orderkey, CASE WHEN o_custkey % 5 <> 0 THEN o_orderpriority END AS p,
 CASE WHEN o_custkey % 3 <> 0 THEN o_orderstatus END AS s FROM orders)
 SELECT o_orderkey, coalesce(p, (SELECT p FROM t WHERE p IS NOT NULL GROUP BY p
 ORDER BY count(*) DESC, p LIMIT 1)) AS p, coalesce(s, 'missing') AS s FROM t""",
)
def impute_categorical(spark, folder):
    df = table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(F.col("o_custkey") % 5 != 0, F.col("o_orderpriority")).alias("p"),
        F.when(F.col("o_custkey") % 3 != 0, F.col("o_orderstatus")).alias("s"),
    )
    return _apply(
        df,
        {"type": "impute_categorical", "columns": ["p"]},
        {"type": "impute_categorical", "columns": ["s"], "strategy": "constant"},
    )


@plan(
    "standard_scale", "E5",
    f"WITH {LI} SELECT l_orderkey, l_linenumber, "
    + ", ".join(
        f"{r(f'({c} - (SELECT avg({c}) FROM li)) / (SELECT stddev_pop({c}) FROM li)')} AS {c}"
        for c in ("l_quantity", "l_tax")
    )
    + " FROM li",
)
def standard_scale(spark, folder):
    df = lineitem_nulls(spark, folder).select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    out = _apply(df, {"type": "standard_scale", "columns": ["l_quantity", "l_tax"]})
    return rounded(out, "l_quantity", "l_tax")


def _row_wise(name, covers, columns, config, sql_columns, rounding, digits=4):
    select = ", ".join(
        f"{r(e, digits) if c in rounding else e} AS \"{c}\"" for c, e in sql_columns.items()
    )

    @plan(name, covers, f"WITH {LI} SELECT {select} FROM li")
    def run(spark, folder):
        df = lineitem_nulls(spark, folder).select(*columns)
        return rounded(_apply(df, config), *rounding, digits=digits)


_row_wise(
    "log_transform", "E6", ["l_orderkey", "l_extendedprice", "l_tax"],
    {"type": "log_transform", "columns": ["l_extendedprice", "l_tax"]},
    {"l_orderkey": "l_orderkey", "l_extendedprice": "ln(1 + l_extendedprice)",
     "l_tax": "ln(1 + l_tax)"},
    ["l_extendedprice", "l_tax"],
)
_row_wise(
    "drop_columns", "E7", ["l_orderkey", "l_linenumber", "l_quantity", "l_tax"],
    {"type": "drop_columns", "columns": ["l_tax", "l_quantity"]},
    {"l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber"}, [],
)
_row_wise(
    "create_interaction", "E8", ["l_orderkey", "l_extendedprice", "l_discount"],
    {"type": "create_interaction", "column_a": "l_extendedprice", "column_b": "l_discount"},
    {"l_orderkey": "l_orderkey", "l_extendedprice": "l_extendedprice", "l_discount": "l_discount",
     "l_extendedprice_x_l_discount": "l_extendedprice * l_discount"},
    ["l_extendedprice_x_l_discount"],
)
_row_wise(
    "polynomial_features", "E12", ["l_orderkey", "l_quantity", "l_tax"],
    {"type": "polynomial_features", "columns": ["l_quantity", "l_tax"]},
    {"l_orderkey": "l_orderkey", "l_quantity": "l_quantity", "l_tax": "l_tax",
     "l_quantity^2": "l_quantity * l_quantity", "l_quantity l_tax": "l_quantity * l_tax",
     "l_tax^2": "l_tax * l_tax"},
    ["l_quantity^2", "l_quantity l_tax", "l_tax^2"],
)
_row_wise(
    "cyclic_encode", "E18", ["l_orderkey", "l_linenumber"],
    {"type": "cyclic_encode", "column": "l_linenumber", "period": 7},
    {"l_orderkey": "l_orderkey",
     "l_linenumber_sin": "sin(2 * pi() * l_linenumber / 7.0e0)",
     "l_linenumber_cos": "cos(2 * pi() * l_linenumber / 7.0e0)"},
    ["l_linenumber_sin", "l_linenumber_cos"],
)
_row_wise(
    "ratio_features", "E19", ["l_orderkey", "l_extendedprice", "l_quantity"],
    {"type": "ratio_features", "numerator": "l_extendedprice", "denominator": "l_quantity"},
    {"l_orderkey": "l_orderkey", "l_extendedprice": "l_extendedprice",
     "l_quantity": "l_quantity",
     "l_extendedprice_over_l_quantity": "l_extendedprice / (l_quantity + 1e-8)"},
    ["l_extendedprice_over_l_quantity"],
)


_BRANDS = """t AS (SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity, CASE WHEN
 p_size % 9 <> 0 THEN p_brand END AS p_brand FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def _brands(spark, folder):
    part = table(spark, folder, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.when(F.col("p_size") % 9 != 0, F.col("p_brand")).alias("p_brand"),
    )
    li = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_partkey"
    )
    return li.join(part, "l_partkey").drop("l_partkey")


@plan(
    "target_encode", "E9",
    f"""WITH {_BRANDS}, s AS (SELECT p_brand, avg(l_extendedprice) AS m,
 count(l_extendedprice) AS n FROM t WHERE p_brand IS NOT NULL GROUP BY 1),
 e AS (SELECT p_brand AS b, g * (1 - 1 / (1 + exp(-(n - 1) / 10.0e0))) +
 m * (1 / (1 + exp(-(n - 1) / 10.0e0))) AS enc FROM s, (SELECT avg(l_extendedprice) AS g FROM t))
 SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity, {r('enc')} AS p_brand
 FROM t LEFT JOIN e ON p_brand = b""",
)
def target_encode(spark, folder):
    out = _apply(
        _brands(spark, folder),
        {"type": "target_encode", "columns": ["p_brand"], "target_column": "l_extendedprice"},
    )
    return rounded(out, "p_brand")


def _hash(key, seed):
    return f"CAST(('0x' || substr(md5({key} || ':{seed}'), 1, 13)) AS BIGINT)"


@plan(
    "target_encode_out_of_fold", "E9",
    f"""WITH t AS (SELECT o_orderkey, o_orderpriority, o_totalprice, CAST((row_number() OVER
 (ORDER BY {_hash('o_orderkey', 7)}) - 1) * 3 // count(*) OVER () AS INTEGER) AS fold
 FROM orders),
 p AS (SELECT o_orderpriority AS k, fold AS f, sum(o_totalprice) AS s, count(*) AS n FROM t
 GROUP BY 1, 2), q AS (SELECT k, sum(s) AS s, sum(n) AS n FROM p GROUP BY 1),
 g AS (SELECT f, sum(s) AS s, sum(n) AS n FROM p GROUP BY 1),
 a AS (SELECT sum(s) AS s, sum(n) AS n FROM p),
 e AS (SELECT p.k, p.f, (a.s - g.s) / (a.n - g.n) AS o, (q.s - p.s) / (q.n - p.n) AS m,
 1 / (1 + exp(-(q.n - p.n - 1) / 10.0e0)) AS w FROM p JOIN q USING (k) JOIN g USING (f), a)
 SELECT o_orderkey, {r('o * (1 - w) + m * w', 3)} AS o_orderpriority, o_totalprice, fold
 FROM t JOIN e ON o_orderpriority = k AND fold = f""",
)
def target_encode_out_of_fold(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    folded = assign_folds(df, ["o_orderkey"], 3, 7)
    out = _apply(
        folded,
        {"type": "target_encode", "columns": ["o_orderpriority"],
         "target_column": "o_totalprice", "fold_column": "fold"},
    )
    return rounded(out, "o_orderpriority", digits=3)


@plan(
    "frequency_encode", "E10",
    f"""WITH {_BRANDS}, k AS (SELECT p_brand AS b, count(*) AS n FROM t WHERE p_brand IS NOT NULL
 GROUP BY 1) SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity, n AS p_brand
 FROM t LEFT JOIN k ON p_brand = b""",
)
def frequency_encode(spark, folder):
    return _apply(_brands(spark, folder), {"type": "frequency_encode", "columns": ["p_brand"]})


@plan(
    "groupby_aggregate", "E11",
    f"""SELECT o_orderkey, o_custkey, o_totalprice, {r('m', 6)} AS o_custkey_mean_o_totalprice,
 {r('s', 6)} AS o_custkey_std_o_totalprice, n AS n_orders, lo AS cheapest, hi AS dearest
 FROM orders JOIN (SELECT o_custkey, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s,
 count(o_totalprice) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders
 GROUP BY 1) USING (o_custkey)""",
)
def groupby_aggregate(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    base = {
        "type": "groupby_aggregate", "group_column": "o_custkey", "agg_column": "o_totalprice"
    }
    out = _apply(
        df, base, {**base, "agg_func": "std"},
        {**base, "agg_func": "count", "new_name": "n_orders"},
        {**base, "agg_func": "min", "new_name": "cheapest"},
        {**base, "agg_func": "max", "new_name": "dearest"},
    )
    return rounded(
        out, "o_custkey_mean_o_totalprice", "o_custkey_std_o_totalprice", digits=6
    )


def _quantile_bin(c, n):
    edges = [sql_quantile("li", c, k / n) for k in range(1, n)]
    first = sql_quantile("li", c, 0.0)
    last = sql_quantile("li", c, 1.0)
    # an edge equal to an outer edge opens no bin; repeated inner edges count once
    parts, seen = [], [first]
    for e in edges:
        earlier = " AND ".join(f"{e} - {s} > 1e-8" for s in seen)
        parts.append(
            f"(CASE WHEN {c} >= {e} AND {earlier} AND {last} - {e} > 1e-8 THEN 1 ELSE 0 END)"
        )
        seen.append(e)
    return f"CASE WHEN {c} IS NOT NULL THEN CAST({' + '.join(parts)} AS DOUBLE) END"


@plan(
    "bin_numeric_quantile", "E13",
    f"WITH {LI} SELECT l_orderkey, l_linenumber, {_quantile_bin('l_extendedprice', 5)} "
    f"AS l_extendedprice, {_quantile_bin('l_discount', 5)} AS l_discount FROM li",
)
def bin_numeric_quantile(spark, folder):
    df = lineitem_nulls(spark, folder).select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount"
    )
    return _apply(df, {"type": "bin_numeric", "columns": ["l_extendedprice", "l_discount"]})


@plan(
    "bin_numeric_uniform", "E13",
    f"WITH {LI} SELECT l_orderkey, l_linenumber, CAST("
    + " + ".join(
        f"(CASE WHEN l_extendedprice >= lo + {k} * ((hi - lo) / 4) THEN 1 ELSE 0 END)"
        for k in range(1, 4)
    )
    + " AS DOUBLE) AS l_extendedprice FROM li, (SELECT min(l_extendedprice) AS lo, "
    "max(l_extendedprice) AS hi FROM li)",
)
def bin_numeric_uniform(spark, folder):
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return _apply(
        df,
        {"type": "bin_numeric", "columns": ["l_extendedprice"], "n_bins": 4,
         "strategy": "uniform"},
    )


@plan("bin_numeric_kmeans", "E13")
def bin_numeric_kmeans(spark, folder):
    df = table(spark, folder, "events").select("event_id", "value")
    return _apply(
        df, {"type": "bin_numeric", "columns": ["value"], "n_bins": 4, "strategy": "kmeans"}
    )


@plan("feature_select_mutual_info", "E14")
def feature_select_mutual_info(spark, folder):
    df = lineitem_nulls(spark, folder).select(
        "l_quantity", "l_extendedprice", "l_tax", "l_linenumber", "l_returnflag"
    )
    return _apply(df, {"type": "feature_select", "target_column": "l_returnflag", "k": 2})


@plan(
    "feature_select_informative", "E14",
    """SELECT l_returnflag, l_linenumber + CASE l_returnflag WHEN 'A' THEN 100 WHEN 'N' THEN 200 ELSE 300 END
 AS sure, l_linenumber + CASE WHEN l_returnflag = 'A' THEN 5 ELSE 0 END AS vague FROM lineitem""",
)
def feature_select_informative(spark, folder):
    """Of a feature that tells the class, one that tells a part of it, and noise, two are kept."""
    flag = F.col("l_returnflag")
    df = table(spark, folder, "lineitem").select(
        "l_returnflag", "l_tax", "l_orderkey",
        (F.col("l_linenumber") + F.when(flag == "A", 100).when(flag == "N", 200).otherwise(300)).alias("sure"),
        (F.col("l_linenumber") + F.when(flag == "A", 5).otherwise(0)).alias("vague"))
    return _apply(df, {"type": "feature_select", "target_column": "l_returnflag", "k": 2})


@plan(
    "feature_select_variance", "E15",
    "SELECT l_quantity, l_extendedprice, l_linestatus, l_returnflag FROM lineitem "
    "WHERE (SELECT var_pop(l_tax) FROM lineitem) <= 1 AND "
    "(SELECT var_pop(l_quantity) FROM lineitem) > 1",
)
def feature_select_variance(spark, folder):
    df = table(spark, folder, "lineitem").select(
        "l_quantity", "l_tax", "l_extendedprice", "l_linestatus", "l_returnflag"
    )
    return _apply(
        df,
        {"type": "feature_select", "target_column": "l_returnflag",
         "method": "variance_threshold", "threshold": 1.0},
    )


def _average_rank(c):
    return (
        f"CASE WHEN {c} IS NOT NULL THEN rank() OVER (ORDER BY {c} NULLS LAST) + "
        f"(count(*) OVER (PARTITION BY {c}) - 1) / 2.0e0 END"
    )


@plan(
    "rank_transform", "E16 H1",
    f"WITH {LI} SELECT l_orderkey, l_linenumber, {_average_rank('l_extendedprice')} "
    f"AS l_extendedprice, {_average_rank('l_tax')} AS l_tax FROM li",
)
def rank_transform(spark, folder):
    df = lineitem_nulls(spark, folder).select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_tax"
    )
    return _apply(df, {"type": "rank_transform", "columns": ["l_extendedprice", "l_tax"]})


@plan("power_transform", "E17")
def power_transform(spark, folder):
    df = table(spark, folder, "events").select("event_id", "value")
    return _apply(df, {"type": "power_transform", "columns": ["value"]})


@plan(
    "power_transform_fixed", "E17",
    "WITH t AS (SELECT event_id, (sqrt(value + 1) - 1) / 0.5e0 AS y FROM events) "
    f"SELECT event_id, {r('(y - (SELECT avg(y) FROM t)) / (SELECT stddev_pop(y) FROM t)')} "
    "AS value FROM t",
)
def power_transform_fixed(spark, folder):
    df = table(spark, folder, "events").select("event_id", "value")
    out = _apply(
        df, {"type": "power_transform", "columns": ["value"], "lambdas": {"value": 0.5}}
    )
    return rounded(out, "value")


@plan(
    "categorical_interaction", "E20",
    f"""WITH t AS (SELECT p_partkey, p_brand, p_type, p_brand || '_' || p_type AS v FROM part),
 k AS {_codes('v', 't')} SELECT p_partkey, p_brand, p_type, code AS p_brand_x_p_type
 FROM t JOIN k USING (v)""",
)
def categorical_interaction(spark, folder):
    df = table(spark, folder, "part").select("p_partkey", "p_brand", "p_type")
    return _apply(df, {"type": "categorical_interaction", "columns": ["p_brand", "p_type"]})


@plan(
    "auto_preprocess", "E21",
    f"""WITH {LI}, t AS (SELECT l_quantity, l_discount, 1 AS fixed, CASE WHEN l_partkey % 5 <> 0
 THEN l_linestatus END AS l_linestatus, CAST(l_partkey AS VARCHAR) AS part_text, l_returnflag
 FROM li), k AS {_codes('part_text', 't')},
 m AS (SELECT l_linestatus AS top FROM t WHERE l_linestatus IS NOT NULL GROUP BY 1
 ORDER BY count(*) DESC, 1 LIMIT 1)
 SELECT l_quantity, coalesce(l_discount, {sql_quantile('t', 'l_discount', 0.5)}) AS l_discount,
 code AS part_text, l_returnflag, """
    + ", ".join(
        f"CAST(coalesce(l_linestatus, top) = '{v}' AS INTEGER) AS \"l_linestatus_{v}\""
        for v in ("F", "O")
    )
    + " FROM t JOIN k ON part_text = v, m",
)
def auto_preprocess_plan(spark, folder):
    df = lineitem_nulls(spark, folder).select(
        "l_quantity", "l_discount", F.lit(1).alias("fixed"),
        F.when(F.col("l_partkey") % 5 != 0, F.col("l_linestatus")).alias("l_linestatus"),
        F.col("l_partkey").cast("string").alias("part_text"), "l_returnflag",
    )
    return auto_preprocess(df, "l_returnflag")[0]


@plan(
    "operation_chain", "E22 A3",
    f"""WITH {LI}, t AS (SELECT l_orderkey, coalesce(l_tax, (SELECT avg(l_tax) FROM li)) AS l_tax,
 ln(1 + l_extendedprice) AS l_extendedprice, l_returnflag FROM li)
 SELECT l_orderkey, {r('l_tax', 6)} AS l_tax, {r('l_extendedprice')} AS l_extendedprice,
 {r('l_tax * l_extendedprice')} AS l_tax_x_l_extendedprice, """
    + ", ".join(
        f"CAST(l_returnflag = '{v}' AS INTEGER) AS \"l_returnflag_{v}\"" for v in ("A", "N", "R")
    )
    + " FROM t",
)
def operation_chain(spark, folder):
    df = lineitem_nulls(spark, folder).select(
        "l_orderkey", "l_tax", "l_extendedprice", "l_returnflag"
    )
    out = _apply(
        df,
        {"type": "impute_numeric", "columns": ["l_tax"]},
        {"type": "log_transform", "columns": ["l_extendedprice"]},
        {"type": "create_interaction", "column_a": "l_tax", "column_b": "l_extendedprice"},
        {"type": "one_hot_encode", "columns": ["l_returnflag"]},
    )
    out = rounded(out, "l_tax", digits=6)
    path = scratch(spark)
    write_table(rounded(out, "l_extendedprice", "l_tax_x_l_extendedprice"), f"{path}/out.parquet")
    return read_table(spark, f"{path}/out.parquet")
