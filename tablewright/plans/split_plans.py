"""Splits and folds."""

from pyspark.sql import functions as F

from tablewright.operators.splits import assign_folds, create_split, split_summary
from tablewright.plans.base import plan, r, rounded, scratch, table
from tablewright.sources.tables import read_split, write_split

KEYS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")


def _hash(key, seed=42):
    return f"CAST(('0x' || substr(md5({key} || ':{seed}'), 1, 13)) AS BIGINT)"


def _orders(spark, folder):
    return table(spark, folder, "orders").select(*KEYS)


def _label(condition):
    return f"CASE WHEN {condition} THEN 'validation' ELSE 'train' END"


COLUMNS = ", ".join(KEYS)


@plan(
    "split_random", "F1 F2 H4",
    f"SELECT {COLUMNS}, "
    + _label(f"row_number() OVER (ORDER BY {_hash('o_orderkey')}) <= ceil(0.2e0 * count(*) OVER ())")
    + " AS split FROM orders",
)
def split_random(spark, folder):
    return create_split(_orders(spark, folder), "o_orderstatus", ["o_orderkey"], "random")


@plan(
    "split_stratified", "F1 F3 H4",
    f"SELECT {COLUMNS}, "
    + _label(
        f"row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_hash('o_orderkey')}) <= "
        "round(0.2e0 * count(*) OVER (PARTITION BY o_orderstatus))"
    )
    + " AS split FROM orders",
)
def split_stratified(spark, folder):
    return create_split(_orders(spark, folder), "o_orderstatus", ["o_orderkey"], "auto")


@plan(
    "split_temporal", "F4 H2",
    f"SELECT {COLUMNS}, "
    + _label(
        "row_number() OVER (ORDER BY o_orderdate, o_orderkey) > "
        "CAST(floor(count(*) OVER () * (1 - 0.2e0)) AS BIGINT)"
    )
    + " AS split FROM orders",
)
def split_temporal(spark, folder):
    return create_split(
        _orders(spark, folder), "o_orderstatus", ["o_orderkey"], "temporal",
        temporal_column="o_orderdate",
    )


@plan(
    "split_group", "F5",
    f"""WITH g AS (SELECT o_custkey AS k, row_number() OVER (ORDER BY {_hash('o_custkey')}) <=
 ceil(0.3e0 * count(*) OVER ()) AS v FROM (SELECT DISTINCT o_custkey FROM orders))
 SELECT {COLUMNS}, {_label('v')} AS split FROM orders JOIN g ON o_custkey = k""",
)
def split_group(spark, folder):
    return create_split(
        _orders(spark, folder), "o_orderstatus", ["o_orderkey"], "group", 0.3,
        group_column="o_custkey",
    )


@plan(
    "split_summary", "F1 A4",
    f"""WITH s AS (SELECT {_label(f'''row_number() OVER (ORDER BY {_hash('o_orderkey')}) <=
 ceil(0.2e0 * count(*) OVER ())''')} AS split FROM orders)
 SELECT split, count(*) AS n_rows, {r('count(*) / (SELECT count(*) FROM s)')} AS share
 FROM s GROUP BY 1""",
)
def split_summary_plan(spark, folder):
    split = create_split(_orders(spark, folder), "o_orderstatus", ["o_orderkey"], "random")
    return rounded(split_summary(split), "share")


@plan(
    "folds_plain", "F6",
    f"SELECT o_orderkey, CAST((row_number() OVER (ORDER BY {_hash('o_orderkey')}) - 1) * 5 // "
    "count(*) OVER () AS INTEGER) AS fold FROM orders",
)
def folds_plain(spark, folder):
    return assign_folds(
        table(spark, folder, "orders").select("o_orderkey"), ["o_orderkey"], 5, 42
    )


@plan(
    "folds_stratified", "F6",
    f"SELECT o_orderkey, o_orderpriority, CAST((row_number() OVER (PARTITION BY o_orderpriority "
    f"ORDER BY {_hash('o_orderkey')}) - 1) * 5 // count(*) OVER (PARTITION BY o_orderpriority) "
    "AS INTEGER) AS fold FROM orders",
)
def folds_stratified(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return assign_folds(df, ["o_orderkey"], 5, 42, "o_orderpriority")


@plan(
    "split_partition_pruned", "A4",
    f"""WITH s AS (SELECT o_orderkey, {_label(f'''row_number() OVER (ORDER BY
 {_hash('o_orderkey')}) <= ceil(0.2e0 * count(*) OVER ())''')} AS split FROM orders)
 SELECT o_orderkey, split FROM s WHERE split = 'validation'""",
)
def split_partition_pruned(spark, folder):
    """The validation side, read back from the written table by its folder alone."""
    split = create_split(_orders(spark, folder), "o_orderstatus", ["o_orderkey"], "random")
    path = scratch(spark)
    write_split(split, path)
    return read_split(spark, path, "validation").select("o_orderkey", "split")
