"""Registry of queries and the derived inputs they share with their SQL counterparts."""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.core import ensure_checkpoint_dir, normalise_missing


@dataclass(frozen=True)
class Plan:
    name: str
    covers: tuple[str, ...]
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Plan] = {}


def plan(name: str, covers: str, sql: str | None = None):
    """Register ``(spark, folder) -> DataFrame`` under a name, with the operators it covers."""

    def register(run: Callable[[SparkSession, str], DataFrame]):
        def guarded(spark: SparkSession, folder: str) -> DataFrame:
            if not os.environ.get("PYSPARK_PYTHON") and spark.sparkContext.master.startswith(
                "local"
            ):
                spark.sparkContext.pythonExec = sys.executable
            return run(spark, folder)

        REGISTRY[name] = Plan(name, tuple(covers.split()), guarded, sql)
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return normalise_missing(spark.read.parquet(f"{folder}/{name}.parquet"))


def scratch(spark: SparkSession) -> str:
    """A new folder for a written table, where every executor can reach it."""
    return f"{ensure_checkpoint_dir(spark)}/tablewright-{uuid.uuid4().hex}"


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    """Round columns, turning a negative zero into zero."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


def r(expression: str, digits: int = 4) -> str:
    """The same rounding in SQL."""
    return f"(round({expression}, {digits}) + 0.0e0)"


def sql_number(x: float) -> str:
    return f"{x!r}e0" if "e" not in repr(x) else repr(x)


def sql_quantile(source: str, column: str, p: float) -> str:
    """Linearly interpolated quantile as a scalar subquery."""
    at = f"({sql_number(p)} * (len(a) - 1))"
    low = f"a[CAST(floor({at}) AS BIGINT) + 1]"
    high = f"a[least(CAST(floor({at}) AS BIGINT) + 2, len(a))]"
    return (
        f"(SELECT {low} + ({high} - {low}) * ({at} - floor({at})) FROM (SELECT "
        f"list_sort(list(CAST({column} AS DOUBLE))) AS a FROM {source} "
        f"WHERE {column} IS NOT NULL))"
    )


# lineitem with missing values in two columns
LI = """li AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
 l_extendedprice, CASE WHEN l_partkey % 7 <> 0 THEN l_discount END AS l_discount,
 CASE WHEN l_quantity <= 45 THEN l_tax END AS l_tax, l_returnflag, l_linestatus, l_shipdate
 FROM lineitem)"""
LI_NUMERIC = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax",
)


def lineitem_nulls(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").withColumns(
        {
            "l_discount": F.when(F.col("l_partkey") % 7 != 0, F.col("l_discount")),
            "l_tax": F.when(F.col("l_quantity") <= 45, F.col("l_tax")),
        }
    )


# binary pseudo-predictions
BINARY_PREDICTIONS = """pred AS (SELECT event_id, user_id, value, event_type,
 (event_id * 7919 % 1000) / 1000.0e0 AS score,
 CASE WHEN event_id * 7919 % 1000 >= 500 THEN 1 ELSE 0 END AS prediction,
 CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label FROM events)"""


def binary_predictions(spark: SparkSession, folder: str) -> DataFrame:
    bucket = F.pmod(F.col("event_id") * 7919, F.lit(1000))
    score = bucket / F.lit(1000.0)
    return table(spark, folder, "events").select(
        "event_id", "user_id", "value", "event_type",
        score.alias("score"),
        F.when(bucket >= 500, 1).otherwise(0).alias("prediction"),
        F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("label"),
        F.array(1 - score, score).alias("probability"),
    )


CLASSES = ("click", "error", "purchase", "signup", "view")


# five-class pseudo-predictions with scores that depend on the id
def _class_score_sql(i: int) -> str:
    return f"(event_id * {7919 + 2 * i} % 997 + 1) / 1000.0e0"


CLASS_PREDICTIONS = (
    "mc AS (SELECT event_id, user_id, value, event_type AS label, CASE "
    + " ".join(
        f"WHEN event_id * 31 % 7 = {i} THEN '{c}'" for i, c in enumerate(CLASSES)
    )
    + " ELSE event_type END AS prediction, "
    + ", ".join(f"{_class_score_sql(i)} AS p{i}" for i in range(len(CLASSES)))
    + " FROM events)"
)


def class_predictions(spark: SparkSession, folder: str) -> DataFrame:
    chosen = F.pmod(F.col("event_id") * 31, F.lit(7))
    prediction = None
    for i, c in enumerate(CLASSES):
        prediction = (
            F.when(chosen == i, c) if prediction is None else prediction.when(chosen == i, c)
        )
    scores = [
        (F.pmod(F.col("event_id") * (7919 + 2 * i), F.lit(997)) + 1) / F.lit(1000.0)
        for i in range(len(CLASSES))
    ]
    return table(spark, folder, "events").select(
        "event_id", "user_id", "value",
        F.col("event_type").alias("label"),
        prediction.otherwise(F.col("event_type")).alias("prediction"),
        F.array(*scores).alias("probability"),
    )


REGRESSION_PREDICTIONS = """reg AS (SELECT event_id, user_id, event_type, value AS label,
 value * 0.9e0 + (event_id * 7919 % 100) / 10.0e0 + user_id / 50.0e0 AS prediction
 FROM events)"""


def regression_predictions(spark: SparkSession, folder: str) -> DataFrame:
    noise = F.pmod(F.col("event_id") * 7919, F.lit(100)) / F.lit(10.0)
    return table(spark, folder, "events").select(
        "event_id", "user_id", "event_type",
        F.col("value").alias("label"),
        (F.col("value") * 0.9 + noise + F.col("user_id") / F.lit(50.0)).alias("prediction"),
    )


RUNS = """runs AS (SELECT user_id AS workspace, event_id AS run_id, value AS score,
 ts AS created_at, event_type AS model_type FROM events)"""


def pseudo_runs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("user_id").alias("workspace"), F.col("event_id").alias("run_id"),
        F.col("value").alias("score"), F.col("ts").alias("created_at"),
        F.col("event_type").alias("model_type"),
    )
