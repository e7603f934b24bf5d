"""Append-only run log in JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_SCHEMA = (
    "run_id string, workspace string, model_type string, hyperparameters string, metric string, "
    "score double, created_at timestamp"
)


def append_runs(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").json(path)


def read_runs(spark: SparkSession, path: str, schema: str = RUN_SCHEMA) -> DataFrame:
    """All readable records; malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def parse_lines(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """Records from a text column, ignoring lines that are not valid JSON objects."""
    parsed = F.from_json(F.trim(F.col(column)), schema, {"mode": "PERMISSIVE"})
    valid = F.get_json_object(F.trim(F.col(column)), "$").isNotNull()
    return lines.where(valid).select(parsed.alias("r")).select("r.*")
