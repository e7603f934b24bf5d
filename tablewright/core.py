"""Data model shared by all operators: schema roles, tasks, missing values, lineage cuts."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

BINARY = "binary_classification"
MULTICLASS = "multiclass_classification"
REGRESSION = "regression"

# A side of a join is broadcast only after it was measured to be within both bounds.
BROADCAST_MAX_ROWS = 500_000
BROADCAST_MAX_BYTES = 64 << 20

_NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)


@dataclass(frozen=True)
class TaskSpec:
    """Target column together with the learning task."""

    target: str
    task: str

    @property
    def is_classification(self) -> bool:
        return self.task != REGRESSION


def col(name: str) -> Column:
    """Column reference that tolerates dots and spaces in the name."""
    return F.col("`" + name.replace("`", "``") + "`")


def require_columns(df: DataFrame, columns: Iterable[str], context: str = "") -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        prefix = f"{context}: " if context else ""
        raise ValueError(
            f"{prefix}columns not found: {missing}. Available columns: {', '.join(df.columns)}"
        )


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]


def categorical_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Everything that is neither numeric nor nested (booleans and dates count as categorical)."""
    return [
        f.name
        for f in df.schema.fields
        if not isinstance(f.dataType, (T.NumericType, *_NESTED)) and f.name not in exclude
    ]


def normalise_missing(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL once, so later code only has to test for NULL."""
    floats = {
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))
    }
    if not floats:
        return df
    return df.select(
        *[
            F.when(~F.isnan(col(c)), col(c)).alias(c) if c in floats else col(c)
            for c in df.columns
        ]
    )


def as_double(name: str) -> Column:
    return col(name).cast("double")


def small_cardinality(df: DataFrame, column: str, limit: int) -> int | None:
    """Exact distinct count when it is at most ``limit``, else None.

    A sketch decides first, so a high-cardinality column never shuffles its distinct values just
    to learn that there are many of them.
    """
    estimate = df.agg(F.approx_count_distinct(col(column)).alias("n")).first()["n"]
    if estimate > 5 * limit + 50:
        return None
    exact = df.agg(F.count_distinct(col(column)).alias("n")).first()["n"]
    return exact if exact <= limit else None


def resolve_task(df: DataFrame, target: str, task: str = "auto") -> TaskSpec:
    """Infer the task: many-valued numeric is regression, two values binary, else multiclass."""
    require_columns(df, [target])
    if task == "classification":
        task = "auto-class"
    elif task != "auto":
        if task not in (BINARY, MULTICLASS, REGRESSION):
            raise ValueError(f"Unknown task type '{task}'")
        return TaskSpec(target, task)
    distinct = small_cardinality(df, target, 20)
    numeric = target in numeric_columns(df)
    if task == "auto" and numeric and distinct is None:
        return TaskSpec(target, REGRESSION)
    return TaskSpec(target, BINARY if distinct == 2 else MULTICLASS)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared checkpoint folder; only a local session may make its own."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="tablewright-checkpoint-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so executor loss cannot change it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def measured_size(df: DataFrame) -> tuple[int, int]:
    """Row count and a byte estimate (text by its real length) in one aggregate."""
    width: Column = F.lit(16)
    for field in df.schema.fields:
        if isinstance(field.dataType, T.StringType):
            width = width + F.coalesce(F.octet_length(col(field.name)), F.lit(0)) + 16
        else:
            width = width + 16
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(width.cast("long")).alias("b")).first()
    return row["n"], row["b"] or 0


def fits_broadcast(rows: int, size: int) -> bool:
    return rows <= BROADCAST_MAX_ROWS and size <= BROADCAST_MAX_BYTES


def rows_of(df: DataFrame, structs: list[Column]) -> DataFrame:
    """Turn the single row of ``df`` into one output row per struct."""
    return df.select(F.inline(F.array(*structs)))


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Small driver-side result (one entry per column, class or bin) as a DataFrame."""
    struct = T._parse_datatype_string(schema)
    columns = list(zip(*rows)) if rows else [[] for _ in struct.names]
    arrow = to_arrow_schema(struct)
    table = pa.table(
        [pa.array(values, type=f.type) for values, f in zip(columns, arrow)], schema=arrow
    )
    return spark.createDataFrame(table, struct)
