"""Scoring of a stream with a fitted model; prediction keeps no state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tablewright.operators.training import predict


def start_scoring(
    stream: DataFrame, model: Model, features: Sequence[str], classes: Sequence, path: str,
    checkpoint: str, **trigger,
) -> StreamingQuery:
    """Append predictions to Parquet; the checkpoint makes the sink exactly-once."""
    return (
        predict(model, stream, features, classes)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
