"""Write fitted objects to a shared folder and read them in another session.

Feature chains, nearest neighbours and ensembles hold plain values, tables and Spark's own models.
Tables are written as Parquet, Spark models by their own writers, and the rest as one small pickled
record that refers to them. As with any pickled state, load only what you trust.
"""

from __future__ import annotations

import io
import pickle
from typing import Any

from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.ml.util import JavaMLWritable
from pyspark.sql import DataFrame, SparkSession


class _Writer(cloudpickle.Pickler):
    """Pickles an object; tables and Spark models become references to what was written."""

    def __init__(self, file: io.BytesIO, path: str):
        super().__init__(file)
        self.path = path
        self.known: dict[int, tuple[str, int]] = {}
        self.held: list[Any] = []  # keeps ids from being used again

    def persistent_id(self, obj: Any):
        if isinstance(obj, SparkSession):
            return ("session", 0)
        table = isinstance(obj, DataFrame)
        if not table and (isinstance(obj, PipelineModel) or not isinstance(obj, JavaMLWritable)):
            return None
        if id(obj) not in self.known:
            n = len(self.held)
            self.held.append(obj)
            if table:
                obj.write.mode("overwrite").parquet(f"{self.path}/tables/{n}")
            else:
                PipelineModel(stages=[obj]).write().overwrite().save(f"{self.path}/models/{n}")
            self.known[id(obj)] = ("table" if table else "model", n)
        return self.known[id(obj)]


class _Reader(pickle.Unpickler):
    def __init__(self, file: io.BytesIO, path: str, spark: SparkSession):
        super().__init__(file)
        self.path, self.spark, self.found = path, spark, {}

    def persistent_load(self, reference: tuple[str, int]) -> Any:
        if reference not in self.found:
            kind, n = reference
            if kind == "session":
                self.found[reference] = self.spark
            elif kind == "table":
                self.found[reference] = self.spark.read.parquet(f"{self.path}/tables/{n}")
            else:
                self.found[reference] = PipelineModel.load(f"{self.path}/models/{n}").stages[0]
        return self.found[reference]


def save_fitted(fitted: Any, path: str, spark: SparkSession | None = None) -> None:
    """Write a fitted feature chain, model or ensemble below ``path``, replacing what is there."""
    spark = spark or SparkSession.getActiveSession()
    file = io.BytesIO()
    stages = fitted.stages if isinstance(fitted, PipelineModel) else None
    _Writer(file, path).dump(fitted if stages is None else ("chain", stages))
    row = spark.createDataFrame([(bytearray(file.getvalue()),)], "state binary")
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/state")


def load_fitted(path: str, spark: SparkSession | None = None) -> Any:
    """Read what :func:`save_fitted` wrote; tables are read lazily from ``path``."""
    spark = spark or SparkSession.getActiveSession()
    state = spark.read.parquet(f"{path}/state").first()["state"]
    found = _Reader(io.BytesIO(bytes(state)), path, spark).load()
    if isinstance(found, tuple) and len(found) == 2 and found[0] == "chain":
        return PipelineModel(stages=found[1])
    return found
