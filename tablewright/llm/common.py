"""Shared pieces of the training-data operators: row-wise Arrow maps, staging, dense numbering."""

from __future__ import annotations

import ctypes
import gc
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tablewright.core import cut_lineage

#: Text bytes that a Python helper handles at once; bounds the memory of a worker.
SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch that are unpacked together.
BATCH_BYTES = 4 << 20


def release() -> None:
    """Give memory that is no longer used back to the system; workers live on through many stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def free_disk(spark: SparkSession, waits: tuple[int, ...] = (0, 1, 3)) -> None:
    """Have Spark's cleaner remove shuffles and checkpoints that nothing refers to any more.

    It learns of them when the driver collects its garbage, which may be long after. The events of
    a job that just ended still hold its plan for some seconds, so further collections follow.
    """
    gc.collect()
    for wait in waits:
        time.sleep(wait)
        spark.sparkContext._jvm.System.gc()


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def text_strings(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Texts of a string column; null is empty, malformed bytes become U+FFFD."""
    return [x.decode("utf-8", "replace") for x in text_bytes(column)]


def slices(sizes: list[int], most: int = SLICE_BYTES) -> Iterator[slice]:
    """Cut a batch into runs of about ``most`` bytes; a longer text is a run of its own."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def map_rows(
    df: DataFrame,
    inputs: list[str],
    outputs: T.StructType,
    compute: Callable[[list[pa.Array]], list],
    keep: list[str] | None = None,
) -> DataFrame:
    """Append ``outputs`` computed from the ``inputs`` of each Arrow batch.

    Columns in ``keep`` pass through; names may repeat in neither. ``compute`` gets the input
    columns of one batch and returns one sequence per output.
    """
    keep = list(keep or [])
    names = [f"_in{i}" for i in range(len(inputs))]
    source = df.select(*[F.col(f"`{c}`") for c in keep],
                       *[F.col(f"`{c}`").alias(n) for c, n in zip(inputs, names)])
    schema = T.StructType([df.schema[c] for c in keep] + list(outputs.fields))
    types = [f.type for f in to_arrow_schema(outputs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, whole.num_rows * BATCH_BYTES // max(whole.nbytes, 1))
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                found = compute([batch.column(len(keep) + i) for i in range(len(names))])
                arrays = [batch.column(i) for i in range(len(keep))]
                arrays += [x if isinstance(x, pa.Array) else pa.array(x, type=t)
                           for x, t in zip(found, types)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
        release()

    return source.mapInArrow(run, schema)


def spread(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows range-partitioned by ``order``, with `_part` and `_pos` written down once.

    The position in the input breaks ties, so equal keys spread over partitions. The rows are
    checkpointed in the shared folder: a lost executor cannot renumber them.
    """
    placed = df.withColumn("_pos", F.monotonically_increasing_id())
    placed = placed.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order], F.col("_pos"))
    return cut_lineage(placed.withColumn("_part", F.spark_partition_id()))


def dense_numbers(staged: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """Number the rows of each group from 0 without gaps, never gathering a group in one task.

    Needs the `_part` and `_pos` of :func:`spread`: rows are numbered within (group, part) and
    shifted by the rows that earlier parts hold.
    """
    cell = [*groups, "_part"]
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    shifts = staged.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")).select(
        *cell, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    within = Window.partitionBy(*cell).orderBy(
        *[F.col(c).asc_nulls_first() for c in order], "_pos")
    return (
        staged.withColumn("_rank", F.row_number().over(within))
        .join(shifts, cell)
        .withColumn(name, F.col("_shift") + F.col("_rank") - 1)
        .drop("_shift", "_rank", "_part", "_pos")
    )
