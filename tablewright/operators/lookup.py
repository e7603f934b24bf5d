"""Statistics tables joined back to rows: broadcast when measured small, salted when not."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.core import col, cut_lineage, fits_broadcast, measured_size

HOT_SHARE = 200
SALTS = 64


@dataclass
class Lookup:
    """A materialised table with unique keys, its measured size and its most frequent keys."""

    table: DataFrame
    keys: list[str]
    rows: int
    small: bool
    hot: list[tuple]


def build_lookup(
    table: DataFrame, keys: Sequence[str], weight: str | None = None, force_shuffle: bool = False
) -> Lookup:
    """Materialise a key table once, measure it and note the keys that hold many rows.

    ``weight`` names the column with the number of rows per key. Keys above 1/HOT_SHARE of all
    rows are at most HOT_SHARE many, so listing them is bounded.
    """
    keys = list(keys)
    fixed = cut_lineage(table)
    rows, size = measured_size(fixed)
    small = fits_broadcast(rows, size) and not force_shuffle
    hot: list[tuple] = []
    if weight and not small:
        total = fixed.agg(F.sum(weight)).first()[0] or 0
        found = (
            fixed.where(F.col(weight) * HOT_SHARE >= F.lit(total))
            .select(*[col(k) for k in keys])
            .collect()
        )
        hot = [tuple(r) for r in found]
    return Lookup(fixed, keys, rows, small, hot)


def _salt(df: DataFrame):
    usable = [
        col(f.name)
        for f in df.schema.fields
        if not isinstance(f.dataType, (T.MapType, T.VariantType))
    ]
    # the input partition parts equal rows; it stays the same when a task is run again
    return F.pmod(F.xxhash64(F.spark_partition_id(), *usable), F.lit(SALTS)).cast("int")


def _is_hot(columns: list[Column], hot: list[tuple]) -> Column:
    if not hot:
        return F.lit(False)
    if len(columns) == 1:
        return F.coalesce(columns[0].isin([k[0] for k in hot]), F.lit(False))
    found = F.lit(False)
    for key in hot:
        same = F.lit(True)
        for c, v in zip(columns, key):
            same = same & c.eqNullSafe(F.lit(v))
        found = found | same
    return found


def attach(df: DataFrame, lookup: Lookup, on: Sequence[str]) -> DataFrame:
    """Left join: every row of ``df`` is kept and gains the non-key columns of the table.

    Small tables are broadcast. Otherwise both sides are shuffled by key; frequent keys and rows
    without a key are spread over SALTS sub-keys, for which the table rows are repeated.
    """
    renamed = lookup.table
    match_names = [f"_key{i}" for i in range(len(on))]
    for k, m in zip(lookup.keys, match_names):
        renamed = renamed.withColumnRenamed(k, m)
    condition = [col(c) == F.col(m) for c, m in zip(on, match_names)]
    if lookup.small:
        joined = df
        matched = joined.join(F.broadcast(renamed), condition, "left")
        return matched.drop(*match_names)

    spread = F.lit(False)
    for c in on:
        spread = spread | col(c).isNull()
    is_hot = _is_hot([F.col(m) for m in match_names], lookup.hot)
    row_hot = _is_hot([col(c) for c in on], lookup.hot)
    left = df.withColumn("_salt", F.when(spread | row_hot, _salt(df)).otherwise(0))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = renamed.withColumn("_tsalt", F.explode(copies))
    condition.append(F.col("_salt") == F.col("_tsalt"))
    return left.join(right, condition, "left").drop("_salt", "_tsalt", *match_names)
