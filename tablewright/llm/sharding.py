"""Jump consistent hashing with SQL expressions: stable shards without a ring table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.common import dense_numbers, spread

#: Fixed value: multiplier of the published generator, 2862933555777941757, as high * 2^32 + low
#: with a negative low half, so that no product of 32-bit halves leaves the range of a long.
HIGH, LOW = 0x27BB2EE7, 0x87B0B0FD - (1 << 32)
MASK = (1 << 32) - 1


def jump_state(key: Column, shards: int) -> Column:
    """Struct with the last jump below ``shards`` (`at`) and the first one beyond (`next`).

    The state of the 64-bit generator is kept in two 32-bit halves: wrapping multiplication is an
    error in ANSI mode. Each step jumps ahead at least one shard, so ``shards`` steps suffice.
    """
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(F.lit(MASK)).alias("low"),
        F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("next"))

    def product(s: Column) -> Column:
        low = s["low"] * F.lit(LOW) + 1
        high = (F.shiftright(low, 32) + s["high"] * F.lit(LOW) + s["low"] * F.lit(HIGH))
        return F.struct(high.bitwiseAND(F.lit(MASK)).alias("high"),
                        low.bitwiseAND(F.lit(MASK)).alias("low"), s["next"].alias("at"))

    def leap(s: Column) -> Column:
        span = F.lit(float(1 << 31)) / (F.shiftright(s["high"], 1) + 1).cast("double")
        to = F.floor((s["at"] + 1).cast("double") * span).cast("long")
        return F.struct(s["high"], s["low"], s["at"], to.alias("next"))

    def step(s: Column, _: Column) -> Column:
        moved = F.element_at(F.transform(F.array(product(s)), leap), 1)
        return F.when(s["next"] < shards, moved).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step)


def stable_key(df: DataFrame, column: str) -> Column:
    """A 64-bit key: integers as they are, other values hashed; null is key 0."""
    kind = df.schema[column].dataType
    value = F.col(f"`{column}`")
    if not isinstance(kind, T.IntegralType):
        value = F.when(value.isNotNull(), F.xxhash64(value))
    return F.coalesce(value.cast("long"), F.lit(0).cast("long"))


def shard(
    df: DataFrame, shards: int, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Shard and place of every row; the id and the number of shards decide alone.

    Returns id, size (UTF-8 bytes of the text plus 8; null text 8), text_crc32 (null text 0), law
    `key`, shard, slot (from 0 without gaps in each shard, by id; equal ids in input order) and
    grown_shard, the shard with one more: it differs only for rows that move into the new one.
    Null ids share key 0 and come first. Repeated rows share a shard and have slots of their own.
    Other columns are not read; an empty table gives no rows.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    rows = df.select(
        F.col(f"`{id_column}`").alias("_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        jump_state(stable_key(df, id_column), shards).alias("_jump"),
    ).select(
        "_id", "size", "text_crc32", F.lit("key").alias("law"),
        F.col("_jump.at").cast("int").alias("shard"),
        F.when(F.col("_jump.next") == shards, shards).otherwise(F.col("_jump.at")).cast("int")
        .alias("grown_shard"),
    )
    numbered = dense_numbers(spread(rows, ["_id"]), ["shard"], ["_id"], "slot")
    return numbered.select(
        F.col("_id").alias(id_column), "size", "text_crc32", "law", "shard",
        F.col("slot").cast("long").alias("slot"), "grown_shard")
