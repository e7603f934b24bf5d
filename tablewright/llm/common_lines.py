"""Lines that many documents share are dropped everywhere but in the first of them."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.core import cut_lineage, fits_broadcast
from tablewright.operators.lookup import HOT_SHARE, Lookup, attach, build_lookup

#: White space stripped from both ends of a line before it is compared.
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """What is compared: the line without outer white space, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), string.ascii_uppercase, string.ascii_lowercase)


def _fingerprint(*values: Column) -> list[Column]:
    """Two 64-bit hashes with different seeds; together they take the place of the values."""
    return [F.xxhash64(*values), F.xxhash64(F.lit(7), *values)]


def _marks(hits: DataFrame) -> Lookup:
    """Positions to drop of each row that has any, measured with their arrays."""
    table = cut_lineage(hits.groupBy("_row1", "_row2").agg(
        F.collect_set("_at").alias("_drops"), F.count(F.lit(1)).alias("_weight")))
    rows, places, weight = table.agg(
        F.count(F.lit(1)), F.sum(F.size("_drops")), F.sum("_weight")).first()
    small = fits_broadcast(rows, 48 * rows + 4 * (places or 0))
    hot = []
    if not small:  # at most HOT_SHARE keys, those of rows repeated very often
        hot = [tuple(r) for r in table.where(F.col("_weight") * HOT_SHARE >= weight)
               .select("_row1", "_row2").collect()]
    return Lookup(table.drop("_weight"), ["_row1", "_row2"], rows, small, hot)


def drop_common_lines(
    df: DataFrame,
    least_documents: int = 2,
    least_chars: int = 10,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep: list[str] | None = None,
    prefix: str = "",
) -> DataFrame:
    """Drop lines whose key ``least_documents`` documents or more hold, but not in the smallest id.

    Texts are split at line feeds; a key is a line without outer white space and with A-Z in lower
    case. Keys of fewer than ``least_chars`` code points stay. One row per input row: the columns
    in ``keep`` (default: the id) and, named with ``prefix``, n_lines, n_dropped and kept, the
    other lines joined again. A null or empty text is one empty line; kept is then empty. Rows of
    equal id are one document, so equal lines in them do not count twice. Null ids are one
    document too, later than any other. Any number and length of lines is allowed; a task holds
    one text and its lines at a time. An empty table gives no rows. No other column is read, and
    their names do not matter.

    Each task counts its own (line, document) pairs before they are shuffled by both, and the
    counts of a line are added up before they meet; a line that every document holds costs one
    row a task. Only hashes, ids and positions are shuffled. Common lines are joined back by
    broadcast if they are measured to be few, otherwise with the frequent ones spread.
    """
    keep = [id_column] if keep is None else list(keep)
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    row1, row2 = _fingerprint(F.col(f"`{id_column}`"), text)
    lines = df.select(
        F.col(f"`{id_column}`").alias("_id"), row1.alias("_row1"), row2.alias("_row2"),
        F.posexplode(F.split(text, "\n", -1)).alias("_at", "_line"),
    ).select("*", line_key(F.col("_line")).alias("_key")).where(F.length("_key") >= least_chars)
    key1, key2 = _fingerprint(F.col("_key"))
    lines = lines.select("_id", "_row1", "_row2", "_at", key1.alias("_hash1"), key2.alias("_hash2"))

    held = lines.groupBy("_hash1", "_hash2", "_id").agg(F.count(F.lit(1)).alias("_n"))
    common = held.groupBy("_hash1", "_hash2").agg(
        F.count(F.lit(1)).alias("_documents"), F.sum("_n").alias("_weight"),
        F.min("_id").alias("_owner"),
    ).where(F.col("_documents") >= least_documents).drop("_documents")
    lookup = build_lookup(common, ["_hash1", "_hash2"], weight="_weight")
    hits = attach(lines, lookup, ["_hash1", "_hash2"]).where(
        F.col("_weight").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_owner")))

    texts = df.select(
        *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(keep)],
        row1.alias("_row1"), row2.alias("_row2"), F.split(text, "\n", -1).alias("_lines"))
    marked = attach(texts, _marks(hits), ["_row1", "_row2"])
    places = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drops"))
    left = F.when(F.col("_drops").isNull(), F.col("_lines")).otherwise(
        F.transform(places, lambda i: F.get(F.col("_lines"), i)))
    return marked.select(
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(keep)],
        F.size("_lines").cast("long").alias(f"{prefix}n_lines"),
        F.coalesce(F.size("_drops"), F.lit(0)).cast("long").alias(f"{prefix}n_dropped"),
        F.array_join(left, "\n").alias(f"{prefix}kept"))
