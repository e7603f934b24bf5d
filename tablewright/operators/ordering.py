"""Global order at scale: prefix sums over values, row indexes and lags without a global window."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.core import (
    BROADCAST_MAX_BYTES,
    as_double,
    cut_lineage,
    fits_broadcast,
    local_rows,
)
from tablewright.operators.lookup import HOT_SHARE, Lookup, attach

ROWS_PER_BUCKET = 1_000_000
#: Ranges of the first cut of a column, ranges of each of them in the second cut, edges of a group
#: of those, and ranges whose offsets are added up together.
COARSE, FINE, EDGE_GROUP, BLOCK = 256, 1_024, 32, 1_024
_MASK = (1 << 33) - 1


@dataclass
class PrefixTable:
    """One row per distinct value, with per-value sums and the sums over all smaller values."""

    table: DataFrame
    totals: dict[str, float]

    @property
    def n(self) -> int:
        return int(self.totals["n"])


def _first_cuts(wide: DataFrame, k: int, rows_per_bucket: int) -> tuple[list[int], list[list[float]]]:
    """Values per column (or a bound), and borders of at most COARSE ranges of about that many rows."""
    rows = wide.count()
    if rows <= rows_per_bucket:
        return [rows] * k, [[] for _ in range(k)]
    probes = [i / COARSE for i in range(1, COARSE)]
    parts = []
    for i in range(k):
        parts += [F.count(f"v{i}").alias(f"n{i}"),
                  F.percentile_approx(f"v{i}", probes, 8 * COARSE).alias(f"q{i}")]
    head = wide.agg(*parts).first()
    counts, edges = [], []
    for i in range(k):
        n, cuts = head[f"n{i}"], list(head[f"q{i}"] or [])
        buckets = min(max(math.ceil(n / rows_per_bucket), 1), COARSE)
        step = max(len(cuts) // buckets, 1)
        chosen = [] if buckets == 1 else cuts[step - 1 :: step]
        counts.append(n)
        edges.append(sorted({e for e in chosen if math.isfinite(e)}))
    return counts, edges


def _fine_ranges(rows: DataFrame, parts: int) -> DataFrame:
    """Cut every coarse range (c, coarse) into up to ``parts`` by a sketch of its own.

    The borders of all ranges are a table of at most COARSE rows per column, joined by range; a
    value finds its place in two steps, among every EDGE_GROUP-th border and then within a group.
    """
    probes = [i / parts for i in range(1, parts)]
    edges = F.array_sort(F.array_distinct(F.percentile_approx("value", probes, 4 * parts)))
    borders = rows.groupBy("c", "coarse").agg(edges.alias("_edges"))
    every = F.expr(f"transform(sequence(0, size(_edges) div {EDGE_GROUP}), "
                   f"i -> get(_edges, cast((i + 1) * {EDGE_GROUP} - 1 as int)))")
    borders = borders.withColumn("_tops", F.filter(every, lambda e: e.isNotNull()))
    groups = rows.select("c", "coarse").distinct().count()
    if 8 * groups * parts <= BROADCAST_MAX_BYTES:
        borders = F.broadcast(borders)
    placed = rows.join(borders, ["c", "coarse"])
    value = F.col("value")
    placed = placed.withColumn("_top", F.size(F.filter("_tops", lambda e: e <= value)))
    own = F.slice("_edges", F.col("_top") * EDGE_GROUP + 1, F.lit(EDGE_GROUP))
    fine = F.col("_top") * EDGE_GROUP + F.size(F.filter(own, lambda e: e <= value))
    return placed.withColumn("bucket", F.col("coarse") * FINE + fine).drop(
        "_edges", "_tops", "_top", "coarse")


def _offsets(totals: DataFrame, sums: Sequence[str]) -> DataFrame:
    """(c, bucket, start_m ...): sums over all smaller buckets of a column, in two levels.

    Buckets are added up within blocks of BLOCK, and blocks within a column: a table of any number
    of ranges, and no list of them on the driver.
    """
    block = F.floor(F.col("bucket") / BLOCK)
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(
        Window.unboundedPreceding, -1)
    blocks = totals.groupBy("c", block.alias("block")).agg(*[F.sum(m).alias(m) for m in sums])
    blocks = blocks.select("c", "block", *[
        F.coalesce(F.sum(m).over(before("c").orderBy("block")), F.lit(0)).alias(f"_past_{m}")
        for m in sums])
    inner = totals.withColumn("block", block).select("c", "block", "bucket", *[
        F.coalesce(F.sum(m).over(before("c", "block").orderBy("bucket")), F.lit(0)).alias(f"_own_{m}")
        for m in sums])
    return inner.join(blocks, ["c", "block"]).select(
        "c", "bucket", *[(F.col(f"_past_{m}") + F.col(f"_own_{m}")).alias(f"start_{m}") for m in sums])


def column_prefixes(
    df: DataFrame,
    columns: Sequence[Column],
    measures: dict[str, Column] | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    dense: bool = False,
) -> DataFrame:
    """``c, value, n, before_n`` and ``m, before_m`` for every measure m, for several columns at once.

    ``c`` is the place of a column in ``columns``; NULLs are left out. ``dense`` adds
    ``distinct_before``, the 0-based dense rank.

    The rows of all columns are reduced to distinct values in one job (map-side combine, so a
    heavy value is one row) and cut into value ranges at sketch quantiles, in two levels where a
    column is long. Running sums inside a range are windows partitioned by column and range.
    """
    measures = dict(measures or {})
    k = len(columns)
    wide = df.select(
        *[v.cast("double").alias(f"v{i}") for i, v in enumerate(columns)],
        *[m.alias(f"_m{j}") for j, m in enumerate(measures.values())],
    )
    counts, edges = _first_cuts(wide, k, rows_per_bucket)
    cut = [i for i in range(k) if edges[i]]
    if cut:
        wide = Bucketizer(
            splitsArray=[[-math.inf, *edges[i], math.inf] for i in cut],
            inputCols=[f"v{i}" for i in cut], outputCols=[f"_b{i}" for i in cut],
            handleInvalid="keep",
        ).transform(wide)
    rows = wide.select(*[f"_m{j}" for j in range(len(measures))], F.inline(F.array(*[
        F.struct(
            F.lit(i).alias("c"),
            (F.col(f"_b{i}") if i in cut else F.lit(0)).cast("long").alias("coarse"),
            F.col(f"v{i}").alias("value"),
        )
        for i in range(k)
    ]))).where(F.col("value").isNotNull())
    parts = min(FINE, max(math.ceil(n / (COARSE * rows_per_bucket)) for n in counts))
    if parts > 1:
        rows = _fine_ranges(rows, parts)
    else:
        rows = rows.withColumnRenamed("coarse", "bucket")

    names = ["n", *measures]
    sums = [F.count(F.lit(1)).alias("n")] + [
        F.sum(f"_m{j}").alias(m) for j, m in enumerate(measures)]
    here = rows.groupBy("c", "bucket", "value").agg(*sums)
    if dense:
        here = here.withColumn("distinct", F.lit(1).cast("long"))
    tracked = [*names, *(["distinct"] if dense else [])]
    w = Window.partitionBy("c", "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    inside = {m: F.coalesce(F.sum(m).over(w), F.lit(0)) for m in tracked}
    out = here.select("c", "bucket", "value", *names, *[
        e.alias(f"before_{m}") for m, e in inside.items()])
    if cut:
        totals = here.groupBy("c", "bucket").agg(*[F.sum(m).alias(m) for m in tracked])
        out = out.join(_offsets(totals, tracked), ["c", "bucket"]).select(
            "c", "value", *names,
            *[(F.col(f"before_{m}") + F.col(f"start_{m}")).alias(f"before_{m}") for m in tracked])
    out = out.select("c", "value", *names, *[f"before_{m}" for m in tracked])
    return out.withColumnRenamed("before_distinct", "distinct_before") if dense else out


def value_prefix(
    df: DataFrame,
    value: Column,
    measures: dict[str, Column] | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    dense: bool = False,
) -> PrefixTable:
    """:func:`column_prefixes` of one column, with the sums over all its rows."""
    measures = dict(measures or {})
    rows = df.select(
        value.cast("double").alias("value"), *[m.alias(k) for k, m in measures.items()]
    ).where(F.col("value").isNotNull())
    table = column_prefixes(
        rows, [F.col("value")], {m: F.col(m) for m in measures}, rows_per_bucket, dense).drop("c")
    row = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(m).alias(m) for m in measures]).first()
    return PrefixTable(table, {m: row[m] or 0 for m in ("n", *measures)})


def attach_ranks(
    df: DataFrame, columns: Sequence[str], prefixes: DataFrame, ranks: dict[str, dict[str, Column]],
) -> DataFrame:
    """Add to ``df``, for each column, expressions over its prefix table (name -> expression).

    The tables are written once and joined back by value: by broadcast if a column has few
    values, otherwise shuffled with its frequent values spread. NULL keeps NULL.
    """
    names = sorted({n for own in ranks.values() for n in own})
    shown = [
        F.coalesce(*[F.when(F.col("c") == i, ranks[c][name])
                     for i, c in enumerate(columns) if name in ranks.get(c, {})]).alias(name)
        for name in names]
    table = cut_lineage(prefixes.select("c", F.col("value").alias("_value"), F.col("n").alias("_w"), *shown))
    sizes = {r["c"]: r for r in table.groupBy("c").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("_w").alias("total")).collect()}
    for i, c in enumerate(columns):
        own = list(ranks.get(c, {}))
        if not own:
            continue
        mine = table.where(F.col("c") == i).select("_value", *own, "_w")
        rows, total = (sizes[i]["rows"], sizes[i]["total"]) if i in sizes else (0, 0)
        small = fits_broadcast(rows, 16 * (2 + len(own)) * rows)
        hot = [] if small else mine.where(
            F.col("_w") * HOT_SHARE >= total).select("_value").collect()
        lookup = Lookup(mine.drop("_w"), ["_value"], rows, small, [tuple(r) for r in hot])
        df = attach(df.withColumn("_ranked", as_double(c)), lookup, ["_ranked"]).drop("_ranked")
    return df


def average_ranks(
    df: DataFrame, column: str, name: str, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Add the 1-based average rank of ``column`` as ``name``; NULL keeps NULL."""
    return add_ranks(df, {column: name}, rows_per_bucket)


def add_ranks(
    df: DataFrame, names: dict[str, str], rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Add the average rank of every column named as a key; all columns are ranked in one job."""
    columns = list(names)
    prefixes = column_prefixes(df, [as_double(c) for c in columns], None, rows_per_bucket)
    return attach_ranks(df, columns, prefixes, {c: {n: average_rank()} for c, n in names.items()})


def average_rank() -> Column:
    """1-based average rank of a value in a prefix table."""
    return F.col("before_n") + (F.col("n") + 1) / 2.0


@dataclass
class IndexedRows:
    """Rows in global order, materialised once: ``row_index`` is 0-based, ``part`` its range."""

    table: DataFrame
    n: int


def global_row_index(df: DataFrame, order: Sequence[Column]) -> IndexedRows:
    """Number all rows in the given total order.

    Spark's own range partitioning sorts the rows; position inside a partition comes from the
    monotonic id, partition offsets from one count per partition. The sorted rows are written to
    the checkpoint folder because ids and offsets must refer to the same partition bounds.
    """
    stamped = df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id())
    stamped = cut_lineage(stamped)
    part = F.shiftright("_mid", 33).cast("int")
    sizes = stamped.groupBy(part.alias("part")).count().orderBy("part").collect()
    offsets, seen = [], 0
    for r in sizes:
        offsets.append((r["part"], seen))
        seen += r["count"]
    spark = df.sparkSession
    offset_table = local_rows(spark, offsets, "part int, part_offset long")
    table = (
        stamped.withColumn("part", part)
        .join(F.broadcast(offset_table), "part")  # one row per sort partition
        .withColumn("row_index", F.col("part_offset") + F.col("_mid").bitwiseAND(F.lit(_MASK)))
        .drop("_mid", "part_offset")
    )
    return IndexedRows(table, seen)


def lagged_products(
    indexed: IndexedRows, columns: Sequence[str], centres: dict[str, float]
) -> dict[str, tuple[float, int]]:
    """Sum of products of successive non-null values (centred), per column, and their number.

    Lags inside a range are windows partitioned by the range; products across range borders use
    the first and last value of every range (one small row per range).
    """
    w = Window.partitionBy("part").orderBy("row_index").rowsBetween(Window.unboundedPreceding, -1)
    t = indexed.table.select(
        "part",
        "row_index",
        *[(F.col(c).cast("double") - F.lit(centres[c])).alias(c) for c in columns],
    )
    for c in columns:
        t = t.withColumn(f"prev_{c}", F.last(c, ignorenulls=True).over(w))
    aggs = []
    for i, c in enumerate(columns):
        present = F.when(F.col(c).isNotNull(), F.struct("row_index", F.col(c).alias("v")))
        aggs += [
            F.sum(F.col(c) * F.col(f"prev_{c}")).alias(f"s{i}"),
            F.count(F.col(c) * F.col(f"prev_{c}")).alias(f"n{i}"),
            F.min(present)["v"].alias(f"first{i}"),
            F.max(present)["v"].alias(f"last{i}"),
        ]
    parts = t.groupBy("part").agg(*aggs).orderBy("part").collect()
    out = {}
    for i, c in enumerate(columns):
        total, pairs, previous = 0.0, 0, None
        for r in parts:
            if r[f"first{i}"] is None:
                continue
            if previous is not None:
                total += previous * r[f"first{i}"]
                pairs += 1
            total += r[f"s{i}"] or 0.0
            pairs += r[f"n{i}"]
            previous = r[f"last{i}"]
        out[c] = (total, pairs)
    return out
