"""Train / validation splits and cross-validation folds from keyed hashes.

Membership depends only on the row key and the seed, never on partitioning. Exact sizes come from
order statistics of the hash, so no split sorts or shuffles the rows.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.core import (
    REGRESSION,
    as_double,
    col,
    cut_lineage,
    numeric_columns,
    require_columns,
    resolve_task,
)
from tablewright.functions.expressions import HASH_SPAN, keyed_hash
from tablewright.operators.lookup import Lookup, attach, build_lookup
from tablewright.operators.order_stats import order_statistics

STRATEGIES = ("random", "stratified", "temporal", "group")

#: A key at a cut that holds more than one of this many rows of its class is reported.
COARSE_SHARE = 20


def row_key(columns: Sequence[str]) -> Column:
    """One text key from one or several key columns."""
    if len(columns) == 1:
        return col(columns[0]).cast("string")
    return F.concat_ws("|", *[col(c).cast("string") for c in columns])


def _label(is_validation: Column) -> Column:
    return F.when(is_validation, "validation").otherwise("train")


def _hash_cuts(hashed: DataFrame, counts_to_ranks) -> list[float]:
    """Hash values at the 1-based ranks ``counts_to_ranks(n)`` of column ``_u``."""
    n = hashed.count()
    ranks = [r for r in counts_to_ranks(n) if 0 < r <= n]
    if not ranks:
        return []
    stats = order_statistics(
        hashed,
        {"u": F.col("_u").cast("double")},
        [(r - 1) / max(n - 1, 1) for r in ranks],
        lambda _n: [r - 1 for r in ranks],
    )["u"]
    return [stats.values[r - 1] for r in ranks]


def class_cuts(df: DataFrame, strata: str, ranks: Column, n_ranks: int) -> Lookup:
    """Hash value at each wanted rank inside every class, as an array column ``cuts`` per class.

    Every class and rank gets its cut: a band that misses it, since many rows share a key and so a
    hash, is widened and read again.

    ``ranks`` is an array expression over the class size ``n``. Hashes are uniform, so rank r of n
    lies near r / n; only the few rows in a narrow band around that point are listed, all others
    are counted. The largest window therefore holds about the square root of the class size.
    """
    sizes = df.groupBy(col(strata).alias("stratum")).agg(F.count(F.lit(1)).alias("n"))
    wanted = cut_lineage(
        sizes.where(F.col("stratum").isNotNull())
        .select("stratum", "n", F.posexplode(ranks).alias("i", "rank"))
        .where((F.col("rank") >= 1) & (F.col("rank") <= F.col("n")))
    )
    found, missing, width = None, wanted, 1
    while True:
        own = cut_lineage(_cuts_in_bands(df, strata, missing, width))
        found = own if found is None else found.unionByName(own)
        missing = missing.join(own, ["stratum", "i"], "left_anti")
        if missing.isEmpty():
            break
        missing, width = cut_lineage(missing), width * 64
    known = found.join(sizes, "stratum")
    coarse = known.where((F.col("alike") > 1) & (F.col("alike") * COARSE_SHARE > F.col("n")))
    if not coarse.isEmpty():
        warnings.warn("one key holds a large part of a class; its rows stay together, so the class "
                      "is not divided in the wanted shares", stacklevel=3)
    sized = (
        known
        .groupBy("stratum", F.col("n").alias("_w"))
        .agg(F.sort_array(F.collect_list(F.struct("i", "_u"))).alias("c"))
        .select("stratum", F.transform("c", lambda x: x["_u"]).alias("cuts"), "_w")
    )
    return build_lookup(sized, ["stratum"], weight="_w")


def _cuts_in_bands(df: DataFrame, strata: str, wanted: DataFrame, width: int) -> DataFrame:
    """(stratum, i, _u) of the wanted ranks that lie in bands of ``width`` times the usual one."""
    n = F.col("n").cast("double")
    centre = F.col("rank") / n
    half = width * (8 * F.sqrt(centre * (1 - centre) / n + 1 / (n * n)) + 16 / n)
    bands = build_lookup(
        wanted.withColumn("lo", (centre - half) * F.lit(HASH_SPAN))
        .withColumn("hi", (centre + half) * F.lit(HASH_SPAN))
        .groupBy("stratum", "n")
        .agg(
            F.sort_array(F.collect_list(F.struct("i", "rank", "lo", "hi"))).alias("bands")
        ),  # n_ranks entries per class
        ["stratum"],
        weight="n",
    )
    # NULL classes form their own stratum
    keyed = df.select(col(strata).alias("_s"), F.col("_u"))
    rows = attach(keyed.where(F.col("_s").isNotNull()), bands, ["_s"])
    u = F.col("_u").cast("double")
    hits = F.filter("bands", lambda b: u <= b["hi"])
    # below counts rows under each band; rows inside a band keep their hash
    near = rows.select(
        "_s", "_u", F.explode(F.transform(hits, lambda b: F.struct(
            b["i"].alias("i"), b["rank"].alias("rank"), (u < b["lo"]).alias("below")))).alias("b")
    ).select("_s", "_u", "b.*")
    below = near.where("below").groupBy("_s", "i").agg(F.count(F.lit(1)).alias("below"))
    inside = near.where(~F.col("below")).drop("below")
    w = Window.partitionBy("_s", "i").orderBy("_u")
    alike = F.count(F.lit(1)).over(Window.partitionBy("_s", "i", "_u"))
    placed = inside.withColumn("place", F.row_number().over(w)).withColumn("alike", alike).join(
        below, ["_s", "i"], "left")
    return placed.where(F.col("place") + F.coalesce("below", F.lit(0)) == F.col("rank")).select(
        F.col("_s").alias("stratum"), "i", "_u", "alike")


def random_split(df: DataFrame, key: Sequence[str], fraction: float, seed: int) -> DataFrame:
    """Exactly ceil(fraction * n) validation rows: those with the smallest hashes."""
    u = keyed_hash(row_key(key), seed)
    cuts = _hash_cuts(df.select(u.alias("_u")), lambda n: [math.ceil(fraction * n)])
    return df.withColumn("split", _label(u.cast("double") <= F.lit(cuts[0] if cuts else -1.0)))


def stratified_split(
    df: DataFrame, target: str, key: Sequence[str], fraction: float, seed: int
) -> DataFrame:
    """The same share of every class, exact up to one row per class."""
    hashed = df.withColumn("_u", keyed_hash(row_key(key), seed))
    share = F.array(F.round(F.col("n") * F.lit(fraction)).cast("long"))
    cuts = class_cuts(hashed, target, share, 1)
    joined = attach(hashed, cuts, [target])
    chosen = F.coalesce(F.col("_u") <= F.element_at("cuts", 1), F.lit(False))
    return joined.withColumn("split", _label(chosen)).drop("_u", "cuts", "_w")


def temporal_split(
    df: DataFrame, temporal: str, key: Sequence[str], fraction: float, seed: int
) -> DataFrame:
    """The first int(n * (1 - fraction)) rows by time are train; equal times follow the key.

    Two order statistics are enough: the time at the cut, and among the rows with exactly that
    time the key at the remaining rank. Text keys are ordered by their hash.
    """
    when = F.unix_micros(col(temporal).cast("timestamp")).cast("double")
    if temporal in numeric_columns(df):
        when = as_double(temporal)
    numeric_key = len(key) == 1 and key[0] in numeric_columns(df)
    tie = as_double(key[0]) if numeric_key else keyed_hash(row_key(key), seed).cast("double")
    narrow = df.select(when.alias("t"), tie.alias("k"))
    n = narrow.count()
    n_train = int(n * (1 - fraction))
    if n_train <= 0 or n_train >= n:
        return df.withColumn("split", F.lit("train" if n_train >= n else "validation"))
    stats = order_statistics(
        narrow, {"t": F.coalesce(F.col("t"), F.lit(math.inf))},
        [(n_train - 1) / max(n - 1, 1)], lambda _n: [n_train - 1],
    )["t"]
    cut = stats.values[n_train - 1]
    earlier = narrow.where(F.col("t") < F.lit(cut)).count()
    left = n_train - earlier
    tied = narrow.where(F.coalesce(F.col("t"), F.lit(math.inf)) == F.lit(cut))
    tie_cut = order_statistics(
        tied, {"k": F.col("k")}, [left / max(n - earlier, 1), 0.5],
        lambda m: [min(left, m) - 1],
    )["k"]
    limit = next(iter(tie_cut.values.values()))
    moment = F.coalesce(when, F.lit(math.inf))
    train = (moment < F.lit(cut)) | ((moment == F.lit(cut)) & (tie <= F.lit(limit)))
    return df.withColumn("split", _label(~F.coalesce(train, F.lit(False))))


def group_split(df: DataFrame, group: str, fraction: float, seed: int) -> DataFrame:
    """ceil(fraction * groups) whole groups go to validation; rows need no join for that."""
    u = keyed_hash(row_key([group]), seed)
    groups = df.select(col(group)).distinct().select(u.alias("_u"))
    cuts = _hash_cuts(groups, lambda n: [math.ceil(fraction * n)])
    inside = u.cast("double") <= F.lit(cuts[0] if cuts else -1.0)
    return df.withColumn("split", _label(F.coalesce(inside, F.lit(False))))


def create_split(
    df: DataFrame,
    target: str,
    key: Sequence[str],
    strategy: str = "auto",
    validation_fraction: float = 0.2,
    temporal_column: str | None = None,
    group_column: str | None = None,
    task: str = "auto",
    seed: int = 42,
) -> DataFrame:
    """Add a ``split`` column with the values ``train`` and ``validation``.

    ``key`` names the columns that identify a row. ``auto`` is random for regression, else
    stratified.
    """
    require_columns(df, [target, *key])
    if not 0.0 < validation_fraction < 1.0:
        raise ValueError("validation_fraction must be between 0 and 1")
    if strategy in ("auto", "stratified"):
        spec = resolve_task(df, target, task)
        if strategy == "auto":
            strategy = "random" if spec.task == REGRESSION else "stratified"
        elif spec.task == REGRESSION:
            raise ValueError("a continuous target cannot be stratified; use strategy='random'")
    if strategy == "random":
        return random_split(df, key, validation_fraction, seed)
    if strategy == "stratified":
        return stratified_split(df, target, key, validation_fraction, seed)
    if strategy == "temporal":
        if not temporal_column:
            raise ValueError("a split by time needs temporal_column")
        require_columns(df, [temporal_column])
        return temporal_split(df, temporal_column, key, validation_fraction, seed)
    if strategy == "group":
        if not group_column:
            raise ValueError("a split by groups needs group_column")
        require_columns(df, [group_column])
        return group_split(df, group_column, validation_fraction, seed)
    raise ValueError(f"Unknown split strategy '{strategy}'. Use one of {STRATEGIES}.")


def split_summary(df: DataFrame) -> DataFrame:
    """Rows and share per partition of a split table."""
    counts = df.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))
    w = Window.partitionBy(F.lit(0))  # two rows
    return counts.withColumn("share", F.col("n_rows") / F.sum("n_rows").over(w))


def assign_folds(
    df: DataFrame, key: Sequence[str], k: int, seed: int, stratify: str | None = None
) -> DataFrame:
    """Add ``fold`` in 0..k-1; fold sizes differ by at most one row (per class if stratified)."""
    if k < 2:
        raise ValueError("at least two folds are needed")
    hashed = df.withColumn("_u", keyed_hash(row_key(key), seed))
    if stratify is None:
        cuts = _hash_cuts(
            hashed.select("_u"), lambda n: [math.ceil(j * n / k) for j in range(1, k)]
        )
        fold = F.lit(0)
        for c in cuts:
            fold = fold + F.when(F.col("_u").cast("double") > F.lit(c), 1).otherwise(0)
        return hashed.withColumn("fold", fold).drop("_u")
    ranks = F.array(*[F.ceil(F.col("n") * F.lit(j) / F.lit(k)).cast("long") for j in range(1, k)])
    cuts = class_cuts(hashed, stratify, ranks, k - 1)
    joined = attach(hashed, cuts, [stratify])
    u = F.col("_u")
    fold = F.size(F.filter("cuts", lambda c: u > c))
    # a class without usable cuts (NULL or a single row) is spread by its hash
    fold = F.when(F.col("cuts").isNull(), F.pmod(u, F.lit(k)).cast("int")).otherwise(fold)
    return joined.withColumn("fold", fold).drop("_u", "cuts", "_w")
