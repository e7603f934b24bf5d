"""Reusable column expressions (all JVM-side)."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# 13 hexadecimal digits are 52 bits, so a double holds every hash value exactly.
HASH_DIGITS = 13
HASH_SPAN = float(16**HASH_DIGITS)


def keyed_hash(key: Column, seed: int) -> Column:
    """Deterministic 52-bit hash of a key as a long, independent of partitioning."""
    text = F.concat(key.cast("string"), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, HASH_DIGITS), 16, 10).cast("long")


def sample_skewness(n: Column, g1: Column) -> Column:
    """Bias-corrected skewness from the population skewness; NULL below three values."""
    n = n.cast("double")
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(n: Column, g2: Column) -> Column:
    """Bias-corrected excess kurtosis from the population excess kurtosis."""
    n = n.cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson r over rows where both are present; NULL when either side is constant."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(x) * F.stddev_pop(y))


def interpolated_bucket(value: Column, edges: Sequence[float], closed: str) -> Column:
    """Index of the bin of ``value`` between inner ``edges``; NULL stays NULL.

    ``closed="right"`` puts a value equal to an edge below it, ``closed="left"`` above it. The edges
    are bisected: a value is compared with the logarithm of their number.
    """
    if not edges:
        return F.when(value.isNotNull(), F.lit(0))
    edges = sorted(float(e) for e in edges)

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        edge = F.lit(edges[middle])
        above = value > edge if closed == "right" else value >= edge
        return F.when(above, among(middle + 1, high)).otherwise(among(low, middle))

    return F.when(value.isNotNull(), among(0, len(edges)))


def majority_vote(votes: Sequence[Column]) -> Column:
    """Most frequent vote of a row; a tie goes to the vote that appears first in the list."""
    counts = [
        functools.reduce(operator.add, [F.when(v.eqNullSafe(w), 1).otherwise(0) for w in votes])
        for v in votes
    ]
    top = F.greatest(*counts) if len(counts) > 1 else counts[0]
    choice: Column | None = None
    for vote, count in zip(votes, counts):
        choice = F.when(count == top, vote) if choice is None else choice.when(count == top, vote)
    return choice


def mean_vote(votes: Sequence[Column]) -> Column:
    total = functools.reduce(operator.add, [v.cast("double") for v in votes])
    return total / F.lit(float(len(votes)))


def composite_score(
    quality: Column, runs_to_best: Column, max_runs: Column, calls: Column, max_calls: Column
) -> Column:
    """Weighted quality / efficiency / economy score, each part clamped to [0, 1]."""

    def clamp(c: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))

    def saved(used: Column, budget: Column) -> Column:
        share = F.lit(1.0) - used.cast("double") / F.when(budget > 0, budget).cast("double")
        return F.coalesce(share, F.lit(0.0))

    return (
        0.6 * clamp(quality.cast("double"))
        + 0.25 * clamp(saved(runs_to_best, max_runs))
        + 0.15 * clamp(saved(calls, max_calls))
    )


def readable_size(total_bytes: Column) -> Column:
    """Byte count as text such as ``1.5 MB``; absent or non-positive sizes are ``unknown``."""
    out = F.when(total_bytes.isNull() | (total_bytes <= 0), F.lit("unknown"))
    for power, unit in ((4, "TB"), (3, "GB"), (2, "MB"), (1, "KB")):
        divisor = float(1024**power)
        out = out.when(
            total_bytes >= divisor,
            F.format_string(f"%.1f {unit}", F.bround(total_bytes / F.lit(divisor), 1)),
        )
    return out.otherwise(F.concat(total_bytes.cast("long").cast("string"), F.lit(" B")))
