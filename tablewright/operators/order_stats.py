"""Exact order statistics without sorting the data.

A mergeable quantile sketch brackets every wanted rank; a second pass counts what lies between
the brackets and lists only the distinct values inside them. Data is never shuffled, only sketches
and a few counters are, and a value held by a third of all rows is one entry. The second pass
proves the answer, so a poor sketch costs another pass and never a wrong result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.core import as_double

SKETCH_ACCURACY = 2_000
LIST_LIMIT = 500_000
SMALL_COLUMN = 10_000


@dataclass
class _Target:
    rank: int
    lo: float
    hi: float
    value: float | None = None


@dataclass
class OrderStatistics:
    """Number of non-null values and the value at each requested rank (0-based)."""

    n: int
    values: dict[int, float]
    minimum: float | None
    maximum: float | None

    def quantile(self, p: float) -> float | None:
        if self.n == 0:
            return None
        position = p * (self.n - 1)
        low = math.floor(position)
        a, b = self.values[low], self.values[min(low + 1, self.n - 1)]
        return a + (b - a) * (position - low)


def _merge(targets: Sequence[_Target]) -> list[tuple[float, float]]:
    merged: list[list[float]] = []
    for lo, hi in sorted((t.lo, t.hi) for t in targets if t.value is None):
        if merged and lo <= math.nextafter(merged[-1][1], math.inf):
            merged[-1][1] = max(merged[-1][1], hi)
        else:
            merged.append([lo, hi])
    return [(a, b) for a, b in merged]


def _zone(value: Column, intervals: Sequence[tuple[float, float]]) -> Column:
    """Even numbers are the gaps around the intervals, odd numbers the intervals themselves."""
    zone: Column | None = None
    for i, (lo, hi) in enumerate(intervals):
        below, inside = value < F.lit(lo), value <= F.lit(hi)
        zone = F.when(below, 2 * i) if zone is None else zone.when(below, 2 * i)
        zone = zone.when(inside, 2 * i + 1)
    return zone.otherwise(2 * len(intervals))


def _zoned_rows(
    df: DataFrame, columns: dict[str, Column], intervals: dict[str, list[tuple[float, float]]]
) -> DataFrame:
    """(c, z, v) of every value that is not NULL: its column, its zone, and itself inside an interval.

    Zones are found by bisection; a comparison with each border in turn would take most of the time
    of a scan. Infinite borders, of which there are few, are compared.
    """
    names = list(intervals)
    # -0.0 equals 0.0, but bisection would put it below
    wide = df.select(*[(columns[name] + F.lit(0.0)).alias(f"v{i}") for i, name in enumerate(names)])
    cuts = {i: _splits(intervals[name]) for i, name in enumerate(names)}
    cut = [i for i, splits in cuts.items() if splits]
    if cut:
        wide = Bucketizer(
            splitsArray=[cuts[i] for i in cut], inputCols=[f"v{i}" for i in cut],
            outputCols=[f"z{i}" for i in cut], handleInvalid="keep").transform(wide)
    entries = []
    for i, name in enumerate(names):
        value = F.col(f"v{i}")
        zone = _zone(value, intervals[name])
        if i in cut:
            above = F.lit(2 * len(intervals[name]))  # NaN is above all numbers
            zone = F.when(F.isnan(value), above).otherwise(F.col(f"z{i}").cast("int"))
        entries.append(F.struct(
            F.lit(i).alias("c"), F.when(value.isNotNull(), zone).alias("z"), value.alias("v")))
    return wide.select(F.inline(F.array(*entries))).where(F.col("z").isNotNull()).withColumn(
        "v", F.when(F.col("z") % 2 == 1, F.col("v")))


def _splits(intervals: Sequence[tuple[float, float]]) -> list[float]:
    """Borders of the zones as half-open ranges; none if an interval ends at infinity."""
    ends = [e for lo, hi in intervals for e in (lo + 0.0, math.nextafter(hi, math.inf))]
    return [-math.inf, *ends, math.inf] if all(map(math.isfinite, ends)) else []


def order_statistics(
    df: DataFrame,
    columns: dict[str, Column],
    guesses: Sequence[float],
    ranks: Callable[[int], Sequence[int]],
    *,
    accuracy: int = SKETCH_ACCURACY,
    list_limit: int = LIST_LIMIT,
    small: int = SMALL_COLUMN,
) -> dict[str, OrderStatistics]:
    """Values at exact ranks for several double columns at once.

    ``guesses`` are the fractions near which the ranks lie; ``ranks(n)`` lists the 0-based ranks
    wanted from a column with n non-null values.
    """
    margin = 2.0 / accuracy
    probes = sorted({min(max(g + s, 0.0), 1.0) for g in guesses for s in (-margin, margin)})
    parts = []
    for i, value in enumerate(columns.values()):
        parts += [
            F.count(value).alias(f"n{i}"),
            F.min(value).alias(f"lo{i}"),
            F.max(value).alias(f"hi{i}"),
        ]
        if probes:
            parts.append(F.percentile_approx(value, probes, accuracy).alias(f"q{i}"))
    first = df.agg(*parts).first()

    targets: dict[str, list[_Target]] = {}
    extremes: dict[str, tuple[int, float, float]] = {}
    expected = 0.0
    for i, name in enumerate(columns):
        n = first[f"n{i}"]
        extremes[name] = (n, first[f"lo{i}"], first[f"hi{i}"])
        if n == 0:
            continue
        low, high = first[f"lo{i}"], first[f"hi{i}"]
        at = dict(zip(probes, first[f"q{i}"])) if probes else {}
        wanted = []
        for rank in sorted(set(ranks(n))):
            if n <= small or low == high:
                wanted.append(_Target(rank, low, high))
                continue
            share = rank / (n - 1)
            below = [at[p] for p in probes if p <= share - margin / 2 and p > 0.0]
            above = [at[p] for p in probes if p >= share + margin / 2 and p < 1.0]
            wanted.append(_Target(rank, max(below, default=low), min(above, default=high)))
        targets[name] = wanted
        if low != high:
            expected += n if n <= small else min(n, len(guesses) * 4 * margin * n)

    while True:
        intervals = {c: _merge(t) for c, t in targets.items()}
        intervals = {c: m for c, m in intervals.items() if m}
        if not intervals:
            break
        zoned = _zoned_rows(df, columns, intervals)
        names = list(intervals)
        listed = expected <= list_limit
        if listed:
            counted = zoned.groupBy("c", "z", "v").agg(F.count(F.lit(1)).alias("n"))
            rows = counted.limit(4 * list_limit + 1).collect()
            if len(rows) > 4 * list_limit:
                expected = math.inf  # more values than the sketch promised: narrow further
                continue
        else:
            ladder = [k / 200 for k in range(201)]
            rows = (
                zoned.groupBy("c", "z")
                .agg(
                    F.count(F.lit(1)).alias("n"),
                    F.min("v").alias("lo"),
                    F.max("v").alias("hi"),
                    F.approx_count_distinct("v").alias("d"),
                    F.percentile_approx("v", ladder, accuracy).alias("q"),
                )
                .collect()
            )
        expected = 0.0
        for c, name in enumerate(names):
            mine = [r for r in rows if r["c"] == c]
            expected += _advance(
                targets[name], intervals[name], mine, extremes[name], listed, accuracy
            )

    return {
        name: OrderStatistics(
            extremes[name][0],
            {t.rank: t.value for t in targets.get(name, [])},
            extremes[name][1],
            extremes[name][2],
        )
        for name in columns
    }


def _advance(
    targets: list[_Target],
    intervals: list[tuple[float, float]],
    rows: list,
    extremes: tuple[int, float, float],
    listed: bool,
    accuracy: int,
) -> float:
    """Resolve or narrow the targets of one column; returns how many values may be listed next."""
    _, low, high = extremes
    zones: dict[int, int] = {}
    for r in rows:
        zones[r["z"]] = zones.get(r["z"], 0) + r["n"]
    starts, seen = {}, 0
    for z in range(2 * len(intervals) + 1):
        starts[z] = seen
        seen += zones.get(z, 0)

    inside: dict[int, list[tuple[float, int]]] = {}
    sketches = {}
    if listed:
        for r in rows:
            if r["v"] is not None:
                inside.setdefault(r["z"], []).append((r["v"], r["n"]))
        for values in inside.values():
            values.sort()
    else:
        sketches = {r["z"]: r for r in rows}

    upcoming = 0.0
    for t in targets:
        if t.value is not None:
            continue
        zone = next(z for z in starts if starts[z] <= t.rank < starts[z] + zones.get(z, 0))
        if zone % 2 == 0:
            # the sketch missed: search the gap that provably holds the rank
            t.lo = intervals[zone // 2 - 1][1] if zone > 0 else low
            t.hi = intervals[zone // 2][0] if zone // 2 < len(intervals) else high
            upcoming += zones[zone]
        elif listed:
            offset = starts[zone]
            for value, count in inside[zone]:
                offset += count
                if t.rank < offset:
                    t.value = value
                    break
        else:
            r = sketches[zone]
            if r["lo"] == r["hi"]:
                t.value = r["lo"]
                continue
            share = (t.rank - starts[zone]) / max(r["n"] - 1, 1)
            slack = 2.0 / accuracy
            below = [v for k, v in enumerate(r["q"]) if k > 0 and k / 200 <= share - slack]
            above = [v for k, v in enumerate(r["q"]) if k < 200 and k / 200 >= share + slack]
            t.lo, t.hi = max(below, default=r["lo"]), min(above, default=r["hi"])
            # heavy values at the ends of an interval are many rows but few distinct values
            upcoming += min(r["n"] * (1 / 100 + 4 * slack), 1.2 * r["d"] + 10)
    return upcoming


def _quantile_ranks(probabilities: Sequence[float]) -> Callable[[int], list[int]]:
    def ranks(n: int) -> list[int]:
        wanted = []
        for p in probabilities:
            low = math.floor(p * (n - 1))
            wanted += [low, min(low + 1, n - 1)]
        return wanted

    return ranks


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], **options
) -> dict[str, OrderStatistics]:
    """Order statistics from which any of ``probabilities`` can be interpolated linearly."""
    if not columns:
        return {}
    exprs = {c: as_double(c) for c in columns}
    return order_statistics(
        df, exprs, probabilities, _quantile_ranks(probabilities), **options
    )


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    return {c: s.quantile(0.5) for c, s in exact_quantiles(df, columns, [0.5]).items()}
