"""Normality tests: Shapiro-Wilk and Anderson-Darling, in one group or over distinct values."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.core import as_double, col, cut_lineage, local_rows, numeric_columns, require_columns
from tablewright.functions.special import normal_cdf, normal_quantile
from tablewright.operators.ordering import value_prefix
from tablewright.operators.profile import numeric_moments

SMALL_TABLE = 5_000
#: Places of equal values whose scores a task adds up at once.
PLACES = 256
SCHEMA = (
    "column string, test string, statistic double, p_value double, critical_value_5pct double, "
    "is_normal boolean, n_valid long"
)


def shapiro_wilk(values: np.ndarray) -> tuple[float, float]:
    """W and its p-value with Royston's polynomial approximations (at least 3 values)."""
    x = np.sort(values.astype(float))
    n = len(x)
    if x[0] == x[-1]:
        return 1.0, 1.0
    m = np.array([normal_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    return _royston(n, float(m @ m), float(m @ (x - x.mean())), m[-2:], x[:2], x[-2:],
                    float(((x - x.mean()) ** 2).sum()))


def _royston(
    n: int, ssq: float, product: float, m: np.ndarray, low: np.ndarray, high: np.ndarray,
    squares: float,
) -> tuple[float, float]:
    """W and its p-value from sums over the sorted values.

    ``ssq`` and ``product`` are the sums of squared normal scores and of scores times values,
    ``m`` the last two scores, ``low`` and ``high`` the first and last two values, ``squares`` the
    squared deviations. All but the outer one or two scores are divided by one number.
    """
    root = 1.0 / math.sqrt(n)
    # fixed values: published coefficients of the approximation
    tail1 = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0], root)
    tail2 = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0], root)
    outer, inner = m[1] / math.sqrt(ssq) + tail1, m[0] / math.sqrt(ssq) + tail2
    wide, narrow = high[1] - low[0], high[0] - low[1]
    if n > 5:
        phi = (ssq - 2 * m[1] ** 2 - 2 * m[0] ** 2) / (1 - 2 * outer**2 - 2 * inner**2)
        total = (product - m[1] * wide - m[0] * narrow) / math.sqrt(phi) + outer * wide + inner * narrow
    else:
        phi = (ssq - 2 * m[1] ** 2) / (1 - 2 * outer**2)
        total = (product - m[1] * wide) / math.sqrt(phi) + outer * wide
    w = min(float(total**2 / squares), 1.0)
    if n == 3:
        p = 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return w, max(p, 0.0)
    y = math.log(max(1.0 - w, 1e-300))
    if n <= 11:
        gamma = -2.273 + 0.459 * n
        if y >= gamma:
            return w, 0.0
        y = -math.log(gamma - y)
        mean = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n)
        sd = math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        log_n = math.log(n)
        mean = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], log_n)
        sd = math.exp(np.polyval([0.0030302, -0.082676, -0.4803], log_n))
    return w, 1.0 - normal_cdf((y - mean) / sd)


def shapiro_wilk_of_column(df: DataFrame, column: str, mean: float) -> tuple[float, float]:
    """The same for a column of any length (at least 8 values).

    Works on distinct values with their counts and prefix counts: a value occupying the sorted
    positions b+1 .. b+c counts with the sum of their scores, added up PLACES at a time.
    """
    prefix = value_prefix(df, col(column))
    n, last = prefix.n, F.col("before_n") + F.col("n") - 1
    table = cut_lineage(prefix.table.select(
        (F.col("value") - F.lit(mean)).alias("v"), "before_n", "n"))
    low, high = (
        [v for r in table.orderBy(order).limit(2).collect() for v in [r["v"]] * min(2, r["n"])][:2]
        for order in (F.asc("v"), F.desc("v")))
    if low[0] == high[0]:
        return 1.0, 1.0
    places = table.select("v", last.alias("last"), F.explode(
        F.sequence("before_n", last, F.lit(PLACES).cast("long"))).alias("first"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = NormalDist().inv_cdf
        for batch in batches:
            found = []
            for v, first, last in zip(batch["v"], batch["first"], batch["last"]):
                m = np.array([score((i + 0.625) / (n + 0.25))
                              for i in range(first, min(last + 1, first + PLACES))])
                found.append((m @ m, v * m.sum(), v * v * len(m)))
            yield pd.DataFrame(found, columns=["ssq", "product", "squares"])

    sums = places.repartition(parts, "first").mapInPandas(
        add, "ssq double, product double, squares double").agg(
            *[F.sum(c).alias(c) for c in ("ssq", "product", "squares")]).first()
    m = np.array([normal_quantile((n - 1 - 0.375) / (n + 0.25)), normal_quantile((n - 0.375) / (n + 0.25))])
    return _royston(n, sums["ssq"], sums["product"], m, np.array(low), np.array(high[::-1]), sums["squares"])


def _small_table(df: DataFrame, names: Sequence[str]) -> list[tuple]:
    """The whole table has fewer than SMALL_TABLE rows; one bounded group per column."""
    entries = F.array(
        *[F.struct(F.lit(c).alias("column"), as_double(c).alias("x")) for c in names]
    )

    def test(group: pd.DataFrame) -> pd.DataFrame:
        values = group["x"].to_numpy()
        if len(values) < 8:
            return pd.DataFrame([(group["column"].iloc[0], None, None, len(values))],
                                columns=["column", "w", "p", "n"])
        w, p = shapiro_wilk(values)
        return pd.DataFrame([(group["column"].iloc[0], w, p, len(values))],
                            columns=["column", "w", "p", "n"])

    found = {
        r["column"]: r
        for r in df.select(F.inline(entries))
        .where(F.col("x").isNotNull())
        .groupBy("column")
        .applyInPandas(test, "column string, w double, p double, n long")
        .collect()
    }
    rows = []
    for c in names:
        r = found.get(c)
        if r is None or r["n"] < 8:
            n = r["n"] if r else 0
            rows.append((c, "insufficient_data", None, None, None, None, n))
        else:
            rows.append((c, "shapiro_wilk", r["w"], r["p"], None, r["p"] > 0.05, r["n"]))
    return rows


def _log_tails(z: pd.Series) -> pd.DataFrame:
    """Logarithms of the lower and upper normal tail; Spark has no error function."""
    scaled = z.to_numpy() / math.sqrt(2.0)
    tiny = 1e-320
    lower = [math.log(max(0.5 * math.erfc(-v), tiny)) for v in scaled]
    upper = [math.log(max(0.5 * math.erfc(v), tiny)) for v in scaled]
    return pd.DataFrame({"lower": lower, "upper": upper})


def anderson_darling(df: DataFrame, column: str, mean: float, std: float) -> float:
    """A-squared against the fitted normal distribution.

    Works on distinct values with their counts and prefix counts: a value occupying the sorted
    positions b+1 .. b+c contributes the sum of (2i-1) over them, which is c * (2b + c).
    """
    prefix = value_prefix(df, col(column))
    n = prefix.n
    b, c = F.col("before_n").cast("double"), F.col("n").cast("double")
    log_tails = F.pandas_udf(_log_tails, "lower double, upper double")
    weighted = prefix.table.select(
        b.alias("b"), c.alias("c"),
        log_tails((F.col("value") - F.lit(mean)) / F.lit(std)).alias("t"),
    )
    low = F.col("c") * (2 * F.col("b") + F.col("c"))
    high = F.col("c") * (2.0 * n) - low
    total = weighted.agg(F.sum(low * F.col("t.lower") + high * F.col("t.upper"))).first()[0]
    return -n - total / n


def critical_value_5pct(n: int) -> float:
    return round(0.787 / (1.0 + 4.0 / n - 25.0 / n / n), 3)


def test_normality(
    df: DataFrame, columns: Sequence[str] | None = None, method: str = "auto"
) -> DataFrame:
    """One row per numeric column.

    ``method`` is ``shapiro_wilk``, ``anderson_darling``, or ``auto``: the first below 5,000 rows,
    else the second. The p-value of the first was fitted to fewer than 5,000 rows; above, it is
    the same formula carried on.
    """
    if method not in ("auto", "shapiro_wilk", "anderson_darling"):
        raise ValueError(f"unknown normality test '{method}'")
    if columns:
        require_columns(df, columns)
    names = [c for c in numeric_columns(df) if not columns or c in columns]
    if not names:
        return local_rows(df.sparkSession, [], SCHEMA)
    moments = numeric_moments(df, names, shape=False)
    small = next(iter(moments.values()))["rows"] < SMALL_TABLE
    if small and method != "anderson_darling":
        return local_rows(df.sparkSession, _small_table(df, names), SCHEMA)
    rows = []
    for c in names:
        m = moments[c]
        n = m["n"]
        if n < 8:
            rows.append((c, "insufficient_data", None, None, None, None, n))
        elif method == "shapiro_wilk":
            w, p = shapiro_wilk_of_column(df, c, m["mean"])
            rows.append((c, "shapiro_wilk", w, p, None, p > 0.05, n))
        elif not m["std"]:
            rows.append((c, "error", None, None, None, None, n))
        else:
            statistic = anderson_darling(df, c, m["mean"], m["std"])
            limit = critical_value_5pct(n)
            rows.append((c, "anderson_darling", statistic, None, limit, statistic < limit, n))
    return local_rows(df.sparkSession, rows, SCHEMA)


test_normality.__test__ = False
