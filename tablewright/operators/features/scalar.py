"""Row-wise operations and operations that learn a few numbers per column."""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Iterator, Sequence
from itertools import combinations, combinations_with_replacement
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.core import as_double, col
from tablewright.operators.features.base import FeatureOperation, feature_operation
from tablewright.operators.order_stats import medians


def replace_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Replace columns in place, keeping their order, in one projection."""
    return df.select(*[new[c].alias(c) if c in new else col(c) for c in df.columns])


@feature_operation("impute_numeric")
def impute_numeric(params: dict[str, Any]) -> FeatureOperation:
    columns, strategy = params.get("columns", []), params.get("strategy", "mean")
    if strategy not in ("mean", "median", "zero"):
        raise ValueError(
            f"impute_numeric: unknown strategy '{strategy}'. Use 'mean', 'median' or 'zero'."
        )

    def learn(df: DataFrame):
        if strategy == "zero" or not columns:
            fill = dict.fromkeys(columns, 0.0)
        elif strategy == "mean":
            r = df.agg(*[F.avg(as_double(c)).alias(f"m{i}") for i, c in enumerate(columns)])
            fill = dict(zip(columns, r.first()))
        else:
            fill = medians(df, columns)
        return lambda d: replace_columns(
            d, {c: F.coalesce(as_double(c), F.lit(fill[c])) for c in columns}
        )

    return FeatureOperation("impute_numeric", learn, columns)


def most_frequent(df: DataFrame, columns: list[str]) -> dict[str, Any]:
    """Most frequent value per column, ties to the smallest; one grouping per column."""
    found = {}
    for c in columns:
        counts = df.where(col(c).isNotNull()).groupBy(col(c).alias("v")).agg(
            F.count(F.lit(1)).alias("n")
        )
        best = counts.agg(F.min(F.struct((-F.col("n")).alias("k"), F.col("v")))["v"]).first()[0]
        found[c] = best
    return found


@feature_operation("impute_categorical")
def impute_categorical(params: dict[str, Any]) -> FeatureOperation:
    columns, strategy = params.get("columns", []), params.get("strategy", "mode")
    fill_value = params.get("fill_value", "missing")
    if strategy not in ("mode", "constant"):
        raise ValueError(
            f"impute_categorical: unknown strategy '{strategy}'. Use 'mode' or 'constant'."
        )

    def learn(df: DataFrame):
        fill = dict.fromkeys(columns, fill_value)
        if strategy == "mode":
            fill.update(
                {c: v for c, v in most_frequent(df, columns).items() if v is not None}
            )
        return lambda d: replace_columns(
            d,
            {c: F.coalesce(col(c), F.lit(fill[c]).cast(d.schema[c].dataType)) for c in columns},
        )

    return FeatureOperation("impute_categorical", learn, columns)


@feature_operation("standard_scale")
def standard_scale(params: dict[str, Any]) -> FeatureOperation:
    columns = params.get("columns", [])

    def learn(df: DataFrame):
        exprs = []
        for i, c in enumerate(columns):
            exprs += [
                F.avg(as_double(c)).alias(f"m{i}"), F.stddev_pop(as_double(c)).alias(f"s{i}")
            ]
        r = df.agg(*exprs).first() if columns else {}
        scales = {c: (r[f"m{i}"], r[f"s{i}"] or 1.0) for i, c in enumerate(columns)}
        return lambda d: replace_columns(
            d, {c: (as_double(c) - F.lit(m)) / F.lit(s) for c, (m, s) in scales.items()})

    return FeatureOperation("standard_scale", learn, columns)


@feature_operation("log_transform")
def log_transform(params: dict[str, Any]) -> FeatureOperation:
    columns = params.get("columns", [])
    return FeatureOperation(
        "log_transform",
        lambda df: lambda d: replace_columns(d, {c: F.log1p(as_double(c)) for c in columns}),
        columns,
    )


@feature_operation("drop_columns")
def drop_columns(params: dict[str, Any]) -> FeatureOperation:
    columns = params.get("columns", [])
    return FeatureOperation("drop_columns", lambda df: lambda d: d.drop(*columns), columns)


@feature_operation("create_interaction")
def create_interaction(params: dict[str, Any]) -> FeatureOperation:
    a, b = params.get("column_a", ""), params.get("column_b", "")
    name = params.get("name", f"{a}_x_{b}")
    return FeatureOperation(
        "create_interaction", lambda df: lambda d: d.withColumn(name, col(a) * col(b)), [a, b]
    )


@feature_operation("ratio_features")
def ratio_features(params: dict[str, Any]) -> FeatureOperation:
    a, b = params.get("numerator", ""), params.get("denominator", "")
    name = params.get("name", f"{a}_over_{b}")
    return FeatureOperation(
        "ratio_features",
        lambda df: lambda d: d.withColumn(name, as_double(a) / (as_double(b) + F.lit(1e-8))),
        [a, b],
    )


@feature_operation("cyclic_encode")
def cyclic_encode(params: dict[str, Any]) -> FeatureOperation:
    c, period = params.get("column", ""), params.get("period", 1)

    def apply(d: DataFrame) -> DataFrame:
        angle = F.lit(2 * math.pi) * as_double(c) / F.lit(float(period))
        return d.withColumns({f"{c}_sin": F.sin(angle), f"{c}_cos": F.cos(angle)}).drop(c)

    return FeatureOperation("cyclic_encode", lambda df: apply, [c])


def polynomial_terms(columns: list[str], degree: int, interaction_only: bool) -> list[tuple]:
    pick = combinations if interaction_only else combinations_with_replacement
    return [t for d in range(1, degree + 1) for t in pick(columns, d)]


def _term_name(term: tuple) -> str:
    powers = {c: term.count(c) for c in term}
    return " ".join(c if p == 1 else f"{c}^{p}" for c, p in powers.items())


@feature_operation("polynomial_features")
def polynomial_features(params: dict[str, Any]) -> FeatureOperation:
    columns = params.get("columns", [])
    terms = polynomial_terms(
        columns, params.get("degree", 2), params.get("interaction_only", False)
    )

    def apply(d: DataFrame) -> DataFrame:
        products = [
            functools.reduce(operator.mul, [as_double(c) for c in t]).alias(_term_name(t))
            for t in terms
        ]
        return d.select(*[col(c) for c in d.columns if c not in columns], *products)

    return FeatureOperation("polynomial_features", lambda df: apply, columns)


def _power(x: Column, lam: Column) -> Column:
    """(x^lam - 1) / lam with its limit log x at zero."""
    return F.when(F.abs(lam) < 1e-12, F.log(x)).otherwise((F.pow(x, lam) - 1) / lam)


def yeo_johnson(x: Column, lam: Column) -> Column:
    return F.when(x >= 0, _power(x + 1, lam)).otherwise(-_power(1 - x, 2 - lam))


def _powered(x: np.ndarray, lam: np.ndarray, yeo: bool) -> np.ndarray:
    """Transformed values, one row per exponent."""
    def power(v, exponents):
        near = np.abs(exponents) < 1e-12
        safe = np.where(near, 1.0, exponents)[:, None]
        return np.where(near[:, None], np.log(v), (np.power(v, safe) - 1) / safe)

    if not yeo:
        return power(x, lam)
    out = np.empty((len(lam), len(x)))
    high = x >= 0
    out[:, high] = power(x[high] + 1, lam)
    out[:, ~high] = -power(1 - x[~high], 2 - lam)
    return out


def likeliest_lambdas(
    df: DataFrame, columns: Sequence[str], method: str, rounds: int = 4, points: int = 41
) -> dict[str, float]:
    """Maximum-likelihood exponents of all columns by repeated grids, one scan a round.

    Every task adds up counts, sums and squares of all columns at all grid points as arrays; only
    these sums are shuffled. They are taken about the transformed mean of a column, which keeps
    their precision.
    """
    yeo = method == "yeo-johnson"
    names = list(columns)
    if not names:
        return {}
    narrow = df.select(*[as_double(c).alias(f"x{i}") for i, c in enumerate(names)])
    means = narrow.agg(*[F.avg(x) for x in narrow.columns]).first()
    span = {i: (-5.0, 5.0) for i, m in enumerate(means) if m is not None}
    best = {i: 1.0 for i in range(len(names))}
    for _ in range(rounds):
        if not span:
            break
        grids = {i: np.linspace(low, high, points) for i, (low, high) in span.items()}
        centres = {i: _powered(np.array([means[i]]), g, yeo)[:, 0] for i, g in grids.items()}

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = {i: np.zeros((4, points)) for i in grids}
            for batch in batches:
                for i, grid in grids.items():
                    x = batch[f"x{i}"].to_numpy(dtype=float)
                    x = x[~np.isnan(x)]
                    with np.errstate(all="ignore"):
                        y = _powered(x, grid, yeo) - centres[i][:, None]
                        slope = np.sign(x) * np.log1p(np.abs(x)) if yeo else np.log(x)
                        total[i] += np.stack([np.full(points, float(len(x))), y.sum(1), (y * y).sum(1),
                                              np.full(points, slope.sum())])
            for i, t in total.items():
                yield pd.DataFrame({"c": i, "g": np.arange(points), "n": t[0], "s": t[1], "q": t[2],
                                    "j": t[3]})

        parts = ("n", "s", "q", "j")
        found = narrow.mapInPandas(
            sums, "c int, g int, " + ", ".join(f"{p} double" for p in parts)
        ).groupBy("c", "g").agg(*[F.sum(p).alias(p) for p in parts]).collect()
        scores: dict[int, list[tuple[float, float]]] = {}
        for r in found:
            if not r["n"]:
                continue
            v = r["q"] / r["n"] - (r["s"] / r["n"]) ** 2
            if math.isfinite(v) and v > 0 and v > 1e-14 * r["q"] / r["n"]:
                g = float(grids[r["c"]][r["g"]])
                scores.setdefault(r["c"], []).append((-r["n"] / 2 * math.log(v) + (g - 1) * r["j"], g))
        for i in list(span):
            if i not in scores:
                del span[i]
                continue
            best[i] = max(scores[i])[1]
            step = (span[i][1] - span[i][0]) / (points - 1)
            span[i] = (best[i] - step, best[i] + step)
    return {c: best[i] for i, c in enumerate(names)}


@feature_operation("power_transform")
def power_transform(params: dict[str, Any]) -> FeatureOperation:
    columns, method = params.get("columns", []), params.get("method", "yeo-johnson")
    fixed = params.get("lambdas", {})
    if method not in ("yeo-johnson", "box-cox"):
        raise ValueError(f"power_transform: unknown method '{method}'")
    transform = yeo_johnson if method == "yeo-johnson" else _power

    def learn(df: DataFrame):
        if method == "box-cox" and columns:
            lows = df.agg(*[F.min(as_double(c)).alias(f"m{i}") for i, c in enumerate(columns)])
            if any(v is not None and v <= 0 for v in lows.first()):
                raise ValueError("power_transform: box-cox needs strictly positive values")
        def powered(c: str, lam: float) -> Column:
            return transform(as_double(c), F.lit(float(lam)))

        lambdas = {**likeliest_lambdas(df, [c for c in columns if c not in fixed], method),
                   **{c: float(fixed[c]) for c in columns if c in fixed}}
        learnt = {}
        if columns:
            shown = [powered(c, lambdas[c]) for c in columns]
            row = df.agg(*[e(y) for y in shown for e in (F.avg, F.stddev_pop)]).first()
            learnt = {c: (lambdas[c], row[2 * i], row[2 * i + 1] or 1.0)
                      for i, c in enumerate(columns)}
        return lambda d: replace_columns(
            d, {c: (powered(c, lam) - F.lit(m)) / F.lit(s) for c, (lam, m, s) in learnt.items()})

    return FeatureOperation("power_transform", learn, columns)
