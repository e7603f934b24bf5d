"""Operations that learn a table: encodings, group statistics, ranks, bins."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.core import as_double, col, cut_lineage
from tablewright.functions.expressions import interpolated_bucket
from tablewright.operators.features.base import FeatureOperation, feature_operation
from tablewright.operators.features.scalar import replace_columns
from tablewright.operators.lookup import Lookup, attach, build_lookup
from tablewright.operators.order_stats import exact_quantiles
from tablewright.operators.ordering import (
    add_ranks,
    average_rank,
    global_row_index,
    value_prefix,
)

MAX_INDICATORS = 2_000
SORT_IN_ONE_TASK = 100_000


def distinct_values(df: DataFrame, column: str, limit: int) -> list | None:
    """Sorted distinct values, or None when there are more than ``limit``."""
    values = (
        df.select(col(column).alias("v")).where(F.col("v").isNotNull()).distinct().limit(limit + 1)
    ).collect()
    return None if len(values) > limit else sorted(r["v"] for r in values)


@feature_operation("one_hot_encode")
def one_hot_encode(params: dict[str, Any]) -> FeatureOperation:
    """Indicator columns ``<column>_<value>``; ``sparse=True`` makes one vector per column."""
    columns, sparse = params.get("columns", []), params.get("sparse", False)

    def learn(df: DataFrame):
        if sparse:
            indexed = [f"_{c}_index" for c in columns]
            indexer = StringIndexer(
                inputCols=columns, outputCols=indexed, handleInvalid="keep",
                stringOrderType="alphabetAsc",
            ).fit(df)
            encoder = OneHotEncoder(
                inputCols=indexed, outputCols=[f"{c}_vec" for c in columns], dropLast=False
            ).fit(indexer.transform(df))
            return lambda d: encoder.transform(indexer.transform(d)).drop(*columns, *indexed)
        values = {}
        for c in columns:
            values[c] = distinct_values(df, c, MAX_INDICATORS)
            if values[c] is None:
                raise ValueError(
                    f"one_hot_encode: '{c}' has more than {MAX_INDICATORS} values; "
                    "use sparse=True"
                )
        return lambda d: d.select(*[col(c) for c in d.columns if c not in columns], *[
            F.coalesce((col(c) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}_{v}")
            for c in columns
            for v in values[c]
        ])

    return FeatureOperation("one_hot_encode", learn, columns)


def text_form(c: Column) -> Column:
    """Value as text; a missing value is the category ``nan``."""
    return F.coalesce(c.cast("string"), F.lit("nan"))


def string_codes(df: DataFrame, text: Column, in_one_task: int = SORT_IN_ONE_TASK) -> Lookup:
    """Distinct texts numbered from 0 in lexicographic order.

    A distinct list measured to be small is numbered in one task; a longer one is range-sorted.
    """
    counted = cut_lineage(
        df.select(text.alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("_w"))
    )
    if counted.count() <= in_one_task:
        w = Window.partitionBy(F.lit(0)).orderBy("text")
        coded = counted.withColumn("code", F.row_number().over(w).cast("long") - 1)
    else:
        coded = global_row_index(counted, [F.col("text")]).table.withColumnRenamed(
            "row_index", "code"
        ).drop("part")
    return build_lookup(coded.select("text", "code", "_w"), ["text"], weight="_w")


def _with_codes(d: DataFrame, text: Column, lookup: Lookup, name: str) -> DataFrame:
    keyed = attach(d.withColumn("_text", text), lookup, ["_text"])
    return keyed.withColumn(name, F.col("code")).drop("_text", "code", "_w")


@feature_operation("label_encode")
def label_encode(params: dict[str, Any]) -> FeatureOperation:
    columns = params.get("columns", [])

    def learn(df: DataFrame):
        codes = {c: string_codes(df, text_form(col(c))) for c in columns}

        def apply(d: DataFrame) -> DataFrame:
            order = d.columns
            for c in columns:
                d = _with_codes(d, text_form(col(c)), codes[c], c)
            return d.select(*[col(c) for c in order])

        return apply

    return FeatureOperation("label_encode", learn, columns)


@feature_operation("categorical_interaction")
def categorical_interaction(params: dict[str, Any]) -> FeatureOperation:
    columns = params.get("columns", [])
    if len(columns) != 2:
        raise ValueError("categorical_interaction requires exactly 2 columns.")
    a, b = columns

    def text() -> Column:
        return F.concat(text_form(col(a)), F.lit("_"), text_form(col(b)))

    def learn(df: DataFrame):
        codes = string_codes(df, text())
        return lambda d: _with_codes(d, text(), codes, f"{a}_x_{b}")

    return FeatureOperation("categorical_interaction", learn, columns)


def smoothed_mean(mean: Column, count: Column, overall: Column, smoothing: float) -> Column:
    weight = 1 / (1 + F.exp(-(count - 1) / F.lit(float(smoothing))))
    return overall * (1 - weight) + mean * weight


@feature_operation("target_encode")
def target_encode(params: dict[str, Any]) -> FeatureOperation:
    """Smoothed mean of the target per category.

    With ``fold_column`` every row is encoded from the rows of the other folds (statistics of all
    rows minus those of its own fold), which keeps the target of a row out of its own feature.
    Rows of other tables, without that column or with an unknown fold, get the value of all rows.
    """
    columns, target = params.get("columns", []), params.get("target_column", "")
    smoothing, fold = params.get("smoothing", 10), params.get("fold_column")

    def learn(df: DataFrame):
        y = as_double(target)
        overall = df.agg(F.avg(y)).first()[0]
        tables, whole = {}, {}
        for c in columns:
            rows = df.where(col(c).isNotNull())
            stats = rows.groupBy(col(c).alias("key")).agg(
                F.avg(y).alias("mean"), F.count(y).alias("n"), F.count(F.lit(1)).alias("_w")
            )
            value = smoothed_mean(F.col("mean"), F.col("n"), F.lit(overall), smoothing)
            whole[c] = build_lookup(
                stats.select("key", value.alias("_all"), "_w"), ["key"], weight="_w"
            )
            if not fold:
                continue
            per_fold = rows.groupBy(col(c).alias("key"), col(fold).alias("fold")).agg(
                F.sum(y).alias("s"), F.count(y).alias("n"), F.count(F.lit(1)).alias("_w")
            )
            total = per_fold.groupBy("key").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
            by_fold = (
                df.groupBy(col(fold).alias("fold"))
                .agg(F.sum(y).alias("fs"), F.count(y).alias("fn"))
            )
            sums = df.agg(F.sum(y).alias("s"), F.count(y).alias("n")).first()
            rest_n = F.col("tn") - F.col("n")
            rest_mean = (F.col("ts") - F.coalesce("s", F.lit(0.0))) / rest_n
            rest_overall = (F.lit(sums["s"]) - F.col("fs")) / (F.lit(sums["n"]) - F.col("fn"))
            value = F.when(
                rest_n > 0, smoothed_mean(rest_mean, rest_n, rest_overall, smoothing)
            ).otherwise(rest_overall)
            joined = per_fold.join(total, "key").join(by_fold, "fold")
            tables[c] = build_lookup(
                joined.select("key", "fold", value.alias("_enc"), "_w"), ["key", "fold"],
                weight="_w",
            )

        def apply(d: DataFrame) -> DataFrame:
            order = d.columns
            for c in columns:
                d = attach(d, whole[c], [c]).drop("_w")
                best = F.col("_all")
                if fold and fold in order:
                    d = attach(d, tables[c], [c, fold]).drop("_w")
                    best = F.coalesce("_enc", best)
                d = d.withColumn(c, best).drop("_all", "_enc")
            return d.select(*[col(c) for c in order])

        return apply

    wanted = [*columns, target, *([fold] if fold else [])]
    return FeatureOperation("target_encode", learn, wanted)


@feature_operation("frequency_encode")
def frequency_encode(params: dict[str, Any]) -> FeatureOperation:
    columns = params.get("columns", [])

    def learn(df: DataFrame):
        tables = {
            c: build_lookup(
                df.where(col(c).isNotNull())
                .groupBy(col(c).alias("key"))
                .agg(F.count(F.lit(1)).alias("_freq")),
                ["key"],
                weight="_freq",
            )
            for c in columns
        }

        def apply(d: DataFrame) -> DataFrame:
            order = d.columns
            for c in columns:
                d = attach(d, tables[c], [c])
                d = d.withColumn(c, F.col("_freq")).drop("_freq")
            return d.select(*[col(c) for c in order])

        return apply

    return FeatureOperation("frequency_encode", learn, columns)


_AGGREGATES = {
    "mean": F.avg, "std": F.stddev_samp, "count": F.count, "min": F.min, "max": F.max,
}


@feature_operation("groupby_aggregate")
def groupby_aggregate(params: dict[str, Any]) -> FeatureOperation:
    """A statistic of a group; ``more`` lists further ones of the same group, all joined at once."""
    group, wanted = params.get("group_column", ""), []
    for own in [params, *params.get("more", [])]:
        value, func = own.get("agg_column", ""), own.get("agg_func", "mean")
        if func not in _AGGREGATES:
            raise ValueError(
                f"groupby_aggregate: unknown agg_func '{func}'. Use one of {sorted(_AGGREGATES)}."
            )
        wanted.append((value, func, own.get("new_name", f"{group}_{func}_{value}")))

    def learn(df: DataFrame):
        stats = (
            df.where(col(group).isNotNull())
            .groupBy(col(group).alias("key"))
            .agg(*[_AGGREGATES[func](col(value)).alias(f"_stat{i}")
                   for i, (value, func, _) in enumerate(wanted)], F.count(F.lit(1)).alias("_w"))
        )
        table = build_lookup(stats, ["key"], weight="_w")

        def apply(d: DataFrame) -> DataFrame:
            d = attach(d, table, [group]).drop("_w")
            for i, (_, _, name) in enumerate(wanted):
                d = d.withColumnRenamed(f"_stat{i}", name)
            return d

        return apply

    return FeatureOperation("groupby_aggregate", learn, [group, *[v for v, _, _ in wanted]])


@feature_operation("rank_transform")
def rank_transform(params: dict[str, Any]) -> FeatureOperation:
    """Average rank over the whole column, without an unpartitioned window."""
    columns = params.get("columns", [])

    def learn(df: DataFrame):
        tables: dict[str, Lookup] = {}

        def ranks_elsewhere(d: DataFrame, c: str) -> DataFrame:
            """Ranks the training values had, for a table other than the training table."""
            if c not in tables:
                ranks = value_prefix(df, col(c)).table.select(
                    "value", average_rank().alias("_rank"), F.col("n").alias("_w")
                )
                tables[c] = build_lookup(ranks, ["value"], weight="_w")
            keyed = attach(d.withColumn("_value", as_double(c)), tables[c], ["_value"])
            return keyed.drop("_w", "_value")

        def apply(d: DataFrame) -> DataFrame:
            order, same = d.columns, d is df or d.sameSemantics(df)
            if same:
                d = add_ranks(d, {c: f"_rank_{c}" for c in columns})
                return d.select(*[col(f"_rank_{c}").alias(c) if c in columns else col(c) for c in order])
            for c in columns:
                d = ranks_elsewhere(d, c).withColumn(c, F.col("_rank")).drop("_rank")
            return d.select(*[col(c) for c in order])

        return apply

    return FeatureOperation("rank_transform", learn, columns)


def one_dimensional_kmeans(
    df: DataFrame, column: str, k: int, low: float, high: float, iterations: int = 300
) -> list[float]:
    """Sorted centres of Lloyd's algorithm on one column, started at uniform bin centres.

    In one dimension the clusters are intervals, so every round is one small aggregate over the
    distinct values, which are reduced once beforehand.
    """
    values = cut_lineage(
        df.select(as_double(column).alias("x"))
        .where(F.col("x").isNotNull())
        .groupBy("x")
        .agg(F.count(F.lit(1)).cast("double").alias("w"))
    )
    width = (high - low) / k
    centres = [low + width * (i + 0.5) for i in range(k)]
    for _ in range(iterations):
        edges = [(a + b) / 2 for a, b in zip(centres, centres[1:])]
        found = {
            r["b"]: r["m"]
            for r in values.groupBy(interpolated_bucket(F.col("x"), edges, "left").alias("b"))
            .agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("m"))
            .collect()
        }
        moved = sorted(found.get(i, c) for i, c in enumerate(centres))
        if max(abs(a - b) for a, b in zip(moved, centres)) <= 1e-9 * (high - low):
            return moved
        centres = moved
    return centres


def bin_edges(df: DataFrame, columns: Sequence[str], n_bins: int, strategy: str) -> dict:
    """Inner bin edges per column; bins narrower than 1e-8 are merged."""
    if strategy not in ("quantile", "uniform", "kmeans"):
        raise ValueError(f"bin_numeric: unknown strategy '{strategy}'")
    probabilities = [k / n_bins for k in range(n_bins + 1)]
    stats = exact_quantiles(df, columns, probabilities if strategy == "quantile" else [])
    out = {}
    for c in columns:
        s = stats[c]
        if s.n == 0:
            out[c] = []
            continue
        if strategy == "quantile":
            edges = [s.quantile(p) for p in probabilities]
        elif strategy == "uniform" or s.minimum == s.maximum:
            step = (s.maximum - s.minimum) / n_bins
            edges = [s.minimum + i * step for i in range(n_bins)] + [s.maximum]
        else:
            centres = one_dimensional_kmeans(df, c, n_bins, s.minimum, s.maximum)
            middle = [(a + b) / 2 for a, b in zip(centres, centres[1:])]
            edges = [s.minimum, *middle, s.maximum]
        kept = edges[:1]
        for e in edges[1:]:
            if strategy == "uniform" or e - kept[-1] > 1e-8:
                kept.append(e)
        out[c] = kept[1:-1]
    return out


@feature_operation("bin_numeric")
def bin_numeric(params: dict[str, Any]) -> FeatureOperation:
    columns, n_bins = params.get("columns", []), params.get("n_bins", 5)
    strategy = params.get("strategy", "quantile")

    def learn(df: DataFrame):
        edges = bin_edges(df, columns, n_bins, strategy)
        return lambda d: replace_columns(d, {
            c: interpolated_bucket(as_double(c), edges[c], "left").cast("double") for c in columns
        })

    return FeatureOperation("bin_numeric", learn, columns)
