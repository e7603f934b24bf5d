"""Correlation, mutual information, contingency and variance-based association measures."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.core import (
    TaskSpec,
    as_double,
    categorical_columns,
    col,
    cut_lineage,
    local_rows,
    numeric_columns,
    require_columns,
    resolve_task,
)
from tablewright.functions.expressions import interpolated_bucket
from tablewright.functions.special import f_upper_tail
from tablewright.operators.lookup import attach, build_lookup
from tablewright.operators.neighbour_information import class_information, pair_information
from tablewright.operators.order_stats import exact_quantiles, medians
from tablewright.operators.ordering import attach_ranks, average_rank, column_prefixes, value_prefix

MI_BINS = 16
INFORMATIVE = 0.01
#: Classes up to which all pairs are visited, in one task.
CLASS_BLOCK = 1_000

Pair = tuple[str, str]


def _clean(r: float | None) -> float | None:
    return None if r is None or not math.isfinite(r) else r


def _corr_of_pairs(df: DataFrame, pairs: Sequence[Pair]) -> dict[Pair, float | None]:
    """All pairs in one scan: every task multiplies its rows as matrices (values, squares and
    presence flags), which gives the pairwise-complete sums; Spark adds them per pair.

    An aggregate before it takes the mean of every column over all its values; values are shifted
    by it, so the sums keep their precision whatever the offset and wherever the gaps are.
    """
    if not pairs:
        return {}
    names = sorted({c for p in pairs for c in p})
    at = {c: i for i, c in enumerate(names)}
    first = np.array([at[a] for a, _ in pairs])
    second = np.array([at[b] for _, b in pairs])
    narrow = df.select(*[as_double(c).alias(f"x{i}") for i, c in enumerate(names)])
    means = narrow.agg(*[F.avg(f"x{i}") for i in range(len(names))]).first()
    centre = np.array([v if v is not None and math.isfinite(v) else 0.0 for v in means])

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(centre)
        total = np.zeros((3 * k, 3 * k))
        for batch in batches:
            x = batch.to_numpy(dtype=float) - centre
            present = ~np.isnan(x)
            x = np.where(present, x, 0.0)
            z = np.hstack([x, x * x, present.astype(float)])
            total += z.T @ z
        xs, sq, on = slice(0, k), slice(k, 2 * k), slice(2 * k, 3 * k)
        sums, squares = total[xs, on], total[sq, on]
        yield pd.DataFrame(
            {
                "p": np.arange(len(first)),
                "n": total[on, on][first, second],
                "sx": sums[first, second],
                "sy": sums[second, first],
                "sxx": squares[first, second],
                "syy": squares[second, first],
                "sxy": total[xs, xs][first, second],
            }
        )

    parts = ("n", "sx", "sy", "sxx", "syy", "sxy")
    schema = "p int, " + ", ".join(f"{c} double" for c in parts)
    rows = (
        narrow.mapInPandas(products, schema)
        .groupBy("p")
        .agg(*[F.sum(c).alias(c) for c in parts])
        .collect()
    )
    out: dict[Pair, float | None] = {p: None for p in pairs}
    for r in rows:
        n = r["n"]
        if n < 2:
            continue
        vx = r["sxx"] - r["sx"] ** 2 / n
        vy = r["syy"] - r["sy"] ** 2 / n
        if vx <= 1e-12 * r["sxx"] or vy <= 1e-12 * r["syy"]:
            continue
        out[pairs[r["p"]]] = _clean((r["sxy"] - r["sx"] * r["sy"] / n) / math.sqrt(vx * vy))
    return out


def pairwise_correlations(
    df: DataFrame, columns: Sequence[str], against: str | None = None
) -> dict[Pair, float | None]:
    """Pearson r of all column pairs (or of each column with ``against``), pairwise complete."""
    return _corr_of_pairs(
        df, [(c, against) for c in columns] if against else list(combinations(columns, 2))
    )


def spearman_correlations(df: DataFrame, columns: Sequence[str]) -> dict[Pair, float | None]:
    """Pearson r of average ranks; ranks are taken after dropping rows a pair cannot use.

    One job counts, by column and value, all rows and those in which each of the columns with gaps
    is present; prefix sums of these counts are the ranks of a column within the rows that any
    partner leaves. They are joined back by column, and one scan correlates all pairs, so nothing
    is shuffled once more for another pair.
    """
    names = list(columns)
    if len(names) < 2:
        return {}
    narrow = df.select(*[as_double(c).alias(f"x{i}") for i, c in enumerate(names)])
    xs = narrow.columns
    missing = narrow.agg(*[F.count(F.when(F.col(x).isNull(), 1)).alias(x) for x in xs]).first()
    gapped = [x for x in xs if missing[x]]
    prefixes = column_prefixes(narrow, [F.col(x) for x in xs], {
        f"with_{g}": F.col(g).isNotNull().cast("long") for g in gapped})

    def ranked(x: str, partner: str) -> tuple[str, Column]:
        """Name and rank of a value of ``x`` among the rows in which the partner is present."""
        if partner not in gapped:
            return f"{x}_rank", average_rank()
        before, own = F.col(f"before_with_{partner}"), F.col(f"with_{partner}")
        return f"{x}_rank_{partner}", before + (own + 1) / 2.0

    wanted: dict[str, dict[str, Column]] = {}
    pairs = {}
    for (a, x), (b, y) in combinations(list(zip(names, xs)), 2):
        ends = []
        for own, partner in ((x, y), (y, x)):
            name, rank = ranked(own, partner)
            wanted.setdefault(own, {})[name] = rank
            ends.append(name)
        pairs[(a, b)] = tuple(ends)
    rows = attach_ranks(narrow, xs, prefixes, wanted)
    found = _corr_of_pairs(rows, list(pairs.values()))
    return {p: found[ends] for p, ends in pairs.items()}


def _pairs_within(counts: DataFrame, keys: list[str]) -> float:
    grouped = counts.groupBy(*keys).agg(F.sum("n").cast("double").alias("g")) if keys else counts
    value = grouped.agg(F.sum(F.col("g") * (F.col("g") - 1) / 2)).first()[0]
    return value or 0.0


def kendall_tau(df: DataFrame, x: str, y: str, codes_per_bucket: int = 100_000) -> float | None:
    """Kendall's tau-b from counted inversions, without comparing pairs of rows.

    Rows are reduced to distinct (x, y) cells and y is coded by dense rank. Two codes first
    differ at exactly one bit, so for every bit level the cells are grouped by the higher bits and
    the ones before each zero (in x order) are a prefix sum. Groups are cut into ranges of x, so
    no window holds more than ``codes_per_bucket`` x values.
    """
    cells = cut_lineage(
        df.select(as_double(x).alias("x"), as_double(y).alias("y"))
        .where(F.col("x").isNotNull() & F.col("y").isNotNull())
        .groupBy("x", "y")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    n = cells.agg(F.sum("n")).first()[0] or 0
    if n < 2:
        return None
    coded = cells
    levels = 0
    for name in ("x", "y"):
        prefix = value_prefix(cells, F.col(name), dense=True)
        codes = prefix.table.select(
            "value", F.col("n").alias("_w"), F.col("distinct_before").alias(f"{name}_code")
        )
        lookup = build_lookup(codes, ["value"], weight="_w")
        coded = attach(coded, lookup, [name]).drop("_w")
        levels = max(int(lookup.rows) - 1, 1).bit_length()
    coded = coded.select("x_code", "y_code", "n")

    level = F.col("level")
    per_level = (
        coded.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
        .withColumn("prefix", F.expr("shiftright(y_code, level + 1)"))
        .withColumn("bit", F.expr("shiftright(y_code, level) & 1"))
        .withColumn("bucket", (F.col("x_code") / codes_per_bucket).cast("long"))
        .groupBy(level, "prefix", "bucket", "x_code")
        .agg(
            F.sum(F.col("n") * F.col("bit")).cast("double").alias("ones"),
            F.sum(F.col("n") * (1 - F.col("bit"))).cast("double").alias("zeros"),
        )
    )
    inside = (
        Window.partitionBy("level", "prefix", "bucket")
        .orderBy("x_code")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    across = (
        Window.partitionBy("level", "prefix")
        .orderBy("bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    near = (
        per_level.withColumn("seen", F.sum("ones").over(inside))
        .agg(F.sum(F.col("zeros") * F.coalesce("seen", F.lit(0.0))))
        .first()[0]
    )
    far = (
        per_level.groupBy("level", "prefix", "bucket")
        .agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
        .withColumn("seen", F.sum("ones").over(across))
        .agg(F.sum(F.col("zeros") * F.coalesce("seen", F.lit(0.0))))
        .first()[0]
    )
    discordant = (near or 0.0) + (far or 0.0)
    all_pairs = n * (n - 1) / 2
    tied_x = _pairs_within(cells, ["x"])
    tied_y = _pairs_within(cells, ["y"])
    tied_both = _pairs_within(cells.withColumn("g", F.col("n").cast("double")), [])
    scale = math.sqrt((all_pairs - tied_x) * (all_pairs - tied_y))
    if scale == 0:
        return None
    return (all_pairs - tied_x - tied_y + tied_both - 2 * discordant) / scale


def correlation_pairs(
    df: DataFrame, method: str = "pearson", columns: Sequence[str] | None = None
) -> dict[Pair, float | None]:
    if method not in ("pearson", "spearman", "kendall"):
        raise ValueError(
            f"Unsupported correlation method '{method}'. Use 'pearson', 'spearman' or 'kendall'."
        )
    names = list(columns or numeric_columns(df))
    if method == "pearson":
        return pairwise_correlations(df, names)
    if method == "spearman":
        return spearman_correlations(df, names)
    return {(a, b): kendall_tau(df, a, b) for a, b in combinations(names, 2)}


def compute_correlations(
    df: DataFrame,
    target: str,
    method: str = "pearson",
    include_matrix: bool = True,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Rows ``kind, feature_1, feature_2, correlation``.

    ``kind`` is ``target`` (feature against target), ``pair`` (each unordered pair once, strongest
    first) or ``matrix`` (every ordered pair and the diagonal; optional).
    """
    require_columns(df, [target])
    names = list(columns or numeric_columns(df))
    found = correlation_pairs(df, method, names) if len(names) > 1 else {}
    rows: list[tuple] = []
    for (a, b), r in found.items():
        if target in (a, b):
            rows.append(("target", b if a == target else a, target, r))
    pairs = [(a, b, r) for (a, b), r in found.items() if r is not None]
    rows += [("pair", a, b, r) for a, b, r in sorted(pairs, key=lambda p: -abs(p[2]))]
    if include_matrix and found:
        spread = df.agg(
            *[(F.min(as_double(c)) < F.max(as_double(c))).alias(f"s{i}")
              for i, c in enumerate(names)]
        ).first()
        for i, a in enumerate(names):
            for b in names:
                if a == b:
                    rows.append(("matrix", a, a, 1.0 if spread[f"s{i}"] else None))
                else:
                    rows.append(("matrix", a, b, found.get((a, b), found.get((b, a)))))
    return local_rows(
        df.sparkSession,
        rows,
        "kind string, feature_1 string, feature_2 string, correlation double",
    )


def _n_log_n(c: Column) -> Column:
    return F.sum(c * F.log(c.cast("double")))


def mutual_information(
    df: DataFrame,
    target: str,
    task: str = "auto",
    top_n: int = 0,
    bins: int = MI_BINS,
    features: Sequence[str] | None = None,
    method: str = "binned",
    neighbours: int = 3,
) -> DataFrame:
    """Mutual information (nats) of every feature with the target.

    ``method`` is ``binned``, the plug-in estimate, or ``neighbours``: pairs with a continuous
    column are then estimated from distances to the ``neighbours``-th neighbour, without noise on
    ties. Discrete pairs are the same in both.

    Discrete columns are used as they are (NULL is a value of its own); continuous columns, and a
    regression target, are cut at exact quantiles into ``bins`` classes after NULL was replaced by
    the median. One job counts all (feature, value, target) cells; the entropies follow from three
    independent groupings, so no window or join over cells is needed.
    """
    require_columns(df, [target])
    if method not in ("binned", "neighbours"):
        raise ValueError("method must be 'binned' or 'neighbours'")
    spec: TaskSpec = resolve_task(df, target, task)
    names = list(features or [c for c in numeric_columns(df) + categorical_columns(df)
                              if c != target])
    schema = "feature string, mi double, informative boolean"
    if not names:
        return local_rows(df.sparkSession, [], schema)
    continuous = [c for c in numeric_columns(df) if c in names]
    binned = continuous + ([target] if spec.task == "regression" else [])
    probabilities = [k / bins for k in range(1, bins)]
    if 0.5 not in probabilities:
        probabilities = sorted([*probabilities, 0.5])
    stats = exact_quantiles(df, binned, probabilities)

    def code(c: str) -> Column:
        if c in stats:
            fill = stats[c].quantile(0.5)
            edges = sorted({stats[c].quantile(k / bins) for k in range(1, bins)})
            filled = F.coalesce(as_double(c), F.lit(0.0 if c == target else fill))
            return interpolated_bucket(filled, edges, "right").cast("string")
        if c == target and c in numeric_columns(df):
            return F.coalesce(as_double(c), F.lit(0.0)).cast("string")
        return F.coalesce(col(c).cast("string"), F.lit("\u0000null"))

    estimated: dict[str, float] = {}
    if method == "neighbours":
        estimated = _neighbour_estimates(df, names, target, spec, stats, code, neighbours)
    names_left = [c for c in names if c not in estimated]
    scored = [] if not names_left else _plug_in(df, names_left, target, code)
    scored = sorted([*scored, *estimated.items()], key=lambda s: (-s[1], s[0]))
    if top_n > 0:
        scored = scored[:top_n]
    return local_rows(
        df.sparkSession, [(c, s, round(s, 4) > INFORMATIVE) for c, s in scored], schema
    )


def _neighbour_estimates(df, names, target, spec, stats, code, k: int) -> dict[str, float]:
    """Estimates of the features that are continuous or have a continuous target."""
    def filled(c: str) -> Column:
        return F.coalesce(as_double(c), F.lit(0.0 if c == target else stats[c].quantile(0.5)))

    regression = spec.task == "regression"
    if regression:
        mixed = [c for c in names if c not in stats]
        entries = [F.struct(F.lit(i).alias("f"), code(c).alias("c"), filled(target).alias("v"))
                   for i, c in enumerate(mixed)]
    else:
        mixed = [c for c in names if c in stats]
        entries = [F.struct(F.lit(i).alias("f"), code(target).alias("c"), filled(c).alias("v"))
                   for i, c in enumerate(mixed)]
    out: dict[str, float] = {}
    if mixed:
        found = class_information(df.select(F.inline(F.array(*entries))), k)
        out = {c: found.get(i, 0.0) for i, c in enumerate(mixed)}
    if regression:
        for c in (c for c in names if c in stats):
            out[c] = pair_information(df, filled(c), filled(target), k)
    return out


def _plug_in(df: DataFrame, names: list[str], target: str, code) -> list[tuple[str, float]]:
    """Entropies of the (feature, value, target) cells, for all features in one job."""
    y = code(target).alias("y")
    entries = F.array(
        *[F.struct(F.lit(i).alias("f"), code(c).alias("x")) for i, c in enumerate(names)]
    )
    cells = (
        df.select(y, F.inline(entries)).groupBy("f", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    )
    n = F.col("n")
    joint = cells.groupBy("f").agg(_n_log_n(n).alias("hxy"), F.sum(n).alias("total"))
    by_x = cells.groupBy("f", "x").agg(F.sum(n).alias("n")).groupBy("f").agg(
        _n_log_n(n).alias("hx"))
    by_y = cells.groupBy("f", "y").agg(F.sum(n).alias("n")).groupBy("f").agg(
        _n_log_n(n).alias("hy"))
    total = F.col("total").cast("double")
    mi = F.log(total) + (F.col("hxy") - F.col("hx") - F.col("hy")) / total
    rows = (
        joint.join(by_x, "f").join(by_y, "f").select("f", F.greatest(mi, F.lit(0.0)).alias("mi"))
    ).collect()
    return [(names[r["f"]], r["mi"]) for r in rows]


def cramers_v(df: DataFrame, target: str | None = None) -> DataFrame:
    """Cramer's V of categorical pairs, with the continuity correction for 2 x 2 tables.

    The statistic only needs the occupied cells: chi2 = n * (sum o^2 / (row * column) - 1). For a
    2 x 2 table the deviation from independence is the same in all four cells, so the corrected
    value follows from the same sums.
    """
    if target:
        require_columns(df, [target])
    names = categorical_columns(df)
    if target in names:
        pairs = [(c, target) for c in names if c != target]
    else:
        pairs = list(combinations(names, 2))
    schema = "feature_1 string, feature_2 string, cramers_v double"
    if not pairs:
        return local_rows(df.sparkSession, [], schema)
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("p"),
                col(a).cast("string").alias("a"),
                col(b).cast("string").alias("b"),
            )
            for i, (a, b) in enumerate(pairs)
        ]
    )
    cells = (
        df.select(F.inline(entries))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull())
        .groupBy("p", "a", "b")
        .agg(F.count(F.lit(1)).alias("o"))
    )
    by_a = cells.groupBy("p", "a").agg(F.sum("o").alias("na"))
    by_b = cells.groupBy("p", "b").agg(F.sum("o").alias("nb"))
    o, na, nb = (F.col(c).cast("double") for c in ("o", "na", "nb"))
    core = (
        cells.join(by_a, ["p", "a"])
        .join(by_b, ["p", "b"])
        .groupBy("p")
        .agg(F.sum(o * o / (na * nb)).alias("phi1"), F.sum("o").cast("double").alias("n"))
    )
    rows_a = by_a.groupBy("p").agg(
        F.count(F.lit(1)).alias("ra"), F.sum(1 / na).alias("inv_a"))
    rows_b = by_b.groupBy("p").agg(
        F.count(F.lit(1)).alias("rb"), F.sum(1 / nb).alias("inv_b"))
    n, smaller = F.col("n"), F.least("ra", "rb")
    chi2 = F.greatest(n * (F.col("phi1") - 1), F.lit(0.0))
    inverse = n * F.col("inv_a") * F.col("inv_b")
    deviation = F.sqrt(chi2 / inverse)
    corrected = F.pow(deviation - F.least(deviation, F.lit(0.5)), 2) * inverse
    two_by_two = (F.col("ra") == 2) & (F.col("rb") == 2)
    v = F.sqrt(F.when(two_by_two, corrected).otherwise(chi2) / (n * (smaller - 1)))
    label = F.create_map(
        *[x for i, p in enumerate(pairs) for x in (F.lit(i), F.array(F.lit(p[0]), F.lit(p[1])))]
    )
    return (
        core.join(rows_a, "p")
        .join(rows_b, "p")
        .where(smaller >= 2)
        .select(
            label[F.col("p")][0].alias("feature_1"),
            label[F.col("p")][1].alias("feature_2"),
            v.alias("cramers_v"),
        )
    )


def fill_with_medians(df: DataFrame, columns: Sequence[str], keep: Sequence[Column]) -> DataFrame:
    middle = medians(df, columns)
    return df.select(
        *keep, *[F.coalesce(as_double(c), F.lit(middle[c])).alias(c) for c in columns]
    )


def _class_key(df: DataFrame, target: str) -> Column:
    """Grouping key of a target; a missing class is a class, a missing number counts as 0."""
    if target in numeric_columns(df):
        return F.coalesce(as_double(target), F.lit(0.0))
    return col(target)


def anova_scores(df: DataFrame, target: str) -> DataFrame:
    """One-way ANOVA F and p of every numeric feature across the target classes."""
    require_columns(df, [target])
    names = numeric_columns(df, exclude=[target])
    schema = "feature string, f_statistic double, p_value double, significant boolean"
    if not names:
        return local_rows(df.sparkSession, [], schema)
    filled = fill_with_medians(df, names, [_class_key(df, target).alias("_class")])
    means = filled.agg(*[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(names)]).first()
    per_class = filled.groupBy("_class").agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        *[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(names)],
        *[F.var_pop(col(c)).alias(f"v{i}") for i, c in enumerate(names)],
    )
    n = F.col("n")
    sums = per_class.agg(
        F.sum(n).alias("n"),
        F.count(F.lit(1)).alias("k"),
        *[
            F.sum(n * F.pow(F.col(f"m{i}") - F.lit(means[f"m{i}"]), 2)).alias(f"b{i}")
            for i in range(len(names))
        ],
        *[F.sum(n * F.col(f"v{i}")).alias(f"w{i}") for i in range(len(names))],
    ).first()
    rows = []
    for i, c in enumerate(names):
        df1, df2 = sums["k"] - 1, sums["n"] - sums["k"]
        between, within = sums[f"b{i}"], sums[f"w{i}"]
        if df1 < 1 or df2 < 1 or within == 0:
            rows.append((c, None, None, False))
            continue
        f = (between / df1) / (within / df2)
        p = f_upper_tail(f, df1, df2)
        rows.append((c, f, p, p < 0.05))
    rows.sort(key=lambda r: (-(r[1] or 0.0), r[0]))
    return local_rows(df.sparkSession, rows, schema)


def variance_inflation(df: DataFrame, target: str, top_n: int | None = None) -> DataFrame:
    """Variance inflation factor per numeric feature from the k x k correlation matrix.

    ``top_n`` restricts it to the features of largest variance.
    """
    require_columns(df, [target])
    names = numeric_columns(df, exclude=[target])
    schema = "feature string, vif double, high boolean, severe boolean"
    if len(names) < 2:
        return local_rows(df.sparkSession, [], schema)
    filled = fill_with_medians(df, names, [])
    row = filled.agg(*[F.var_pop(col(c)).alias(f"v{i}") for i, c in enumerate(names)]).first()
    variance = {c: row[f"v{i}"] or 0.0 for i, c in enumerate(names)}
    names = sorted(names, key=lambda c: -variance[c])[:top_n]
    found = pairwise_correlations(filled, names)
    k = len(names)
    matrix = np.eye(k)
    for i in range(k):
        for j in range(i + 1, k):
            r = found.get((names[i], names[j]))
            matrix[i, j] = matrix[j, i] = r if r is not None else 0.0
    rows = []
    for i, c in enumerate(names):
        if variance[c] == 0:
            rows.append((c, float("inf"), True, True))
            continue
        others = [j for j in range(k) if j != i and variance[names[j]] > 0]
        r = matrix[i, others]
        explained = float(r @ np.linalg.pinv(matrix[np.ix_(others, others)]) @ r)
        vif = 1.0 / (1.0 - min(explained, 0.9999))
        rows.append((c, vif, vif > 10, vif > 50))
    rows.sort(key=lambda r: (-r[1], r[0]))
    return local_rows(df.sparkSession, rows, schema)


def _ratio_sums(moments: tuple) -> tuple[float, int]:
    """Sum and number of Fisher ratios between all pairs of classes.

    The classes are given as (count, mean, variance); pairs without two rows each or without
    variance do not count.
    """
    n, m, v = moments
    total, pairs = 0.0, 0
    for i in range(len(n)):
        rest = slice(i + 1, None)
        spread = v[i] + v[rest]
        usable = (n[i] >= 2) & (n[rest] >= 2) & (spread > 0)
        gap = (m[i] - m[rest]) ** 2
        total += float((gap[usable] / spread[usable]).sum())
        pairs += int(usable.sum())
    return total, pairs


def separability(df: DataFrame, target: str, block: int = CLASS_BLOCK) -> DataFrame:
    """Fisher ratio per feature, averaged over class pairs.

    The class moments stay a table. Up to ``block`` classes meet pair by pair in one task; above,
    the sums over all pairs come from sums over the classes (:func:`_pair_sums`), so the work grows
    with the classes and not with their pairs, and the number of classes has no limit.
    """
    require_columns(df, [target])
    names = numeric_columns(df, exclude=[target])
    schema = "feature string, separability double"
    if not names:
        return local_rows(df.sparkSession, [], schema)
    per_class = cut_lineage(
        df.where(col(target).isNotNull())
        .groupBy(col(target).alias("_class"))
        .agg(
            *[F.count(as_double(c)).alias(f"n{i}") for i, c in enumerate(names)],
            *[F.avg(as_double(c)).alias(f"m{i}") for i, c in enumerate(names)],
            *[F.var_samp(as_double(c)).alias(f"v{i}") for i, c in enumerate(names)],
        )
        .drop("_class")
    )

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        moments = [
            (rows[f"n{f}"].to_numpy(), rows[f"m{f}"].to_numpy(dtype=float),
             rows[f"v{f}"].to_numpy(dtype=float)) for f in range(len(names))]
        found = [(f, *_ratio_sums(m)) for f, m in enumerate(moments)]
        return pd.DataFrame(found, columns=["f", "total", "pairs"])

    if per_class.count() <= block:
        sums = per_class.groupBy().applyInPandas(meet, "f int, total double, pairs long").collect()
        rows = [(names[r["f"]], r["total"] / r["pairs"]) for r in sums if r["pairs"]]
    else:
        sums = _pair_sums(per_class, len(names))
        rows = [(names[f], total / pairs) for f, (total, pairs) in sums.items() if pairs]
    rows.sort(key=lambda r: (-r[1], r[0]))
    return local_rows(df.sparkSession, rows, schema)


def _rates(low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights c and rates t with sum(c exp(-t s)) = 1 / s for s from ``low`` to ``high``.

    1 / s is the integral of exp(u - s exp(u)) over u. The trapezoid rule with step h is off by
    about exp(-pi^2 / h), which is 1e-16 here; what is left of the first point, where the inner
    exponential is 1 to within 1e-14, is a geometric series and one term of rate zero.
    """
    h = 0.25
    first, last = math.log(1e-7) - math.log(high), math.log(40.0) - math.log(low)
    u = first + h * np.arange(math.ceil((last - first) / h) + 1)
    return np.r_[h * math.exp(first) / math.expm1(h), h * np.exp(u)], np.r_[0.0, np.exp(u)]


def _pair_sums(per_class: DataFrame, features: int) -> dict[int, tuple[float, int]]:
    """By feature: sum and number of the Fisher ratios of all class pairs.

    A ratio is (m - m')^2 / (v + v'). With 1 / (v + v') as a sum of c exp(-t v) exp(-t v'), the
    pairs of one rate t add up to (sum of weights) x (weighted squared deviations of the means),
    the weights being exp(-t v). Classes without variance are kept apart, as their pairs with each
    other do not count; a task returns a row per feature and rate.
    """
    usable = [(F.col(f"n{f}") >= 2) & F.col(f"v{f}").isNotNull() & ~F.isnan(f"v{f}")
              for f in range(features)]
    flat = F.array(*[
        F.struct(F.lit(f).alias("f"), F.col(f"m{f}").alias("m"), F.col(f"v{f}").alias("v"))
        for f in range(features)])
    rows = per_class.select(F.inline(F.filter(F.transform(
        F.arrays_zip(flat.alias("x"), F.array(*usable).alias("y")),
        lambda z: F.when(z["y"], z["x"])), lambda z: z.isNotNull())))
    moving = F.when(F.col("v") > 0, F.col("v"))
    ranges = {r["f"]: r for r in rows.groupBy("f").agg(
        F.min(moving).alias("low"), F.max(moving).alias("high"),
        F.count(moving).alias("some"), F.count(F.lit(1)).alias("n")).collect()}
    rates = {f: _rates(r["low"], 2 * r["high"]) for f, r in ranges.items() if r["some"]}

    def merge(a: list, w: np.ndarray, m: np.ndarray, d: np.ndarray) -> list:
        """Weights, weighted means and squared deviations of two sets of classes together."""
        total = a[0] + w
        part = np.divide(w, total, out=np.zeros_like(total), where=total > 0)
        gap = m - a[1]
        return [total, a[1] + gap * part, a[2] + d + gap * gap * a[0] * part]

    def moments(weights: np.ndarray, m: np.ndarray) -> tuple:
        w = weights.sum(1)
        mean = np.divide(weights @ m, w, out=np.zeros_like(w), where=w > 0)
        return w, mean, (weights * (m[None, :] - mean[:, None]) ** 2).sum(1)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for batch in batches:
            for f, own in batch.groupby("f"):
                if f not in rates:
                    continue
                t = rates[f][1]
                m, v = own["m"].to_numpy(dtype=float), own["v"].to_numpy(dtype=float)
                state = held.setdefault(f, [np.zeros(len(t) + 1) for _ in range(3)])
                step = max(1, (1 << 20) // len(t))
                for i in range(0, len(v), step):
                    x, y = v[i : i + step], m[i : i + step]
                    still = (x == 0).astype(float)[None, :]  # the last row: classes without variance
                    weights = np.r_[np.exp(-t[:, None] * x[None, :]) * (1 - still), still]
                    state = merge(state, *moments(weights, y))
                held[f] = state
        for f, (w, m, d) in held.items():
            yield pd.DataFrame({"f": f, "j": np.arange(len(w)), "w": w, "m": m, "d": d})

    parts = rows.mapInPandas(add, "f int, j int, w double, m double, d double")
    both = cut_lineage(parts)
    means = both.groupBy("f", "j").agg(
        F.sum("w").alias("total"), F.sum(F.col("w") * F.col("m")).alias("wm"))
    centred = both.join(means.withColumn("mean", F.when(
        F.col("total") > 0, F.col("wm") / F.col("total")).otherwise(0.0)), ["f", "j"])
    whole = centred.groupBy("f", "j").agg(
        F.first("total").alias("w"), F.first("mean").alias("m"),
        F.sum(F.col("d") + F.col("w") * (F.col("m") - F.col("mean")) ** 2).alias("d"),
    ).orderBy("f", "j").toPandas()
    found = {}
    for f, r in ranges.items():
        some, still = r["some"], r["n"] - r["some"]
        pairs = some * (some - 1) // 2 + some * still
        total = 0.0
        if f in rates:
            own = whole[whole["f"] == f]
            w, m, d = (own[x].to_numpy() for x in ("w", "m", "d"))
            moved = w[:-1] * w[-1] * (m[:-1] - m[-1]) ** 2 + w[-1] * d[:-1] + w[:-1] * d[-1]
            total = float((rates[f][0] * (w[:-1] * d[:-1] + moved)).sum())
        found[f] = (total, pairs)
    return found


def separability_summary(df: DataFrame, target: str) -> DataFrame:
    """Mean separability and the difficulty it stands for."""
    scores = separability(df, target)
    classes = df.agg(F.count_distinct(col(target)).alias("n_classes"))
    mean = F.coalesce(F.avg(F.round("separability", 4)), F.lit(0.0))
    level = (
        F.when(F.col("n_classes") < 2, "trivial")
        .when(F.col("mean_separability") > 2.0, "easy")
        .when(F.col("mean_separability") > 0.5, "moderate")
        .when(F.col("mean_separability") > 0.1, "hard")
        .otherwise("very_hard")
    )
    # both sides are single rows
    return (
        scores.agg(mean.alias("mean_separability"))
        .withColumn("k", F.lit(1))
        .join(classes.withColumn("k", F.lit(1)), "k")
        .drop("k")
        .withColumn("difficulty", level)
    )


def missing_patterns(df: DataFrame, top: int | None = None) -> DataFrame:
    """Correlation of missingness with observed numeric columns, strongest first.

    Every row also carries the overall verdict (``pattern``) and the largest absolute correlation.
    A table without missing values gives no rows; see ``missing_pattern`` for the verdict alone.
    """
    pattern, strongest, rows = _missing_correlations(df)
    kept = [r for r in rows if abs(r[2]) > 0.1]
    kept.sort(key=lambda r: (-abs(r[2]), r[0], r[1]))
    return local_rows(
        df.sparkSession,
        [(*r, pattern, strongest) for r in kept[:top]],
        "missing_column string, correlated_with string, correlation double, pattern string, "
        "max_correlation double",
    )


def missing_pattern(df: DataFrame) -> str:
    return _missing_correlations(df)[0]


def _missing_correlations(df: DataFrame) -> tuple[str, float, list[tuple[str, str, float]]]:
    names = numeric_columns(df) + categorical_columns(df)
    numeric = numeric_columns(df)
    shares = df.agg(
        *[F.avg(col(c).isNull().cast("double")).alias(f"m{i}") for i, c in enumerate(names)]
    ).first()
    gappy = [c for i, c in enumerate(names) if 0 < (shares[f"m{i}"] or 0) < 1]
    if not any((shares[f"m{i}"] or 0) > 0 for i in range(len(names))):
        return "none", 0.0, []
    pairs = [(a, b) for a in gappy for b in numeric if a != b]
    flagged = df.select(
        *[as_double(b).alias(b) for b in numeric],
        *[col(a).isNull().cast("double").alias(f"{a}__missing") for a in gappy],
    )
    found = _corr_of_pairs(flagged, [(f"{a}__missing", b) for a, b in pairs])
    observed = flagged.agg(*[F.count(col(b)).alias(f"n{i}") for i, b in enumerate(numeric)]).first()
    enough = {b for i, b in enumerate(numeric) if observed[f"n{i}"] >= 10}
    rows = [
        (a, b, r)
        for (a, b) in pairs
        if (r := found[(f"{a}__missing", b)]) is not None and b in enough
    ]
    strongest = max((abs(r[2]) for r in rows), default=0.0)
    pattern = "MCAR" if strongest < 0.1 else "MAR" if strongest < 0.5 else "MNAR"
    return pattern, strongest, rows
