"""Missing features for tree learners: each feature sends its gaps to one side, learned from folds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.core import as_double
from tablewright.operators.order_stats import exact_quantiles

BINS = 32
BELOW, ABOVE = "below", "above"


def present(feature: str) -> Column:
    """The value as a double; NaN is missing too."""
    value = as_double(feature)
    return F.when(~F.isnan(value), value)


@dataclass
class GapDirections:
    """Side, stand-in value and number of gaps of each feature; ``fill`` is a plain projection."""

    side: dict[str, str]
    value: dict[str, float]
    gaps: dict[str, int]

    def fill(self, df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
        """Put the stand-in for each gap; ``names`` gives the columns if they are called otherwise."""
        names = names or {f: f for f in self.side}
        return df.withColumns(
            {names[f]: F.coalesce(present(names[f]), F.lit(v)) for f, v in self.value.items()})


def _best_split(left: np.ndarray, left_n: np.ndarray, all_: np.ndarray, n: float) -> int:
    """Last bin on the left of the split that explains most."""
    right, right_n = all_ - left, n - left_n
    gain = ((left**2).sum(axis=1) / np.maximum(left_n, 1e-300)
            + (right**2).sum(axis=1) / np.maximum(right_n, 1e-300))
    gain[(left_n <= 0) | (right_n <= 0)] = -np.inf
    return int(gain.argmax())


def _fold_loss(n: np.ndarray, sums: np.ndarray, squares: np.ndarray, order: list[int]) -> float:
    """Squared error on each fold of a one-split tree fitted on the others; bins in ``order``.

    ``n`` is folds x bins, ``sums`` has the label's sum (or one column of counts for each class).
    """
    n, sums, squares = n[:, order], sums[:, order], squares[:, order]
    loss = 0.0
    for k in range(len(n)):
        rest_n, rest = n.sum(axis=0) - n[k], sums.sum(axis=0) - sums[k]
        left_n, left = np.cumsum(rest_n), np.cumsum(rest, axis=0)
        if not left_n[-1]:
            continue
        cut = _best_split(left, left_n, left[-1], left_n[-1]) + 1
        for part in (slice(0, cut), slice(cut, None)):
            total = rest_n[part].sum()
            mean = rest[part].sum(axis=0) / total if total else left[-1] / left_n[-1]
            held, held_n = sums[k, part].sum(axis=0), n[k, part].sum()
            loss += squares[k, part].sum() - 2 * float(mean @ held) + held_n * float(mean @ mean)
    return loss


def learn_directions(
    df: DataFrame, features: Sequence[str], classification: bool, label: str = "label",
    fold: str = "fold", bins: int = BINS,
) -> GapDirections:
    """Whether the gaps of a feature belong below or above all its values, by fold score.

    The values of a feature with gaps are cut into ``bins`` quantile ranges. One aggregate counts
    rows and label sums by feature, range and fold; from them, in a task per feature, a one-split
    tree is fitted on all folds but one and judged on that one, with the gaps at either end. The
    side of least squared error (of class shares, for classes) wins, below on ties; a feature
    without gaps or without values gets below. Gaps are then given a value beyond that end.
    """
    features = list(features)
    parts = []
    for i, f in enumerate(features):
        finite = F.when(F.abs(present(f)) != float("inf"), present(f))
        parts += [F.count(F.when(present(f).isNull(), 1)).alias(f"n{i}"),
                  F.min(finite).alias(f"lo{i}"), F.max(finite).alias(f"hi{i}")]
    found = df.agg(*parts).first()
    gaps = {f: found[f"n{i}"] for i, f in enumerate(features)}
    open_ = [f for i, f in enumerate(features) if gaps[f] and found[f"lo{i}"] is not None]
    side = dict.fromkeys(features, BELOW)
    if open_:
        probabilities = [k / bins for k in range(1, bins)]
        values = df.select(*[present(f).alias(f"v{i}") for i, f in enumerate(open_)],
                           F.col(fold).alias("fold"), F.col(label).alias("label"))
        stats = exact_quantiles(values, [f"v{i}" for i in range(len(open_))], probabilities)
        entries = []
        for i in range(len(open_)):
            s = stats[f"v{i}"]
            edges = sorted({s.quantile(p) for p in probabilities})
            reached = F.array(*[F.col(f"v{i}") > F.lit(float(e)) for e in edges])
            number = F.size(F.filter(reached, lambda x: x))
            entries.append(F.struct(
                F.lit(i).alias("feature"),
                F.when(F.col(f"v{i}").isNotNull(), number).otherwise(-1).alias("bin")))
        y = F.col("label").cast("double")
        group = ["feature", "fold", "bin"] + (["label"] if classification else [])
        cells = values.select("fold", "label", F.inline(F.array(*entries))).groupBy(*group).agg(
            F.count(F.lit(1)).cast("double").alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("q"))

        def judge(cells: pd.DataFrame) -> pd.DataFrame:
            folds, at = np.unique(cells["fold"].to_numpy(), return_inverse=True)
            bin_ = cells["bin"].to_numpy()
            last = bin_.max() + 1  # gaps come last
            place = np.where(bin_ < 0, last, bin_)
            if classification:
                kinds, column = np.unique(cells["label"].to_numpy(), return_inverse=True)
                weight, square = cells["n"].to_numpy(), cells["n"].to_numpy()
            else:
                kinds, column = [0], np.zeros(len(cells), int)
                weight, square = cells["s"].to_numpy(), cells["q"].to_numpy()
            n, squares = (np.zeros((len(folds), last + 1)) for _ in range(2))
            sums = np.zeros((len(folds), last + 1, len(kinds)))
            np.add.at(n, (at, place), cells["n"].to_numpy())
            np.add.at(squares, (at, place), square)
            np.add.at(sums, (at, place, column), weight)
            own = list(range(last))
            below = _fold_loss(n, sums, squares, [last, *own])
            above = _fold_loss(n, sums, squares, [*own, last])
            better = above < below * (1 - 1e-9)
            return pd.DataFrame({"feature": [int(cells["feature"].iloc[0])], "above": [bool(better)]})

        for r in cells.groupBy("feature").applyInPandas(judge, "feature int, above boolean").collect():
            side[open_[r["feature"]]] = ABOVE if r["above"] else BELOW
    value = {}
    for i, f in enumerate(features):
        low, high = found[f"lo{i}"] or 0.0, found[f"hi{i}"] or 0.0
        far = high - low + 1.0
        value[f] = float(high + far if side[f] == ABOVE else low - far)
    return GapDirections(side, value, gaps)
