"""Linear classifiers of several folds fitted together, on blocks of rows that every step scans once.

Spark's own learners start a job for each evaluation of the loss of each fit; a support vector
classifier asks for hundreds of them. Here the fits of all folds go in step: one job evaluates what
each of them asks for next, as products of small matrices. Loss, scaling, penalty, optimiser and stop
rules are those of Spark's ``LogisticRegression`` (L-BFGS) and ``LinearSVC`` (OWL-QN without L1), so
coefficients agree with theirs up to the order of sums.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Generator, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import (
    LinearSVC,
    LinearSVCModel,
    LogisticRegression,
    LogisticRegressionModel,
)
from pyspark.ml.common import _py2java
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block; the products of a block with all asked coefficients stay in a core's cache.
BLOCK_ROWS = 8_192
#: Rows of a partition of blocks.
PART_ROWS = 500_000
#: Features up to which a step's sums are small enough for the driver.
MAX_FEATURES = 1_000
#: Step sizes of a line search that one job tries ahead.
AHEAD = 4

Asked = list[np.ndarray]
Answers = list[tuple[float, np.ndarray]]
Search = Generator[Asked, Answers, np.ndarray]


class _Failed(Exception):
    """A line search or the history of an optimiser is of no use; it starts again once."""


def takes(learner: Any, n_classes: int, n_features: int) -> bool:
    """Whether a learner can be fitted here."""
    if n_classes != 2 or n_features > MAX_FEATURES:
        return False
    if isinstance(learner, LinearSVC):
        return True
    return isinstance(learner, LogisticRegression) and (
        learner.getElasticNetParam() == 0.0 or learner.getRegParam() == 0.0)


def block_rows(rows: DataFrame, weighted: bool, n: int):
    """(fold, block, weights) of ``features``, ``label``, ``fold``, as a persisted RDD.

    A block has the rows of one fold: the signed features and the sign (1 or -1) of each row, a line
    per feature.
    """
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(fold: int, parts: list):
            z = np.concatenate([p[0] for p in parts], axis=1)
            w = np.concatenate([p[1] for p in parts])
            for at in range(0, len(w), BLOCK_ROWS):
                piece = np.ascontiguousarray(z[:, at : at + BLOCK_ROWS])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([fold], pa.int32()), pa.array([len(piece)], pa.int32()),
                     pa.array([piece.tobytes()], pa.binary()),
                     pa.array([w[at : at + BLOCK_ROWS].tobytes() if weighted else b""], pa.binary())],
                    names=["fold", "lines", "z", "w"])

        for b in batches:
            if not b.num_rows:
                continue
            fold = b.column(2).to_numpy(zero_copy_only=False)
            sign = 2.0 * b.column(1).to_numpy(zero_copy_only=False) - 1.0
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            w = b.column(3).to_numpy(zero_copy_only=False)
            for k in np.unique(fold):
                at = fold == k
                z = np.vstack([x[at].T * sign[at], sign[at]])
                held.setdefault(int(k), []).append((z, w[at]))
                if sum(len(p[1]) for p in held[int(k)]) >= BLOCK_ROWS:
                    yield from out(int(k), held.pop(int(k)))
        for k in sorted(held):
            yield from out(k, held[k])

    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = cores * max(1, -(-n // (PART_ROWS * cores)))
    narrow = rows.select(vector_to_array("features").alias("x"), "label", "fold", "weight")
    made = narrow.coalesce(parts).mapInArrow(blocks, "fold int, lines int, z binary, w binary")
    return made.rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)


def _read(block: tuple) -> tuple[int, np.ndarray, np.ndarray | None]:
    fold, lines, z, w = block
    return fold, np.frombuffer(z).reshape(lines, -1), np.frombuffer(w) if w else None


def _merged(a: tuple, b: tuple) -> tuple:
    """Moments (weight, squared weights, means, squared deviations) of two sets of rows together."""
    n = a[0] + b[0]
    if not n:
        return a
    d = b[2] - a[2]
    return (n, a[1] + b[1], a[2] + d * (b[0] / n), a[3] + b[3] + d * d * (a[0] * b[0] / n), a[4] + b[4])


def fold_moments(blocks) -> dict[int, tuple]:
    """Moments and weight by class of every fold, in one job."""
    def of(part):
        found: dict[int, tuple] = {}
        for block in part:
            fold, z, w = _read(block)
            sign, x = z[-1], z[:-1] * z[-1]
            w = np.ones(len(sign)) if w is None else w
            n = w.sum()
            first = x[:, 0]  # the mean of a constant is that constant, without a rounding error
            mean = first + (x - first[:, None]) @ w / n if n else first
            own = (n, (w * w).sum(), mean, ((x - mean[:, None]) ** 2) @ w,
                   np.array([w[sign < 0].sum(), w[sign > 0].sum()]))
            found[fold] = _merged(found[fold], own) if fold in found else own
        return [found]

    total: dict[int, tuple] = {}
    for found in blocks.mapPartitions(of).collect():
        for fold, own in found.items():
            total[fold] = _merged(total[fold], own) if fold in total else own
    return total


def _hinge(z: np.ndarray, w: np.ndarray | None, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = c @ z
    np.subtract(1.0, t, out=t)
    np.maximum(t, 0.0, out=t)
    active = (t > 0.0).astype(float)
    if w is not None:
        t *= w
        active *= w
    return t.sum(axis=1), -(active @ z.T)


def _log_loss(z: np.ndarray, w: np.ndarray | None, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = c @ z
    e = np.exp(-np.abs(t))
    loss = np.log1p(e)
    loss -= np.minimum(t, 0.0)
    share = np.where(t > 0.0, e, 1.0)
    share /= 1.0 + e
    if w is not None:
        loss *= w
        share *= w
    return loss.sum(axis=1), -(share @ z.T)


LOSSES = {"hinge": _hinge, "log": _log_loss}


def _sums(blocks, loss: str, asked: Sequence[tuple[int | None, np.ndarray]]) -> list[np.ndarray]:
    """Loss and signed feature sums of each asked (fold left out, coefficients), in one job."""
    out = [f for f, _ in asked]
    coefficients = np.array([c for _, c in asked])

    def of(part):
        total = np.zeros((len(out), coefficients.shape[1] + 1))
        chosen: dict[int, np.ndarray] = {}
        for block in part:
            fold, z, w = _read(block)
            if fold not in chosen:
                chosen[fold] = np.array([i for i, f in enumerate(out) if f != fold], dtype=int)
            at = chosen[fold]
            if len(at):
                value, gradient = LOSSES[loss](z, w, coefficients[at])
                total[at, 0] += value
                total[at, 1:] += gradient
        return [total]

    return list(sum(blocks.mapPartitions(of).collect(), np.zeros((len(out), coefficients.shape[1] + 1))))


class _Problem:
    """Scaling, penalty and start of one fit."""

    def __init__(self, learner: Any, moments: Sequence[tuple], out: int | None):
        self.out = out
        total = moments[0]
        for m in moments[1:]:
            total = _merged(total, m)
        self.weight, squares, mean, deviations, self.classes = total
        free = self.weight - squares / self.weight
        self.std = np.sqrt(np.maximum(deviations / free, 0.0)) if free > 0 else np.zeros(len(mean))
        self.inverse = np.divide(1.0, self.std, out=np.zeros(len(mean)), where=self.std != 0)
        self.centre = mean * self.inverse
        penalty = learner.getRegParam()
        scale = self.inverse**2 if not learner.getStandardization() else np.ones(len(mean))
        self.penalty = penalty * scale
        self.start = np.zeros(len(mean) + 1)
        if isinstance(learner, LogisticRegression):
            self.start[-1] = math.log(self.classes[1] / self.classes[0])

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Coefficients of unscaled features and the intercept."""
        return np.append(x[:-1] * self.inverse, x[-1] - x[:-1] @ self.centre)

    def answer(self, x: np.ndarray, sums: np.ndarray) -> tuple[float, np.ndarray]:
        """Penalised mean loss and its gradient."""
        slope = np.append(sums[1:-1] * self.inverse - sums[-1] * self.centre, sums[-1]) / self.weight
        slope[:-1] += self.penalty * x[:-1]
        return sums[0] / self.weight + 0.5 * float(self.penalty @ x[:-1] ** 2), slope


def _direction(history: list[tuple[np.ndarray, np.ndarray]], slope: np.ndarray) -> np.ndarray:
    """Descent direction from the latest steps and changes of the gradient, newest first."""
    d = slope.copy()
    scale = 1.0
    if history:
        step, change = history[0]
        sy, yy = step @ change, change @ change
        if sy < 0 or math.isnan(sy):
            raise _Failed
        scale = sy / yy if yy else math.nan
    shares = []
    for step, change in history:
        rho = step @ change
        share = step @ d / rho if rho else math.nan
        if math.isnan(share):
            raise _Failed
        shares.append((share, rho))
        d -= share * change
    d *= scale
    for (step, change), (share, rho) in zip(reversed(history), reversed(shares)):
        d += (share - change @ d / rho) * step
    return -d


def _minimise(
    start: np.ndarray, most: int, tolerance: float, direct: Callable, search: Callable,
    trace: list[float] | None = None,
) -> Search:
    """Iterations and stop rules of both optimisers; yields points, is sent values and gradients."""
    ((value, slope),) = yield [start]
    x, first, history, values, steps, failed = start, value, [], [math.inf], 0, False
    while True:
        if trace is not None:
            trace.append(value)
        if (steps >= most or (len(values) >= 2 and abs(value - max(values)) <= tolerance * first)
                or np.linalg.norm(slope) <= max(tolerance * value, 1e-8)):
            return x
        try:
            d = direct(history, slope)
            at, new, new_slope = yield from search(x, value, slope, d, steps)
            failed = False
        except _Failed:
            if failed:
                return x
            failed, history = True, []
            continue
        history = [(at - x, new_slope - slope), *history][:10]
        x, value, slope, steps = at, new, new_slope, steps + 1
        values = [*values, value][-20:]


def _wolfe(x, value, slope, d, steps):
    """Step to the strong Wolfe conditions: growing, then cubic interpolation in the bracket."""
    tried: dict[float, tuple] = {0.0: (0.0, slope @ d, value, x, slope)}

    def at(t):
        if t not in tried:
            point = x + d * t
            ((v, g),) = yield [point]
            tried[t] = (t, g @ d, v, point, g)
        return tried[t]

    def between(a, b):
        d1 = a[1] + b[1] - 3 * (a[2] - b[2]) / (a[0] - b[0])
        square = d1 * d1 - a[1] * b[1]
        d2 = math.sqrt(square) if square >= 0 else math.nan
        width = b[0] - a[0]
        below = b[1] - a[1] + 2 * d2
        t = b[0] - width * (b[1] + d2 - d1) / below if below else math.nan
        return min(max(t, a[0] + 0.1 * width), a[0] + 0.9 * width) if not math.isnan(t) else t

    def accepted(c):
        if c[0] * np.linalg.norm(slope) < 1e-10:
            raise _Failed
        return c[3], c[2], c[4]

    begin = low = tried[0.0]
    if begin[1] > 0:
        raise _Failed
    t = 1.0 / np.linalg.norm(d) if steps == 0 else 1.0
    high = None
    for i in range(10):
        c = yield from at(t)
        if not math.isfinite(c[2]):
            t /= 2.0
            continue
        if c[2] > value + 1e-4 * t * begin[1] or (c[2] >= low[2] and i > 0):
            high = c
            break
        if abs(c[1]) <= 0.9 * abs(begin[1]):
            return accepted(c)
        if c[1] >= 0:
            low, high = c, low
            break
        low, t = c, t * 1.5
    if high is None:
        raise _Failed
    for _ in range(10):
        c = yield from at(between(high, low) if low[0] > high[0] else between(low, high))
        if c[2] > value + 1e-4 * c[0] * begin[1] or c[2] >= low[2]:
            high = c
            continue
        if abs(c[1]) <= 0.9 * abs(begin[1]):
            return accepted(c)
        if c[1] * (high[0] - low[0]) >= 0:
            high = low
        low = c
    raise _Failed


def _orthant_direction(history, slope):
    d = _direction(history, slope)
    return np.where(d * slope < 0, d, 0.0)


def _backtrack(x, value, slope, d, steps):
    """Step inside the orthant of ``x``, halved or grown; a job also tries the next halvings."""
    shrink = 0.1 if steps < 1 else 0.5
    orthant = np.where(x != 0, np.sign(x), np.sign(-slope))
    tried: dict[float, tuple] = {}

    def at(t):
        if t not in tried:
            ahead = [t]
            while len(ahead) < AHEAD:
                ahead.append(ahead[-1] * shrink)
            points = []
            for a in ahead:
                p = x + d * a
                points.append(np.where(np.sign(p) == np.sign(orthant), p, 0.0))
            for a, p, (v, g) in zip(ahead, points, (yield points)):
                tried[a] = (p, v, g)
        return tried[t]

    begin = slope @ d
    norm = np.linalg.norm(slope)
    t = 0.5 / norm if steps < 1 and norm else 1.0
    if begin < 0:  # Breeze takes the value of x for that of the first step, and so always shrinks it
        t *= shrink
    p, v, g = yield from at(t)
    for _ in range(18 if begin < 0 else 0):
        along = g @ d
        if v > value + t * begin * 1e-4:
            factor = shrink
        elif along < 0.9 * begin:
            factor = 2.1
        elif along > -0.9 * begin:
            factor = shrink
        else:
            break
        t *= factor
        if not 1e-10 <= t <= 1e10:
            raise _Failed
        p, v, g = yield from at(t)
    return p, v, g


def fit_together(
    data, learner: Any, left_out: Sequence[int | None], traces: list[list[float]] | None = None,
) -> list | None:
    """A model for each fold that is left out (None: all rows).

    None where Spark's learner has a rule of its own: rows of a single class, or values that are not
    finite.
    """
    weighted = learner.isDefined("weightCol") and bool(learner.getOrDefault("weightCol"))
    blocks = block_rows(data.rows, weighted, data.n)
    try:
        moments = fold_moments(blocks)
        problems = []
        for out in left_out:
            own = [moments[k] for k in sorted(moments) if k != out]
            if not own or not all(sum(m[4][c] for m in own) > 0 for c in (0, 1)):
                return None
            if not all(np.isfinite(m[3]).all() for m in own):
                return None
            problems.append(_Problem(learner, own, out))
        svc = isinstance(learner, LinearSVC)
        loss, direct, search = (
            ("hinge", _orthant_direction, _backtrack) if svc else ("log", _direction, _wolfe))
        traces = traces if traces is not None else [[] for _ in problems]
        running = [
            _minimise(p.start, learner.getMaxIter(), learner.getTol(), direct, search, trace)
            for p, trace in zip(problems, traces)]
        asked = {i: next(r) for i, r in enumerate(running)}
        found: dict[int, np.ndarray] = {}
        while asked:
            points = [(i, x) for i, xs in asked.items() for x in xs]
            sums = _sums(blocks, loss, [(problems[i].out, problems[i].raw(x)) for i, x in points])
            answers: dict[int, Answers] = {i: [] for i in asked}
            for (i, x), s in zip(points, sums):
                answers[i].append(problems[i].answer(x, s))
            for i, answer in answers.items():
                try:
                    asked[i] = running[i].send(answer)
                except StopIteration as end:
                    found[i] = end.value
                    del asked[i]
    finally:
        blocks.unpersist()
    return [_model(data.rows.sparkSession, learner, p.raw(found[i])) for i, p in enumerate(problems)]


def _model(spark, learner: Any, raw: np.ndarray):
    """Spark's model of these coefficients."""
    sc = spark.sparkContext
    package = sc._jvm.org.apache.spark.ml.classification
    made, kind = ((package.LinearSVCModel, LinearSVCModel) if isinstance(learner, LinearSVC)
                  else (package.LogisticRegressionModel, LogisticRegressionModel))
    java = made(learner.uid, _py2java(sc, Vectors.dense(raw[:-1].tolist())), float(raw[-1]))
    return learner._copyValues(kind(java))
