"""Quality classifier: regularised quadratic discriminant on document statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.core import cut_lineage
from tablewright.llm.common import map_rows, text_bytes

#: Weight of the pooled covariance in each class, and of the mean variance on the diagonal.
SHRINK_POOLED, SHRINK_RIDGE = 0.3, 0.05
#: Statistics further than this from the pooled mean count as this far, in standard deviations.
REACH = 6.0
#: Widths of the log-density difference that is one unit of the logit.
TEMPER = 0.2

#: Labels up to this number are broadcast (some 30 MB).
BROADCAST_LABELS = 1_000_000

#: Byte classes, in this order: upper case, lower case, digits, white space, end of sentence,
#: other marks of prose, symbols, bytes beyond ASCII.
CLASSES = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789",
    b" \t\n\r\x0b\x0c", b".!?", b",;:'\"()-", b"#*$%&|<>@^~_=+\\/[]{}`",
    bytes(range(128, 256)),
)
SPACE = CLASSES[3]
WIDTH = len(CLASSES) + 14


def statistics(raw: bytes) -> list[float]:
    """Transformed statistics of one text: square roots of shares, logarithms of sizes."""
    size = max(1, len(raw))
    shares = [len(raw) - len(raw.translate(None, c)) for c in CLASSES]
    words = raw.split()
    n = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip(SPACE)]
    m = max(1, len(lines))
    seen = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    spots = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    p = spots[spots > 0] / size
    marked = sum(1 for w in words if w[-1] in CLASSES[6] or w[0] in CLASSES[6])
    shouted = sum(1 for w in words if w.isupper() and len(w) > 1)
    capital = sum(1 for w in words if 65 <= w[0] <= 90)
    same = sum(map(bytes.__eq__, words, words[1:]))
    stops = shares[4]
    return [
        *(float(np.sqrt(x / size)) for x in shares),
        float(np.log1p(len(words))), float(np.log1p(size / n)), float(np.log1p(n / m)),
        float(np.log(len(seen) + 1) / np.log(n + 2)), float(np.sqrt(max(seen.values(), default=0) / n)),
        float(np.sqrt(1 - len(pairs) / max(1, n - 1))) if len(words) > 1 else 0.0,
        float(np.sqrt(1 - len(set(lines)) / m)) if lines else 0.0,
        float(-(p * np.log2(p)).sum()) if len(raw) else 0.0,
        float(np.sqrt(marked / n)), float(np.sqrt(shouted / n)), float(np.sqrt(capital / n)),
        float(np.sqrt(same / n)), float(np.log1p(n / (stops + 1))),
        float(np.log1p(max(map(len, words), default=0))),
    ]


@dataclass(frozen=True)
class Model:
    """Standardisation, class means and inverted Cholesky factors, made once on the driver."""

    centre: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, np.ndarray]
    whiten: tuple[np.ndarray, np.ndarray]
    offset: float

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -REACH, REACH)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability-like score of class 1 from the Mahalanobis log-density difference."""
        z = self.standard(x)
        far = [(((z - m) @ w.T) ** 2).sum(axis=1) for m, w in zip(self.means, self.whiten)]
        difference = 0.5 * (far[0] - far[1]) + self.offset
        return 1 / (1 + np.exp(-np.clip(TEMPER * difference, -500, 500)))


def moments(rows: DataFrame, width: int, model: Model | None = None) -> dict[int, tuple]:
    """By class: number, sums and sums of products of the statistics, added up in the tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + width + width * width))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, width)
            y = batch.column(1).to_numpy(zero_copy_only=False)
            x = x if model is None else model.standard(x)
            for c in (0, 1):
                own = x[y == c]
                total[c] += np.r_[len(own), own.sum(axis=0), (own.T @ own).ravel()]
        at = np.arange(total.size)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), pa.array(total.ravel())], names=["at", "value"])

    summed = rows.mapInArrow(add, "at long, value double").groupBy("at").agg(
        F.sum("value").alias("value")).toArrow()
    flat = np.zeros(2 * (1 + width + width * width))
    flat[summed.column("at").to_numpy()] = summed.column("value").to_numpy()
    out = {}
    for c, row in enumerate(flat.reshape(2, -1)):
        out[c] = row[0], row[1 : 1 + width], row[1 + width :].reshape(width, width)
    return out


def fit(rows: DataFrame, width: int = WIDTH) -> Model:
    """Model from rows (stats array<double>, label 0/1), all of them; no sample is taken.

    The first pass standardises by the pooled moments, the second takes class moments of the
    clipped values. Each class covariance is drawn towards the pooled one and then towards a
    multiple of the identity; a class without rows has the pooled moments, and without any rows
    all scores are 0.5.
    """
    def pooled(found):
        n = found[0][0] + found[1][0]
        mean = (found[0][1] + found[1][1]) / max(n, 1)
        return n, mean, (found[0][2] + found[1][2]) / max(n, 1) - np.outer(mean, mean)

    rows = cut_lineage(rows)  # statistics of labelled texts, read twice
    _, centre, spread = pooled(moments(rows, width))
    scale = np.sqrt(np.maximum(np.diag(spread), 1e-6))
    blank = Model(centre, scale, (np.zeros(width),) * 2, (np.eye(width),) * 2, 0.0)
    found = moments(rows, width, blank)
    total, mean, shared = pooled(found)
    means, whiten, logs = [], [], []
    for c in (0, 1):
        n, sums, products = found[c]
        own_mean = sums / n if n else mean
        own = products / n - np.outer(own_mean, own_mean) if n else shared
        own = (1 - SHRINK_POOLED) * own + SHRINK_POOLED * shared
        ridge = max(np.trace(own) / width, 1e-6)
        own = (1 - SHRINK_RIDGE) * own + SHRINK_RIDGE * ridge * np.eye(width)
        factor = np.linalg.cholesky(own)
        means.append(own_mean)
        whiten.append(np.linalg.inv(factor))
        logs.append(np.log(np.diag(factor)).sum())
    prior = np.log((found[1][0] + 1) / (found[0][0] + 1)) if total else 0.0
    return Model(centre, scale, tuple(means), tuple(whiten), float(logs[0] - logs[1] + prior))


STATS = T.StructType([T.StructField("_stats", T.ArrayType(T.DoubleType(), False))])
SCORE = T.StructType([
    T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def with_statistics(df: DataFrame, keep: list[str], text_column: str = "text") -> DataFrame:
    """The ``keep`` columns and `_stats`; a null text has the statistics of the empty one."""

    def compute(columns):
        return [[statistics(t) for t in text_bytes(columns[0])]]

    return map_rows(df, [text_column], STATS, compute, keep)


def with_scores(
    df: DataFrame, model: Model, keep: list[str], text_column: str = "text", prefix: str = ""
) -> DataFrame:
    """The ``keep`` columns, score and predicted (their names after ``prefix``)."""
    outputs = T.StructType([T.StructField(prefix + f.name, f.dataType) for f in SCORE.fields])
    if clash := set(keep) & set(outputs.names):
        raise ValueError(f"rename these columns first: {sorted(clash)}")

    def compute(columns):
        x = np.array([statistics(t) for t in text_bytes(columns[0])]).reshape(-1, WIDTH)
        score = model.score(x)
        return [pa.array(score), pa.array((score >= 0.5).astype(np.int32))]

    return map_rows(df, [text_column], outputs, compute, keep)


def training_rows(
    df: DataFrame, labels: DataFrame, id_column: str, text_column: str
) -> DataFrame:
    """(stats, label) of labelled documents that are not held out.

    Held out: crc32 of the id as text, modulo 3, is 1. Labels other than 0 and 1 and null ids are
    left out; a document labelled twice counts twice. Up to a checked number of labels they are
    broadcast and only labelled texts are read closely; beyond, statistics are joined by a shuffle.
    """
    known = labels.where(F.col("label").isin(0, 1) & F.col("id").isNotNull()).select(
        F.col("id").alias("_lid"), F.col("label").cast("int").alias("_label"))
    own = df.select(F.col(f"`{id_column}`").alias("_id"), F.col(f"`{text_column}`").alias("_text"))
    own, match = own.where(~held_out("_id")), F.col("_id") == F.col("_lid")
    if known.count() <= BROADCAST_LABELS:
        labelled = own.join(F.broadcast(known), match)
        return with_statistics(labelled, ["_label"], "_text").select("_stats", "_label")
    return with_statistics(own, ["_id"], "_text").join(known, match).select("_stats", "_label")


def held_out(id_column: str):
    """Whether a row's label may not be learned from; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 3 == 1, F.lit(False))


def learn(
    df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> Model:
    """Model from all labelled rows of ``df`` that are not held out; see :func:`fit`."""
    return fit(training_rows(df, labels, id_column, text_column))


def classify(
    df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Id, held_out, score and predicted (1 from 0.5 on) of every row.

    ``labels`` has columns id and label (0 or 1). Scores come from the text alone, null as empty;
    the driver sees sums of the width of the statistics. Null and repeated ids are rows like any
    other; an empty table gives no rows. Other columns are not read.
    """
    model = learn(df, labels, id_column, text_column)
    rows = df.select(F.col(f"`{id_column}`").alias("_id"), F.col(f"`{text_column}`").alias("_text"))
    return with_scores(rows, model, ["_id"], "_text").select(
        F.col("_id").alias(id_column), held_out("_id").alias("held_out"), "score", "predicted")
