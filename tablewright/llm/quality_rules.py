"""Quality rules: hashed n-gram log-likelihood ratio of trusted text against the whole corpus.

The n-grams are four bytes long and run over the words of a text joined by single blanks. Such
n-grams recur in any text of a language, so a passage that a corpus repeats does not stand out
from its own counts, as its rare words would.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.common import map_rows, slices, text_bytes

#: Multiplier of the bucket hash; a product with a 32-bit n-gram stays below 2^63.
MULTIPLIER = 1_103_515_245
#: Buckets, smoothing of a bucket, and the least mean log ratio of a kept text.
BUCKETS, SMOOTHING, THRESHOLD = 65_536, 5.0, -0.4
#: Base rules: words needed, and the percentage of words in repeated windows that is too much.
LEAST_WORDS, MOST_REPEATED = 20, 30
WINDOW = 8
#: Bytes of a long text whose n-grams are hashed at a time.
PIECE_BYTES = 1 << 19
#: Ids up to this number are broadcast (some 30 MB), more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
INNER = bytes(range(0x80, 0xC0))  # bytes of a code point after its first

OUTPUT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()), T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()), T.StructField("base_failed", T.BooleanType()),
    T.StructField("log_ratio", T.DoubleType()), T.StructField("kept", T.BooleanType()),
])


def grams(words: list[list[bytes]], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of some texts, and how many each text has."""
    joined = [b" " + b" ".join(w) + b" " for w in words]
    lengths = np.array([len(j) for j in joined], dtype=np.int64)
    data = np.frombuffer(b"".join(joined), dtype=np.uint8).astype(np.uint64)
    counts = np.maximum(lengths - 3, 0)
    if len(data) < 4:
        return np.zeros(0, dtype=np.int64), counts
    starts = np.cumsum(lengths) - lengths
    inside = np.ones(len(data), dtype=bool)
    for back in (1, 2, 3):  # an n-gram does not run into the next text
        inside[starts + lengths - np.minimum(back, lengths)] = False
    return _bucket(data, buckets)[inside[:-3]], counts


def gram_pieces(
    words: list[list[bytes]], buckets: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """:func:`grams` of a run of texts at once, or of one long text piece by piece.

    Pieces overlap by three bytes, so every n-gram of the text lies in one of them.
    """
    if len(words) != 1 or sum(map(len, words[0])) <= PIECE_BYTES:
        yield grams(words, buckets)
        return
    joined = b" " + b" ".join(words[0]) + b" "
    for at in range(0, len(joined) - 3, PIECE_BYTES):
        data = np.frombuffer(joined[at : at + PIECE_BYTES + 3], dtype=np.uint8).astype(np.uint64)
        found = _bucket(data, buckets)
        yield found, np.array([len(found)])


def _bucket(data: np.ndarray, buckets: int) -> np.ndarray:
    value = data[:-3] << np.uint64(24) | data[1:-2] << np.uint64(16)
    value |= data[2:-1] << np.uint64(8) | data[3:]
    hashed = (value * np.uint64(MULTIPLIER)) & np.uint64(0xFFFFFFFF)
    return (hashed * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def repeated_words(words: list[list[bytes]], window: int = WINDOW) -> np.ndarray:
    """Words of each text in windows of ``window`` (a power of two) words that it has twice or more.

    Words get numbers, then pairs, fours and eights of neighbours do, so equal numbers mean equal
    words; nothing rests on a hash.
    """
    counts = np.array([len(w) for w in words], dtype=np.int64)
    number: dict[bytes, int] = {}
    give = number.setdefault
    ids = np.array([give(w, len(number)) for own in words for w in own], dtype=np.int64)
    total, span = len(ids), 1
    while span < window and len(ids) > span:
        ids = np.unique(ids[:-span] << 32 | ids[span:], return_inverse=True)[1].astype(np.int64)
        span *= 2
    result = np.zeros(len(words), dtype=np.int64)
    if span < window or not len(ids):
        return result
    text = np.repeat(np.arange(len(words)), counts)
    at = np.flatnonzero(text[: len(ids)] == text[window - 1 : window - 1 + len(ids)])
    if not len(at):
        return result
    _, back, times = np.unique(text[at] << 32 | ids[at], return_inverse=True, return_counts=True)
    hit = at[times[back] > 1]
    edge = np.zeros(total + 1, dtype=np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + window, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(text[covered], minlength=len(words)).astype(np.int64)


def repeated_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in raw.split(b"\n") if x.strip(SPACE)]
    return len(lines) - len(set(lines))


def gram_counts(df: DataFrame, trusted: DataFrame, id_column: str, text_column: str,
                buckets: int) -> DataFrame:
    """(bucket, raw, target): n-grams of all texts and of those whose id is in ``trusted``.

    A task adds up its rows in two arrays, so the shuffle carries at most one row per task and
    bucket, however frequent an n-gram is.
    """
    ids = trusted.select(F.col(trusted.columns[0]).alias("_tid"), F.lit(True).alias("_trusted"))
    ids = ids.where("_tid IS NOT NULL").distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    rows = df.select(F.col(f"`{id_column}`").alias("_id"), F.col(f"`{text_column}`").alias("_text"))
    flagged = rows.join(ids, F.col("_id") == F.col("_tid"), "left").select("_text", "_trusted")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = np.zeros(buckets, dtype=np.int64)
        target = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            texts = text_bytes(batch.column(0))
            marks = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            for part in slices([len(t) for t in texts]):
                for found, counts in gram_pieces([t.split() for t in texts[part]], buckets):
                    raw += np.bincount(found, minlength=buckets)
                    target += np.bincount(
                        found[np.repeat(marks[part], counts)], minlength=buckets)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])],
            names=["bucket", "raw", "target"])

    return (
        flagged.mapInArrow(add, "bucket int, raw long, target long")
        .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    )


def log_ratios(counts: DataFrame, buckets: int, smoothing: float) -> np.ndarray:
    """log(target share / raw share) of every bucket; all zero without trusted text.

    The raw counts are scaled to the size of the target before both are smoothed, so the two
    multinomials have one total and a bucket with its expected share has ratio 0 at any size.
    """
    rows = counts.toArrow()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    at = rows.column("bucket").to_numpy()
    raw[at], target[at] = rows.column("raw").to_numpy(), rows.column("target").to_numpy()
    if not target.sum():
        return np.zeros(buckets)
    expected = raw * (target.sum() / raw.sum())
    return np.log(target + smoothing) - np.log(expected + smoothing)


def judge(
    df: DataFrame,
    trusted: DataFrame,
    keep: list[str],
    id_column: str = "doc_id",
    text_column: str = "text",
    buckets: int = BUCKETS,
    smoothing: float = SMOOTHING,
    threshold: float = THRESHOLD,
    prefix: str = "",
) -> DataFrame:
    """The ``keep`` columns of every row, the base statistics, log_ratio and the verdict ``kept``.

    ``trusted`` holds ids of texts known to be good in its first column. log_ratio is the mean over
    the n-grams of a text, rounded to 6 digits (0 for a text without n-grams). A text is kept if
    the base rules pass (20 words or more, at most 30 % of them in repeated windows) and log_ratio
    reaches ``threshold``. Null texts count as empty and fail; null and repeated ids are rows like
    any other, a null id is never trusted; an empty table gives no rows. Names in ``keep`` may not
    be those of the result, which follow ``prefix``; other columns are not read.
    """
    ratio = log_ratios(
        gram_counts(df, trusted, id_column, text_column, buckets), buckets, smoothing)
    outputs = T.StructType([T.StructField(prefix + f.name, f.dataType) for f in OUTPUT.fields])
    if clash := set(keep) & set(outputs.names):
        raise ValueError(f"rename these columns first: {sorted(clash)}")

    def compute(columns):
        out: list[list] = [[] for _ in OUTPUT.names]
        texts = text_bytes(columns[0])
        for part in slices([len(t) for t in texts]):
            words = [t.split() for t in texts[part]]
            sums, counts = np.zeros(len(words)), np.zeros(len(words), dtype=np.int64)
            for found, own in gram_pieces(words, buckets):
                edges = np.r_[0, np.cumsum(own)]
                value = np.r_[0.0, ratio[found], 0.0]
                added = np.add.reduceat(value, edges[:-1] + 1) if len(words) else np.zeros(0)
                added[own == 0] = 0
                sums, counts = sums + added, counts + own
            repeats = repeated_words(words).tolist()
            score = np.round(sums / np.maximum(counts, 1), 6) + 0.0
            for t, w, again, own in zip(texts[part], words, repeats, score.tolist()):
                failed = len(w) < LEAST_WORDS or 100 * again > MOST_REPEATED * len(w)
                row = (len(w), len(t.translate(None, SPACE + INNER)),
                       len(t) - len(t.translate(None, SYMBOLS)), repeated_lines(t), again,
                       failed, own, not failed and own >= threshold)
                for column, x in zip(out, row):
                    column.append(x)
        return out

    return map_rows(df, [text_column], outputs, compute, keep)
