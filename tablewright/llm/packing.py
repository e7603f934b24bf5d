"""Packing of token sequences: dominance reduction on the length histogram, then best fit.

Bins depend on lengths only, so the plan is made from the number of pieces of each length, at most
``capacity`` numbers whatever the size of the corpus. Every piece then finds its place from its
length and its number among the pieces of that length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.core import cut_lineage
from tablewright.llm.common import text_strings
from tablewright.llm.tokens import encoder

Pattern = tuple[tuple[int, ...], int]  # lengths in one bin, number of such bins


def _largest(counts: dict[int, int], most: int, taken: Counter) -> int | None:
    """Largest length of at most ``most`` that is left after ``taken``."""
    return max((s for s, n in counts.items() if s <= most and n > taken[s]), default=None)


def _smallest_sum(counts: dict[int, int], taken: Counter, k: int) -> float:
    """Sum of the ``k`` smallest pieces left after ``taken``; infinite if there are fewer."""
    total, need = 0, k
    for s in sorted(counts):
        use = min(need, counts[s] - taken[s])
        total, need = total + use * s, need - use
        if not need:
            return total
    return float("inf")


def dominating_set(counts: dict[int, int], j: int, capacity: int) -> tuple[int, ...] | None:
    """Up to three lengths, ``j`` among them, that dominate every feasible bin holding ``j``.

    A bin dominates another if the other's pieces can be grouped so that each group is no longer
    than a piece of its own; then some best packing contains it. Proven cases, with rest
    ``r = capacity - j``: nothing fits beside j; one piece fills r exactly; at most one piece fits
    (the longest fitting one dominates); at most two fit, and the longest fitting piece is as long
    as any fitting pair; at most two fit, and the pair of the longest fitting piece a with b has
    no partner longer than b anywhere.
    """
    rest, taken = capacity - j, Counter([j])
    longest = _largest(counts, rest, taken)
    if longest is None:
        return (j,)
    if longest == rest or _smallest_sum(counts, taken, 2) > rest:
        return (j, longest)
    if _smallest_sum(counts, taken, 3) <= rest:
        return None
    best, pair = -1, None
    for a in sorted((s for s, n in counts.items() if s <= rest and n > taken[s]), reverse=True):
        if 2 * a < best:
            break
        b = _largest(counts, min(a, rest - a), taken + Counter([a]))
        if b is not None and a + b > best:
            best, pair = a + b, (a, b)
    if longest >= best:
        return (j, longest)
    a, b = pair
    minor = _largest(counts, rest // 2, taken)  # no fitting pair has a longer second piece
    if a == longest and (minor is None or b >= minor):
        return (j, a, b)
    return None


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Fix dominating bins until no length yields one; ``counts`` is left with the remainder.

    A condition that holds keeps holding while its own pieces last, since removing pieces only
    makes fewer things fit; so a bin is fixed as often as its pieces allow.
    """
    fixed: list[Pattern] = []
    again = True
    while again:
        again = False
        for j in sorted(counts, reverse=True):
            while counts.get(j) and (found := dominating_set(counts, j, capacity)):
                times = min(counts[s] // k for s, k in Counter(found).items())
                fixed.append((found, times))
                for s in found:
                    counts[s] -= times
                    if not counts[s]:
                        del counts[s]
                again = True
    return fixed


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit by falling length, many equal pieces and bins at a time.

    A piece goes to the fullest bin it fits in, so a bin takes equal pieces until no more fit
    before the next bin is touched.
    """
    open_bins: dict[int, list[list]] = {}  # free length -> [lengths, number of bins]
    done: list[Pattern] = []

    def put(lengths: tuple[int, ...], free: int, n: int) -> None:
        if n:
            open_bins.setdefault(free, []).append([lengths, n])

    for s in sorted(counts, reverse=True):
        left = counts[s]
        while left:
            fits = [f for f in open_bins if f >= s]
            free = min(fits) if fits else capacity
            each = free // s
            if fits:
                lengths, n = open_bins[free].pop()
                if not open_bins[free]:
                    del open_bins[free]
            else:
                lengths, n = (), -(-left // each)
            full = min(n, left // each)
            put(lengths + (s,) * each, free - each * s, full)
            left -= full * each
            n -= full
            if n and left:  # fewer pieces than fit in one more bin
                put(lengths + (s,) * left, free - left * s, 1)
                left, n = 0, n - 1
            if n and lengths:
                put(lengths, free, n)
    for groups in open_bins.values():
        done += [(lengths, n) for lengths, n in groups]
    return done


def plan_bins(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Bins for the given number of pieces of each length; every piece is in exactly one."""
    left = {s: n for s, n in counts.items() if n}
    if any(s < 1 or s > capacity for s in left):
        raise ValueError("lengths must lie between 1 and the capacity")
    fixed = reduce_by_dominance(left, capacity)
    return fixed + best_fit(left, capacity)


def seats(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """By length: rows (first piece number, first bin, offset), in order of piece number."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    used: Counter = Counter()
    start = 0
    for lengths, times in patterns:
        at = 0
        for s in lengths:
            rows.setdefault(s, []).append((used[s], start, at))
            used[s] += times
            at += s
        start += times
    return {s: np.array(r, dtype=np.int64) for s, r in rows.items()}


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Pieces of a document of ``n`` tokens: the first may be shorter, the others are full."""
    head = n % capacity
    return ([head] if head or not n else []) + [capacity] * (n // capacity)


PIECE = T.StructType([
    T.StructField("piece", T.IntegerType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids", T.BinaryType()),
])


def token_pieces(
    df: DataFrame,
    path: str,
    capacity: int,
    end_id: int,
    id_column: str,
    text_column: str,
    with_ids: bool,
) -> DataFrame:
    """Pieces of every document with their place in the numbering of equal lengths.

    `_part` is the task, `_nth` the number of the piece among those of its length in that task.
    Without ``with_ids`` a piece carries the CRC-32 of its packed ids instead of the ids.
    """
    last = T.StructField("ids", T.BinaryType()) if with_ids else T.StructField(
        "ids_crc32", T.LongType())
    schema = T.StructType([
        T.StructField(id_column, df.schema[id_column].dataType), *PIECE.fields[:3], last,
        T.StructField("_part", T.IntegerType()), T.StructField("_nth", T.LongType()),
    ])
    # _read keeps the id apart from a text column of the same name
    source = df.select(F.col(f"`{id_column}`").alias("_id"), F.col(f"`{text_column}`").alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seen = encoder(path), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows, take = [], []
            for i, text in enumerate(text_strings(batch.column(1))):
                ids = np.append(coder.ids(text), end_id).astype("<u4").tobytes()
                at = 0
                for k, n in enumerate(cut_lengths(len(ids) // 4, capacity)):
                    own = ids[4 * at : 4 * (at + n)]
                    rows.append((k, at, n, own if with_ids else zlib.crc32(own), part, seen[n]))
                    take.append(i)
                    seen[n] += 1
                    at += n
            columns = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.int32(), pa.int64(), pa.int64(),
                     pa.binary() if with_ids else pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(take, type=pa.int64()))]
                + [pa.array(c, type=t) for c, t in zip(columns, kinds)],
                names=schema.names)

    return source.mapInArrow(run, schema)


def pack(
    df: DataFrame,
    path: str,
    capacity: int = 1024,
    end_id: int = 2,
    id_column: str = "doc_id",
    text_column: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    A document is its ids followed by ``end_id``; only a longer one is cut. A null or empty text
    is that one end token. Returns one row per piece: id, piece, start, length, ids or their
    CRC-32, sequence_id, offset. Equal ids or rows are packed as separate documents, null ids
    too; an empty table gives no pieces. Other columns are not read.

    The pieces are checkpointed once, because their numbers within a task must not change. The
    driver sees one row per length. Offsets within a sequence run from 0 without gaps.
    """
    staged = cut_lineage(
        token_pieces(df, path, capacity, end_id, id_column, text_column, with_ids))
    cells = staged.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    counts = {r["length"]: r["n"]
              for r in cells.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    table = seats(plan_bins(counts, capacity))
    earlier = Window.partitionBy("length").orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    shifts = cells.select(
        "length", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    numbered = staged.join(shifts, ["length", "_part"]).withColumn(
        "_nth", F.col("_nth") + F.col("_shift"))
    kept = [id_column, "piece", "start", "length", staged.columns[4]]
    out = T.StructType([numbered.schema[c] for c in kept] + [
        T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, nth = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False), np.int64)
                           for c in (3, 5))
            order = np.argsort(length, kind="stable")
            sequence, offset = np.empty(len(nth), np.int64), np.empty(len(nth), np.int64)
            for s, run in groupby(order.tolist(), key=length.__getitem__):
                at = np.fromiter(run, dtype=np.int64)
                seat = table[int(s)]
                row = seat[np.searchsorted(seat[:, 0], nth[at], side="right") - 1]
                sequence[at] = row[:, 1] + nth[at] - row[:, 0]
                offset[at] = row[:, 2]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=out.names)

    return numbered.select(*kept, "_nth").mapInArrow(place, out)
