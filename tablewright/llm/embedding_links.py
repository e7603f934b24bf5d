"""Embedding near-duplicates by collision-counting projections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.core import cut_lineage
from tablewright.llm.components import components, spanning

SEED = 20_190_501
#: Counted projections, and the window in standard deviations of a pair at the threshold.
PROJECTIONS, WINDOW = 32, 2.5
#: Share of pairs at the threshold that cells and counting may each miss.
MISS = 1e-6
#: Rows wanted in a cell, rows above which a cell is cut into blocks, rows of a task's group.
CELL_ROWS, BLOCK_ROWS, GROUP_ROWS = 256, 2_048, 32_768
#: Crowded cells up to this number are broadcast (some 40 bytes each).
BROADCAST_CELLS = 200_000
#: Pairs counted at once.
PAIRS_AT_ONCE = 1 << 17


def directions(dimension: int, planes: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal directions for counting and Gaussian normals for the cells (fixed seed)."""
    rng = np.random.default_rng([SEED, dimension])
    basis, _ = np.linalg.qr(rng.standard_normal((dimension, dimension)))
    return basis[:, : min(PROJECTIONS, dimension)], rng.standard_normal((dimension, planes))


def cell_plan(rows: int, cosine: float) -> tuple[int, int]:
    """Signs in a cell's code and number of codes for groups of up to ``rows`` vectors.

    A pair at the threshold agrees in a sign with probability 1 - angle / pi, so it shares one of
    ``t`` codes of ``b`` signs except for (1 - agree^b)^t of the cases.
    """
    signs = min(20, max(4, math.ceil(math.log2(max(rows, 1) / CELL_ROWS + 1))))
    agree = (1 - math.acos(min(1.0, max(-1.0, cosine))) / math.pi) ** signs
    return signs, 1 if agree >= 1 else max(1, math.ceil(math.log(MISS) / math.log(1 - agree)))


def count_needed(projections: int, dimension: int, cosine: float) -> tuple[float, int]:
    """Window and the collisions that a pair must have, calibrated for the recall.

    Two unit vectors at the threshold are sqrt(2 - 2 cosine) apart; along a random direction the
    gap has that length over sqrt(dimension) as its standard deviation. The count is the largest
    that at least 1 - MISS of such pairs reach. When all directions are counted, it is also never
    above what the squared length leaves: gaps beyond the window number at most length^2 / window^2.
    """
    length = math.sqrt(max(0.0, 2 - 2 * cosine))
    window = WINDOW * length / math.sqrt(dimension) + 1e-9
    hit = math.erf(WINDOW / math.sqrt(2))
    below, need = 0.0, 0
    for k in range(projections + 1):
        below += math.comb(projections, k) * hit**k * (1 - hit) ** (projections - k)
        if below > MISS:
            break
        need = k + 1
    if dimension < 8:  # too few directions for the normal approximation
        need = max(0, projections - int(length**2 / window**2))
    return window, need


def readable(
    df: DataFrame, id_column: str, vector_column: str, label_column: str
) -> tuple[DataFrame, type]:
    """Id, label and packed vector, null where it must not link; and the type of a component."""
    double = isinstance(df.schema[vector_column].dataType.elementType, T.DoubleType)
    kind = np.float64 if double else np.float32
    schema = T.StructType([
        T.StructField("_id", df.schema[id_column].dataType),
        T.StructField("_label", df.schema[label_column].dataType),
        T.StructField("_vector", T.BinaryType()),
    ])
    source = df.select(*(F.col(f"`{c}`").alias(n) for c, n in (
        (id_column, "_id"), (label_column, "_label"), (vector_column, "_v"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            labels = batch.column(1).is_valid().to_pylist()
            for has, values in zip(labels, batch.column(2)):
                own = None
                if has and values.is_valid and not values.values.null_count:
                    v = values.values.to_numpy(zero_copy_only=False).astype(kind) + kind(0)
                    if np.isfinite(v).all() and v.any():
                        own = v.tobytes()
                packed.append(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(packed, pa.binary())],
                names=schema.names)

    return source.mapInArrow(run, schema), kind


def _units(packed: list[bytes], kind: type) -> np.ndarray:
    v = np.frombuffer(b"".join(packed), dtype=kind).reshape(len(packed), -1).astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # squares stay in range
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def links_in_run(
    units: np.ndarray, side: np.ndarray, whole: bool, codes: np.ndarray, turn: int,
    cosine: float, cut: tuple[float, int],
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one cell (or of two blocks of it) that link and met in no earlier code.

    The rows are sorted along the first direction, where a linked pair is no further apart than
    the vectors are; the collisions of such pairs in all directions are counted, and those that
    have enough are verified by their cosine.
    """
    window, need = cut
    along = units @ directions(units.shape[1], 0)[0]
    order = np.argsort(along[:, 0], kind="stable")
    first = along[order, 0]
    length = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9  # no projection of the gap is longer
    ends = np.searchsorted(first, first + length, side="right")
    n = len(order)
    found_a, found_b = [], []
    steps = np.maximum(ends - np.arange(n) - 1, 0)
    cuts = np.searchsorted(np.cumsum(steps), np.arange(PAIRS_AT_ONCE, steps.sum() + PAIRS_AT_ONCE,
                                                       PAIRS_AT_ONCE), side="left")
    begin = 0
    for stop in np.unique(np.minimum(cuts + 1, n)):
        own = steps[begin:stop]
        left = np.repeat(np.arange(begin, stop), own)
        right = left + 1 + np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        begin = stop
        a, b = order[left], order[right]
        if not whole:
            across = side[a] != side[b]
            a, b = a[across], b[across]
        met = (np.abs(along[a] - along[b]) <= window).sum(axis=1) >= need
        a, b = a[met], b[met]
        near = (units[a] * units[b]).sum(axis=1) >= cosine
        a, b = a[near], b[near]
        fresh = ~(codes[a, :turn] == codes[b, :turn]).any(axis=1)
        found_a.append(a[fresh])
        found_b.append(b[fresh])
    if not found_a:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate(found_a), np.concatenate(found_b)


def near_vectors(
    df: DataFrame,
    cosine: float = 0.98,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
) -> DataFrame:
    """One row per vector: id, n_links, component_id and kept.

    Vectors of equal label and length link at ``cosine`` or more, in double precision. A vector
    that is null, zero, or holds a null or non-finite component, or whose label is null, links
    with nothing: n_links 0, its own component. Equal vectors are one node whose rows link to each
    other; n_links counts rows. component_id is the smallest id reachable; a null id never names a
    component unless it is alone (then null, not kept). Repeated ids give one row each.

    Cells are codes of projection signs; each pair is judged in the first code it shares, so
    nothing is written per pair: tasks return degrees and a spanning set of links. A crowded cell
    is compared block by block in separate tasks.
    """
    vectors, kind = readable(df, id_column, vector_column, label_column)
    vectors = cut_lineage(vectors)
    nodes = cut_lineage(
        vectors.where("_vector IS NOT NULL").groupBy("_label", "_vector")
        .agg(F.min("_id").alias("low"), F.count(F.lit(1)).alias("copies"))
        .withColumn("node", F.monotonically_increasing_id()))
    largest = nodes.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    signs, turns = cell_plan(largest or 1, cosine)
    probe = T.StructType([
        T.StructField("node", T.LongType()), T.StructField("copies", T.LongType()),
        T.StructField("vector", T.BinaryType()),
        T.StructField("turn", T.IntegerType()), T.StructField("code", T.IntegerType()),
        T.StructField("width", T.IntegerType()), T.StructField("label", T.LongType())])

    def codes_of(units: np.ndarray) -> np.ndarray:
        """The code of each vector in each turn; a task makes them again rather than be sent them."""
        _, normals = directions(units.shape[1], signs * turns)
        bits = (units @ normals > 0).reshape(len(units), turns, signs)
        return (bits * (1 << np.arange(signs))).sum(axis=2).astype("<i4")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = batch.column(2).to_pylist()
            widths = np.array([len(p) for p in packed])
            for width in np.unique(widths):
                at = np.flatnonzero(widths == width)
                codes = codes_of(_units([packed[i] for i in at], kind))
                rows = batch.take(pa.array(at))
                for t in range(turns):
                    yield pa.RecordBatch.from_arrays(
                        [rows.column(0), rows.column(1), rows.column(2),
                         pa.array(np.full(len(at), t, np.int32)), pa.array(codes[:, t]),
                         pa.array(np.full(len(at), width, np.int32)), rows.column(3)],
                        names=probe.names)

    probes = nodes.select("node", "copies", "_vector", F.xxhash64("_label").alias("_l")).mapInArrow(
        spread, probe)
    cell = ["label", "width", "turn", "code"]
    crowded = cut_lineage(
        probes.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK_ROWS)
        .select(*cell, F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks")))
    count = F.coalesce(F.col("blocks"), F.lit(1))
    if crowded.count() <= BROADCAST_CELLS:
        crowded = F.broadcast(crowded)
    dealt = (
        probes.join(crowded, cell, "left")
        .withColumn("side", F.pmod(F.xxhash64("node"), count).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), count - 1)))
        .withColumn("pair", F.struct(F.least("side", "other").alias("i"),
                                     F.greatest("side", "other").alias("k")))
    )
    parallel = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(parallel, nodes.count() * turns // GROUP_ROWS)
    tagged = dealt.select(
        "node", "copies", "vector", "turn", "side",
        (F.col("pair.i") == F.col("pair.k")).alias("whole"),
        F.xxhash64(*cell, "pair").alias("run"),
        F.pmod(F.xxhash64(*cell, "pair"), F.lit(groups)).alias("grp"))

    def link(table: pa.Table) -> pa.Table:
        run = table.column("run").to_numpy()
        order = np.argsort(run, kind="stable")
        starts = np.flatnonzero(np.r_[True, run[order][1:] != run[order][:-1]])
        node, copies, turn, side = (
            table.column(c).to_numpy() for c in ("node", "copies", "turn", "side"))
        whole = table.column("whole").to_numpy(zero_copy_only=False)
        vector = table.column("vector").to_pylist()
        degree = np.zeros(len(node), dtype=np.int64)
        pairs = []
        for s, e in zip(starts, np.r_[starts[1:], len(order)]):
            at = order[s:e]
            if len(at) < 2:
                continue
            units = _units([vector[i] for i in at], kind)
            width = units.shape[1]
            a, b = links_in_run(
                units, side[at], bool(whole[at[0]]), codes_of(units), int(turn[at[0]]), cosine,
                count_needed(min(PROJECTIONS, width), width, cosine))
            np.add.at(degree, at[a], copies[at[b]])
            np.add.at(degree, at[b], copies[at[a]])
            if len(a):
                pairs.append(np.stack(spanning(at[a], at[b], len(node)), axis=1))
        at = np.flatnonzero(degree)
        pairs = np.concatenate(pairs) if pairs else np.zeros((0, 2), int)
        none = pa.nulls(len(pairs), pa.int64())
        return pa.table({
            "a": pa.concat_arrays([pa.array(node[pairs[:, 0]]), pa.array(node[at])]),
            "b": pa.concat_arrays([pa.array(node[pairs[:, 1]]), pa.nulls(len(at), pa.int64())]),
            "n": pa.concat_arrays([none, pa.array(degree[at])])})

    found = cut_lineage(tagged.groupBy("grp").applyInArrow(link, "a long, b long, n long"))
    degrees = found.where("n IS NOT NULL").groupBy(F.col("a").alias("node")).agg(
        F.sum("n").alias("n"))
    roots = components(found.where("b IS NOT NULL").select("a", "b").distinct())
    placed = (
        nodes.join(degrees, "node", "left").join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    lowest = placed.groupBy("root").agg(F.min("low").alias("component"))
    named = placed.join(lowest, "root").select(
        F.col("_label").alias("l"), F.col("_vector").alias("v"), "component",
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"))
    same = (F.col("_vector") == F.col("v")) & (F.col("_label") == F.col("l"))
    component = F.when(F.col("v").isNull(), F.col("_id")).otherwise(F.col("component"))
    return vectors.join(named, same, "left").select(
        F.col("_id").alias(id_column), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("_id") == component, F.lit(False)).alias("kept"))
