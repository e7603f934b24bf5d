"""SimHash near-duplicates found by generalised pigeonhole probing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.core import cut_lineage
from tablewright.llm.common import map_rows, text_bytes
from tablewright.llm.components import components, settle, spanning

#: Distinct fingerprints that the cost model looks at. They only steer the choice of partitions and
#: thresholds; any choice finds the same pairs.
SAMPLE = 2_048
#: Rows of a probing group, and cost of testing a candidate against writing a row.
GROUP_ROWS, TEST_COST = 65_536, 0.02
#: Runs of equal keys above the first length are linked without listing their near pairs, above
#: the second (radius 2 at most) without comparing all of them; rows compared with a run at once.
LONG_RUN, HUGE_RUN, ROWS_AT_ONCE = 256, 200_000, 64
#: Rows of a probed value above which it is cut into blocks; crowded values broadcast at most.
BLOCK_ROWS, BROADCAST_KEYS = 16_384, 200_000
#: Shingle hashes whose bits are counted at once.
HASHES_AT_ONCE = 16_384


def fingerprint(raw: bytes, words: int, bits: int) -> bytes:
    """Majority bits of the shingle hashes of one text, most significant byte first.

    The text is lower-cased (A-Z) and split at ASCII white space. Each shingle of ``words`` words,
    repeats included, is hashed with XXH64 (seed 42); further 64-bit words of a wider fingerprint
    come from mixing that hash. A shorter text is one shingle; a text without words is all zeros.
    """
    return majority(shingle_hashes(raw, words), bits)


def shingles(raw: bytes, words: int) -> list[bytes]:
    """The shingles of one text in order, repeats included; none if it has no words."""
    parts = raw.lower().split()
    if len(parts) >= words:
        return list(map(b" ".join, zip(*(parts[i:] for i in range(words)))))
    return [b" ".join(parts)] if parts else []


def shingle_hashes(raw: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle."""
    own = shingles(raw, words)
    return np.fromiter(map(xxhash.xxh64_intdigest, own, repeat(42)), dtype=np.uint64, count=len(own))


def majority(hashes: np.ndarray, bits: int) -> bytes:
    """Majority bits of hashes, zeros if there are none."""
    n = len(hashes)
    if not n:
        return bytes(bits // 8)
    out = []
    for lane in range(bits // 64):
        mixed = hashes
        if lane:
            mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(
                (0x9E3779B97F4A7C15 * (2 * lane + 1)) & 0xFFFFFFFFFFFFFFFF)
            mixed ^= mixed >> np.uint64(32)
        counts = np.zeros(64, dtype=np.int64)
        for i in range(0, n, HASHES_AT_ONCE):
            own = mixed[i : i + HASHES_AT_ONCE].astype(">u8").view(np.uint8).reshape(-1, 8)
            counts += np.unpackbits(own, axis=1).sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * counts > n).tobytes())
    return b"".join(out)


def fingerprints(
    df: DataFrame, words: int, bits: int = 64, id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Id and fingerprint (binary, ``bits`` long) of every row; a null text has no words."""
    if bits % 64 or bits < 64:
        raise ValueError("bits must be a multiple of 64")
    out = T.StructType([T.StructField("fingerprint", T.BinaryType())])

    def compute(columns):
        return [[fingerprint(x, words, bits) for x in text_bytes(columns[0])]]

    return map_rows(df, [text_column], out, compute, keep=[id_column])


@dataclass(frozen=True)
class Probing:
    """Bits of each partition and the distance at which it is probed (-1: not at all)."""

    parts: tuple[tuple[int, ...], ...]
    radii: tuple[int, ...]


def _bits(packed: np.ndarray) -> np.ndarray:
    return np.unpackbits(packed, axis=1)


def correlated_parts(sample: np.ndarray, m: int) -> list[list[int]]:
    """Cut the bits into ``m`` parts of near equal width, bits that go together in one part."""
    width = sample.shape[1]
    spread = sample - (sample.mean(axis=0) if len(sample) else 0.5)
    scale = np.sqrt((spread**2).sum(axis=0))
    scale[scale == 0] = 1
    together = np.abs((spread / scale).T @ (spread / scale)) if len(sample) else np.eye(width)
    np.fill_diagonal(together, 0)
    free, parts = list(range(width)), []
    for k in range(m):
        size = len(free) // (m - k)
        part = [max(free, key=lambda b: (together[b, free].sum(), -b))]
        while len(part) < size:
            rest = [b for b in free if b not in part]
            part.append(max(rest, key=lambda b: (together[b, part].sum(), -b)))
        free = [b for b in free if b not in part]
        parts.append(sorted(part))
    return parts


def allocate(costs: list[list[float]], need: int) -> tuple[float, tuple[int, ...]]:
    """Radii of least total cost with sum(radius + 1) = ``need``; costs[i][t + 1] for radius t.

    If two fingerprints differ in at most need - 1 bits, some part differs in at most its radius:
    otherwise the parts would differ in sum(radius + 1) = need bits together. Dynamic programming
    over parts and what is still needed.
    """
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for row in costs:
        step: dict[int, tuple[float, tuple[int, ...]]] = {}
        for have, (cost, radii) in best.items():
            for k, own in enumerate(row):
                if have + k <= need:
                    found = (cost + own, (*radii, k - 1))
                    if have + k not in step or found < step[have + k]:
                        step[have + k] = found
        best = step
    if need not in best:
        raise ValueError("the parts cannot reach this radius")
    return best[need]


def choose_probing(sample: np.ndarray, rows: int, radius: int, most: int = 2) -> Probing:
    """Parts and radii of least estimated cost for ``rows`` distinct fingerprints.

    Candidates of a part at radius t are estimated from the sample pairs at that distance, and at
    least as many as independent bits would give; a probe costs a row for each variant.
    """
    width = sample.shape[1]
    rate = sample.mean(axis=0) if len(sample) else np.full(width, 0.5)
    differ = 2 * rate * (1 - rate)
    pairs = rows * (rows - 1) / 2
    options = []
    for m in sorted({-(-width // 32), -(-width // 16), -(-width // 21), radius + 1}):
        if m > width // 8 or width / m > 40:
            continue
        parts, costs = correlated_parts(sample, m), []
        for part in parts:
            spots = sample[:, part].astype(np.float32)
            ones = spots.sum(axis=1)
            apart = ones[:, None] + ones[None, :] - 2 * spots @ spots.T
            near = np.triu_indices(len(sample), 1)
            seen = np.bincount(np.rint(apart[near]).astype(int), minlength=len(part) + 1)
            chance = np.array([1.0])
            for p in differ[part]:
                chance = np.convolve(chance, [1 - p, p])
            row, variants = [0.0], 1
            for t in range(most + 1):
                if t:
                    variants += math.comb(len(part), t)
                share = max(seen[: t + 1].sum() / max(1, len(near[0])), chance[: t + 1].sum())
                row.append(rows * (variants + (t > 0)) + TEST_COST * pairs * share)
            costs.append(row)
        try:
            options.append((*allocate(costs, radius + 1), parts))
        except ValueError:
            continue
    _, radii, parts = min(options, key=lambda x: x[0])
    return Probing(tuple(map(tuple, parts)), radii)


def probe_keys(packed: np.ndarray, probing: Probing) -> Iterator[tuple[np.ndarray, int]]:
    """Keys of all fingerprints, one array for each part and variant; 1 marks the own value.

    A key holds the part's number above 40 bits of its value. At radius 0 only the own value is
    written; at a larger radius also every value within it, as a probe.
    """
    spots = _bits(packed)
    for k, (part, radius) in enumerate(zip(probing.parts, probing.radii)):
        if radius < 0:
            continue
        weights = np.uint64(1) << np.arange(len(part), dtype=np.uint64)
        value = (spots[:, list(part)].astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)
        value |= np.uint64(k) << np.uint64(40)
        yield value, 1
        for t in range(1, radius + 1):
            for flips in combinations(range(len(part)), t):
                yield value ^ np.uint64(sum(1 << f for f in flips)), 0


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows of 64-bit words, one word at a time to keep the memory small."""
    total = np.bitwise_count(a[..., 0] ^ b[..., 0]).astype(np.uint16)
    for w in range(1, a.shape[-1]):
        total += np.bitwise_count(a[..., w] ^ b[..., w])
    return total


def link_run(words: np.ndarray, radius: int) -> np.ndarray:
    """Component labels (row numbers) of one long run of equal keys, in linear memory.

    Blocks of rows are compared with all rows, and only pairs from different components so far are
    looked at. Up to radius 2 two fingerprints are near if they agree after some two bits are
    masked, so rows of a huge run are grouped by every mask of two bits that vary instead. Two
    probes that are near may be linked here too; that changes no component.
    """
    n = len(words)
    label = np.arange(n)
    if radius > 2 or n <= HUGE_RUN:
        for i in range(0, n, ROWS_AT_ONCE):
            own = slice(i, i + ROWS_AT_ONCE)
            near = _distance(words[own, None, :], words[None, :, :]) <= radius
            near &= label[own, None] != label[None, :]
            a, b = np.nonzero(near)
            if len(a):
                label = settle(label, label[a + i], label[b])
        return label
    spread = np.bitwise_or.reduce(words ^ words[:1], axis=0)
    vary = [(w, b) for w in range(words.shape[1]) for b in range(64)
            if spread[w] >> np.uint64(b) & np.uint64(1)]
    for mask in combinations(vary, min(radius, len(vary))):
        kept = words.copy()
        for w, b in mask:
            kept[:, w] &= ~(np.uint64(1) << np.uint64(b))
        order = np.lexsort(kept.T)
        same = np.flatnonzero((kept[order[1:]] == kept[order[:-1]]).all(axis=1))
        a, b = label[order[same]], label[order[same + 1]]
        if (a != b).any():
            label = settle(label, a, b)
    return label


def find_links(key: np.ndarray, own: np.ndarray, words: np.ndarray, radius: int) -> np.ndarray:
    """Row pairs whose links connect everything that is near within runs of equal keys."""
    order = np.lexsort((1 - own, key))
    key, own, words = key[order], own[order], words[order]
    same = key[1:] == key[:-1]
    starts = np.flatnonzero(np.r_[True, ~same]) if len(key) else np.zeros(0, int)
    lengths = np.diff(np.r_[starts, len(key)])
    run = np.repeat(np.arange(len(starts)), lengths)
    found = []
    for s, n in zip(starts[lengths > LONG_RUN], lengths[lengths > LONG_RUN]):
        label = link_run(words[s : s + n], radius)
        moved = np.flatnonzero(label != np.arange(n))
        found.append(np.stack([s + moved, s + label[moved]], axis=1))
    rest = np.flatnonzero(lengths[run] <= LONG_RUN) if len(key) else np.zeros(0, int)
    a = b = np.zeros(0, dtype=np.int64)
    for gap in range(1, int(lengths[lengths <= LONG_RUN].max(initial=1))):
        at = rest[rest + gap < len(key)]
        at = at[run[at] == run[at + gap]]
        if not len(at):
            break
        at = at[own[at] == 1]  # own values come first, so a pair of two probes is left out
        near = at[_distance(words[at], words[at + gap]) <= radius]
        a, b = np.r_[a, near], np.r_[b, near + gap]
        if len(a) > 1 << 20:
            a, b = spanning(a, b, len(key))
    if len(a):
        found.append(np.stack(spanning(a, b, len(key)), axis=1))
    pairs = np.concatenate(found) if found else np.zeros((0, 2), dtype=np.int64)
    return order[pairs]


def near_links(
    distinct: DataFrame, radius: int, guarantee: int | None = None, bits: int = 64
) -> DataFrame:
    """Links (a, b) between numbered fingerprints, with the components of "at most ``radius`` bits".

    ``distinct`` has columns node (long, unique) and fingerprint. All pairs within ``guarantee``
    bits (default: the radius) share a probed value and are found. A wider radius also links what
    happens to share one. No group's pairs are written: a task returns a spanning set of links.
    """
    guarantee = radius if guarantee is None else guarantee
    rows = distinct.count()
    sample = distinct.orderBy(F.xxhash64("fingerprint"), "node").limit(SAMPLE).select("fingerprint")
    packed = np.frombuffer(
        b"".join(bytes(r[0]) for r in sample.collect()), dtype=np.uint8).reshape(-1, bits // 8)
    probing = choose_probing(_bits(packed).astype(np.float64), rows, guarantee)
    variants = sum(1 for _ in probe_keys(np.zeros((1, bits // 8), np.uint8), probing))
    parallel = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(parallel, rows * variants // GROUP_ROWS)
    out = T.StructType([
        T.StructField("key", T.LongType()),
        T.StructField("own", T.LongType()), T.StructField("node", T.LongType()),
        T.StructField("fingerprint", T.BinaryType())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, prints = batch.column(0), batch.column(1).cast(pa.binary())
            if not len(node):
                continue
            own_bits = np.frombuffer(
                b"".join(prints.to_pylist()), dtype=np.uint8).reshape(len(node), -1)
            for key, own in probe_keys(own_bits, probing):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.astype(np.int64)),
                     pa.array(np.full(len(key), own, np.int64)), node, prints], names=out.names)

    def link(table: pa.Table) -> pa.Table:
        prints = b"".join(table.column("fingerprint").to_pylist())
        words = np.frombuffer(prints, dtype=np.uint64).reshape(table.num_rows, -1)
        run, own, node = (table.column(c).to_numpy() for c in ("run", "own", "node"))
        pairs = node[find_links(run, own, words, radius)]
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()),
                         "b": pa.array(pairs[:, 1], pa.int64())})

    probes = distinct.select("node", "fingerprint").mapInArrow(spread, out)
    # a crowded value is cut into blocks, and every two blocks meet in a run of their own
    crowded = cut_lineage(
        probes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK_ROWS)
        .select("key", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks")))
    if crowded.count() <= BROADCAST_KEYS:
        crowded = F.broadcast(crowded)
    count = F.coalesce(F.col("blocks"), F.lit(1))
    side, other = F.pmod(F.xxhash64("node"), count).cast("int"), F.col("other")
    dealt = probes.join(crowded, "key", "left").withColumn("side", side).withColumn(
        "other", F.explode(F.sequence(F.lit(0), count - 1)))
    run = F.xxhash64("key", F.least("side", other), F.greatest("side", other))
    tagged = dealt.select(run.alias("run"), "own", "node", "fingerprint",
                          F.pmod(run, F.lit(groups)).alias("grp"))
    return tagged.groupBy("grp").applyInArrow(link, "a long, b long").distinct()


def near_components(
    df: DataFrame,
    words: int = 3,
    bits: int = 64,
    radius: int = 2,
    guarantee: int | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Id, fingerprint (binary) and component_id of every row.

    component_id is the smallest id reachable over links of at most ``radius`` differing bits, the
    row's own id included. Equal fingerprints are one node, so thousands of copies cost one probe.
    Null and empty texts have the zero fingerprint and link like any other. A null id takes part
    but never names a component (null only if a component has no other). Repeated ids give one
    row each, and an empty table gives none. Other columns are not read.
    """
    prints = cut_lineage(fingerprints(
        df.select(F.col(f"`{id_column}`").alias("_id"), F.col(f"`{text_column}`").alias("_text")),
        words, bits, "_id", "_text"))
    distinct = cut_lineage(
        prints.groupBy("fingerprint").agg(F.min("_id").alias("low"))
        .withColumn("node", F.monotonically_increasing_id()))
    roots = components(near_links(distinct, radius, guarantee, bits))
    placed = distinct.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    named = placed.join(lowest, "root").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint").select(
        F.col("_id").alias(id_column), "fingerprint", "component_id")
