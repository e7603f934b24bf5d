"""Near-duplicates at a Jaccard similarity: SimHash with generalised pigeonhole, verified on shingles.

Pigeonhole probing joins what is close first. Its reach is a number of differing bits, far fewer than
sets at the threshold may have, so what it leaves apart meets in cells of sampled bits, of stated recall.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.core import cut_lineage, fits_broadcast
from tablewright.llm.common import free_disk, map_rows, release, text_bytes
from tablewright.llm.components import components
from tablewright.llm.simhash import (
    Probing,
    _distance,
    majority,
    near_links,
    probe_keys,
    shingle_hashes,
)
from tablewright.operators.lookup import HOT_SHARE, Lookup, attach

BITS, SEED = 512, 20_260_301
#: Share of pairs at the threshold that cells and filters may miss together.
MISS = 1e-3
#: Sets up to this size also meet by prefixes of their hashes, which misses nothing.
SHORT = 6
#: Bits carried by a probe; differing bits allowed in them and, before verifying, in all.
SKETCH, SKETCH_RADIUS, RADIUS = 128, 40, 116
#: Differing bits of a sketch that pigeonhole parts are certain to find, and those at which they link.
GUARANTEE, JOIN_RADIUS = 7, 20
#: Probes wanted in a task's group, rows above which a cell is cut into blocks, rows compared with a
#: block at once, and cost of comparing two rows against writing one.
GROUP_ROWS, BLOCK_ROWS, ROWS_AT_ONCE, TEST_COST = 65_536, 2_048, 256, 0.002
#: Nodes whose cells are counted; a larger table is sampled, as counts only steer the blocks.
COUNTED_NODES = 1_000_000
#: Keys broadcast at most; bytes of texts and hashes that a verifying task keeps; passes in which
#: crowded cells are joined by representatives, before all near pairs that are left are compared.
BROADCAST_ROWS, HELD_BYTES, PASSES = 200_000, 8 << 20, 8
#: Weight of a text byte where broadcasting is decided; pairs of texts unpacked at a time.
SMALL_TEXTS, TEXTS_AT_ONCE = 8, 64


def bit_chance(threshold: float) -> float:
    """Largest probability that a bit differs at ``threshold``, over sets of more than SHORT.

    With J common of U shingles, sets of equal size are furthest apart: angle / pi at the cosine
    2 J / (1 + J). Small sets deviate from it, by up to 0.01 at 0.8 (15 shingles; tests enumerate them).
    """
    return math.acos(2 * threshold / (1 + threshold)) / math.pi + 0.011


def recall(signs: int, parts: int, chance: float) -> float:
    """Probability that a pair whose bits differ with ``chance`` meets and passes the filters."""
    d = np.arange(RADIUS + 1)
    log = np.array([math.lgamma(i + 1) for i in range(BITS + 1)])
    weight = np.exp(log[BITS] - log[d] - log[BITS - d] + d * math.log(chance)
                    + (BITS - d) * math.log1p(-chance))
    agree = np.exp(log[BITS - d] - log[BITS - d - signs] - log[BITS] + log[BITS - signs])
    k = np.arange(SKETCH_RADIUS + 1)
    passes = np.exp(log[SKETCH] - log[k] - log[SKETCH - k] + k * math.log(chance)
                    + (SKETCH - k) * math.log1p(-chance)).sum()
    return float((weight * (1 - (1 - agree) ** parts)).sum() - (1 - passes))


def parts_needed(signs: int, threshold: float) -> int:
    """Fewest parts of ``signs`` bits whose recall at the threshold is at least 1 - MISS."""
    chance, low, high = bit_chance(threshold), 0, 1
    while recall(signs, high, chance) < 1 - MISS:
        low, high = high, 2 * high
        if high > 1 << 14:
            raise ValueError("this threshold is too low for the filters")
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if recall(signs, middle, chance) >= 1 - MISS else (middle, high)
    return high


def cell_parts(rows: int, threshold: float) -> Probing:
    """Parts of equal width for ``rows`` nodes; width and number change together, the recall stays.

    Bits are dealt by permutations of a fixed seed, not by the data.
    """
    signs, parts = min(
        ((s, parts_needed(s, threshold)) for s in range(6, 22)),
        key=lambda x: x[1] * (1 + TEST_COST * rows / 2 ** (x[0] + 1)))
    rng, free, chosen = np.random.default_rng(SEED), [], []
    for _ in range(parts):
        if len(free) < signs:
            free = rng.permutation(BITS).tolist()
        chosen.append(tuple(sorted(free[:signs])))
        free = free[signs:]
    return Probing(tuple(chosen), (0,) * parts)


def prefix(hashes: np.ndarray, threshold: float) -> np.ndarray:
    """The smallest hashes of a set; two sets at the threshold have one of theirs in common."""
    n = len(hashes)
    return hashes[: n - math.ceil(threshold * n - 1e-9) + 1] if n else hashes


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether the Jaccard similarity of two sets of distinct hashes is at least ``threshold``."""
    if min(len(a), len(b)) < threshold * max(len(a), len(b)) - 1e-9:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= threshold * (len(a) + len(b) - common) - 1e-9


class HashSets:
    """Shingle hashes of the (packed) texts seen last, HELD_BYTES of texts and hashes in all."""

    def __init__(self, words: int):
        self.words, self.held, self.size = words, {}, 0
        self.coder = zstandard.ZstdDecompressor()

    def get(self, text: bytes) -> np.ndarray:
        found = self.held.pop(text, None)
        if found is None:
            found = np.unique(shingle_hashes(self.coder.decompress(text), self.words))
            self.size += len(text) + found.nbytes
        self.held[text] = found  # the last one used stands at the end
        while self.size > HELD_BYTES and len(self.held) > 1:
            old = next(iter(self.held))
            self.size -= len(old) + self.held.pop(old).nbytes
        return found


def _near(words: np.ndarray, size: np.ndarray, left: np.ndarray, threshold: float) -> np.ndarray:
    """Rows ``left`` against all: near sketches and sizes that allow the threshold."""
    near = _distance(words[left, None, :], words[None, :, :]) <= SKETCH_RADIUS
    low = np.minimum(size[left, None], size[None, :])
    return near & (low >= threshold * np.maximum(size[left, None], size[None, :]) - 1e-9)


def star_run(words: np.ndarray, size: np.ndarray, threshold: float) -> list[tuple]:
    """A candidate link from every row to the first earlier row that is near."""
    found = []
    for i in range(0, len(words), ROWS_AT_ONCE):
        left = np.arange(i, min(i + ROWS_AT_ONCE, len(words)))
        near = _near(words, size, left, threshold)
        near &= np.arange(len(words))[None, :] < left[:, None]
        first = near.argmax(axis=1)
        has = near[np.arange(len(left)), first]
        found.append((left[has], first[has]))
    return found


def pair_run(
    words: np.ndarray, size: np.ndarray, label: np.ndarray, threshold: float, part: int,
    probing: Probing,
) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of a run that are near by their whole fingerprints and differ in label.

    One side of each is a row that does not have the run's most common label. A pair that also
    meets in the cell of an earlier part is left to it, so cells share out the work; where sets
    meet by a hash (``part`` beyond the parts) nothing is left out.
    """
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    values, at, counts = np.unique(label, return_inverse=True, return_counts=True)
    common = at == counts.argmax()
    rest, earlier = np.flatnonzero(~common), None
    for i in range(0, len(rest), ROWS_AT_ONCE):
        own = rest[i : i + ROWS_AT_ONCE]
        low, high = (f(size[own, None], size[None, :]) for f in (np.minimum, np.maximum))
        near = (_distance(words[own, None, :], words[None, :, :]) <= RADIUS) | (low <= SHORT)
        near &= (low >= threshold * high - 1e-9) & (at[own, None] != at[None, :])
        near &= common[None, :] | (np.arange(len(words))[None, :] < own[:, None])
        a, b = np.nonzero(near)
        a = own[a]
        if len(a) and 0 < part < len(probing.parts):
            if earlier is None:
                before = Probing(probing.parts[:part], probing.radii[:part])
                packed = words.view(np.uint8).reshape(len(words), -1)
                earlier = [key for key, _ in probe_keys(packed, before)]
            for key in earlier:
                first = key[a] != key[b]
                a, b = a[first], b[first]
        left.append(a)
        right.append(b)
    return np.concatenate(left), np.concatenate(right)


def _chunks(size: np.ndarray, most: int) -> list[np.ndarray]:
    """Rows in runs of at most ``most`` bytes of hashes; a larger set is a run of its own."""
    cuts, total = [0], 0
    for i, n in enumerate(size.tolist()):
        if total and total + 8 * n > most:
            cuts.append(i)
            total = 0
        total += 8 * n
    return [np.arange(s, e) for s, e in zip(cuts, [*cuts[1:], len(size)])]


def joined_run(
    sets: Callable[[int], np.ndarray], size: np.ndarray, label: np.ndarray, left: np.ndarray,
    right: np.ndarray, threshold: float,
) -> list[tuple[int, int]]:
    """Links that join all rows of a run which candidate pairs of the threshold connect.

    ``sets`` gives a row's distinct hashes. Every pair is decided by its sets, unless links found
    before connect it already. Two chunks of sets are held at a time.
    """
    if not len(left):
        return []
    chunks, found = _chunks(size, HELD_BYTES), []
    home = np.repeat(np.arange(len(chunks)), [len(c) for c in chunks])
    label = label.copy()
    low, high = np.minimum(left, right), np.maximum(left, right)
    order = np.lexsort((high, low, home[high], home[low]))
    low, high = low[order], high[order]
    meet = home[low] * len(chunks) + home[high]
    held: dict[int, dict[int, np.ndarray]] = {}
    for at in np.split(np.arange(len(low)), np.flatnonzero(meet[1:] != meet[:-1]) + 1):
        held = {c: held.get(c, {}) for c in {home[low[at[0]]], home[high[at[0]]]}}
        used = np.unique(np.r_[low[at], high[at]]).tolist()
        for i in used:
            if i not in held[home[i]]:
                held[home[i]][i] = sets(i)
        ids = np.unique(np.concatenate([held[home[i]][i] for i in used]), return_inverse=True)[1]
        number = dict(zip(used, np.split(ids, np.cumsum([len(held[home[i]][i]) for i in used])[:-1])))
        mark = np.zeros(ids.max(initial=0) + 1, bool)
        starts = np.flatnonzero(np.r_[True, low[at][1:] != low[at][:-1]])
        for s, e in zip(starts, np.r_[starts[1:], len(at)]):
            a, others = int(low[at[s]]), high[at[s:e]]
            others = others[label[others] != label[a]]
            if not len(others):
                continue
            mark[number[a]] = True
            for i in range(0, len(others), TEXTS_AT_ONCE):
                b = others[i : i + TEXTS_AT_ONCE]
                own_sizes = np.array([len(number[j]) for j in b.tolist()])
                if not own_sizes.all():  # an empty set is near none but itself
                    b, own_sizes = b[own_sizes > 0], own_sizes[own_sizes > 0]
                    if not len(b):
                        continue
                hits = mark[np.concatenate([number[j] for j in b.tolist()])]
                both = np.add.reduceat(hits.astype(np.int64), np.cumsum(own_sizes) - own_sizes)
                total = len(number[a]) + own_sizes - both
                for j in b[both >= threshold * total - 1e-9].tolist():
                    if label[j] != label[a]:
                        found.append((a, j))
                        label[label == label[j]] = label[a]
            mark[number[a]] = False
    return found


def _runs_across(table: pa.Table, threshold: float, probing: Probing) -> Iterator[tuple]:
    """Rows of each run with a near pair of different labels, by node; their columns and pairs."""
    run, part, node, label, size = (
        table.column(c).to_numpy() for c in ("run", "part", "node", "label", "size"))
    words = np.frombuffer(
        b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(run), -1)
    order = np.lexsort((node, run))
    starts = np.flatnonzero(np.r_[True, run[order][1:] != run[order][:-1]])
    for s, e in zip(starts, np.r_[starts[1:], len(order)]):
        at = order[s:e]
        if e - s < 2 or (label[at] == label[at[0]]).all():
            continue
        left, right = pair_run(words[at], size[at], label[at], threshold, part[at[0]], probing)
        if len(left):
            yield at, (node[at], label[at], size[at]), left, right


def _ordered(links: DataFrame) -> DataFrame:
    """Each link once, the later node first, so that many links end in few nodes."""
    return cut_lineage(links.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


class NearSets:
    """The sets of one table, their cells and the verification of links between them."""

    def __init__(self, rows: DataFrame, words: int, threshold: float):
        """``rows``: row (long, unique), key (comparable) and text, read again for some rows."""
        self.rows, self.words, self.threshold = rows, words, threshold
        out = T.StructType([
            T.StructField("digest", T.BinaryType()), T.StructField("size", T.IntegerType()),
            T.StructField("prefix", T.BinaryType()), T.StructField("fingerprint", T.BinaryType())])

        def compute(columns):
            found = []
            for raw in text_bytes(columns[0]):
                own = np.unique(shingle_hashes(raw, words))
                short = prefix(own, threshold) if len(own) <= SHORT / threshold else own[:0]
                found.append((xxhash.xxh3_128_digest(own.tobytes()), len(own), short.tobytes(),
                              majority(own, BITS)))
            return [list(c) for c in zip(*found)] if found else [[], [], [], []]

        self.sketched = cut_lineage(map_rows(rows, ["text"], out, compute, keep=["row", "key"]))
        self.nodes = cut_lineage(
            self.sketched.groupBy("digest").agg(
                F.min("key").alias("low"), F.min("row").alias("row"), F.first("size").alias("size"),
                F.first("prefix").alias("prefix"), F.first("fingerprint").alias("fingerprint"))
            .withColumn("node", F.monotonically_increasing_id()))
        self.count = self.nodes.count()
        self.probing = cell_parts(self.count, threshold)
        self.parallel = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def probes(self, nodes: DataFrame, parts: int, bits: int = SKETCH) -> DataFrame:
        """One row for each node, of the columns given and ``label``, in each of its cells.

        The sketch of a row is the first ``bits`` of its fingerprint.
        """
        probing = Probing(self.probing.parts[:parts], self.probing.radii[:parts])
        out = T.StructType([
            T.StructField("cell", T.LongType()), T.StructField("node", T.LongType()),
            T.StructField("label", T.LongType()), T.StructField("size", T.IntegerType()),
            T.StructField("sketch", T.BinaryType())])

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                prints = batch.column(4).to_pylist()
                sketch = pa.array([p[: bits // 8] for p in prints], pa.binary())
                own = [*(batch.column(i) for i in range(3)), sketch]
                packed = np.frombuffer(b"".join(prints), np.uint8).reshape(len(prints), -1)
                for cell, _ in probe_keys(packed, probing):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell.astype(np.int64)), *own], names=out.names)
                short = [np.frombuffer(x, np.uint64) >> np.uint64(2) for x in
                         batch.column(3).to_pylist()]
                at = np.repeat(np.arange(len(short)), [len(x) for x in short])
                if len(at):
                    cell = (np.concatenate(short) | np.uint64(1 << 62)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell), *(c.take(pa.array(at)) for c in own)], names=out.names)

        return nodes.select("node", "label", "size", "prefix", "fingerprint").mapInArrow(spread, out)

    def crowded(self, nodes: DataFrame, parts: int) -> tuple[DataFrame, int]:
        """Cells of more than BLOCK_ROWS nodes (estimated): blocks of their commonest label, of the rest."""
        share = max(1, self.count // COUNTED_NODES)
        counted = nodes.where(F.pmod(F.xxhash64("node"), F.lit(share)) == 0)
        blocks = (
            self.probes(counted, parts).groupBy("cell", "label").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("cell").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("top"))
            .where(F.col("n") * share > BLOCK_ROWS))
        size = F.lit(share / BLOCK_ROWS)
        found = cut_lineage(blocks.select(
            "cell", F.col("top.label").alias("top"),
            F.ceil(F.col("n") * size).cast("int").alias("blocks"),
            F.ceil(F.col("top.n") * size).cast("int").alias("tops"),
            F.greatest(F.ceil((F.col("n") - F.col("top.n")) * size), F.lit(int(share > 1)))
            .cast("int").alias("rests")))
        n = found.count()
        return (F.broadcast(found) if n <= BROADCAST_ROWS else found), n

    def pigeonholed(self) -> DataFrame:
        """Candidate links by generalised pigeonhole: all within GUARANTEE bits of a sketch are joined."""
        sketches = self.nodes.select(
            "node", F.substring("fingerprint", 1, SKETCH // 8).alias("fingerprint"))
        return _ordered(near_links(sketches, JOIN_RADIUS, GUARANTEE, SKETCH))

    def stars(self, nodes: DataFrame, parts: int) -> tuple[DataFrame, int]:
        """Candidate links within the blocks of each cell, and the number of cells cut into blocks."""
        crowded, n = self.crowded(nodes, parts)
        side = F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1)))
        dealt = self.probes(nodes, parts).join(crowded, "cell", "left").withColumn(
            "run", F.xxhash64("cell", side))
        return self._candidates(dealt, parts), n

    def across(self, nodes: DataFrame, parts: int) -> DataFrame:
        """Verified links that join what near pairs of different labels connect.

        In a crowded cell, blocks of the commonest label meet the blocks of the rest only. No pairs
        are written: a run of nodes that meet returns those with a near pair, which are brought
        together again with their texts and return links without cycles.
        """
        crowded, _ = self.crowded(nodes, parts)
        of = F.xxhash64("node", F.lit(1))
        series = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1))
        run = lambda *x: F.xxhash64("cell", *x)
        top = F.transform(series(F.col("rests")), lambda j: run(
            F.lit("t"), F.pmod(of, F.col("tops")), j.cast("long")))
        own = F.pmod(of, F.col("rests"))
        rest = F.concat(
            F.transform(series(F.col("tops")), lambda i: run(F.lit("t"), i.cast("long"), own)),
            F.transform(series(F.col("rests")), lambda j: run(
                F.lit("r"), F.least(own, j.cast("long")), F.greatest(own, j.cast("long")))))
        runs = F.when(F.col("blocks").isNull(), F.array(F.xxhash64("cell"))).when(
            F.col("label") == F.col("top"), top).otherwise(rest)
        dealt = self.probes(nodes, parts, BITS).join(crowded, "cell", "left").withColumn(
            "run", F.explode(runs)).withColumn("part", F.shiftright("cell", 40).cast("int"))
        threshold, probing, shingle = self.threshold, self.probing, self.words
        columns = ["run", "part", "node", "label", "size", "sketch"]

        def near_rows(table: pa.Table) -> pa.Table:
            kept = [np.zeros(0, np.int64)]
            for at, _, left, right in _runs_across(table, threshold, probing):
                kept.append(at[np.unique(np.r_[left, right])])
            return table.select(columns).take(pa.array(np.concatenate(kept)))

        def join(table: pa.Table) -> pa.Table:
            coder, texts, found = zstandard.ZstdDecompressor(), table.column("text"), []
            for at, (node, label, size), left, right in _runs_across(table, threshold, probing):
                links = joined_run(
                    lambda i: np.unique(shingle_hashes(  # noqa: B023
                        coder.decompress(texts[int(at[i])].as_py()), shingle)),  # noqa: B023
                    size, label, left, right, threshold)
                found += [(node[i], node[j]) for i, j in links]
            release()
            return pa.table({c: pa.array([x[k] for x in found], pa.int64())
                             for k, c in enumerate(("a", "b"))})

        shape = "run long, part int, node long, label long, size int, sketch binary"
        groups = F.lit(max(self.parallel, self.count * parts // GROUP_ROWS))
        met = cut_lineage(
            dealt.select(*columns, F.pmod(F.xxhash64("run"), groups).alias("grp"))
            .groupBy("grp").applyInArrow(near_rows, shape))
        packed, count, size = self._packed(met.select("node").distinct())
        text = F.broadcast(packed) if fits_broadcast(count, 32 * count + SMALL_TEXTS * size) else packed
        rows, size = met.join(packed.select("node", F.octet_length("text").alias("n")), "node").agg(
            F.count(F.lit(1)), F.sum("n")).first()
        groups = F.lit(max(self.parallel, (size or 0) // HELD_BYTES, rows // GROUP_ROWS))
        found = met.join(text, "node").select(
            *columns, "text", F.pmod(F.xxhash64("run"), groups).alias("grp"))
        return _ordered(found.groupBy("grp").applyInArrow(join, "a long, b long"))

    def _candidates(self, dealt: DataFrame, parts: int) -> DataFrame:
        threshold = self.threshold
        groups = max(self.parallel, self.count * parts // GROUP_ROWS)

        def link(table: pa.Table) -> pa.Table:
            run, node, size = (table.column(c).to_numpy() for c in ("run", "node", "size"))
            words = np.frombuffer(
                b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(run), -1)
            order = np.lexsort((node, run))
            starts = np.flatnonzero(np.r_[True, run[order][1:] != run[order][:-1]])
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for s, e in zip(starts, np.r_[starts[1:], len(order)]):
                if e - s < 2:
                    continue
                at = order[s:e]
                for a, b in star_run(words[at], size[at], threshold):
                    left.append(node[at[a]])
                    right.append(node[at[b]])
            return pa.table({"a": pa.array(np.concatenate(left), pa.int64()),
                             "b": pa.array(np.concatenate(right), pa.int64())})

        tagged = dealt.select("run", "node", "size", "sketch", F.pmod(
            F.xxhash64("run"), F.lit(groups)).alias("grp"))
        found = tagged.groupBy("grp").applyInArrow(link, "a long, b long").where("a <> b")
        return _ordered(found)

    def _packed(self, nodes: DataFrame) -> tuple[DataFrame, int, int]:
        """Compressed texts of distinct nodes, their number and bytes."""
        ends = cut_lineage(nodes.join(self.nodes.select("node", "row"), "node").select("node", "row"))
        if ends.count() <= BROADCAST_ROWS:
            ends = F.broadcast(ends)
        texts = self.rows.select("row", "text").join(ends, "row").select("node", "text")

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            coder = zstandard.ZstdCompressor(level=1)
            for batch in batches:
                for i in range(0, batch.num_rows, TEXTS_AT_ONCE):
                    part = batch.slice(i, TEXTS_AT_ONCE)
                    own = [coder.compress(t) for t in text_bytes(part.column(1))]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array(own, pa.binary())], names=["node", "text"])

        packed = cut_lineage(texts.mapInArrow(pack, "node long, text binary"))
        count, size = packed.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
        return packed, count, size or 0

    def verified(self, pairs: DataFrame, nearest: bool = False) -> DataFrame:
        """The links whose texts have the similarity, after a look at the whole fingerprints.

        With ``nearest`` only the link of least distance is looked at for each ``a``: enough for
        links that serve to join, as all others are candidates again later.
        """
        threshold, words = self.threshold, self.words
        prints = self.nodes.select("node", "size", "fingerprint")
        both = pairs.join(prints.select(F.col("node").alias("a"), F.col("size").alias("size_a"),
                                        F.col("fingerprint").alias("print_a")), "a")
        both = both.join(prints.select(F.col("node").alias("b"), F.col("size").alias("size_b"),
                                       F.col("fingerprint").alias("print_b")), "b")

        def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(
                    batch.num_rows, -1) for i in (3, 5))
                small = np.minimum(batch.column(2).to_numpy(), batch.column(4).to_numpy()) <= SHORT
                apart = _distance(x, y)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(apart.astype(np.int32))],
                    names=["a", "b", "apart"]).filter(pa.array((apart <= RADIUS) | small))

        near = both.select("a", "b", "size_a", "print_a", "size_b", "print_b").mapInArrow(
            passing, "a long, b long, apart int")
        if nearest:
            near = near.groupBy("a").agg(F.min_by("b", F.struct("apart", "b")).alias("b"))
        wanted = cut_lineage(near.select("a", "b"))
        total = wanted.count()
        packed, count, size = self._packed(
            wanted.select(F.col("a").alias("node")).union(wanted.select("b")).distinct())
        small = fits_broadcast(count, 32 * count + SMALL_TEXTS * size)

        def texts_of(end: str) -> Lookup:
            """Texts by node; the nodes at that end of many links are dealt out by ``attach``."""
            links = wanted.groupBy(end).agg(F.count(F.lit(1)).alias("n"))
            hot = [] if small else links.where(F.col("n") * HOT_SHARE >= total).select(end).collect()
            named = packed.withColumnRenamed("text", f"text_{end}")
            return Lookup(named, ["node"], count, small, [tuple(r) for r in hot])

        joined = attach(attach(wanted, texts_of("a"), ["a"]), texts_of("b"), ["b"])

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = HashSets(words)
            for batch in batches:
                mask = []
                for i in range(0, batch.num_rows, TEXTS_AT_ONCE):
                    x, y = (batch.column(c).slice(i, TEXTS_AT_ONCE).to_pylist() for c in (2, 3))
                    mask += [similar(own.get(a), own.get(b), threshold) for a, b in zip(x, y)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1)], names=["a", "b"]).filter(
                        pa.array(mask, pa.bool_()))
            release()

        return cut_lineage(joined.select("a", "b", "text_a", "text_b").mapInArrow(
            judge, "a long, b long"))

    def labelled(self, links: DataFrame) -> DataFrame:
        """The nodes with their component; what finding the links and rounds left on disk is freed."""
        found = cut_lineage(self.nodes.join(components(links), "node", "left").withColumn(
            "label", F.coalesce("root", "node")).drop("root"))
        free_disk(self.rows.sparkSession, (0, 1))
        return found

    def components(self) -> DataFrame:
        """Row, key and component (its smallest key) of every row.

        Links of the pigeonhole parts are verified first, then star links between the representatives
        of what was joined, until no cell of representatives is crowded, PASSES times at most; a hot
        group is one label by then. Last, every near pair of different labels is verified, whatever
        is left.
        """
        parts = len(self.probing.parts)
        few = -(-parts // 4)
        links = self.verified(self.pigeonholed(), nearest=True)
        free_disk(self.rows.sparkSession, (0, 1))
        nodes = self.labelled(links)
        for _ in range(PASSES):
            candidates, blocks = self.stars(nodes.where("label = node"), few)
            found = self.verified(candidates, nearest=True)
            del candidates
            links = links.union(found)
            nodes = self.labelled(links)
            if not blocks or found.isEmpty():
                break
        links = links.union(self.across(nodes, parts))
        nodes = self.labelled(links)
        lowest = nodes.groupBy("label").agg(F.min("low").alias("component"))
        named = nodes.join(lowest, "label").select("digest", "component")
        return self.sketched.join(named, "digest").select("row", "key", "component")


def near_components(rows: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """Row, key and component of each row of ``rows`` (row, key, text).

    Texts link if the Jaccard similarity of their sets of ``words``-word shingles is at least
    ``threshold``; every link is verified. A pair at the threshold is missed with probability MISS
    at most, whatever the rows and their number; closer pairs less. Equal sets are one node. Null
    and empty texts have the empty set and are equal. ``rows`` must be stored: it is read twice.
    """
    return NearSets(rows, words, threshold).components()
