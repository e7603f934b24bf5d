"""The near-dedup stage of the pipeline against brute-force Jaccard similarities."""

import math
import pathlib
import random
from math import comb

import numpy as np
import pytest
import zstandard
from helpers import awkward_texts, components_of, documents, raw

import corpus_pipeline
from tablewright.core import ensure_checkpoint_dir
from tablewright.llm import near_sets, simhash


def grams(text):
    w = raw(text).lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return 1.0 if a == b else len(a & b) / len(a | b)


def edited_texts(seed, groups, sizes=(12, 400), most=4):
    """Groups of texts at similarities around the threshold."""
    r, texts = random.Random(seed), []
    for g in range(groups):
        base = [f"w{r.randrange(10**6)}" for _ in range(r.randrange(*sizes))]
        texts.append(" ".join(base))
        for _ in range(r.randrange(1, most)):
            own = list(base)
            for _ in range(max(1, round(len(own) * r.uniform(0.002, 0.03)))):
                own[r.randrange(len(own))] = f"x{r.randrange(10**6)}"
            texts.append(" ".join(own))
    return texts


def stage_groups(rows):
    """Pairs of rows that brute force links, and the component of every row."""
    sets = [grams(t) for _, t in rows]
    home = {}
    for i, s in enumerate(sets):
        for x in s or [None]:
            home.setdefault(x, []).append(i)
    near = {(a, b) for at in home.values() for k, a in enumerate(at) for b in at[:k]
            if jaccard(sets[a], sets[b]) >= 0.8 - 1e-9}
    return near, components_of(len(rows), near)


def kept_by(rows):
    root = stage_groups(rows)[1]
    best = {}
    for k, (i, _) in enumerate(rows):
        best[root[k]] = min(best.get(root[k], (2, 0, 0)), (i is None, i or 0, k))
    return sorted((rows[k][0] for _, _, k in best.values()), key=repr)


def test_stage_keeps_one_of_each_group(spark):
    texts = edited_texts(3, 250) + edited_texts(4, 60, (5, 12))
    rows = [(i, t[:5000] if t else t) for i, t in awkward_texts()]
    rows += [(100 + i, t) for i, t in enumerate(texts)]
    docs = documents(spark, rows, extra=True)
    found = corpus_pipeline.simhash_stage(spark, docs, "")
    assert found.columns == docs.columns
    assert sorted((r.doc_id for r in found.collect()), key=repr) == kept_by(rows)


@pytest.mark.parametrize("rows", [1_000, 300_000, 10_000_000])
def test_cells_meet_near_pairs_at_any_table_size(rows):
    probing = near_sets.cell_parts(rows, 0.8)
    r, met, seen = random.Random(1), [], []
    for _ in range(3_000):
        total = r.choice([15, 25, 60, 120, 300])
        common = math.ceil(total * r.choice([0.8, 0.8, 0.85, 0.9, 0.95]) - 1e-9)
        own = np.random.default_rng(r.randrange(1 << 40)).integers(0, 1 << 64, total, np.uint64)
        a = np.r_[own[:common], own[common : common + (total - common) // 2]]
        b = np.r_[own[:common], own[common + (total - common) // 2 :]]
        prints = np.frombuffer(b"".join(simhash.majority(x, 512) for x in (a, b)), np.uint8)
        prints = prints.reshape(2, -1)
        meets = any(k[0] == k[1] for k, _ in simhash.probe_keys(prints, probing))
        words = prints.view(np.uint64)
        near = near_sets._near(words[:, :2], np.array([len(a), len(b)]), np.array([0]), 0.8)[0, 1]
        met.append(meets and near)
        seen.append(np.bitwise_count(prints[0] ^ prints[1]).sum() <= near_sets.RADIUS)
    assert np.mean(np.array(met) & np.array(seen)) >= 1 - 2 * near_sets.MISS


def test_bit_chance_covers_small_sets():
    def differs(common, x, y):
        total = 0
        for c in range(common + 1):
            a, b = (sum(comb(n, k) for k in range(n + 1) if 2 * (c + k) > common + n) / 2**n
                    for n in (x, y))
            total += comb(common, c) / 2**common * (a * (1 - b) + b * (1 - a))
        return total

    for total in range(near_sets.SHORT + 1, 130):
        own = total - math.ceil(0.8 * total - 1e-9)
        assert max(differs(total - own, x, own - x) for x in range(own + 1)) <= near_sets.bit_chance(0.8)


def test_similarity_decides_not_the_bits(spark):
    """Pairs at 0.80 link and pairs at 0.79 do not, whatever their fingerprints say."""
    rows, r = [], random.Random(8)
    for k in range(120):
        n = 360
        base = [f"w{r.randrange(10**7)}" for _ in range(n + 4)]
        cut = 40 if k % 2 else 42  # common shingles: 320 of 400, 318 of 402
        rows.append((2 * k, " ".join(base)))
        rows.append((2 * k + 1, " ".join(base[: n + 4 - cut] + [f"y{k}-{j}" for j in range(cut)])))
    found = {x.doc_id for x in corpus_pipeline.simhash_stage(spark, documents(spark, rows), "").collect()}
    assert found == {2 * k for k in range(120)} | {2 * k + 1 for k in range(0, 120, 2)}


@pytest.mark.parametrize("block, passes", [(20, 8), (64, 8), (20, 1)])
def test_crowded_cells_give_the_same_components(spark, monkeypatch, block, passes):
    """Half of all rows are near one text; texts are shuffled, hot ones dealt out."""
    monkeypatch.setattr(near_sets, "BLOCK_ROWS", block)
    monkeypatch.setattr(near_sets, "PASSES", passes)
    monkeypatch.setattr(near_sets, "HELD_BYTES", 5_000)
    monkeypatch.setattr(near_sets, "fits_broadcast", lambda *_: False)
    r = random.Random(5)
    base, texts = [f"w{i}" for i in range(200)], []
    for k in range(150):
        own = list(base)
        for _ in range(1 + k % 3 if k < 120 else 6):
            own[r.randrange(len(own))] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(own))
    texts += edited_texts(6, 60)
    r.shuffle(texts)
    rows = list(enumerate(texts))
    found = corpus_pipeline.simhash_stage(spark, documents(spark, rows), "")
    assert sorted((x.doc_id for x in found.collect()), key=repr) == kept_by(rows)


def test_held_sets_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(near_sets, "HELD_BYTES", 3_000)
    sets = near_sets.HashSets(5)
    pack = zstandard.ZstdCompressor(level=1).compress
    texts = [" ".join(f"w{i}x{k}" for i in range(20)).encode() for k in range(60)]
    for _ in range(3):
        for t in texts:
            assert sets.get(pack(t)).tolist() == sorted(set(simhash.shingle_hashes(t, 5).tolist()))
            assert sets.size <= 3_000 and sets.size == sum(len(k) + v.nbytes for k, v in sets.held.items())
    long = pack(" ".join(map(str, range(1_000))).encode())
    assert len(sets.get(long)) == 996 and list(sets.held) == [long]


def test_pigeonhole_parts_find_what_they_guarantee(spark):
    """The first step finds close texts by itself; all within the guaranteed bits are joined."""
    r, rows = random.Random(11), []
    for _ in range(12):
        base = [f"w{r.randrange(10**6)}" for _ in range(600)]
        rows += [[*base[:k], f"x{k}", *base[k + 1 :]] for k in range(50, 600, 100)]
    rows = [(i, " ".join(t)) for i, t in enumerate(rows)]
    table = spark.createDataFrame([(i, i, t) for i, t in rows], "row long, key long, text string")
    sets = near_sets.NearSets(table, 5, 0.8)
    nodes = sets.nodes.collect()
    place = {r.node: i for i, r in enumerate(nodes)}
    links = {(place[r.a], place[r.b]) for r in sets.pigeonholed().collect()}
    assert all(nodes[a].node > nodes[b].node for a, b in links)
    words = np.frombuffer(b"".join(r.fingerprint[:16] for r in nodes), np.uint64).reshape(-1, 2)
    apart = simhash._distance(words[:, None, :], words[None, :, :])
    close = np.argwhere(np.triu(apart <= near_sets.GUARANTEE, 1)).tolist()
    joined = components_of(len(nodes), links)
    assert len(close) > 20 and all(joined[a] == joined[b] for a, b in close)
    assert sets.verified(sets.pigeonholed(), nearest=True).count() > 20


def test_stage_joins_by_pigeonhole_parts(spark, monkeypatch):
    """Close copies are one label before any cell is looked at."""
    asked, stars = [], near_sets.NearSets.stars
    monkeypatch.setattr(near_sets.NearSets, "stars", lambda self, nodes, parts: (
        asked.append((self.count, nodes.count())), stars(self, nodes, parts))[1])
    base = [f"w{i}" for i in range(600)]
    texts = [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(0, 600, 20)]
    found = corpus_pipeline.simhash_stage(spark, documents(spark, list(enumerate(texts))), "")
    assert [r.doc_id for r in found.collect()] == [0]
    assert asked[0][0] == 30 and asked[0][1] < 15


def test_stage_leaves_no_copy_of_the_texts(spark):
    """The numbered rows are a checkpoint, which is cleaned, not a folder that stays."""
    folder = pathlib.Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    docs = documents(spark, list(enumerate(edited_texts(2, 3))))
    corpus_pipeline.simhash_stage(spark, docs, "").count()
    assert not list(folder.glob("placed-*"))


def unlinked_group(r, n, words=200):
    """Texts near one that is not there: by their bits all are near each other, by their sets few link."""
    base = [f"v{r.randrange(10**6)}" for _ in range(words)]
    texts = []
    for _ in range(n):
        own = list(base)
        for at in r.sample(range(words), r.randrange(3, 7)):
            own[at] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(own))
    return texts


def all_groups(texts):
    """The same as ``stage_groups`` where most texts have shingles in common."""
    sets = [grams(t) for t in texts]
    near = {(a, b) for a in range(len(sets)) for b in range(a) if jaccard(sets[a], sets[b]) >= 0.8 - 1e-9}
    return near, components_of(len(sets), near)


def test_last_pass_writes_no_pairs(spark, monkeypatch):
    """A group that does not link gives rows and links in proportion to its nodes, none is missed."""
    texts = unlinked_group(random.Random(21), 250)
    rows = list(enumerate(texts))
    near, joined = all_groups(texts)
    table = spark.createDataFrame([(i, i, t) for i, t in rows], "row long, key long, text string")
    sets = near_sets.NearSets(table, 5, 0.8)
    parts = len(sets.probing.parts)
    made, cut = [], near_sets.cut_lineage
    monkeypatch.setattr(near_sets, "cut_lineage", lambda df: (
        made.append((df.columns, (kept := cut(df)).count())), kept)[1])
    place = {r.node: r.row for r in sets.nodes.collect()}
    links = [(place[r.a], place[r.b]) for r in sets.across(
        sets.nodes.withColumn("label", near_sets.F.col("node")), parts).collect()]
    assert components_of(len(rows), set(links)) == joined
    assert {(max(x), min(x)) for x in links} <= near
    assert max(n for _, n in made) <= (parts + 1) * len(rows) < 250 * 249 // 2


@pytest.mark.parametrize("held", [2_000, 8 << 20])
def test_runs_of_all_parts_find_each_near_pair_once(monkeypatch, held):
    monkeypatch.setattr(near_sets, "HELD_BYTES", held)
    texts = unlinked_group(random.Random(4), 120) + edited_texts(9, 20)
    hashes = [np.unique(simhash.shingle_hashes(t.encode(), 5)) for t in texts]
    prints = np.frombuffer(b"".join(simhash.majority(x, 512) for x in hashes), np.uint8)
    prints = prints.reshape(len(texts), -1)
    words, size, label = prints.view(np.uint64), np.array([len(x) for x in hashes]), np.arange(len(texts))
    probing, seen, links = near_sets.cell_parts(1_000, 0.8), [], []
    for k in range(len(probing.parts)):
        own = simhash.Probing(probing.parts[k : k + 1], (0,))
        (keys, _), = simhash.probe_keys(prints, own)
        for key in np.unique(keys):
            at = np.flatnonzero(keys == key)
            a, b = near_sets.pair_run(words[at], size[at], label[at], 0.8, k, probing)
            seen += [tuple(sorted(x)) for x in zip(at[a].tolist(), at[b].tolist())]
            links += [(int(at[i]), int(at[j])) for i, j in near_sets.joined_run(
                lambda i: hashes[at[i]], size[at], label[at], a, b, 0.8)]  # noqa: B023
    assert len(seen) == len(set(seen)) > 3_000
    _, joined = all_groups(texts)
    assert components_of(len(texts), set(links)) == joined and len(links) < len(seen) / 3


def test_finished_passes_leave_no_shuffles_on_disk(spark):
    """Shuffles of earlier passes go while the stage runs, not when the driver happens to collect garbage."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    places = [pathlib.Path(d.getPath()) for d in disk.localDirs()]

    def shuffles():
        return {f.name.split("_")[1] for d in places for f in d.rglob("shuffle_*")}

    before = shuffles()
    rows = list(enumerate(edited_texts(11, 60)))
    docs = documents(spark, rows)
    keyed = docs.selectExpr("doc_id AS row", "doc_id AS key", "text")
    assert near_sets.near_components(keyed, 5, 0.8).count() == len(rows)
    assert len(shuffles() - before) < 12
