"""Duplicate operators against brute force, on awkward and on random input."""

import hashlib
import math
import random
import re
import time

import numpy as np
import pytest
import xxhash
from helpers import awkward_texts, components_of, documents, prose, raw

from tablewright.llm import components, embedding_links, repeats, simhash
from tablewright.llm.common import free_disk


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", raw(text).lower())
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_texts():
    r = random.Random(4)
    rows = [(i, t[:5000] if t else t) for i, t in awkward_texts()]
    for k in range(6):
        words = prose(50 + k, 150).split()
        for i in range(12):
            own = list(words)
            for _ in range(i // 4):
                own[r.randrange(len(own))] = "changed"
            rows.append((1000 + 100 * k + i, " ".join(own).upper() if i == 3 else " ".join(own)))
    return rows


@pytest.mark.parametrize("block", [simhash.BLOCK_ROWS, 6])
def test_simhash_components(spark, monkeypatch, block):
    """With blocks of six rows the values that near copies share are cut into pairs of blocks."""
    monkeypatch.setattr(simhash, "BLOCK_ROWS", block)
    rows = near_texts()
    prints = [plain_fingerprint(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a)
             if (prints[a] ^ prints[b]).bit_count() <= 2]
    root = components_of(len(rows), links)
    low = {}
    for (i, _), r in zip(rows, root):
        low[r] = min([x for x in (low.get(r), i) if x is not None], default=None)
    want = sorted(((i, f"{p:016x}", low[r]) for (i, _), p, r in zip(rows, prints, root)), key=repr)
    found = simhash.near_components(documents(spark, rows, extra=True)).collect()
    assert sorted(((r.doc_id, r.fingerprint.hex(), r.component_id) for r in found), key=repr) == want
    assert simhash.near_components(documents(spark, [])).count() == 0


def test_wide_fingerprints_tell_similar_from_other():
    words = prose(9, 400).split()
    close, far = list(words), prose(10, 400).split()
    close[200] = "changed"
    a, b, c = (np.frombuffer(simhash.fingerprint(" ".join(w).encode(), 5, 512), np.uint8)
               for w in (words, close, far))
    assert np.bitwise_count(a ^ b).sum() < 60 < 180 < np.bitwise_count(a ^ c).sum()


@pytest.mark.parametrize("radius, run", [(1, 8), (2, 8), (2, 10_000), (3, 8), (3, 10_000)])
def test_every_allocation_finds_all_links(monkeypatch, radius, run):
    monkeypatch.setattr(simhash, "LONG_RUN", run)
    rng = np.random.default_rng(radius)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = set(seeds.tolist())
    for _ in range(400):
        v = int(rng.choice(list(values)[:80]))
        for b in rng.choice(16, rng.integers(0, 4), replace=False):
            v ^= 1 << int(b)
        values.add(v)
    values = np.array(sorted(values), dtype=np.uint64)
    packed = values.byteswap().view(np.uint8).reshape(-1, 8)
    probing = simhash.choose_probing(simhash._bits(packed).astype(float), len(values), radius)
    assert sum(t + 1 for t in probing.radii) == radius + 1
    key, own, node = [], [], []
    for k, mark in simhash.probe_keys(packed, probing):
        key.append(k)
        own.append(np.full(len(k), mark))
        node.append(np.arange(len(values)))
    key, own, node = map(np.concatenate, (key, own, node))
    words = values[node][:, None]
    got = node[simhash.find_links(key.astype(np.int64), own, words, radius)]
    links = [(a, b) for a in range(len(values)) for b in range(a)
             if int(values[a] ^ values[b]).bit_count() <= radius]
    assert components_of(len(values), got.tolist()) == components_of(len(values), links)


def test_unequal_thresholds_where_a_part_is_dull():
    rng = np.random.default_rng(1)
    sample = rng.integers(0, 2, (500, 64)).astype(float)
    sample[:, :22] = sample[:, :1]  # one group of bits says nothing but one bit
    probing = simhash.choose_probing(sample, 10_000_000, 2)
    dull = [i for i, p in enumerate(probing.parts) if len(set(p) & set(range(22))) > 10]
    assert all(probing.radii[i] == -1 for i in dull) and len(set(probing.radii)) > 1


def test_allocation_is_the_cheapest():
    rng = np.random.default_rng(2)
    for _ in range(50):
        costs = [[0.0, *rng.random(3)] for _ in range(3)]
        want = min(costs[0][a] + costs[1][b] + costs[2][c] for a in range(4) for b in range(4)
                   for c in range(4) if a + b + c == 3)
        assert math.isclose(simhash.allocate(costs, 3)[0], want)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)]
    edges += [(200, 200), (201, 202), (202, 201), (None, 5), (300, 301), (301, 60)]
    found = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    whole = [(a, b) for a, b in edges if a is not None]
    root = components_of(400, whole)
    assert {(r.node, r.root) for r in found} == {
        (n, root[n]) for e in whole for n in e}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_links(rows):
    unit = []
    for _, v, label in rows:
        ok = label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v, np.float32).astype(float) / np.linalg.norm(
            np.array(v, np.float32).astype(float)) if ok else None)
    return [(a, b) for a in range(len(rows)) for b in range(a)
            if unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2]
            and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98]


@pytest.mark.parametrize("block", [embedding_links.BLOCK_ROWS, 40])
def test_vectors_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_links, "BLOCK_ROWS", block)
    rng = np.random.default_rng(5)
    rows = []
    for c in range(12):
        centre = rng.standard_normal(32)
        for _ in range(25):
            v = centre + rng.standard_normal(32) * rng.choice([0.02, 0.13, 0.16, 0.4])
            rows.append((len(rows), [float(np.float32(x)) for x in v], c % 3))
    rows += [(900 + i, rows[i][1], rows[i][2]) for i in (0, 0, 0, 30)]
    rows += [(950, [2 * x for x in rows[0][1]], 0), (951, None, 1), (952, [0.0] * 32, 1),
             (953, [float("nan")] + [1.0] * 31, 1), (954, [None] + [1.0] * 31, 1),
             (955, rows[0][1], None), (956, [], 1), (957, [1.0, 2.0], 0), (958, [2.0, 4.0], 0),
             (None, rows[0][1], 0), (None, None, 0), (959, [1e30] * 32, 2), (960, [1e-30] * 32, 2),
             (961, [-0.0, 1.0], 1), (962, [0.0, 1.0], 1), (7, rows[7][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    links = plain_links(rows)
    root = components_of(len(rows), links)
    low = {}
    for (i, _, _), r in zip(rows, root):
        low[r] = min([x for x in (low.get(r), i) if x is not None], default=None)
    degree = [0] * len(rows)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    want = [(i, n, low[r], i is not None and i == low[r])
            for (i, _, _), n, r in zip(rows, degree, root)]
    found = embedding_links.near_vectors(df).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<double>, label int")
    assert embedding_links.near_vectors(df).count() == 0


def plain_removal(rows, least):
    """Covered bytes of each row, by comparing every string with those of smaller ids."""
    later = float("inf")
    first = {}
    for i, t in rows:
        for p in range(len(t) - least + 1):
            s = t[p : p + least]
            first[s] = min(first.get(s, later), later if i is None else i)
    out = []
    for i, t in rows:
        own = later if i is None else i
        cover = bytearray(len(t))
        for p in range(len(t) - least + 1):
            if first[t[p : p + least]] < own:
                cover[p : p + least] = b"\1" * least
        kept = bytes(c for c, m in zip(t, cover) if not m)
        spans = sum(1 for k in range(len(cover)) if cover[k] and (not k or not cover[k - 1]))
        out.append((i, len(t), sum(cover), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def random_texts(seed):
    """Texts over few letters that share, nest, overlap and repeat passages."""
    r = random.Random(seed)
    pool = ["".join(r.choice("ab\0é") for _ in range(r.randrange(20, 120))) for _ in range(8)]
    rows = []
    for i in range(60):
        parts = [r.choice(pool)[r.randrange(10) :] if r.random() < 0.7 else
                 "".join(r.choice("abc") for _ in range(r.randrange(30)))
                 for _ in range(r.randrange(0, 6))]
        rows.append((r.choice([i, i, i, 1, None]), "".join(parts)))
    return rows


@pytest.mark.parametrize("seed, least, bucket", [
    (1, 50, None), (2, 20, None), (3, 17, 500), (4, 50, 2_000), (5, 33, None)])
def test_removal_of_random_texts(spark, monkeypatch, seed, least, bucket):
    if bucket:  # small shares, small arrays, and texts hashed in parts
        monkeypatch.setattr(repeats, "BUCKET_BYTES", bucket)
        monkeypatch.setattr(repeats, "ARRAY_BYTES", bucket)
        monkeypatch.setattr(repeats, "HASHED_BYTES", 70)
    rows = random_texts(seed)
    want = plain_removal([(i, raw(t)) for i, t in rows], least)
    found = repeats.remove_repeats(documents(spark, rows).repartition(5), least).collect()
    assert sorted(map(tuple, found), key=repr) == sorted((w[:5] for w in want), key=repr)


def test_removal_of_awkward_texts(spark):
    rows = [(i, t[:4000] if t else t) for i, t in awkward_texts()]
    want = plain_removal([(i, raw(t)) for i, t in rows], 50)
    docs = documents(spark, rows, extra=True)
    found = repeats.remove_repeats(docs).collect()
    assert sorted(map(tuple, found), key=repr) == sorted((w[:5] for w in want), key=repr)
    cut = repeats.without_repeats(docs)
    assert cut.columns == docs.columns
    texts = sorted(((r.doc_id, r.text or "") for r in cut.collect()), key=repr)
    assert texts == sorted(((w[0], w[5].decode("utf-8", "ignore")) for w in want), key=repr)
    assert repeats.remove_repeats(documents(spark, [])).count() == 0


def test_memory_of_a_long_text_and_of_one_anchor(monkeypatch):
    """A text of 32 MB is hashed in parts; the runs of one anchor go into arrays of bounded size."""
    import tracemalloc

    text = np.random.default_rng(1).integers(97, 123, 32 << 20, dtype=np.uint8).tobytes()
    tracemalloc.start()
    own, first, last, *_ = repeats._all_runs([b"short", text], 50)
    assert set(own.tolist()) == {1} and (last - first + 1).sum() == len(text) - 49
    assert (first[1:] == last[:-1] + 1).all()
    del own, first, last
    assert tracemalloc.get_traced_memory()[1] < 420 << 20  # 4 M runs of 32 bytes, twice, and a part
    tracemalloc.stop()

    r = random.Random(3)
    side = lambda: bytes(r.choice(b"abcd") for _ in range(34))
    strings = [side() + b"the same anchor!" + side() for _ in range(4_000)]
    strings += [side() + s[34:] for s in strings[:300]]
    monkeypatch.setattr(repeats, "ARRAY_BYTES", 60_000)
    n = len(strings)
    block = repeats._pack(
        np.arange(2 * n, dtype=np.uint64).reshape(-1, 2), np.arange(n),
        repeats._planes(np.arange(n, dtype=np.uint64)), repeats._planes(np.zeros(n, np.uint64)),
        repeats._steps(np.zeros(n, np.uint64)), np.full(n, 84, np.uint16), b"".join(strings))
    tracemalloc.start()
    keys, text, start, length = repeats.repeated_spans([block], 50)
    assert tracemalloc.get_traced_memory()[1] < 24 << 20  # 0.36 MB of runs, which took 29 MB at once
    tracemalloc.stop()
    assert {t for t, s, m in zip(text.tolist(), start.tolist(), length.tolist())
            if s <= 34 and s + m == 84} >= set(range(4_000, 4_300))


def test_ids_must_be_ordered_numbers(spark):
    with pytest.raises(ValueError):
        repeats.remove_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def plain_repeats(strings, least):
    """Maximal repeats by definition: all substrings, extended while every occurrence agrees."""
    places = {}
    for s, t in enumerate(strings):
        for a in range(len(t)):
            for b in range(a + least, len(t) + 1):
                places.setdefault(t[a:b], []).append((s, a))
    found = set()
    for sub, at in places.items():
        if len(at) < 2:
            continue
        left = {strings[s][a - 1] if a else None for s, a in at}
        ends = [(s, a + len(sub)) for s, a in at]
        right = {strings[s][e] if e < len(strings[s]) else (s, "end") for s, e in ends}
        if (len(left) > 1 or None in left) and len(right) > 1:
            found.add((len(sub), tuple(sorted(at))))
    return found


def test_prefix_tree_gives_all_maximal_repeats():
    r = random.Random(6)
    for _ in range(40):
        strings = list({bytes(r.choice(b"ab") for _ in range(r.randrange(6, 30)))
                        for _ in range(6)})
        got = {(n, tuple(sorted(zip(s.tolist(), o.tolist()))))
               for n, s, o in repeats.maximal_repeats(strings, 5)}
        assert got == plain_repeats(strings, 5)


def test_anchors_depend_on_the_window_alone():
    text = prose(20, 200).encode()
    other = b"prefix of another length " + text[300:900] + b" and an end"
    windows = []
    for t in (text, other):
        number, first, last, anchor, _, _ = repeats.anchored_runs([b"", t], 50)
        assert set(number.tolist()) == {1}
        windows.append({t[p : p + 50]: h for a, b, h in zip(
            first.tolist(), last.tolist(), anchor.tolist()) for p in range(a, b + 1)})
        assert sum(last - first + 1) == len(t) - 49
    shared = set(windows[0]) & set(windows[1])
    assert len(shared) >= 551
    assert all(windows[0][w] == windows[1][w] for w in shared)


def test_planes_round_trip():
    r = np.random.default_rng(3)
    for n in (0, 1, 1000):
        values = np.sort(r.integers(0, 1 << 62, n, dtype=np.uint64))
        assert (repeats._from_planes(repeats._planes(values)) == values).all()
        assert (repeats._from_steps(repeats._steps(values)) == values).all()


def test_runs_leave_no_shuffles_behind(spark, monkeypatch):
    """What was shuffled to find the runs is gone before the texts are shuffled again."""
    monkeypatch.setattr(repeats, "FREED_BYTES", 0)
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    r = random.Random(4)
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(200)) for _ in range(200)]
    docs = documents(spark, [(i, t + texts[i // 2]) for i, t in enumerate(texts)]).cache()
    docs.count()
    free_disk(spark)
    time.sleep(2)
    before = disk.getAllFiles().size()
    kept = repeats._found(docs, 50, "doc_id", "text")
    for _ in range(20):
        time.sleep(0.5)
        if disk.getAllFiles().size() <= before:
            break
    assert kept and disk.getAllFiles().size() <= before


def test_hashing_slices_change_no_runs(monkeypatch):
    """Arrays of a slice stay small; the slice's size does not show in the runs."""
    assert repeats.HASHED_BYTES <= 1 << 17
    r = random.Random(6)
    texts = [bytes(r.choices(b"abcdefgh ", k=r.randrange(60, 900))) for _ in range(300)]
    found = []
    for size in (1 << 19, repeats.HASHED_BYTES, 1 << 12):
        monkeypatch.setattr(repeats, "HASHED_BYTES", size)
        found.append(sorted(zip(*(x.tolist() for x in repeats._all_runs(texts, 50)))))
    assert found[0] == found[1] == found[2]
