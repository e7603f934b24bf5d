"""Quality rules against SQL and plain loops, the classifier against held-out labels."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from helpers import awkward_texts, documents, prose, raw
from pyspark.sql import functions as F

from tablewright.llm import quality_classifier, quality_rules

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def base(text):
    data = raw(text)
    words = WORD.findall(data)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit |= set(range(i, i + 8))
    lines = [x for x in data.split(b"\n") if WORD.search(x)]
    chars = sum(len(w.decode()) for w in words)
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return (len(words), chars, sum(map(data.decode().count, "#*$%&|<>")),
            len(lines) - len(set(lines)), len(hit), failed)


def plain_ratio(rows, trusted, buckets, smoothing):
    def buckets_of(text):
        words = WORD.findall(raw(text))
        data = b" " + b" ".join(words) + b" "
        return [(int.from_bytes(data[i : i + 4], "big") * quality_rules.MULTIPLIER % (1 << 32))
                * buckets >> 32 for i in range(len(data) - 3)]

    raw_counts, target = [0] * buckets, [0] * buckets
    for i, t in rows:
        for b in buckets_of(t):
            raw_counts[b] += 1
            target[b] += i in trusted
    if not sum(target):
        return [0.0] * len(rows)
    share = sum(target) / sum(raw_counts)
    ratio = [math.log((a + smoothing) / (b * share + smoothing))
             for a, b in zip(target, raw_counts)]
    return [sum(ratio[b] for b in own) / len(own) if (own := buckets_of(t)) else 0.0
            for _, t in rows]


@pytest.mark.parametrize("trusted", [[5, 14], []])
def test_rules_equal_plain_loops(spark, trusted):
    rows = [(i, t[:9000] if t else t) for i, t in awkward_texts()] + [
        (30, "word " * 40), (31, "### && $$ a b c d e f g h"), (32, prose(4, 25))]
    ids = spark.createDataFrame([(i,) for i in trusted], "doc_id long")
    found = quality_rules.judge(
        documents(spark, rows), ids, ["doc_id"], buckets=512, threshold=-0.05)
    ratios = plain_ratio(rows, set(trusted), 512, quality_rules.SMOOTHING)
    want = []
    for (i, t), own in zip(rows, ratios):
        b = base(t)
        want.append((i, *b, not b[5] and own >= -0.05, own))
    got = sorted(((*r[:7], r.kept, r.log_ratio) for r in found.collect()), key=repr)
    for one, other in zip(got, sorted(want, key=repr), strict=True):
        assert one[:-1] == other[:-1] and abs(one[-1] - other[-1]) < 1e-6


def test_rules_refuse_clashing_names_and_take_a_prefix(spark):
    ids = spark.createDataFrame([], "doc_id long")
    docs = documents(spark, extra=True)
    with pytest.raises(ValueError):
        quality_rules.judge(docs, ids, docs.columns)
    found = quality_rules.judge(docs, ids, docs.columns, prefix="_q_")
    assert found.columns[: len(docs.columns)] == docs.columns
    assert found.count() == docs.count()
    assert quality_rules.judge(documents(spark, []), ids, ["doc_id"]).count() == 0


def test_repeated_words_of_random_texts():
    r = random.Random(1)
    texts = [[r.choice([b"a", b"b", b"c"]) for _ in range(r.randrange(40))] for _ in range(200)]
    want = [base((b" ".join(t)).decode())[4] for t in texts]
    assert quality_rules.repeated_words(texts).tolist() == want


def auc(label, score):
    rank = np.argsort(np.argsort(score)) + 1
    ones = label == 1
    n1, n0 = ones.sum(), (~ones).sum()
    return (rank[ones].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


def test_classifier_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select(
        F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    found = quality_classifier.classify(docs, labels)
    assert found.count() == docs.count()
    rows = found.join(labels, F.col("doc_id") == F.col("id")).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    label, score = (np.array([getattr(r, c) for r in held]) for c in ("label", "score"))
    assert auc(label, score) > 0.97
    assert (label == [r.predicted for r in held]).mean() > 0.95


def test_held_out_labels_do_not_matter(spark):
    docs = documents(spark, [(i, prose(i, 40) if i % 2 else "## " * 30) for i in range(40)])
    rows = [(i, i % 2) for i in range(40)]
    turned = [(i, y if zlib.crc32(str(i).encode()) % 3 != 1 else 1 - y) for i, y in rows]
    one, other = (
        quality_classifier.classify(docs, spark.createDataFrame(x, "id long, label int"))
        .orderBy("doc_id").collect() for x in (rows, turned))
    assert one == other


def test_classifier_edge_cases(spark):
    none = spark.createDataFrame([], "id long, label int")
    docs = documents(spark, extra=True)
    rows = quality_classifier.classify(docs, none).collect()
    assert len(rows) == docs.count()
    assert all(r.score == 0.5 for r in rows)
    labels = spark.createDataFrame([(5, 1), (12, 0), (None, 1), (7, 3)], "id long, label int")
    for how in (quality_classifier.BROADCAST_LABELS, -1):
        saved, quality_classifier.BROADCAST_LABELS = quality_classifier.BROADCAST_LABELS, how
        try:
            scored = quality_classifier.classify(docs, labels).collect()
        finally:
            quality_classifier.BROADCAST_LABELS = saved
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored)
    assert quality_classifier.classify(documents(spark, []), labels).count() == 0


def test_score_is_the_density_difference():
    rng = np.random.default_rng(0)
    cov = [np.diag([1.0, 2.0]), np.array([[1.0, 0.3], [0.3, 0.5]])]
    means = (np.zeros(2), np.ones(2))
    factors = [np.linalg.cholesky(c) for c in cov]
    offset = np.log(np.diag(factors[0])).sum() - np.log(np.diag(factors[1])).sum()
    model = quality_classifier.Model(
        np.zeros(2), np.ones(2), means, tuple(np.linalg.inv(f) for f in factors), offset)
    x = rng.standard_normal((50, 2))

    def density(z, m, c):
        d = z - m
        return -0.5 * (d @ np.linalg.inv(c) * d).sum(1) - 0.5 * np.log(np.linalg.det(c))

    want = density(x, means[1], cov[1]) - density(x, means[0], cov[0])
    got = np.log(model.score(x) / (1 - model.score(x))) / quality_classifier.TEMPER
    assert np.allclose(got, want)


@pytest.mark.parametrize("piece", [1, 5, 64, 1_000])
def test_ngrams_of_a_long_text_in_pieces(monkeypatch, piece):
    monkeypatch.setattr(quality_rules, "PIECE_BYTES", piece)
    for text in (b"", b"a", b"abc", b"a longer text of some words", prose(4, 700).encode()):
        whole, counts = quality_rules.grams([text.split()], 65_536)
        parts = list(quality_rules.gram_pieces([text.split()], 65_536))
        assert np.concatenate([f for f, _ in parts]).tolist() == whole.tolist()
        assert sum(int(n.sum()) for _, n in parts) == counts[0]
        assert all(len(f) <= max(piece, len(text) + 2) for f, _ in parts)
    both = [t.encode().split() for t in (prose(1, 50), prose(2, 60))]
    assert len(list(quality_rules.gram_pieces(both, 64))) == 1


def test_classifier_equals_a_plain_one(spark, data):
    """Statistics, clipping, moments, shrinkage and densities over all rows held in one matrix."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    known = [(r.doc_id, r.quality) for r in labels.collect()
             if r.doc_id in text and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    x = np.array([quality_classifier.statistics(raw(text[i])) for i, _ in known])
    y = np.array([q for _, q in known])
    centre, scale = x.mean(axis=0), np.sqrt(np.maximum(x.var(axis=0), 1e-6))
    standard = lambda v: np.clip((v - centre) / scale, -6, 6)
    z = standard(x)
    pooled = np.cov(z.T, bias=True)
    classes = []
    for c in (0, 1):
        cov = 0.7 * np.cov(z[y == c].T, bias=True) + 0.3 * pooled
        cov = 0.95 * cov + 0.05 * np.trace(cov) / len(cov) * np.eye(len(cov))
        classes.append((z[y == c].mean(axis=0), np.linalg.inv(cov), np.linalg.slogdet(cov)[1]))
    prior = math.log((sum(y == 1) + 1) / (sum(y == 0) + 1))
    want = {}
    for i, t in text.items():
        v = standard(np.array(quality_classifier.statistics(raw(t))))
        far = [0.5 * ((v - m) @ inverse @ (v - m)) + 0.5 * log for m, inverse, log in classes]
        want[i] = 1 / (1 + math.exp(-max(-500, min(500, 0.2 * (far[0] - far[1] + prior)))))
    scored = quality_classifier.classify(
        docs, labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("label")))
    for r in scored.collect():
        assert math.isclose(r.score, want[r.doc_id], abs_tol=1e-6)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
