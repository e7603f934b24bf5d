"""FM-index searches and spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest
from helpers import awkward_texts, documents, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from tablewright.llm import spelling
from tablewright.llm.fm_index import WordIndex, one_error


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_words(rows, chars=5, count=3):
    total = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= chars and n >= count}


def plain_variants(words):
    form, near = {}, {}
    by_size = {}
    for w in words:
        by_size.setdefault(len(w), []).append(w)
    for w in words:
        near[w] = [v for k in (-1, 0, 1) for v in by_size.get(len(w) + k, ())
                   if v != w and is_near(w, v)]
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n, len(near[w]), form[w], words.get(form[w]), root))
    return sorted(out)


WORD = st.text("abcd", min_size=1, max_size=9)


@settings(max_examples=200, deadline=None)
@given(st.sets(WORD, min_size=1, max_size=40), st.sets(st.text("abcdz", min_size=1, max_size=9)))
def test_searches_find_every_pair_once(words, queries):
    words, queries = sorted(words), sorted(queries)
    index = WordIndex(words)
    found = [p for right in (True, False)
             for p in zip(*map(list, one_error(index, queries, right)))]
    assert sorted(found) == [(i, j) for i, q in enumerate(queries)
                             for j, w in enumerate(words) if q != w and is_near(q, w)]


def variants_of(seed, n):
    r = random.Random(seed)
    stems = ["".join(r.choice("aeiourstln") for _ in range(r.randrange(4, 9))) for _ in range(40)]
    out = []
    for _ in range(n):
        w = r.choice(stems[: r.randrange(1, 41)])
        if r.random() < 0.3:
            i = r.randrange(len(w))
            w = w[:i] + r.choice(["", "x", "é", w[i] * 2]) + w[i + 1 :]
        out.append(w.upper() if r.random() < 0.1 else w)
    return " ".join(out)


ROWS = awkward_texts() + [(100 + i, variants_of(i, 300)) for i in range(30)] + [
    (None, variants_of(99, 50)), (7, "Ünïcode ünïcode ÜNÏCODE ünïcodé × ÷÷÷÷÷÷ ÷÷÷÷÷÷ ÷÷÷÷÷÷"),
    (200, "xx" * 700 + " " + "xx" * 700 + "y " + "xx" * 700), (201, "xx" * 700 + " " + "xx" * 700 + "y"),
    (202, ("xx" * 700 + "y ") * 5), (203, prose(5, 3000).replace("hill", "hills")),
]


@pytest.mark.parametrize("block", [(spelling.BLOCK_SYMBOLS, spelling.BLOCK_QUERIES), (300, 7)])
def test_variants_equal_brute_force(spark, block):
    words = plain_words(ROWS)
    assert len(words) > 300 and any(len(w) > 1000 for w in words)
    found = spelling.spelling_variants(
        documents(spark, ROWS, extra=True), block_symbols=block[0], block_queries=block[1])
    assert sorted(map(tuple, found.collect())) == [
        (w, n, k, f, fn, r) for w, n, k, f, fn, r in plain_variants(words)]


def test_pairs_once_in_both_orders(spark):
    words = plain_words(ROWS, chars=1, count=1)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    for block in ((1 << 18, 1 << 16), (200, 5)):
        found = sorted(map(tuple, spelling.near_pairs(df, *block).collect()))
        assert found == sorted((a, b) for a in words for b in words if a != b and is_near(a, b))


def test_long_texts_are_read_in_windows():
    text = prose(3, 2000).lower() + " " + "q" * 500 + " end"
    for window in (1, 7, 100):
        assert spelling.runs_of(text, window) == Counter(re.findall("[a-zÀ-ÿ]+", text))


def test_no_words(spark):
    assert spelling.spelling_variants(documents(spark, [])).count() == 0
    assert spelling.spelling_variants(documents(spark, [(1, None), (2, "12 a b")])).count() == 0
