"""Alignment of two tokenizers against a plain walk over the libraries' own tokens."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from helpers import awkward_texts, documents, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tablewright.llm import alignment
from tablewright.llm.tokens import byte_alphabet

A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")

TEXTS = awkward_texts() + [
    (50, "▁literal mark"), (51, "ﬁgure Ⅳ and ½"), (52, "  two blanks  and\ttab\n\n\nlines  "),
    (53, " "), (54, "=" * 500 + "-" * 333), (55, "中文没有空格" * 60), (56, "\u0000\u0001 a"),
    (57, "<s> </s> <unk> <0x41>"), (58, "naïve café " * 300), (59, "don't we'll I'm"),
    (60, "한국어 띄어쓰기 日本語テキスト"), (61, "word " * 2000 + "ᰀ odd script"),
    (62, "x" * 20_000), (63, "\n" * 5_000), (64, "🤖👍🏽" * 50 + " end"),
]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain(text, a, b):
    """Groups as (list of A ids, list of B ids), walking both sides byte by byte."""
    if not text:
        return []
    alphabet = byte_alphabet()
    encoding = a.encode(" " + text, add_special_tokens=False)
    left = [(i, bytes(alphabet[c] for c in t)) for i, t in zip(encoding.ids, encoding.tokens)]
    right = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        right.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    raw = (" " + text).encode()
    if b"".join(x for _, x in left) != raw or b"".join(x for _, x in right) != raw:
        return []
    groups, i, j = [], 0, 0
    while i < len(left):
        ga, gb = [left[i][0]], [right[j][0]]
        na, nb = len(left[i][1]), len(right[j][1])
        i, j = i + 1, j + 1
        while na != nb:
            if na < nb:
                ga.append(left[i][0])
                na += len(left[i][1])
                i += 1
            else:
                gb.append(right[j][0])
                nb += len(right[j][1])
                j += 1
        groups.append((ga, gb))
    return groups


def report(rows, libraries):
    found, documents_of = [], Counter()
    for i, text in rows:
        groups = plain(text, *libraries)
        links = Counter()
        for ga, gb in groups:
            ca, cb = Counter(ga), Counter(gb)
            for x in ca:
                for y in cb:
                    links[x, y] += ca[x] * cb[y]
        documents_of.update(links.keys())
        found.append((i, groups, links))
    top = defaultdict(int)
    for (x, _), n in documents_of.items():
        top[x] = max(top[x], n)
    out = []
    for i, groups, links in found:
        shown = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        out.append((
            i, sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups),
            sum(links.values()), sum(n for p, n in links.items() if documents_of[p] == top[p[0]]),
            sum(n * documents_of[p] for p, n in links.items()),
            hashlib.sha256(shown.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


@pytest.mark.parametrize("segment", [alignment.SEGMENT, 40])
def test_report_equals_plain_walk(spark, libraries, segment):
    found = alignment.link_report(documents(spark, TEXTS, extra=True), A, B, segment=segment)
    assert sorted(map(tuple, found.collect()), key=repr) == report(TEXTS, libraries)


def test_report_of_given_documents_and_shuffled_join(spark, data, libraries, monkeypatch):
    import tablewright.operators.lookup as lookup

    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    monkeypatch.setattr(lookup, "fits_broadcast", lambda *_: False)
    found = alignment.link_report(docs, A, B)
    assert sorted(map(tuple, found.collect()), key=repr) == report(rows, libraries)


def test_aligned_lists(spark, libraries):
    df = documents(spark, TEXTS, extra=True)
    found = alignment.align(df, A, B, prefix="x_")
    assert found.columns == [c for c in df.columns if c != "text"] + [
        "x_a_ids", "x_b_ids", "x_a_stops", "x_b_stops"]
    got = []
    for r in found.collect():
        a, b = [0, *r.x_a_stops], [0, *r.x_b_stops]
        got.append((r.doc_id, [(r.x_a_ids[a[i]:a[i + 1]], r.x_b_ids[b[i]:b[i + 1]])
                               for i in range(len(a) - 1)]))
    assert sorted(got, key=repr) == sorted(
        [(i, plain(t, *libraries)) for i, t in TEXTS], key=repr)
    assert alignment.align(df.limit(0), A, B).count() == 0
    assert alignment.link_report(df.limit(0), A, B).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 5), min_size=1, max_size=40),
                          st.integers(1, 7)), min_size=1, max_size=6))
def test_cuts_are_all_shared_ends(texts):
    """Random token lengths: the division finds exactly the common ends of both sides."""
    len_a, len_b, low, high = [], [], [], []
    for lengths, step in texts:
        low.append(len(len_a))
        len_a += lengths
        high.append(len(len_a))
        rest = sum(lengths)
        while rest:
            len_b.append(min(step, rest))
            rest -= len_b[-1]
    end_a, end_b = np.cumsum(len_a), np.cumsum(len_b)
    cut = alignment.shared_cuts(end_a, end_b, np.array(low), np.array(high))
    assert cut.tolist() == np.isin(end_a, end_b).tolist()


def test_a_long_text_without_common_ends_is_one_group():
    n = 200_000
    end_a, end_b = np.cumsum(np.r_[3, np.full(n, 2)]), np.cumsum(np.r_[np.full(n, 2), 3])
    cut = alignment.shared_cuts(end_a, end_b, np.array([0]), np.array([n + 1]))
    assert cut.sum() == 1 and cut[-1]
