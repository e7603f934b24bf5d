"""Token operators against the libraries, packing against its laws and small optima."""

import base64
import hashlib
import itertools
import random
import zlib
from struct import pack as to_bytes

import public_tokenizers
import pytest
import tiktoken
from helpers import awkward_texts, documents, prose, raw
from tokenizers import Tokenizer

from tablewright.llm import byte_bpe, packing, token_counts, tokens

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_fast_engine_gives_the_library_ids(library):
    encoder = tokens.Encoder(JSON)
    assert encoder.fast is not None
    for _, text in awkward_texts():
        assert encoder.ids(text or "").tolist() == ids_of(library, text)
    odd = "՘֋ unsettled <|endoftext|>ẞ"
    assert encoder.ids(odd).tolist() == ids_of(library, odd)


def test_counts_every_row(spark, library):
    found = token_counts.token_counts(documents(spark, extra=True), JSON, chunk=500, overlap=16)
    got = sorted(map(tuple, found.collect()), key=repr)
    want = sorted(((i, len(raw(t)), n := len(ids_of(library, t)), n > 1024)
                   for i, t in awkward_texts()), key=repr)
    assert got == want
    assert token_counts.token_counts(documents(spark, []), JSON).count() == 0


def test_sentencepiece_counts(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    found = token_counts.token_counts(documents(spark, [(1, "A cat sat."), (2, None)]), path)
    assert {r.doc_id: r.n_tokens for r in found.collect()} == {
        1: len(processor.encode("A cat sat.")), 2: 0}


@pytest.mark.parametrize("text", [
    prose(5, 900), "word" * 2000, "a b " * 700, "   \n\n" * 800, prose(6, 200) + "x" * 3000 + " y z",
    "ab<|endoftext|>cd " * 200, "日本語 の 文 " * 300, "tab\tnew\nline " * 300,
])
@pytest.mark.parametrize("chunk, overlap", [(64, 16), (200, 7), (1000, 50)])
def test_spliced_counts_equal_whole_counts(library, text, chunk, overlap):
    want = len(ids_of(library, text))
    assert token_counts.count_spliced(library, text, chunk, overlap) == want


def test_perfect_hash_is_minimal_and_rejects_strangers():
    keys = [str(i).encode() for i in range(5000)]
    found = byte_bpe.PerfectHash(keys)
    assert found.find(keys) == list(range(5000))
    assert sorted(found.place.tolist()) == list(range(5000))
    assert found.find([b"-1", b"5000", b""]) == [-1, -1, -1]


def test_bytes_encode_as_the_library_and_decode_back(spark):
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding(
        "t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = byte_bpe.digests(byte_bpe.encode_decode(
        documents(spark, extra=True), RANKS, public_tokenizers.PATTERN))
    want = []
    for i, t in awkward_texts():
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(to_bytes(f"<{len(ids)}I", *ids)).hexdigest(),
                     hashlib.sha256(raw(t)).hexdigest()))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)


def test_merges_of_random_bytes():
    coder = byte_bpe.Codec(RANKS, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN,
                                mergeable_ranks=coder.ranks, special_tokens={})
    r = random.Random(3)
    for _ in range(400):
        word = "".join(r.choice("aeinrst éß東") for _ in range(r.randrange(1, 60)))
        ids = coder.encode([word])[0]
        assert ids == to_bytes(f"<{len(ids) // 4}I", *library.encode_ordinary(word))
        assert coder.decode(ids) == word.encode()


def check_sequences(rows, capacity):
    """Every sequence is gapless from 0 and within the capacity; returns how many there are."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_keeps_every_token_once(spark, library):
    rows = packing.pack(documents(spark, extra=True), JSON, capacity=64).collect()
    check_sequences(rows, 64)
    got = sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr)
    want = []
    for i, t in awkward_texts():
        ids, at = [*ids_of(library, t), 2], 0
        sizes = ([len(ids) % 64] if len(ids) % 64 else []) + [64] * (len(ids) // 64)
        for k, n in enumerate(sizes):
            crc = zlib.crc32(to_bytes(f"<{n}I", *ids[at : at + n]))
            want.append((i, k, at, n, crc))
            at += n
    assert got == sorted(want, key=repr)
    whole = packing.pack(documents(spark), JSON, capacity=64, with_ids=True).collect()
    assert sorted(zlib.crc32(r.ids) for r in whole) == sorted(w[4] for w in want)
    assert packing.pack(documents(spark, []), JSON).count() == 0


def fewest(items, capacity):
    """Bins of an optimal packing, by exhaustive search over the fullest bins."""
    if not items:
        return 0
    first, rest = items[0], items[1:]
    best = len(items)
    for k in range(len(rest), -1, -1):
        for pick in itertools.combinations(range(len(rest)), k):
            if first + sum(rest[i] for i in pick) <= capacity:
                left = [x for i, x in enumerate(rest) if i not in pick]
                best = min(best, 1 + fewest(left, capacity))
        if best == -(-sum(items) // capacity):
            break
    return best


def test_dominating_sets_never_cost_a_bin():
    r = random.Random(7)
    for _ in range(150):
        capacity = r.choice([10, 20, 30])
        items = sorted((r.randrange(1, capacity + 1) for _ in range(r.randrange(1, 8))),
                       reverse=True)
        counts = {s: items.count(s) for s in items}
        left = dict(counts)
        fixed = packing.reduce_by_dominance(left, capacity)
        rest = sorted((s for s, n in left.items() for _ in range(n)), reverse=True)
        assert sum(n for _, n in fixed) + fewest(rest, capacity) == fewest(items, capacity)


def test_best_fit_equals_one_piece_at_a_time():
    r = random.Random(8)
    for _ in range(200):
        capacity = r.choice([17, 40, 100])
        items = sorted((r.randrange(1, capacity + 1) for _ in range(r.randrange(0, 60))),
                       reverse=True)
        bins = []
        for s in items:
            fits = [i for i, free in enumerate(bins) if free >= s]
            if fits:
                bins[min(fits, key=lambda i: bins[i])] -= s
            else:
                bins.append(capacity - s)
        plan = packing.best_fit({s: items.count(s) for s in items}, capacity)
        assert sorted(capacity - sum(own) for own, n in plan for _ in range(n)) == sorted(bins)


def test_seats_number_every_piece():
    counts = {7: 1000, 3: 999, 2: 10_001, 10: 4}
    plan = packing.plan_bins(dict(counts), 10)
    assert {s: sum(own.count(s) * n for own, n in plan) for s in counts} == counts
    total = sum(s * n for s, n in counts.items())
    assert sum(n for _, n in plan) == -(-total // 10)
