"""Byte-level BPE by ranks: a minimal perfect hash for known pre-tokens, a heap for the others."""

from __future__ import annotations

import base64
from collections.abc import Sequence
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain
from struct import pack, unpack

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.common import map_rows, slices, text_bytes

#: Pre-tokens a worker remembers, and the longest that is worth it (code points).
MEMORY, LONGEST = 600_000, 64

OUTPUT = T.StructType([
    T.StructField("ids", T.BinaryType()),
    T.StructField("decoded", T.BinaryType()),
])


class PerfectHash:
    """Minimal perfect hash of byte strings by hash and displace.

    A key's 64-bit hash gives a group. Groups, largest first, get the smallest displacement that
    moves all their keys to free places; a key alone in its group takes a place that is left, which
    its group names outright. ``n`` keys fill ``n`` places. A lookup is two array reads and one
    comparison of the key kept there.
    """

    def __init__(self, keys: Sequence[bytes], seed: int = 0):
        self.n, self.groups, self.seed = max(len(keys), 1), max(1, len(keys) // 2), seed
        hashes = self.hashes(keys)
        if len(set(hashes.tolist())) < len(keys):
            raise ValueError("two keys are equal or share a hash; use another seed")
        order = np.argsort(hashes % np.uint64(self.groups), kind="stable")
        cuts = np.searchsorted((hashes % np.uint64(self.groups))[order],
                               np.arange(self.groups + 1, dtype=np.uint64))
        self.shift = np.zeros(self.groups, dtype=np.int64)
        self.place = np.full(self.n, -1, dtype=np.int64)
        free = np.ones(self.n, dtype=bool)
        by_size = np.argsort(cuts[:-1] - cuts[1:], kind="stable")
        for g in by_size[: int((np.diff(cuts) > 1).sum())]:
            members = order[cuts[g] : cuts[g + 1]]
            tries, good = np.arange(64), np.zeros(64, dtype=bool)
            while not good.any():
                at = self._places(hashes[members][None, :], tries[:, None])
                apart = np.diff(np.sort(at, axis=1), axis=1).all(axis=1)
                good = free[at].all(axis=1) & apart
                tries = tries + 64
            first = int(good.argmax())
            at = at[first]
            self.shift[g], self.place[at] = tries[first] - 64, members
            free[at] = False
        alone = by_size[np.diff(cuts)[by_size] == 1]
        left = np.flatnonzero(free)[: len(alone)]
        self.shift[alone], self.place[left] = -1 - left, order[cuts[alone]]
        self.keys = [keys[i] if i >= 0 else None for i in self.place.tolist()]

    def hashes(self, keys: Sequence[bytes]) -> np.ndarray:
        seed, digest = self.seed, xxhash.xxh64_intdigest
        return np.fromiter((digest(k, seed) for k in keys), dtype=np.uint64, count=len(keys))

    def _places(self, hashes: np.ndarray, shift: np.ndarray) -> np.ndarray:
        moved = hashes ^ (shift.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        mixed = moved * np.uint64(0xBF58476D1CE4E5B9)
        at = ((mixed ^ (mixed >> np.uint64(31))) % np.uint64(self.n)).astype(np.int64)
        return np.where(shift < 0, -1 - shift, at)

    def find(self, keys: Sequence[bytes]) -> list[int]:
        """Index of each key in the list the hash was built from, -1 if it is not there."""
        hashes = self.hashes(keys)
        at = self._places(hashes, self.shift[hashes % np.uint64(self.groups)]).tolist()
        mine, place = self.keys, self.place
        return [int(place[a]) if mine[a] == k else -1 for k, a in zip(keys, at)]


def merge(word: bytes, single: list[int], pairs: dict[int, int]) -> list[int]:
    """Ids of one pre-token: always join the adjacent pair of least rank, the leftmost on ties.

    Parts form a linked list over byte positions; a heap holds (rank, position) of the pairs that
    spell a token. An entry whose pair a neighbouring merge has changed is skipped when it comes
    up. ``pairs`` maps two packed ids to the id (rank) of their concatenation.
    """
    ids = [single[b] for b in word]
    n = len(ids)
    get = pairs.get
    rank = [get(a << 20 | b, -1) for a, b in zip(ids, ids[1:])]  # of the pair that starts here
    heap = [r << 32 | i for i, r in enumerate(rank) if r >= 0]
    if not heap:
        return ids
    heapify(heap)
    rank.append(-1)
    after, before = list(range(1, n + 1)), list(range(-1, n))
    while heap:
        top = heappop(heap)
        i = top & 0xFFFFFFFF
        joined = top >> 32
        if rank[i] != joined:
            continue
        gone = after[i]
        end = after[gone]
        ids[i], ids[gone], after[i], rank[gone] = joined, -1, end, -1
        if end < n:
            before[end] = i
            rank[i] = r = get(joined << 20 | ids[end], -1)
            if r >= 0:
                heappush(heap, r << 32 | i)
        else:
            rank[i] = -1
        left = before[i]
        if left >= 0:
            rank[left] = r = get(ids[left] << 20 | joined, -1)
            if r >= 0:
                heappush(heap, r << 32 | left)
    return [x for x in ids if x >= 0]


class Codec:
    """Encoder and decoder for one rank file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            rows = [line.split() for line in f if line.strip()]
        self.tokens = {int(b): base64.b64decode(a) for a, b in rows}
        self.ranks = {t: i for i, t in self.tokens.items()}
        self.order = list(self.ranks)
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        if len(self.ranks) >= 1 << 20:
            raise ValueError("pairs are packed for vocabularies of up to 2^20 tokens")
        self.pairs = {
            self.ranks[t[:k]] << 20 | self.ranks[t[k:]]: i
            for t, i in self.ranks.items() for k in range(1, len(t))
            if t[:k] in self.ranks and t[k:] in self.ranks
        }
        self.whole = PerfectHash(self.order)
        self.packed = [pack("<I", self.ranks[t]) for t in self.order]
        self.split = regex.compile(pattern)
        self.memory: dict[str, bytes] = {}

    def words(self, words: list[str]) -> list[bytes]:
        """Packed ids of pre-tokens: whole ones by the perfect hash, the rest by merging."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        whole, single, pairs = self.packed, self.single, self.pairs
        out = []
        for w, at in zip(raw, self.whole.find(raw)):
            if at >= 0:
                out.append(whole[at])
            else:
                ids = merge(w, single, pairs)
                out.append(pack(f"<{len(ids)}I", *ids))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text; every distinct pre-token is resolved once."""
        out: list[bytes] = []
        for part in slices([len(t) for t in texts]):
            pieces = [self.split.findall(t) for t in texts[part]]
            words = set(chain.from_iterable(pieces))
            if len(self.memory) > MEMORY:
                self.memory.clear()
            known = self.memory
            fresh = list(words.difference(known))
            known.update(zip(fresh, self.words(fresh)))
            out += [b"".join(map(known.__getitem__, p)) for p in pieces]
            for w in fresh:
                if len(w) > LONGEST:
                    del known[w]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, unpack(f"<{len(ids) // 4}I", ids)))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """Built once in each Python worker; the vocabulary is the only state and does not grow."""
    return Codec(path, pattern)


def encode_decode(
    df: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Id, packed ids and decoded bytes of every row.

    Whole texts are encoded, a null text as the empty one (no ids). Malformed bytes are read as
    U+FFFD. Ids pass through, null or repeated; other columns are not read.
    """

    def compute(columns):
        coder = codec(path, pattern)
        texts = [x.decode("utf-8", "replace") for x in text_bytes(columns[0])]
        ids = coder.encode(texts)
        return [ids, [coder.decode(x) for x in ids]]

    return map_rows(df, [text_column], OUTPUT, compute, keep=[id_column])


def digests(encoded: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Number of ids and SHA-256 of the ids and of the decoded bytes, from the table above."""
    return encoded.select(
        id_column,
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
