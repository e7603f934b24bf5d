"""Bidirectional FM-index over a delimited list of words, and searches that allow one error."""

from __future__ import annotations

import numpy as np

#: Queries searched at a time.
QUERIES_AT_ONCE = 8_192


def rotation_order(symbols: np.ndarray) -> np.ndarray:
    """Start of each rotation of a cyclic sequence in sorted order, by prefix doubling."""
    n, step = len(symbols), 1
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    while True:
        key = rank * (rank.max() + 1) + np.roll(rank, -step)
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[False, np.diff(key[order]) > 0])
        if rank[order[-1]] == n - 1 or step >= n:
            return order
        step *= 2


class Side:
    """The symbols before the sorted rotations as a wavelet matrix, with the rotations' starts."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.first = np.searchsorted(np.sort(symbols), np.arange(size))
        current = symbols[rotation_order(symbols) - 1]
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for bit in range(max(1, (size - 1).bit_length()) - 1, -1, -1):
            ones = (current >> bit & 1).astype(bool)
            zeros = np.r_[0, np.cumsum(~ones)].astype(np.int32)
            self.levels.append((bit, zeros, int(zeros[-1])))
            current = np.r_[current[~ones], current[ones]]
        self.shift = self.first - self._descend(
            np.zeros(size, np.int64), np.zeros(size, np.int64), np.arange(size))[0]

    def _descend(self, low, high, symbol):
        less = np.zeros(len(low), np.int64)
        for bit, zeros, total in self.levels:
            low0, high0 = zeros[low], zeros[high]
            one = symbol >> bit & 1 == 1
            less += np.where(one, high0 - low0, 0)
            low = np.where(one, total + low - low0, low0)
            high = np.where(one, total + high - high0, high0)
        return low, high, less

    def step(self, low: np.ndarray, size: np.ndarray, symbol: np.ndarray) -> tuple:
        """(low, size, smaller) after one symbol is put before the pattern.

        ``smaller`` counts the occurrences that smaller symbols precede: by so much the interval
        of the other direction moves.
        """
        at, end, less = self._descend(low, low + size, symbol)
        return at + self.shift[symbol], end - at, less

    def children(self, low: np.ndarray, size: np.ndarray) -> tuple:
        """(interval, symbol, low, size, smaller) for all symbols that precede each interval."""
        owner = np.arange(len(low))
        high, symbol, less = low + size, np.zeros(len(low), np.int64), np.zeros(len(low), np.int64)
        for _, zeros, total in self.levels:
            low0, high0 = zeros[low].astype(np.int64), zeros[high].astype(np.int64)
            low = np.r_[low0, total + low - low0]
            high = np.r_[high0, total + high - high0]
            less = np.r_[less, less + high0 - low0]
            symbol = np.r_[symbol << 1, symbol << 1 | 1]
            owner = np.r_[owner, owner]
            some = high > low
            low, high, less, symbol, owner = (
                x[some] for x in (low, high, less, symbol, owner))
        return owner, symbol, low + self.shift[symbol], high - low, less


class WordIndex:
    """Suffix-rank intervals of patterns over ``$word$word...`` in both directions, kept in step.

    A state of a pattern is (low among the sorted rotations, low among those of the reversed
    text, occurrences). The delimiter is the smallest symbol, so the rotations that begin with it
    come first and in the order of the words: the rank of a whole ``$word$`` is the place of the
    word in sorted order.
    """

    def __init__(self, words: list[str]):
        """``words``: distinct, not empty, in code-point order."""
        codes, sizes = flat(words)
        self.alphabet = np.unique(codes)
        ends = np.cumsum(sizes + 1)
        text = np.zeros(int(ends[-1]), np.int64)
        inside = np.ones(len(text), bool)
        inside[ends - sizes - 1] = False
        text[inside] = np.searchsorted(self.alphabet, codes) + 1
        self.words = len(words)
        self.sides = {False: Side(text, len(self.alphabet) + 1),
                      True: Side(text[::-1], len(self.alphabet) + 1)}

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        """Symbols of code points; -1 for those that no word holds."""
        at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == codes, at + 1, -1)

    def extend(self, right: bool, low, other, size, symbol) -> tuple:
        """States after one symbol on the left or right end.

        ``low`` belongs to the direction of the extension, ``other`` to the opposite one.
        """
        low, grown, smaller = self.sides[right].step(low, size, symbol)
        return low, other + smaller, grown

    def branch(self, right: bool, low, other, size) -> tuple:
        """(state's number, symbol, low, other, size) of all one-symbol extensions that occur."""
        owner, symbol, low, grown, smaller = self.sides[right].children(low, size)
        return owner, symbol, low, other[owner] + smaller, grown


def flat(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words on end, and the length of each."""
    joined = "".join(words).encode("utf-32-le", "surrogatepass")
    return (np.frombuffer(joined, dtype="<u4").astype(np.int64),
            np.fromiter(map(len, words), np.int64, len(words)))


def one_error(index: WordIndex, queries: list[str], right: bool) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) numbers of the words at one insertion, deletion or replacement.

    With ``right`` the first half (rounded down) of a query is matched exactly, and the error lies
    in the rest; otherwise the second half is matched from its end and the error lies before it.
    An edit within a run of equal characters counts at its right end, so the two searches
    together yield each pair once.
    """
    found = [_search(index, queries[i : i + QUERIES_AT_ONCE], i, right)
             for i in range(0, len(queries), QUERIES_AT_ONCE)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _search(index: WordIndex, queries: list[str], base: int, right: bool):
    codes, length = flat(queries)
    symbols = np.r_[index.symbols(codes), 0]
    start = np.cumsum(length) - length
    exact = length // 2 if right else length - length // 2

    def at(query, place):
        """The symbol read at a place, in the direction of the search."""
        return symbols[start[query] + (place if right else length[query] - 1 - place)]

    def only(mask, *arrays):
        return tuple(x[mask] for x in arrays)

    # clean: no error so far; once: one error made, only exact steps remain
    n = len(queries)
    clean = (np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64),
             np.full(n, index.words))
    once = (np.zeros(0, np.int64),) * 5
    hits_query, hits_word = [], []
    while len(clean[0]) or len(once[0]):
        parts = []
        query, place, low, other, size = once
        if len(query):
            last = place == length[query]
            symbol = np.where(last, 0, at(query, np.minimum(place, length[query] - 1)))
            known = symbol >= 0
            query, place, low, other, size, symbol, last = only(
                known, query, place, low, other, size, symbol, last)
            low, other, size = index.extend(right, low, other, size, symbol)
            done = last & (size > 0)
            hits_query.append(query[done] + base)
            hits_word.append((other if right else low)[done])
            parts.append(only(~last & (size > 0), query, place + 1, low, other, size))
        query, place, low, other, size = clean
        clean_parts = []
        if len(query):
            early = place < exact[query]
            q, p, lo, ot, sz = only(early, query, place, low, other, size)
            symbol = at(q, p)
            q, p, lo, ot, sz, symbol = only(symbol >= 0, q, p, lo, ot, sz, symbol)
            lo, ot, sz = index.extend(right, lo, ot, sz, symbol)
            clean_parts.append(only(sz > 0, q, p + 1, lo, ot, sz))

            q, p, lo, ot, sz = only(~early, query, place, low, other, size)
            more = p < length[q]
            mine = np.where(more, at(q, np.minimum(p, length[q] - 1)), 0)
            if right:  # the symbol to the right of the edit, which it must differ from
                beside = mine
                after = np.where(p + 1 < length[q], at(q, np.minimum(p + 1, length[q] - 1)), 0)
                insertable = np.ones(len(q), bool)
            else:
                beside = after = at(q, np.maximum(p - 1, 0))
                insertable = p > exact[q]
            drop = more & (mine != after)
            if right:  # the last character has nothing to its right
                drop |= more & (p + 1 == length[q])
            parts.append(only(drop, q, p + 1, lo, ot, sz))
            owner, symbol, lo, ot, sz = index.branch(right, lo, ot, sz)
            letter = symbol > 0
            owner, symbol, lo, ot, sz = only(letter, owner, symbol, lo, ot, sz)
            q, p = q[owner], p[owner]
            same = more[owner] & (symbol == mine[owner])
            clean_parts.append(only(same, q, p + 1, lo, ot, sz))
            parts.append(only(more[owner] & ~same, q, p + 1, lo, ot, sz))
            inserted = insertable[owner] & (symbol != beside[owner])
            parts.append(only(inserted, q, p, lo, ot, sz))
        once = tuple(np.concatenate(x) for x in zip(*parts)) if parts else once
        clean = (tuple(np.concatenate(x) for x in zip(*clean_parts)) if clean_parts
                 else (np.zeros(0, np.int64),) * 5)
        if not parts:
            once = (np.zeros(0, np.int64),) * 5
    return (np.concatenate([*hits_query, np.zeros(0, np.int64)]),
            np.concatenate([*hits_word, np.zeros(0, np.int64)]))
