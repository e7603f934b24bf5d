"""Repeated passages across documents, by enhanced suffix arrays over anchored contexts.

A text is seen as windows of ``least`` bytes. Each window names the leftmost smallest hash among
its shorter byte strings, so equal windows name equal strings (anchors) wherever they occur.

1. Anchors that two different texts have, with the same bytes before or after, are found by hash;
   the rest of the corpus is done.
2. The windows of such an anchor, one run of bytes per occurrence, go to the task of the anchor.
3. That task sorts the suffixes of the different runs of an anchor into a suffix array, computes
   common prefixes, and scans them with a stack: intervals of the prefix tree that cannot be
   extended to the left in all their occurrences are the maximal repeats, each with all its
   occurrences.
4. Spans go back to the texts.

Equal texts, by their digests, and runs that are equal as a whole, by their bytes, are matched
before that; on copied text most removed bytes are decided so, the edges of a copy by the arrays.

Texts and occurrences travel in compressed blocks of many, never one row each.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.core import cut_lineage
from tablewright.llm.common import free_disk, release, slices, text_bytes

#: Length of an anchor, text bytes of a block of texts, run bytes above which the runs of a bucket
#: are split over several tasks, and run bytes of one suffix array (each takes some 80 bytes).
ANCHOR, BLOCK_BYTES, BUCKET_BYTES, ARRAY_BYTES = 16, 8 << 20, 16 << 20, 1 << 20
#: Ranges of anchors for each block of texts: the runs of a range are held as objects by a task.
RANGES = 2
#: Text bytes gathered in a task before they are dealt out.
GATHER_BYTES = 8 << 20
#: Text bytes hashed at once: each takes about a hundred bytes of arrays, which stay in the cache.
HASHED_BYTES = 1 << 16
#: Text bytes from which shuffles that are done with are freed between steps, which takes seconds.
FREED_BYTES = 64 << 20
#: Id of a text whose ids are all null: later than any other.
NO_ID = np.iinfo(np.int64).max

_TABLE = np.random.default_rng(20_200_229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(
    2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def _pack(*arrays) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(arrays, protocol=5))


def _unpack(block: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(block))


def _planes(values: np.ndarray) -> tuple[int, bytes]:
    """Whole numbers byte by byte, the last bytes of all first: zeros and repeats lie together."""
    wide = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    return len(values), wide[:, : max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)].T.tobytes()


def _from_planes(planes: tuple[int, bytes]) -> np.ndarray:
    n, data = planes
    wide = np.zeros((n, 8), dtype=np.uint8)
    if n:
        own = np.frombuffer(data, dtype=np.uint8).reshape(-1, n).T
        wide[:, : own.shape[1]] = own
    return wide.reshape(-1).view("<u8").astype(np.uint64)


def _steps(rising: np.ndarray) -> tuple[int, bytes]:
    """Rising numbers as planes of their differences."""
    return _planes(np.diff(rising, prepend=np.uint64(0)))


def _from_steps(planes: tuple[int, bytes]) -> np.ndarray:
    return np.cumsum(_from_planes(planes), dtype=np.uint64)


def string_hashes(data: np.ndarray, k: int, power: dict[int, np.ndarray]) -> np.ndarray:
    """64-bit hash of every ``k`` consecutive bytes, by doubling; ``power`` keeps the doublings."""
    power.setdefault(1, _TABLE[data])
    m = 1
    while 2 * m <= k:
        if 2 * m not in power:
            factor = np.uint64(pow(_BASE, m, 1 << 64))
            power[2 * m] = power[m][:-m] * factor + power[m][m:]
        m *= 2
    out, done = None, 0
    for b in sorted(power, reverse=True):
        if k - done >= b:
            part = power[b][done:]
            if out is None:
                out = part
            else:
                n = min(len(out), len(part))
                out = out[:n] * np.uint64(pow(_BASE, b, 1 << 64)) + part[:n]
            done += b
    out = out[: len(data) - k + 1]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def anchored_runs(texts: list[bytes], least: int) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, anchor hash, left, right) of the runs of all windows.

    The windows of a run share an anchor; positions count within the text, and every window of
    ``least`` bytes lies in exactly one run. ``left`` and ``right`` are hashes (16 bits, above 0)
    of the anchor with half of a window's other bytes before or after it; 0 if the text has not so
    many. A window holds one of these two strings, whatever its place about the anchor.
    """
    none = np.zeros(0, dtype=np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    if len(data) < least:
        return none, none, none, none.astype(np.uint64), none, none
    k = min(ANCHOR, least // 2)
    power: dict[int, np.ndarray] = {}
    value = string_hashes(data, k, power)
    half = (least - k + 1) // 2
    wide = string_hashes(data, k + half, power)
    window = least - k + 1
    low, at = value, np.arange(len(value), dtype=np.int32)
    m = 1
    for step in [1 << i for i in range(window.bit_length())] + [window]:
        shift = m if step != window else window - m
        if step == 1 or not shift:
            continue
        right = low[shift:] < low[:-shift]
        low = np.where(right, low[shift:], low[:-shift])
        at = np.where(right, at[shift:], at[:-shift])
        m = step
    ends = np.cumsum(lengths)
    text = np.repeat(np.arange(len(texts)), np.maximum(lengths - least + 1, 0))
    starts = ends - lengths
    inside = np.arange(len(text)) - np.repeat(
        np.cumsum(np.maximum(lengths - least + 1, 0)) - np.maximum(lengths - least + 1, 0),
        np.maximum(lengths - least + 1, 0))
    place = inside + starts[text]
    anchor = at[place]
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]) if len(
        text) else none
    last = np.r_[new[1:], len(text)] - 1
    anchor, own = anchor[new].astype(np.int64), text[new]

    def side(at: np.ndarray) -> np.ndarray:
        fits = (at >= starts[own]) & (at + k + half <= ends[own])
        hashed = wide[np.clip(at, 0, len(wide) - 1)] >> np.uint64(48)
        return np.where(fits, np.maximum(hashed, np.uint64(1)), np.uint64(0)).astype(np.int64)

    # the smallest hashes of windows crowd at zero; mixed again they fill their range evenly
    mixed = (value[anchor] ^ (value[anchor] >> np.uint64(31))) * np.uint64(_BASE)
    mixed ^= mixed >> np.uint64(29)
    return own, inside[new], inside[last], mixed, side(anchor - half), side(anchor)


def _homes(keys: np.ndarray, parts: int) -> np.ndarray:
    """Block of each text, by its key."""
    return (keys[:, 0] % np.uint64(parts)).astype(np.int64)


def _bucket(marks: np.ndarray, parts: int, bits: int) -> np.ndarray:
    """Range of each mark, a number of ``bits`` bits."""
    return (marks >> np.uint64(bits - 32) if bits > 32 else marks).astype(np.int64) * parts >> min(
        bits, 32)


def _shared(mark: np.ndarray, side: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Rows whose mark and side hash a row with another key (low, high) has as well."""
    at = np.flatnonzero(side)
    code = mark[at] ^ (side[at].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    order = np.argsort(code, kind="stable")
    out = np.zeros(len(mark), dtype=bool)
    if len(at):
        starts = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0])
        many = np.zeros(len(starts), dtype=bool)
        for part in (low, high):
            own = part[at[order]]
            many |= np.minimum.reduceat(own, starts) != np.maximum.reduceat(own, starts)
        out[at[order]] = np.repeat(many, np.diff(np.r_[starts, len(order)]))
    return out


def _first_of(mark: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Rows that are the first with their mark and side hash."""
    at = np.flatnonzero(side)
    code = mark[at] ^ (side[at].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    out = np.zeros(len(mark), dtype=bool)
    out[at[np.unique(code, return_index=True)[1]]] = True
    return out


def _keys(texts: list[bytes]) -> np.ndarray:
    digest = b"".join(hashlib.sha256(t).digest()[:16] for t in texts)
    return np.frombuffer(digest, dtype="<u8").reshape(-1, 2)


def _deal(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of each part that has any."""
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cuts)):
        yield int(p), order[cuts[p] : cuts[p + 1]]


def _few(keys: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Only the keys in use, and the texts renumbered to match."""
    used, again = np.unique(text, return_inverse=True)
    return keys[used], again.astype(np.int32)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """Different texts of a task, some megabytes at a time."""
    held: dict[bytes, None] = {}
    size = 0
    for batch in batches:
        for t in text_bytes(batch.column(0)):
            if t not in held:
                held[t] = None
                size += len(t)
            if size > GATHER_BYTES:
                yield list(held)
                held, size = {}, 0
    if held:
        yield list(held)
    held.clear()
    release()


def _rows(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=k) for c, k in zip(columns, kinds)], names=names)


def _hashed_slices(texts: list[bytes], least: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(texts, offsets, bytes) of runs of whole texts; a long text comes in parts.

    Parts overlap by ``least - 1`` bytes, so each window lies in one part. One of the two side
    strings of a window lies in it, and thus in its part; nothing that is shared is missed.
    """
    for part in slices([len(t) for t in texts], HASHED_BYTES):
        long = texts[part.start]
        if len(long) <= 2 * HASHED_BYTES:
            yield list(range(part.start, part.stop)), [0] * (part.stop - part.start), texts[part]
            continue
        for at in range(0, len(long) - least + 1, HASHED_BYTES):  # a long text is alone in its run
            yield [part.start], [at], [long[at : at + HASHED_BYTES + least - 1]]


def _all_runs(texts: list[bytes], least: int, places: bool = True) -> tuple[np.ndarray, ...]:
    """The runs of :func:`anchored_runs` of many texts, slice by slice, in narrow types.

    Without ``places`` the windows' positions are left out.
    """
    found = []
    for numbers, offsets, own in _hashed_slices(texts, least):
        text, first, last, anchor, left, right = anchored_runs(own, least)
        shift = np.array(offsets, dtype=np.int64)
        sides = (left.astype(np.uint16), right.astype(np.uint16))
        where = (first + shift[text], last + shift[text]) if places else ()
        found.append((np.array(numbers, dtype=np.int32)[text], *where, anchor, *sides))
    if found:
        return tuple(np.concatenate(x) for x in zip(*found))
    return (np.zeros(0, int),) * (6 if places else 4)


BLOCK = "kind int, part long, size long, block binary"
BLOCK_NAMES, BLOCK_KINDS = ["kind", "part", "size", "block"], [
    pa.int32(), pa.int64(), pa.int64(), pa.binary()]
#: Kinds of blocks: marks asked about, marks known to be shared, runs of bytes, spans.
ASKED, SHARED, RUNS, SPANS = range(4)


def _shared_blocks(keys: np.ndarray, text: np.ndarray, mark: np.ndarray,
                   parts: int) -> list[tuple]:
    """Rows of marks (rising) known to be shared, for the blocks of their texts."""
    rows = []
    for p, at in _deal(_homes(keys, parts)[text], parts):
        few, again = _few(keys, text[at])
        rows.append((SHARED, p, 0, _pack(few, _planes(again), _steps(mark[at]))))
    return rows


def ask(texts: DataFrame, least: int, parts: int, bits: int) -> DataFrame:
    """Blocks of marks, the first ``bits`` bits of anchor hashes, with their side hashes.

    What a task's own texts share is said at once. Of rows with equal mark and side hashes one
    goes on to be compared with other tasks, so a passage in every text costs a row per task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _gathered(batches):
            keys, rows = _keys(own), []
            text, anchor, left, right = _all_runs(own, least, places=False)
            mark = anchor >> np.uint64(64 - bits)
            order = np.argsort(mark, kind="stable")
            text, mark, left, right = (x[order] for x in (text, mark, left, right))
            number = text.astype(np.uint64)
            local = np.flatnonzero(_shared(mark, left, number, number)
                                   | _shared(mark, right, number, number))
            rows += _shared_blocks(keys, text[local], mark[local], parts)
            lead = np.flatnonzero(_first_of(mark, left) | _first_of(mark, right))
            for p, at in _deal(_bucket(mark[lead], parts, bits), parts):
                at = lead[at]
                few, again = _few(keys, text[at])
                rows.append((ASKED, p, 0, _pack(
                    few, _planes(again), _steps(mark[at]), _planes(left[at]), _planes(right[at]))))
            yield _rows(rows, BLOCK_NAMES, BLOCK_KINDS)

    return texts.mapInArrow(run, BLOCK)


def answer(asked: DataFrame, parts: int) -> DataFrame:
    """Blocks of the marks that different texts share, for the blocks of these texts."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("kind")[0].as_py() == SHARED:
            return table
        blocks = [_unpack(b) for b in table.column("block").to_pylist()]
        shift = np.cumsum([0] + [len(b[0]) for b in blocks])
        keys = np.concatenate([b[0] for b in blocks])
        text = np.concatenate([_from_planes(b[1]).astype(np.int64) + s
                               for b, s in zip(blocks, shift)])
        mark = np.concatenate([_from_steps(b[2]) for b in blocks])
        left, right = (np.concatenate([_from_planes(b[i]) for b in blocks]) for i in (3, 4))
        low, high = keys[text, 0], keys[text, 1]
        at = np.flatnonzero(_shared(mark, left, low, high) | _shared(mark, right, low, high))
        at = at[np.argsort(mark[at], kind="stable")]
        rows = _shared_blocks(keys, text[at], mark[at], parts)
        return pa.Table.from_batches([_rows(rows, BLOCK_NAMES, BLOCK_KINDS)])

    return asked.groupBy("kind", "part").applyInArrow(run, BLOCK)


def text_blocks(texts: DataFrame, parts: int) -> DataFrame:
    """Blocks of different texts, dealt out by their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _gathered(batches):
            rows = []
            for p, at in _deal(_homes(_keys(own), parts), parts):
                mine = [own[i] for i in at]
                rows.append((p, _pack([len(t) for t in mine], b"".join(mine))))
            yield _rows(rows, ["part", "texts"], [pa.int64(), pa.binary()])

    return texts.mapInArrow(run, "part long, texts binary")


def _block_texts(table: pa.Table) -> dict[bytes, bytes]:
    """Texts of a block by key."""
    found: dict[bytes, bytes] = {}
    for block in table.column("texts").to_pylist():
        lengths, data = _unpack(block)
        at = 0
        for n in lengths:
            t = data[at : at + n]
            found.setdefault(hashlib.sha256(t).digest()[:16], t)
            at += n
    return found


def _spans(keys: np.ndarray, text: np.ndarray, start: np.ndarray, length: np.ndarray,
           parts: int) -> list[tuple]:
    rows = []
    for p, at in _deal(_homes(keys, parts)[text], parts) if len(text) else ():
        few, again = _few(keys, text[at])
        rows.append((SPANS, p, 0, _pack(few, again, start[at], length[at].astype(np.int32))))
    return rows


def collect_runs(
    texts: DataFrame, notes: DataFrame, least: int, parts: int, bits: int
) -> DataFrame:
    """Runs of the shared anchors for the anchors' tasks; spans that a block can tell itself.

    Of equal runs in a block only that of the smallest id goes on, the others are repeats of it.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        release()
        found = _block_texts(left)
        names, own = list(found), list(found.values())
        number = {k: i for i, k in enumerate(names)}
        keys = np.frombuffer(b"".join(names), dtype="<u8").reshape(-1, 2)
        ids = np.full(len(own), NO_ID, dtype=np.int64)
        wanted = []
        for block, key, i in zip(*(right.column(c).to_pylist() for c in ("block", "key", "id"))):
            if block is None:
                if key in number and i is not None:
                    ids[number[key]] = i
                continue
            few, again, mark = _unpack(block)
            place = np.array([number.get(k.tobytes(), -1) for k in few], dtype=np.int64)
            wanted.append(_ask_code(
                place[_from_planes(again).astype(np.int64)], _from_steps(mark)))
        text, first, last, anchor, _, _ = _all_runs(own, least)
        anchor = anchor >> np.uint64(64 - bits)
        if not wanted or not len(text):
            return pa.Table.from_batches([_rows([], BLOCK_NAMES, BLOCK_KINDS)])
        code = _ask_code(text, anchor)
        at = np.flatnonzero(np.isin(code, np.unique(np.concatenate(wanted))))
        text, first, last, anchor = text[at], first[at], last[at], anchor[at]
        del code
        order = np.argsort(ids[text], kind="stable")  # of equal runs the first is the smallest id
        seen: dict[bytes, int] = {}
        keep, again_text, again_first, again_length = [], [], [], []
        for i in order.tolist():
            t, a, b = int(text[i]), int(first[i]), int(last[i]) + least
            run_bytes = own[t][a:b]
            before = seen.setdefault(run_bytes, i)
            if before == i:
                keep.append(i)
            elif ids[text[before]] < ids[t]:
                again_text.append(t)
                again_first.append(a)
                again_length.append(b - a)
            else:
                keep.append(i)
        rows = _spans(keys, np.array(again_text, dtype=np.int64),
                      np.array(again_first, dtype=np.int64),
                      np.array(again_length, dtype=np.int64), parts)
        keep = np.array(keep, dtype=np.int64)
        keep = keep[np.argsort(anchor[keep], kind="stable")]
        for p, at in _deal(_bucket(anchor[keep], RANGES * parts, bits), RANGES * parts):
            mine = keep[at]
            few, again = _few(keys, text[mine])
            used = np.unique(text[mine])
            strings = [own[t][a:b] for t, a, b in zip(
                text[mine].tolist(), first[mine].tolist(), (last[mine] + least).tolist())]
            data = b"".join(strings)
            rows.append((RUNS, p, len(data), _pack(
                few, ids[used], _planes(again), _planes(first[mine]), _steps(anchor[mine]),
                np.array([len(s) for s in strings], dtype=np.uint16), data)))
        return pa.Table.from_batches([_rows(rows, BLOCK_NAMES, BLOCK_KINDS)])

    return texts.groupBy("part").cogroup(notes.groupBy("part")).applyInArrow(run, BLOCK)


def _ask_code(text: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """One number for (text of the block, mark); a chance match only adds a run to compare."""
    return anchor ^ ((text.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))


def suffix_array(strings: list[bytes], least: int) -> tuple[np.ndarray, ...]:
    """(string, offset, common prefix with the one before) of all suffixes of ``least`` or more.

    Suffixes are sorted by their bytes, eight at a time, and end with their string.
    """
    lengths = np.array([len(s) for s in strings], dtype=np.int64)
    width = (int(lengths.max()) + 7) // 8 * 8
    flat = bytearray((len(strings) + 1) * (width + 8))
    for i, s in enumerate(strings):
        flat[i * (width + 8) : i * (width + 8) + len(s)] = s
    counts = lengths - least + 1
    string = np.repeat(np.arange(len(strings)), counts)
    offset = np.arange(len(string)) - np.repeat(np.cumsum(counts) - counts, counts)
    words = np.ndarray((len(flat) - 7,), dtype=">u8", buffer=bytes(flat), strides=(1,))
    place, rest = string * (width + 8) + offset, lengths[string] - offset
    columns = []
    for j in range(0, width, 8):
        own = words[np.minimum(place + j, len(words) - 1)].astype(np.uint64)
        over = np.clip(j + 8 - rest, 0, 8)  # bytes beyond the string's end become zero
        own = np.where(over >= 8, np.uint64(0),
                       own >> (np.minimum(over, 7) * 8).astype(np.uint64)
                       << (np.minimum(over, 7) * 8).astype(np.uint64))
        columns.append(own)
    order = np.lexsort((rest, *columns[::-1]))
    string, offset, rest = string[order], offset[order], rest[order]
    prefix = np.zeros(len(order), dtype=np.int64)
    equal = np.ones(max(len(order) - 1, 0), dtype=bool)
    for own in columns:
        own = own[order]
        apart = own[1:] ^ own[:-1]
        same = np.full(len(apart), 8, dtype=np.int64)
        for b in range(8):
            same = np.minimum(same, np.where(apart >> np.uint64(56 - 8 * b) & np.uint64(255), b, 8))
        prefix[1:] += np.where(equal, same, 0)
        equal &= same == 8
    prefix[1:] = np.minimum(prefix[1:], np.minimum(rest[1:], rest[:-1]))
    return string, offset, prefix


def prefix_intervals(prefix: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(first, last, length) of the nodes of the common-prefix tree of at least ``least``.

    One pass with a stack of open intervals; each closes where the common prefix drops below its
    length.
    """
    stack: list[tuple[int, int]] = []  # (length, first suffix)
    for i in range(1, len(prefix) + 1):
        now = prefix[i] if i < len(prefix) else 0
        begin = i - 1
        while stack and stack[-1][0] > now:
            length, begin = stack.pop()
            yield begin, i - 1, length
        if now >= least and (not stack or stack[-1][0] < now):
            stack.append((now, begin))


def maximal_repeats(
    strings: list[bytes], least: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, strings, offsets) of every maximal repeat of at least ``least`` bytes.

    A node counts if its occurrences are preceded by different bytes, or one of them begins its
    string: what came before that is not known here. Otherwise the node one byte to the left has
    the same occurrences and is longer.
    """
    string, offset, prefix = suffix_array(strings, least)
    before = np.array([strings[s][o - 1] if o else 256 for s, o in zip(
        string.tolist(), offset.tolist())], dtype=np.int64)
    cuts = np.flatnonzero(np.r_[True, prefix[1:] < least])
    sizes = np.diff(np.r_[cuts, len(prefix)])
    spread = np.maximum.reduceat(before, cuts)
    diverse = (spread == 256) | (spread != np.minimum.reduceat(before, cuts))
    for a, n in zip(cuts[(sizes > 1) & diverse].tolist(), sizes[(sizes > 1) & diverse].tolist()):
        for first, last, length in prefix_intervals([0, *prefix[a + 1 : a + n].tolist()], least):
            own = slice(a + first, a + last + 1)
            lead = before[own]
            if lead.max() == 256 or lead.max() != lead.min():
                yield length, string[own], offset[own]


def read_runs(blocks: list[bytes]) -> tuple:
    """Keys, ids, and text, start, anchor and bytes of every run in some blocks."""
    loaded = [_unpack(b) for b in blocks]
    shift = np.cumsum([0] + [len(b[0]) for b in loaded])
    keys, ids = (np.concatenate([b[i] for b in loaded]) for i in (0, 1))
    text = np.concatenate([_from_planes(b[2]).astype(np.int64) + s for b, s in zip(loaded, shift)])
    start = np.concatenate([_from_planes(b[3]).astype(np.int64) for b in loaded])
    anchor = np.concatenate([_from_steps(b[4]) for b in loaded])
    strings = []
    for b in loaded:
        edge = np.r_[0, np.cumsum(b[5], dtype=np.int64)].tolist()
        strings += [b[6][a:e] for a, e in zip(edge, edge[1:])]
    return keys, ids, text, start, anchor, strings


def array_groups(
    anchor: np.ndarray, same: np.ndarray, size: np.ndarray, most: int
) -> Iterator[np.ndarray]:
    """Numbers of the different runs that go into one suffix array together.

    ``same`` is the number of each run's bytes and ``size`` the length of each of these. Equal
    windows name equal anchors, so only different runs of one anchor need to meet. Whole anchors
    share an array up to ``most`` bytes; the runs of a larger one are dealt into shares of half
    that, and every two shares meet in an array.
    """
    pairs = np.unique(np.stack([anchor, same.astype(np.uint64)], axis=1), axis=0)
    many = np.flatnonzero(np.r_[False, pairs[1:, 0] == pairs[:-1, 0]])
    pairs = pairs[np.unique(np.r_[many, many - 1])]
    of, run = pairs[:, 0], pairs[:, 1].astype(np.int64)
    cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, int)
    held: list[np.ndarray] = []
    total = 0
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(of)]):
        own = run[a:b]
        edge = np.cumsum(size[own])
        if total and total + edge[-1] > most:
            yield np.unique(np.concatenate(held))
            held, total = [], 0
        if edge[-1] <= most:
            held.append(own)
            total += int(edge[-1])
            continue
        share = (edge - 1) // (most // 2)
        shares = [own[share == k] for k in np.unique(share)]
        for k, mine in enumerate(shares):
            for other in shares[k + 1 :]:
                yield np.r_[mine, other]
    if held:
        yield np.unique(np.concatenate(held))


def covered_parts(
    strings: list[bytes], low: np.ndarray, least: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, begin, length) of what a string of a smaller ``low`` holds too."""
    edge = np.zeros((len(strings), max(map(len, strings)) + 1), dtype=np.int32)
    for length, string, offset in maximal_repeats(strings, least):
        later = low[string] > low[string].min()
        if later.any():
            np.add.at(edge, (string[later], offset[later]), 1)
            np.add.at(edge, (string[later], offset[later] + length), -1)
    rim = np.diff((np.cumsum(edge, axis=1) > 0).astype(np.int8), axis=1, prepend=0)
    row, begin = np.nonzero(rim == 1)
    return row, begin, np.nonzero(rim == -1)[1] - begin


def repeated_spans(blocks: list[bytes], least: int) -> tuple:
    """Keys and (text, start, length) of the spans that a text of smaller id holds too.

    Runs that are equal as a whole are matched by their bytes; of different runs of an anchor the
    suffix arrays tell what they share.
    """
    keys, ids, text, start, anchor, strings = read_runs(blocks)
    number: dict[bytes, int] = {}
    give = number.setdefault
    same = np.array([give(s, len(number)) for s in strings], dtype=np.int64)
    del strings
    different = list(number)
    del number
    order = np.argsort(same, kind="stable")
    cuts = np.searchsorted(same[order], np.arange(len(different)))
    own = ids[text]
    low = np.minimum.reduceat(own[order], cuts)
    size = np.fromiter(map(len, different), np.int64, len(different))
    whole = np.flatnonzero(own > low[same])
    found = [(text[whole], start[whole], size[same[whole]])]
    # every later run of these bytes is a span already; the smallest ids have only parts
    first = np.flatnonzero(own == low[same])
    first = first[np.argsort(same[first], kind="stable")]
    of_first = same[first]
    for chosen in array_groups(anchor, same, size, ARRAY_BYTES):
        row, begin, length = covered_parts([different[i] for i in chosen], low[chosen], least)
        a = np.searchsorted(of_first, chosen[row])
        n = np.searchsorted(of_first, chosen[row], side="right") - a
        at = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        who = first[at]
        found.append((text[who], start[who] + np.repeat(begin, n), np.repeat(length, n)))
    return keys, *(np.concatenate(x) for x in zip(*found))


def spread_runs(runs: DataFrame) -> DataFrame:
    """Blocks of runs by task; a bucket above ``BUCKET_BYTES`` becomes tasks of two shares each.

    Any two blocks of a bucket meet in some task, which is all that comparing needs.
    """
    sizes = runs.groupBy("part").agg(F.sum("size").alias("total")).select(
        "part", F.greatest(F.ceil(F.col("total") / BUCKET_BYTES), F.lit(1)).cast("int")
        .alias("shares"))
    own = F.pmod(F.xxhash64("block"), F.col("shares")).cast("int")
    return (
        runs.join(sizes, "part").withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
        .select("part", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("k"),
                "block")
    )


def compare(runs: DataFrame, least: int, parts: int) -> DataFrame:
    """Blocks of repeated spans, found by the suffix array of each bucket."""

    def run(table: pa.Table) -> pa.Table:
        release()
        keys, text, start, length = repeated_spans(table.column("block").to_pylist(), least)
        return pa.Table.from_batches(
            [_rows(_spans(keys, text, start, length, parts), BLOCK_NAMES, BLOCK_KINDS)])

    return spread_runs(runs).groupBy("part", "i", "k").applyInArrow(run, BLOCK)


def merged(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans as disjoint runs that do not touch."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate((start + length)[order])
    new = np.flatnonzero(np.r_[True, start[1:] > end[:-1]])
    return start[new], end[np.r_[new[1:] - 1, len(start) - 1]]


def cut_texts(texts: DataFrame, spans: DataFrame, with_text: bool) -> DataFrame:
    """By key of a text with spans: bytes removed, spans, digest, perhaps the kept characters."""
    names = ["key", "n_removed", "n_spans", "kept_sha256", "kept"]
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        release()
        found = _block_texts(left)
        by_text: dict[bytes, list] = {}
        for block in right.column("block").to_pylist():
            few, again, start, length = _unpack(block)
            for i, at in _deal(again.astype(np.int64), len(few)):
                by_text.setdefault(few[i].tobytes(), []).append((start[at], length[at]))
        rows = []
        for key, own in by_text.items():
            begin, end = merged(*(np.concatenate(x) for x in zip(*own)))
            text, at, left_over = found[key], 0, []
            for a, b in zip(begin.tolist(), end.tolist()):
                left_over.append(text[at:a])
                at = b
            kept = b"".join([*left_over, text[at:]])
            whole = kept.decode("utf-8", "ignore").encode() if with_text else None
            rows.append((key, len(text) - len(kept), len(begin), hashlib.sha256(kept).hexdigest(),
                         whole))
        return pa.Table.from_batches([_rows(rows, names, kinds)])

    return texts.groupBy("part").cogroup(spans.groupBy("part")).applyInArrow(
        run, "key binary, n_removed long, n_spans long, kept_sha256 string, kept binary")


def _key(sha: Column | str) -> Column:
    """Key of a text: the first 16 bytes of its digest, given in hexadecimal."""
    return F.unhex(F.substring(sha, 1, 32))


def _found(df: DataFrame, least: int, id_column: str, text_column: str) -> tuple:
    """Narrow rows, first ids of the texts, texts, number of parts and blocks with spans."""
    if not isinstance(df.schema[id_column].dataType, T.IntegralType):
        raise ValueError("ids must be integers: the smaller id keeps its text")
    if least < 16:
        raise ValueError("repeats shorter than 16 bytes are not searched")
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit("")).cast("binary")
    narrow = cut_lineage(df.select(
        F.col(f"`{id_column}`").cast("long").alias("_id"), F.sha2(text, 256).alias("_sha"),
        F.octet_length(text).cast("long").alias("n_bytes")))
    total = narrow.agg(F.sum("n_bytes")).first()[0] or 0
    parallel = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(min(parallel, total // (1 << 18) + 1), -(-total // BLOCK_BYTES))
    first = narrow.groupBy("_sha").agg(F.min("_id").alias("id"), F.first("n_bytes").alias("n"))
    texts = df.select(text.alias("_text")).where(F.octet_length("_text") >= least)
    bits = min(64, max(40, total.bit_length() + 12))
    low = F.unhex(F.regexp_replace(F.substring("_sha", 1, 16), "(..)(..)(..)(..)(..)(..)(..)(..)",
                                   "$8$7$6$5$4$3$2$1"))
    # home of a text: its key's first eight bytes, little-endian and unsigned, modulo the parts
    home = F.expr("CAST(CAST(conv(hex(_low), 16, 10) AS DECIMAL(20, 0)) % "
                  f"CAST({parts} AS DECIMAL(20, 0)) AS LONG)")
    known = first.where(F.col("n") >= least).withColumn("_low", low).select(
        home.alias("part"), F.lit(None).cast("binary").alias("block"), _key("_sha").alias("key"), "id")
    shared = answer(ask(texts, least, parts, bits), parts).select("part", "block")
    notes = shared.select(
        "part", "block", F.lit(None).cast("binary").alias("key"),
        F.lit(None).cast("long").alias("id")).unionByName(known)
    blocks = text_blocks(texts, parts)
    runs = cut_lineage(collect_runs(blocks, notes, least, parts, bits))
    if total >= FREED_BYTES:
        free_disk(df.sparkSession)  # marks and texts were shuffled for the runs only
    spans = cut_lineage(runs.where(F.col("kind") == SPANS).select("part", "block").unionByName(
        compare(runs.where(F.col("kind") == RUNS), least, parts).select("part", "block")))
    del runs
    if total >= FREED_BYTES:
        free_disk(df.sparkSession)  # the spans are all that is left of the runs
    return narrow, first, blocks, spans


def remove_repeats(
    df: DataFrame, least: int = 50, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Remove each byte covered by a ``least``-byte string that a smaller id holds too.

    One row per input row: id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256.
    Strings are judged on the input, and matches never cross texts. Equal texts are one text with
    the smallest of their ids: the row of that id (or rows, if it repeats) keeps what no smaller
    id has, later rows lose everything if they are long enough. Rows of equal id and different
    text do not take from each other. A null id is later than any other, and null ids do not take
    from each other; a null text is empty. An empty table gives no rows. Other columns are not
    read. A task holds a few texts at a time, whole, and hashes them 64 KB at a time; a
    longer text is hashed in overlapping parts.
    """
    narrow, first, blocks, spans = _found(df, least, id_column, text_column)
    cut = cut_texts(blocks, spans, False).drop("kept")
    owners = first.select("_sha", F.col("id").alias("_first"), _key("_sha").alias("key"))
    rows = narrow.join(owners.join(cut, "key", "left").drop("key"), "_sha")
    later = ~F.col("_id").eqNullSafe(F.col("_first")) & (F.col("n_bytes") >= least)
    removed = F.when(later, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0)))
    runs = F.when(later, 1).otherwise(F.coalesce("n_spans", F.lit(0)))
    nothing = hashlib.sha256(b"").hexdigest()
    return rows.select(
        F.col("_id").alias(id_column), "n_bytes", removed.cast("long").alias("n_removed"),
        runs.cast("long").alias("n_spans"),
        F.when(later, nothing).otherwise(F.coalesce("kept_sha256", "_sha")).alias("kept_sha256"))


def without_repeats(
    df: DataFrame, least: int = 50, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``df`` with the kept bytes as its text, by the rules of :func:`remove_repeats`.

    All rows and columns stay; a character of which a part was removed goes with it. A null text
    stays null, a text that is wholly repeated becomes empty.
    """
    _, first, blocks, spans = _found(df, least, id_column, text_column)
    cut = cut_texts(blocks, spans, True).select("key", F.col("kept").cast("string").alias("_kept"))
    owners = first.select(_key("_sha").alias("key"), F.col("id").alias("_first"))
    text = F.col(f"`{text_column}`")
    names = {c: f"_c{i}" for i, c in enumerate(df.columns)}  # whatever the columns are called
    keyed = df.select(
        *[F.col(f"`{c}`").alias(n) for c, n in names.items()],
        _key(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)).alias("key"))
    own_id, own = F.col(names[id_column]), F.col(names[text_column])
    later = ~own_id.eqNullSafe(F.col("_first")) & (F.octet_length(own) >= least)
    joined = keyed.join(owners, "key").join(cut, "key", "left")
    return joined.select(*[
        F.when(later, F.lit("")).otherwise(F.coalesce("_kept", own)).alias(c)
        if c == text_column else F.col(n).alias(c) for c, n in names.items()])
