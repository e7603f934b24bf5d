"""Tokens of two tokenizers aligned: groups between shared cuts, links and their document counts."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from tokenizers import Tokenizer

from tablewright.core import ensure_checkpoint_dir
from tablewright.llm.common import SLICE_BYTES, slices, text_bytes
from tablewright.llm.tokens import UNSETTLED, byte_alphabet, encoder
from tablewright.operators.lookup import attach, build_lookup

#: Code points after which a text is cut at the next blank that both tokenizers must cut at.
SEGMENT = 1 << 17
#: Links of a group that are written out one by one; larger groups go by their distinct ids.
SMALL_GROUP = 64
#: Links held at a time.
LINKS_AT_ONCE = 1 << 21


class Tokenizers:
    """A byte-level tokenizer (A) and a piece model (B) that both read a blank before the text."""

    def __init__(self, path_a: str, path_b: str):
        known = encoder(path_a)
        if not known.byte_level:
            raise ValueError("the first tokenizer must be a byte-level one")
        self.fast = known.fast
        self.library = Tokenizer.from_file(path_a)
        self.library.encode_special_tokens = True  # their strings are plain text
        with open(path_a, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        alphabet = byte_alphabet()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            if all(c in alphabet for c in token):
                self.bytes_a[i] = bytes(alphabet[c] for c in token)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(names)
        ]
        #: No piece goes on over a blank, so a blank between two other characters begins a piece.
        self.cuttable = not any("▁" in p.lstrip("▁") for p in names)
        self.length_a = np.array([len(x) for x in self.bytes_a], dtype=np.int64)
        self.length_b = np.array([len(x) for x in self.bytes_b], dtype=np.int64)
        digits = [str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        #: Decimal ids with what may follow them: id * 4 + 0..3 for , | ; and nothing.
        self.printed = [(d + end).encode() for d in digits for end in (",", "|", ";", "")]

    def segments(self, text: str, most: int) -> list[str]:
        """Parts that can be encoded alone, each with a blank put before it.

        Neither tokenizer joins a single blank to what stands before it, if that is no white
        space; so cutting there and leaving out the blank changes no token.
        """
        found, start = [], 0
        while self.cuttable and len(text) - start > most:
            at = text.find(" ", start + most)
            while 0 <= at and (at + 1 == len(text) or text[at - 1].isspace()
                               or text[at + 1].isspace()):
                at = text.find(" ", at + 1)
            if at < 0:
                break
            found.append(text[start:at])
            start = at + 1
        return [*found, text[start:]]

    def ids_a(self, text: str) -> np.ndarray:
        if self.fast is not None and (text.isascii() or not UNSETTLED.search(text)):
            return self.fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=())
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def encode(self, text: str, most: int) -> tuple[list[np.ndarray], list[list[int]]] | None:
        """Ids of both sides by segments; None where either does not spell the blank and text."""
        sides_a, sides_b = [], []
        for part in self.segments(text, most) if text else []:
            a, b = self.ids_a(" " + part), self.pieces.encode(part)
            raw = (" " + part).encode()
            if (b"".join([self.bytes_b[i] for i in b]) != raw
                    or b"".join([self.bytes_a[i] for i in a.tolist()]) != raw):
                return None
            sides_a.append(a)
            sides_b.append(b)
        return sides_a, sides_b


@lru_cache(maxsize=2)
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    """Loaded once in each Python worker."""
    return Tokenizers(path_a, path_b)


def _ranges(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers start[i] .. start[i] + count[i] - 1 in order, and the i of each."""
    owner = np.repeat(np.arange(len(count)), count)
    first = np.cumsum(count) - count
    return np.arange(len(owner)) - first[owner] + start[owner], owner


def shared_cuts(end_a: np.ndarray, end_b: np.ndarray, low: np.ndarray,
                high: np.ndarray) -> np.ndarray:
    """Mask of the A tokens after which a group ends; ``low``/``high`` bound each text's tokens.

    Divide and conquer over intervals of A tokens, all open intervals of a level at a time. In
    each one the end of the middle A token is looked up among the B ends by bisection; if it is
    no B end, ends farther out are tried in windows that grow until one is shared. The interval
    is divided there. An interval without a shared end inside is a group.
    """
    def is_shared(tried: np.ndarray) -> np.ndarray:
        ends = end_a[tried]
        return end_b[np.searchsorted(end_b, ends)] == ends

    cut = np.zeros(len(end_a), dtype=bool)
    full = high > low
    low, high = low[full], high[full]
    cut[high - 1] = True
    while True:
        wide = high - low > 1
        low, high = low[wide], high[wide]
        if not len(low):
            return cut
        at = (low + high) // 2 - 1
        found = np.where(is_shared(at), at, -1)
        waiting, reach = np.flatnonzero((found < 0) & (high - low > 2)), 1
        while len(waiting):
            left = np.maximum(low[waiting], at[waiting] - reach)
            right = np.minimum(high[waiting] - 2, at[waiting] + reach)
            tried, owner = _ranges(left, right - left + 1)
            shared = is_shared(tried)
            tried, owner = tried[shared], owner[shared]
            order = np.lexsort((np.abs(tried - at[waiting[owner]]), owner))
            first = order[np.r_[True, np.diff(owner[order]) > 0]] if len(order) else order
            found[waiting[owner[first]]] = tried[first]
            more = (found[waiting] < 0) & (
                (left > low[waiting]) | (right < high[waiting] - 2))
            waiting, reach = waiting[more], reach * 4
        hit = found >= 0
        cut[found[hit]] = True
        low, high = (np.r_[low[hit], found[hit] + 1], np.r_[found[hit] + 1, high[hit]])


class Aligned:
    """The groups of a run of texts: token ids of both sides and where each group ends in them."""

    def __init__(self, both: Tokenizers, texts: list[str], most: int):
        ids_a, ids_b, count_a, count_b = [], [], [], []
        for text in texts:
            encoded = both.encode(text, most) or ([], [])
            ids_a += encoded[0]
            ids_b += [np.array(x, dtype=np.int64) for x in encoded[1]]
            count_a.append(sum(map(len, encoded[0])))
            count_b.append(sum(map(len, encoded[1])))
        self.a = np.concatenate([*ids_a, np.zeros(0, np.int64)]).astype(np.int64)
        self.b = np.concatenate([*ids_b, np.zeros(0, np.int64)]).astype(np.int64)
        self.count_a, self.count_b = np.array(count_a), np.array(count_b)
        stop_a = np.cumsum(self.count_a)
        end_a = np.cumsum(both.length_a[self.a])
        end_b = np.cumsum(both.length_b[self.b])
        cut = shared_cuts(end_a, end_b, stop_a - self.count_a, stop_a)
        last = np.flatnonzero(cut)
        self.stop_a = last + 1
        self.stop_b = np.searchsorted(end_b, end_a[last]) + 1 if len(last) else last
        self.start_a = np.r_[0, self.stop_a[:-1]].astype(np.int64)[: len(last)]
        self.start_b = np.r_[0, self.stop_b[:-1]].astype(np.int64)[: len(last)]
        self.size_a, self.size_b = self.stop_a - self.start_a, self.stop_b - self.start_b
        self.text = np.searchsorted(stop_a, last, side="right")
        self.n_groups = np.bincount(self.text, minlength=len(texts))
        links = np.zeros(len(texts), np.int64)
        np.add.at(links, self.text, self.size_a * self.size_b)
        self.n_links = links

    def digests(self, both: Tokenizers) -> list[str]:
        """SHA-256 of `a,a|b;a|b,b` for each text; the empty string without tokens."""
        code = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        follow_a = np.zeros(len(self.a), np.int64)
        follow_a[self.stop_a - 1] = 1
        follow_b = np.zeros(len(self.b), np.int64)
        follow_b[self.stop_b - 1] = 2
        filled = self.count_b > 0
        follow_b[np.cumsum(self.count_b)[filled] - 1] = 3
        code[np.arange(len(self.a)) + np.repeat(self.start_b, self.size_a)] = 4 * self.a + follow_a
        code[np.arange(len(self.b)) + np.repeat(self.stop_a, self.size_b)] = 4 * self.b + follow_b
        stops = np.cumsum(self.count_a + self.count_b).tolist()
        found, start, printed = [], 0, both.printed
        for stop in stops:
            joined = b"".join([printed[i] for i in code[start:stop].tolist()])
            found.append(hashlib.sha256(joined).hexdigest() if stop > start else "")
            start = stop
        return found

    def _small(self, chosen: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, a, b, 1) of every link of the chosen groups."""
        k, owner = _ranges(np.zeros(len(chosen), np.int64),
                           (self.size_a * self.size_b)[chosen])
        group = chosen[owner]
        a = self.a[self.start_a[group] + k // self.size_b[group]]
        b = self.b[self.start_b[group] + k % self.size_b[group]]
        return self.text[group], a, b, np.ones(len(group), np.int64)

    def _large(self, group: int) -> Iterator[tuple[np.ndarray, ...]]:
        """The same of one large group, by its distinct ids and how often they occur."""
        a, times_a = np.unique(self.a[self.start_a[group] : self.stop_a[group]], return_counts=True)
        b, times_b = np.unique(self.b[self.start_b[group] : self.stop_b[group]], return_counts=True)
        rows = max(1, LINKS_AT_ONCE // len(b))
        for i in range(0, len(a), rows):
            part = slice(i, i + rows)
            n = len(a[part]) * len(b)
            yield (np.full(n, self.text[group]), np.repeat(a[part], len(b)),
                   np.tile(b, len(a[part])), np.outer(times_a[part], times_b).ravel())

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, a << 32 | b, links) of each distinct id pair of a text, sorted."""
        size = self.size_a * self.size_b
        small = np.flatnonzero(size <= SMALL_GROUP)
        parts = [self._small(small)] if len(small) else []
        held = sum(len(p[0]) for p in parts)
        for group in np.flatnonzero(size > SMALL_GROUP):
            for part in self._large(group):
                parts.append(part)
                held += len(part[0])
                if held > 2 * LINKS_AT_ONCE:
                    parts = [_added(parts)]
                    held = len(parts[0][0])
        text, a, b, times = _added(parts)
        return text, a << 32 | b, times


def _added(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Rows (text, a, b, times) with equal ones added up, in order."""
    if not parts:
        return (np.zeros(0, np.int64),) * 4
    text, a, b, times = (np.concatenate([p[i] for p in parts]) for i in range(4))
    pair = a << 32 | b
    order = np.lexsort((pair, text))
    text, pair, times = text[order], pair[order], times[order]
    new = np.flatnonzero(np.r_[True, (np.diff(text) != 0) | (np.diff(pair) != 0)])[: len(text)]
    return (text[new], pair[new] >> 32, pair[new] & 0xFFFFFFFF,
            np.add.reduceat(times, new) if len(new) else times)


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = pa.array(np.r_[0, np.cumsum(counts)], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(values, type=kind))


_IDS, _LONGS = T.ArrayType(T.IntegerType()), T.ArrayType(T.LongType())
ALIGNED = T.StructType([
    T.StructField(n, _IDS) for n in ("a_ids", "b_ids", "a_stops", "b_stops")])
LINKED = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")]
    + [T.StructField("groups_sha256", T.StringType())]
    + [T.StructField(n, _LONGS) for n in ("pairs", "times")])


def _each(df: DataFrame, paths: tuple[str, str], text_column: str, keep: list[str],
          prefix: str, outputs: T.StructType, most: int, compute) -> DataFrame:
    """Append ``compute`` of the alignment of each run of texts; one batch out for each run."""
    source = df.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(keep)],
                       F.col(f"`{text_column}`").alias("_text"))
    schema = T.StructType(source.schema.fields[:-1] + [
        T.StructField(prefix + f.name, f.dataType) for f in outputs])
    types = [f.type for f in to_arrow_schema(outputs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(*paths)
        for batch in batches:
            sizes = [len(x) for x in text_bytes(batch.column(len(keep)))]
            for part in slices(sizes, SLICE_BYTES):
                rows = batch.slice(part.start, part.stop - part.start)
                texts = [x.decode("utf-8", "replace") for x in text_bytes(rows.column(len(keep)))]
                found = compute(both, Aligned(both, texts, most), len(texts))
                arrays = [rows.column(i) for i in range(len(keep))]
                arrays += [x if isinstance(x, pa.Array) else pa.array(x, type=t)
                           for x, t in zip(found, types)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    mapped = source.mapInArrow(run, schema)
    return mapped.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(keep)],
                         *mapped.columns[len(keep):])


def align(
    df: DataFrame, path_a: str, path_b: str, text_column: str = "text",
    keep: list[str] | None = None, prefix: str = "", segment: int = SEGMENT,
) -> DataFrame:
    """Token ids of each whole text by both tokenizers and the ends of their common groups.

    ``path_a`` is a byte-level `.json` file of `tokenizers`, which reads a blank and the text;
    ``path_b`` a `.model` file of `sentencepiece`, which adds that blank itself. Special tokens
    are plain text. A group ends at each byte where tokens of both sides end; group i holds the
    ids up to a_stops[i] and b_stops[i]. Null and empty texts and those that either side does not
    spell exactly have empty lists. Rows keep the columns in ``keep`` (default: all others), of
    any names; repeated rows are treated alike. Texts longer than ``segment`` code points are
    encoded in segments between blanks at which both tokenizers are bound to cut. An empty table
    gives no rows.
    """
    keep = [c for c in df.columns if c != text_column] if keep is None else list(keep)

    def compute(both, found, n):
        text_a = np.r_[0, np.cumsum(found.count_a)][:-1]
        text_b = np.r_[0, np.cumsum(found.count_b)][:-1]
        return [_lists(found.a, found.count_a, pa.int32()), _lists(found.b, found.count_b, pa.int32()),
                _lists(found.stop_a - text_a[found.text], found.n_groups, pa.int32()),
                _lists(found.stop_b - text_b[found.text], found.n_groups, pa.int32())]

    return _each(df, (path_a, path_b), text_column, keep, prefix, ALIGNED, segment, compute)


def link_report(
    df: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text",
    segment: int = SEGMENT,
) -> DataFrame:
    """Counts of tokens, groups and links of each text, and how common its links are.

    Links are all pairs of an A and a B token of one group; the count of an id pair is the number
    of rows that hold it linked. Returns id, n_a, n_b, n_groups, n_links, n_best (links whose
    count is the highest of their A id), count_sum (sum of the counts of the links) and
    groups_sha256; rows without tokens have zeros and the empty string. Rules for texts are those
    of :func:`align`; null and repeated ids pass through, every row counts as a document.

    The texts are encoded once. The distinct pairs of each row are written to the checkpoint
    folder, counted, and joined with the counts: by broadcast if these are measured to be few,
    otherwise shuffled with the frequent pairs spread. A group of many tokens is counted by its
    distinct ids, so its links are never written out one by one.
    """
    def compute(both, found, n):
        text, pair, times = found.pairs()
        counts = np.bincount(text, minlength=n)
        return [found.count_a, found.count_b, found.n_groups, found.n_links, found.digests(both),
                _lists(pair, counts, pa.int64()), _lists(times, counts, pa.int64())]

    folder = f"{ensure_checkpoint_dir(df.sparkSession)}/alignment-{uuid.uuid4().hex}"
    linked = _each(df.select(F.col(f"`{id_column}`").alias("_id"),
                             F.col(f"`{text_column}`").alias("_text")),
                   (path_a, path_b), "_text", ["_id"], "", LINKED, segment, compute)
    linked.withColumn("_row", F.monotonically_increasing_id()).write.parquet(folder)
    stored = df.sparkSession.read.parquet(folder)

    counts = stored.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(
        F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("a", F.shiftright("pair", 32))
    highest = counts.groupBy("a").agg(F.max("n").alias("top"))
    judged = counts.join(highest, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    lookup = build_lookup(judged, ["pair"], weight="n")
    links = stored.select("_row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed(
        "pairs", "pair")
    sums = attach(links, lookup, ["pair"]).groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return stored.drop("pairs", "times").join(sums, "_row", "left").select(
        F.col("_id").alias(id_column), "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256")
