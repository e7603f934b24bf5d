"""Spelling variants: words one edit away from a much more frequent word, by FM-index searches."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.core import cut_lineage
from tablewright.llm.common import text_bytes
from tablewright.llm.fm_index import WordIndex, one_error
from tablewright.operators.lookup import attach, build_lookup

RUN = re.compile("[a-zÀ-ÿ]+")
#: Runs whose hash this number divides lose a character.
DAMAGE = 97
#: Code points of a text that are searched for runs at a time.
WINDOW = 1 << 20
#: Words a task counts before it hands them on.
HELD_WORDS = 100_000
#: Symbols of the words that one index holds, and queries that one index answers.
BLOCK_SYMBOLS, BLOCK_QUERIES = 1 << 18, 1 << 16


def runs_of(text: str, window: int = WINDOW) -> Counter:
    """How often each maximal run occurs in a text whose A-Z are lower case already."""
    counts: Counter = Counter()
    start = 0
    while start < len(text):
        stop = start + window
        while stop < len(text) and RUN.match(text[stop]):
            stop += 1
        counts.update(RUN.findall(text, start, stop))
        start = stop
    return counts


def damaged(doc: bytes, counts: Counter, least_chars: int) -> Iterator[tuple[str, int]]:
    """(word, occurrences) of a document: some runs lose the character that their hash names."""
    begin = zlib.crc32(doc + b":")
    for run, n in counts.items():
        if len(run) >= least_chars:
            h = zlib.crc32(run.encode(), begin)
            if h % DAMAGE == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < least_chars:
                    continue
            yield run, n


def word_counts(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_chars: int = 5,
    least_count: int = 3,
) -> DataFrame:
    """(word, n) over all texts: runs of letters, A-Z in lower case, some of them damaged.

    A run of which the hash of `id:run` is a multiple of 97 loses one character. Words of fewer
    than ``least_chars`` code points or with fewer than ``least_count`` occurrences are left out.
    A null text has no runs, a null id is the empty string; rows of equal id count like any other.
    Each task adds its counts up before the shuffle, and very long texts are read in windows.
    """
    source = df.select(
        F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("")).alias("_id"),
        F.col(f"`{text_column}`").alias("_text"))
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])

    def batch_of(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())],
            names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for doc, raw in zip(text_bytes(batch.column(0)), text_bytes(batch.column(1))):
                text = raw.lower().decode("utf-8", "replace")  # of bytes: A-Z alone
                for word, n in damaged(doc, runs_of(text), least_chars):
                    total[word] += n
                if len(total) > HELD_WORDS:
                    yield batch_of(total)
                    total = Counter()
        yield batch_of(total)

    counted = source.mapInArrow(run, schema).groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least_count)


#: What a row of a block is: a word of the index, a query whose first half is exact, or one whose
#: second half is.
INDEXED, FIRST_EXACT, SECOND_EXACT = 0, 1, 2


def _routed(words: DataFrame) -> DataFrame:
    """(key, role, word, n): each query goes to the key of its exact half, twice in all, and each
    word of the index to the halves of all queries that are one longer, as long or one shorter."""
    size = F.length("word")

    def head(n):
        return F.concat(F.lit("a"), F.substring(F.col("word"), F.lit(1), n))

    def tail(n):
        return F.concat(F.lit("z"), F.substring(F.col("word"), size - n + 1, n))

    half = F.floor(size / 2).cast("int")

    def row(key, role):
        return F.struct(F.xxhash64(key).alias("key"), F.lit(role).alias("role"))

    low, high = F.floor((size - 1) / 2).cast("int"), F.floor((size + 1) / 2).cast("int")
    rows = F.array(
        row(head(low), INDEXED), row(head(high), INDEXED), row(tail(half), INDEXED),
        row(tail(F.least(half + 1, size)), INDEXED), row(head(half), FIRST_EXACT),
        row(tail(size - half), SECOND_EXACT))
    return words.select("word", "n", F.inline(F.array_distinct(rows)))


def _blocks(words: DataFrame, block_symbols: int, block_queries: int) -> DataFrame:
    """Routed rows with the block they belong to (g1, g2, g3).

    Keys share blocks by hash. A key of more symbols or queries than a block may hold is dealt
    into shares of both, and every share of the words meets every share of the queries in a block
    of its own.
    """
    rows = _routed(words)
    weight = F.when(F.col("role") == INDEXED, F.length("word") + 1)
    sizes = rows.groupBy("key").agg(
        F.sum(weight).alias("symbols"), F.count(F.when(F.col("role") != INDEXED, 1)).alias("asked"),
        F.count(F.lit(1)).alias("weight"))
    sizes = cut_lineage(sizes)
    total = sizes.agg(F.sum("symbols")).first()[0] or 0
    buckets = -(-total // block_symbols) + 1
    crowded = sizes.where(
        (F.col("symbols") > block_symbols) | (F.col("asked") > block_queries)
    ).select(
        "key", "weight",
        F.greatest(F.ceil(F.col("symbols") / block_symbols), F.lit(1)).cast("int").alias("shares"),
        F.greatest(F.ceil(F.col("asked") / block_queries), F.lit(1)).cast("int").alias("turns"))
    dealt = attach(rows, build_lookup(crowded, ["key"], weight="weight"), ["key"])
    split = F.col("shares").isNotNull()
    shares, turns = F.coalesce("shares", F.lit(1)), F.coalesce("turns", F.lit(1))
    is_index = F.col("role") == INDEXED
    one = F.array(F.pmod(F.xxhash64("word"), F.when(is_index, shares).otherwise(turns)).cast("int"))
    every = F.sequence(F.lit(0), F.when(is_index, turns).otherwise(shares) - 1)
    placed = dealt.select(
        F.when(split, F.col("key")).otherwise(F.pmod("key", F.lit(buckets))).alias("g1"),
        split.alias("_split"), "role", "word", "n",
        F.explode(F.when(is_index, one).otherwise(every)).alias("_i"),
        F.when(is_index, every).otherwise(one).alias("_j"))
    placed = placed.select("g1", "_split", "role", "word", "n", "_i", F.explode("_j").alias("_j"))
    return placed.select(
        "g1", F.when(F.col("_split"), F.col("_i")).otherwise(-1).alias("g2"),
        F.when(F.col("_split"), F.col("_j")).otherwise(-1).alias("g3"), "role", "word", "n")


def _matches(table: pa.Table) -> tuple[list[str], np.ndarray, Iterator]:
    """Index words of a block, their counts, and (queries, query numbers, word numbers) by search."""
    role = table.column("role").to_numpy()
    words, n = table.column("word").to_pylist(), table.column("n").to_numpy()
    held = {words[i]: n[i] for i in np.flatnonzero(role == INDEXED)}
    indexed = sorted(held)
    counts = np.array([held[w] for w in indexed], np.int64)

    def searches():
        if not indexed:
            return
        index = WordIndex(indexed)
        for kind in (FIRST_EXACT, SECOND_EXACT):
            queries = sorted({words[i] for i in np.flatnonzero(role == kind)})
            if queries:
                yield queries, *one_error(index, queries, kind == FIRST_EXACT)

    return indexed, counts, searches()


def near_pairs(
    words: DataFrame, block_symbols: int = BLOCK_SYMBOLS, block_queries: int = BLOCK_QUERIES
) -> DataFrame:
    """(word, near) for all ordered pairs one edit apart of a (word, n) table of distinct words."""
    def run(table: pa.Table) -> pa.Table:
        indexed, _, searches = _matches(table)
        word, near = [], []
        for queries, q, w in searches:
            word += [queries[i] for i in q]
            near += [indexed[i] for i in w]
        return pa.table({"word": pa.array(word, pa.string()), "near": pa.array(near, pa.string())})

    return _blocks(words, block_symbols, block_queries).groupBy("g1", "g2", "g3").applyInArrow(
        run, "word string, near string")


def near_summary(
    words: DataFrame, block_symbols: int = BLOCK_SYMBOLS, block_queries: int = BLOCK_QUERIES
) -> DataFrame:
    """(word, n_near, best, best_n): number of near words, and the most frequent of them.

    The pairs of a block are added up where they are found; no pair is shuffled.
    """
    def run(table: pa.Table) -> pa.Table:
        indexed, counts, searches = _matches(table)
        word, n_near, best, best_n = [], [], [], []
        for queries, q, w in searches:
            order = np.lexsort((w, -counts[w], q))
            q, w = q[order], w[order]
            first = np.flatnonzero(np.r_[True, np.diff(q) > 0])[: len(q)]
            word += [queries[i] for i in q[first]]
            n_near += np.diff(np.r_[first, len(q)]).tolist()
            best += [indexed[i] for i in w[first]]
            best_n += counts[w[first]].tolist()
        return pa.table({
            "word": pa.array(word, pa.string()), "n_near": pa.array(n_near, pa.int64()),
            "best": pa.array(best, pa.string()), "best_n": pa.array(best_n, pa.int64())})

    found = _blocks(words, block_symbols, block_queries).groupBy("g1", "g2", "g3").applyInArrow(
        run, "word string, n_near long, best string, best_n long")
    merged = found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"),
        F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("top"))
    return merged.select(
        "word", "n_near", F.col("top.best").alias("best"), (-F.col("top.less")).alias("best_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a table (word, form, ...): forms followed to the last one.

    Every pass doubles the length of the way that is known. A form is at least twice as frequent
    as its word, so a way is no longer than the logarithm of the largest count, and the passes
    are few.
    """
    ways = cut_lineage(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        ahead = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = cut_lineage(ways.join(ahead, "root", "left"))
        moved = joined.where("next IS NOT NULL").limit(1).count()
        ways = joined.select("word", F.coalesce("next", "root").alias("root"))
        if not moved:
            return ways


def spelling_variants(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_chars: int = 5,
    least_count: int = 3, factor: int = 2, block_symbols: int = BLOCK_SYMBOLS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """Words of the texts with the more frequent spelling that each seems to be a variant of.

    Words are those of :func:`word_counts`. Two words are near if one insertion, deletion or
    replacement of a code point parts them. Returns word, n, n_near, form (the near word of
    largest n, the first in code-point order among equals, if it has ``factor`` times the word's n
    or more, else null), form_n and root (the last of the forms that follow from the word, or the
    word). Texts without words, or no texts, give no rows; null texts and ids, repeated rows and
    other columns are treated as there.

    Words are dealt by halves: a word and its near word share the first or the second half of
    either, so a query and all that it can match in one search meet in a block. A block's words
    form a bidirectional FM-index; each query matches one half exactly and goes on across the
    other with one error. Halves that very many words share are split into blocks of words and of
    queries. Very long words are allowed; a search takes a step for each of their characters.
    """
    words = cut_lineage(word_counts(df, id_column, text_column, least_chars, least_count))
    summary = near_summary(words, block_symbols, block_queries)
    is_form = F.col("best_n") >= factor * F.col("n")
    forms = cut_lineage(words.join(summary, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")))
    roots = _roots(forms)
    return forms.join(roots, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
