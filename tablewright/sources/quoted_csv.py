"""CSV with line breaks inside quotes, read by many tasks.

A byte range may begin inside a quoted field. One scan learns for every range in which state it
ends, from either state it may begin in; running through the ranges of a file then gives the true
state at each border. A second scan puts lines together to records from there. Only a record that
crosses a border is joined from pieces, at most one per range.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.core import col

#: The rest of a quoted field, up to the quote that ends it.
CLOSING = re.compile(r'(?:[^"]|"")*+"(?!")')

#: Types in the order in which they are tried, with the pattern of texts that may be of it.
KINDS = (
    ("int", r"[+-]?\d{1,10}"), ("bigint", r"[+-]?\d{1,19}"),
    ("double", r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|NaN|-?Inf(inity)?"),
    ("date", r"\d{4}-\d{2}-\d{2}"),
    ("timestamp", r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})?"),
    ("boolean", r"(?i)true|false"),
)


def advance(line: str, inside: bool, opening: re.Pattern) -> bool:
    """Whether the line ends inside a quoted field; ``opening`` finds a quote that begins a field."""
    at = 0
    while True:
        if inside:
            closed = CLOSING.match(line, at)
            if closed is None:
                return True
            at = closed.end()
        opened = opening.search(line, at)
        if opened is None:
            return False
        at, inside = opened.end(), True


def opening_of(separator: str) -> re.Pattern:
    return re.compile(f'(?:^|{re.escape(separator)})"')


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """Lines with the file and the first byte of the range that they were read from, in order."""
    value = F.col("value")  # the text source hands on the bytes as they are
    if encoding.upper() not in ("UTF-8", "UTF8"):
        value = F.decode(value.cast("binary"), encoding)
    return spark.read.option("lineSep", "\n").text(path).select(
        value.alias("value"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"))


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[str]]]:
    """(file, block, lines) of stretches of lines; a range may come in several of them."""
    for batch in batches:
        value, file, block = (batch.column(i).to_pylist() for i in range(3))
        start = 0
        for i in range(1, len(value) + 1):
            if i == len(value) or block[i] != block[start] or file[i] != file[start]:
                yield file[start], block[start], value[start:i]
                start = i


def range_states(spark: SparkSession, path: str, separator: str, encoding: str) -> DataFrame:
    """(file, block, inside): whether each range begins inside a quoted field; a row per range."""
    opening = opening_of(separator)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: dict[tuple[str, int], list[bool]] = {}
        for file, block, lines in _by_range(batches):
            state = ends.setdefault((file, block), [False, True])
            for line in lines:
                if '"' in line:
                    both = advance(line, state[0], opening), advance(line, state[1], opening)
                    state[:] = both
        yield pa.RecordBatch.from_arrays([
            pa.array([k[0] for k in ends], pa.string()), pa.array([k[1] for k in ends], pa.int64()),
            pa.array([s[0] for s in ends.values()], pa.bool_()),
            pa.array([s[1] for s in ends.values()], pa.bool_()),
        ], names=["file", "block", "from_out", "from_in"])

    ends = _lines(spark, path, encoding).mapInArrow(
        run, "file string, block long, from_out boolean, from_in boolean")
    # the last range before this one that ends alike from both states settles the state; ranges
    # after it keep the state or turn it over
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    turns = (F.col("from_out") & ~F.col("from_in")).cast("int")
    marked = ends.withColumn("turned", F.coalesce(F.sum(turns).over(before), F.lit(0)))
    alike = F.when(F.col("from_out") == F.col("from_in"), F.struct("block", "from_out", "turned"))
    marked = marked.withColumn("settled", F.max(alike).over(before))
    odd = (F.col("turned") - F.coalesce("settled.turned", F.lit(0))) % 2 == 1
    return marked.select(
        "file", "block", (F.coalesce("settled.from_out", F.lit(False)) != odd).alias("inside"))


HEAD, WHOLE, TAIL, THROUGH = range(4)


def records(spark: SparkSession, path: str, separator: str, encoding: str) -> DataFrame:
    """(file, first, record): the records of all files; ``first`` marks the first of a file.

    The states of all ranges go to every task: one entry per range that begins inside a field.
    """
    opening = opening_of(separator)
    begins = {(r["file"], r["block"]) for r in
              range_states(spark, path, separator, encoding).where("inside").collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        key, kind, inside, first = None, WHOLE, False, False
        out: list[tuple] = []

        def put(k: int) -> None:
            nonlocal first
            out.append((*key, k, first and k in (WHOLE, TAIL), "\n".join(held)))
            first = first and k not in (WHOLE, TAIL)
            held.clear()

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
            made = pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)],
                names=["file", "block", "kind", "first", "record"])
            out.clear()
            return made

        def finish() -> None:
            if held or (key and kind == HEAD):
                put(THROUGH if kind == HEAD else TAIL)

        for file, block, lines in _by_range(batches):
            if (file, block) != key:
                finish()
                key, inside, first = (file, block), (file, block) in begins, block == 0
                kind = HEAD if inside else WHOLE
            for line in lines:
                held.append(line)
                if '"' in line:
                    inside = advance(line, inside, opening)
                if not inside:
                    put(kind)
                    kind = WHOLE
            if len(out) >= 5_000:
                yield flush()
        finish()
        yield flush()

    made = _lines(spark, path, encoding).mapInArrow(
        run, "file string, block long, kind int, first boolean, record string")
    whole = made.where(F.col("kind") == WHOLE).select("file", "first", "record")
    # the pieces of a record lie in ranges that follow each other; its first piece is a tail
    pieces = made.where(F.col("kind") != WHOLE)
    order = Window.partitionBy("file").orderBy("block", "kind")
    pieces = pieces.withColumn("number", F.sum(F.when(F.col("kind") == TAIL, 1).otherwise(0)).over(
        order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = pieces.groupBy("file", "number").agg(
        F.max("first").alias("first"),
        F.array_sort(F.collect_list(F.struct("block", "kind", "record"))).alias("own"))
    return whole.unionByName(joined.select(
        "file", "first", F.array_join(F.col("own.record"), "\n").alias("record")))


def _inferred(rows: DataFrame, names: list[str]) -> str:
    """Types that fit all texts of each column, in one aggregate."""
    checks = []
    for i, c in enumerate(names):
        for kind, pattern in KINDS:
            value = col(c)
            fits = value.isNull() | (value.rlike(f"^({pattern})$")
                                     & F.expr(f"try_cast(`{c.replace('`', '``')}` AS {kind}) IS NOT NULL"))
            checks.append(F.bool_and(fits).alias(f"{kind}{i}"))
        checks.append(F.count(col(c)).alias(f"n{i}"))
    found = rows.agg(*checks).first()
    out = []
    for i, c in enumerate(names):
        kind = next((k for k, _ in KINDS if found[f"{k}{i}"] and found[f"n{i}"]), "string")
        out.append(f"`{c.replace('`', '``')}` {kind}")
    return ", ".join(out)


def read_quoted_csv(
    spark: SparkSession, path: str, separator: str = ",", encoding: str = "UTF-8",
    schema: str | None = None,
) -> DataFrame:
    """Rows of CSV files with a header whose quoted fields may span lines, in any number of tasks.

    A quote opens a field only at its beginning, ``""`` stands for a quote in it. The header has
    to end within the first range of its file. Without a ``schema`` types are inferred.
    """
    # a record ends at a line feed; the carriage return before it belongs to the break
    found = records(spark, path, separator, encoding).withColumn(
        "record", F.regexp_replace("record", "\r$", ""))
    header = found.where("first").orderBy("file").select("record").limit(1).collect()
    if not header:
        raise ValueError(f"no header in {path}")
    names = next(csv.reader([header[0][0].lstrip("﻿")], delimiter=separator))
    if schema is not None:
        names = T._parse_datatype_string(schema).names
    options = {"sep": separator, "quote": '"', "escape": '"', "multiLine": "true"}
    text = ", ".join("`{}` string".format(n.replace("`", "``")) for n in names)
    rows = found.where(~F.col("first") & (F.col("record") != "")).select(
        F.from_csv("record", text, options).alias("r")).select("r.*")
    wanted = schema or _inferred(rows, names)
    if schema is not None:
        return found.where(~F.col("first") & (F.col("record") != "")).select(
            F.from_csv("record", wanted, options).alias("r")).select("r.*")
    types = T._parse_datatype_string(wanted)
    return rows.select(*[
        F.expr(f"try_cast(`{f.name.replace('`', '``')}` AS {f.dataType.simpleString()})").alias(f.name)
        for f in types])
