"""Dataset readers and writers: delimited text, Parquet, JSON, split tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.core import normalise_missing
from tablewright.sources.quoted_csv import read_quoted_csv

FORMATS = ("csv", "parquet", "json", "orc")


def sniff_separator(spark: SparkSession, path: str) -> str:
    """``;`` when the header line has more of them than commas."""
    first = spark.read.option("encoding", "latin1").text(path).limit(1).collect()
    line = first[0][0] if first else ""
    return ";" if line.count(";") > line.count(",") else ","


def inspect_text(spark: SparkSession, path: str) -> tuple[bool, bool]:
    """Whether a text file is valid UTF-8 and whether a quoted field spans lines; one scan."""
    # latin-1 keeps every byte, encoding back restores the original bytes
    raw = (
        spark.read.option("encoding", "ISO-8859-1")
        .option("header", False)
        .option("sep", "\u0001")
        .option("quote", "")
        .csv(path, schema="line string")
    )
    valid = F.is_valid_utf8(F.encode("line", "ISO-8859-1").cast("string"))
    quotes = F.length("line") - F.length(F.replace(F.col("line"), F.lit('"'), F.lit("")))
    row = raw.agg(F.bool_and(valid).alias("utf8"), F.bool_or(quotes % 2 == 1).alias("open")).first()
    return row["utf8"] is not False, bool(row["open"])


def load_csv(
    spark: SparkSession, path: str, separator: str | None = None, encoding: str | None = None,
    schema: str | None = None, multi_line: bool | None = None,
) -> DataFrame:
    """CSV with a header; separator, encoding and line layout are detected, types inferred.

    With ``encoding`` and ``multi_line`` given nothing is inspected, with a ``schema`` nothing is
    inferred, so the file is read once.

    Files with line breaks inside quotes are read by byte ranges too, each from its true state
    (:mod:`quoted_csv`); ``multi_line=True`` asks for Spark's own reader, which takes a file whole.
    Giving a schema avoids the extra inference pass over large files.
    """
    if not path.rstrip("/").lower().endswith((".csv", ".csv.gz")):
        raise ValueError(f"Expected a CSV file, got: {path}")
    utf8, asked = True, multi_line
    if encoding is None or multi_line is None:
        utf8, spans = inspect_text(spark, path)
        multi_line = spans if multi_line is None else multi_line
    separator = separator or sniff_separator(spark, path)
    encoding = encoding or ("UTF-8" if utf8 else "ISO-8859-1")
    if multi_line and not asked and not path.endswith(".gz"):
        return normalise_missing(read_quoted_csv(spark, path, separator, encoding, schema))
    reader = (
        spark.read.option("header", True)
        .option("sep", separator)
        .option("encoding", encoding)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
    )
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return normalise_missing(reader.csv(path))


def load_table(spark: SparkSession, path: str, kind: str | None = None, **options) -> DataFrame:
    """Read a dataset by its suffix (or ``kind``) with NaN turned into NULL."""
    kind = kind or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind not in FORMATS:
        raise ValueError(f"Unknown format '{kind}'. Use one of {FORMATS}.")
    if kind == "csv":
        return load_csv(spark, path, **options)
    return normalise_missing(spark.read.format(kind).options(**options).load(path))


def preview(df: DataFrame, n_rows: int = 5, order: list[Column] | None = None) -> DataFrame:
    """First rows; with an order key this is a top-k, without one any first partition."""
    return (df.orderBy(*order) if order else df).limit(n_rows)


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer = writer.option("header", True)
    writer.format(kind).save(path)


def write_split(df: DataFrame, path: str) -> None:
    """One table partitioned by ``split``; a reader of one side never opens the other."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("split") == split)
