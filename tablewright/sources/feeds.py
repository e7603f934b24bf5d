"""Rows from research feeds: Atom entries and JSON lists of notebooks, datasets and papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.expressions import readable_size

ATOM_SCHEMA = (
    "title string, summary string, published string, id string, "
    "author array<struct<name: string>>, "
    "link array<struct<_href: string, _rel: string, _type: string>>, "
    "category array<struct<_term: string>>, "
    "`arxiv:primary_category` array<struct<_term: string>>, "
    "primary_category array<struct<_term: string>>"
)


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def atom_rows(entries: DataFrame) -> DataFrame:
    """Title, abstract, authors, url, date and distinct categories of parsed Atom entries."""
    page = F.filter(
        F.coalesce(F.col("link"), F.array()),
        lambda x: F.coalesce(x["_type"] == "text/html", F.lit(False))
        | F.coalesce(x["_rel"] == "alternate", F.lit(False)),
    )
    url = F.try_element_at(page, F.lit(1))["_href"]
    url = F.when(F.coalesce(url, F.lit("")) == "", F.trim(_text(F.col("id")))).otherwise(url)
    terms = F.transform(
        F.concat(
            *[
                F.coalesce(F.col(f"`{c}`"), F.array())
                for c in ("arxiv:primary_category", "primary_category", "category")
            ]
        ),
        lambda x: x["_term"],
    )
    authors = F.transform(
        F.coalesce(F.col("author"), F.array()), lambda a: F.trim(a["name"])
    )
    return entries.select(
        F.trim(F.translate(_text(F.col("title")), "\n", " ")).alias("title"),
        F.trim(_text(F.col("summary"))).alias("abstract"),
        F.filter(authors, lambda a: F.coalesce(a != "", F.lit(False))).alias("authors"),
        url.alias("url"),
        _text(F.col("published")).alias("published"),
        F.array_distinct(
            F.filter(terms, lambda t: F.coalesce(t != "", F.lit(False)))
        ).alias("categories"),
    )


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom files; each file is split at its ``entry`` elements."""
    raw = (
        spark.read.format("xml").option("rowTag", "entry").schema(ATOM_SCHEMA).load(path)
    )
    return atom_rows(raw)


NOTEBOOKS = (
    "array<struct<title: string, author: string, ref: string, totalVotes: double, "
    "language: string>>"
)
DATASETS = (
    "array<struct<title: string, ref: string, subtitle: string, description: string, "
    "totalBytes: double, downloadCount: bigint>>"
)
PAPERS = (
    "struct<count: bigint, results: array<struct<id: string, title: string, abstract: string, "
    "url_abs: string, url_pdf: string, proceeding: string, tasks: array<string>>>>"
)


def notebook_rows(lists: DataFrame, body: str = "body") -> DataFrame:
    """One row per notebook of every JSON list."""
    n = F.col("n")
    return lists.select(F.explode(F.from_json(body, NOTEBOOKS)).alias("n")).select(
        _text(n["title"]).alias("title"),
        _text(n["author"]).alias("author"),
        F.when(n["ref"].isNotNull(), F.concat(F.lit("https://www.kaggle.com/code/"), n["ref"]))
        .otherwise("")
        .alias("url"),
        F.coalesce(n["totalVotes"], F.lit(0.0)).alias("score"),
        F.coalesce(n["language"], F.lit("unknown")).alias("language"),
    )


def dataset_rows(lists: DataFrame, body: str = "body") -> DataFrame:
    """One row per dataset, with a readable size."""
    d = F.col("d")
    return lists.select(F.explode(F.from_json(body, DATASETS)).alias("d")).select(
        F.coalesce(d["title"], d["ref"], F.lit("")).alias("title"),
        F.coalesce(d["subtitle"], d["description"], F.lit("")).alias("description"),
        F.when(
            d["ref"].isNotNull(), F.concat(F.lit("https://www.kaggle.com/datasets/"), d["ref"])
        )
        .otherwise("")
        .alias("url"),
        readable_size(d["totalBytes"]).alias("size"),
        F.coalesce(d["downloadCount"], F.lit(0)).alias("download_count"),
    )


def paper_rows(responses: DataFrame, body: str = "body") -> DataFrame:
    """One row per paper; a task is a name or an object with a ``name``."""
    p = F.col("p")
    names = F.transform(
        F.coalesce(p["tasks"], F.array()),
        lambda t: F.coalesce(F.get_json_object(t, "$.name"), t),
    )
    fallback = F.when(
        F.coalesce(p["id"], F.lit("")) != "",
        F.concat(F.lit("https://paperswithcode.com/paper/"), p["id"]),
    ).otherwise("")
    return responses.select(
        F.explode(F.from_json(body, PAPERS)["results"]).alias("p")
    ).select(
        _text(p["title"]).alias("title"),
        _text(p["abstract"]).alias("abstract"),
        F.when(F.coalesce(p["url_abs"], F.lit("")) != "", p["url_abs"])
        .otherwise(fallback)
        .alias("url"),
        F.when(p["url_pdf"] != "", p["url_pdf"]).alias("url_pdf"),
        F.when(p["proceeding"] != "", p["proceeding"]).alias("proceeding"),
        names.alias("tasks"),
    )
