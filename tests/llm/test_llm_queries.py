"""Registered queries against their SQL, and the pipeline's stages on a small folder."""

import pytest
from oracle import compare, duck
from pyspark.sql import functions as F

import corpus_pipeline
from tablewright.llm import queries  # noqa: F401
from tablewright.llm.registry import QUERIES


@pytest.fixture(scope="module")
def con(data):
    return duck(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, data, con):
    ok, note = compare(QUERIES[name], spark, con, data)
    assert ok, note


def test_entry_registers_all(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


def test_pipeline_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    first = docs.where("length(text) > 1500 and length(text) < 9000").orderBy("doc_id").limit(1)
    words = F.split("text", " ")
    near = first.select(
        (F.col("doc_id") + 100_000).alias("doc_id"),
        F.array_join(F.concat(F.slice(words, 1, 50), F.array(F.lit("changed")),
                              F.slice(words, 51, 10_000)), " ").alias("text"),
        "lang", "source", "n_chars")
    copy = first.withColumn("doc_id", F.col("doc_id") + 200_000)
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (5, "", "en", "s", 0)], docs.schema)
    docs = docs.unionByName(near).unionByName(copy).unionByName(odd)
    counts = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, data).write.parquet(f"{tmp_path}/{i}")
        out = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert out.dtypes == docs.dtypes
        counts.append(out.count())
        if i == 2:
            left = {r.doc_id for r in out.select("doc_id").collect()}
            mine = first.first().doc_id
            before = {r.doc_id for r in docs.select("doc_id").collect()}
            assert mine in before and len(left & {mine, mine + 100_000, mine + 200_000}) == 1
            assert left <= before
        if i == 4:
            assert out.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 1024
            assert out.where("octet_length(ids) <> 4 * length").count() == 0
            assert {r.doc_id for r in out.select("doc_id").collect()} == left
        docs = out
    assert counts[0] >= counts[1] >= counts[2] == counts[3] > 0


def test_pipeline_of_no_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, data).count() == 0


def test_pipeline_keeps_extra_columns_and_repeated_rows(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(60)
    docs = docs.union(docs.limit(5)).withColumns(
        {"kept": F.lit("k"), "score": F.lit("s"), "_sha": F.lit("h"), "key": F.lit("y"),
         "_row": F.lit("mine"), "_gone": F.lit("g"), "c0": F.lit("c"), "row": F.lit("r")})
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns
        assert out.where("kept <> 'k' or score <> 's' or _sha <> 'h' or key <> 'y' "
                         "or _row <> 'mine' or _gone <> 'g' or c0 <> 'c' or row <> 'r'").count() == 0
    single = corpus_pipeline.simhash_stage(spark, docs, data)
    assert single.groupBy("doc_id").count().where("count > 1").count() == 0
