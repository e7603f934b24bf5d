"""A training corpus from raw documents: filter, deduplicate, cut repeats, pack.

Each stage takes the documents its predecessor kept and returns documents, the last one pieces of
packed sequences. ``run`` writes every stage's rows as Parquet in the shared checkpoint folder and
reads them again, so a lost executor costs tasks of one stage only.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.core import cut_lineage, ensure_checkpoint_dir
from tablewright.llm import near_sets, packing, quality_classifier, quality_rules, repeats
from tablewright.llm.common import free_disk

#: Near-duplicates: Jaccard similarity of the sets of five-word shingles.
SHINGLE, SIMILARITY = 5, 0.8
#: Bytes of texts that a task hands to its Python worker at once.
ARROW_BYTES = 4 << 20
#: Rows up to this number are broadcast as keys (8 bytes each before overhead).
BROADCAST_ROWS = 1_000_000


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the discriminant takes for low quality."""
    _begin(spark)
    labels = _labels(spark, sf_dir).select(
        F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    model = quality_classifier.learn(docs, labels)
    scored = quality_classifier.with_scores(docs, model, docs.columns, prefix="_quality_")
    return scored.where("_quality_predicted = 1").select(*_own(docs))


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the base rules or the log-likelihood ratio reject."""
    _begin(spark)
    trusted = _labels(spark, sf_dir).where("quality = 1").select("doc_id")
    judged = quality_rules.judge(docs, trusted, docs.columns, prefix="_rules_")
    return judged.where("_rules_kept").select(*_own(docs))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group, that of the smallest id.

    SimHash fingerprints meet by the generalised pigeonhole probing of op8 first; see ``near_sets``.
    A row is named by its id, null last, and its place in the table; so rows with equal or null
    ids are told apart, and of identical rows one stays. The places are written once and read
    from there, as another scan may split the files otherwise and number the rows anew. They go
    with the checkpoints of this stage and take no disk in later ones.
    """
    _begin(spark)
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # whatever the columns are called
    placed = cut_lineage(docs.select(
        *[F.col(f"`{c}`").alias(n) for c, n in own.items()],
        F.monotonically_increasing_id().alias("row")))
    doc_id = F.col(own["doc_id"])
    key = F.struct(doc_id.isNull().alias("none"), doc_id.alias("id"), F.col("row"))
    groups = near_sets.near_components(
        placed.select("row", key.alias("key"), F.col(own["text"]).alias("text")),
        SHINGLE, SIMILARITY)
    gone = groups.where("key <> component").select(F.col("row").alias("gone"))
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return placed.join(gone, F.col("row") == F.col("gone"), "left_anti").select(
        *[F.col(n).alias(c) for c, n in own.items()])


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 bytes or more that an earlier document holds too."""
    _begin(spark)
    kept = repeats.without_repeats(docs, least=50)
    return kept.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining texts, with their token ids, in sequences of 1,024 tokens."""
    _begin(spark)
    return packing.pack(
        docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2, with_ids=True)


def _begin(spark: SparkSession) -> None:
    """Small Arrow batches, and no shuffles and checkpoints of earlier stages.

    Texts are large rows: at the default of 64 MB the buffers of a task on both sides of the Python
    worker take more memory than its work. What earlier stages left goes with their objects.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    free_disk(spark)


def _own(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


STAGES = [
    ("quality_classifier", quality_classifier_stage),
    ("quality_rules", quality_rules_stage),
    ("simhash_near_dedup", simhash_stage),
    ("suffix_array_dedup", repeats_stage),
    ("best_fit_packing", packing_stage),
]

#: Discriminants, hashes, suffix arrays and tokens are beyond SQL; tests compare the stages with
#: brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; returns the packed pieces."""
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
