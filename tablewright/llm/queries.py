"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers

from pyspark.sql import functions as F

from tablewright.llm import (
    alignment,
    byte_bpe,
    common_lines,
    embedding_links,
    html_text,
    oracles,
    packing,
    quality_classifier,
    quality_rules,
    repeats,
    sharding,
    simhash,
    spelling,
    token_counts,
)
from tablewright.llm.registry import query, table


@query("op1_quality_rules", oracles.QUALITY_RULES)
def op1_quality_rules(spark, folder):
    good = table(spark, folder, "labels").where("quality = 1").select("doc_id")
    return quality_rules.judge(table(spark, folder, "documents"), good, keep=["doc_id"])


@query("op2_quality_classifier")
def op2_quality_classifier(spark, folder):
    labels = table(spark, folder, "labels").select(
        F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return quality_classifier.classify(table(spark, folder, "documents"), labels)


@query("op3_repeated_passages", oracles.REPEATED_PASSAGES)
def op3_repeated_passages(spark, folder):
    return repeats.remove_repeats(table(spark, folder, "documents"), least=50)


@query("op4_best_fit_packing")
def op4_best_fit_packing(spark, folder):
    return packing.pack(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
        capacity=1024, end_id=2)


@query("op5_byte_bpe")
def op5_byte_bpe(spark, folder):
    return byte_bpe.digests(byte_bpe.encode_decode(
        table(spark, folder, "documents"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))


@query("op6_html_text")
def op6_html_text(spark, folder):
    return html_text.extract(table(spark, folder, "pages"), keep=["page_id", "url"])


@query("op7_jump_sharding", oracles.JUMP_SHARDING)
def op7_jump_sharding(spark, folder):
    return sharding.shard(table(spark, folder, "documents"), shards=24)


@query("op8_simhash")
def op8_simhash(spark, folder):
    found = simhash.near_components(
        table(spark, folder, "documents"), words=3, bits=64, radius=2)
    return found.withColumn("fingerprint", F.lower(F.hex("fingerprint")))


@query("op9_embedding_links", oracles.EMBEDDING_LINKS)
def op9_embedding_links(spark, folder):
    return embedding_links.near_vectors(table(spark, folder, "embeddings"), cosine=0.98)


@query("op10_token_counts")
def op10_token_counts(spark, folder):
    return token_counts.token_counts(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op11_spelling_variants", oracles.SPELLING_VARIANTS)
def op11_spelling_variants(spark, folder):
    return spelling.spelling_variants(table(spark, folder, "documents"))


@query("op12_token_alignment")
def op12_token_alignment(spark, folder):
    return alignment.link_report(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"))


@query("op13_line_dedup", oracles.LINE_DEDUP)
def op13_line_dedup(spark, folder):
    found = common_lines.drop_common_lines(table(spark, folder, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
