"""The operators applied to their whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from panelry.llm import align, bpe, chat, exact_dedup, graph_search, html_text, jaccard_join, licenses, line_dedup, merkle, mixing, quality, toxicity
from panelry.llm.common import table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN

#: Domains of the mix by label: poor 0, good 1, toxic 2; their target shares.
MIX = [0.08, 0.90, 0.02]


def domain_labels(labels):
    """Labels as domains: toxic before poor before good."""
    domain = F.when(F.col("toxic") == 1, 2).otherwise(F.when(F.col("quality") == 1, 1).when(F.col("quality") == 0, 0))
    return labels.select(F.col("doc_id").cast("long"), domain.alias("domain"))


def op1_chat_formatting(spark, folder):
    return chat.format_turns(table(spark, folder, "conversations"))


def op2_toxicity(spark, folder):
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op3_license_scan(spark, folder):
    return licenses.scan(table(spark, folder, "documents"))


def op4_jaccard_join(spark, folder):
    return jaccard_join.similar_documents(table(spark, folder, "documents"))


def op5_quality(spark, folder):
    return quality.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op6_mixing(spark, folder):
    mixed = mixing.mix(table(spark, folder, "documents"), domain_labels(table(spark, folder, "labels")), MIX)
    p = [F.col("p")[i].alias(f"p_{name}") for i, name in enumerate(("poor", "good", "toxic"))]
    return mixed.select("doc_id", "n_tokens", *p, "rate", "copies", "residual")


def op7_bpe(spark, folder):
    return bpe.encoding_digest(table(spark, folder, "documents"), RANKS, PATTERN)


def op8_html_text(spark, folder):
    return html_text.extract(table(spark, folder, "pages"))


def op9_graph_search(spark, folder):
    return graph_search.nearest(table(spark, folder, "embeddings"))


def op10_exact_dedup(spark, folder):
    return exact_dedup.exact_duplicates(table(spark, folder, "documents"))


def op11_merkle_manifest(spark, folder):
    return merkle.manifest(table(spark, folder, "documents"))


def op12_line_dedup(spark, folder):
    kept = line_dedup.dedup_lines(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op13_tokenizer_alignment(spark, folder):
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return align.align(table(spark, folder, "documents"), *paths, digest=True).withColumnRenamed("groups", "groups_sha256")


QUERIES = (
    op1_chat_formatting, op2_toxicity, op3_license_scan, op4_jaccard_join, op5_quality, op6_mixing, op7_bpe,
    op8_html_text, op9_graph_search, op10_exact_dedup, op11_merkle_manifest,
    op12_line_dedup, op13_tokenizer_alignment,
)


def queries():
    import corpus_pipeline

    return {**{q.__name__: q for q in QUERIES}, "pipeline": corpus_pipeline.run}
