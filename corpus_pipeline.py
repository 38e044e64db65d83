"""Documents to training tokens: drop toxic texts, drop copies, drop near copies, mix, encode.

Each stage takes what the one before it kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelry.llm import bpe, exact_dedup, jaccard_join, mixing, queries, toxicity
from panelry.llm.common import free_name, table, written

#: The mix after toxic texts have gone: shares of poor and good text. No document is taken less
#: than once, so the stage repeats documents and drops none.
STAGE_MIX, MOST_COPIES = [0.06, 0.93, 0.01], 2.0


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold; the id's rows go or stay together."""
    found = toxicity.toxicity(docs, table(spark, sf_dir, "labels"))
    own = free_name(docs, "clean_id")
    clean = found.where("predicted = 0").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(clean, F.col("doc_id").cast("long").eqNullSafe(F.col(own)), "left_semi")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.drop_similar(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says, once at least."""
    labelled = queries.domain_labels(table(spark, sf_dir, "labels"))
    mixed = mixing.mix(docs, labelled, STAGE_MIX, low=1.0, high=MOST_COPIES)
    own, copies, turn = (free_name(docs, name) for name in ("mixed_id", "copies", "turn_no"))
    times = mixed.groupBy(F.col("doc_id").alias(own)).agg(F.max("copies").alias(copies))
    joined = docs.join(times, F.col("doc_id").cast("long").eqNullSafe(F.col(own)))
    return joined.withColumn(turn, F.explode(F.sequence(F.lit(1), copies))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encoding_digest(docs, queries.RANKS, queries.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix),
    ("bpe", encode),
]

#: Classifiers and tokens are beyond SQL; the stages are tested on planted rows instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
