"""Helpers shared by the operators: the shared folder, written tables, words."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``.

    Where the session names none, a session on one machine gets a new temporary folder; on a
    cluster that is an error, as executors would write to their own disks.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local") or "local-cluster" in spark.conf.get("spark.master"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until the frame has no such column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a table in the shared folder: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """A text as given; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def crc_bucket(column: str, buckets: int) -> Column:
    """crc32 of a value as text, modulo ``buckets``; null stays null."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(buckets))


def hash_words(words: list[str], known: dict[str, int], limit: int = 1 << 20) -> np.ndarray:
    """A stable 64-bit hash per word; ``known`` remembers them within one task."""
    import xxhash

    if len(known) > limit:
        known.clear()
    for word in set(words).difference(known):
        known[word] = xxhash.xxh3_64_intdigest(word)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def in_parts(batches, column: str = "text", chars: int = 4 << 20):
    """The Arrow batches cut so that none holds much more than ``chars`` bytes of text."""
    import pyarrow.compute as pc

    for given in batches:
        sizes = pc.fill_null(pc.binary_length(given.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, low = np.cumsum(sizes), 0
        while low < len(sizes):
            before = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, before + chars, "right")))
            yield given.slice(low, high - low)
            low = high


def fraction(column: str, seed: int) -> Column:
    """A fixed number in [0, 1) per value, spread evenly."""
    return F.pmod(F.xxhash64(F.col(column), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, seed: int = 11) -> DataFrame:
    """About ``rows`` labelled documents, evenly over all, with the columns of both.

    All of them when there are fewer; so the broadcast side has about ``rows`` rows at most.  Labels without an id are ignored, a repeated label counts
    once with its larger values.
    """
    others = [c for c in labels.columns if c != "doc_id"]
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.max(c).alias(c) for c in others])
    share = min(1.0, rows / max(1, known.count()))
    return docs.join(F.broadcast(known.where(fraction("doc_id", seed) < share)), "doc_id")
