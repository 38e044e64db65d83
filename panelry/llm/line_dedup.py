"""Reversible line dedup: cuckoo filters by shard in front of exact reference counts.

A ``LineIndex`` knows the lines of the documents inserted so far.  Its truth are two tables: the
postings (which document holds which line) and the reference counts of lines (how many rows hold
it, the smallest and the largest id).  In front of them every shard of the key space has a cuckoo
filter of bounded size.  A batch to insert asks the filters first: a line that its filter does
not know is new and needs no lookup, only what the filter knows is looked up in the counts.
Documents can be deleted: the counts of their lines are taken anew from the postings left, and
lines that nobody holds any more leave their filter.  What ``kept`` returns depends on the
documents of the index alone, in whatever order they came and went.

Counts are aggregated map side, one row per line and task, before anything is shuffled by line.
Lines that hold more than one in ``HEAVY`` of all postings, less than ``HEAVY`` lines, find
their postings by broadcast; all others by a shuffle in which no line has more than that share.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelry.llm.common import in_parts, whole_text, written
from panelry.llm.cuckoo import CuckooFilter

SHORTEST = 10
SHARD_KEYS = 1 << 16
BUCKETS = SHARD_KEYS // 2  # two places per key at the size aimed at
HEAVY = 4096
LOWEST = -(1 << 63)
BLANKS = b" \t\n\x0b\x0c\r"

POSTING = "doc_id long, text_md5 binary, key binary"
DELTA = "key binary, n long, low long, high long, shard int"
PROBED = "key binary, known boolean, shard int, slots binary, stash binary"
FILTER = "shard int, slots binary, stash binary"


def line_key(line: bytes) -> bytes | None:
    """The hash that names a line, or None where its key is too short to count.

    Blanks at both ends go and A-Z become small; the length is in code points.
    """
    key = line.strip(BLANKS).lower()
    if len(key) < SHORTEST or (len(key) < 4 * SHORTEST and len(key.decode()) < SHORTEST):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def split_to_postings(batches):
    import pyarrow as pa

    kinds = {"doc_id": pa.int64(), "text_md5": pa.binary(), "key": pa.binary()}
    for batch in in_parts(batches):
        ids, texts, keys = [], [], []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            own = {line_key(line) for line in text.split(b"\n")} - {None}
            ids += [doc_id] * len(own)
            texts += [hashlib.md5(text).digest()] * len(own)
            keys += own
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((ids, texts, keys), kinds.values())],
                                         names=list(kinds))


def named(docs: DataFrame) -> DataFrame:
    """Rows by id and text; a row without id counts as the smallest id."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("doc_id"), whole_text().alias("text"))


def key_bytes(table, keep=None) -> bytes:
    keys = table.column("key").to_pylist()
    return b"".join(keys if keep is None else [k for k, kept in zip(keys, keep) if kept])


def filter_of(table) -> CuckooFilter:
    """The filter of a shard, new where it has none yet."""
    rows = table.to_pylist()
    return CuckooFilter(BUCKETS, rows[0]["slots"], rows[0]["stash"]) if rows else CuckooFilter(BUCKETS)


def probe(asked, filters):
    """Which keys the filter knows; the others are put into it."""
    import pyarrow as pa

    shard = (asked if asked.num_rows else filters).column("shard")[0].as_py()
    own = filter_of(filters)
    known = own.contains(key_bytes(asked)).tolist()
    own.add(key_bytes(asked, [not k for k in known]))
    n = asked.num_rows
    return pa.table({
        "key": pa.array([*asked.column("key").to_pylist(), None], pa.binary()),
        "known": pa.array([*known, None], pa.bool_()),
        "shard": pa.array([shard] * (n + 1), pa.int32()),
        "slots": pa.array([None] * n + [own.slots.tobytes()], pa.binary()),
        "stash": pa.array([None] * n + [own.stash.tobytes()], pa.binary()),
    })


def changed(keys, filters, remove: bool):
    import pyarrow as pa

    shard = (keys if keys.num_rows else filters).column("shard")[0].as_py()
    own = filter_of(filters)
    (own.remove if remove else own.add)(key_bytes(keys))
    return pa.table({"shard": pa.array([shard], pa.int32()), "slots": pa.array([own.slots.tobytes()], pa.binary()),
                     "stash": pa.array([own.stash.tobytes()], pa.binary())})


def put(keys, filters):
    return changed(keys, filters, False)


def take(keys, filters):
    return changed(keys, filters, True)


def counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


@dataclass(frozen=True)
class LineIndex:
    """Lines of documents; ``insert`` and ``delete`` give a new index, the old one stays as it is."""

    postings: DataFrame  # doc_id, text_md5, key, version
    counts: DataFrame    # key, n, low, high: parts of a line's count may lie in several rows
    filters: DataFrame   # shard, slots, stash
    deleted: DataFrame   # doc_id, version
    shards: int = 0
    version: int = 0
    keys: int = 0        # lines inserted, an upper bound of the different ones

    @staticmethod
    def empty(spark: SparkSession) -> LineIndex:
        def none(schema):
            return spark.createDataFrame([], schema)

        return LineIndex(none(f"{POSTING}, version int"), none("key binary, n long, low long, high long"),
                         none(FILTER), none("doc_id long, version int"))

    def shard(self, column: str = "key"):
        return F.pmod(F.crc32(column), F.lit(self.shards)).cast("int")

    def resized(self, keys: int) -> LineIndex:
        """Enough shards for so many lines more; their filters are filled from the counts."""
        need = -(-(self.keys + keys) // SHARD_KEYS)
        if need <= self.shards:
            return self
        wider = replace(self, shards=max(need, 2 * self.shards))
        if not self.keys:
            return wider
        live = self.current().select("key").withColumn("shard", wider.shard())
        empty = self.filters.limit(0)
        filters = live.groupBy("shard").cogroup(empty.groupBy("shard")).applyInArrow(put, FILTER)
        return replace(wider, filters=written(filters, "filters"))

    def current(self) -> DataFrame:
        """One row per line held: how many rows hold it, the smallest and the largest id."""
        return counted(self.counts)

    def live(self) -> DataFrame:
        """Postings of documents that were not deleted since."""
        gone = self.deleted.select(F.col("doc_id").alias("gone_id"), F.col("version").alias("gone_at"))
        return self.postings.join(
            gone, (F.col("doc_id") == F.col("gone_id")) & (F.col("version") < F.col("gone_at")), "left_anti")

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with these documents added."""
        version = self.version + 1
        postings = written(named(docs).mapInArrow(split_to_postings, POSTING), "postings")
        deltas = written(counted(postings.select("key", F.lit(1).cast("long").alias("n"), F.col("doc_id").alias("low"),
                                                 F.col("doc_id").alias("high"))), "deltas")
        fresh = deltas.count()
        if not fresh:
            return replace(self, version=version)
        wide = self.resized(fresh)
        asked = deltas.select("key", wide.shard().alias("shard"))
        probed = written(
            asked.groupBy("shard").cogroup(wide.filters.groupBy("shard")).applyInArrow(probe, PROBED), "probed")
        filters = probed.where("slots IS NOT NULL").select("shard", "slots", "stash")
        hits = probed.where("known").select("key", "shard")
        # known to the filter only: another line with this fingerprint, so it is new as well
        strays = written(hits.join(self.counts, "key", "left_anti"), "strays")
        if self.keys and not strays.isEmpty():
            filters = written(
                strays.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(put, FILTER), "filters")
        return replace(
            wide, filters=filters, version=version, keys=self.keys + fresh,
            postings=self.postings.unionByName(postings.withColumn("version", F.lit(version))),
            counts=self.counts.unionByName(deltas),
        )

    def delete(self, ids: DataFrame) -> LineIndex:
        """The index without the documents of these ids (column ``doc_id``)."""
        version = self.version + 1
        names = ids.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("doc_id")).distinct()
        names = written(names.withColumn("version", F.lit(version)), "deleted")
        touched = written(self.live().join(names.select("doc_id"), "doc_id", "left_semi").select("key").distinct(), "touched")
        after = replace(self, version=version, deleted=self.deleted.unionByName(names))
        left = counted(after.live().select("key", F.lit(1).cast("long").alias("n"), F.col("doc_id").alias("low"),
                                           F.col("doc_id").alias("high")))
        left = written(left.join(touched, "key", "left_semi"), "left")
        counts = written(self.current().join(touched, "key", "left_anti").unionByName(left), "counts")
        dead = touched.join(left, "key", "left_anti").withColumn("shard", self.shard() if self.shards else F.lit(0))
        filters = dead.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(take, FILTER)
        return replace(after, counts=counts, filters=written(filters, "filters"))

    def dropped(self) -> DataFrame:
        """``doc_id, text_md5, keys``: the lines every row of the index loses."""
        repeated = written(self.current().where("low < high").select("key", "low", "n"), "repeated")
        total = self.counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        heavy = F.broadcast(repeated.where(F.col("n") * HEAVY > total).select("key", "low"))
        light = repeated.where(F.col("n") * HEAVY <= total).select("key", "low")
        live = self.live()
        often = live.join(heavy, "key")
        seldom = live.join(heavy, "key", "left_anti").join(light, "key")
        lost = often.unionByName(seldom).where("doc_id > low")
        return lost.groupBy("doc_id", "text_md5").agg(F.collect_set("key").alias("keys"))

    def kept(self, docs: DataFrame) -> DataFrame:
        """Documents of the index with the lines that stay.

        ``doc_id, n_lines, n_dropped, text``, one row per row of ``docs``.  A line found in at
        least two documents stays in the smallest id only, there as often as it occurs; keys of
        fewer than ten code points always stay.  Null and empty texts are one empty line.  Rows
        sharing an id are one document; rows without id are one too, the smallest.  Rows the index
        does not hold lose nothing.  Further columns are ignored, an empty table gives no rows.
        """
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
        rows = rows.withColumn("text_md5", F.unhex(F.md5(F.col("text").cast("binary"))))
        lost = self.dropped().withColumnRenamed("doc_id", "own_id").withColumnRenamed("text_md5", "own_md5")
        same = (F.coalesce("doc_id", F.lit(LOWEST)) == F.col("own_id")) & (F.col("text_md5") == F.col("own_md5"))
        return rows.join(lost, same, "left").select("doc_id", "text", "keys").mapInArrow(
            without_lines, "doc_id long, n_lines long, n_dropped long, text string")


def without_lines(batches):
    import pyarrow as pa

    for batch in in_parts(batches):
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        counts, drops, kept = [], [], []
        for text, keys in zip(texts, batch.column("keys").to_pylist()):
            lines, gone = text.split(b"\n"), set(keys or ())
            stay = [line for line in lines if line_key(line) not in gone] if gone else lines
            counts.append(len(lines))
            drops.append(len(lines) - len(stay))
            kept.append(b"\n".join(stay))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(drops, pa.int64()),
             pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_lines", "n_dropped", "text"])


def dedup_lines(docs: DataFrame, increments: int = 2) -> DataFrame:
    """Insert a whole table in ``increments`` parts, by a hash of the id, and give what is kept."""
    index = LineIndex.empty(docs.sparkSession)
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(increments))
    for number in range(increments):
        index = index.insert(docs.where(part == number))
    return index.kept(docs)
