"""Self-join of documents by Jaccard similarity of their word shingles, by chosen paths.

A run samples shared tokens of a set by minimum hashes: at each node of a random tree a set goes
on to the child named by its smallest token under one hash, and with probability ``FORK`` also to
a second child under another hash.  Whether two sets keep a common path depends on their
similarity alone, whatever else is in the table.  A set alone in its
node is done; below ``SHALLOW`` levels, which part texts that merely share a passage, a node of
few sets is not split further but compared by brute force.  Nodes with the same members are
compared once.  Runs repeat until 1 - (1 - p)^runs reaches the target recall for a pair at the
threshold and the full depth.

Nodes that never get small (large groups of near copies) are cut into blocks and compared block
by block.  Inside a node the shared tokens of all pairs are one matrix product, and only counts
and a root per member leave the task, never the pairs.  A pair that meets in several nodes is
counted in the first of them.  Texts with the same set of shingles are one member of the join.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelry.llm.common import WORD, hash_words, in_parts, whole_text, written
from panelry.llm.components import components

DEPTH = 3
FORK = 0.25
SHALLOW = 2
SMALL = 12
BLOCK = 768
TOKENS = 1_500_000
SLICE = 4096
CHUNK = 1 << 16


def survival(similarity: float, depth: int = DEPTH, fork: float = FORK) -> float:
    """Chance that two sets of this similarity share a path of this depth in one run.

    All nodes of a level go by the same two minimum hashes, so the nodes that two sets share live
    or end together: the number of nodes shared is followed from level to level.
    """
    shared = {1: 1.0}
    for _ in range(depth):
        after: dict[int, float] = {}
        for nodes, chance in shared.items():
            for forked in range(nodes + 1):
                split_ = math.comb(nodes, forked) * fork**forked * (1 - fork) ** (nodes - forked)
                for first, second in itertools.product((0, 1), repeat=2):
                    agree = math.prod(similarity if x else 1 - similarity for x in (first, second))
                    left = nodes * first + forked * second
                    after[left] = after.get(left, 0.0) + chance * split_ * agree
        shared = {n: p for n, p in after.items() if n}
    return sum(shared.values())


def runs_for(recall: float, similarity: float, depth: int = DEPTH) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(similarity, depth)))


def mix(values: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a fixed bijection)."""
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


def shingles(texts: list[str], words: int, known: dict[str, int]) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of all its runs of ``words`` words.

    A shorter text is one shingle of all its words, a text without words has none.
    """
    cut = [WORD.findall(text.lower()) for text in texts]
    flat = hash_words([w for own in cut for w in own], known)
    rolled = np.zeros(len(flat), np.uint64)
    for k in range(words):
        ahead = np.zeros_like(flat)
        ahead[:len(flat) - k] = flat[k:]
        rolled = mix(rolled + ahead)
    out, at = [], 0
    for own in cut:
        n = len(own)
        if n >= words:
            out.append(np.unique(rolled[at:at + n - words + 1]))
        else:
            single = np.zeros(min(n, 1), np.uint64)
            for value in flat[at:at + n]:
                single = mix(single + value)
            out.append(single)
        at += n
    return out


def set_key(held: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(held.tobytes(), digest_size=16).digest()


def minima(sets: list[np.ndarray], odd: np.ndarray) -> np.ndarray:
    """The smallest value of every set under every hash, a row per set that holds something."""
    out = np.empty((len(sets), len(odd)), np.int32)
    low = 0
    while low < len(sets):
        high, held = low, 0
        while high < len(sets) and (high == low or held + len(sets[high]) <= CHUNK):
            held += len(sets[high])
            high += 1
        tokens = (np.concatenate(sets[low:high]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0] + [len(s) for s in sets[low:high - 1]])
        for k, m in enumerate(odd):
            out[low:high, k] = (np.minimum.reduceat(tokens * m, starts) >> np.uint32(1)).astype(np.int32)
        low = high
    return out


def sketches(words: int, coordinates: int):
    """Per document the digest of its shingle set, its size and its minimum hashes."""

    def run(batches):
        import pyarrow as pa

        odd = np.random.default_rng(7).integers(0, 1 << 31, coordinates, np.uint32) * np.uint32(2) + np.uint32(1)
        known: dict[str, int] = {}
        for given in in_parts(batches):
            sets = shingles(given.column("text").to_pylist(), words, known)
            sizes = np.array([len(s) for s in sets], np.int32)
            flat = minima([s for s in sets if len(s)], odd).ravel()
            ends = np.cumsum(np.concatenate([[0], np.where(sizes > 0, coordinates, 0)])).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [given.column("doc_id"), pa.array([set_key(s) for s in sets], pa.binary()),
                 pa.array(sizes), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))],
                names=["doc_id", "set_key", "size", "mins"])

    return run


def first_level(members: DataFrame, runs: int) -> DataFrame:
    """One row per member and run: the root, with the coordinates of that run."""
    width = 2 * DEPTH
    each = F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.struct(
        r.cast("long").alias("node"), F.slice("mins", r * width + 1, width).alias("mins")))
    return members.select("member", "size", F.explode(each).alias("at")).select(
        "member", "size", "at.node", "at.mins")


def split(rows: DataFrame, level: int) -> DataFrame:
    """The children of every row at this level."""
    first, second = F.element_at("mins", 2 * level + 1), F.element_at("mins", 2 * level + 2)
    forks = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1000)) < int(1000 * FORK)
    children = F.when(forks, F.array(F.xxhash64("node", F.lit(1), first), F.xxhash64("node", F.lit(2), second))) \
        .otherwise(F.array(F.xxhash64("node", F.lit(1), first)))
    return rows.select("member", "size", "mins", F.explode(children).alias("node"))


def leaves(members: DataFrame, runs: int) -> DataFrame:
    """``member``, ``leaf``, ``n``, ``tokens``: nodes of two members or more where splitting ended."""
    rows, found = first_level(members, runs), None
    for level in range(DEPTH):
        rows = split(rows, level)
        counts = rows.groupBy("node").agg(
            F.count("*").alias("n"), F.sum("size").alias("tokens")).where("n > 1")
        rows = written(rows.join(counts, "node"), "nodes")
        if level < SHALLOW:
            rows = rows.select("member", "size", "node", "mins")
            continue
        ended = rows if level == DEPTH - 1 else rows.where(F.col("n") <= SMALL)
        ended = ended.select("member", F.col("node").alias("leaf"), "n", "tokens")
        found = ended if found is None else found.unionByName(ended)
        rows = rows.where(F.col("n") > SMALL).select("member", "size", "node", "mins")
    return found


def shingle_sets(words: int):
    """The sets of the texts whose digest is the wanted one (an id may repeat over other texts)."""

    def run(batches):
        import pyarrow as pa

        known: dict[str, int] = {}
        for given in in_parts(batches):
            sets = shingles(given.column("text").to_pylist(), words, known)
            same = [set_key(s) == k for s, k in zip(sets, given.column("set_key").to_pylist())]
            rest = given.select(["member", "leaves"]).filter(pa.array(same, pa.bool_()))
            held = [s.astype("<u8").tobytes() for s, right in zip(sets, same) if right]
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, pa.array(held, pa.binary())], names=["member", "leaves", "held"])

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Number of shared tokens of all pairs, summed over slices of the tokens held twice or more."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.cumsum(df > 1) - 1
    use = df[column] > 1
    owner, column = owner[use], common[column[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((n, n), np.float32)
    width = int(common[-1]) + 1 if len(common) else 0
    for low in range(0, width, SLICE):
        a, b = np.searchsorted(column, [low, low + SLICE])
        part = np.zeros((n, min(SLICE, width - low)), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        shared += part @ part.T
    return shared


def compare(threshold: float):
    """All links within one node, or between two of its blocks."""

    def run(key, group):
        import pandas as pd

        leaf, first, second = key
        group = group.sort_values("member").drop_duplicates("member")
        ids = group["member"].to_numpy()
        sets = [np.frombuffer(x, "<u8") for x in group["held"]]
        sizes = np.array([len(s) for s in sets], np.float64)
        shared = overlaps(sets).astype(np.float64)
        linked = shared >= threshold * (sizes[:, None] + sizes[None, :] - shared) - 1e-9
        np.fill_diagonal(linked, False)
        block = group["block"].to_numpy()
        if first != second:
            linked &= block[:, None] != block[None, :]
        if not linked.any():
            return pd.DataFrame({"member": [], "links": [], "root": []})
        earlier = [np.asarray(x)[np.asarray(x) < leaf] for x in group["leaves"]]
        counted = linked
        if any(len(x) for x in earlier):
            counted = linked & (overlaps(earlier) < 0.5)
        root = np.arange(len(ids))
        while True:
            near = np.where(linked, root[None, :], len(ids)).min(axis=1)
            lower = np.minimum(root, near)
            lower = np.minimum(lower, lower[lower])
            if (lower == root).all():
                break
            root = lower
        touched = linked.any(axis=1)
        return pd.DataFrame({"member": ids[touched], "links": counted.sum(axis=1)[touched],
                             "root": ids[root[touched]]})

    return run


def similar_documents(docs: DataFrame, words: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """One row per document: ``doc_id``, ``class_id``, ``set_id``, ``set_size``, ``copies``, ``n_links``.

    ``set_id`` is the smallest ``doc_id`` with the same shingle set and ``copies`` the rows that
    have it; ``n_links`` counts the other sets of Jaccard similarity ``threshold`` or more;
    ``class_id`` is the smallest ``doc_id`` reachable over links.  A text shorter than ``words``
    words is one shingle; null, empty and wordless texts have none, form one set and link to
    nothing.  A set whose rows all have a null ``doc_id`` links to nothing; otherwise
    such rows share what their set has.  Further columns are ignored, an empty table gives an empty result.
    """
    runs = runs_for(recall, threshold)
    plain = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    found = written(plain.mapInArrow(
        sketches(words, 2 * DEPTH * runs),
        "doc_id long, set_key binary, size int, mins array<int>"), "sketches")
    sets = written(found.groupBy("set_key").agg(
        F.min("doc_id").alias("set_id"), F.count("*").alias("copies"),
        F.first("size").alias("size")), "sets")
    owners = sets.where("size > 0 AND set_id IS NOT NULL").select(F.col("set_id").alias("doc_id"), "set_key")
    members = found.join(owners, ["doc_id", "set_key"]).dropDuplicates(["doc_id", "set_key"])
    # ids may repeat over different texts, so a member is named by its set
    member = F.xxhash64("set_key").alias("member")
    members = written(members.select("doc_id", "set_key", member, "size", "mins"), "members")
    nodes = leaves(members.select("member", "size", "mins"), runs)
    linked = written(candidate_links(plain, members.select("doc_id", "set_key", "member"), nodes, words, threshold),
                     "compared")
    named = sets.select("set_key", "set_id", "copies", "size", member)
    degrees = linked.groupBy("member").agg(F.sum("links").alias("n_links"))
    label = components(linked.select(F.col("member").alias("a"), F.col("root").alias("b")))
    grouped = label.withColumnRenamed("node", "member").join(named.select("member", "set_id"), "member")
    lowest = grouped.groupBy("label").agg(F.min("set_id").alias("class_id"))
    of_linked = grouped.join(lowest, "label").select("member", "class_id")
    classes = named.join(of_linked, "member", "left").join(degrees, "member", "left").select(
        "set_key", F.coalesce("class_id", "set_id").alias("class_id"), "set_id",
        F.col("size").alias("set_size"), "copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return found.select("doc_id", "set_key").join(classes, "set_key").drop("set_key")


def different(nodes: DataFrame) -> DataFrame:
    """One node of all those that hold the same members, told by two 64-bit digests of them."""
    same = nodes.groupBy("leaf").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("member", F.lit(1))).alias("a"),
        F.bit_xor(F.xxhash64("member", F.lit(2))).alias("b"))
    return nodes.join(same.groupBy("n", "a", "b").agg(F.min("leaf").alias("leaf")).select("leaf"), "leaf", "left_semi")


def candidate_links(plain, members, nodes, words, threshold):
    """Brute force over the leaves; only the texts of their members are read into sets again."""
    nodes = written(different(written(nodes, "leaves")), "leaves")
    paths = nodes.groupBy("member").agg(F.collect_set("leaf").alias("leaves"))
    texts = plain.join(members.join(paths, "member"), "doc_id")
    full = texts.select("member", "set_key", "leaves", "text").mapInArrow(
        shingle_sets(words), "member long, leaves array<long>, held binary")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("tokens") / TOKENS)).cast("int")
    placed = nodes.withColumn("blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64("member", "leaf"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(
        F.least("block", other).alias("first"), F.greatest("block", other).alias("second")))
    dealt = placed.select("member", "leaf", "block", F.explode(pairs).alias("pair")).select(
        "member", "leaf", "block", "pair.first", "pair.second")
    return dealt.join(full, "member").groupBy("leaf", "first", "second").applyInPandas(
        compare(threshold), "member long, links long, root long")


def drop_similar(docs: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """The documents with one row left of each class: the one with the smallest id."""
    found = similar_documents(docs, words, threshold)
    stays = found.where("doc_id = class_id OR doc_id IS NULL OR set_size = 0").select("doc_id").distinct()
    return docs.join(stays, docs["doc_id"].eqNullSafe(stays["doc_id"]), "left_semi")
