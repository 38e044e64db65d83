"""Approximate nearest neighbours on robust-pruned directed graphs, one per shard.

Vectors are dealt to shards of bounded size by content; a shard holds more points the larger the
table is, so the number of shards grows with its root until shards are full.  In a shard, points
enter the graph in growing batches: a greedy search from the medoid proposes neighbours, and
relaxed pruning keeps a candidate only if no kept one is ``ALPHA`` times nearer to it than the
point is, so edges point in different directions.  Points that pruning cut off are linked again.
A shard no larger than the beam is searched whole.

The graph of a shard is built once and stored in the shared folder, a row per point with its
edges, so a lost executor repeats shards, not the index.  Every query then runs a beam search in
every shard, and the shards' best are merged.  Queries are dealt to blocks of bounded size, and a
task holds the stored graph of one shard and one block.  Scores of what the searches found are
exact cosines in double precision.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelry.llm.common import written

SHARD = 2048
LARGEST = 16384
DEGREE = 32
BEAM = 64
ALPHA = 1.2
BATCH = 256
QUERIES = 8192


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def greedy(points: np.ndarray, edges: np.ndarray, start: int, targets: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search for many unit targets at once: candidates and squared distances, nearest first.

    ``edges`` holds neighbour numbers, -1 where there is none.  Each step expands the nearest
    candidate not yet expanded of every target that has one.
    """
    q = len(targets)
    ids = np.full((q, beam), -1)
    dist = np.full((q, beam), np.inf)
    done = np.ones((q, beam), bool)
    ids[:, 0], done[:, 0] = start, False
    dist[:, 0] = ((targets - points[start]) ** 2).sum(axis=1)
    active = np.arange(q)
    while len(active):
        open_ = np.where(done[active], np.inf, dist[active])
        nearest = open_.argmin(axis=1)
        going = np.isfinite(open_[np.arange(len(active)), nearest])
        active, nearest = active[going], nearest[going]
        if not len(active):
            break
        done[active, nearest] = True
        near = edges[ids[active, nearest]]
        fresh = (near >= 0) & ~(near[:, :, None] == ids[active][:, None, :]).any(axis=2)
        gap = 2 - 2 * np.matmul(points[near], targets[active][:, :, None])[:, :, 0]
        gap = np.where(fresh, gap, np.inf)
        all_dist = np.concatenate([dist[active], gap], axis=1)
        all_ids = np.concatenate([ids[active], near], axis=1)
        all_done = np.concatenate([done[active], ~fresh], axis=1)
        order = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
        dist[active] = np.take_along_axis(all_dist, order, 1)
        ids[active] = np.where(np.isfinite(dist[active]), np.take_along_axis(all_ids, order, 1), -1)
        done[active] = np.take_along_axis(all_done, order, 1)
    return ids, dist


def prune(points: np.ndarray, owners: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Diverse neighbours of every owner from its candidates (-1: none)."""
    own = points[owners]
    gap = 2 - 2 * np.matmul(points[candidates], own[:, :, None])[:, :, 0]
    gap[(candidates < 0) | (candidates == owners[:, None])] = np.inf
    order = np.argsort(gap, axis=1, kind="stable")
    candidates, gap = np.take_along_axis(candidates, order, 1), np.take_along_axis(gap, order, 1)
    repeated = np.zeros_like(gap, bool)
    for k in range(1, gap.shape[1]):
        repeated[:, k] = (candidates[:, :k] == candidates[:, k:k + 1]).any(axis=1)
    gap[repeated] = np.inf
    held = points[candidates]
    kept = np.full((len(owners), degree), -1)
    count = np.zeros(len(owners), int)
    rows = np.arange(len(owners))
    alive = np.isfinite(gap)
    for _ in range(degree):
        first = alive.argmax(axis=1)
        some = alive[rows, first]
        if not some.any():
            break
        kept[rows[some], count[some]] = candidates[rows[some], first[some]]
        count[some] += 1
        between = 2 - 2 * np.matmul(held, held[rows, first][:, :, None])[:, :, 0]
        alive &= ~(some[:, None] & (alpha * alpha * between <= gap))
        alive[rows, first] = False
    return kept


def build(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """Edges of the graph over all points and the medoid, where searches start."""
    n = len(points)
    start = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    edges = np.full((n, degree), -1)
    order = np.random.default_rng(n).permutation(n)
    order = order[order != start]
    low, size = 0, 8
    while low < len(order):
        batch = order[low:low + size]
        found, _ = greedy(points, edges, start, points[batch], beam)
        # points of one batch do not find each other through the graph: they are candidates too
        peers = np.broadcast_to(batch[None, :min(len(batch), 32)], (len(batch), min(len(batch), 32)))
        edges[batch] = prune(points, batch, np.concatenate([found, peers], axis=1), degree, alpha)
        source = np.repeat(batch, degree)
        target = edges[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        touched, first, many = np.unique(target, return_index=True, return_counts=True)
        back = np.full((len(touched), degree + many.max(initial=0)), -1)
        back[:, :degree] = edges[touched]
        column = np.arange(len(target)) - np.repeat(first, many)
        back[np.repeat(np.arange(len(touched)), many), degree + column] = source
        edges[touched] = prune(points, touched, back, degree, alpha)
        low, size = low + len(batch), min(BATCH, size * 2)
    return linked(points, edges, start), start


def reached(edges: np.ndarray, seen: np.ndarray, fresh: np.ndarray) -> None:
    """Mark in ``seen`` all that the points ``fresh`` lead to."""
    seen[fresh] = True
    while len(fresh):
        fresh = np.unique(edges[fresh])
        fresh = fresh[fresh >= 0]
        fresh = fresh[~seen[fresh]]
        seen[fresh] = True


def linked(points: np.ndarray, edges: np.ndarray, start: int) -> np.ndarray:
    """The edges with one more column by which every point can be reached from the start.

    Pruning may leave a point no way in, copies of one direction above all.  Such a point hangs on
    the reached one nearest to it, points on the same one in a chain.
    """
    link = np.full(len(points), -1)
    seen = np.zeros(len(points), bool)
    reached(edges, seen, np.array([start]))
    while not seen.all():
        lost = int(np.flatnonzero(~seen)[0])
        known = np.flatnonzero(seen)
        near = int(known[(points[known] @ points[lost]).argmax()])
        link[lost], link[near] = link[near], lost
        reached(np.concatenate([edges, link[:, None]], axis=1), seen, np.array([lost]))
    return np.concatenate([edges, link[:, None]], axis=1)


def shard_size(points: int, least: int = SHARD, most: int = LARGEST) -> int:
    """Points a shard may hold: eight times the root of the table, within the bounds."""
    return min(max(least, 8 * math.isqrt(points)), max(least, most))


#: A point of a stored graph: its place in the shard, where searches of the shard start, its edges.
GRAPH = "shard int, size int, at int, start int, ids array<long>, v array<double>, edges array<int>"


def index_shard(beam: int):
    """The graph over the points of one shard, a row per point; no edges where all are searched."""

    def run(key, points):
        import pandas as pd

        points = points.sort_values("ids", key=lambda ids: ids.map(lambda x: x[0]))
        vectors = np.stack(points["v"].to_numpy()).astype(np.float64)
        whole = len(vectors) <= beam
        edges, start = (np.zeros((len(vectors), 0), int), 0) if whole else build(unit(vectors))
        return pd.DataFrame({
            "shard": key[0], "size": key[1], "at": np.arange(len(vectors)), "start": start,
            "ids": points["ids"].to_list(), "v": points["v"].to_list(), "edges": list(edges)})

    return run


def search_shard(k: int, beam: int):
    """Search the stored graph of one shard for a block of queries."""

    def run(key, points, queries):
        import pandas as pd

        if not len(points) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        points = points.sort_values("at")
        vectors = np.stack(points["v"].to_numpy()).astype(np.float64)
        wanted = np.stack(queries["v"].to_numpy()).astype(np.float64)
        ids = points["ids"].to_list()
        edges, start = np.stack(points["edges"].to_numpy()), int(points["start"].iloc[0])
        directions, lengths = unit(vectors), np.linalg.norm(vectors, axis=1)
        out = []
        for low in range(0, len(wanted), BATCH):
            part = wanted[low:low + BATCH]
            if len(vectors) <= beam:
                found = np.broadcast_to(np.arange(len(vectors)), (len(part), len(vectors)))
            else:
                found, _ = greedy(directions, edges, start, unit(part), beam)
            for row, (query, target) in enumerate(zip(queries["query_id"].iloc[low:low + BATCH], part)):
                hit = found[row][found[row] >= 0]
                score = vectors[hit] @ target / (lengths[hit] * np.linalg.norm(target))
                best = sorted(((-s, i) for s, h in zip(score, hit) for i in ids[h] if i != query))[:k]
                out += [(query, i, -s) for s, i in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """Vectors without null, non-finite components and not all zero, with an id."""
    value = F.col("embedding")
    finite = F.forall(value, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return vectors.select(F.col("vec_id").cast("long"), value.cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


def index(rows: DataFrame, shards: int, k: int = 5, beam: int = BEAM) -> DataFrame:
    """The stored graphs of ``shards`` shards over ``vec_id`` and ``v``, a row per point (see ``GRAPH``).

    Equal vectors are one point that keeps its ``k + 1`` smallest ids, which are all that can be
    among the ``k`` nearest.
    """
    by_id = Window.partitionBy("v").orderBy("vec_id")
    few = rows.distinct().withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= k + 1)
    points = few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")) \
        .withColumn("size", F.size("v")).withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))
    return written(points.groupBy("shard", "size").applyInPandas(index_shard(beam), GRAPH), "graphs")


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, shard: int = SHARD, beam: int = BEAM,
            block: int = QUERIES) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` nearest found by cosine.

    Queries are the rows whose id is divisible by ``every``; all rows are indexed, a row is not
    its own neighbour.  Ties go to the smaller id.  Null, zero and non-finite vectors and rows
    without an id take no part; vectors of another length than most are searched among their
    kind.  Equal vectors are one point.  A repeated id is one query and one neighbour, by the
    nearest of its vectors.  Further columns are ignored, an empty table gives an empty result.
    """
    rows = usable(vectors)
    total = rows.count()
    shards = max(1, -(-total // shard_size(total, shard)))
    graphs = index(rows, shards, k, beam)
    asked = rows.where(F.col("vec_id") % every == 0).distinct()
    blocks = max(1, -(-asked.count() // block))
    points = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    queries = asked.select(
        F.col("vec_id").alias("query_id"), "v", F.size("v").alias("size"),
        F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    keys = ["shard", "size", "block"]
    found = points.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(
        search_shard(k, beam), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(best)) \
        .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
