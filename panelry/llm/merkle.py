"""A Merkle manifest of documents, and proofs that climb it by a recursive query.

Every document is a leaf.  The leaves of a language, by id, form a tree whose every node is the
hash of two consecutive ones below it; the tops of the languages form the tree of the root.

Levels are built and stored ``STRIDE`` at a time: a node row holds its hash, the siblings on its
way up to the next stored level, and the id of its ancestor there.  ``climb`` is a recursive
query over these rows: one walker per leaf appends the siblings of each row it passes, folds them
into the hash of the tampered document, and goes on to the ancestor until there is none.

What many walkers need at once is small: nodes that hold more than one in ``HEAVY`` of all leaves
are fewer than ``HEAVY`` per stored level, so they are broadcast.  All other nodes are joined by
a shuffle in which no node has more than that share of the walkers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelry.llm.common import written

STRIDE = 8
HEAVY = 4096
#: Upper rows (some 700 bytes each) that are broadcast without looking at their weight.
BROADCAST_ROWS = 16384
TOP = -1
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def framed(value: Column) -> Column:
    """A value with its length in bytes before it; null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """``lang, doc_id, hash, forged``: the leaf, and the one of the tampered row where it differs."""
    fields = [framed(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    more = framed((F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(21,0)"))
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    return docs.select(
        F.col("lang").cast("string").alias("lang"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(digest(*fields)).alias("hash"),
        F.when(tampered, F.unhex(digest(*fields[:3], more, fields[4]))).alias("forged"),
    )


def numbered(rows: DataFrame, group: str, *order: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``pos`` from 0 within each group, and the groups with their ``size``.

    Ranges of the whole order are sorted side by side and shifted by the counts before them, so a
    group of any size is spread over all tasks; the scan position parts rows that are all alike.
    """
    tie = rows.withColumn("tie", F.monotonically_increasing_id())
    keys = [group, *order, "tie"]
    run = tie.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
    run = written(run.withColumn("at", F.monotonically_increasing_id()), "ordered")
    run = run.withColumn("part", F.shiftright("at", 33))
    parts = run.groupBy("part", group).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first"))
    own = parts.select(F.col("part").alias("own_part"), F.col(group).alias("own_group"), "shift")
    same = (F.col("part") == F.col("own_part")) & F.col(group).eqNullSafe(F.col("own_group"))
    placed = run.join(own, same).withColumn("pos", F.col("at") + F.col("shift"))
    sizes = parts.groupBy(group).agg(F.sum("n").alias("size"))
    return placed.drop("at", "part", "own_part", "own_group", "shift"), sizes


def stride_up(nodes: DataFrame) -> DataFrame:
    """Blocks of 2^STRIDE consecutive nodes with every level above them, up to ``height``.

    A block is closed below its bound, so its arrays are as well.
    """
    member = F.struct("pos", "hash", "leaves", "doc_id", "forged")
    blocks = nodes.groupBy("tree", "level", F.shiftright("pos", STRIDE).alias("block")).agg(
        F.max("size").alias("size"), F.sum("leaves").alias("leaves"),
        F.array_sort(F.collect_list(member)).alias("members"),
    )
    # the levels that a tree of this many nodes still has, one stride of them at most
    height = F.when(F.col("size") > 1, F.least(F.lit(STRIDE), F.length(F.bin(F.col("size") - 1)))).otherwise(0)
    blocks = blocks.withColumn("height", height.cast("int"))
    pairs = ("transform(sequence(0, (size(a) - 1) div 2), i -> "
             "sha2(cast(concat(a[2 * i], coalesce(get(a, 2 * i + 1), '')) AS binary), 256))")
    rest = "slice(sequence(0, %d), 1, height)" % (STRIDE - 1)
    levels = (f"aggregate({rest}, array(transform(members, m -> lower(hex(m.hash)))), (levels, level) -> "
              f"concat(levels, transform(slice(levels, -1, 1), a -> {pairs})))")
    blocks = blocks.withColumn("levels", F.expr(levels))
    return blocks.withColumns({
        "top": F.unhex(F.element_at(F.element_at("levels", -1), 1)),
        # half of the nodes, rounded up, as often as levels were built
        "above": F.expr("(size + shiftleft(1L, height) - 1) div shiftleft(1L, height)"),
        "rest": F.expr(rest),
    })


def node_id(tree: Column, level: Column, pos: Column) -> Column:
    return F.concat_ws("/", tree, level, pos)


def links(blocks: DataFrame, total: int) -> DataFrame:
    """Node rows: their hash, the siblings on the way up and the stored ancestor.

    ``up`` has one entry per level, null where a node has no sibling.  The last row of a language
    points into the tree of the tops, the last one there points nowhere.
    """
    rows = blocks.select(
        "tree", "level", "height", "block", "top", "above", F.col("leaves").alias("leaves_above"),
        F.expr(f"""inline(transform(members, m -> struct(m.pos, m.hash, m.leaves, m.doc_id, m.forged,
            transform(rest, i -> get(levels[i], cast(shiftright(m.pos & {(1 << STRIDE) - 1}L, i) ^ 1 AS int)))
            AS up)))"""),
    )
    last, top_tree = F.col("above") == 1, F.col("tree") == TOP
    here = node_id(F.col("tree"), F.col("level") + F.col("height"), F.col("block"))
    into_top = node_id(F.lit(TOP), F.lit(0), F.col("tree"))
    return rows.select(
        node_id(F.col("tree"), F.col("level"), F.col("pos")).alias("id"), "tree", "pos", "hash", "up", "doc_id", "forged",
        (F.col("leaves") * HEAVY > total).alias("heavy"),
        F.when(~last, here).when(~top_tree, into_top).alias("parent"),
        F.col("top").alias("parent_hash"),
        (last & ~top_tree).alias("is_subroot"),
        (F.col("leaves_above") * HEAVY > total).alias("parent_heavy"),
    )


def grow(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """All levels of all trees as block tables, and the tops ``tree, hash, leaves``."""
    built, tops = [], []
    while True:
        blocks = written(stride_up(nodes), "blocks")
        built.append(blocks)
        above = blocks.select(
            "tree", (F.col("level") + F.col("height")).alias("level"), F.col("block").alias("pos"),
            F.col("top").alias("hash"), "leaves", F.col("above").alias("size"),
            F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("forged"),
        )
        tops.append(above.where("size = 1").select("tree", "hash", "leaves"))
        if most <= 1 << STRIDE:
            break
        most = -(-most >> STRIDE)
        nodes = above.where("size > 1")
    found = tops[0]
    for more in tops[1:]:
        found = found.unionByName(more)
    return built, found


FOLD = """aggregate(sequence_of({up}), lower(hex({start})), (h, i) ->
    sha2(cast(CASE WHEN get({up}, i) IS NULL THEN h
                   WHEN (shiftright({pos}, i) & 1) = 1 THEN concat(get({up}, i), h)
                   ELSE concat(h, get({up}, i)) END AS binary), 256))"""


def fold(start: str, up: str, pos: str) -> str:
    """SQL for the hash that ``start`` becomes beside the siblings ``up``."""
    text = FOLD.format(start=start, up=up, pos=pos)
    return "unhex(" + text.replace(f"sequence_of({up})", f"transform({up}, (s, i) -> i)") + ")"


def climb(walkers: DataFrame, upper: DataFrame, heavy_only: bool) -> DataFrame:
    """The recursive query: from every leaf to the root."""
    shown = "n.parent, n.parent_heavy, n.parent_hash, n.is_subroot, n.up, n.pos"
    if heavy_only:
        near = f"SELECT /*+ BROADCAST(n) */ c.*, {shown} FROM climb c JOIN {{heavy}} n ON c.at = n.id"
        light = {}
    else:
        # A walker whose next node is broadcast has a key of its own here, so none of them meet.
        either = ", ".join(f"coalesce(n.{x}, l.{x}) AS {x}" for x in
                           ("parent", "parent_heavy", "parent_hash", "is_subroot", "up", "pos"))
        near = f"""SELECT /*+ BROADCAST(n) */ c.*, {either} FROM climb c
                   LEFT JOIN {{light}} l
                     ON CASE WHEN c.heavy THEN concat_ws('-', c.tree, c.leaf_pos) ELSE c.at END = l.id
                   LEFT JOIN {{heavy}} n ON CASE WHEN c.heavy THEN c.at END = n.id
                   WHERE c.at IS NOT NULL"""
        light = {"light": upper.where("NOT heavy")}
    heavy = upper if heavy_only else upper.where("heavy")
    spark = walkers.sparkSession
    text = f"""
        WITH RECURSIVE climb(doc_id, tree, leaf_pos, leaf, at, heavy, folded, proof, subroot, reached) AS (
          SELECT doc_id, tree, pos, hash, parent, parent_heavy, {fold("coalesce(forged, hash)", "up", "pos")},
                 unhex(array_join(up, '')), CASE WHEN is_subroot THEN parent_hash END, parent_hash
          FROM {{walkers}}
          UNION ALL
          SELECT doc_id, tree, leaf_pos, leaf, parent, parent_heavy, {fold("folded", "up", "pos")},
                 concat(proof, unhex(array_join(up, ''))),
                 CASE WHEN is_subroot THEN parent_hash ELSE subroot END, parent_hash
          FROM ({near}))
        SELECT doc_id, lower(hex(leaf)) AS leaf, lower(hex(subroot)) AS subroot, lower(hex(reached)) AS root,
               sha2(cast(lower(hex(proof)) AS binary), 256) AS proof_sha256,
               lower(hex(folded)) AS folded_root, folded = reached AS verified
        FROM climb WHERE at IS NULL"""
    return spark.sql(text, walkers=walkers, heavy=heavy, **light)


def manifest(docs: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document: its leaf, the roots over it, its proof, and the check of the proof.

    ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.  The proof is that of
    the untampered documents; ``folded_root`` is what it gives with the tampered leaf where the row
    was tampered with (7 divides the crc32 of its id), and ``verified`` tells whether that is the
    root.  Rows without id come first in their language and are never tampered with; a null count
    of characters stays null, so its row verifies.  Rows sharing an id are ordered by their leaf;
    rows alike in every field have the same leaf and places of their own.  A null language is a
    language.  Empty tables give no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    own = written(leaves(docs), "leaves")
    placed, sizes = numbered(own, "lang", "doc_id", "hash")
    languages, _ = numbered(sizes.withColumn("every", F.lit(0)), "every", "lang")
    languages = written(languages.select("lang", "size", F.col("pos").alias("tree")), "languages")
    total, most, trees = languages.agg(
        F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0)), F.count("*")
    ).first()
    named = languages.select(F.col("lang").alias("tree_lang"), "size", "tree")
    nodes = placed.join(named, F.col("lang").eqNullSafe(F.col("tree_lang"))).select(
        "tree", F.lit(0).alias("level"), "pos", "hash", F.lit(1).cast("long").alias("leaves"), "size", "doc_id", "forged"
    )
    built, tops = grow(nodes, most)
    top_nodes = tops.select(
        F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("pos"), "hash", "leaves",
        F.lit(trees).cast("long").alias("size"), F.lit(None).cast("long").alias("doc_id"),
        F.lit(None).cast("binary").alias("forged"),
    )
    top_built, _ = grow(top_nodes, trees)

    upper = None
    for blocks in [*built[1:], *top_built]:
        rows = links(blocks, total).drop("tree", "hash", "doc_id", "forged")
        upper = rows if upper is None else upper.unionByName(rows)
    upper = written(upper, "nodes")
    heavy_only = upper.count() <= broadcast_rows
    before = spark.conf.get(ROW_LIMIT, None)
    spark.conf.set(ROW_LIMIT, "-1")  # one row per leaf and step
    try:
        return written(climb(links(built[0], total), upper, heavy_only), "manifest")
    finally:
        spark.conf.set(ROW_LIMIT, before) if before is not None else spark.conf.unset(ROW_LIMIT)
