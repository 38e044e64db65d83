"""Exact duplicates by radix tries over whole byte strings.

Documents are equal when their texts are identical after lower-casing A-Z.  Each scan task
inserts its texts into a compressed radix trie whose terminal nodes hold the owner so far, so
however many copies a task sees, it sends on one entry per distinct text.  The entries are dealt
by length and content hash, and a second trie per (length, hash) merges what different tasks
found.  A trie over its byte budget spills its largest subtree; copies that come later simply
open a second entry for the same text, which the merge joins again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelry.llm.common import free_name, whole_text, written

TRIE_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
LOWEST = -(1 << 63)


def shared_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    size = min(len(a), len(b))
    if a[:size] == b[:size]:
        return size
    low, high = 0, 16
    while high < size and a[low:high] == b[low:high]:
        low, high = high, high * 2
    high = min(high, size)
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class Node:
    """An edge label, the children by their first byte, and the owner if a text ends here."""

    __slots__ = ("label", "children", "entry")

    def __init__(self, label: bytes, entry=None):
        self.label, self.children, self.entry = label, {}, entry


class RadixTrie:
    """Compressed trie of byte strings; ``size`` counts the label bytes under each first byte."""

    def __init__(self):
        self.root = Node(b"")
        self.size: dict[int, int] = {}

    def find(self, key: bytes) -> Node:
        """The terminal node of a string, created where missing."""
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                fresh = Node(key[at:])
                node.children[key[at]] = fresh
                self.size[key[0]] = self.size.get(key[0], 0) + len(fresh.label) + 200
                return fresh
            label = child.label
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            common = shared_prefix(label, key[at:at + len(label)])
            middle = Node(label[:common])
            child.label = label[common:]
            middle.children[child.label[0]] = child
            node.children[key[at]] = middle
            self.size[key[0]] += 200
            node, at = middle, at + common
        return node

    def bytes(self) -> int:
        return sum(self.size.values())

    def spill(self) -> Iterator[tuple[bytes, list]]:
        """Take out the largest subtree below the root and return its texts with their owners."""
        first = max(self.size, key=self.size.get)
        del self.size[first]
        yield from walk(self.root.children.pop(first))

    def drain(self) -> Iterator[tuple[bytes, list]]:
        yield from walk(self.root)
        self.root, self.size = Node(b""), {}


def walk(top: Node) -> Iterator[tuple[bytes, list]]:
    stack = [(top, b"")]
    while stack:
        node, before = stack.pop()
        key = before + node.label
        if node.entry is not None:
            yield key, node.entry
        stack.extend((child, key) for child in node.children.values())


ENTRY = "local long, size long, hash long, text binary, best_id long, best_row long, n long"
LOCAL = f"row long, doc_id long, sha string, {ENTRY}"
MERGED = "local long, keep_id long, keep_row long, group_size long"


def better(entry: list, doc_id: int | None, row: int, n: int) -> None:
    """Merge one candidate owner: the largest id wins, null lies below all, then the first row."""
    mine = (LOWEST if entry[0] is None else entry[0], -entry[1])
    if (LOWEST if doc_id is None else doc_id, -row) > mine:
        entry[0], entry[1] = doc_id, row
    entry[2] += n


def local_tries(trie_bytes: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        kinds = {"row": pa.int64(), "doc_id": pa.int64(), "sha": pa.string(), "local": pa.int64(),
                 "size": pa.int64(), "hash": pa.int64(), "text": pa.binary(),
                 "best_id": pa.int64(), "best_row": pa.int64(), "n": pa.int64()}

        def batch(columns: dict, length: int):
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[k], t) if k in columns else pa.nulls(length, t)
                 for k, t in kinds.items()], names=list(kinds))

        def entries(found):
            rows, held = [], 0
            for key, (best_id, best_row, n, local) in found:
                digest = int.from_bytes(hashlib.sha256(key).digest()[:8], "big", signed=True)
                rows.append((local, len(key), digest, key, best_id, best_row, n))
                held += len(key)
                if held > BATCH_BYTES or len(rows) >= 4096:
                    yield batch(dict(zip(list(kinds)[3:], zip(*rows))), len(rows))
                    rows, held = [], 0
            if rows:
                yield batch(dict(zip(list(kinds)[3:], zip(*rows))), len(rows))

        trie = RadixTrie()
        row = TaskContext.get().partitionId() << 33
        for given in batches:
            ids = given.column("doc_id").to_pylist()
            texts = given.column("text").cast(pa.binary()).to_pylist()
            rows, shas, locals_ = [], [], []
            for doc_id, text in zip(ids, texts):
                key = text.lower()
                node = trie.find(key)
                if node.entry is None:
                    node.entry = [doc_id, row, 1, row]
                else:
                    better(node.entry, doc_id, row, 1)
                rows.append(row)
                shas.append(hashlib.sha256(key).hexdigest())
                locals_.append(node.entry[3])
                row += 1
                while trie.bytes() > trie_bytes:
                    yield from entries(trie.spill())
            if rows:
                yield batch({"row": rows, "doc_id": ids, "sha": shas, "local": locals_}, len(rows))
        yield from entries(trie.drain())

    return run


def merge_tries(batches):
    """Rows arrive sorted by length and hash; one small trie at a time is in memory."""
    import pyarrow as pa

    names = ["local", "keep_id", "keep_row", "group_size"]

    def finish(trie, waiting):
        owners = {id(node): node.entry for _, node in waiting}
        return [(local, *owners[id(node)][:3]) for local, node in waiting]

    trie, waiting, at, done = RadixTrie(), [], None, []
    for given in batches:
        columns = [given.column(n).to_pylist()
                   for n in ("local", "size", "hash", "text", "best_id", "best_row", "n")]
        for local, size, digest, text, best_id, best_row, n in zip(*columns):
            if (size, digest) != at:
                done += finish(trie, waiting)
                trie, waiting, at = RadixTrie(), [], (size, digest)
            node = trie.find(text)
            if node.entry is None:
                node.entry = [best_id, best_row, n]
            else:
                better(node.entry, best_id, best_row, n)
            waiting.append((local, node))
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in zip(*done)], names=names)
            done = []
    done = finish(trie, waiting)
    if done:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in zip(*done)], names=names)


def exact_duplicates(docs: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per document: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Of equal texts the row with the largest ``doc_id`` stays.  Null texts count as empty, all
    empty texts are one group.  A null ``doc_id`` lies below every other; rows that repeat both
    id and text keep exactly one of them.  Further columns are ignored, an empty table gives an
    empty result.
    """
    plain = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    found = written(plain.mapInArrow(local_tries(trie_bytes), LOCAL), "tries")
    entries = (
        found.where("n IS NOT NULL").select("local", "size", "hash", "text", "best_id", "best_row", "n")
        .repartition("size", "hash").sortWithinPartitions("size", "hash")
    )
    owners = entries.mapInArrow(merge_tries, MERGED)
    members = found.where("row IS NOT NULL").select("row", "doc_id", "sha", "local")
    return members.join(owners, "local").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns.

    Needs ids that name one row each; rows sharing an id stay or go together with the owner,
    and of rows that repeat id and text one stays.
    """
    lowered = F.translate(whole_text(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def key(sha):
        return F.concat_ws(":", sha, F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null")))

    name = free_name(docs, "own_key")
    kept = exact_duplicates(docs).where("kept").select(key(F.col("text_sha256")).alias(name))
    marked = docs.withColumn(name, key(F.sha2(lowered.cast("binary"), 256)))
    return marked.join(kept, name, "left_semi").dropDuplicates([name]).drop(name)
