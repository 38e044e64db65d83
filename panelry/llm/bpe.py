"""Byte-level BPE: encode by ranked merges, decode by joining the tokens' bytes.

A text is cut by the vocabulary's pattern; each distinct piece of a task is folded once, by
always merging the adjacent pair of lowest rank, and its ids are remembered for the next
occurrence.  The rank map is the only thing sent to the tasks, and its size is the vocabulary's.

``folded_words`` is the same fold of a column of words by higher-order functions over a literal
rank map.  It gives the same ids at some twenty times the cost a word, so texts do not go by it.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelry.llm.common import in_parts, whole_text

SHORT = 48
NONE = 1 << 40
UNRANKED = (1 << 31) - 1
BUCKETS = 1 << 16
REMEMBERED = 1 << 20
#: Pieces already folded by this Python worker, by vocabulary; it serves many tasks.
FOLDED: dict[str, dict[str, bytes]] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and rank from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def digest_of(ranks: dict[bytes, int]) -> str:
    state = hashlib.sha256()
    for piece, rank in ranks.items():
        state.update(b"%d:%d:" % (rank, len(piece)) + piece)
    return state.hexdigest()


def fold_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    get = ranks.get
    parts = [piece[i:i + 1] for i in range(len(piece))]
    pairs = [get(a + b, NONE) for a, b in zip(parts, parts[1:])]
    while pairs:
        best = min(pairs)
        if best == NONE:
            break
        at = pairs.index(best)
        merged = parts[at] + parts.pop(at + 1)
        parts[at] = merged
        del pairs[at]
        if at:
            pairs[at - 1] = get(parts[at - 1] + merged, NONE)
        if at < len(pairs):
            pairs[at] = get(merged + parts[at + 1], NONE)
    return [ranks[part] for part in parts]


def fold_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same fold with a heap of pairs over a linked list: n log n for one endless word."""
    n = len(piece)
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = []

    def push(i):
        j = end[i]
        if j < n:
            rank = ranks.get(piece[i:end[j]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, j, end[j]))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, j, stop = heapq.heappop(heap)
        if not alive[i] or end[i] != j or not alive[j] or end[j] != stop:
            continue
        end[i], alive[j] = stop, False
        if stop < n:
            before[stop] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


def fold(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: a whole token at once, else merges in order of rank, leftmost first."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    return (fold_short if len(piece) <= SHORT else fold_long)(piece, ranks)


def encoder(ranks: dict[bytes, int], pattern: str):
    """A function from text to its ids as little-endian unsigned 32-bit integers."""
    import regex

    pieces = regex.compile(pattern)
    known = FOLDED.setdefault(digest_of(ranks), {})

    def encode(text: str) -> bytes:
        cut = pieces.findall(text)
        for piece in set(cut).difference(known):
            ids = fold(piece.encode("utf-8"), ranks)
            known[piece] = b"".join(i.to_bytes(4, "little") for i in ids)
        out = b"".join(map(known.__getitem__, cut))
        if len(known) > REMEMBERED:
            known.clear()
        return out

    return encode


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of every whole text; null texts have no ids."""
    return _mapped(docs, ranks_path, pattern, "doc_id long, ids array<int>", _ids)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``doc_id`` and ``bytes``: the joined pieces of an ``ids`` column; null ids give no bytes."""
    ranks = read_ranks(ranks_path)

    def run(batches):
        import pyarrow as pa

        token = {rank: piece for piece, rank in ranks.items()}
        for given in batches:
            data = [b"".join(map(token.__getitem__, ids or ())) for ids in given.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [given.column("doc_id"), pa.array(data, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, bytes binary")


def encoding_digest(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per document its number of tokens and the digests of its ids and of its decoded bytes.

    Null and empty texts have no tokens and the digests of nothing.  Repeated rows and ids stay
    as they are, further columns are ignored, an empty table gives an empty result.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _mapped(docs, ranks_path, pattern, schema, _digests)


def _ids(data: list[bytes], _):
    import numpy as np
    import pyarrow as pa

    return {"ids": pa.array([np.frombuffer(d, "<u4").astype("int32") for d in data], pa.list_(pa.int32()))}


def _digests(data: list[bytes], token: list[bytes]):
    import numpy as np

    ids = (np.frombuffer(d, "<u4").tolist() for d in data)
    decoded = [hashlib.sha256(b"".join(map(token.__getitem__, i))).hexdigest() for i in ids]
    return {
        "n_tokens": [len(d) // 4 for d in data],
        "ids_sha256": [hashlib.sha256(d).hexdigest() for d in data],
        "decoded_sha256": decoded,
    }


def _mapped(docs, ranks_path, pattern, schema, columns):
    ranks = read_ranks(ranks_path)

    def run(batches):
        import pyarrow as pa

        token = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            token[rank] = piece
        to_ids = encoder(ranks, pattern)
        for given in in_parts(batches):
            data = [to_ids(text) for text in given.column("text").to_pylist()]
            made = columns(data, token)
            yield pa.RecordBatch.from_arrays(
                [given.column("doc_id"), *(v if isinstance(v, pa.Array) else pa.array(v) for v in made.values())],
                names=["doc_id", *made])

    plain = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    return plain.mapInArrow(run, schema)


def literal_ranks(ranks: dict[bytes, int]) -> Column:
    """The rank map as one literal: an array of small maps from bytes in hex, by their hash.

    A map is searched from its first key, so one map of all tokens would be read through for
    every pair; here a lookup reads about one entry.
    """
    import xxhash

    held: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        key = piece.hex().upper()
        held[xxhash.xxh64_intdigest(key.encode(), seed=42) % BUCKETS][key] = rank
    return F.from_json(F.lit(json.dumps(held)), "array<map<string,int>>")


def rank_of(held: Column, key: Column) -> Column:
    bucket = F.get(held, F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))
    return F.coalesce(F.try_element_at(bucket, key), F.lit(UNRANKED))


def folded(word: Column, held: Column) -> Column:
    """The ids of a word: its bytes, merged pair by pair in order of rank, leftmost first."""
    whole = F.hex(F.encode(word, "utf-8"))
    single = F.regexp_extract_all(whole, F.lit(".."), F.lit(0))
    before_last = F.slice(single, 1, F.greatest(F.size(single) - 1, F.lit(0)))
    pairs = F.zip_with(before_last, F.slice(single, 2, F.size(single)), lambda a, b: rank_of(held, F.concat(a, b)))
    no_rank = F.array().cast("array<int>")

    def merge(state: Column, _: Column) -> Column:
        parts, ranks, lowest = state["parts"], state["ranks"], F.array_min(state["ranks"])
        at, n = F.array_position(ranks, lowest).cast("int"), F.size(parts)
        joined = F.concat(F.element_at(parts, at), F.element_at(parts, at + 1))
        left = F.when(at > 1, F.array(rank_of(held, F.concat(F.get(parts, at - 2), joined)))).otherwise(no_rank)
        right = F.when(at + 1 < n, F.array(rank_of(held, F.concat(joined, F.get(parts, at + 1))))).otherwise(no_rank)
        merged = F.struct(
            F.concat(F.slice(parts, 1, at - 1), F.array(joined), F.slice(parts, at + 2, n)).alias("parts"),
            F.concat(F.slice(ranks, 1, F.greatest(at - 2, F.lit(0))), left, right,
                     F.slice(ranks, at + 2, n)).alias("ranks"))
        return F.when(F.coalesce(lowest, F.lit(UNRANKED)) == UNRANKED, state).otherwise(merged)

    steps = F.sequence(F.lit(1), F.greatest(F.size(single) - 1, F.lit(1)))
    end = F.aggregate(steps, F.struct(single.alias("parts"), pairs.alias("ranks")), merge)
    ids = F.transform(end["parts"], lambda part: rank_of(held, part))
    return F.when(rank_of(held, whole) != UNRANKED, F.array(rank_of(held, whole))).otherwise(ids)


def folded_words(words: DataFrame, ranks_path: str) -> DataFrame:
    """``word`` and ``ids`` of every distinct word of a column ``word``, built-in functions only.

    An empty word has no ids, a null one is left out, further columns are ignored and an empty
    table gives an empty result.  The work of a word grows with the square of its length.
    """
    distinct = words.select("word").where("word IS NOT NULL").distinct()
    held = F.array(literal_ranks(read_ranks(ranks_path)))
    return distinct.select("word", F.get(F.transform(held, lambda ranks: folded(F.col("word"), ranks)), 0).alias("ids"))
