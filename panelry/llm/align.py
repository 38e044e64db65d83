"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes.

A text is cut by a byte-level vocabulary (A) and by a piece vocabulary with byte fallback (B).
Byte offsets where tokens of both end are found by a galloping intersection: the shorter list of
ends drives an exponential and then a binary search into the longer one, all its ends at once.
The common ends slice both token lists into groups; how far the ranks advance between two of
them is the size of a group on either side, and every A token of a group is linked with every B.

Counts of linked id pairs cover the corpus.  Tasks cut their documents into chunks of bounded
bytes, and a chunk asks for each of its distinct pairs once, with the number of its documents
that hold it; the answers go back to the chunk, whose documents lie packed in the shared folder.
So neither links nor pairs of documents are shuffled, only the distinct pairs of chunks.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelry.llm.common import in_parts, whole_text, written

CHUNK_BYTES = 16 << 20
PART_BYTES = 2 << 20
#: Links expanded at once; a group of more is counted by its distinct ids instead.
EXPANDED = 1 << 22
WIDE = 1 << 12

READ = "chunk long, docs binary, pairs binary, pair int, a int, b int, holding int"
LINKED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Vocabularies built in this Python worker, by the digest of their files.
LOADED: dict[tuple[str, str], tuple] = {}


# -- the two vocabularies --------------------------------------------------------


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes.

    Fixed rule: printable Latin-1 signs stand for themselves, all other bytes for the letters
    from U+0100 on, in their order.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def byte_level_tokens(data: bytes) -> dict[bytes, int]:
    """Token bytes and ids of a byte-level BPE file, special tokens left out.

    Merges must be numbered like the tokens they make: then merging by rank of the token made,
    as the encoder does, is merging in the order of the file.
    """
    file = json.loads(data)
    special = {t["content"] for t in file.get("added_tokens", ())}
    vocabulary, letters = file["model"]["vocab"], byte_letters()
    made = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in file["model"]["merges"]]
    if any(a >= b for a, b in zip(made, made[1:])):
        raise ValueError("the merges of the vocabulary are not in the order of its ids")
    return {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if token not in special}


def piece_bytes(model, i: int) -> bytes:
    piece = model.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()


def text_table(tokens: list[bytes]):
    import pyarrow as pa

    return pa.array(tokens, pa.large_binary())


def vocabularies(a_file: bytes, b_file: bytes):
    """Encoders of both, tables of their tokens' bytes, and the table that writes groups."""
    import pyarrow as pa
    import sentencepiece
    import tiktoken
    from tokenizers import Tokenizer

    name = hashlib.sha256(a_file).hexdigest(), hashlib.sha256(b_file).hexdigest()
    if name not in LOADED:
        ranks = byte_level_tokens(a_file)
        ranked = tiktoken.Encoding(name[0], pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

        @cache
        def library():
            whole = Tokenizer.from_str(a_file.decode())
            whole.encode_special_tokens = True
            return whole

        def first(text: str) -> np.ndarray:
            try:
                return ranked.encode_to_numpy(text, disallowed_special=())
            except ValueError:  # its pattern gives up on runs of a million blanks
                return np.array(library().encode(text, add_special_tokens=False).ids, np.uint32)

        second = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        a_tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            a_tokens[i] = token
        b_tokens = [piece_bytes(second, i) for i in range(second.get_piece_size())]
        size = max(len(a_tokens), len(b_tokens))
        # an id is followed by a comma within its side of a group, by a bar after A and a semicolon after B
        shown = pa.array([f"{i}{mark}".encode() for mark in ",|;" for i in range(size)], pa.large_binary())
        LOADED[name] = first, second, text_table(a_tokens), text_table(b_tokens), shown, size
    return LOADED[name]


def joined(table, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """Bytes of the entries ``ids`` one after another, and where each begins (and the last ends)."""
    import pyarrow as pa

    taken = table.take(pa.array(ids, pa.int64()))
    if not len(taken):
        return memoryview(b""), np.zeros(1, np.int64)
    _, ends, data = taken.buffers()
    return memoryview(data or b"").cast("B"), np.frombuffer(ends, np.int64, len(taken) + 1, taken.offset * 8)


# -- alignment -------------------------------------------------------------------


def gallop(short: np.ndarray, long: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each of ``short`` the first place of ``long`` that is not below it, from a guess on.

    Steps double away from the guess until the value is passed, then the last step is halved.
    """
    low, high = start.copy(), start.copy()
    below = long[start] < short
    away, step = np.flatnonzero(below), 1
    while len(away):
        low[away] = high[away]
        high[away] = np.minimum(high[away] + step, len(long) - 1)
        away = away[(long[high[away]] < short[away]) & (high[away] < len(long) - 1)]
        step *= 2
    away, step = np.flatnonzero(~below), 1
    while len(away):
        high[away] = low[away]
        low[away] = np.maximum(low[away] - step, 0)
        away = away[(long[low[away]] >= short[away]) & (low[away] > 0)]
        step *= 2
    # the place lies in [low, high]
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        less = long[middle] < short[open_]
        low[open_] = np.where(less, middle + 1, low[open_])
        high[open_] = np.where(less, high[open_], middle)
        open_ = open_[low[open_] < high[open_]]
    return low


def common_ends(a_ends: np.ndarray, b_ends: np.ndarray, a_n: np.ndarray, b_n: np.ndarray):
    """Ranks in both lists of the ends they share; both must rise strictly to the same last end.

    ``a_n`` and ``b_n`` tell how many tokens each text has, for a first guess within the text.
    """
    turned = len(b_ends) < len(a_ends)
    short, long = (b_ends, a_ends) if turned else (a_ends, b_ends)
    if not len(short):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n, m = (b_n, a_n) if turned else (a_n, b_n)
    at = np.arange(len(short)) - np.repeat(np.cumsum(n) - n, n)
    guess = np.repeat(np.cumsum(m) - m, n) + at * np.repeat(m, n) // np.repeat(n, n)
    place = gallop(short, long, guess)
    same = np.flatnonzero(long[place] == short)
    return (place[same], same) if turned else (same, place[same])


def linked_pairs(code: np.ndarray, a: np.ndarray, b: np.ndarray, size: int, a_first, a_n, b_first, b_n):
    """Distinct (document, pair) codes and their link occurrences, over all groups.

    ``code`` is the document of each group; a code is ``(document * size + a) * size + b``.
    """
    codes, times = [], []
    links = a_n * b_n
    single = links == 1
    codes.append((code[single] * size + a[a_first[single]]) * size + b[b_first[single]])
    times.append(np.ones(len(codes[0]), np.int64))
    some = np.flatnonzero(~single & (links <= WIDE))
    cuts = np.searchsorted(np.cumsum(links[some]), np.arange(EXPANDED, links[some].sum() + EXPANDED, EXPANDED))
    for part in np.split(some, np.unique(cuts)):
        n = links[part]
        group = np.repeat(part, n)
        at = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
        row, column = np.divmod(at, b_n[group])
        codes.append((code[group] * size + a[a_first[group] + row]) * size + b[b_first[group] + column])
        times.append(np.ones(len(group), np.int64))
    for g in np.flatnonzero(links > WIDE):
        a_ids, a_times = np.unique(a[a_first[g]:a_first[g] + a_n[g]], return_counts=True)
        b_ids, b_times = np.unique(b[b_first[g]:b_first[g] + b_n[g]], return_counts=True)
        codes.append(((code[g] * size + a_ids)[:, None] * size + b_ids).ravel())
        times.append((a_times[:, None] * b_times).ravel())
    code, times = np.concatenate(codes), np.concatenate(times)
    if len(code) and times.max() == 1:
        return np.unique(code, return_counts=True)
    order = np.argsort(code)
    code, times = code[order], times[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    return code[first], np.add.reduceat(times, first) if len(first) else times


def aligned(texts: list[bytes], tools) -> tuple[dict, np.ndarray, np.ndarray]:
    """Columns of these texts (UTF-8), and their distinct pair codes with link occurrences."""
    first, second, a_table, b_table, shown, size = tools
    plain = [t.decode() for t in texts]
    a_ids = [first(f" {t}") if t else np.zeros(0, np.uint32) for t in plain]
    b_lists = second.encode(plain, num_threads=1)
    b_ids = [np.fromiter(ids, np.int64, len(ids)) if t else np.zeros(0, np.int64) for t, ids in zip(plain, b_lists)]
    a_n, b_n = (np.array([len(x) for x in ids], np.int64) for ids in (a_ids, b_ids))
    a, b = (np.concatenate([*ids, np.zeros(0, np.int64)]).astype(np.int64) for ids in (a_ids, b_ids))
    whole = np.zeros(len(texts), bool)
    (a_bytes, a_at), (b_bytes, b_at) = joined(a_table, a), joined(b_table, b)
    a_cut, b_cut = np.append(0, np.cumsum(a_n)), np.append(0, np.cumsum(b_n))
    for i, text in enumerate(texts):
        source = b" " + text
        whole[i] = bool(text) and (source == a_bytes[a_at[a_cut[i]]:a_at[a_cut[i + 1]]]
                                   and source == b_bytes[b_at[b_cut[i]]:b_at[b_cut[i + 1]]])
    a_keep, b_keep = np.repeat(whole, a_n), np.repeat(whole, b_n)
    a, b = a[a_keep], b[b_keep]
    a_n, b_n = np.where(whole, a_n, 0), np.where(whole, b_n, 0)
    # texts follow one another, so ends of one text can only meet ends of the same
    a_last, b_last = common_ends(np.cumsum(np.diff(a_at)[a_keep]), np.cumsum(np.diff(b_at)[b_keep]), a_n, b_n)
    a_first, b_first = np.append(0, a_last[:-1] + 1)[:len(a_last)], np.append(0, b_last[:-1] + 1)[:len(b_last)]
    a_wide, b_wide = a_last - a_first + 1, b_last - b_first + 1
    of_text = np.repeat(np.arange(len(texts)), a_n)[a_last]
    per_text = np.zeros(len(texts), np.int64)
    np.add.at(per_text, of_text, a_wide * b_wide)
    codes, times = linked_pairs(of_text, a, b, size, a_first, a_wide, b_first, b_wide)

    # the written form: A tokens of a group, then its B tokens, each with the mark behind it
    order = np.empty(len(a) + len(b), np.int64)
    a_mark, b_mark = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    a_mark[a_last], b_mark[b_last] = size, 2 * size
    order[np.arange(len(a)) + np.repeat(b_first, a_wide)] = a + a_mark
    order[np.arange(len(b)) + np.repeat(a_last + 1, b_wide)] = b + b_mark
    line, at = joined(shown, order)
    cut = np.append(0, np.cumsum(a_n + b_n))
    groups = [bytes(line[at[s]:at[e] - 1]) if e > s else b"" for s, e in zip(cut, cut[1:])]
    columns = {"n_a": a_n, "n_b": b_n, "n_groups": np.bincount(of_text, minlength=len(texts)), "n_links": per_text,
               "groups": groups}
    return columns, codes, times


# -- chunks ----------------------------------------------------------------------


def packed(table) -> bytes:
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes):
    import pyarrow as pa

    return pa.ipc.open_stream(data).read_all()


class Chunk:
    """Documents of a task until they are enough: their columns and their distinct pairs."""

    def __init__(self):
        self.bytes, self.docs, self.codes, self.times = 0, [], [], []

    def add(self, ids, columns: dict, codes, times, size: int, shown) -> None:
        import pyarrow as pa

        done = sum(d.num_rows for d in self.docs)
        self.docs.append(pa.table({"doc_id": ids, **{k: pa.array(v) for k, v in columns.items() if k != "groups"},
                                   "groups": pa.array([shown(g) for g in columns["groups"]])}))
        self.codes.append(codes + done * size * size)
        self.times.append(times)

    def rows(self, number: int, size: int):
        """The packed documents, then a row per distinct pair: pairs held most often come first."""
        import pyarrow as pa

        codes, times = np.concatenate(self.codes), np.concatenate(self.times)
        docs = pa.concat_tables(self.docs)
        text, pair = np.divmod(codes, size * size)
        distinct, at, holding = np.unique(pair, return_inverse=True, return_counts=True)
        order = np.argsort(-holding, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        rank = rank[at]
        sorted_ = np.lexsort((rank, text))
        rank, text, times = rank[sorted_], text[sorted_], times[sorted_]
        step = np.diff(rank, prepend=0)
        begins = np.flatnonzero(np.diff(text, prepend=-1))
        step[begins] = rank[begins]
        held = np.bincount(text, minlength=docs.num_rows)
        docs = docs.append_column("held", pa.array(held))
        pairs = pa.table({"step": pa.array(step.astype(np.uint32)), "times": pa.array(times.astype(np.uint32))})
        yield batch(chunk=[number], docs=[packed(docs)], pairs=[packed(pairs)])
        a, b = np.divmod(distinct[order], size)
        for low in range(0, len(order), 1 << 16):
            part = slice(low, min(low + (1 << 16), len(order)))
            n = part.stop - low
            yield batch(chunk=np.full(n, number), pair=np.arange(low, part.stop, dtype=np.int32), a=a[part].astype(np.int32),
                        b=b[part].astype(np.int32), holding=holding[order][part].astype(np.int32))


def batch(**columns):
    import pyarrow as pa

    kinds = {"chunk": pa.int64(), "docs": pa.binary(), "pairs": pa.binary(), "pair": pa.int32(), "a": pa.int32(),
             "b": pa.int32(), "holding": pa.int32()}
    n = len(columns["chunk"])
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in kinds.items()], names=list(kinds))


def hashed(groups: bytes) -> str:
    return hashlib.sha256(groups).hexdigest() if groups else ""


def as_text(groups: bytes) -> str:
    return groups.decode()


def to_chunks(a_file: bytes, b_file: bytes, shown, chunk_bytes: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        tools = vocabularies(a_file, b_file)
        size, number = tools[-1], itertools.count(TaskContext.get().partitionId() << 33)
        chunk = Chunk()
        for given in in_parts(batches, chars=PART_BYTES):
            texts = given.column("text").cast(pa.binary()).to_pylist()
            columns, codes, times = aligned(texts, tools)
            chunk.add(given.column("doc_id"), columns, codes, times, size, shown)
            chunk.bytes += sum(map(len, texts)) + 64 * len(texts)
            if chunk.bytes >= chunk_bytes:
                yield from chunk.rows(next(number), size)
                chunk = Chunk()
        if chunk.docs:
            yield from chunk.rows(next(number), size)

    return run


def answered(chunk, answers):
    """The documents of a chunk with the counts of their pairs summed."""
    import pyarrow as pa

    outs = []
    count, best = np.zeros(answers.num_rows, np.int64), np.zeros(answers.num_rows, np.int64)
    at = answers.column("pair").to_numpy()
    count[at], best[at] = answers.column("documents").to_numpy(), answers.column("best").to_numpy()
    for row in chunk.to_pylist():
        docs, pairs = unpacked(row["docs"]), unpacked(row["pairs"])
        held = docs.column("held").to_numpy()
        rank = np.cumsum(pairs.column("step").to_numpy().astype(np.int64))
        ends = np.cumsum(held)
        # steps begin anew in every document
        before = np.append(0, rank)[ends - held]
        rank -= np.repeat(before, held)
        times = pairs.column("times").to_numpy().astype(np.int64)
        sums = {}
        for name, value in (("n_best", best), ("count_sum", count)):
            running = np.append(0, np.cumsum(times * value[rank]))
            sums[name] = running[ends] - running[ends - held]
        outs.append(pa.table({**{c: docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")},
                              **{k: pa.array(v) for k, v in sums.items()}, "groups": docs.column("groups")}))
    return pa.concat_tables(outs)


def align(docs: DataFrame, a_path: str, b_path: str, digest: bool = False, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per document: tokens, groups and links of two vocabularies, with corpus-wide counts.

    ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups``.  ``groups`` is the
    alignment, as ``a1,a2|b1;a3|b2,b3`` (ids in order), or its sha256 with ``digest``.  A pair of
    ids counts once per row that holds it linked; ``n_best`` are the links whose pair counts as
    much as the best pair of their A id, ties included, ``count_sum`` is the sum over links.
    Texts that are null or empty, or whose tokens do not spell a space and the text, have zeros
    and no groups.  Repeated rows and ids count each; further columns are ignored; an empty table
    gives no rows.
    """
    with open(a_path, "rb") as a, open(b_path, "rb") as b:
        a_file, b_file = a.read(), b.read()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    read = written(rows.mapInArrow(to_chunks(a_file, b_file, hashed if digest else as_text, chunk_bytes), READ), "chunks")
    asked = read.where("a IS NOT NULL").select("chunk", "pair", "a", "b", "holding")
    same = Window.partitionBy("a", "b")
    counted = asked.select("chunk", "pair", "a", F.sum("holding").over(same).alias("documents"))
    # one row per A id: never more than the vocabulary has
    top = counted.groupBy("a").agg(F.max("documents").alias("most"))
    answers = counted.join(F.broadcast(top), "a").select(
        F.col("chunk").alias("of_chunk"), "pair", "documents", (F.col("documents") == F.col("most")).cast("int").alias("best"))
    packs = read.where("docs IS NOT NULL").select("chunk", "docs", "pairs")
    return packs.groupBy("chunk").cogroup(answers.groupBy("of_chunk")).applyInArrow(answered, LINKED)
