"""Quality by perplexity under an interpolated modified Kneser-Ney character model.

The model is trained on all trusted texts.  Its counts are one table of n-grams of every order:
raw counts for the longest, numbers of different left neighbours below, three discounts per
order, and the weight each context gives to the next shorter one.  Documents are dealt to blocks
of bounded size by their id, packed and compressed on the way; a block meets the trusted ids to
count its n-grams, and asks the table only for its own different n-grams to score them, so the
joins carry distinct n-grams and never texts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelry.llm.common import crc_bucket, in_parts, whole_text, written

ORDER = 4
START, END = "\x02", "\x03"
BLOCK_CHARS = 3 << 20
PACKED = 24 << 20
FOLDS = 5
SALTS = 8
DENSE = 1 << 25


def padded(text: str, order: int) -> str:
    return START * (order - 1) + text.lower() + END


def ranked(keys: np.ndarray, size: int) -> tuple[int, np.ndarray]:
    """How many different keys (all below ``size``) there are, and the number of each key among them."""
    if size > DENSE:
        different, number = np.unique(keys, return_inverse=True)
        return len(different), number
    seen = np.zeros(size, bool)
    seen[keys] = True
    different = np.flatnonzero(seen)
    rank = np.empty(size, np.int32)
    rank[different] = np.arange(len(different))
    return len(different), rank[keys].astype(np.int64)


def windows(texts: list[str], order: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct n-grams of padded texts, the number of each at all positions, texts' lengths."""
    parts = [padded(t, order) for t in texts]
    flat = "".join(parts)
    lengths = np.array([len(t) for t in parts], np.int64)
    codes = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letters, codes = ranked(codes, 0x110000)
    kinds, number = letters, codes
    # one character longer at a time, so that keys stay small enough to number by a table
    for k in range(1, order):
        number = number[:-1] * letters + codes[k:]
        kinds, number = ranked(number, kinds * letters)
    starts = np.cumsum(lengths) - lengths
    valid = np.ones(len(number), bool)
    for k in range(1, order):
        edge = starts[1:] - k
        valid[edge[edge < len(number)]] = False
    kinds, number = ranked(number[valid], kinds)
    position = np.empty(kinds, np.int64)
    position[number] = np.flatnonzero(valid)
    grams = [flat[p:p + order] for p in position.tolist()]
    return grams, number, lengths - order + 1


def packed(batches):
    """Texts of one batch and block as one compressed Arrow stream."""
    import pyarrow as pa

    for given in in_parts(batches, chars=PACKED):
        blocks = given.column("block").to_numpy(zero_copy_only=False)
        order = np.argsort(blocks, kind="stable")
        names, first = np.unique(blocks[order], return_index=True)
        rows = given.take(pa.array(order)).select(["doc_id", "lang", "text"])
        data = []
        for low, high in zip(first, [*first[1:], len(order)]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))) as out:
                # a copy of the slice alone, or its neighbours would be written too
                out.write_batch(rows.take(pa.array(np.arange(low, high))))
            data.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(data, pa.binary())], names=["block", "data"])


def unpacked(group):
    import pyarrow as pa

    return pa.concat_tables(pa.ipc.open_stream(d).read_all() for d in group["data"])


def in_blocks(docs: DataFrame, blocks: int) -> DataFrame:
    """Packs by block.  Rows of one id are spread over ``SALTS`` blocks, rows without id over all."""
    row = F.monotonically_increasing_id()
    block = F.when(F.col("doc_id").isNull(), F.pmod(F.hash(row), F.lit(blocks))).otherwise(
        block_of(blocks, F.pmod(F.hash(row), F.lit(SALTS))))
    return docs.withColumn("block", block.cast("int")).mapInArrow(packed, "block int, data binary")


def block_of(blocks: int, salt):
    return F.pmod(F.xxhash64(F.col("doc_id"), salt.cast("int")), F.lit(blocks)).cast("int")


def in_all_blocks(known: DataFrame, blocks: int) -> DataFrame:
    """Trusted ids in every block that may hold one of their rows."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salted = known.select("doc_id", salts.alias("salt"))
    return salted.select("doc_id", block_of(blocks, F.col("salt")).alias("block")).distinct()


def count_grams(order: int):
    """n-gram counts of the trusted texts of one block."""

    def run(packs, trusted):
        import pandas as pd

        if not len(packs) or not len(trusted):
            return pd.DataFrame({"gram": pd.Series([], dtype=object), "n": pd.Series([], dtype="int64")})
        table = unpacked(packs)
        known = set(trusted["doc_id"].tolist())
        texts = [t for i, t in zip(table["doc_id"].to_pylist(), table["text"].to_pylist()) if i in known]
        grams, number, _ = windows(texts, order)
        return pd.DataFrame({"gram": pd.Series(grams, dtype=object), "n": np.bincount(number, minlength=len(grams))})

    return run


def language_model(packs: DataFrame, trusted: DataFrame, order: int = ORDER) -> DataFrame:
    """``gram``, ``p``, ``back``: probability of every seen n-gram of every order given what goes
    before its last character, and the weight of shorter n-grams where it is the context.

    ``p`` is null for what occurs as a context only, that is for start marks."""
    top = written(packs.groupBy("block").cogroup(trusted.groupBy("block"))
                  .applyInPandas(count_grams(order), "gram string, n long")
                  .groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    levels = {order: top}
    for k in range(order - 1, 0, -1):
        # continuation counts: how many different characters stand before it
        longer = levels[k + 1].select("gram") if k + 1 < order else top.select("gram")
        levels[k] = written(longer.groupBy(F.expr(f"substring(gram, 2, {k})").alias("gram"))
                            .agg(F.count("*").alias("n")), "grams")
    lower, tables = None, []
    for k in range(1, order + 1):
        grams = levels[k].withColumn("context", F.expr(f"substring(gram, 1, {k - 1})"))
        seen = {r["n"]: r["c"] for r in grams.where("n <= 4").groupBy("n").agg(F.count("*").alias("c")).collect()}
        n1, n2, n3, n4 = (seen.get(i, 0) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.0
        discounts = [min(float(i), max(0.0, i - (i + 1) * y * b / a)) if a else y * i / 2
                     for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        discount = F.when(F.col("n") == 1, discounts[0]).when(F.col("n") == 2, discounts[1]).otherwise(discounts[2])
        contexts = grams.groupBy("context").agg(
            F.sum("n").alias("total"), F.sum(discount).alias("taken"), F.count("*").alias("types"))
        own = grams.join(contexts, "context")
        alpha, gamma = (F.col("n") - discount) / F.col("total"), F.col("taken") / F.col("total")
        if lower is None:
            # below single characters lies the uniform chance of a seen one or of any other
            kinds = levels[1].count() + 1
            made = own.select("gram", (alpha + gamma / kinds).alias("p"))
            tables.append(contexts.select(
                F.lit("").alias("gram"), F.lit(1.0 / kinds).alias("p"), (F.col("taken") / F.col("total")).alias("back")))
        else:
            suffix = lower.select(F.col("gram").alias("suffix"), F.col("p").alias("shorter"))
            made = own.withColumn("suffix", F.expr(f"substring(gram, 2, {k - 1})")).join(suffix, "suffix") \
                .select("gram", (alpha + gamma * F.col("shorter")).alias("p"))
            back = contexts.select(F.col("context").alias("gram"), gamma.alias("back"))
            # contexts of start marks are no n-grams themselves: they have a weight and no chance
            tables.append(lower.join(back, "gram", "outer").select("gram", "p", F.coalesce("back", F.lit(1.0)).alias("back")))
        lower = written(made, "chances")
    tables.append(lower.select("gram", "p", F.lit(1.0).alias("back")))
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return written(out, "model")


def asked(order: int):
    """The different n-grams of all orders in one block."""

    def run(group):
        import pandas as pd

        grams, _, _ = windows(unpacked(group)["text"].to_pylist(), order)
        every, ends = {""}, set(grams)
        while ends != {""} and ends:
            every |= ends
            every.update([g[:-1] for g in ends])
            ends = {g[1:] for g in ends}
        return pd.DataFrame({"block": group["block"].iloc[0], "gram": pd.Series(list(every), dtype=object)})

    return run


def score(order: int):
    def run(packs, known):
        import pandas as pd

        if not len(packs):
            return pd.DataFrame({"doc_id": pd.Series([], dtype="int64"), "lang": pd.Series([], dtype=object),
                                 "n_chars": pd.Series([], dtype="int64"), "log_p": pd.Series([], dtype=float)})
        docs = unpacked(packs)
        seen = known[known["p"].notna()]
        p = dict(zip(seen["gram"], seen["p"]))
        back = dict(zip(known["gram"], known["back"]))
        grams, number, lengths = windows(docs["text"].to_pylist(), order)

        def chance(gram):
            weight = 1.0
            while True:
                found = p.get(gram)
                if found is not None:
                    return weight * found
                if not gram:
                    return 1e-9
                weight *= back.get(gram[:-1], 1.0)
                gram = gram[1:]

        logs = np.log([chance(g) for g in grams])
        ends = np.cumsum(lengths)
        total = np.concatenate([[0.0], np.cumsum(logs[number])])
        return pd.DataFrame({
            "doc_id": pd.array(docs["doc_id"].to_pylist(), "Int64"), "lang": pd.Series(docs["lang"].to_pylist(), dtype=object),
            "n_chars": lengths - 1, "log_p": (total[ends] - total[ends - lengths]) / lengths})

    return run


def perplexities(packs: DataFrame, model: DataFrame, order: int = ORDER) -> DataFrame:
    """``doc_id``, ``lang``, ``n_chars``, ``log_p`` (mean natural log per character)."""
    wanted = packs.groupBy("block").applyInPandas(asked(order), "block int, gram string")
    known = wanted.join(model, "gram")
    return packs.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(
        score(order), "doc_id long, lang string, n_chars long, log_p double")


def quality(docs: DataFrame, labels: DataFrame, quantile: float = 0.995, order: int = ORDER) -> DataFrame:
    """One row per document: ``doc_id``, ``lang``, ``n_chars``, ``perplexity``, ``threshold``, ``kept``.

    Trusted texts are those labelled quality 1.  The model counts those whose crc32(doc_id) mod
    ``FOLDS`` is not 0; the others, which it has not seen, set the thresholds (all trusted texts,
    if there are no others).  A document is kept if its perplexity is at most that ``quantile`` of
    these texts of its language (of all of them where the language has none).  Null and empty texts have no perplexity and are not kept; without any
    trusted text nothing can be judged and all other documents are kept, perplexity null.
    Repeated rows are scored alike, further columns are ignored, an empty table gives an empty
    result.
    """
    known = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long")).distinct()
    plain = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), whole_text().alias("text"))
    chars = plain.agg(F.sum(F.length("text") + order).alias("c")).first()["c"] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    packs = in_blocks(plain.where("text <> ''"), blocks)
    fold = crc_bucket("doc_id", FOLDS)
    model = language_model(packs, in_all_blocks(known.where(fold != 0), blocks), order)
    trained = not model.where("gram <> ''").isEmpty()
    if not trained:
        nothing = F.lit(None).cast("double")
        return plain.select("doc_id", "lang", F.length("text").cast("long").alias("n_chars"), nothing.alias("perplexity"),
                            nothing.alias("threshold"), (F.col("text") != "").alias("kept"))
    scored = written(perplexities(packs, model, order), "scores").join(
        known.withColumn("trusted", F.lit(True)), "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    unseen = scored.where(F.col("trusted") & (fold == 0))
    limit = F.percentile_approx("log_p", 1 - quantile, 10_000)
    of_all = unseen.agg(limit.alias("limit")).first()["limit"]
    if of_all is None:
        unseen = scored.where("trusted")
        of_all = unseen.agg(limit.alias("limit")).first()["limit"]
    of_language = unseen.groupBy("lang").agg(limit.alias("own_limit"))
    bound = F.coalesce("own_limit", F.lit(of_all))
    named = of_language.withColumnRenamed("lang", "of_lang")
    judged = scored.join(named, F.col("lang").eqNullSafe(F.col("of_lang")), "left").select(
        "doc_id", "lang", "n_chars", F.exp(-F.col("log_p")).alias("perplexity"), F.exp(-bound).alias("threshold"),
        (F.col("log_p") >= bound).alias("kept"))
    empty = plain.where("text = ''").select(
        "doc_id", "lang", F.lit(0).cast("long").alias("n_chars"), F.lit(None).cast("double").alias("perplexity"),
        F.lit(None).cast("double").alias("threshold"), F.lit(False).alias("kept"))
    return judged.unionByName(empty)
