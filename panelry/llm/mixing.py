"""Mixing documents to target weights of domains that are only known softly.

A classifier fitted on labelled rows gives every document its chances of each domain.  The rates
(how often a document is taken) then minimise || sum_i rate_i tokens_i p_i - target ||^2 within
bounds by projected gradient steps.  A step needs the D expected totals and a D x D matrix, sums
over all documents made by task; the rate of a document follows from its own p and the few step vectors so
far, so no state is kept per document and every round is one scan of a narrow table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from panelry.llm.common import fraction, in_parts, labelled_sample, whole_text, written

BYTES = 256
SHAPES = 5


def features(text: str) -> tuple[np.ndarray, int]:
    """Frequencies of the text's bytes, its repetition and lengths, and its number of words."""
    words, lines = text.split(), text.split("\n")
    out = np.zeros(BYTES + SHAPES)
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    if len(raw):
        out[:BYTES] = np.sqrt(np.bincount(raw, minlength=BYTES) / len(raw))
    n = max(1, len(words))
    out[BYTES:] = (1 - len(set(lines)) / len(lines), 1 - len(set(words)) / n, len(raw) / n / 10,
                   np.log1p(len(words)) / 10, len(lines) / n)
    return out, len(words)


def feature_rows(batches):
    import pyarrow as pa

    for given in in_parts(batches):
        rows = [features(t)[0] for t in given.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [given.column("domain"), pa.array(rows, pa.list_(pa.float64()))], names=["domain", "x"])


def posteriors(weights: np.ndarray, bias: np.ndarray):
    def run(batches):
        import pyarrow as pa

        for given in in_parts(batches):
            made = [features(t) for t in given.column("text").to_pylist()]
            if not made:
                continue
            score = np.stack([x for x, _ in made]) @ weights.T + bias
            p = np.exp(score - score.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays(
                [given.column("doc_id"), pa.array([n for _, n in made], pa.int64()),
                 pa.array(list(p), pa.list_(pa.float64()))], names=["doc_id", "n_tokens", "p"])

    return run


def classify(docs: DataFrame, labelled: DataFrame, domains: int, sample_rows: int) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``p``: the chance of each domain, from the whole text."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    plain = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    sample = labelled_sample(plain, labelled, sample_rows).select("domain", "text")
    rows = written(sample.mapInArrow(feature_rows, "domain int, x array<double>"), "features")
    seen = sorted(r["domain"] for r in rows.select("domain").distinct().collect())
    weights, bias = np.zeros((domains, BYTES + SHAPES)), np.full(domains, -50.0)
    if len(seen) > 1:
        code = F.element_at(F.create_map(*[F.lit(x) for i, d in enumerate(seen) for x in (d, float(i))]), F.col("domain"))
        train = rows.select(code.alias("label"), array_to_vector("x").alias("features"))
        fitted = LogisticRegression(family="multinomial", regParam=1e-4, maxIter=60).fit(train)
        weights[seen], bias[seen] = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    else:
        bias[seen or slice(None)] = 0.0
    return plain.mapInArrow(posteriors(weights, bias), "doc_id long, n_tokens long, p array<double>")


def rated(steps: list[np.ndarray], low: float, high: float):
    """Adds the rate after all steps: start at one, move along p, keep to the bounds.

    The steps go to the tasks as numbers: a Spark expression of some hundred nodes a step would be planned
    and compiled anew for every fit, which takes the driver's memory.
    """

    def run(batches):
        import pyarrow as pa

        for given in batches:
            if not given.num_rows:
                continue
            p = given.column("p").flatten().to_numpy(zero_copy_only=False).reshape(given.num_rows, -1)
            rate = np.full(given.num_rows, min(max(1.0, low), high))
            for step in steps:
                move = sum((p[:, d] * float(s) for d, s in enumerate(step)), 0.0)
                rate = np.minimum(np.maximum(rate - move, low), high)
            yield pa.RecordBatch.from_arrays([*given.columns, pa.array(rate)], names=[*given.schema.names, "rate"])

    return run


def sums_of(steps: list[np.ndarray], tried: list[np.ndarray], low: float, high: float):
    """Per task and step tried: the domain totals, the Gram matrix of the free documents, the way moved."""

    def run(batches):
        import pyarrow as pa

        d = len(tried[0])
        out = np.zeros((len(tried), d + d * d + 1))
        for given in batches:
            n = given.column("n_tokens").to_numpy(zero_copy_only=False).astype(float)
            p = given.column("p").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            rate = np.full(len(n), min(max(1.0, low), high))
            for step in steps:
                rate = np.clip(rate - p @ step, low, high)
            for row, step in zip(out, tried):
                moved = np.clip(rate - p @ step, low, high)
                free = n * ((moved > low) & (moved < high))
                row[:d] += (moved * n) @ p
                row[d:-1] += ((p * free[:, None]).T @ p).ravel()
                row[-1] += n @ (moved - rate) ** 2
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(tried)), out.shape[1]), pa.int32()),
             pa.array(np.tile(np.arange(out.shape[1]), len(tried)), pa.int32()), pa.array(out.ravel())],
            names=["tried", "place", "value"])

    return run


def fit_rates(docs: DataFrame, target: list[float], low: float, high: float, rounds: int = 80,
              tolerance: float = 1e-7) -> tuple[DataFrame, float]:
    """Adds ``rate``, and tells how far the expected domain totals stay from the target shares.

    Projected gradient: the objective is a least squares in the totals, documents are weighed by
    their tokens, and a step of one over the largest curvature always lowers it.  Each round tries
    that step, a longer one, and some along the Newton direction of the documents that are free to
    move, all in one scan, and takes whichever lowers the objective most.  It ends when the
    gradient step no longer moves the documents, which only the minimum within the bounds does.
    """
    d = len(target)
    goal = np.array(target, float) / sum(target)
    narrow = docs.select("n_tokens", "p").where("n_tokens > 0")

    def measured(steps, tried):
        rows = narrow.mapInArrow(sums_of(steps, tried, low, high), "tried int, place int, value double")
        out = np.zeros((len(tried), d + d * d + 1))
        for row in rows.groupBy("tried", "place").agg(F.sum("value").alias("value")).collect():
            out[row["tried"], row["place"]] = row["value"]
        return out

    base = narrow.agg(F.sum("n_tokens").alias("t")).first()["t"]
    if not base:
        return docs.withColumn("rate", F.lit(min(max(1.0, low), high))), 0.0
    # with a lowest rate above zero the length of the mix is free: shares of the mix itself
    shape = np.eye(d) - np.outer(goal, np.ones(d)) if low > 0 else np.eye(d)
    aim = np.zeros(d) if low > 0 else goal * base

    def missed(row):
        return shape @ row[:d] - aim

    steps, at = [], measured([], [np.zeros(d)])[0]
    every = np.array([[r["value"] for r in narrow.selectExpr(
        "posexplode(p) AS (j, pj)", "p", "n_tokens").groupBy("j").agg(
        F.sum(F.col("n_tokens") * F.col("pj") * F.col("p")[i]).alias("value")).orderBy("j").collect()] for i in range(d)])
    curvature = np.linalg.eigvalsh(shape @ every @ shape.T).max()
    for _ in range(rounds):
        miss = missed(at)
        if curvature <= 0 or np.abs(miss).sum() <= tolerance * base:
            break
        plain = shape.T @ miss / curvature
        free = shape @ at[d:-1].reshape(d, d) @ shape.T
        newton = shape.T @ (np.linalg.pinv(free, rcond=1e-9, hermitian=True) @ miss)
        tried = [plain, 8 * plain, *[newton * t for t in (1.0, 0.5, 0.2, 0.05)], *[(newton + plain) * t for t in (1.0, 0.3)]]
        found = measured(steps, tried)
        if found[0][-1] <= tolerance ** 2 * base:
            break
        errors = [float(np.linalg.norm(missed(row))) for row in found]
        best = int(np.argmin(errors))
        if errors[best] >= np.linalg.norm(miss):
            break
        steps.append(tried[best])
        at = found[best]
    residual = float(np.abs(missed(at)).sum() / at[:d].sum()) if at[:d].sum() else 0.0
    schema = StructType([*docs.schema.fields, StructField("rate", DoubleType())])
    return docs.mapInArrow(rated(steps, low, high), schema), residual


def mix(docs: DataFrame, labelled: DataFrame, target: list[float], low: float = 0.0, high: float = 4.0,
        sample_rows: int = 20_000, seed: int = 31) -> DataFrame:
    """One row per document: ``doc_id``, ``n_tokens``, ``p``, ``rate``, ``copies``, ``residual``.

    ``labelled`` has ``doc_id`` and ``domain`` (0, 1, ...); the classifier is fitted on about
    ``sample_rows`` of its rows.  ``target`` holds a weight per domain, rates lie in
    [``low``, ``high``].  With ``low`` 0 the targets are shares of the tokens given, so the mix is
    as long as the input where the bounds allow; with a higher ``low`` they are shares of the mix.
    ``copies`` rounds the rate up or down by a fixed chance per document.  ``residual`` is the same
    in all rows: the sum over domains of what the expected totals miss, as a share of the mix.
    Targets that the bounds exclude are approached as far as they allow.  Null and empty texts have no tokens and the
    starting rate's moves; labels without an id or a domain are ignored; repeated rows are rated
    alike; further columns are ignored; an empty table gives an empty result.
    """
    known = labelled.where("domain IS NOT NULL").select("doc_id", F.col("domain").cast("int").alias("domain"))
    rated, residual = fit_rates(written(classify(docs, known, len(target), sample_rows), "posteriors"), target, low, high)
    whole = F.floor("rate")
    return rated.withColumns({
        "copies": (whole + (fraction("doc_id", seed) < F.col("rate") - whole).cast("int")).cast("int"),
        "residual": F.lit(residual),
    })
