"""Toxicity by weak supervision: voters, a label model over them, a linear classifier.

1. Lexicon terms (words, word beginnings, and beginnings that two or three different words share,
   as a syllable that is harmless once may tell when it comes back) that occur in toxic documents
   far more often than chance are taken from a bounded sample of labelled rows outside the
   held-out fold.
2. Families of terms and text patterns are the voters; one pass over the whole texts gives the
   votes and term hits of every document.
3. A log-linear label model of the votes and the hidden label, with pairwise terms for correlated
   voters, is fitted by expectation maximisation on the counts of vote patterns.  The label is
   hidden but for the labelled rows, which anchor the two classes.  There are 2^voters patterns
   however many documents, so its sums are exact.
4. Logistic regression learns the posterior labels (given votes, and the label where it is known)
   from term hits and patterns; it scores all.
"""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelry.llm.common import WORD, crc_bucket, in_parts, labelled_sample, whole_text, written

PREFIXES = (4, 5, 6, 7, 8)
REPEATS = (2, 3)
LEXICON_VOTERS = 10
PATTERNS = (re.compile(r"[!?]{2,}"), re.compile(r"\b[^\W\d_a-z]{4,}\b"))
VOTERS = LEXICON_VOTERS + len(PATTERNS)
PAIRS = 12
PURE = 0.8


def terms_of(word: str) -> list[str]:
    """A word as ``=word`` and its beginnings as ``^beginning``."""
    return ["=" + word, *("^" + word[:n] for n in PREFIXES if len(word) > n)]


def repeated(words: set[str]) -> list[str]:
    """Beginnings that several different words share, as ``2beginning`` and ``3beginning``."""
    from collections import Counter

    shared = Counter(word[:n] for word in words for n in PREFIXES if len(word) > n)
    return [f"{k}{stem}" for stem, n in shared.items() for k in REPEATS if n >= k]


def term_counts(batches):
    """Documents with each term, by label, summed within the batch."""
    from collections import Counter

    import pyarrow as pa

    for given in in_parts(batches):
        counts = (Counter(), Counter())
        for text, toxic in zip(given.column("text").to_pylist(), given.column("toxic").to_pylist()):
            words = set(WORD.findall(text.lower()))
            counts[toxic].update({t for w in words for t in terms_of(w)})
            counts[toxic].update(repeated(words))
        terms = list(counts[0] | counts[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.string()), pa.array([counts[1][t] for t in terms], pa.int64()),
             pa.array([counts[0][t] for t in terms], pa.int64())], names=["term", "pos", "neg"])


def lexicon(sample: DataFrame, terms: int) -> tuple[list[str], list[int], float]:
    """The strongest terms, the voter of each, and the share of toxic rows.

    A term is taken if ``PURE`` of its documents are toxic and chance would give as many at a
    level below 0.05 over all terms (Chernoff bound), most surprising first.
    """
    total = sample.groupBy("toxic").count().collect()
    size = {r["toxic"]: r["count"] for r in total}
    pos, rows = size.get(1, 0), sum(size.values())
    if not pos or pos == rows:
        return [], [], pos / rows if rows else 0.0
    base = pos / rows
    counts = written(sample.select("text", "toxic").mapInArrow(term_counts, "term string, pos long, neg long")
                     .groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "terms")
    n, share = F.col("pos") + F.col("neg"), F.col("pos") / (F.col("pos") + F.col("neg"))
    other = F.when(share < 1, (1 - share) * F.log((1 - share) / F.lit(1 - base))).otherwise(0.0)
    strength = n * (share * F.log(share / F.lit(base)) + other)
    level = math.log(max(1, counts.count()) / 0.05)
    best = counts.where("pos > 0").where((share >= PURE) & (strength > level)) \
        .orderBy(strength.desc(), "term").limit(terms).collect()
    chosen = [r["term"] for r in best]
    family: dict[str, int] = {}
    families = itertools.count()
    for term in sorted(chosen, key=len):
        own = next((family[term[1:n + 1]] for n in PREFIXES if term[1:n + 1] in family), None)
        family.setdefault(term[1:], own if own is not None else next(families) % LEXICON_VOTERS)
    return chosen, [family[t[1:]] for t in chosen], base


def hits(terms: list[str], voter: list[int]):
    """Votes and term hits of every document from its whole text."""
    index = {t: i for i, t in enumerate(terms)}
    stems = {t[1:] for t in terms if t[0] not in "=^"}

    def run(batches):
        import pyarrow as pa

        known: dict[str, tuple[int, ...]] = {}
        alike: dict[str, bool] = {}
        for given in in_parts(batches):
            votes, found = [], []
            for text in given.column("text").to_pylist():
                words = set(WORD.findall(text.lower()))
                if len(known) > 1 << 20:
                    known.clear()
                    alike.clear()
                for word in words.difference(known):
                    known[word] = tuple(index[t] for t in terms_of(word) if t in index)
                    alike[word] = any(len(word) > n and word[:n] in stems for n in PREFIXES)
                again = (index.get(t) for t in repeated({word for word in words if alike[word]}))
                own = sorted({i for word in words for i in known[word]}.union(i for i in again if i is not None))
                mask = 0
                for i in own:
                    mask |= 1 << voter[i]
                for k, pattern in enumerate(PATTERNS):
                    if pattern.search(text):
                        mask |= 1 << (LEXICON_VOTERS + k)
                        own.append(len(terms) + k)
                votes.append(mask)
                found.append(own)
            yield pa.RecordBatch.from_arrays(
                [given.column("doc_id"), given.column("held_out"), pa.array(votes, pa.int32()),
                 pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "held_out", "votes", "hits"])

    return run


class LabelModel:
    """p(y, votes) proportional to exp(a y + sum b_j v_j + sum c_j v_j y + sum d_ij v_i v_j)."""

    def __init__(self, voters: int, base: float):
        self.voters, self.base, self.pairs = voters, base, []
        self.states = (np.arange(1 << voters)[:, None] >> np.arange(voters)) & 1

    def posterior(self) -> np.ndarray:
        """Chance of label 1 for every vote pattern."""
        return 1 / (1 + np.exp(-np.clip(self.log_odds, -30, 30)))

    def fit(self, counts: np.ndarray, known: np.ndarray, rounds: int = 30) -> LabelModel:
        """``counts`` of unlabelled rows by pattern, ``known`` of labelled rows by label and pattern."""
        v = self.states.astype(float)
        self.free, self.fixed = counts, known
        # start: any lexicon vote speaks for label 1, no vote against it
        q = np.where(v[:, :LEXICON_VOTERS].any(axis=1), 0.9, self.base * 0.1)
        q, start = self.independent(v, q, rounds)
        self.pairs = self.correlated(v, q)
        self.log_odds = self.joint(v, q, start, rounds)
        return self

    def shares(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weight of every pattern with label 0 and with label 1; known labels count as they are."""
        total = self.free.sum() + self.fixed.sum()
        return ((self.free * (1 - q) + self.fixed[0]) / total, (self.free * q + self.fixed[1]) / total)

    def independent(self, v, q, rounds):
        """Naive Bayes by expectation maximisation: accuracies without correlations."""
        for _ in range(rounds):
            zero, one = self.shares(q)
            prior = np.clip(one.sum(), 1e-6, 1 - 1e-6)
            hit = (one @ v + 1e-6) / (prior + 2e-6)
            false = (zero @ v + 1e-6) / (1 - prior + 2e-6)
            odds = np.log([hit / false, (1 - hit) / (1 - false)])
            bias = math.log(prior / (1 - prior)) + odds[1].sum()
            q = 1 / (1 + np.exp(-np.clip(bias + v @ (odds[0] - odds[1]), -30, 30)))
        return q, (np.log(false / (1 - false)), np.concatenate([[bias], odds[0] - odds[1]]))

    def correlated(self, v, q):
        """Pairs of voters whose votes go together more than the labels explain."""
        found = {}
        for i, j in itertools.combinations(range(self.voters), 2):
            for w in self.shares(q):
                w = w / max(w.sum(), 1e-12)
                a, b = w @ v[:, i], w @ v[:, j]
                spread = math.sqrt(max(a * (1 - a) * b * (1 - b), 1e-12))
                together = abs(w @ (v[:, i] * v[:, j]) - a * b) / spread
                found[i, j] = max(found.get((i, j), 0), together)
        return [p for p in sorted(found, key=found.get, reverse=True)[:PAIRS] if found[p] > 0.05]

    def joint(self, v, q, start, rounds):
        """Expectation maximisation with gradient steps on the exact joint distribution."""
        both = np.stack([v[:, i] * v[:, j] for i, j in self.pairs], axis=1) if self.pairs else np.zeros((len(v), 0))
        shared = np.concatenate([v, both], axis=1)
        own = np.concatenate([np.ones((len(v), 1)), v], axis=1)
        theta, phi = np.concatenate([start[0], np.zeros(both.shape[1])]), start[1].copy()
        for _ in range(rounds):
            zero, one = self.shares(q)
            seen_shared, seen_own = (zero + one) @ shared, one @ own
            for _ in range(40):
                low = shared @ theta
                high = low + own @ phi
                top = max(low.max(), high.max())
                e0, e1 = np.exp(low - top), np.exp(high - top)
                z = e0.sum() + e1.sum()
                theta += seen_shared - ((e0 + e1) / z) @ shared
                phi += seen_own - (e1 / z) @ own
            q = 1 / (1 + np.exp(-np.clip(own @ phi, -30, 30)))
        return own @ phi


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, terms: int = 2048,
             threshold: float = 0.3) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``score``, ``predicted``, ``votes``.

    Labels are learnt from rows whose crc32(doc_id) mod 4 is not 2; only texts enter the score.
    About ``sample_rows`` labelled ones give the lexicon, its ``terms`` strongest terms; the label
    model counts the votes of all rows, and the classifier is fitted on the posteriors of all.  Null and empty texts are scored like texts without any term.
    A null ``doc_id`` is never held out and never labelled.  Without labels of both kinds every
    score is the share of toxic rows known (0 if none).  Repeated rows are scored alike, further
    columns are ignored, an empty table gives an empty result.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel

    plain = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"),
                        F.coalesce(crc_bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out"))
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("toxic IN (0, 1)")
    known = known.where(crc_bucket("doc_id", 4) != 2)
    chosen, voter, base = lexicon(labelled_sample(plain, known, sample_rows), terms)
    if not chosen:
        return plain.select("doc_id", "held_out", F.lit(float(base)).alias("score"),
                            F.lit(int(base >= threshold)).alias("predicted"), F.lit(0).alias("votes"))
    found = written(plain.mapInArrow(
        hits(chosen, voter), "doc_id long, held_out boolean, votes int, hits array<int>"), "votes")
    train = found.where("NOT held_out")
    counts = np.zeros((3, 1 << VOTERS))
    told = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    train = train.join(told, "doc_id", "left").withColumn("label", F.coalesce("toxic", F.lit(2)))
    patterns = train.groupBy("votes", "label").count()
    for row in patterns.collect():  # at most 3 * 2^VOTERS rows
        counts[row["label"], row["votes"]] = row["count"]
    model = LabelModel(VOTERS, base).fit(counts[2], counts[:2])
    size = len(chosen) + len(PATTERNS)
    # where the label is known it is the posterior, as in the fit of the label model
    posterior = F.when(F.col("label") < 2, F.col("label").cast("double")).otherwise(
        F.element_at(F.lit([float(x) for x in model.posterior()]), F.col("votes") + 1))
    # all rows take part; those with the same hits are one row with their posteriors summed
    alike = train.groupBy("hits").agg(F.sum(posterior).alias("one"), F.count("*").alias("n"))
    to_vector = CountVectorizerModel.from_vocabulary(
        [str(i) for i in range(size)], inputCol="names", outputCol="features", minTF=0.0)
    named = alike.select(F.col("hits").cast("array<string>").alias("names"), F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("one").alias("weight")),
        F.struct(F.lit(0.0).alias("label"), (F.col("n") - F.col("one")).alias("weight")))).alias("at"))
    both = to_vector.transform(named.select("names", "at.*").where("weight > 0")).select("features", "label", "weight")
    both = written(both, "soft")
    fitted = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=60, standardization=False).fit(both)
    weights = F.lit([float(x) for x in fitted.coefficients])
    logit = F.aggregate("hits", F.lit(float(fitted.intercept)), lambda sum_, i: sum_ + F.get(weights, i))
    scored = found.select("doc_id", "held_out", (1 / (1 + F.exp(-logit))).alias("score"), "votes")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "votes")
