"""Operator 4: mixing to target weights with soft memberships.

A classifier learned from the labels gives each document a posterior over the
domains.  Document rates r >= 0 are fitted so that the expected tokens of each
domain, sum of r * tokens * posterior, match the targets: projected gradient
steps on the least squares, each a distributed sum over all documents.  A rate
follows from the posterior alone, so that documents alike are treated alike.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.llm.common import small_batches, table, unit_hash, utf8, worker_cache
from aerolake.llm.grams import Grams, grams
from aerolake.llm.quality import gram_counts
from aerolake.llm.tokens import WordIds
from aerolake.llm.toxicity import logistic
from aerolake.runtime import broadcastable, materialize

#: The domains of the labels, and the share of tokens that each is to have.
DOMAINS = ("good", "poor", "toxic")
TARGETS = {"good": 0.985, "poor": 0.005, "toxic": 0.01}
#: The classifier's features: stems of so many bytes, hashed to buckets, no bigrams.
KIND = (1 << 15, 5, False)
#: Copies of a document, at most.
MOST = 4.0
#: Pseudo-counts of a bucket; labelled documents that calibrate the classifier, at most; decimals of a posterior.
PRIOR, CALIBRATE, DECIMALS, SEED = 5.0, 20_000, 3, 4


def domain_of() -> Column:
    """A labels row's domain as an index of DOMAINS; null for other labels."""
    return F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)


class Chunks:
    """Token counts and stem buckets of texts in one pass: a blank-separated chunk's are worked out once and remembered.

    Chunks hold whole stems and whole tokens, so both follow from those of the chunks.
    """

    def __init__(self, path: str, most: int = 300_000):
        self.ids, self.grams, self.most = WordIds(path, most), Grams(*KIND), most
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.tokens, self.sizes, self.starts, self.stems = (np.zeros(0, np.int64) for _ in range(4))

    def _learn(self, chunks: list[bytes]) -> None:
        for first in range(0, len(chunks), 10_000):
            self.ids._learn(chunks[first : first + 10_000])
        stems = [self.grams.hashes(c).astype(np.int64) for c in chunks]
        sizes = np.array([len(s) for s in stems], np.int64)
        base = len(self.known)
        self.known.update((c, base + k) for k, c in enumerate(chunks))
        self.tokens = np.append(self.tokens, [len(self.ids.known[c]) // 4 for c in chunks])
        self.ids.known.clear()
        self.starts = np.append(self.starts, len(self.stems) + np.cumsum(sizes) - sizes)
        self.sizes = np.append(self.sizes, sizes)
        self.stems = np.concatenate([self.stems, *stems])

    def of(self, raws: list[bytes]) -> list[tuple[int, np.ndarray]]:
        """By text, the number of token ids and the buckets that ``Grams.of`` gives; what is new in them is worked out together."""
        split = [self.ids.chunks(raw) for raw in raws]
        if missing := set().union(*split) - self.known.keys():
            if len(self.known) + len(missing) > self.most:
                self._forget()
                missing = set().union(*split)
            self._learn(list(missing))
        known, found = self.known, []
        for chunks in split:
            at = np.array([known[c] for c in chunks], np.int64)
            n = self.sizes[at]
            place = np.arange(n.sum()) + np.repeat(self.starts[at] - np.cumsum(n) + n, n)
            found.append((int(self.tokens[at].sum()), self.grams.buckets_of(self.stems[place].astype(np.uint64))))
        return found


class Classifier:
    """Hashed stems' log ratios of each domain to all, calibrated one domain against the rest."""

    def __init__(self, ratios: np.ndarray, fits: list):
        self.ratios, self.fits = ratios, fits

    def features(self, buckets: list[np.ndarray]) -> np.ndarray:
        """Of texts' stem buckets, by domain: the mean ratio, how much telling stems tell, and that by length; then the length."""
        rows = []
        for own in buckets:
            r = self.ratios[:, own]
            n, telling = max(1, r.shape[1]), np.maximum(r - 1, 0).sum(axis=1)
            rows.append(np.concatenate((r.sum(axis=1) / n, np.log1p(telling), 10 * np.minimum(telling / n, 0.1), [np.log1p(n)])))
        return np.array(rows).reshape(len(buckets), 3 * len(self.ratios) + 1)

    def posteriors(self, buckets: list[np.ndarray]) -> np.ndarray:
        """Rows over the domains; a domain without labels has 0."""
        x = self.features(buckets)
        p = np.zeros((len(buckets), len(self.fits)))
        for c, fit in enumerate(self.fits):
            if isinstance(fit, float):
                p[:, c] = fit
            elif fit is not None:
                centre, scale, w, bias = fit
                p[:, c] = 1 / (1 + np.exp(-np.clip((x - centre) / scale @ w + bias, -40, 40)))
        return p / p.sum(axis=1, keepdims=True)


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """Of each bucket, how much more a domain (row) holds it than all do, with PRIOR pseudo-counts."""
    all_ = counts.sum(axis=0)
    expected = all_ * (counts.sum(axis=1, keepdims=True) / max(1.0, all_.sum()))
    return np.log((counts + PRIOR) / (expected + PRIOR))


def learn(docs: DataFrame, labels: DataFrame, calibrate: int = CALIBRATE) -> Classifier | None:
    """Ratios from all labelled documents; calibrated on at most ``calibrate`` of them, each half under the other half's ratios.

    None where nothing is labelled.
    """
    marks = labels.select("doc_id", domain_of().alias("domain")).where("domain is not null").groupBy("doc_id").agg(F.max("domain").alias("domain"))
    marks = marks.withColumn("half", F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(2)).cast("int"))
    known = docs.select("doc_id", "text").join(F.broadcast(marks) if broadcastable(marks, 28) else marks, "doc_id")
    counts = gram_counts(known.select("text", (F.col("domain") * 2 + F.col("half") + 1).alias("class")), 2 * len(DOMAINS) + 1, *KIND)[1:]
    halves = [log_ratios(counts[h::2]) for h in (0, 1)]
    chosen = marks.orderBy(F.xxhash64(F.lit(SEED + 1), "doc_id"), "doc_id").limit(calibrate)
    some = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``calibrate`` rows
    model = Classifier(log_ratios(counts[0::2] + counts[1::2]), [])

    def of_batches(batches):
        own = [Classifier(r, []) for r in halves]
        for batch in batches:
            x = [own[1 - h].features([grams(*KIND).of(raw)])[0] for raw, h in zip(utf8(batch.column(1)), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(x, pa.list_(pa.float64())), batch.column(2).cast(pa.int32())], ["doc_id", "x", "domain"])

    small_batches(docs.sparkSession)
    rows = some.select("doc_id", "text", "domain", "half").mapInArrow(of_batches, "doc_id long, x array<double>, domain int").toPandas().sort_values("doc_id")
    if not len(rows):
        return None
    x, y = np.array(rows["x"].tolist()), rows["domain"].to_numpy()
    present = [c for c in range(len(DOMAINS)) if (y == c).any()]
    model.fits = [None if c not in present else 1.0 if len(present) == 1 else logistic(x, (y == c).astype(float)) for c in range(len(DOMAINS))]
    return model


def memberships(docs: DataFrame, model: Classifier | None, decimals: int = DECIMALS, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, tokens, p array) of every row; tokens are blank-separated words, or the vocabulary's ids if one is given.

    The posterior is rounded, so documents come in a bounded number of kinds.
    """
    ratios, fits = (model.ratios, model.fits) if model else (None, None)
    unit = 10**decimals

    def of_batches(batches):
        own = Classifier(ratios, fits) if fits else None
        chunks = worker_cache(("chunks", vocabulary, KIND), lambda: Chunks(vocabulary)) if vocabulary else None
        for batch in batches:
            raws = utf8(batch.column(1))
            counted = chunks.of(raws) if chunks else [(len(raw.split()), grams(*KIND).of(raw)) for raw in raws]
            p = own.posteriors([b for _, b in counted]) if own and counted else np.tile([1.0] + [0.0] * (len(DOMAINS) - 1), (len(counted), 1))
            whole = np.floor(p * unit).astype(int)
            whole[np.arange(len(p)), p.argmax(axis=1)] += unit - whole.sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([n for n, _ in counted], pa.int64()), pa.array(list(whole / unit), pa.list_(pa.float64()))], ["doc_id", "tokens", "p"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(of_batches, "doc_id long, tokens long, p array<double>")


def rate_of(p: Column, steps: list[list[float]], most: float | None) -> Column:
    """The rate after projected gradient steps from 1: each takes p . step away and projects to [0, most]."""

    def step(rate: Column, by: list[float]) -> Column:
        moved = rate - reduce(lambda a, b: a + b, [F.element_at(p, d + 1) * F.lit(float(v)) for d, v in enumerate(by)])
        moved = F.greatest(F.lit(0.0), moved)
        return moved if most is None else F.least(F.lit(float(most)), moved)

    def dot(by: Column) -> Column:
        return F.aggregate(F.zip_with(p, by, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)

    if not steps:
        return F.lit(1.0)
    if len(steps) == 1:
        return step(F.lit(1.0), steps[0])
    all_ = F.array(*[F.array(*[F.lit(float(v)) for v in s]) for s in steps])
    bound = (lambda c: F.greatest(F.lit(0.0), c)) if most is None else (lambda c: F.least(F.lit(float(most)), F.greatest(F.lit(0.0), c)))
    return F.aggregate(all_, F.lit(1.0), lambda rate, by: bound(rate - dot(by)))


def fit_rates(members: DataFrame, targets: list[float], most: float | None = None, rounds: int = 60, within: float = 1e-6) -> list[list[float]]:
    """Steps that lead to the fitted rates.

    members: (tokens, p); targets: tokens per domain.  The squares are weighted by
    the inverse of H = sum tokens p p', in whose metric the gradient step 1 is safe.
    Documents of equal posterior are summed first: a bounded number of kinds.
    """
    d = len(targets)
    at = [F.element_at("p", k + 1) for k in range(d)]
    kinds = materialize(members.groupBy("p").agg(F.sum("tokens").cast("double").alias("tokens")), "kinds")
    first = kinds.agg(*[F.sum(F.col("tokens") * at[i] * at[j]) for i in range(d) for j in range(d)]).first()
    h = np.array([v or 0.0 for v in first]).reshape(d, d)
    inverse, goal, steps, last = np.linalg.pinv(h + 1e-9 * np.trace(h) * np.eye(d)), np.array(targets, float), [], None
    for _ in range(rounds if np.trace(h) > 0 else 0):
        rate = rate_of(F.col("p"), steps, most)
        now = np.array([v or 0.0 for v in kinds.agg(*[F.sum(rate * F.col("tokens") * a) for a in at]).first()])
        gap = now - goal
        worth = float(gap @ inverse @ gap)
        if np.abs(gap).max() <= within * max(1.0, goal.max()) or (last is not None and last - worth <= 1e-9 * max(worth, 1e-30)):
            break
        last = worth
        steps.append((inverse @ gap).tolist())
    return steps


def mixed(docs: DataFrame, labels: DataFrame, targets: dict | None = None, total: float | None = None, most: float | None = MOST, seed: int = SEED, learned_from: DataFrame | None = None, vocabulary: str | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text, any others): doc_id, tokens, p_<domain>, rate, copies.

    targets: shares of the domains, summing to 1.  total: tokens of the mixture; by
    default so many that the largest share gets its present expected tokens.
    vocabulary: path of a tokenizer whose ids are the tokens; without one blank-separated
    words are (counting ids takes about as long again as all else).
    learned_from: the rows that labels name, if docs has other doc_ids.
    most: upper bound of a rate (1: no document twice; None: none).  copies: the rate rounded up
    or down at random by a hash of doc_id, so that its expectation is the rate.
    Null and empty texts have no tokens and the posterior of an empty text; without
    labels all belong to the first domain.  A domain without labels takes no part.
    Texts of any length count whole.  Repeated rows, and rows without a doc_id, get equal
    rates for equal texts and one hash, so equal copies.  Extra columns are ignored; an
    empty table gives an empty result.
    """
    shares = [(targets or TARGETS).get(name, 0.0) for name in DOMAINS]
    rows = materialize(memberships(docs, learn(docs if learned_from is None else learned_from, labels), vocabulary=vocabulary), "memberships")
    present = [float(v or 0.0) for v in rows.agg(*[F.sum(F.col("tokens") * F.element_at("p", k + 1)) for k in range(len(DOMAINS))]).first()]
    shares = [s if v > 0 else 0.0 for s, v in zip(shares, present, strict=True)]
    if sum(shares) > 0:
        shares = [s / sum(shares) for s in shares]
        largest = int(np.argmax(shares))
        total = present[largest] / shares[largest] if total is None else total
        steps = fit_rates(rows, [total * s for s in shares], most)
    else:
        steps = []
    whole = F.floor("rate")
    return (
        rows.withColumn("rate", rate_of(F.col("p"), steps, most))
        .withColumn("copies", (whole + (unit_hash(F.col("doc_id"), seed=seed) < F.col("rate") - whole).cast("int")).cast("int"))
        .select("doc_id", "tokens", *[F.element_at("p", k + 1).alias(f"p_{name}") for k, name in enumerate(DOMAINS)], "rate", "copies")
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posteriors, rates and copies of all documents under the production targets."""
    return mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
