"""Operator 6: quality by importance resampling of hashed n-grams.

Two generative models over hashed uni- and bigrams: one of the target (labelled
good) texts, one of all raw texts.  A document's weight is the ratio of its
probabilities; Gumbel noise added to the log weight and a top-k over all
documents sample k of them without replacement, in proportion to the weights.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.llm.common import small_batches, table, unit_hash, utf8
from aerolake.llm.grams import BUCKETS, grams
from aerolake.runtime import broadcastable, materialize

SEED = 6
#: Of so many labels one places the cut and is not learned from.
FOLDS = 4


def gram_counts(docs: DataFrame, classes: int, *kind) -> np.ndarray:
    """counts[class][bucket] over all rows of docs (text, class int; null counts for class 0 alone).

    kind: what ``grams`` takes, the number of buckets first.

    A row of class c counts for 0 (raw) and for c.  Each task sends one row a
    class; what reaches the driver is classes x buckets numbers.
    """

    buckets = kind[0]

    def of_batches(batches):
        total, own = np.zeros((classes, buckets), np.int64), grams(*kind)
        for batch in batches:
            for raw, c in zip(utf8(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                n = np.bincount(own.of(raw), minlength=buckets)
                total[0] += n
                if c:
                    total[c] += n
        for c in range(classes):
            at = np.flatnonzero(total[c])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c, np.int32)), pa.array(at.astype(np.int32)), pa.array(total[c][at])], ["class", "bucket", "n"])

    small_batches(docs.sparkSession)
    parts = docs.select("text", "class").mapInArrow(of_batches, "class int, bucket int, n long")
    out = np.zeros((classes, buckets))
    for row in parts.groupBy("class", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row["class"], row["bucket"]] = row["n"]
    return out


def log_weights(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """(doc_id, log_weight, n_grams) of every row: the sum of its n-grams' log ratios."""
    ratio = ratio.astype(np.float64)

    def of_batches(batches):
        own = grams(len(ratio))
        for batch in batches:
            found = [(float(ratio[b].sum()), len(b)) for b in map(own.of, utf8(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([w for w, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int64())], ["doc_id", "log_weight", "n_grams"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(of_batches, "doc_id long, log_weight double, n_grams long")


def top_k_cut(keys: DataFrame, k: int, key: str = "key", tie: str = "tie") -> tuple[float, int]:
    """The k-th largest (key, tie): an exact selection by counting, without a sort of all rows.

    Each pass splits the open range into 4096 parts and counts the rows of each, so
    4096 counts reach the driver; it goes on inside the part that holds the k-th
    row.  Rows with equal keys are told apart by tie (a long, larger first).
    """
    low, high, above = keys.agg(F.min(key), F.max(key)).first()[:2] + (0,)
    while low < high:
        step = (high - low) / 4096
        if step <= 0 or low + step <= low or high - step >= high:
            break
        part = F.least(F.lit(4095), F.floor((F.col(key) - low) / step)).cast("int")
        counts = {r.part: r["count"] for r in keys.where(F.col(key).between(low, high)).groupBy(part.alias("part")).count().collect()}
        spread = keys.where(F.col(key).between(low, high)).groupBy(part.alias("part")).agg(F.min(key).alias("a"), F.max(key).alias("b"))
        for p in sorted(counts, reverse=True):
            if above + counts[p] >= k:
                break
            above += counts[p]
        found = spread.where(F.col("part") == p).first()
        low, high = found.a, found.b
    # equal keys: the same selection over the ties, sixteen bits of their order (from 0 up) at a time
    same, found = keys.where(F.col(key) == low).select((F.col(tie).bitwiseXOR(F.lit(-(1 << 63)))).alias("t")), 0
    if above + same.count() == k:
        return low, -(1 << 63)
    for shift in (48, 32, 16, 0):
        part = F.shiftrightunsigned("t", shift).bitwiseAND(F.lit(0xFFFF)).cast("int")
        within = same if shift == 48 else same.where(F.shiftrightunsigned("t", shift + 16) == found)
        counts = {r.part: r["count"] for r in within.groupBy(part.alias("part")).count().collect()}
        for p in sorted(counts, reverse=True):
            if above + counts[p] >= k:
                break
            above += counts[p]
        found = found << 16 | p
    return low, found - (1 << 63)


class Sampler:
    """What one resampling has learned: log ratios by bucket, and the cut in (key, tie); cut None keeps all."""

    def __init__(self, ratio: np.ndarray, seed: int, cut: float | None, tie: int, scored: DataFrame):
        self.ratio, self.seed, self.cut, self.tie, self.scored = ratio, seed, cut, tie, scored

    def kept(self, key: Column, tie: Column) -> Column:
        """Whether a row with this key and tie is in the sample."""
        return F.lit(True) if self.cut is None else (key > self.cut) | ((key == self.cut) & (tie >= self.tie))

    def rows(self, docs: DataFrame) -> DataFrame:
        """The sampled rows of the docs it was fitted on, columns as they are; nothing is shuffled."""
        ratio, columns = self.ratio, docs.columns

        @F.pandas_udf("double")
        def weight(texts: pd.Series) -> pd.Series:
            own = grams(len(ratio))
            return pd.Series([float(ratio[own.of(t.encode())].sum()) for t in texts])

        small_batches(docs.sparkSession)
        key, tie = keyed(weight(F.coalesce("text", F.lit(""))), self.seed)
        return docs.where(self.kept(key, tie)).select(*columns)


def keyed(log_weight: Column, seed: int) -> tuple[Column, Column]:
    """(log weight plus Gumbel noise, what settles equal keys); both follow from the row alone."""
    return log_weight - F.log(-F.log(unit_hash(F.col("doc_id"), seed=seed))), F.xxhash64(F.lit(seed + 1), "doc_id")


def held_back(doc_id: Column, seed: int) -> Column:
    """Labels that place the cut and teach the target model nothing: one in FOLDS, by a hash of doc_id."""
    return F.pmod(F.xxhash64(F.lit(seed + 2), doc_id), F.lit(FOLDS)) == 0


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, seed: int = SEED, keep: int | None = None) -> Sampler:
    """Learn the two models from all rows and find the cut; see ``resample``."""
    marks = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    marks = marks.withColumn("cuts", held_back(F.col("doc_id"), seed))
    small = broadcastable(marks, 32)
    marked = docs.select("doc_id", "text").join(F.broadcast(marks) if small else marks, "doc_id", "left")
    counts = gram_counts(marked.select("text", F.when((F.col("quality") == 1) & ~F.col("cuts"), 1).when(F.col("quality") == 0, 2).cast("int").alias("class")), 3, buckets)
    smooth = lambda n: np.log((n + 1) / (n.sum() + len(n)))
    ratio = smooth(counts[1]) - smooth(counts[0])
    key, tie = keyed(F.col("log_weight"), seed)
    rows = materialize(log_weights(docs, ratio).withColumn("key", key).withColumn("tie", tie), "log-weights")
    total = rows.count()
    if keep is None:
        keep = total if not counts[1].any() or not counts[2].any() else _calibrated(rows, marks, small)
    if keep >= total:
        return Sampler(ratio, seed, None, 0, rows)
    return Sampler(ratio, seed, *(top_k_cut(rows, keep) if keep > 0 else (float("inf"), 0)), rows)


def resample(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, seed: int = SEED, keep: int | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text, any others): doc_id, log_weight, n_grams, key, kept.

    labels (doc_id, quality 1 or 0; others are no labels).  The target model is of the good
    rows, the raw one of all rows.  keep: how many to sample; by default as many as
    reach the log weight that parts the labelled good from the labelled bad with
    fewest errors, relative to the kinds' sizes; one in FOLDS of the labels is kept from
    the target model for that (where these are not of both kinds, all labels place it).  Null and empty texts have log weight
    0.  Ties at the cut are settled by a hash of doc_id; rows that repeat one
    stay or go together.  Without good or without bad labels everything is kept.
    Extra columns are ignored; an empty table gives an empty result.
    """
    sampler = fit(docs, labels, buckets, seed, keep)
    return sampler.scored.withColumn("kept", sampler.kept(F.col("key"), F.col("tie"))).drop("tie")


def _calibrated(rows: DataFrame, marks: DataFrame, small: bool, parts: int = 2048) -> int:
    """How many rows reach the log weight that parts good from bad labels best.

    Of cuts with equally few errors, the lowest: clean documents are kept.
    """
    scale = lambda c: F.signum(c) * F.log1p(F.abs(c))  # noqa: E731  fine near 0, where it matters
    low, high = rows.agg(F.min(scale(F.col("log_weight"))), F.max(scale(F.col("log_weight")))).first()
    width = (high - low) / parts or 1.0
    part = F.floor((scale(F.col("log_weight")) - low) / width).cast("int").alias("part")
    n = np.zeros((3, parts + 1))
    for r in rows.groupBy(part).count().collect():
        n[0, r.part] = r["count"]
    by_fold = np.zeros((2, 2, parts + 1))
    for r in rows.join(F.broadcast(marks) if small else marks, "doc_id").groupBy(part, "quality", "cuts").count().collect():
        by_fold[int(r.cuts), r.quality, r.part] = r["count"]
    n[1:] = by_fold[1] if by_fold[1].sum(axis=1).all() else by_fold.sum(axis=0)
    lost = np.cumsum(n[2]) - n[2]  # good below the cut
    passed = n[1].sum() - (np.cumsum(n[1]) - n[1])  # bad at the cut or above
    error = lost / max(1, n[2].sum()) + passed / max(1, n[1].sum())
    return int(n[0][int(np.argmin(error)) :].sum())


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their log weight, sampling key and whether they are kept."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
