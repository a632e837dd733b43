"""From raw documents to packed training sequences.

Each stage gets all that its predecessor kept, and its decisions take effect:
all but the last return rows of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.llm import exact_dedup, mixing, packing, quality, simhash
from aerolake.llm.common import table
from aerolake.runtime import broadcastable, materialize

#: No SQL gives fitted models or packing; tests hold the stages against brute force.
ORACLE_SQL = None


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is not among ids (one column doc_id); rows without an id stay."""
    return docs.join(F.broadcast(ids) if broadcastable(ids, 16) else ids, "doc_id", "left_anti").select(*docs.columns)


def _by_row(docs: DataFrame, found) -> DataFrame:
    """docs without the rows whose doc_id ``found(docs)`` gives.

    Where ids repeat or are missing, the rows are numbered, in a written table so that
    the numbers stay, and ``found`` gets these as doc_id: rows go, not ids.
    """
    odd = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    if odd.isEmpty():
        return _without(docs, materialize(found(docs), "gone"))
    numbered = materialize(docs.withColumn("_number", F.monotonically_increasing_id()), "numbered")
    rows = numbered.select(F.col("_number").alias("doc_id"), F.struct(*docs.columns).alias("_row"), "text")
    return _without(rows, materialize(found(rows.select("doc_id", "text")), "gone")).select("_row.*")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality sampler keeps.

    Null and empty texts weigh 0 and are kept or not as such; rows that repeat stay or go
    together; equal keys at the cut are settled by a hash of doc_id.  Without labels of
    both kinds all stay.  An empty table gives an empty one.
    """
    return quality.fit(docs, table(spark, sf_dir, "labels")).rows(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest original, then the smallest doc_id.

    Null, empty and blank texts equal each other.  A doc_id that several rows have, and rows
    without one, are settled by content; of repeated rows one stays.  An empty table gives
    an empty one.
    """
    found = materialize(exact_dedup.exact_dedup(docs), "copies")
    odd = found.groupBy("doc_id").count().where("count > 1 or doc_id is null").select("doc_id")
    odd = materialize(odd, "repeated-ids")
    gone = found.where("doc_id is not null and not (doc_id <=> keep_id)").select("doc_id")
    if odd.isEmpty():
        return _without(docs, gone)
    named = odd.where("doc_id is not null")
    plain = _without(_without(docs.where("doc_id is not null"), named), gone)
    some = docs.where("doc_id is null").unionByName(docs.join(named, "doc_id", "left_semi"))
    sha = F.lower(F.hex(exact_dedup.sha256(exact_dedup.normalised(F.col("text")))))
    kept = found.where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha"))
    ours = some.withColumn("_sha", sha).join(kept, (F.col("_sha") == F.col("kept_sha")) & F.col("doc_id").eqNullSafe(F.col("kept_id")))
    one = ours.groupBy("_sha").agg(F.max_by(F.struct(*docs.columns), F.char_length(F.coalesce("text", F.lit("")))).alias("_row"))
    return plain.unionByName(one.select("_row.*").select(*docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near copies.

    Texts without words are near copies of each other.  Where a doc_id repeats or is
    missing, rows are told apart, and the first row of a group stays: a text goes only
    if a near copy of it stays.  An empty table gives an empty one.
    """
    return _by_row(docs, lambda d: simhash.near_groups(d).where("doc_id != component_id").select("doc_id"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A mixture of the target weights in the ids that packing counts, no document twice.

    Null and empty texts have no tokens and the posterior of an empty text.  Where a doc_id
    repeats or is missing, each row is drawn by itself.  Without labels all stay.  An
    empty table gives an empty one.
    """
    labels = table(spark, sf_dir, "labels")
    return _by_row(docs, lambda d: mixing.mixed(d, labels, most=1.0, learned_from=docs, vocabulary=public_tokenizers.path(packing.VOCABULARY)).where("copies = 0").select("doc_id"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens.

    Null and empty texts are the end id alone; longer ones are cut in pieces; repeated rows
    are packed each; a null doc_id stays null.  An empty table gives an empty one.
    """
    return packing.best_fit_packing(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing to target weights", mix),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
