"""Operator 10: exact dedup as a stateful stream (DataFrame and SQL functions only).

A stream of (digest, stable identifier, content locator) rows folds into keyed
state that never expires and lives on disk (RocksDB): per digest the number of
arrivals and the best of them.  On hits (digests with several arrivals) whole
contents are compared; contents that share a digest but differ are regrouped by
content, so that equality never rests on a hash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.llm.common import BLANKS, table
from aerolake.runtime import broadcastable, fresh_path, materialize

ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


#: Rows of a group that one task compares with the group's best content, about; parts of a group at most, as each takes a copy of that content.
PART_ROWS, PARTS = 256, 1024


def normalised(text: Column) -> Column:
    """The text without blanks; null is empty."""
    return reduce(lambda t, blank: F.replace(t, F.lit(blank), F.lit("")), BLANKS, F.coalesce(text, F.lit("")))


def sha256(content: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, as 32 bytes."""
    return F.unhex(F.sha2(content.cast("binary"), 256))


def locator(docs: DataFrame) -> Column:
    """Where a row's content lies: file and row number of a table of files; of other frames the row's number."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index").schema  # noqa: B018  analysed here
        return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:
        return F.struct(F.lit("").alias("file"), F.monotonically_increasing_id().alias("row"))


def fold_stream(spark: SparkSession, arrivals: str, schema, checkpoint: str, out: str) -> DataFrame:
    """Fold the arrivals that ``checkpoint`` has not seen yet; groups of all arrivals so far.

    arrivals: folder of Parquet files (digest, best).  The same checkpoint and out
    may be used again after more files have arrived: the state is kept for ever.
    """
    was = {k: spark.conf.get(k, None) for k in ROCKS}
    for k, v in ROCKS.items():
        spark.conf.set(k, v)
    try:
        groups = spark.readStream.schema(schema).parquet(arrivals).groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.max("best").alias("best"))
        query = (
            groups.writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/batch={batch}"))
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    # Counts only grow and the best only rises, so the largest is the latest.
    return spark.read.parquet(out).groupBy("digest").agg(F.max("group_size").alias("group_size"), F.max("best").alias("best"))


def exact_dedup(docs: DataFrame, digest=sha256) -> DataFrame:
    """One row per row of docs (doc_id, text, any others): doc_id, keep_id, group_size, kept, text_sha256.

    Null texts are empty; empty and blank texts equal each other.  Of equal texts
    the row with the most code points stays, then the smallest doc_id (null last),
    then one arrival of a row repeated under one doc_id: exactly one row of a group
    is kept.  Extra columns are ignored; an empty table gives an empty result.
    digest: a weaker one changes no result (tests use that).
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    ordered = F.struct(
        F.char_length(text).alias("n"),
        F.col("doc_id").isNotNull().alias("named"),
        F.bitwise_not(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0))).alias("later"),
        locator(docs).alias("locator"),
    )
    content = normalised(F.col("text"))
    path = fresh_path(spark, "arrivals")
    rows_of = F.col("doc_id").cast("bigint").alias("doc_id"), digest(content).alias("digest"), sha256(content).alias("sha"), ordered.alias("best")
    rows = docs.select(*rows_of)
    rows.write.parquet(path)
    arrivals = spark.read.schema(rows.schema).parquet(path)
    groups = materialize(fold_stream(spark, path, arrivals.select("digest", "best").schema, fresh_path(spark, "dedup-state"), fresh_path(spark, "dedup-groups")), "groups") if not arrivals.isEmpty() else arrivals.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.max("best").alias("best"))
    # A large group is dealt out in parts; each part gets the best content to compare with.
    parts = F.least(F.lit(PARTS), F.ceil(F.col("group_size") / PART_ROWS)).cast("int")
    hits = groups.where("group_size > 1").select("digest", "best", parts.alias("parts"))
    if broadcastable(hits, 64):
        hits = F.broadcast(hits)
    # Full bytes on hits: every content under a digest against the best one's content.
    seen = docs.select(digest(content).alias("digest"), content.alias("content"), F.struct(F.char_length(text).alias("n"), F.col("doc_id").cast("bigint").alias("doc_id")).alias("who")).join(hits, "digest")
    seen = seen.withColumn("part", F.pmod(F.xxhash64("who", F.spark_partition_id()), F.col("parts")).cast("int"))
    first = seen.where((F.col("who.n") == F.col("best.n")) & F.col("who.doc_id").eqNullSafe(F.when(F.col("best.named"), F.bitwise_not(F.col("best.later"))))).select("digest", "parts", F.col("content").alias("held")).dropDuplicates(["digest"])
    first = first.select("digest", "held", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    clashes = materialize(seen.select("digest", "part", "content").join(first, ["digest", "part"]).where("content != held").select("digest").distinct(), "clashes")
    found = arrivals.join(groups.withColumnRenamed("best", "best_of"), "digest")
    if not clashes.isEmpty():
        rows = docs.select(*rows_of, content.alias("content")).join(clashes, "digest", "left_semi")
        clashed = materialize(rows, "clashed")
        again = clashed.groupBy("content").agg(F.count(F.lit(1)).alias("group_size"), F.max("best").alias("best_of"))
        names = ("doc_id", "sha", "best", "group_size", "best_of")
        found = found.join(clashes, "digest", "left_anti").select(*names).unionByName(clashed.join(again, "content").select(*names))
    return _answer(found)


def _answer(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        F.when(F.col("best_of.named"), F.bitwise_not(F.col("best_of.later"))).alias("keep_id"),
        F.col("group_size").cast("bigint").alias("group_size"),
        (F.col("best") == F.col("best_of")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over all documents."""
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as c from documents)
select doc_id,
       first_value(doc_id) over (partition by c order by n desc, doc_id) as keep_id,
       count(*) over (partition by c) as group_size,
       row_number() over (partition by c order by n desc, doc_id) = 1 as kept,
       sha256(c) as text_sha256
from d"""
