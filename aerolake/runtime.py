"""Shared-storage helpers: where intermediate tables go and how lineage is cut.

Executors can vanish and share no local disks, so everything that must outlive
a job goes to the folder the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share.

    ``spark.checkpoint.dir`` decides.  Only where it is unset and driver and executors
    are one process (local tests) is a temporary folder made, and then set as the
    session's checkpoint folder; on a cluster it must be named.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
    made = "file://" + tempfile.mkdtemp(prefix="aerolake-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the application's part of the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/aerolake/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete all that this application has written to the shared folder, once its results have been read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/aerolake/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` wrote and nobody reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)


def broadcastable(df: DataFrame, row_bytes: int, limit_bytes: int = 8 << 20) -> bool:
    """True when a counted table of ``row_bytes`` wide rows stays under ``limit_bytes``."""
    most = limit_bytes // row_bytes
    return df.limit(most + 1).count() <= most
