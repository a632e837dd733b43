"""What several operators of this subpackage share."""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: The six characters of [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str):
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of few rows: texts are large, and Python's memory follows the batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def unit_hash(*cols, seed: int) -> Column:
    """A uniform number in (0, 1) that depends on the columns alone, so retried tasks agree."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def worker_cache(key, make):
    """What ``make`` makes, kept as long as the Python worker lives, over tasks.

    Only the thing asked for last is held, so workers that serve several operators
    in turn do not pile up their word lists.
    """
    held = sys.__dict__.setdefault("_aerolake_cache", {})
    if key not in held:
        held.clear()
        held[key] = make()
    return held[key]


def utf8(column: pa.Array) -> list[bytes]:
    """A text column's values as UTF-8; null is empty."""
    return [b if b is not None else b"" for b in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]
