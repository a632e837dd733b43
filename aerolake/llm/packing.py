"""Operator 9: best-fit packing with a bounded number of open bins."""

from __future__ import annotations

import zlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.llm.common import small_batches, table, utf8
from aerolake.llm.tokens import VOCABULARY, WordIds

#: Tokens of a sequence, and open bins of a task.
SIZE, OPEN_BINS = 2048, 1 << 18
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


class BestFit:
    """Online best fit over at most ``most`` open bins.

    A bit of ``free`` is set where some open bin has just that much space; the
    lowest bit from an item's length upwards is the best fit.  At the limit the
    fullest bin (lowest bit) closes first.
    """

    def __init__(self, size: int, most: int):
        self.size, self.most, self.free, self.count, self.bins, self.next = size, most, 0, 0, {}, 0

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset) of an item of 1 to size tokens."""
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(space)
        else:
            if self.count >= self.most:
                self._take((self.free & -self.free).bit_length() - 1)
            bin_, space, self.next = self.next, self.size, self.next + 1
        if left := space - length:
            self.bins.setdefault(left, []).append(bin_)
            self.free |= 1 << left
            self.count += 1
        return bin_, self.size - space

    def _take(self, space: int) -> int:
        stack = self.bins[space]
        bin_ = stack.pop()
        if not stack:
            del self.bins[space]
            self.free &= ~(1 << space)
        self.count -= 1
        return bin_


def pieces(docs: DataFrame, size: int = SIZE, vocabulary: str | None = None) -> DataFrame:
    """Documents as token ids and an end id 0, in pieces of at most ``size``."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    names = [x.split()[0] for x in PIECE.split(", ")]

    def of_batches(batches):
        ids = WordIds.of(path)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, raw in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                packed = ids.packed(raw) + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(packed), 4 * size)):
                    part = packed[at : at + 4 * size]
                    for column, value in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if k == 1 else pa.int64()) for k, x in enumerate(out)], names)

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(of_batches, PIECE)


def packed(parts: DataFrame, size: int = SIZE, open_bins: int = OPEN_BINS) -> DataFrame:
    """Give each piece a sequence and its offset there.

    Rows are narrow, so a task packs a million pieces or so; it takes them longest
    first, which fills bins nearly whole.  The order within a task is total but
    for equal rows, so a retried task gives the same sequences.
    """

    def of_batches(batches):
        from pyspark import TaskContext

        base, fit = TaskContext.get().partitionId() << 40, BestFit(size, open_bins)
        for batch in batches:
            at = [fit.put(n) for n in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([base + b for b, _ in at], pa.int64()), pa.array([o for _, o in at], pa.int64())], [*batch.schema.names, "sequence_id", "offset"])

    dealt = parts.repartition(F.xxhash64("doc_id", "piece", "ids_crc32")).sortWithinPartitions(F.col("length").desc(), "doc_id", "piece", "ids_crc32")
    return dealt.mapInArrow(of_batches, f"{PIECE}, sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, size: int = SIZE, open_bins: int = OPEN_BINS, vocabulary: str | None = None) -> DataFrame:
    """One row per piece of docs (doc_id, text, any others): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece, the end id alone.  Repeated rows are packed
    each; a null doc_id stays null.  Extra columns are ignored; an empty table gives
    an empty result.
    """
    return packed(pieces(docs, size, vocabulary), size, open_bins)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over all documents."""
    return best_fit_packing(table(spark, sf_dir, "documents"))
