"""Token ids of whole texts, and operator 8: the exact length histogram."""

from __future__ import annotations

import os
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerolake.llm.common import small_batches, table, utf8, worker_cache
from aerolake.runtime import materialize

VOCABULARY = "word_bpe_49k.json"


class WordIds:
    """Ids of texts under a word-end BPE whose tokens never span white space.

    Blank-separated chunks are encoded once and remembered, up to ``most`` of
    them.  Chunks of plain lower-case letters are whole words, which the
    tokenizer's normalizer and patterns leave as they are: they go to its model
    straight, and the word-end tokens part them again.
    """

    #: A stop or comma at a chunk's end, after a letter or digit: a run of its own for the tokenizer.
    stop = re.compile(rb"[.,](?=[ \n\t\r\x0b\x0c]|\Z)(?<=[a-z0-9][.,])")
    plain = re.compile("[a-z\xdf-\xf6\xf8-\xff]+")

    def __init__(self, path: str, most: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.most, self.known = Tokenizer.from_file(path), most, {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    @classmethod
    def of(cls, path: str) -> WordIds:
        """The worker's own, kept over tasks."""
        return worker_cache(("ids", path), lambda: cls(path))

    def _learn(self, chunks: list[bytes]) -> None:
        known, words, keys, rest = self.known, [], [], []
        for chunk in chunks:
            word = chunk.decode()
            if self.plain.fullmatch(word):
                words.append(word)
                keys.append(chunk)
            else:
                rest.append(chunk)
        if words:
            ids = np.array(self.words.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.dtype("<u4"))
            coded, at = ids.tobytes(), 0
            for key, end in zip(keys, (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist(), strict=True):
                known[key], at = coded[at:end], end
        for chunk, code in zip(rest, self.tokenizer.encode_batch_fast([c.decode() for c in rest], add_special_tokens=False), strict=True):
            known[chunk] = np.array(code.ids, np.dtype("<u4")).tobytes()

    def chunks(self, raw: bytes) -> list[bytes]:
        """A text's chunks; those of ASCII white space only, and the spelling of special tokens is left alone."""
        return self.stop.sub(rb" \g<0>", raw.lower()).split() if b"<|" not in raw else raw.split()

    def packed(self, raw: bytes) -> bytes:
        """The ids of a UTF-8 text as little-endian unsigned 32-bit numbers."""
        chunks, known = self.chunks(raw), self.known
        if missing := list({c for c in chunks if c not in known}):
            if len(known) + len(missing) > self.most:
                known.clear()
                missing = list(set(chunks))
            for first in range(0, len(missing), 10_000):
                self._learn(missing[first : first + 10_000])
        return b"".join([known[c] for c in chunks])


def lengths(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of every row; null and empty texts have 0 tokens."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def of_batches(batches):
        ids = WordIds.of(path)
        for batch in batches:
            n = np.fromiter((len(ids.packed(raw)) // 4 for raw in utf8(batch.column(1))), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n)], ["doc_id", "n_tokens"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(of_batches, "doc_id long, n_tokens long")


def length_histogram(counted: DataFrame, block: int = 1024) -> DataFrame:
    """From (n_tokens): a row per occurring length, with sums that answer every context limit.

    n_docs: documents of the length; docs_at_least: of this length or more;
    docs_below: shorter ones (so the q-quantile is the largest length whose
    docs_below is at most q * (N - 1)); tokens_at_least: their tokens in whole;
    truncated_total: tokens of all documents cut to this length.  Any limit L
    between two lengths l < L <= m has truncated total
    total - tokens_at_least(m) + L * docs_at_least(m).  Null lengths are left
    out.  An empty table gives an empty result.  The sums run in blocks of
    lengths, so no task holds all lengths.
    """
    h = counted.where("n_tokens is not null").groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))
    h = materialize(h.withColumn("block", F.floor(F.col("n_tokens") / block)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs")), "histogram")
    totals = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a row a block: largest length / block rows
    later = totals.select("block", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"))
    overall = totals.agg(F.sum("d").alias("all_docs"), F.sum("t").alias("all_tokens"))
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return (
        h.join(later, "block")
        .withColumn("docs_at_least", F.sum("n_docs").over(inside) + F.col("d_after"))
        .withColumn("tokens_at_least", F.sum("tokens").over(inside) + F.col("t_after"))
        .join(F.broadcast(overall))  # one row
        .select(
            "n_tokens",
            "n_docs",
            "docs_at_least",
            (F.col("all_docs") - F.col("docs_at_least")).alias("docs_below"),
            "tokens_at_least",
            (F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"),
        )
    )


def truncated_total(histogram: DataFrame, limit: int) -> int:
    """Tokens of all documents cut to ``limit``: one row of the histogram answers."""
    least = histogram.orderBy("n_tokens").first()
    if least is None or limit <= 0:
        return 0
    total = least.tokens_at_least
    at = histogram.where(F.col("n_tokens") >= limit).orderBy("n_tokens").first()
    return total if at is None else total - at.tokens_at_least + limit * at.docs_at_least


def quantile(histogram: DataFrame, q: float) -> int | None:
    """The exact lower q-quantile of the lengths."""
    least = histogram.orderBy("n_tokens").first()
    if least is None:
        return None
    rank = int(q * (least.docs_at_least - 1))
    return histogram.where(F.col("docs_below") <= rank).orderBy(F.col("n_tokens").desc()).first().n_tokens


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length histogram of all documents under the word tokenizer."""
    return length_histogram(lengths(table(spark, sf_dir, "documents")))
