"""Operator 2: SimHash near-dedup by anchor-point covering.

Fingerprints differ in at most k bits.  Some bit subsets of a *design* are sure
to hold at most ``slack`` of those bits.  On each subset a covering code (a
Hamming code on 15 or 31 bits, all words on the rest; covering radius 1) gives
the anchors: every fingerprint has one home anchor within the radius, and is
replicated to every anchor within radius + slack.  Of a linked pair, the one
therefore meets the other at its home anchor, where they are compared exactly.
Anchors with many homes are dealt out by home; a worker holds only the homes of
one anchor and streams the other members past them.
"""

from __future__ import annotations

import re
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.llm.common import small_batches, table, utf8
from aerolake.operators.components import connected_components
from aerolake.runtime import broadcastable, materialize

#: Words of a shingle, bits that linked fingerprints may differ in, seed of XXH64.
WIDTH, BITS, SEED = 4, 4, 42
#: Homes that one task holds for one anchor.
MOST_HOMES = 20_000


def fingerprints(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) for every row; fp is the 64 bits as a signed long.

    Null, empty and blank texts have no words: fp 0.  Fewer words than ``width``
    make one shingle of them all.  Whole texts count, in blocks of bounded size.
    """
    block = 1 << 15

    def of_batches(batches):
        word = re.compile(rb"[^\x20\x09-\x0D]+")
        h64 = xxhash.xxh64_intdigest
        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            held, owner, sizes = [], [], []  # hashes of whole short texts, until a block is full
            n = 0

            def flush():
                bits = np.unpackbits(np.array(held, np.dtype(">u8")).view(np.uint8).reshape(-1, 8), axis=1)
                at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                ones = np.add.reduceat(bits, at, axis=0, dtype=np.int64)
                out[owner] = np.packbits(2 * ones > np.array(sizes)[:, None], axis=1).view(np.dtype(">u8")).ravel()

            for row, raw in enumerate(utf8(batch.column(1))):
                words = word.findall(raw.lower())  # bytes: only A-Z change
                if not words:
                    continue
                if len(words) < width:
                    spans, count, joined = [(0, None)], 1, b" ".join(words)
                else:
                    joined = b" ".join(words)
                    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
                    starts = np.concatenate(([0], ends[:-1]))
                    count = len(words) - width + 1
                    spans = zip(starts[:count].tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)
                if count > block:
                    ones, spans = np.zeros(64, np.int64), iter(spans)
                    for first in range(0, count, block):
                        part = [h64(joined[s:e], seed) for s, e in islice(spans, min(block, count - first))]
                        ones += np.unpackbits(np.array(part, np.dtype(">u8")).view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
                    out[row] = np.packbits(2 * ones > count).view(np.dtype(">u8"))[0]
                    continue
                held += [h64(joined[s:e], seed) for s, e in spans]
                owner.append(row)
                sizes.append(count)
                n += count
                if n >= block:
                    flush()
                    held, owner, sizes, n = [], [], [], 0
            if n:
                flush()
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(of_batches, "doc_id long, fp long")


class Design:
    """Bit subsets and the code on each.

    subsets: lists of (shift, width) pieces; ham: 15 or 31, the bits of a subset
    that the Hamming code takes, the rest being free; slack: differing bits that
    some subset is sure not to exceed.
    """

    def __init__(self, subsets, ham: int, slack: int):
        self.subsets, self.ham, self.slack = subsets, ham, slack

    def patterns(self, bits: int):
        """For each syndrome: error patterns (within slack + 1 bits) that lead to an anchor, the home's first, padded with it."""
        by = [[] for _ in range(self.ham + 1)]
        for weight in range(self.slack + 2):
            for flips in combinations(range(bits), weight):
                syndrome = 0
                for f in flips:
                    syndrome ^= f + 1 if f < self.ham else 0
                by[syndrome].append(sum(1 << f for f in flips))
        most = max(map(len, by))
        sizes = np.array([len(x) for x in by])
        return np.array([x + [0] * (most - len(x)) for x in by], np.uint64), sizes

    def syndromes(self, x: np.ndarray) -> np.ndarray:
        s = np.zeros(len(x), np.uint64)
        for f in range(self.ham):
            s ^= ((x >> np.uint64(f)) & np.uint64(1)) * np.uint64(f + 1)
        return s.astype(np.int64)

    def rows_each(self) -> float:
        """Mean number of anchors of a fingerprint."""
        total = 0.0
        for pieces in self.subsets:
            _, sizes = self.patterns(sum(w for _, w in pieces))
            total += sizes.mean()
        return total


def _steiner() -> list:
    """Blocks of S(3,4,8): the 14 planes of the affine space over {0,1}^3, as byte positions."""
    return [[(8 * p, 8) for p in four] for four in combinations(range(8), 4) if four[0] ^ four[1] ^ four[2] ^ four[3] == 0]


#: Three blocks: one holds at most 1 of 4 differing bits; 17 to 18 bits tell anchors apart.
NARROW = Design([[(0, 22)], [(22, 21)], [(43, 21)]], 15, 1)
#: 14 halves, of which one misses 3 of any 4 bytes, so holds at most 1 of 4 differing bits; 27 bits tell anchors apart.
WIDE = Design(_steiner(), 31, 1)


def design_for(distinct: int) -> Design:
    """The design with less work for so many fingerprints: rows made, and comparisons at a hundredth of a row each."""
    cost = lambda d, bits: distinct * d.rows_each() + 0.01 * distinct * len(d.subsets) * distinct * d.rows_each() / len(d.subsets) / 2**bits
    return min((NARROW, 17), (WIDE, 27), key=lambda x: cost(*x))[0]


def anchored(fps: DataFrame, design: Design, homes_only: bool = False) -> DataFrame:
    """(anchor, home, fp): a row for every anchor within radius + slack; home marks the one within the radius."""

    def of_batches(batches):
        tables = [design.patterns(sum(w for _, w in pieces)) for pieces in design.subsets]
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for first in range(0, len(fp), 4096):
                part = fp[first : first + 4096]
                keys, homes, whose = [], [], []
                for k, (pieces, (patterns, sizes)) in enumerate(zip(design.subsets, tables, strict=True)):
                    x, at = np.zeros(len(part), np.uint64), 0
                    for shift, width in pieces:
                        x |= ((part >> np.uint64(shift)) & np.uint64((1 << width) - 1)) << np.uint64(at)
                        at += width
                    s = design.syndromes(x)
                    count = np.ones(len(part), np.int64) if homes_only else sizes[s]
                    row = np.repeat(np.arange(len(part)), count)
                    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                    keys.append((x[row] ^ patterns[s[row], nth]) | np.uint64(k << 40))
                    homes.append(nth == 0)
                    whose.append(part[row])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(homes)), pa.array(np.concatenate(whose).view(np.int64))], ["anchor", "home", "fp"])

    return fps.select("fp").mapInArrow(of_batches, "anchor long, home boolean, fp long")


def joined_roots(roots: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Union of the pairs (i, j) into a forest of smallest-index roots."""
    while len(i):
        ri, rj = roots[i], roots[j]
        open_ = ri != rj
        i, j, ri, rj = i[open_], j[open_], ri[open_], rj[open_]
        np.minimum.at(roots, np.maximum(ri, rj), np.minimum(ri, rj))
        while not np.array_equal(up := roots[roots], roots):
            roots = up
    return roots


def _linked(bits: int):
    """Compare each anchor's homes with its members; emit a spanning forest of the links found."""

    def of_batches(batches):
        held_key, held_salt, held = None, None, np.zeros(0, np.uint64)
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            salt = batch.column(1).to_numpy(zero_copy_only=False)
            home = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            fp = batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(key):
                continue
            if (key[0], salt[0]) == (held_key, held_salt):  # homes of the group that goes on
                n = len(held)
                key, salt, home, fp = np.concatenate((np.full(n, held_key), key)), np.concatenate((np.full(n, held_salt), salt)), np.concatenate((np.ones(n, bool), home)), np.concatenate((held, fp))
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])))
            group = np.cumsum(new) - 1
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(key)))
            roots = np.arange(len(key))
            at = np.flatnonzero(home & (size[group] > 1))
            width = size[group[at]]
            done = 0
            while done < len(at):  # at most about two million comparisons at a time
                upto = max(done + 1, done + int(np.searchsorted(np.cumsum(width[done:]), 2_000_000)))
                h = np.repeat(at[done:upto], width[done:upto])
                m = np.arange(len(h)) - np.repeat(np.cumsum(width[done:upto]) - width[done:upto], width[done:upto]) + start[group[h]]
                near = (np.bitwise_count(fp[h] ^ fp[m]) <= bits) & (h != m)
                roots = joined_roots(roots, h[near], m[near])
                done = upto
            moved = np.flatnonzero(roots != np.arange(len(roots)))
            a, b = fp[moved], fp[roots[moved]]
            differ = a != b
            if differ.any():
                pairs = np.unique(np.stack([a[differ], b[differ]], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy().view(np.int64)), pa.array(pairs[:, 1].copy().view(np.int64))], ["a", "b"])
            last = group == group[-1]
            held_key, held_salt, held = key[-1], salt[-1], fp[last & home]

    return of_batches


def links(fps: DataFrame, distinct: int, bits: int = BITS, most_homes: int = MOST_HOMES) -> DataFrame:
    """(a, b) edges between distinct fingerprints that span exactly the components of "differ in at most ``bits`` bits"."""
    if bits > BITS:
        raise ValueError(f"the designs cover up to {BITS} differing bits")
    design = design_for(distinct)
    hot = anchored(fps, design, homes_only=True).groupBy("anchor").count().where(F.col("count") > most_homes).select("anchor", F.ceil(F.col("count") / most_homes).cast("int").alias("salts"))
    hot = materialize(hot, "hot-anchors")
    rows = anchored(fps, design)
    if hot.isEmpty():
        dealt = rows.select("anchor", F.lit(0).alias("salt"), "home", "fp")
    else:
        hot = F.broadcast(hot) if broadcastable(hot, 12) else hot
        own = F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int")
        dealt = (
            rows.join(hot, "anchor", "left")
            .select("anchor", F.coalesce("salts", F.lit(1)).alias("salts"), "home", "fp")
            .select("anchor", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), (F.col("home")).alias("home"), "fp", own.alias("own"))
            .select("anchor", "salt", (F.col("home") & (F.col("salt") == F.col("own"))).alias("home"), "fp")
        )
    parted = dealt.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", F.col("home").desc(), "fp")
    return parted.mapInArrow(_linked(bits), "a long, b long")


def near_groups(docs: DataFrame, width: int = WIDTH, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """One row per row of docs (doc_id, text, any others): doc_id, fingerprint, component_id.

    fingerprint: 16 lower-case hex digits.  component_id: the smallest doc_id
    reachable over links of at most ``bits`` differing bits.  Null and blank texts
    have fingerprint zero, linked like any other.  Repeated rows give repeated
    rows; a null doc_id never names a component unless all its ids are null.
    Extra columns are ignored; an empty table gives an empty result.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    rows = materialize(fingerprints(docs, width, seed), "fingerprints")
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    found = connected_components(links(fps, fps.count(), bits))
    rooted = fps.join(found, fps["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = materialize(rooted.join(named, "root").select("fp", "component_id"), "fingerprint-components")
    return rows.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over all documents."""
    return near_groups(table(spark, sf_dir, "documents"))
