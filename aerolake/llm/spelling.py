"""Operator 13: grouping of spelling variants.

Words that one edit parts are found with a positional q-gram inverted index.  A
word's padded q-grams that one edit leaves alone number at least its length less
one, so two near words share one of their few rarest grams: each such gram, with a
length and a position, is a shard of the index.  Within a shard every word's own
posting lists are merged by a heap under the length and position limits; what is
on as many lists as the bound asks is compared, and the pairs that one edit parts
stay.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from heapq import heapify, heappop, heappush, nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.llm.common import small_batches, table
from aerolake.runtime import discard, materialize

#: One of so many words of a text loses a code point; fewest code points and occurrences of a word that counts.
DAMAGE, SHORTEST, FEWEST = 97, 5, 3
#: Length of a gram; buckets in which grams are counted; index rows of a shard, about, beyond which it is split.
Q, BUCKETS, SHARD = 3, 1 << 16, 2000
#: Distinct words that a counting task holds before it sends them on.
HELD = 500_000
#: In UTF-8: letters beyond ASCII that count start with C3; any other sequence parts words.
OTHER = re.compile(rb"[\xc2\xc4-\xf4][\x80-\xbf]+")
LETTERS = bytes(c if chr(c).isalpha() and c < 128 or c >= 128 else 32 for c in range(256)).lower()
POSTING = "gram string, n int, p int, role int, word string, count long"
#: Roles in a shard: indexed and asked for its own length, indexed only, asks for longer words, asks for its own length.
OWN, INDEXED, LONGER, SAME = range(4)


def runs(raw: bytes) -> list[bytes]:
    """Maximal runs of letters A-Z, a-z and U+00C0 to U+00FF of a UTF-8 text, A-Z lower-cased."""
    return OTHER.sub(b" ", raw).translate(LETTERS).split()


def damaged(run: bytes, doc: bytes, damage: int = DAMAGE) -> bytes:
    """The run, or without one code point where ``damage`` divides the CRC-32 of ``<doc>:<run>``."""
    h = zlib.crc32(run, zlib.crc32(doc + b":"))
    if h % damage:
        return run
    text = run.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def words(docs: DataFrame, damage: int = DAMAGE, shortest: int = SHORTEST, fewest: int = FEWEST, held: int = HELD) -> DataFrame:
    """(word, n) of all whole texts, counted: at least ``shortest`` code points and ``fewest`` occurrences."""

    def of_batches(batches):
        total: Counter = Counter()

        def out():
            found = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return found

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                name = b"" if doc is None else str(doc).encode()
                seed, odd = zlib.crc32(name + b":"), []
                own = Counter(runs(text.encode()))
                for run, n in own.items():
                    if zlib.crc32(run, seed) % damage == 0:
                        odd.append((run, n))
                for run, n in odd:
                    del own[run]
                    total[damaged(run, name, damage)] += n
                total.update(own)
                if len(total) > held:
                    yield out()
        yield out()

    small_batches(docs.sparkSession, 500)
    counted = docs.select("doc_id", "text").mapInArrow(of_batches, "word string, n long")
    return counted.where(F.length("word") >= shortest).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= fewest)


def grams(word: str, q: int = Q) -> list[str]:
    """The q-grams by position of a word padded on both sides."""
    padded = "\x01" * (q - 1) + word + "\x02" * (q - 1)
    return [padded[i : i + q] for i in range(len(word) + q - 1)]


def bucket(gram: str) -> int:
    """Where a gram is counted."""
    return zlib.crc32(gram.encode()) % BUCKETS


def rarest(word: str, counts: np.ndarray, q: int = Q) -> list[tuple[str, int]]:
    """The word's q + 1 rarest (gram, position), by one order that all words share."""
    found = grams(word, q)
    return [(g, p) for _, g, p in nsmallest(q + 1, [(counts[bucket(g)], g, p) for p, g in enumerate(found)])]


def on_lists(lists: list[list[int]], least: int) -> list[int]:
    """What stands on at least ``least`` of some ascending lists: a heap merge that skips what cannot reach it."""
    if len(lists) < least:
        return []
    heap, out = [(own[0], k, 0) for k, own in enumerate(lists)], []
    heapify(heap)
    while len(heap) >= least:
        first, popped = heap[0][0], []
        while heap and heap[0][0] == first:
            popped.append(heappop(heap))
        if len(popped) >= least:
            out.append(first)
            for _, k, i in popped:
                if i + 1 < len(lists[k]):
                    heappush(heap, (lists[k][i + 1], k, i + 1))
            continue
        while heap and len(popped) < least - 1:
            popped.append(heappop(heap))
        if not heap:
            break
        target = heap[0][0]  # anything smaller is on the lists just popped at most
        for _, k, i in popped:
            at = bisect_left(lists[k], target, i)
            if at < len(lists[k]):
                heappush(heap, (lists[k][at], k, at))
    return out


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point parts two words, b the longer if any."""
    i = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        i += 1
    if len(a) == len(b):
        return i < len(a) and a[i + 1 :] == b[i + 1 :]
    return len(b) == len(a) + 1 and a[i:] == b[i + 1 :]


class Shard:
    """A positional inverted index of words of one length."""

    def __init__(self, q: int = Q):
        self.q, self.words, self.counts, self.own, self.lists = q, [], [], [], {}

    def add(self, word: str, count: int, asks: bool) -> None:
        if asks:
            self.own.append(len(self.words))
        self.words.append(word)
        self.counts.append(count)

    def close(self) -> None:
        """Build the lists; a shard of one word that nobody asks needs none."""
        for k, word in enumerate(self.words):
            for key in enumerate(grams(word, self.q)):
                self.lists.setdefault(key, []).append(k)

    def near(self, word: str, longer: bool, after: int = -1) -> list[int]:
        """Indexed words (numbered above ``after``) that one edit parts from ``word``."""
        lists, held = [], self.lists
        for p, g in enumerate(grams(word, self.q)):
            for at in (p, p + 1) if longer else (p,):
                found = held.get((at, g))
                if found and found[-1] > after:
                    lists.append(found if after < 0 else found[bisect_left(found, after + 1) :])
        least = max(1, len(word) + longer - 1)
        return [k for k in on_lists(lists, least) if one_edit(word, self.words[k])]


def postings(counted: DataFrame, counts: np.ndarray, q: int = Q) -> DataFrame:
    """The shards' rows: each word indexed under its q + 1 rarest grams, and asking where a word one longer may stand."""

    def of_batches(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for word, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, few = len(word), rarest(word, counts, q)
                rows = [(g, n, p, OWN) for g, p in few]
                rows += [(g, n + 1, p + d, LONGER) for g, p in few[:q] for d in (0, 1)]
                for row in rows:
                    for column, value in zip(out, (*row, word, count), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64()), strict=True)], ["gram", "n", "p", "role", "word", "count"])

    return counted.select("word", "n").mapInArrow(of_batches, POSTING)


def gram_counts(counted: DataFrame, q: int = Q) -> np.ndarray:
    """How many words' grams fall into each bucket; BUCKETS numbers reach the driver at most."""

    def of_batches(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for word in batch.column(0).to_pylist():
                for g in grams(word, q):
                    total[bucket(g)] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], ["at", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in counted.select("word").mapInArrow(of_batches, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out


def near_pairs(counted: DataFrame, q: int = Q, shard: int = SHARD) -> DataFrame:
    """(a, b, a_n, b_n) of all words one edit apart, each pair once; counted: (word, n), words distinct.

    Shards of more than about ``shard`` words are split, each part asked by all that ask the shard.
    """
    spark = counted.sparkSession
    small_batches(spark, 5000)
    rows = materialize(postings(counted, gram_counts(counted, q), q), "postings")
    key = ["gram", "n", "p"]
    large = materialize(rows.where(F.col("role") == OWN).groupBy(*key).count().where(F.col("count") > shard).select(*key, F.ceil(F.col("count") / shard).cast("int").alias("parts")), "large-shards")
    dealt = rows.withColumn("part", F.lit(0))
    if not large.isEmpty():
        split = rows.join(large, key, "left")
        plain = split.where("parts is null").select(*rows.columns, F.lit(0).alias("part"))
        split = split.where("parts is not null")
        own = split.where(F.col("role") == OWN)
        held = own.select(*key, F.lit(INDEXED).alias("role"), "word", "count", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int").alias("part"))
        asked = split.withColumn("role", F.when(F.col("role") == OWN, SAME).otherwise(F.col("role"))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        dealt = plain.unionByName(held).unionByName(asked)

    def of_batches(batches):
        at, index, closed = None, Shard(q), False
        found: list[list] = [[], [], [], []]

        def pair(a: str, n: int, k: int) -> None:
            for column, value in zip(found, ((a, index.words[k], n, index.counts[k]) if a < index.words[k] else (index.words[k], a, index.counts[k], n)), strict=True):
                column.append(value)

        def settle() -> None:
            if len(index.own) > 1:
                index.close()
                for k in index.own:
                    for other in index.near(index.words[k], False, k):
                        pair(index.words[k], index.counts[k], other)

        for batch in batches:
            for *place, role, word, count, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (*place, part) != at:
                    if not closed:
                        settle()
                    at, index, closed = (*place, part), Shard(q), False
                if role <= INDEXED:
                    index.add(word, count, role == OWN)
                elif index.words:
                    if not closed:
                        settle()
                        if not index.lists:
                            index.close()
                        closed = True
                    for k in index.near(word, role == LONGER):
                        if word != index.words[k]:
                            pair(word, count, k)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["a", "b", "a_n", "b_n"])
            found = [[], [], [], []]
        if not closed:
            settle()
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["a", "b", "a_n", "b_n"])

    dealt = dealt.repartition(*key, "part").sortWithinPartitions(*key, "part", "role", "word")
    pairs = dealt.mapInArrow(of_batches, "a string, b string, a_n long, b_n long")
    return pairs.groupBy("a", "b").agg(F.max("a_n").alias("a_n"), F.max("b_n").alias("b_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) by following (word, form) to the last: every round doubles the steps.

    Counts at least double from a word to its form, so there are no circles and few rounds.
    """
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        after = materialize(now.join(on, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), "roots")
        discard(now)
        now = after
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def spelling_groups(docs: DataFrame, damage: int = DAMAGE, shortest: int = SHORTEST, fewest: int = FEWEST, q: int = Q, shard: int = SHARD) -> DataFrame:
    """A row per word of docs (doc_id, text, any others): word, form, root, n, n_near, form_n.

    Null and empty texts have no words; a null doc_id is the empty text in the checksum; texts
    and words of any length count whole; repeated rows count each; an empty table gives an empty
    result.  Of near words with equal counts the smallest in code-point order is the form.
    Extra columns are ignored.  Needs ``shortest`` of at least 2.
    """
    counted = materialize(words(docs, damage, shortest, fewest), "words")
    pairs = materialize(near_pairs(counted, q, shard), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near"))).alias("best"))
    follows = -F.col("best.m") >= 2 * F.col("n")
    rows = counted.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(follows, F.col("best.near")).alias("form"), F.when(follows, -F.col("best.m")).alias("form_n"))
    rows = materialize(rows, "forms")
    found = roots(rows.where("form is not null"))
    return rows.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over all documents."""
    return spelling_groups(table(spark, sf_dir, "documents"))


ORACLE = """
with recursive tab as (select list(c order by i) as t from (select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) r(i))),
tokens as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
own as (select doc_id, run, count(*) as n from tokens group by all),
coded as (select run, n, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda ch: case when ord(ch) < 128 then [ord(ch)::bigint] else [195::bigint, ord(ch)::bigint - 64] end)) as b from own),
crcs as (select run, n, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]))) as h from coded, tab),
ends as (select case when h % 97 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from crcs),
w as materialized (select word, sum(n)::bigint as n from ends where length(word) >= 5 group by word having sum(n) >= 3),
d as materialized (select word, i, substr(word, 1, i - 1) || substr(word, i + 1) as cut from (select word, unnest(range(1, length(word) + 1)) as i from w)),
near as (select a.word, b.word as near from d a join d b on a.cut = b.cut and a.i = b.i and a.word <> b.word union select d.word, w.word from d join w on d.cut = w.word union select w.word, d.word from d join w on d.cut = w.word),
best as (select a.word, count(*) as n_near, max(w.n) as most, min_by(near, (-w.n, near)) as near from near a join w on a.near = w.word group by a.word),
f as materialized (select w.word, w.n, coalesce(n_near, 0) as n_near, case when most >= 2 * w.n then near end as form, case when most >= 2 * w.n then most end as form_n from w left join best using (word)),
walk as (select word, word as at, form as next_ from f union all select walk.word, f.word, f.form from walk join f on f.word = walk.next_)
select f.word, f.form, walk.at as root, f.n, f.n_near, f.form_n from f join walk on walk.word = f.word and walk.next_ is null"""
