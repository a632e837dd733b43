"""Operator 11: language-model scores by prediction by partial matching.

A trie of byte contexts is counted over the training texts, their words one blank
apart.  A symbol is coded in the longest context, of up to ORDER bytes, that training
has seen; where that has not seen the symbol, an escape leads to the next shorter one,
in which the symbols of the longer one are excluded.  Escapes are estimated by the
number of different symbols, each of which gives up half a count.  What a symbol costs
so follows from it and the ORDER bytes before it, its gram: grams are counted over all
texts, each distinct one is given its code length once, and documents sum their
grams'.

Words (for the base score) and grams are joined by shuffles; only the commonest of
them, of a stated number, are handed to all tasks, so that what is shuffled is the
rare rest.
"""

from __future__ import annotations

import uuid
from collections import Counter
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.llm.common import small_batches, table, utf8, worker_cache
from aerolake.runtime import discard, materialize

#: Bytes of the longest context (6 at most: a gram is packed into 64 bits).
ORDER = 5
#: One document of so many, that of this remainder, is held out.
FOLDS, HELD_OUT = 7, 2
#: Words, and grams, that every task holds, at most; bytes of such a word; distinct words, and grams, that a counting task holds.
COMMON_WORDS, COMMON_GRAMS, LONGEST, HELD, HELD_GRAMS = 1 << 17, 1 << 20, 64, 250_000, 1_500_000
#: The symbols: bytes but for white space, the blank behind a word, and the end of a text.
SYMBOLS, BLANK, END = 252, 0x20, 0x0A
#: Bytes that are worked on at once.
WINDOW = 1 << 19
COUNTED = "word string, c long, n long, tail int, grams binary, counts binary, uses binary"
LINE = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, key string, n long"


def held_out(doc_id: Column) -> Column:
    """Whether a document is held out: by the CRC-32 of its doc_id as text; a null counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def coded(tokens: list[bytes]) -> bytes:
    """A text as it is coded: a blank as the first context, each word and a blank, the end."""
    return b" ".join([b"", *tokens, b"\n"])


def packed(texts: list[bytes], order: int = ORDER, window: int = WINDOW):
    """Of every symbol of coded texts, a window at a time: the text's number, and context and symbol as one number.

    That number's bytes are a leading 1, the context from its first byte on, the symbol.
    """
    raw = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    for first in range(0, len(raw), window):
        before = max(0, first - order)
        part = raw[before : first + window].astype(np.int64)
        value = part.copy()
        for back in range(1, order + 1):
            value[back:] |= part[:-back] << (8 * back) if back < len(part) else 0
        value = value[first - before :]
        value &= (1 << 8 * (order + 1)) - 1
        value |= 1 << 8 * (order + 1)
        here = slice(np.searchsorted(starts, first - order), np.searchsorted(starts, first + window))
        for d in range(1, order):  # near a text's beginning contexts are shorter
            at = starts[here][sizes[here] > d] + d - first
            at = at[(at >= 0) & (at < len(value))]
            value[at] = shortened(value[at], d + 1)
        text = np.repeat(np.arange(len(texts)), np.clip(starts + sizes, first, first + len(value)) - np.clip(starts, first, first + len(value)))
        kept = np.ones(len(value), bool)
        kept[starts[(starts >= first) & (starts < first + window)] - first] = False  # the first blank is given
        yield text[kept], value[kept]


def tails(gram: np.ndarray) -> np.ndarray:
    """The last two bytes of grams' contexts."""
    return (gram >> 8) & 0xFFFF


def corpus_counts(docs: DataFrame, order: int = ORDER, held: int = HELD, held_grams: int = HELD_GRAMS) -> DataFrame:
    """What tasks count of all texts of (text, held_out): in training texts (c, counts), and in all (n, uses).

    Rows of words, a row a word and task, and rows of grams, packed, a row a tail of contexts and
    task; with tail -1 those of two bytes, the training texts' alone.  What a task holds is bounded.
    """
    names = [x.split()[0] for x in COUNTED.split(", ")]

    def of_batches(batches):
        words, found, waiting = (Counter(), Counter()), ([], []), 0

        def of_words():
            train, apart = words
            n = [(w, c, c + apart.pop(w, 0)) for w, c in train.items()] + [(w, 0, c) for w, c in apart.items()]
            train.clear()
            apart.clear()
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w, _, _ in n], pa.string()), pa.array([c for _, c, _ in n], pa.int64()), pa.array([u for _, _, u in n], pa.int64()), pa.nulls(len(n), pa.int32()), *[pa.nulls(len(n), pa.binary())] * 3], names)

        def merged() -> int:
            for parts in found:
                if parts:
                    parts[:] = [counted(*(np.concatenate(c) for c in zip(*parts, strict=True)))]
            return sum(len(g) for parts in found for g, _ in parts)

        def of_grams():
            both = [parts[0] if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64)) for parts in found]
            (train, c), (_, other) = both
            gram, uses = counted(np.concatenate([g for g, _ in both]), np.concatenate((c, other)))
            own = np.zeros(len(gram), np.int64)
            own[np.searchsorted(gram, train)] = c
            for parts in found:
                parts.clear()
            low = counted(shortened(train, 2), c)
            order_ = np.argsort(tails(gram), kind="stable")
            gram, own, uses = gram[order_], own[order_], uses[order_]
            start = np.flatnonzero(np.diff(tails(gram), prepend=-1))
            blocks = [(int(tails(gram[a : a + 1])[0]), gram[a:b], own[a:b], uses[a:b]) for a, b in pairwise([*start.tolist(), len(gram)])]
            blocks.append((-1, *low, low[1]))
            for at in range(0, len(blocks), 500):
                some = blocks[at : at + 500]
                packed_ = [pa.array([x[k].astype(kind).tobytes() for x in some], pa.binary()) for k, kind in ((1, "<i8"), (2, "<u4"), (3, "<u4"))]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.string()), *[pa.nulls(len(some), pa.int64())] * 2, pa.array([x[0] for x in some], pa.int32()), *packed_], names)

        for batch in batches:
            texts: tuple[list, list] = ([], [])
            for raw, apart in zip(utf8(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                tokens = raw.lower().split()
                words[apart].update(tokens)
                texts[apart].append(coded(tokens))
            for k in (0, 1):
                for _, gram in packed(texts[k], order):
                    gram.sort()
                    start = np.flatnonzero(np.diff(gram, prepend=-1))
                    found[k].append((gram[start], np.diff(np.append(start, len(gram)))))
                    waiting += len(start)
            if sum(map(len, words)) > held:
                yield from of_words()
            if waiting > held_grams:
                waiting = merged()
                if waiting > held_grams // 2:
                    yield from of_grams()
                    waiting = 0
        yield from of_words()
        merged()
        yield from of_grams()

    small_batches(docs.sparkSession, 200)
    return materialize(docs.select("text", "held_out").mapInArrow(of_batches, COUNTED), "corpus-counts")


def of_size(size: int) -> int:
    """The smallest number of a gram of so many bytes."""
    return 1 << (8 * size)


def shortened(gram: np.ndarray, size: int) -> np.ndarray:
    """The last ``size`` bytes of grams."""
    return (gram & (of_size(size) - 1)) | of_size(size)


def counted(gram: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams in order, with their counts summed."""
    order = np.argsort(gram, kind="stable")
    gram, n = gram[order], n[order]
    starts = np.flatnonzero(np.diff(gram, prepend=-1))
    return gram[starts], np.add.reduceat(n, starts) if len(starts) else n[:0]


def found_at(wanted: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Where values stand in an ordered array; -1 where they do not."""
    if not len(held):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
    return np.where(held[at] == wanted, at, -1)


class Level:
    """The contexts of one order: counts of their symbols, totals, and what an escape to the order below finds there."""

    def __init__(self, gram: np.ndarray, n: np.ndarray, below: Level | None, order: int):
        self.gram, self.n = gram, n
        self.context, start = np.unique(gram >> 8, return_index=True)
        self.total = np.add.reduceat(n, start) if len(start) else n[:0]
        self.kinds = np.diff(np.append(start, len(gram)))
        if below is not None and len(gram):
            known = below.n[found_at(shortened(gram, order), below.gram)]  # whatever follows a context follows its end
            parent = found_at(shortened(self.context, order - 1), below.context)
            self.rest = below.total[parent] - np.add.reduceat(known, start)
            self.rest_kinds = below.kinds[parent] - self.kinds


def levels(gram: np.ndarray, n: np.ndarray, low: list[tuple[np.ndarray, np.ndarray]], order: int = ORDER) -> list[Level]:
    """Levels of orders 0 to ``order`` for the grams of a shard; ``low``: the whole corpus's grams of orders 0 and 1."""
    out: list[Level] = []
    for o in range(order + 1):
        if o < len(low):
            own = low[o]
        else:
            long = (gram >= of_size(o + 1)) & (n > 0)
            own = counted(shortened(gram[long], o + 1), n[long])
        out.append(Level(*own, out[-1] if out else None, o))
    return out


def log_probabilities(gram: np.ndarray, held: list[Level]) -> np.ndarray:
    """log10 of each gram's symbol after its context."""
    lp, done = np.zeros(len(gram)), np.zeros(len(gram), bool)
    last = np.full(len(gram), -1)  # the context just escaped from, of the order above
    for o in range(len(held) - 1, -1, -1):
        level = held[o]
        at = np.flatnonzero(~done & (gram >= of_size(o + 1)))
        context = found_at(shortened(gram[at] >> 8, o), level.context)
        at, context = at[context >= 0], context[context >= 0]
        if not len(at):
            continue
        total, kinds, above = level.total[context], level.kinds[context], last[at]
        escaped = above >= 0
        if escaped.any():
            total[escaped], kinds[escaped] = held[o + 1].rest[above[escaped]], held[o + 1].rest_kinds[above[escaped]]
        symbol = found_at(shortened(gram[at], o + 1), level.gram)
        hit = (symbol >= 0) & (kinds > 0)
        lp[at[hit]] += np.log10((2 * level.n[symbol[hit]] - 1) / (2 * total[hit]))
        done[at[hit]] = True
        miss = ~hit & (kinds > 0)
        lp[at[miss]] += np.log10(kinds[miss] / (2 * total[miss]))
        last[at] = context
    seen = held[0].kinds[0] if len(held[0].kinds) else 0
    lp[~done] -= np.log10(max(1, SYMBOLS - seen))
    return lp


def unpacked(batches) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Gram, count and uses of packed rows (grams, counts, uses), each gram once; None of no rows."""
    parts = [[np.frombuffer(v.as_py(), kind).astype(np.int64) for v in batch.column(k)] for batch in batches for k, kind in ((0, "<i8"), (1, "<u4"), (2, "<u4"))]
    gram, n, uses = (np.concatenate([x for p in parts[k::3] for x in p] or [np.zeros(0, np.int64)]) for k in range(3))
    if not len(gram):
        return None
    distinct, n = counted(gram, n)
    return distinct, n, counted(gram, uses)[1]


def scored_grams(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, lp, uses): each gram's log10 probability under the trie of them all, from the tasks' counts.

    All contexts of a symbol that are longer than a byte end in the same two bytes, their tail: grams
    are dealt by it, and a task sums them and has all longer contexts of its grams.  The shorter
    ones, of which there are 252 and 252 squared at most, go to every task.
    """
    names = ["gram", "lp", "uses"]

    def of_low(batches):
        if found := unpacked(batches):
            yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["gram", "n"])

    rows = counts.where("tail = -1").select("grams", "counts", "uses").mapInArrow(of_low, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).orderBy("gram").toArrow()
    gram, n = rows["gram"].to_numpy(), rows["n"].to_numpy()
    shared = counts.sparkSession.sparkContext.broadcast([counted(shortened(gram, 1), n), (gram, n)])

    def of_batches(batches):
        if found := unpacked(batches):
            gram, n, uses = found
            lp = log_probabilities(gram, levels(gram, n, shared.value, order))
            for at in range(0, len(gram), 100_000):
                some = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(gram[some]), pa.array(lp[some]), pa.array(uses[some])], names)

    return counts.where("tail >= 0").select("tail", "grams", "counts", "uses").repartition("tail").select("grams", "counts", "uses").mapInArrow(of_batches, "gram long, lp double, uses long")


def least_common(rows: DataFrame, by: str, most: int) -> int:
    """The least power of two that at most ``most`` rows reach in ``by``."""
    counts = rows.agg(*[F.sum((F.col(by) >= F.lit(1 << j)).cast("long")).alias(str(j)) for j in range(48)]).first()
    return next((1 << j for j in range(48) if (counts[j] or 0) <= most), 1 << 48)


class Table:
    """Values of numbers: a slot each by a hash, and an ordered array for those whose slot another has."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        self.bits = max(4, int(len(keys)).bit_length() + 1)
        slot = self.slot(keys)
        self.held, self.own = np.zeros(1 << self.bits, np.int64), np.zeros(1 << self.bits)
        self.held[slot], self.own[slot] = keys, values

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values (0 where there is none), and where there is none."""
        slot = self.slot(keys)
        out = self.own[slot]
        other = np.flatnonzero(self.held[slot] != keys)
        at = found_at(keys[other], self.keys)
        out[other] = np.where(at >= 0, self.values[at] if len(self.values) else 0.0, 0.0)
        return out, other[at < 0]


def lm_scores(docs: DataFrame, order: int = ORDER, common_words: int = COMMON_WORDS, common_grams: int = COMMON_GRAMS) -> DataFrame:
    """A row per row of docs (doc_id, text, any others): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts are their end alone.  score: log10 of the probability of the words, one
    blank apart, and of the text's end.  A null doc_id is the empty text in the checksum that parts
    the folds.  Texts and words of any length count whole; repeated rows are scored each; without
    training texts all symbols are alike.  Extra columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    counts = corpus_counts(rows, order)
    words = materialize(counts.where("word is not null").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("uses")), "vocabulary")
    trained = rows.where("not held_out").count()
    total, kinds = (v or 0 for v in words.agg(F.sum("c"), F.sum((F.col("c") > 0).cast("long"))).first())
    total, kinds = total + trained, kinds + (trained > 0)
    grams = materialize(scored_grams(counts, order), "scored-grams")
    discard(counts)
    common = F.col("uses") >= least_common(grams, "uses", common_grams)
    short = F.octet_length("word") <= LONGEST
    known_ = short & (F.col("uses") >= least_common(words.where(short), "uses", common_words))
    table_ = grams.where(common).orderBy("gram").toArrow()  # so many numbers at most
    list_ = words.where(known_).toArrow()  # so many short words at most
    shared = spark.sparkContext.broadcast((list_["word"].to_pylist(), list_["c"].to_numpy(), table_["gram"].to_numpy(), table_["lp"].to_numpy()))
    words, grams = words.where(~known_), grams.where(~common)
    name = uuid.uuid4().hex

    def of_batches(batches):
        def held():
            list_, c, gram, lp = shared.value
            return {w.encode(): v for w, *v in zip(list_, np.log10(c + 1.0).tolist(), (c > 0).tolist(), strict=True)}, Table(gram, lp)

        known, lps = worker_cache(("common", name), held)
        for batch in batches:
            texts, own, rare = [], [], []
            for at, raw in enumerate(utf8(batch.column(2))):
                tokens = raw.lower().split()
                texts.append(coded(tokens))
                base, seen = 0.0, 0
                for w, n in Counter(tokens).items():
                    if v := known.get(w):
                        base += n * v[0]
                        seen += n * v[1]
                    else:
                        rare.append((at, w.decode(), n))
                own.append((len(tokens) + 1, seen, base))
            score, missing = np.zeros(len(texts)), []
            for text, gram in packed(texts, order):
                lp, none = lps.of(gram)
                score += np.bincount(text, lp, len(texts))
                missing.append((text[none], gram[none]))
            row = np.asarray(batch.column(0), np.int64)
            # a document's own row: no word holds a line's end, so it is joined with nothing
            out = [pa.array(row), batch.column(1), batch.column(3), *(pa.array([o[k] for o in own], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))), pa.array(score), pa.array([f"\r{r}" for r in row.tolist()], pa.string()), pa.array(np.zeros(len(row), np.int64))]
            yield pa.RecordBatch.from_arrays(out, names)
            for at, key, n in ((np.array([r[0] for r in rare], np.int64), pa.array([r[1] for r in rare], pa.string()), np.array([r[2] for r in rare], np.int64)), of_missing(missing)):
                no, zero, zeros = len(at), pa.array(np.zeros(len(at), np.int64)), pa.array(np.zeros(len(at)))
                yield pa.RecordBatch.from_arrays([pa.array(row[at]), pa.nulls(no, pa.int64()), pa.nulls(no, pa.bool_()), zero, zero, zeros, zeros, key, pa.array(n)], names)

    def of_missing(missing):
        """(text, key, n) of grams that the table has not, each once a text."""
        text, gram = (np.concatenate(c) for c in zip(*missing, strict=True)) if missing else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        order_ = np.lexsort((gram, text))
        text, gram = text[order_], gram[order_]
        start = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(gram, prepend=-1) != 0))
        return text[start], pa.array([f"\n{g}" for g in gram[start].tolist()], pa.string()), np.diff(np.append(start, len(gram)))

    names = [x.split()[0] for x in LINE.split(", ")]
    small_batches(spark, 200)
    lines = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "held_out").mapInArrow(of_batches, LINE)
    nothing = F.lit(None)
    looked_up = words.select(F.col("word").alias("key"), "c", nothing.cast("double").alias("lp")).unionByName(grams.select(F.concat(F.lit("\n"), F.col("gram").cast("string")).alias("key"), nothing.cast("long").alias("c"), "lp"))
    own = lines.join(looked_up, "key", "left").groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.coalesce(F.col("n") * F.log10(F.col("c") + 1), F.lit(0.0))).alias("base"),
        F.sum(F.col("score") + F.coalesce(F.col("n") * F.col("lp"), F.lit(0.0))).alias("score"),
    )
    base = F.col("base") + F.lit(float(np.log10(trained + 1.0))) - F.col("n_tokens") * F.lit(float(np.log10(total + kinds + 1.0)))
    return own.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.lit(int(trained > 0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op11_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over all documents."""
    return lm_scores(table(spark, sf_dir, "documents"))
