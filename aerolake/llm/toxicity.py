"""Operator 7: toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of ordinary text and one on
the toxic stretches of toxic documents: those whose letter groups toxic documents
hold far more often than ordinary ones, as the rest of a toxic document is
ordinary text.  Windows run over several words.  A window is compressed under the
ordinary dictionary and under the toxic one, which goes on with the ordinary
content, so that its distance, the bytes that the toxic dictionary saves, comes
from toxic text and not from how well either knows ordinary words.  The windows
beyond each of a few distances are counted, and calibrated into the score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.llm.common import small_batches, table, utf8, worker_cache

#: Bounds of the training sample: labelled documents of each kind, by hash order, and bytes of a document (longer ones are not trained on).
TOXIC_DOCS, ORDINARY_DOCS, DOC_BYTES = 2000, 6000, 1 << 15
#: Bytes of the dictionaries at most, and of the segments that training picks for them.
TOXIC_BYTES, ORDINARY_BYTES, TOXIC_SEGMENT, ORDINARY_SEGMENT = 2048, 32768, 8, 24
#: Bytes of a letter group; how much more often toxic documents hold it than ordinary ones.
GROUPS, RATIO = range(5, 12), 50
#: Places for hashed word contexts of the sample.
CONTEXTS = 1 << 26
#: Words of a window, words between the starts of two, and bytes of a word (a longer one counts as several).
WORDS, STRIDE, WORD_BYTES = 6, 3, 64
#: The level whose parser seeks the shortest coding; distances whose windows are counted; the score from which a document is called toxic.
LEVEL, STEPS, CALLED = 13, range(1, 7), 0.3
_WORD = re.compile(rb"[a-z0-9'\x80-\xff]{1,%d}" % WORD_BYTES)
#: Fixed value of the format: the three repeat offsets, after which a trained dictionary's content begins.
_OFFSETS = b"\1\0\0\0\4\0\0\0\x08\0\0\0"


def words(raw: bytes) -> list[bytes]:
    """A text's words, ASCII letters lower-cased, without punctuation."""
    return _WORD.findall(raw.lower())


def windows(raw: bytes) -> list[bytes]:
    """Stretches of WORDS words, each word in two of them."""
    w = words(raw)
    return [b" " + b" ".join(w[i : i + WORDS]) + b" " for i in range(0, max(1, len(w) - WORDS + STRIDE), STRIDE)] if w else []


def _groups(word: bytes) -> set[bytes]:
    return {word[i : i + k] for k in GROUPS for i in range(len(word) - k + 1)}


class Model:
    """The two dictionaries and the calibrated weights; picklable."""

    def __init__(self, toxic: bytes = b"", ordinary: bytes = b"", weights=None):
        self.toxic, self.ordinary, self.weights = toxic, ordinary, weights

    def __getstate__(self):
        return self.toxic, self.ordinary, self.weights

    def __setstate__(self, state):
        self.toxic, self.ordinary, self.weights = state

    def compressors(self):
        """What compresses a window under the ordinary dictionary, and under the toxic one."""

        def of(dictionary: bytes):
            held = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_FULLDICT)
            bare = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
            return zstandard.ZstdCompressor(dict_data=held, compression_params=bare).compress

        tables, content = split_dictionary(self.ordinary)
        return of(self.ordinary), of(tables + split_dictionary(self.toxic)[1] + content)

    def distances(self, raw: bytes, compressors) -> np.ndarray:
        """By window, the bytes that the toxic dictionary saves."""
        ordinary, toxic = compressors
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(raw)], int)

    def features(self, raw: bytes, compressors) -> np.ndarray:
        """Windows at each distance or beyond, their number and share, and the number of windows."""
        found = self.distances(raw, compressors)
        over = np.array([(found >= t).sum() for t in STEPS])
        return np.concatenate((np.log1p(over), np.sqrt(over / max(1, len(found))), [np.log1p(len(found))]))

    def score(self, features: np.ndarray) -> np.ndarray:
        """Probabilities of rows of features."""
        if self.weights is None:
            return np.zeros(len(features))
        centre, scale, w, bias = self.weights
        return 1 / (1 + np.exp(-np.clip((features - centre) / scale @ w + bias, -50, 50)))


def held_out(doc_id: Column) -> Column:
    """True for the rows that nothing may be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(texts: list[bytes], labels: list[int]) -> Model:
    """Fit on a bounded sample.  Two thirds train the dictionaries, one third the thresholds.

    Without texts of either kind the model scores everything 0.
    """
    order = range(len(texts))
    toxic, ordinary = ([k for k in order if labels[k] == y] for y in (1, 0))
    if len(toxic) < 3 or len(ordinary) < 3:
        return Model()
    fit = [k for part in (toxic, ordinary) for k in part[: -(-2 * len(part) // 3)]]
    calibrate = [k for part in (toxic, ordinary) for k in part[-(-2 * len(part) // 3) :]]
    # How many toxic documents hold a letter group, against ordinary ones.  A word counts where its neighbours are new, so copies of a document count once.
    counts: tuple[Counter, Counter] = Counter(), Counter()
    docs, seen = [0, 0], (bytearray(CONTEXTS), bytearray(CONTEXTS))
    for k in fit:
        w, new, had = [b"", *words(texts[k]), b""], set(), seen[labels[k]]
        for i in range(1, len(w) - 1):
            at = zlib.crc32(b" ".join(w[i - 1 : i + 2])) % CONTEXTS
            if not had[at]:
                had[at] = 1
                new.add(b" " + w[i] + b" ")
        counts[labels[k]].update(new)
        docs[labels[k]] += bool(new)
    held: Counter = Counter()
    for word, n in counts[1].items():
        for g in _groups(word):
            held[g] += n
    held = Counter({g: n for g, n in held.items() if n >= max(3, docs[1] / 100)})
    also: Counter = Counter()
    for word, n in counts[0].items():
        for g in _groups(word) & held.keys():
            also[g] += n
    telling = {g for g, n in held.items() if n / docs[1] >= RATIO * (also[g] + 0.5) / docs[0]}
    stretches = []
    for word, n in sorted(counts[1].items()):
        marked = bytearray(len(word))
        for k in GROUPS:
            for i in range(len(word) - k + 1):
                if word[i : i + k] in telling:
                    marked[i : i + k] = b"\1" * k
        stretches += [word[m.start() : m.end()].ljust(8) for m in re.finditer(b"\1+", bytes(marked))] * n
    plain = [b" " + b" ".join(w[i : i + 4]) + b" " for k in fit if not labels[k] for w in [words(texts[k])] for i in range(0, len(w), 4)]
    rng = np.random.default_rng(7)
    pick = lambda x, most: [x[i] for i in rng.permutation(len(x))[:most]]
    model = Model(_dictionary(TOXIC_BYTES, TOXIC_SEGMENT, pick(stretches, 100_000)), _dictionary(ORDINARY_BYTES, ORDINARY_SEGMENT, pick(plain, 200_000)))
    if not model.toxic or not model.ordinary:
        return Model()
    compressors = model.compressors()
    x = np.array([model.features(texts[k], compressors) for k in calibrate])
    model.weights = logistic(x, np.array([labels[k] for k in calibrate], float))
    return model


def split_dictionary(trained: bytes) -> tuple[bytes, bytes]:
    """A trained dictionary's entropy tables and its content."""
    at = trained.index(_OFFSETS) + len(_OFFSETS)
    return trained[:at], trained[at:]


def _dictionary(size: int, segment: int, samples: list[bytes]) -> bytes:
    """A trained dictionary; of few samples, which training refuses, a smaller one of them repeated; of none b""."""
    for tried in (samples, samples * (1 + 4000 // max(1, len(samples)))):
        for most in (size, 2048, 512, 256):
            try:
                return zstandard.train_dictionary(most, tried, k=segment, d=6).as_bytes()
            except zstandard.ZstdError:
                pass
    return b""


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50):
    """(centre, scale, weights, bias) by Newton steps with a ridge."""
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[(x - centre) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    lam = np.r_[np.full(z.shape[1] - 1, ridge), 1e-6]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(lam), z.T @ (p - y) + lam * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return centre, scale, w[:-1], w[-1]


def learn(docs: DataFrame, labels: DataFrame, toxic_docs: int = TOXIC_DOCS, ordinary_docs: int = ORDINARY_DOCS, doc_bytes: int = DOC_BYTES) -> Model:
    """Train on labelled rows outside the held-out fold, at most so many of each kind, by hash order of doc_id.

    Of these, documents of more than ``doc_bytes`` bytes are left out, so what reaches the
    driver is bounded in bytes.  Of rows that repeat a doc_id one counts.
    """
    usable = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "toxic")
    order = F.xxhash64(F.lit(11), F.col("doc_id"))
    ids = usable.where("toxic = 1").orderBy(order, "doc_id").limit(toxic_docs).unionAll(usable.where("toxic = 0").orderBy(order, "doc_id").limit(ordinary_docs))
    sample = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= doc_bytes).join(F.broadcast(ids), "doc_id")  # toxic_docs + ordinary_docs rows at most
    rows = sorted(sample.dropDuplicates(["doc_id"]).select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("raw"), "toxic").toLocalIterator(), key=lambda r: (r.doc_id * 2654435761 % (1 << 32), r.doc_id))
    return train([bytes(r.raw) for r in rows], [r.toxic for r in rows])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs (doc_id, text, any others): doc_id, held_out, score, predicted.

    Null and empty texts are scored like a text without windows; texts of any length
    are scored whole.  Equal texts get equal scores, and repeated rows give repeated
    rows; a null doc_id counts as not held out.  Extra columns are ignored;
    an empty table gives an empty result.
    """
    import pickle

    coded = pickle.dumps((model.toxic, model.ordinary, model.weights))

    def of_batches(batches):
        own = Model(*pickle.loads(coded))
        compressors = worker_cache(("toxicity", coded), own.compressors) if own.weights is not None else None
        for batch in batches:
            if batch.num_rows:
                raws = utf8(batch.column(1))
                p = own.score(np.array([own.features(raw, compressors) for raw in raws])) if compressors else np.zeros(len(raws))
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(p)], ["doc_id", "score"])

    small_batches(docs.sparkSession)
    out = docs.select("doc_id", "text").mapInArrow(of_batches, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CALLED).cast("int").alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over all documents."""
    docs = table(spark, sf_dir, "documents")
    return scored(docs, learn(docs, table(spark, sf_dir, "labels")))
