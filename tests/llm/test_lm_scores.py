"""Operator 11 against a plain trie with explicit exclusion."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from aerolake.llm import lm_scores, queries


def folds(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 7 == 2


class Plain:
    """Counts of every context's symbols; a symbol's probability by walking down with a set of excluded symbols."""

    def __init__(self, texts, order):
        self.order, self.seen = order, defaultdict(Counter)
        for text in texts:
            for j in range(1, len(text)):
                for k in range(min(order, j) + 1):
                    self.seen[text[j - k : j]][text[j]] += 1

    def p(self, context, symbol):
        out, excluded = 1.0, set()
        for k in range(min(self.order, len(context)), -1, -1):
            left = {s: n for s, n in self.seen.get(context[len(context) - k :], {}).items() if s not in excluded}
            if left:
                n = sum(left.values())
                if symbol in left:
                    return out * (2 * left[symbol] - 1) / (2 * n)
                out *= len(left) / (2 * n)
                excluded |= set(left)
        return out / (252 - len(excluded))


def coded(text):
    return b"".join([b" ", *[w + b" " for w in (text or "").encode().lower().split()], b"\n"])


def plain(docs, order):
    train = [t for d, t in docs if not folds(d)]
    model, c = Plain([coded(t) for t in train], order), Counter()
    for t in train:
        c.update([*(t or "").encode().lower().split(), b"\n"])
    n, kinds = sum(c.values()), len(c)
    out = []
    for d, t in docs:
        raw, tokens = coded(t), [*(t or "").encode().lower().split(), b"\n"]
        base = sum(math.log10((c[w] + 1) / (n + kinds + 1)) for w in tokens)
        score = sum(math.log10(model.p(raw[max(0, j - order) : j], raw[j])) for j in range(1, len(raw)))
        out.append((d, folds(d), len(tokens), sum(c[w] > 0 for w in tokens), n, base, score))
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], abs=1e-6) and g[6] == pytest.approx(w[6], abs=1e-6)


def made(seed, n, letters="abcdé"):
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(30)]
    return [(i, rng.choice([" ", "\n", " \t "]).join(rng.choice(words).title() if rng.random() < 0.9 else "".join(rng.choice(letters + "x.") for _ in range(6)) for _ in range(rng.randint(0, 40)))) for i in range(n)]


@pytest.mark.parametrize(("order", "words", "grams"), [(6, 1 << 17, 1 << 20), (6, 3, 20), (3, 0, 0), (1, 10, 10)])
def test_plain_trie(spark, order, words, grams):
    docs = made(order, 60)
    got = lm_scores.lm_scores(spark.createDataFrame(docs, "doc_id long, text string"), order, words, grams).collect()
    same(got, plain(docs, order))


def test_windows():
    """Grams do not depend on where windows end."""
    texts = [coded(t) for _, t in made(3, 25)] + [b" \n"]
    for order in (1, 4, 6):
        whole = [np.concatenate(c) for c in zip(*lm_scores.packed(texts, order), strict=True)]
        for window in (1, 7, 50):
            parts = [np.concatenate(c) for c in zip(*lm_scores.packed(texts, order, window), strict=True)]
            assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
        want = [(k, b"\x01" + t[max(0, j - order) : j + 1]) for k, t in enumerate(texts) for j in range(1, len(t))]
        assert [(k, int.from_bytes(g, "big")) for k, g in want] == list(zip(*(x.tolist() for x in whole), strict=True))


def test_probabilities_sum_to_one(spark):
    texts = [coded(t) for _, t in made(4, 40)]
    _, gram = (np.concatenate(c) for c in zip(*lm_scores.packed(texts, 4), strict=True))
    gram, n = lm_scores.counted(gram, np.ones(len(gram), np.int64))
    low = [lm_scores.counted(lm_scores.shortened(gram, size), n) for size in (1, 2)]
    held = lm_scores.levels(gram, n, low, 4)
    symbols = np.array(sorted({*range(256)} - {9, 11, 12, 13}), np.int64)
    assert len(symbols) == lm_scores.SYMBOLS
    for context in (b" ", b"a", b" ab", b"cd ", b"zzzz", b"zz a", b"\xc3\xa9"):
        lead = int.from_bytes(b"\x01" + context[-4:], "big") << 8
        assert (10 ** lm_scores.log_probabilities(lead | symbols, held)).sum() == pytest.approx(1)


def test_bounded_counting(spark):
    """Counts are the same however often a task sends on what it holds."""
    docs = spark.createDataFrame([(t, i % 3 == 0) for i, t in made(9, 40)], "text string, held_out boolean").coalesce(1)

    def sums(held, grams):
        rows = lm_scores.corpus_counts(docs, 4, held, grams)
        words = {(r.word, r.c, r.n) for r in rows.where("word is not null").groupBy("word").agg({"c": "sum", "n": "sum"}).toDF("word", "c", "n").collect()}
        return words, {tuple(r) for r in lm_scores.scored_grams(rows, 4).collect()}

    assert sums(10**6, 10**6) == sums(5, 50)


def test_table():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 55, 5000))
    values = rng.normal(size=len(keys))
    held = lm_scores.Table(keys[::2], values[::2])
    got, none = held.of(keys)
    assert (np.sort(none) == np.arange(1, len(keys), 2)).all() and np.allclose(got[::2], values[::2]) and (got[1::2] == 0).all()


def test_odd_rows(spark):
    schema = "doc_id long, text string, n int, key string"
    frame = lambda docs: spark.createDataFrame([(*d, 1, "x") for d in docs], schema)
    assert lm_scores.lm_scores(frame([])).count() == 0
    docs = [(None, None), (1, ""), (1, "  "), (2, "a" * 5000 + " b"), (3, "same text"), (3, "same text"), (None, "tränen 漢字  x"), (4, "word " * 3000)]
    same(lm_scores.lm_scores(frame(docs)).collect(), plain(docs, lm_scores.ORDER))
    apart = [d for d in range(60) if folds(d)][:2]
    same(lm_scores.lm_scores(frame([(d, "only held out") for d in apart])).collect(), plain([(d, "only held out") for d in apart], lm_scores.ORDER))


def test_query(spark, tiny):
    rows = queries.queries()["op11_lm_scores"](spark, tiny).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    same(rows, plain(docs, lm_scores.ORDER))
