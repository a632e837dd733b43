"""Hashed n-grams of whole texts: the features of operators 4 and 6."""

from __future__ import annotations

import re
import zlib

import numpy as np

from aerolake.llm.common import worker_cache

#: Runs of letters and digits, or of other signs; whatever the script, since bytes from 0x80 count as letters.
TOKEN = re.compile(rb"[a-z0-9\x80-\xff]+|[^a-z0-9\x80-\xff\x20\x09-\x0D]+")
BUCKETS = 1 << 14


class Grams:
    """Buckets of a text's uni- and bigrams; token hashes are remembered, up to ``most`` of them.

    stem: bytes of a token that count (None: all).  pairs: with bigrams; without,
    only a word said twice makes one.
    """

    def __init__(self, buckets: int = BUCKETS, stem: int | None = None, pairs: bool = True, most: int = 300_000):
        self.buckets, self.stem, self.pairs, self.most, self.known = buckets, stem, pairs, most, {}

    def hashes(self, raw: bytes) -> np.ndarray:
        """A 32-bit hash per token, in order."""
        tokens, known = TOKEN.findall(raw.lower()), self.known
        if missing := {t for t in tokens if t not in known}:
            if len(known) + len(missing) > self.most:
                known.clear()
                missing = set(tokens)
            known.update((t, zlib.crc32(t[: self.stem])) for t in missing)
        return np.array([known[t] for t in tokens], np.uint64)

    def of(self, raw: bytes) -> np.ndarray:
        """The bucket of every unigram, then of every bigram."""
        return self.buckets_of(self.hashes(raw))

    def buckets_of(self, h: np.ndarray) -> np.ndarray:
        """The same from the tokens' hashes."""
        if not len(h):
            return np.zeros(0, np.int64)
        again = h[:-1] == h[1:]
        if self.pairs:
            pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(29)
            pairs[again] = 0  # a word said twice is one bigram, whatever the word
        else:
            pairs = np.zeros(int(again.sum()), np.uint64)
        return np.concatenate((h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33), pairs)).astype(np.int64) % self.buckets


def grams(*kind) -> Grams:
    """The worker's own, kept over tasks."""
    return worker_cache(("grams", *kind), lambda: Grams(*kind))
