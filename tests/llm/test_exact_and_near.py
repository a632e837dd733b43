"""Operators 2 and 10 against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from aerolake.llm import exact_dedup, simhash
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, digest string, count long"  # two extra columns with clashing names


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7) for i, t in rows], SCHEMA)


ROWS = [(5, "a b"), (3, " ab "), (9, "ab"), (1, None), (2, ""), (4, " \n"), (7, "über  x"), (8, "überx"), (6, "one"), (6, "one"), (None, "one"), (10, "y\x0b\x0cz"), (11, "yz"), (12, "a b"), (13, "long " * 30_000)]


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[\\x20\\x09-\\x0D]", "", t or ""), []).append((i, t or ""))
    out = []
    for c, members in groups.items():
        best = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        out += [(i, best[0], len(members), hashlib.sha256(c.encode()).hexdigest()) for i, _ in members]
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.unhex(F.substring(F.sha2(c, 256), 1, 0)), lambda c: F.unhex(F.lit("00"))], ids=["sha256", "empty", "constant"])
def test_exact(spark, digest):
    got = exact_dedup.exact_dedup(frame(spark, ROWS), digest).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == expected(ROWS)
    kept = [r.text_sha256 for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len({r.text_sha256 for r in got})  # one row of a group, repeated ones too
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_empty(spark):
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def test_exact_from_files(spark, tmp_path):
    """Rows of files are located by file and row; large groups in few parts; a constant digest changes nothing."""
    rows = [*ROWS, *[(100 + i, "many copies") for i in range(700)], *[(900, "twice")] * 2]
    frame(spark, rows).repartition(3).write.parquet(f"file://{tmp_path}/docs")
    df = spark.read.parquet(f"file://{tmp_path}/docs")
    places = df.select(exact_dedup.locator(df).alias("at")).collect()
    assert len({(r["at"].file, r["at"].row) for r in places}) == len(rows) and len({r["at"].file for r in places}) == 3
    for digest in (exact_dedup.sha256, lambda c: F.unhex(F.lit("00"))):
        got = exact_dedup.exact_dedup(df, digest).collect()
        assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == expected(rows)
        assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})


def test_state_goes_on(spark, tmp_path):
    """The same checkpoint later counts arrivals of both runs."""
    d = lambda n: f"file://{tmp_path}/{n}"
    one = spark.createDataFrame([("k", 1), ("k", 5), ("j", 2)], "digest string, best long")
    one.write.parquet(d("in"))
    first = exact_dedup.fold_stream(spark, d("in"), one.schema, d("cp"), d("out")).collect()
    assert {(r.digest, r.group_size, r.best) for r in first} == {("k", 2, 5), ("j", 1, 2)}
    spark.createDataFrame([("k", 9)], "digest string, best long").write.mode("append").parquet(d("in"))
    again = exact_dedup.fold_stream(spark, d("in"), one.schema, d("cp"), d("out")).collect()
    assert {(r.digest, r.group_size, r.best) for r in again} == {("k", 3, 9), ("j", 1, 2)}


def fingerprint(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else ([" ".join(words)] if words else [])
    ones = np.zeros(64, int)
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        ones += [(h >> b) & 1 for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def least_reachable(ids, fps, bits=4):
    fps = np.array(fps, np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= bits
    label = np.array(ids)
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return label.tolist()
        label = new


def test_near(spark):
    rng = random.Random(5)
    words = [f"Wort{i}é" for i in range(400)]
    rows = []
    for k in range(30):
        base = [rng.choice(words) for _ in range(rng.choice([3, 4, 40, 300]))]
        for _ in range(rng.randrange(1, 4)):
            text = list(base)
            if len(text) > 10:
                text[rng.randrange(len(text))] = "changed"
            rows.append((len(rows) * 3 + 1, " ".join(text)))
    rows += [(1000, None), (1001, ""), (1002, " \t"), (1003, "Same text"), (1004, "same\ntext"), (1005, "w " * 90_000)]
    got = {r.doc_id: r for r in simhash.near_groups(frame(spark, rows)).collect()}
    fps = [fingerprint(t) for _, t in rows]
    assert [got[i].fingerprint for i, _ in rows] == [f"{v:016x}" for v in fps]
    assert [got[i].component_id for i, _ in rows] == least_reachable([i for i, _ in rows], fps)
    assert simhash.near_groups(frame(spark, [])).count() == 0


@pytest.mark.parametrize("design", [simhash.NARROW, simhash.WIDE], ids=["narrow", "wide"])
def test_designs_meet(spark, design):
    """Any two fingerprints up to 4 bits apart meet at the home anchor of the one and of the other."""
    rng = np.random.default_rng(6)
    x = rng.integers(0, 2**63, 60, dtype=np.uint64) * np.uint64(2)
    pairs = []
    for v in x:
        flips = rng.permutation(64)[: rng.integers(1, 5)]
        pairs.append((int(v), int(v ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64)))))
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    fps = spark.createDataFrame([(signed(v),) for p in pairs for v in p], "fp long")
    at = {}
    for r in simhash.anchored(fps, design).collect():
        at.setdefault(r.fp, set()).add(r.anchor)
        if r.home:
            at.setdefault(("home", r.fp), set()).add(r.anchor)
    for a, b in pairs:
        assert at["home", signed(a)] & at[signed(b)] and at["home", signed(b)] & at[signed(a)]


def test_hot_anchor_is_dealt(spark):
    """A dense ball of fingerprints stays one component when its anchors are dealt out."""
    rng = np.random.default_rng(7)
    ball = {int(np.bitwise_or.reduce(np.uint64(1) << rng.permutation(64)[:2].astype(np.uint64))) for _ in range(300)} | {0}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    fps = spark.createDataFrame([(signed(v),) for v in ball], "fp long")
    edges = simhash.links(fps, len(ball), most_homes=16).collect()
    root = {signed(v): signed(v) for v in ball}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for e in edges:
        root[find(e.a)] = find(e.b)
    assert len({find(signed(v)) for v in ball}) == 1
