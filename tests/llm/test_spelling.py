"""Operator 13 against brute force and SQL."""

import os
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from aerolake.llm import queries, spelling


def apart(a, b):
    """Edit distance by the plain table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain(docs, damage=97):
    """The contract, every two words compared."""
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % damage == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = {w: [o for o in n if abs(len(o) - len(w)) <= 1 and apart(w, o) == 1] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def made(seed, letters, count):
    rng = random.Random(seed)
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(20)]
    docs = []
    for i in range(count):
        words = []
        for _ in range(60):
            w = rng.choice(stems)
            if rng.random() < 0.5:
                at, kind = rng.randrange(len(w)), rng.random()
                w = w[:at] + (rng.choice(letters) if kind < 0.7 else "") + w[at + (kind > 0.35) :]
            words.append(w.upper() if rng.random() < 0.1 else w)
        docs.append((i, rng.choice([" ", ", ", "’", "4", "ā"]).join(words)))
    return docs


@pytest.mark.parametrize(("seed", "letters", "shard"), [(1, "ab", 2000), (2, "abcdeféÉ×", 2000), (3, "ab", 3), (4, "aaab", 1)])
def test_brute_force(spark, seed, letters, shard):
    docs = made(seed, letters, 12)
    got = spelling.spelling_groups(spark.createDataFrame(docs, "doc_id long, text string"), damage=7, shard=shard).collect()
    want = plain(docs, 7)
    assert sorted(map(tuple, got), key=lambda r: r[0]) == want
    assert any(r[1] for r in want) and any(r[4] > 1 for r in want)


def test_on_lists():
    rng = random.Random(5)
    for _ in range(300):
        lists = [sorted(rng.sample(range(30), rng.randint(1, 20))) for _ in range(rng.randint(1, 9))]
        least = rng.randint(1, 6)
        seen = Counter(v for own in lists for v in own)
        assert spelling.on_lists(lists, least) == sorted(v for v, c in seen.items() if c >= least)


def test_near_words_share_rare_grams():
    """The bound and the shards lose no near pair, whatever the order of the grams."""
    import numpy as np

    rng = random.Random(6)
    for _ in range(500):
        counts = np.random.default_rng(rng.randrange(99)).integers(0, 5, spelling.BUCKETS)
        a = "".join(rng.choice("ab") for _ in range(rng.randint(5, 10)))
        at, kind = rng.randrange(len(a)), rng.random()
        b = a[:at] + rng.choice("abc") + a[at + (kind > 0.5) :]
        if apart(a, b) != 1:
            continue
        few = spelling.rarest(b, counts)
        mine = spelling.rarest(a, counts)
        mine = set(mine) if len(a) == len(b) else {(g, p + d) for g, p in mine[:3] for d in (0, 1)}
        assert mine & set(few)
        assert spelling.one_edit(a, b) and not spelling.one_edit(a, a)


def test_odd_rows(spark):
    schema = "doc_id long, text string, word string, n int"
    assert spelling.spelling_groups(spark.createDataFrame([], schema)).count() == 0
    long = "z" * 3000
    docs = [(None, None), (1, ""), (1, "4 4 .."), (2, f"{long} {long} {long} {long}a {long}a {long}a"), (3, "hallo hallo hallo hallo hallo hallo"), (3, "hallo halle halle halle"), (None, "halle")]
    got = spelling.spelling_groups(spark.createDataFrame([(*d, "x", 1) for d in docs], schema)).collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == plain(docs)


def test_query_is_sql(spark, tiny):
    duck = duckdb.connect()
    for f in os.listdir(tiny):
        duck.sql(f"create view {f.removesuffix('.parquet')} as from '{tiny}/{f}'")
    df = queries.queries()["op13_spelling"](spark, tiny)
    rel = duck.sql(queries.oracle_sql()["op13_spelling"])
    assert df.columns == rel.columns
    got = sorted(map(tuple, df.collect()), key=lambda r: r[0])
    assert got == sorted(rel.fetchall(), key=lambda r: r[0]) and len(got) > 500
