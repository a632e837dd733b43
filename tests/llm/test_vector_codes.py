"""Operator 12 against a plain Lloyd."""

import hashlib
import os

import duckdb
import numpy as np
import pytest

from aerolake.llm import queries, vector_codes


def plain(rows, parts, k, rounds, unit=1024):
    """(by row: code, error), codebooks; rows: (id, vector)."""
    x = np.floor(np.array([v for _, v in rows], float) * unit).astype(object)
    width = x.shape[1] // parts
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, list(x[i])))[:k]
    books = [[list(x[i][p * width : (p + 1) * width]) for i in order] for p in range(parts)]

    def nearest(v, book):
        far = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in book]
        return min(range(len(book)), key=lambda e: (far[e], e)), min(far)

    for r in range(rounds + 1):
        found = [[nearest(v[p * width : (p + 1) * width], books[p]) for p in range(parts)] for v in x]
        if r < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    own = [v[p * width : (p + 1) * width] for v, f in zip(x, found, strict=True) if f[p][0] == e]
                    if own:
                        books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    return [([e for e, _ in f], sum(d for _, d in f)) for f in found], books


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(a) for a in v], lab, "x") for i, v, lab in rows], "vec_id long, embedding array<double>, label int, code string")


@pytest.mark.parametrize(("seed", "k", "groups", "grid"), [(0, 12, 4, 3), (1, 40, 16, 40), (2, 7, 1, 2), (3, 60, 5, 1000)])
def test_plain_lloyd(spark, seed, k, groups, grid):
    rng = np.random.default_rng(seed)
    x = rng.integers(-grid, grid + 1, (300, 8)) / 64  # a coarse grid makes many ties
    x[50:60] = x[40:50]
    rows = [(int(i), v.tolist(), int(i) % 3) for i, v in zip(rng.permutation(300), x, strict=True)]
    got, books = vector_codes.vector_codes(frame(spark, rows), 2, k, 3, groups)
    got = {r.vec_id: (r.code, r.error, r.scanned) for r in got.collect()}
    want, want_books = plain([(i, v) for i, v, _ in rows], 2, k, 3)
    assert books.tolist() == want_books
    assert {i: g[:2] for i, g in got.items()} == {i: w for (i, _, _), w in zip(rows, want, strict=True)}


def test_bounds_spare_distances(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 8, (60, 8))
    rows = [(i, (centres[i % 60] + rng.normal(0, 0.05, 8)).tolist(), 0) for i in range(1500)]
    got, _ = vector_codes.vector_codes(frame(spark, rows), 2, 60, 4, 12)
    assert np.mean([r.scanned for r in got.collect()]) < 0.4 * 2 * 60 * 5


def test_bounds_hold(spark):
    """In every round upper bounds are at least, and groups' bounds at most, the true distances."""
    rng = np.random.default_rng(6)
    x = rng.integers(-400, 400, (500, 6))
    entries = x[:30].astype(np.int64)
    groups = vector_codes.groups_of(entries, 6)
    code, upper, lower, before = np.full(500, -1), np.zeros(500), np.zeros((500, groups.max() + 1)), None
    for _ in range(5):
        book = vector_codes.Codebook(entries, groups, before)
        code, upper, lower, _ = book.assign(x, code, upper, lower)
        far = np.sqrt(((x[:, None] - entries[None]) ** 2).sum(-1))
        assert (code == far.argmin(axis=1)).all() and (upper >= far[np.arange(500), code]).all()
        far[np.arange(500), code] = np.inf
        for g in range(groups.max() + 1):
            assert (lower[:, g] <= far[:, groups == g].min(axis=1)).all()
        upper, lower = np.ceil(upper), np.floor(np.clip(lower, -1, 2.0**40))
        before = entries
        entries = np.array([x[code == e].sum(axis=0) // max(1, (code == e).sum()) if (code == e).any() else entries[e] for e in range(30)])


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None, 1), (2, [inf, 0, 0, 0], 1), (3, [nan, 0, 0, 0], 1), (4, [0.5, None, 1, 2], 1)]
    rows = [(i, None if v is None else v, lab) for i, v, lab in rows]
    bad = spark.createDataFrame([(i, v if v is None else [None if a is None else float(a) for a in v], lab, "x") for i, v, lab in rows], "vec_id long, embedding array<double>, label int, error string")
    got, books = vector_codes.vector_codes(bad)
    assert got.count() == 0 and books.shape[1] == 0
    assert vector_codes.vector_codes(bad.limit(0))[0].count() == 0
    # a null id, repeated ids, uneven lengths, no label, far components
    mixed = frame(spark, [(None, [0.1, 0.2, 0.3], None), (7, [1, 2, 3, 4, 5], None), (7, [1, 2, 3, 4, 5], 2), (8, [], 2), (9, [1e30, -1e30, 0], 2)])
    got, books = vector_codes.vector_codes(mixed.drop("label"), 4, 3, 2)
    rows = got.collect()
    assert len(rows) == 5 and books.shape == (4, 3, 2) and all(r.error >= 0 and len(r.code) == 4 for r in rows)
    same = [r.code for r in rows if r.vec_id == 7]
    assert same[0] == same[1]
    assert vector_codes.digest(books) == hashlib.sha256(",".join(str(int(v)) for b in books for e in b for v in e).encode()).hexdigest()


def test_query_is_sql(spark, tiny):
    duck = duckdb.connect()
    for f in os.listdir(tiny):
        duck.sql(f"create view {f.removesuffix('.parquet')} as from '{tiny}/{f}'")
    df = queries.queries()["op12_vector_codes"](spark, tiny)
    rel = duck.sql(queries.oracle_sql()["op12_vector_codes"])
    assert df.columns == rel.columns
    assert sorted(tuple(r) for r in df.collect()) == sorted(rel.fetchall())
