"""Operator 1 on edited copies of drawn pictures."""

import struct
import zlib

import numpy as np

from aerolake.llm import images


def picture(rng, h=96, w=96):
    x = images._smooth(images._smooth(rng.normal(0, 1, (1, h, w)).astype(np.float32)))[0]
    x = (x - x.min()) / (x.max() - x.min()) * 200 + 20
    for _ in range(12):
        y0, x0 = rng.integers(0, h - 12), rng.integers(0, w - 12)
        x[y0 : y0 + rng.integers(5, 20), x0 : x0 + rng.integers(5, 20)] = rng.integers(0, 255)
    return x


def png(x):
    raw = b"".join(b"\0" + row.tobytes() for row in np.clip(x, 0, 255).astype(np.uint8))
    chunk = lambda t, b: struct.pack(">I", len(b)) + t + b + struct.pack(">I", zlib.crc32(t + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", x.shape[1], x.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_edited_copies(spark):
    rng = np.random.default_rng(5)
    rows, origin = [], {}
    for k in range(20):
        p = picture(rng)
        patched = p.copy()
        patched[30:50, 20:60] = 128
        for j, x in enumerate([p, p[10:, 14:], p * 0.7 + 30, np.rot90(p), images._resized(p[None], 1 / 1.4)[0], patched, p]):
            rows.append((k * 10 + j, bytearray(images.encode_pgm(np.clip(x, 0, 255)) if j != 2 else png(x)), "x"))
            origin[k * 10 + j] = k * 10
    rows += [(9001, None, "x"), (9002, bytearray(b"junk"), "x"), (9003, bytearray(b""), "x"), (0, rows[0][1], "x")]
    origin |= {9001: 9001, 9002: 9002, 9003: 9001}
    got = images.copies(spark.createDataFrame(rows, "image_id long, media binary, component_id string")).collect()
    assert len(got) == len(rows)
    assert all(r.component_id in (origin[r.image_id], r.image_id) or origin[r.component_id] == origin[r.image_id] for r in got)  # no false link
    right = [r.component_id == origin[r.image_id] for r in got]
    assert sum(right) / len(right) >= 0.95
    assert images.copies(spark.createDataFrame([], "image_id long, media binary")).count() == 0


def test_decoders():
    x = np.arange(48, dtype=np.uint8).reshape(6, 8)
    assert np.array_equal(images.decode(images.encode_pgm(x)), x) and np.array_equal(images.decode(png(x)), x)
    assert images.decode(None) is None and images.decode(b"P5\n9 9\n255\n123") is None and images.decode(png(x)[:40]) is None


def test_near_vectors_share_a_class(spark, tiny):
    """Classes hold near vectors alone, and nearly all pairs that are very near."""
    rows = spark.read.parquet(f"{tiny}/embeddings.parquet").limit(200).collect()
    rng = np.random.default_rng(11)
    data = [(r.vec_id, list(r.embedding)) for r in rows]
    data += [(10_000 + i, (np.array(v) + rng.normal(0, 0.002, 64)).tolist()) for i, v in data[:60]]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = {r.image_id: r.component_id for r in images.copies(images.rendered(df)).collect()}
    hit = sum(got[10_000 + i] == got[i] for i, _ in data[:60])
    assert hit / 60 >= 0.9


def test_large_buckets_are_compared_in_full(spark, monkeypatch):
    """All pairs of a large group of near descriptors that share a key are matched, in one task or dealt to cells."""
    rng = np.random.default_rng(3)
    bits = rng.random((1200, images.TESTS)) < 0.04
    bits = bits ^ (rng.random(images.TESTS) < 0.5)
    bits[:20] = bits[0]  # equal ones too
    words = np.packbits(bits, axis=1).view(np.dtype(">u8")).astype(np.uint64).view(np.int64)
    keys = np.stack([bits[:, k] @ (1 << np.arange(images.KEY_BITS)) for k in images._KEYS], axis=1)
    assert np.array_equal(images.keys_of(words.view(np.uint64)) & ((1 << 48) - 1), keys)
    i, j = np.triu_indices(len(bits), 1)
    near = ((bits[i] ^ bits[j]).sum(axis=1) <= images.DIFFER) & (keys[i] == keys[j]).any(axis=1)
    want = set(zip(i[near].tolist(), j[near].tolist(), strict=True))
    rows = [(k, 0, 0, *words[k].tolist()) for k in range(len(bits))]
    points = spark.createDataFrame(rows, images._SCHEMA)
    for full in (images.FULL, 150):
        monkeypatch.setattr(images, "FULL", full)
        got = [(r.a, r.b) for r in images.matches(points).select("a", "b").collect()]
        assert set(got) == want
        assert len(got) == len(want)


def test_corners_grow_with_the_area():
    rng = np.random.default_rng(8)
    small, large = (len(images.keypoints(picture(rng, n, n)[None])[0]) for n in (64, 256))
    assert large >= 8 * small
    left = picture(rng, 128, 256)
    left[:, 128:] = 100 + (left[:, 128:] - 100) * 0.1  # the faint half has corners too
    _, _, x, _, _, _ = images.keypoints(left[None])
    assert (x > 140).sum() >= 12


def test_far_corners_meet():
    """Share of pairs of descriptors at a distance that share a key, against that of 28 bits drawn from 256."""
    rng = np.random.default_rng(9)
    for differ, least in ((10, 0.99), (20, 0.95), (30, 0.75), (40, 0.45)):
        flips = np.zeros((4000, images.TESTS), bool)
        for row in flips:
            row[rng.permutation(images.TESTS)[:differ]] = True
        met = np.any([~flips[:, k].any(axis=1) for k in images._KEYS], axis=0)
        assert met.mean() >= least, differ


def test_spots():
    y, x, scale, angle = np.array([0.5, 1000.25]), np.array([8.125, 3.0]), np.array([1.0, 2.25]), np.array([-3.0, 1.0])
    got = images.from_spot(images.spot_of(y, x, scale, angle))
    assert np.abs(got[0] - y).max() <= 0.125 and np.abs(got[1] - x).max() <= 0.125 and got[2].tolist() == scale.tolist()
    assert np.abs(np.exp(1j * got[3]) - np.exp(1j * angle)).max() < 1e-4


def brute_links(points):
    """Links by comparing every corner with every other."""
    rows = points.collect()
    image, spot = np.array([r.image_id for r in rows]), np.array([r.spot for r in rows])
    point, words = np.array([r.point for r in rows]), np.array([[r.d0, r.d1, r.d2, r.d3] for r in rows]).view(np.uint64)
    found = []
    for k in range(len(rows)):
        near = np.flatnonzero((np.bitwise_count(words[k] ^ words[k + 1 :]).sum(axis=1) <= images.DIFFER) & (image[k + 1 :] != image[k])) + k + 1
        found += [(k, j) if image[k] < image[j] else (j, k) for j in near]
    found.sort(key=lambda p: (image[p[0]], image[p[1]]))
    i, j = np.array(found).T
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(v) for v in (image[i], image[j], point[i], point[j], spot[i], spot[j])], list("abcdef"))
    n = {k: int((image == k).sum()) for k in set(image.tolist())}
    out = [v for b in images._voted(images.AGREE)([batch]) for v in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    return {(a, b) for a, b, m in out if m >= images.AGREE + min(n[a], n[b]) // images.RICH}


def test_links_against_brute_force(spark, tiny):
    """At noise of 0.01 the tables find at least 0.9 of the links that comparing all corners finds, and as many among ten times the pictures."""
    rng = np.random.default_rng(12)
    vectors = [list(r.embedding) for r in spark.read.parquet(f"{tiny}/embeddings.parquet").orderBy("vec_id").limit(150).collect()]
    data = [(k, v) for k, v in enumerate(vectors)] + [(1000 + k, (np.array(v) + rng.normal(0, 0.01, 64)).tolist()) for k, v in enumerate(vectors)]
    others = [(10_000 + k, v.tolist()) for k, v in enumerate(rng.normal(0, 0.125, (2700, 64)))]
    links = []
    for rows in (data, data + others):
        points = images.materialize(images.described(images.rendered(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))), "corners")
        links.append({(r.a, r.b) for r in images.agreed(points, images.matches(points)).collect()})
        if len(links) == 1:
            brute = brute_links(points)
    assert len(links[0] & brute) >= 0.9 * len(brute)
    assert all(p[1] == p[0] + 1000 for p in links[0] - brute)  # fewer matches may fit better
    assert {p for p in links[1] if p[1] < 10_000} == links[0]  # more pictures lose none
    assert len({p for p in brute if p[1] == p[0] + 1000}) >= 0.7 * len(vectors)


def test_large_pictures_and_repeated_rows(spark):
    """Pictures of a thousand pixels a side; ties and rows that repeat."""
    rng = np.random.default_rng(13)
    large = picture(rng, 1100, 900)
    rows = [(1, bytearray(images.encode_pgm(large))), (2, bytearray(images.encode_pgm(large[200:900, 100:800]))), (3, bytearray(images.encode_pgm(np.full((64, 64), 7)))), (3, bytearray(images.encode_pgm(np.full((64, 64), 7)))), (1, bytearray(images.encode_pgm(large)))]
    got = sorted((r.image_id, r.component_id) for r in images.copies(spark.createDataFrame(rows, "image_id long, media binary")).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 3), (3, 3)]
