"""Operator 1: copies of images by local descriptors.

Corners at several scales get binary tests turned to the patch's own direction.
Descriptors meet in Hamming tables (keys of sampled bits); pairs of images are
linked only where several matches agree on one similarity transform, so cropped,
scaled, turned and edited copies are found and look-alikes are not.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.llm.common import table
from aerolake.operators.components import connected_components
from aerolake.runtime import broadcastable, materialize

#: Scales, corners of a grid cell of a scale at most, radius of a patch, binary tests of a descriptor.
SCALES, CORNERS, RADIUS, TESTS = (1.0, 1.5, 2.25), 12, 7, 256
#: How much wider than the patch every other test spreads.
WIDE = 2
#: Pixels of a scale that a side of a grid cell has at most, so that corners grow with the picture's area.
CELL = 64
#: Hamming tables and the bits of their keys; differing bits of a match at most.
TABLES, KEY_BITS, DIFFER = 16, 18, 40
#: Matches that must agree on a transform, and one more for each so many corners of the poorer picture.
AGREE, RICH = 3, 16
#: Pixels that shifts of a bin of votes differ by; pixels that a match may be off its fitted place.
SHIFT, NEAR = 16, 2.5
_RNG = np.random.default_rng(1)
_PAIRS = np.clip(np.round(_RNG.normal(0, RADIUS / 2.2, (TESTS, 2, 2))), -RADIUS + 2, RADIUS - 2)
_PAIRS[::2] *= WIDE  # every other test looks beyond the patch, where look-alikes differ
_REACH = int(np.ceil(np.abs(_PAIRS).max() * 2**0.5))
_KEYS = [np.sort(_RNG.permutation(TESTS)[:KEY_BITS]) for _ in range(TABLES)]
_TURNS = 32


def encode_pgm(pixels: np.ndarray) -> bytes:
    """A grey picture as binary PGM."""
    return b"P5\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.astype(np.uint8).tobytes()


def decode(media: bytes | None) -> np.ndarray | None:
    """Grey pixels of a PGM, PPM or 8-bit PNG (not interlaced); None for anything else, empty or broken."""
    try:
        if media and media[:2] in (b"P5", b"P6"):
            head = re.match(rb"P([56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", media)
            w, h, depth = int(head[2]), int(head[3]), 3 if head[1] == b"6" else 1
            raw = np.frombuffer(media, np.uint8, w * h * depth, head.end())
            return raw.reshape(h, w, depth).mean(axis=2).astype(np.float32)
        if media and media[:8] == b"\x89PNG\r\n\x1a\n":
            at, data, w, h, kind, colours = 8, [], 0, 0, 0, None
            while at < len(media):
                n, tag = struct.unpack(">I4s", media[at : at + 8])
                body, at = media[at + 8 : at + 8 + n], at + 12 + n
                if tag == b"IHDR":
                    w, h, bits, kind, _, _, laced = struct.unpack(">IIBBBBB", body)
                    if bits != 8 or laced:
                        return None
                elif tag == b"PLTE":
                    colours = np.frombuffer(body, np.uint8).reshape(-1, 3)
                elif tag == b"IDAT":
                    data.append(body)
            depth = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
            lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(h, 1 + w * depth)
            out = np.zeros((h + 1, (w + 1) * depth), np.int32)
            for y in range(h):
                line, above, here = lines[y, 1:].astype(np.int32), out[y], out[y + 1]
                if lines[y, 0] == 0:
                    here[depth:] = line
                elif lines[y, 0] == 2:
                    here[depth:] = (line + above[depth:]) & 255
                else:
                    for x in range(w * depth):
                        a, b, c = int(here[x]), int(above[x + depth]), int(above[x])
                        guess = a if lines[y, 0] == 1 else (a + b) // 2 if lines[y, 0] == 3 else min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                        here[x + depth] = (line[x] + guess) & 255
            pixels = out[1:, depth:].reshape(h, w, depth)
            if kind == 3:
                return colours[pixels[..., 0]].mean(axis=2).astype(np.float32)
            return pixels[..., : max(1, depth - (kind in (4, 6)))].mean(axis=2).astype(np.float32)
    except (ValueError, KeyError, TypeError, IndexError, struct.error, zlib.error):
        pass
    return None


def _resized(x: np.ndarray, by: float) -> np.ndarray:
    """Bilinear, for a stack of pictures."""
    h, w = int(x.shape[1] / by), int(x.shape[2] / by)
    ys, xs = (np.arange(h) + 0.5) * by - 0.5, (np.arange(w) + 0.5) * by - 0.5
    y0, x0 = np.clip(ys.astype(int), 0, x.shape[1] - 2), np.clip(xs.astype(int), 0, x.shape[2] - 2)
    fy, fx = (ys - y0)[None, :, None], (xs - x0)[None, None, :]
    top = x[:, y0][:, :, x0] * (1 - fx) + x[:, y0][:, :, x0 + 1] * fx
    return top * (1 - fy) + (x[:, y0 + 1][:, :, x0] * (1 - fx) + x[:, y0 + 1][:, :, x0 + 1] * fx) * fy


def _smooth(x: np.ndarray, taps=(1, 4, 6, 4, 1)) -> np.ndarray:
    t = np.array(taps, np.float32) / sum(taps)
    r = len(t) // 2
    p = np.pad(x, ((0, 0), (r, r), (0, 0)), mode="edge")
    x = sum(t[k] * p[:, k : k + x.shape[1]] for k in range(len(t)))
    p = np.pad(x, ((0, 0), (0, 0), (r, r)), mode="edge")
    return sum(t[k] * p[:, :, k : k + x.shape[2]] for k in range(len(t)))


def keypoints(stack: np.ndarray):
    """Of a stack of pictures of one size: (picture, y, x, scale, angle, descriptor bits) of every corner kept."""
    found = []
    disc = np.array([(dy, dx) for dy in range(-RADIUS, RADIUS + 1) for dx in range(-RADIUS, RADIUS + 1) if dy * dy + dx * dx <= RADIUS * RADIUS])
    turned = []
    for k in range(_TURNS):
        c, s = np.cos(2 * np.pi * k / _TURNS), np.sin(2 * np.pi * k / _TURNS)
        turned.append(np.round(_PAIRS @ np.array([[c, -s], [s, c]])).astype(int))  # rows (y, x), turned by the angle
    turned = np.array(turned)
    for scale in SCALES:
        x = _resized(stack, scale) if scale != 1 else stack
        n, h, w = x.shape
        edge = RADIUS + 1
        if min(h, w) < 2 * edge + 3:
            continue
        x = _smooth(x)
        gy, gx = np.gradient(x, axis=1), np.gradient(x, axis=2)
        a, b, c = _smooth(gx * gx), _smooth(gx * gy), _smooth(gy * gy)
        strength = (a + c) / 2 - np.sqrt(((a - c) / 2) ** 2 + b * b)  # the smaller eigenvalue
        peak = strength.copy()
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                peak = np.maximum(peak, np.roll(strength, (dy, dx), (1, 2)))
        strength = np.where((strength >= peak) & (strength > 1.0), strength, 0)
        strength[:, :edge], strength[:, -edge:], strength[:, :, :edge], strength[:, :, -edge:] = 0, 0, 0, 0
        which, y, xx = [], [], []
        for rows in np.array_split(np.arange(h), -(-h // CELL)):
            for columns in np.array_split(np.arange(w), -(-w // CELL)):
                flat = strength[:, rows[0] : rows[-1] + 1, columns[0] : columns[-1] + 1].reshape(n, -1)
                top = np.argsort(-flat, axis=1, kind="stable")[:, :CORNERS]
                good = np.take_along_axis(flat, top, axis=1) > 0
                which.append(np.repeat(np.arange(n), good.sum(axis=1)))
                y.append(rows[0] + top[good] // len(columns))
                xx.append(columns[0] + top[good] % len(columns))
        which, y, xx = np.concatenate(which), np.concatenate(y), np.concatenate(xx)
        if not len(which):
            continue
        patch = x[which[:, None], y[:, None] + disc[:, 0], xx[:, None] + disc[:, 1]]
        angle = np.arctan2(patch @ disc[:, 0], patch @ disc[:, 1])
        turn = np.round(angle / (2 * np.pi) * _TURNS).astype(int) % _TURNS
        at = turned[turn]  # corner, test, point, (y, x)
        wide = np.pad(x, ((0, 0), (_REACH, _REACH), (_REACH, _REACH)), mode="edge")
        value = wide[which[:, None, None], y[:, None, None] + at[..., 0] + _REACH, xx[:, None, None] + at[..., 1] + _REACH]
        found.append((which, (y + 0.5) * scale, (xx + 0.5) * scale, np.full(len(which), scale), angle, value[..., 0] < value[..., 1]))
    if not found:
        return [np.zeros(0, int)] * 5 + [np.zeros((0, TESTS), bool)]
    return [np.concatenate(c) for c in zip(*found, strict=True)]


_SCHEMA = "image_id long, point int, spot long, d0 long, d1 long, d2 long, d3 long"


def spot_of(y, x, scale, angle) -> np.ndarray:
    """Place, scale and angle in one long: quarter pixels, the scale's rank, a 2^20th of a turn."""
    part = lambda v, bits: np.clip(np.round(v), 0, (1 << bits) - 1).astype(np.int64)
    rank = np.searchsorted(SCALES, np.asarray(scale) - 1e-6)
    return part(np.asarray(y) * 4, 20) << 43 | part(np.asarray(x) * 4, 20) << 23 | rank.astype(np.int64) << 20 | part(np.mod(angle, 2 * np.pi) / (2 * np.pi) * ((1 << 20) - 1), 20)


def from_spot(spot: np.ndarray):
    """(y, x, scale, angle) of spots."""
    return (spot >> 43) / 4, (spot >> 23 & 0xFFFFF) / 4, np.array(SCALES)[np.minimum(spot >> 20 & 7, len(SCALES) - 1)], (spot & 0xFFFFF) / ((1 << 20) - 1) * 2 * np.pi


def described(images: DataFrame) -> DataFrame:
    """Corners of images (image_id, media), with the descriptor's 256 bits in four longs."""

    def of_batches(batches):
        names = [f.split()[0] for f in _SCHEMA.split(", ")]
        for batch in batches:
            by_size: dict = {}
            for k, media in enumerate(batch.column(1).to_pylist()):
                pixels = decode(media)
                if pixels is not None and min(pixels.shape) >= 2 * RADIUS + 5:
                    by_size.setdefault(pixels.shape, []).append((k, pixels))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for some in by_size.values():
                at_once = max(1, min(64, (1 << 22) // some[0][1].size))  # large pictures go one by one
                for first in range(0, len(some), at_once):
                    part = some[first : first + at_once]
                    which, y, x, scale, angle, bits = keypoints(np.stack([p for _, p in part]))
                    if not len(which):
                        continue
                    order = np.argsort(which, kind="stable")
                    which = which[order]
                    point = np.arange(len(which)) - np.searchsorted(which, which)
                    words = np.ascontiguousarray(np.packbits(bits[order], axis=1)).view(np.dtype(">u8")).astype(np.uint64).view(np.int64)
                    image = np.array([ids[k] for k, _ in part], np.int64)[which]
                    yield pa.RecordBatch.from_arrays([pa.array(image), pa.array(point.astype(np.int32)), pa.array(spot_of(y[order], x[order], scale[order], angle[order])), *(pa.array(words[:, k]) for k in range(4))], names)

    images.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    return images.select("image_id", "media").mapInArrow(of_batches, _SCHEMA)


def keys_of(words: np.ndarray) -> np.ndarray:
    """By descriptor (rows of four uint64) its key in every table, the table in the bits above."""
    bits = np.unpackbits(np.ascontiguousarray(words.astype(np.dtype(">u8"))).view(np.uint8).reshape(len(words), -1), axis=1)
    return np.stack([(t << 48) + bits[:, k] @ (1 << np.arange(KEY_BITS)) for t, k in enumerate(_KEYS)], axis=1) if len(words) else np.zeros((0, TABLES), np.int64)


def in_tables(points: DataFrame) -> DataFrame:
    """Every corner in every Hamming table: its columns and ``key``, which names table and bucket."""

    def of_batches(batches):
        for batch in batches:
            words = np.stack([batch.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in range(3, 7)], axis=1)
            keys, n = keys_of(words), batch.num_rows
            for t in range(TABLES):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys[:, t], pa.int64())], [*batch.schema.names, "key"]) if n else batch.append_column("key", pa.array([], pa.int64()))

    points.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    return points.select("image_id", "point", "spot", "d0", "d1", "d2", "d3").mapInArrow(of_batches, f"{_SCHEMA}, key long")


_MATCH = "a long, b long, pa int, pb int, sa long, sb long"


def _mask(key: np.ndarray) -> np.ndarray:
    """The bits of a key within the four words of a descriptor."""
    bits = np.zeros(TESTS, bool)
    bits[key] = True
    return np.packbits(bits).view(np.dtype(">u8")).astype(np.uint64)


_MASKS = [_mask(k) for k in _KEYS]


def _met(batches):
    """Matches within the buckets of rows sorted by key and cell; buckets may run over batches.

    All pairs of a bucket are compared, each pair of corners in the first table whose key
    it shares.  Of a cell of two groups (own is the group, -1 where all meet) the pairs
    across the groups are compared.
    """
    names = [f.split()[0] for f in _MATCH.split(", ")]
    held: list[np.ndarray] = []

    def compared(columns):
        key, cell, own, image, point, spot, *d = columns
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])))
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(key)))
        later = np.repeat(start + size, size) - np.arange(len(key)) - 1  # members of the bucket after this one
        ends = np.cumsum(later)
        at = 0
        while at < len(key):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + PAIRS_AT_ONCE)))
            n = later[at:to]
            i = np.repeat(np.arange(at, to), n)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            at = to
            differ = np.zeros(len(i), np.uint16)
            for w in d:
                differ += np.bitwise_count(w[i] ^ w[j])
            near = np.flatnonzero(differ <= DIFFER)
            i, j = i[near], j[near]
            near = (image[i] != image[j]) & ((own[i] < 0) | (own[i] != own[j]))
            i, j = i[near], j[near]
            first, apart = np.ones(len(i), bool), [w[i] ^ w[j] for w in d]
            for t, mask in enumerate(_MASKS[:-1]):
                first &= (key[i] >> 48 <= t) | (sum((w & m != 0).astype(np.uint8) for w, m in zip(apart, mask, strict=True)) > 0)
            i, j = i[first], j[first]
            i, j = np.where(image[i] < image[j], i, j), np.where(image[i] < image[j], j, i)
            for k in range(0, len(i), 50_000):
                c = slice(k, k + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(v[c]) for v in (image[i], image[j], point[i], point[j], spot[i], spot[j])], names)

    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        now[6:] = [c.view(np.uint64) for c in now[6:]]
        if held:
            now = [np.concatenate((h, n)) for h, n in zip(held, now, strict=True)]
        if not len(now[0]):
            continue
        last = np.flatnonzero((now[1] != now[1][-1]) | (now[0] != now[0][-1]))
        whole = int(last[-1]) + 1 if len(last) else 0
        if whole:
            yield from compared([n[:whole] for n in now])
        held = [n[whole:] for n in now]
    if held and len(held[0]):
        yield from compared(held)


#: Rows of a bucket that one task compares alone; fuller ones are dealt to cells. Pairs held at once.
FULL, PAIRS_AT_ONCE = 10_000, 500_000


def matches(points: DataFrame) -> DataFrame:
    """Corners of two images (a < b) whose descriptors differ in at most DIFFER bits, and the similarity transform that each match implies.

    Every two corners that share a key of a table are compared, whatever the size of
    their bucket, and matched once.  A bucket of more than FULL rows is dealt, by a hash, to
    groups of about FULL / 2, and every two groups meet in a cell of their own.
    """
    rows = in_tables(points)
    full = materialize(rows.groupBy("key").count().where(F.col("count") > FULL).select("key", F.ceil(F.col("count") * 2 / FULL).alias("groups")), "full-buckets")
    order = ["key", "cell", "own", "image_id", "point", "spot", "d0", "d1", "d2", "d3"]
    alone = rows.withColumn("cell", F.lit(0).cast("bigint")).withColumn("own", F.lit(-1)).select(*order)
    if not full.isEmpty():
        few = F.broadcast(full) if broadcastable(full, 24) else full
        dealt = rows.join(few, "key").withColumn("own", F.pmod(F.xxhash64("image_id", "point"), "groups").cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("groups") - 1)))
        dealt = dealt.withColumn("cell", F.least("own", "with") * F.col("groups") + F.greatest("own", "with") + 1)
        dealt = dealt.withColumn("own", F.when(F.col("own") == F.col("with"), F.lit(-1)).otherwise(F.col("own")))
        # In the cell of a group and another one, members keep their group; in a group's own cell all meet.
        alone = alone.join(few, "key", "left_anti").select(*order).unionByName(dealt.select(*order))
    points.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    return alone.repartition("key", "cell").sortWithinPartitions("key", "cell", "image_id", "point").mapInArrow(_met, _MATCH)


def _voted(agree: int):
    """Image pairs with enough agreeing matches, from matches sorted by pair."""

    def of_batches(batches):
        held = None
        for batch in batches:
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
            if held is not None:
                now = [np.concatenate((h, n)) for h, n in zip(held, now, strict=True)]
            if not len(now[0]):
                continue
            last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
            whole = int(last[-1]) + 1 if len(last) else 0
            if whole:
                yield counted([n[:whole] for n in now])
            held = [n[whole:] for n in now]
        if held is not None and len(held[0]):
            yield counted(held)

    def counted(columns):
        a, b = columns[:2]
        pair = np.cumsum(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) - 1
        enough = np.bincount(pair)[pair] >= agree
        a, b, pa_, pb, sa, sb = (c[enough] for c in columns)
        (ya, xa, grown_a, angle_a), (yb, xb, grown_b, angle_b) = from_spot(sa), from_spot(sb)
        turn, grow = angle_b - angle_a, grown_b / grown_a
        pair, za, zb = pair[enough], xa + 1j * ya, xb + 1j * yb
        shift = zb - grow * np.exp(1j * turn) * za
        best: dict = {}
        for o in (0.0, 0.5):
            bins = np.stack([pair, np.floor(np.mod(turn, 2 * np.pi) / (np.pi / 6) + o) % 12, np.floor(np.log2(grow) / 0.6 + 0.25 + o), np.floor(shift.real / SHIFT + o), np.floor(shift.imag / SHIFT + o)], axis=1)
            order = np.lexsort(bins.T[::-1])
            cut = np.flatnonzero((np.diff(bins[order], axis=0) != 0).any(axis=1)) + 1 if len(order) else np.zeros(0, int)
            first, end = np.append(0, cut), np.append(cut, len(order))
            for k in np.flatnonzero(end - first >= agree):
                group = order[first[k] : end[k]]
                for _ in range(3):  # fit, keep what fits, fit again
                    if len(group) < agree or (spread := np.abs(za[group] - za[group].mean()).max()) < RADIUS:
                        group = group[:0]
                        break
                    p, q = za[group] - za[group].mean(), zb[group] - zb[group].mean()
                    by = (p.conj() @ q) / (p.conj() @ p).real
                    group = group[np.abs(q - by * p) <= NEAR * max(1.0, spread / 32)]
                if (n := min(len(set(pa_[group])), len(set(pb[group])))) >= agree:
                    key = (int(a[group[0]]), int(b[group[0]]))
                    best[key] = max(n, best.get(key, 0))
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in best], pa.int64()), pa.array([k[1] for k in best], pa.int64()), pa.array(list(best.values()), pa.int64())], ["a", "b", "matches"])

    return of_batches


def agreed(points: DataFrame, pairs: DataFrame, agree: int = AGREE) -> DataFrame:
    """(a, b, matches): image pairs of which enough corner matches share one similarity transform.

    Each match votes for a turn, a scale and a shift, in two grids half a bin apart; a
    transform is fitted to the matches of a bin, and those within about NEAR pixels of it
    count, by distinct corners on both sides.  Enough is ``agree``, and one more for each
    RICH corners of the picture with fewer.
    """
    best = pairs.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(_voted(agree), "a long, b long, matches long")
    size = points.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
    best = best.join(size.select(F.col("image_id").alias("a"), F.col("n").alias("n_a")), "a").join(size.select(F.col("image_id").alias("b"), F.col("n").alias("n_b")), "b")
    return best.where(F.col("matches") >= agree + F.floor(F.least("n_a", "n_b") / RICH)).select("a", "b", "matches")


def copies(images: DataFrame) -> DataFrame:
    """One row per row of images (image_id, media, any others): image_id, n_points, component_id, n_links.

    component_id is the smallest image_id reachable over links; n_links counts the links of the
    image's bytes to others' (equal bytes are one).  Null, empty, unreadable or tiny
    media have no corners and are alone unless their bytes are equal; null and
    empty count as equal.  Repeated rows give repeated rows; a null image_id never names a
    component unless alone.  Extra columns are ignored; an empty table gives an empty result.
    """
    digest = F.sha2(F.coalesce("media", F.lit(b"")), 256)
    rows = images.select("image_id", digest.alias("digest"))
    by_bytes = materialize(rows.groupBy("digest").agg(F.min("image_id").alias("rep")), "by-bytes")
    distinct = images.select("image_id", "media").join(by_bytes.where("rep is not null").select(F.col("rep").alias("image_id")), "image_id", "left_semi").dropDuplicates(["image_id"])
    points = materialize(described(distinct), "corners")
    links = materialize(agreed(points, matches(points)), "image-links")
    found = connected_components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    number = points.groupBy(F.col("image_id").alias("rep")).agg(F.count(F.lit(1)).alias("n_points"))
    each = by_bytes.join(found.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left").join(number, "rep", "left")
    each = materialize(each.select("digest", F.coalesce("n_points", F.lit(0)).alias("n_points"), F.coalesce("component", "rep").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "image-classes")
    return rows.join(each, "digest").select("image_id", "n_points", "component_id", "n_links")


def rendered(vectors: DataFrame) -> DataFrame:
    """Pictures (image_id, media) of embeddings (vec_id, embedding): the 8 x 8 values as a smooth 32 x 32 PGM.

    The tables hold no media; this gives the operator one picture per row.  Values are
    spread over grey levels by their own range; null or short vectors give null media.
    """

    def of_batches(batches):
        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                if not v or len(v) < 64 or any(x is None for x in v[:64]):
                    out.append(None)
                    continue
                grid = np.array(v[:64], np.float32).reshape(1, 8, 8)
                low, high = float(grid.min()), float(grid.max())
                big = _resized((grid - low) / ((high - low) or 1) * 255, 1 / 4)[0]
                out.append(encode_pgm(np.clip(np.round(big), 0, 255)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out, pa.binary())], ["image_id", "media"])

    return vectors.select(F.col("vec_id").alias("image_id"), "embedding").mapInArrow(of_batches, "image_id long, media binary")


def op1_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies among the pictures of all embeddings."""
    return copies(materialize(rendered(table(spark, sf_dir, "embeddings")), "pictures"))
