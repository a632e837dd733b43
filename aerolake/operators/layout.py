"""a map of points in the plane from their fuzzy neighbour graph (uniform manifold approximation).

Each point is tied to its nearest with weights that fall from its closest neighbour on; ties
of both directions are joined by the fuzzy union.  The map starts from principal
components and moves in rounds: ties attract, and every point is repelled by
a sample of points that is drawn anew each round, weighed as if all points repelled.
Coordinates live in the shared folder; a round is two joins of the ties with them and
one aggregate.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolake.operators.neighbours import nearest
from aerolake.runtime import discard, materialize

NEIGHBOURS, ROUNDS, SEED = 15, 30, 42
#: Points that repel in a round, repulsions for each attraction, the longest force, the map's half width at the start.
SAMPLE, NEGATIVE, LONGEST, WIDTH = 64, 5, 4.0, 10.0
#: The curve 1 / (1 + A d^2B) that is flat up to a distance of 0.1 and falls off over 1.
A, B = 1.577, 0.895


def _memberships(far: np.ndarray) -> np.ndarray:
    """Weights of each row's sorted distances (NaN: none): 1 up to the smallest positive one, then falling so that they sum to log2 of their number."""
    near = np.nanmin(np.where(far > 0, far, np.nan), axis=1, initial=np.inf)
    over = np.maximum(far - np.where(np.isinf(near), 0.0, near)[:, None], 0.0)
    goal = np.log2(np.maximum(np.isfinite(far).sum(axis=1), 1))
    low, high = np.zeros(len(far)), np.full(len(far), 2 * np.nanmax(over, initial=1e-9) * far.shape[1] + 1e-9)
    for _ in range(64):
        scale = (low + high) / 2
        small = np.nansum(np.exp(-over / np.maximum(scale, 1e-300)[:, None]), axis=1) < goal
        low, high = np.where(small, scale, low), np.where(small, high, scale)
    return np.exp(-over / np.maximum(high, 1e-12)[:, None])


def fuzzy_graph(points: DataFrame, neighbours: int = NEIGHBOURS, near: DataFrame | None = None) -> DataFrame:
    """(id, other, w) of points (id long, x array of doubles), both ways with one weight.  near: their ``nearest``, where they are known."""
    lists = (nearest(points, neighbours) if near is None else near).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("distance", "other"))).alias("near"))  # at most ``neighbours`` a point

    def weighed(batches):
        for pdf in batches:
            size = pdf["near"].map(len).to_numpy()
            far = np.full((len(pdf), max(1, size.max(initial=1))), np.nan)
            held = np.arange(far.shape[1])[None] < size[:, None]
            far[held] = [e["distance"] for near in pdf["near"] for e in near]
            yield pd.DataFrame({"id": np.repeat(pdf["id"].to_numpy(), size), "other": np.array([e["other"] for near in pdf["near"] for e in near], np.int64), "w": _memberships(far)[held]})

    one = lists.mapInPandas(weighed, "id long, other long, w double").select("id", "other", "w", F.lit(0.0).alias("back"))
    two = materialize(one, "memberships")
    two = two.unionByName(two.select(F.col("other").alias("id"), F.col("id").alias("other"), F.lit(0.0).alias("w"), F.col("w").alias("back")))
    return two.groupBy("id", "other").agg(F.sum("w").alias("w"), F.sum("back").alias("back")).select("id", "other", (F.col("w") + F.col("back") - F.col("w") * F.col("back")).alias("w"))


def principal(points: DataFrame) -> DataFrame:
    """(id, y0, y1): the first two principal components, the farther one scaled to WIDTH; 0 where there are none."""
    some = points.select(F.size("x").alias("n")).limit(2).collect()
    if len(some) < 2:
        return points.select("id", F.lit(0.0).alias("y0"), F.lit(0.0).alias("y1"))
    k = min(2, some[0].n)
    vectors = points.select("id", array_to_vector("x").alias("v"))
    y = PCA(k=k, inputCol="v", outputCol="p").fit(vectors).transform(vectors).select("id", vector_to_array("p").alias("p"))
    y = y.select("id", F.col("p")[0].alias("y0"), F.col("p")[1].alias("y1") if k > 1 else F.lit(0.0).alias("y1"))
    m0, m1 = y.agg(F.avg("y0"), F.avg("y1")).first()
    y = materialize(y.select("id", (F.col("y0") - m0).alias("y0"), (F.col("y1") - m1).alias("y1")), "principal")
    most = y.agg(F.max(F.greatest(F.abs("y0"), F.abs("y1")))).first()[0] or 1.0
    return y.select("id", *[(F.col(c) / most * WIDTH).alias(c) for c in ("y0", "y1")])


def pulled(links: DataFrame, at: DataFrame) -> DataFrame:
    """(id, a0, a1, ties): each point's attraction summed over its ties at the places (id, y0, y1), and their weight."""
    there = at.select(F.col("id").alias("other"), F.col("y0").alias("z0"), F.col("y1").alias("z1"))
    d = [F.col("y0") - F.col("z0"), F.col("y1") - F.col("z1")]
    square = d[0] * d[0] + d[1] * d[1]
    pull = F.when(square > 0, -2 * A * B * F.pow(square, B - 1) / (1 + A * F.pow(square, B))).otherwise(0.0)
    clipped = [F.col("w") * F.least(F.lit(LONGEST), F.greatest(F.lit(-LONGEST), pull * v)) for v in d]
    met = links.join(there, "other").join(at, "id")
    return met.groupBy("id").agg(F.sum(clipped[0]).alias("a0"), F.sum(clipped[1]).alias("a1"), F.sum("w").alias("ties"))


def moved(at: DataFrame, links: DataFrame, sample: np.ndarray, rate: float) -> DataFrame:
    """The places after a round: a step along attraction and NEGATIVE mean repulsions, both a unit of ties."""

    def stepped(batches):
        for pdf in batches:
            y = pdf[["y0", "y1"]].to_numpy(float)
            d = y[:, None] - sample[None]
            square = (d**2).sum(axis=-1)
            push = 2 * B / ((0.001 + square) * (1 + A * square**B))
            force = NEGATIVE * np.clip(push[:, :, None] * d, -LONGEST, LONGEST).mean(axis=1)
            ties = pdf["ties"].to_numpy(float)
            force += pdf[["a0", "a1"]].to_numpy(float) / np.where(ties > 0, ties, 1.0)[:, None]
            y = y + rate * force
            yield pd.DataFrame({"id": pdf["id"], "y0": y[:, 0], "y1": y[:, 1]})

    forces = at.join(pulled(links, at), "id", "left").fillna(0.0, ["a0", "a1", "ties"])
    return forces.mapInPandas(stepped, "id long, y0 double, y1 double")


def umap(points: DataFrame, neighbours: int = NEIGHBOURS, rounds: int = ROUNDS, seed: int = SEED, near: DataFrame | None = None) -> DataFrame:
    """(id, y0, y1) of points (id long, x array of doubles of one length), ids distinct.

    The points that repel in a round follow from a hash of seed, round and id, so a rerun gives the same map.
    Of a point that is near to very many, ties are summed in parts before they meet, but joined by its key
    (adaptive execution splits such a join).  Equal points may part by rounding only; an empty table gives an empty result.
    near: the points' ``nearest``, where they are known.
    """
    points = materialize(points.select(F.col("id").cast("bigint").alias("id"), F.col("x").cast("array<double>").alias("x")), "points")
    links = materialize(fuzzy_graph(points, neighbours, near), "ties")
    at = materialize(principal(points), "places")
    for step in range(rounds):
        drawn = at.orderBy(F.xxhash64(F.lit(seed), F.lit(step), "id"), "id").limit(SAMPLE).collect()
        if not drawn:
            break
        sample = np.array([(r.y0, r.y1) for r in drawn])
        new = materialize(moved(at, links, sample, 1 - step / rounds), "places")
        discard(at)
        at = new
    return at


def preserved(points: DataFrame, places: DataFrame, neighbours: int = NEIGHBOURS, near: DataFrame | None = None) -> float:
    """The share of the points' nearest (id, x) that are among the nearest in the map (id, y0, y1).  near: the points' ``nearest``, where they are known."""
    flat = places.select("id", F.array("y0", "y1").alias("x"))
    one = materialize(nearest(points.select("id", "x"), neighbours).select("id", "other"), "nearest") if near is None else near.select("id", "other")
    n = one.count()
    return one.join(nearest(flat, neighbours).select("id", "other"), ["id", "other"]).count() / n if n else 1.0
