"""Section E: which network name belongs to which access point."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolake.functions import scalars as S
from aerolake.operators import features, fold
from aerolake.operators.components import connected_components
from aerolake.runtime import discard, materialize
from aerolake.sources.events import HIDDEN

#: Weights of the score's parts, and other fixed values of the scoring.
WEIGHTS = {"beacon_count": 0.30, "probe_resp_count": 0.20, "supporting_clients": 0.25, "seq_support": 0.05}
RSSI_WEIGHT, CHANNEL_WEIGHT, RSSI_STD_MAX, EPS = 0.10, 0.10, 20.0, 1e-6
HIGH, MEDIUM, ML_WEIGHT, MULTI_SSID = 0.75, 0.40, 0.6, 2
#: Nodes of the larger side up to which a component is matched exactly.
EXACT_NODES = 2000


def normalisers(pairs: DataFrame) -> DataFrame:
    """One row with the 0.9 quantiles (linear interpolation), at least 1."""
    return pairs.agg(*[F.greatest(F.lit(1.0), F.coalesce(F.percentile(c, 0.9), F.lit(1.0))).alias(f"norm_{c}") for c in WEIGHTS])


def scored(pairs: DataFrame) -> DataFrame:
    """Pairs with their heuristic score."""
    out = pairs.join(F.broadcast(normalisers(pairs)))  # one row
    score = sum((F.lit(w) * F.least(F.lit(1.0), F.col(c) / (F.col(f"norm_{c}") + EPS)) for c, w in WEIGHTS.items()), F.lit(CHANNEL_WEIGHT) + F.lit(RSSI_WEIGHT) * F.greatest(F.lit(0.0), 1 - F.col("rssi_std") / (RSSI_STD_MAX + EPS)))
    return out.withColumn("score", score).drop(*[f"norm_{c}" for c in WEIGHTS])


def blended(pairs: DataFrame, model) -> DataFrame:
    """Scores mixed with a fitted model's probability of class 1 (vector column ``features`` made here)."""
    from pyspark.ml.functions import vector_to_array

    from aerolake.operators.ml import assembled

    numbers = [c for c, t in pairs.dtypes if t in ("int", "bigint", "double") and c not in ("score", "label")]
    out = model.transform(assembled(pairs, numbers))
    return out.withColumn("score", ML_WEIGHT * vector_to_array("probability")[1] + (1 - ML_WEIGHT) * F.col("score")).select(*pairs.columns)


def multi_name(events: DataFrame) -> DataFrame:
    """Access points of one element fingerprint that carry at least two names between them."""
    prints = fold.element_sets(events).select("bssid", S.ie_fingerprint(F.col("ies")).alias("fp")).where("fp is not null")
    named = prints.join(fold.name_map(events), "bssid", "left")
    return named.groupBy("fp").agg(F.count_distinct("ssid").alias("names"), F.collect_set("bssid").alias("bssids")).where(F.col("names") >= MULTI_SSID).select("fp", "names", F.explode("bssids").alias("bssid"))


def assignment(weights: np.ndarray) -> list[tuple[int, int]]:
    """Rows and columns of a matching of largest total weight; weight 0 means no edge.

    Shortest augmenting paths with potentials; rows may stay unmatched, as the
    matrix is padded with zeros.
    """
    rows, columns = weights.shape
    cost = np.zeros((rows, columns + rows))
    cost[:, :columns] = -np.maximum(weights, 0)
    n, m = cost.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], at = i, 0
        least, back, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while owner[at]:
            used[at] = True
            row = owner[at]
            slack = cost[row - 1] - u[row] - v[1:]
            better = ~used[1:] & (slack < least[1:])
            least[1:][better], back[1:][better] = slack[better], at
            after = 1 + int(np.argmin(np.where(used[1:], np.inf, least[1:])))
            step = least[after]
            u[owner[used]] += step
            v[used] -= step
            least[~used] -= step
            at = after
        while at:
            owner[at], at = owner[back[at]], back[at]
    return [(owner[j] - 1, j - 1) for j in range(1, columns + 1) if owner[j] and weights[owner[j] - 1, j - 1] > 0]


_KINDS = "ssid string, bssid string, score double"


def _exactly(pdf: pd.DataFrame) -> pd.DataFrame:
    """The best matching of a gathered graph."""
    pdf = pdf[["ssid", "bssid", "score"]].sort_values(["ssid", "bssid"]).reset_index(drop=True)
    i, names = pd.factorize(pdf["ssid"], sort=True)
    j, points = pd.factorize(pdf["bssid"], sort=True)
    w = np.zeros((len(names), len(points)))
    w[i, j] = pdf["score"]
    found = assignment(w) if len(names) <= len(points) else [(a, b) for b, a in assignment(w.T)]
    return pdf.loc[pd.MultiIndex.from_arrays([i, j]).isin(found) if found else np.zeros(len(pdf), bool)]


def dominant(edges: DataFrame) -> DataFrame:
    """A greedy matching, at least half the best weight: again and again the edges that are the best at both ends.

    Rounds of two aggregates and joins, until no edge is left; no node's edges are gathered.
    Each round takes the best edge at least, so the rounds end.
    """
    order = F.struct("score", F.xxhash64("ssid", "bssid").alias("h"), "ssid", "bssid")
    left, found = materialize(edges.where("ssid is not null and bssid is not null and score is not null").select("ssid", "bssid", "score"), "greedy"), None
    while not left.isEmpty():
        by_name = left.groupBy("ssid").agg(F.max(order).alias("best"))
        by_point = left.groupBy("bssid").agg(F.max(order).alias("best"))
        taken = materialize(by_name.select("best").join(by_point.select("best"), "best").select("best.ssid", "best.bssid", "best.score"), "greedy-taken")
        found = taken if found is None else found.unionByName(taken)
        after = materialize(left.join(taken.select("ssid"), "ssid", "left_anti").join(taken.select("bssid"), "bssid", "left_anti").select("ssid", "bssid", "score"), "greedy")
        discard(left)
        left = after
    return left.limit(0) if found is None else found


def matched(edges: DataFrame, exact_nodes: int = EXACT_NODES) -> DataFrame:
    """E5: edges (ssid, bssid, score) of a maximum-weight matching, by connected component.

    Only a component of at most ``exact_nodes`` names or points, and 50 edges for each or
    a full table of ``exact_nodes`` names and points, is gathered and matched exactly;
    larger ones are matched by ``dominant`` and marked exact = False.  A whole graph of that size needs no parting.
    """
    edges = materialize(edges.select("ssid", "bssid", "score"), "match-input")
    names_, points_, edges_ = edges.agg(F.count_distinct("ssid"), F.count_distinct("bssid"), F.count(F.lit(1))).first()
    if min(names_, points_) <= exact_nodes and (edges_ <= 50 * exact_nodes or names_ * points_ <= exact_nodes**2):
        return edges.groupBy(F.lit(0).alias("component")).applyInPandas(_exactly, _KINDS).withColumn("exact", F.lit(True))
    nodes = edges.select(F.xxhash64(F.lit(0), "ssid").alias("a"), F.xxhash64(F.lit(1), "bssid").alias("b"), "ssid", "bssid", "score")
    nodes = materialize(nodes, "match-edges")
    comp = connected_components(nodes)
    tagged = materialize(nodes.join(comp, nodes["a"] == comp["node"]).select("component", "ssid", "bssid", "score"), "match-components")
    shape = tagged.groupBy("component").agg(F.count_distinct("ssid").alias("names"), F.count_distinct("bssid").alias("points"), F.count(F.lit(1)).alias("edges"))
    large = materialize(shape.where((F.least("names", "points") > exact_nodes) | ((F.col("edges") > 50 * exact_nodes) & (F.col("names") * F.col("points") > exact_nodes**2))).select("component"), "large-components")

    if large.isEmpty():
        return tagged.groupBy("component").applyInPandas(_exactly, _KINDS).withColumn("exact", F.lit(True))
    exact = tagged.join(large, "component", "left_anti").groupBy("component").applyInPandas(_exactly, _KINDS).withColumn("exact", F.lit(True))
    return exact.unionByName(dominant(tagged.join(large, "component", "left_semi")).withColumn("exact", F.lit(False)))


def inferred(events: DataFrame, model=None) -> DataFrame:
    """The matching with labels, evidence and features, best first."""
    pairs = materialize(scored(features.pairs(events)), "scored-pairs")
    if model is not None:
        pairs = materialize(blended(pairs, model), "blended-pairs")
    best = matched(pairs.where(F.col("score") > MEDIUM / 2).select("ssid", "bssid", "score"))
    several = multi_name(events).select("bssid").distinct().withColumn("multi", F.lit(True))
    out = best.join(pairs.drop("score"), ["ssid", "bssid"]).join(several, "bssid", "left")
    return out.select("ssid", "bssid", F.round("score", 3).alias("score"), S.score_label(F.col("score")).alias("label"), "supporting_clients", F.coalesce("multi", F.lit(False)).alias("multi_ssid_allowed"), "beacon_count", "probe_resp_count", "seq_support", "channel", "exact").orderBy(F.col("score").desc(), "ssid")


def label_candidates(pairs: DataFrame, low: float = 0.4, high: float = 0.75, most: int = 200) -> DataFrame:
    """Pairs whose score leaves doubt, for labelling by hand."""
    return pairs.where(F.col("score").between(low, high)).orderBy(F.col("score").desc(), "ssid", "bssid").limit(most)


def top_pairs(pairs: DataFrame, most: int = 20) -> DataFrame:
    """The best pairs."""
    return pairs.where(F.col("ssid") != HIDDEN).orderBy(F.col("score").desc(), "ssid", "bssid").limit(most)
