"""Detectors of anomalies: isolation forest, local outlier factor, elliptic envelope, one-class SVM."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolake.operators.ml import exact_quantiles
from aerolake.operators.neighbours import nearest
from aerolake.runtime import materialize

SEED, SHARE = 42, 0.1
#: Trees of a forest and rows of a tree; rows and starts from which the envelope's first fit is chosen; Fourier features.
TREES, ROWS, START_ROWS, STARTS, FEATURES = 100, 256, 1000, 50, 256


def vectors(frame: DataFrame, columns: list[str], key: str = "id", scale: bool = False) -> DataFrame:
    """(key, x) of numbers as an array; gaps, NaN and infinities are 0.  scale: to mean 0 and population deviation 1."""
    number = lambda c: F.coalesce(F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")), F.col(c).cast("double")), F.lit(0.0))
    values = [number(c) for c in columns]
    if scale:
        stats = frame.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(values)], *[F.stddev_pop(v).alias(f"s{i}") for i, v in enumerate(values)]).first()
        values = [(v - F.lit(stats[f"m{i}"] or 0.0)) / F.lit(stats[f"s{i}"] or 1.0) for i, v in enumerate(values)]
    return frame.select(key, F.array(*values).alias("x"))


def flagged(scored: DataFrame, share: float = SHARE) -> DataFrame:
    """Scores (larger: odder) with ``anomaly`` for those above the (1 - share) quantile."""
    scored = materialize(scored, "anomaly-scores")
    cut = exact_quantiles(scored, "score", [1 - share])[0]
    return scored.withColumn("anomaly", F.col("score") > F.lit(cut) if cut is not None else F.lit(False))


def _with_scores(rows: DataFrame, of) -> DataFrame:
    """(all columns but x, score) by a function of the matrix of x, an Arrow batch at a time."""
    at = rows.columns.index("x")

    def of_batches(batches):
        for batch in batches:
            x = np.array(batch.column(at).to_pylist(), float)
            yield batch.drop_columns(["x"]).append_column("score", pa.array(of(x) if len(x) else np.zeros(0), pa.float64()))

    return rows.mapInArrow(of_batches, T.StructType([*[f for f in rows.schema.fields if f.name != "x"], T.StructField("score", T.DoubleType())]))


# --- isolation forest -----------------------------------------------------


def average_path(n: np.ndarray | float) -> np.ndarray:
    """The mean depth of an unsuccessful search in a random search tree of n rows."""
    n = np.asarray(n, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        long = 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def isolation_tree(x: np.ndarray, seed: int, tree: int, deepest: int) -> dict[str, np.ndarray]:
    """A random partition tree of rows, depth first: column (-1: a leaf), cut (below: left), left, right, and a leaf's path length."""
    rng = np.random.default_rng([seed, tree])
    nodes: list[list] = []

    def grow(rows: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, 0, 0, depth + float(average_path(len(rows)))])
        low, high = (x[rows].min(axis=0), x[rows].max(axis=0)) if len(rows) else (np.zeros(0), np.zeros(0))
        varied = np.flatnonzero(high > low)
        if depth < deepest and len(varied):
            column = int(varied[rng.integers(len(varied))])
            cut = float(rng.uniform(low[column], high[column]))
            cut = cut if cut > low[column] else float(high[column])  # neither side is empty
            left = x[rows, column] < cut
            nodes[me][:2] = column, cut
            nodes[me][2] = grow(rows[left], depth + 1)
            nodes[me][3] = grow(rows[~left], depth + 1)
        return me

    grow(np.arange(len(x)), 0)
    return {name: np.array([n[i] for n in nodes], float if name in ("cut", "path") else int) for i, name in enumerate(("column", "cut", "left", "right", "path"))}


def path_lengths(x: np.ndarray, tree: dict[str, np.ndarray]) -> np.ndarray:
    """Each row's path length, all rows a level at a time."""
    at, rows = np.zeros(len(x), int), np.arange(len(x))
    while len(rows := rows[tree["column"][at[rows]] >= 0]):
        here = at[rows]
        at[rows] = np.where(x[rows, tree["column"][here]] < tree["cut"][here], tree["left"][here], tree["right"][here])
    return tree["path"][at]


def tree_samples(rows: DataFrame, n: int, trees: int, size: int, seed: int, key: str) -> DataFrame:
    """(tree, rank, x): for each tree the ``size`` rows of least hash, found among those under a threshold."""
    size, slack = min(size, n), 1.5
    while True:
        share = min(1.0, slack * size / max(1, n))
        below = int((share * 2 - 1) * (1 << 63)) if share < 1 else (1 << 63) - 1
        dealt = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("h", F.xxhash64(F.lit(seed), "tree", key)).where(F.col("h") <= F.lit(below))
        ranked = materialize(dealt.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy("h", "x"))).where(F.col("rank") <= size).select("tree", "rank", "x"), "tree-rows")  # slack * size rows a tree, about
        if share >= 1 or ranked.count() == trees * size:
            return ranked
        slack *= 2


def isolation_forest(rows: DataFrame, key: str = "id", trees: int = TREES, size: int = ROWS, seed: int = SEED, share: float = SHARE) -> DataFrame:
    """(key, score, anomaly): 2 to the minus mean path length over its expectation, by trees of ``size`` hash-drawn rows each.

    rows: (key, x).  Trees grow in parallel; the forest (a bounded number of nodes) is sent to all tasks.
    """
    rows = materialize(rows.select(key, "x"), "to-isolate")
    n = rows.count()
    if not n:
        return rows.sparkSession.createDataFrame([], T.StructType([rows.schema[key], T.StructField("score", T.DoubleType()), T.StructField("anomaly", T.BooleanType())]))
    size = min(size, n)
    deepest = max(1, math.ceil(math.log2(max(2, size))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        tree = isolation_tree(np.array(pdf["x"].tolist(), float), seed, int(pdf["tree"].iloc[0]), deepest)
        return pd.DataFrame({"tree": [int(pdf["tree"].iloc[0])], **{k: [v.tolist()] for k, v in tree.items()}})

    schema = "tree int, column array<int>, cut array<double>, left array<int>, right array<int>, path array<double>"
    grown = tree_samples(rows, n, trees, size, seed, key).groupBy("tree").applyInPandas(grow, schema).orderBy("tree").collect()  # 2 * size nodes a tree at most
    forest = [{k: np.array(r[k]) for k in ("column", "cut", "left", "right", "path")} for r in grown]
    usual = float(average_path(size)) or 1.0
    return flagged(_with_scores(rows, lambda x: 2 ** (-np.mean([path_lengths(x, t) for t in forest], axis=0) / usual)), share)


# --- local outlier factor -------------------------------------------------


def local_outlier_factor(rows: DataFrame, key: str = "id", k: int = 20, share: float = SHARE, block: int | None = None) -> DataFrame:
    """(key, score, anomaly): how much less dense a row lies than its k nearest others, from exact neighbours.

    rows: (key a long, x).  Reach to a neighbour is at least the neighbour's own k-th distance.
    """
    near = materialize(nearest(rows.select(F.col(key).alias("id"), "x"), k, block), "nearest")
    last = near.groupBy("id").agg(F.max("distance").alias("k_distance"))
    reach = near.join(last.withColumnRenamed("id", "other"), "other").select("id", "other", F.greatest("distance", "k_distance").alias("reach"))
    density = materialize(reach.groupBy("id").agg((1 / (F.avg("reach") + 1e-10)).alias("density")), "densities")
    around = near.join(density.select(F.col("id").alias("other"), F.col("density").alias("theirs")), "other").groupBy("id").agg(F.avg("theirs").alias("theirs"))
    factor = rows.select(F.col(key).alias("id")).join(density, "id", "left").join(around, "id", "left").select(F.col("id").alias(key), F.coalesce(F.col("theirs") / F.col("density"), F.lit(1.0)).alias("score"))
    return flagged(factor, share)


# --- elliptic envelope ----------------------------------------------------


def chi_square_quantile(p: float, d: int) -> float:
    """By bisection on the series of the regularised incomplete gamma function."""

    def below(v: float) -> float:
        a, x = d / 2, v / 2
        term = total = 1 / a
        k = a
        while term > total * 1e-15:
            k += 1
            term *= x / k
            total += term
        return total * math.exp(a * math.log(x) - x - math.lgamma(a))

    low, high = 1e-12, d + 20 * math.sqrt(2 * d) + 100
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return (low + high) / 2


def _moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    m = x.mean(axis=0)
    return m, (x - m).T @ (x - m) / len(x)


def _squared(x: np.ndarray, m: np.ndarray, cov: np.ndarray) -> np.ndarray:
    d = x - m
    return np.einsum("ij,jk,ik->i", d, np.linalg.pinv(cov, hermitian=True), d)


def first_fit(x: np.ndarray, seed: int = SEED, starts: int = STARTS) -> tuple[np.ndarray, np.ndarray]:
    """The best of some concentrated fits of a bounded sample, each begun from a few random rows."""
    n, d = x.shape
    h, rng, best = min(n, (n + d + 1) // 2), np.random.default_rng(seed), None
    for _ in range(starts):
        m, cov = _moments(x[rng.permutation(n)[: min(n, d + 1)]])
        last = np.inf
        for _ in range(50):
            m, cov = _moments(x[np.argsort(_squared(x, m, cov), kind="stable")[:h]])
            size = np.linalg.slogdet(cov + 1e-12 * np.eye(d))[1]
            if size >= last - 1e-12:
                break
            last = size
        if best is None or last < best[0]:
            best = (last, m, cov)
    return best[1], best[2]


def moments(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and population covariance of (x), by sums that tasks make."""

    def of_batches(batches):
        n, s, q = 0, 0.0, 0.0
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float)
            if len(x):
                n, s, q = n + len(x), s + x.sum(axis=0), q + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([s.tolist()]), pa.array([q.ravel().tolist()])], ["n", "s", "q"])

    parts = rows.select("x").mapInArrow(of_batches, "n long, s array<double>, q array<double>")
    long = parts.select("n", F.posexplode(F.concat("s", "q")).alias("i", "v")).groupBy("i").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).orderBy("i").collect()  # width + width squared numbers
    if not long:
        return 0, np.zeros(0), np.zeros((0, 0))
    n, v = long[0]["n"], np.array([r["v"] for r in long])
    d = int((math.sqrt(1 + 4 * len(v)) - 1) / 2)
    m = v[:d] / n
    return n, m, v[d:].reshape(d, d) / n - np.outer(m, m)


def elliptic_envelope(rows: DataFrame, key: str = "id", share: float = SHARE, seed: int = SEED, rounds: int = 30, start_rows: int = START_ROWS) -> DataFrame:
    """(key, score, anomaly): squared distances under a minimum covariance determinant fit, which outliers do not mask.

    rows: (key, x).  The fit starts from the best of a bounded hash sample and is concentrated
    over all rows: the half of least distance (cut found by counting) gives the next mean and
    covariance, until these stay.  Then it is made consistent and reweighted: rows within the
    0.975 quantile give the final fit.
    """
    rows = materialize(rows.select(key, "x"), "to-envelop")
    some = rows.orderBy(F.xxhash64(F.lit(seed), key), "x").limit(start_rows).select("x").collect()  # at most start_rows
    if not some:
        return rows.sparkSession.createDataFrame([], T.StructType([rows.schema[key], T.StructField("score", T.DoubleType()), T.StructField("anomaly", T.BooleanType())]))
    n, whole, _ = moments(rows)
    x = np.array([r["x"] for r in some], float)
    d = len(whole)
    m, cov = first_fit(x - whole, seed)  # about the mean of all, so that large offsets do not cost digits
    half = (min(n, (n + d + 1) // 2) - 1) / max(1, n - 1)
    distance = lambda m, cov: _with_scores(rows.select(key, "x", F.col("x").alias("v")), lambda x: _squared(x - whole, m, cov))

    def inner(scored: DataFrame, cut: float) -> tuple[np.ndarray, np.ndarray]:
        _, m, cov = moments(scored.where(F.col("score") <= F.lit(cut)).select(F.zip_with("v", F.array(*[F.lit(float(v)) for v in whole]), lambda a, b: a - b).alias("x")))
        return m, cov

    last = np.inf
    for _ in range(rounds):
        scored = distance(m, cov)
        m, cov = inner(scored, exact_quantiles(scored, "score", [half])[0] * (1 + 1e-12))
        size = np.linalg.slogdet(cov + 1e-12 * np.eye(d))[1]
        if size >= last - 1e-9:
            break
        last = size
    scored = distance(m, cov)
    cov = cov * ((exact_quantiles(scored, "score", [0.5])[0] / chi_square_quantile(0.5, d)) or 1.0)
    m, cov = inner(distance(m, cov), chi_square_quantile(0.975, d))
    return flagged(distance(m, cov).select(key, "score"), share)


# --- one-class SVM --------------------------------------------------------


def fourier(width: int, gamma: float, features: int = FEATURES, seed: int = SEED):
    """A map to random cosines whose products near the Gaussian kernel exp(-gamma d^2)."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, math.sqrt(2 * gamma), (width, features)), rng.uniform(0, 2 * math.pi, features)
    return lambda x: math.sqrt(2 / features) * np.cos(x @ w + b)


def hinge(margin: np.ndarray, soft: float) -> tuple[np.ndarray, np.ndarray]:
    """max(0, margin), rounded off within ``soft`` of 0, and its slope."""
    slope = np.clip(margin / (2 * soft) + 0.5, 0, 1)
    return np.where(margin >= soft, margin, np.where(margin <= -soft, 0.0, (margin + soft) ** 2 / (4 * soft))), slope


def minimised(value, start: np.ndarray, rounds: int = 100, held: int = 10, within: float = 1e-6) -> np.ndarray:
    """Limited-memory quasi-Newton descent; value(v) gives (value, gradient), each a pass over the data."""
    v, (f, g) = start, value(start)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, back = g.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (y @ s)
            q -= a * y
            back.append(a)
        q *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1.0, np.linalg.norm(g))
        for (s, y), a in zip(pairs, reversed(back), strict=True):
            q += (a - (y @ q) / (y @ s)) * s
        step = 1.0
        while True:
            new = v - step * q
            f_new, g_new = value(new)
            if f_new <= f - 1e-4 * step * (g @ q) or step < 1e-6:
                break
            step /= 2
        if (y := g_new - g) @ (new - v) > 1e-14:
            pairs = [*pairs, (new - v, y)][-held:]
        done = abs(f - f_new) <= within * max(abs(f_new), 1e-6)
        v, f, g = new, f_new, g_new
        if done:
            break
    return v


def one_class_svm(rows: DataFrame, key: str = "id", nu: float = SHARE, features: int = FEATURES, seed: int = SEED, rounds: int = 100, soft: float = 1e-4, model: dict | None = None) -> DataFrame:
    """(key, score, anomaly): how far a row lies outside the smallest region that holds about 1 - nu of the rows.

    rows: (key, x).  A linear one-class machine over random Fourier features of the Gaussian
    kernel (gamma: one over width times variance): every round sums the gradient, as many
    numbers as features, over all rows.  model: takes the fitted weights, offset and map.
    """
    rows = materialize(rows.select(key, "x"), "to-support")
    n, m, cov = moments(rows)
    if not n:
        return rows.sparkSession.createDataFrame([], T.StructType([rows.schema[key], T.StructField("score", T.DoubleType()), T.StructField("anomaly", T.BooleanType())]))
    variance = float(np.trace(cov) / len(m) + (m**2).mean() - m.mean() ** 2)  # of all numbers, as if one column
    to = fourier(len(m), 1 / (len(m) * variance) if variance > 0 else 1.0, features, seed)

    def value(v: np.ndarray) -> tuple[float, np.ndarray]:
        w, rho = v[:-1], v[-1]

        def of_batches(batches):
            total = np.zeros(features + 2)
            for batch in batches:
                x = np.array(batch.column(0).to_pylist(), float)
                if len(x):
                    z = to(x)
                    loss, slope = hinge(rho - z @ w, soft)
                    total += np.concatenate((-(slope @ z), [slope.sum(), loss.sum()]))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(features + 2, dtype=np.int32)), pa.array(total)], ["i", "v"])

        out = rows.select("x").mapInArrow(of_batches, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        total = np.zeros(features + 2)
        total[[r["i"] for r in out]] = [r["v"] for r in out]
        total /= nu * n
        return w @ w / 2 - rho + total[-1], np.concatenate((w + total[:-2], [total[-2] - 1]))

    v = minimised(value, np.zeros(features + 1), rounds)
    if model is not None:
        model |= {"weights": v[:-1], "offset": v[-1], "map": to, "objective": value(v)[0]}
    scored = materialize(_with_scores(rows, lambda x: v[-1] - to(x) @ v[:-1]), "support-scores")
    return scored.withColumn("anomaly", F.col("score") > 0)


DETECTORS = {"isolation_forest": isolation_forest, "one_class_svm": one_class_svm, "local_outlier_factor": local_outlier_factor, "elliptic_envelope": elliptic_envelope}


def compared(rows: DataFrame, key: str = "id", share: float = SHARE, names: list[str] | None = None) -> DataFrame:
    """A row a detector: anomalies, their rate, mean and deviation of the scores; the one whose rate is nearest ``share`` is best."""
    rows = materialize(rows, "to-compare")
    found = []
    for name in names or DETECTORS:
        out = DETECTORS[name](rows, key)
        n, odd, mean, std = out.agg(F.count(F.lit(1)), F.count_if("anomaly"), F.avg("score"), F.stddev_pop("score")).first()
        found.append((name, int(odd), odd / n if n else 0.0, mean or 0.0, std or 0.0))
    best = min(found, key=lambda r: abs(r[2] - share))[0]
    return rows.sparkSession.createDataFrame([(*r, r[0] == best) for r in found], "detector string, anomaly_count long, anomaly_rate double, mean_score double, std_score double, best boolean")
