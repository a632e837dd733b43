"""Networks, boosting and bagging against plain versions."""

import math

import numpy as np
from pyspark.ml.linalg import Vectors

from aerolake.operators import ml, networks
from pyspark.sql import functions as F


def test_gradients(spark):
    """Sums over partitions are a single process's, and its slopes are those of the loss."""
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(50, 3)), rng.normal(size=(50, 2))
    rows = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x array<double>, y array<double>").repartition(5)
    layers = [3, 4, 5, 2]
    v = networks.first_weights(layers) + rng.normal(0, 0.1, sum(a * b for a, b in networks.shapes(layers)))

    def plain(v):
        h = x
        for k, w in enumerate(networks.unpacked(v, layers)):
            h = h @ w[:-1] + w[-1]
            h = np.tanh(h) if k < 2 else h
        decay = sum((w[:-1] ** 2).sum() for w in networks.unpacked(v, layers))
        return ((h - y) ** 2).sum() / 2 / 50 + 1e-4 / 2 * decay

    loss, slope = networks.objective(rows, layers)(v)
    assert abs(loss - plain(v)) < 1e-12
    for i in range(0, len(v), 7):
        step = np.zeros(len(v))
        step[i] = 1e-6
        assert abs((plain(v + step) - plain(v - step)) / 2e-6 - slope[i]) < 1e-6


def test_regressor(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(-2, 2, (240, 2))
    y = np.sin(2 * x[:, 0]) * x[:, 1]
    df = spark.createDataFrame([(i, Vectors.dense(v), float(t)) for i, (v, t) in enumerate(zip(x.tolist(), y, strict=True))], ["id", "features", "label"])
    model = networks.fit_regressor(df.where("id < 200"), [12], rounds=40)
    out = model.transform(df.where("id >= 200")).select("label", "prediction").toPandas()
    assert 1 - ((out.label - out.prediction) ** 2).sum() / ((out.label - out.label.mean()) ** 2).sum() > 0.8


def test_autoencoder(spark):
    """A bent curve in three dimensions: one number tells more than the first principal component."""
    t = np.linspace(-1.5, 1.5, 120)
    x = np.stack((t, t**2, np.sin(2 * t)), axis=1)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, x array<double>")
    out = networks.autoencoded(rows, 1, 8, 60).orderBy("id").collect()
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    s = np.linalg.svd(z, compute_uv=False)
    assert len(out) == 120 and all(len(r.code) == 1 for r in out)
    assert sum(r.loss for r in out) < 0.5 * (s[1:] ** 2).sum()
    assert networks.autoencoded(rows.limit(0)).count() == 0


def stump(x, y, w, classes):
    """The cut of least weighted Gini impurity; class of each side."""
    best = None
    for c in range(x.shape[1]):
        values = np.unique(x[:, c])
        for cut in (values[1:] + values[:-1]) / 2:
            left, gini = x[:, c] <= cut, 0.0
            for side in (left, ~left):
                p = np.array([w[side & (y == k)].sum() for k in range(classes)])
                gini += p.sum() - (p**2).sum() / p.sum()
            if best is None or gini < best[0] - 1e-12:
                best = (gini, c, cut)
    _, c, cut = best
    left = x[:, c] <= cut
    said = [int(np.argmax([w[side & (y == k)].sum() for k in range(classes)])) for side in (left, ~left)]
    return np.where(left, *said)


def test_boosting(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, (150, 3)).astype(float)
    y = ((x[:, 0] > 6).astype(int) + ((x[:, 1] + rng.normal(0, 2, 150)) > 7)).astype(int)
    df = spark.createDataFrame([(i, float(k), Vectors.dense(v)) for i, (v, k) in enumerate(zip(x.tolist(), y.tolist(), strict=True))], ["id", "label", "features"])
    seen: list = []
    model = ml.boosted(df, 3, 4, weights=seen)
    w, said_all = np.full(150, 1 / 150), []
    for k in range(len(seen)):
        said = stump(x, y, w, 3)
        error = w[said != y].sum() / w.sum()
        alpha = math.log((1 - error) / error) + math.log(2)
        assert abs(alpha - model.alphas[k]) < 1e-6
        w = w * np.exp(alpha * (said != y))
        w /= w.sum()
        said_all.append((alpha, said))
        assert np.allclose([seen[k][i] for i in range(150)], w)
    assert len(seen) == 4
    votes = sum(a * np.eye(3)[s] for a, s in said_all)
    got = [r.prediction for r in model.transform(df).orderBy("id").collect()]
    assert got == votes.argmax(axis=1).tolist()


def test_bagging(spark):
    df = spark.range(4000).withColumn("w", ml.poisson_weight("id", 3))
    n = {r.w: r["count"] for r in df.groupBy("w").count().collect()}
    for k in range(4):
        assert abs(n[float(k)] / 4000 - math.exp(-1) / math.factorial(k)) < 0.03
    rows = spark.range(200).select("id", (F.col("id") % 2).cast("double").alias("label"))
    rows = spark.createDataFrame([(r.id, r.label, Vectors.dense([r.label * 6 + r.id % 5, r.id % 7])) for r in rows.collect()], ["id", "label", "features"])
    models = ml.bagged(rows, 3, 4)
    from pyspark.ml.functions import vector_to_array

    said = ml.soft_vote([m.transform(rows).select("id", vector_to_array("probability").alias("probability")) for m in models])
    assert said.join(rows, "id").where("prediction = label").count() > 180
