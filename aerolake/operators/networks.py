"""Feed-forward networks learned by data-parallel gradients: a regressor and an autoencoder.

Every round sends the parameters (a number fixed by the layers) to all tasks and sums
the tasks' gradients; the descent itself is a quasi-Newton one over these sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolake.operators.anomaly import minimised
from aerolake.runtime import materialize

SEED, ALPHA = 42, 1e-4


def shapes(layers: list[int]) -> list[tuple[int, int]]:
    """A weight matrix's rows (a bias among them) and columns, layer by layer."""
    return [(a + 1, b) for a, b in zip(layers[:-1], layers[1:], strict=True)]


def unpacked(v: np.ndarray, layers: list[int]) -> list[np.ndarray]:
    """The weight matrices of a parameter vector."""
    out, at = [], 0
    for a, b in shapes(layers):
        out.append(v[at : at + a * b].reshape(a, b))
        at += a * b
    return out


def first_weights(layers: list[int], seed: int = SEED) -> np.ndarray:
    """Uniform within the root of 6 over a layer's inputs and outputs; biases 0."""
    rng, out = np.random.default_rng(seed), []
    for a, b in shapes(layers):
        w = rng.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a - 1 + b))
        w[-1] = 0
        out.append(w.ravel())
    return np.concatenate(out)


def activations(x: np.ndarray, weights: list[np.ndarray]) -> list[np.ndarray]:
    """Every layer's values: tanh within, linear at the end."""
    out = [x]
    for k, w in enumerate(weights):
        z = out[-1] @ w[:-1] + w[-1]
        out.append(z if k == len(weights) - 1 else np.tanh(z))
    return out


def summed(x: np.ndarray, y: np.ndarray, v: np.ndarray, layers: list[int]) -> np.ndarray:
    """Gradient of half the squared errors' sum, with that sum behind it."""
    weights = unpacked(v, layers)
    held = activations(x, weights)
    error = held[-1] - y
    loss, parts = (error**2).sum() / 2, []
    for k in range(len(weights) - 1, -1, -1):
        parts.append(np.concatenate((held[k].T @ error, error.sum(axis=0)[None])).ravel())
        if k:
            error = error @ weights[k][:-1].T * (1 - held[k] ** 2)
    return np.concatenate([*reversed(parts), [loss]])


def objective(rows: DataFrame, layers: list[int], alpha: float = ALPHA):
    """A function of the parameters: (mean loss with weight decay, gradient), each call a pass over rows (x, y arrays)."""
    n = rows.count()
    size = sum(a * b for a, b in shapes(layers))
    decayed = np.concatenate([np.r_[np.ones((a - 1) * b), np.zeros(b)] for a, b in shapes(layers)])

    def value(v: np.ndarray) -> tuple[float, np.ndarray]:
        def of_batches(batches):
            total = np.zeros(size + 1)
            for batch in batches:
                x, y = (np.array(batch.column(k).to_pylist(), float) for k in (0, 1))
                if len(x):
                    total += summed(x, y, v, layers)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1, dtype=np.int32)), pa.array(total)], ["i", "v"])

        total = np.zeros(size + 1)
        for r in rows.select("x", "y").mapInArrow(of_batches, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():  # as many numbers as parameters
            total[r["i"]] = r["v"]
        total /= max(1, n)
        return total[-1] + alpha / 2 * (decayed * v**2).sum(), total[:-1] + alpha * decayed * v

    return value


def learned(rows: DataFrame, hidden: list[int], rounds: int = 60, seed: int = SEED, alpha: float = ALPHA) -> tuple[list[int], np.ndarray]:
    """Layers and parameters of a network from x to y (rows of arrays); without rows, and with constant ones, as started."""
    rows = materialize(rows.select("x", "y"), "to-learn")
    first = rows.first()
    if first is None:
        return [], np.zeros(0)
    layers = [len(first["x"]), *hidden, len(first["y"])]
    return layers, minimised(objective(rows, layers, alpha), first_weights(layers, seed), rounds, within=1e-7)


def applied(rows: DataFrame, layers: list[int], v: np.ndarray, out: str, layer: int = -1) -> DataFrame:
    """rows (x, any others) with a layer's values as an array column."""
    at = rows.columns.index("x")

    def of_batches(batches):
        weights = unpacked(v, layers)
        for batch in batches:
            x = np.array(batch.column(at).to_pylist(), float)
            y = activations(x, weights)[layer] if len(x) else np.zeros((0, 1))
            yield batch.append_column(out, pa.array(y.tolist(), pa.list_(pa.float64())))

    return rows.mapInArrow(of_batches, T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))]))


def _scales(rows: DataFrame, column: str) -> tuple[list[float], list[float]]:
    """Means and population deviations (1 where 0) of an array column's positions."""
    found = rows.select(F.posexplode(column).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("i").collect()
    return [r["m"] for r in found], [r["s"] or 1.0 for r in found]


def _scaled(column: str, m: list[float], s: list[float]):
    lits = lambda v: F.array(*[F.lit(float(x)) for x in v])
    return F.zip_with(F.zip_with(column, lits(m), lambda a, b: a - b), lits(s), lambda a, b: a / b)


class Regressor(Transformer):
    """A fitted network that adds ``prediction`` to rows with a vector of features."""

    def __init__(self, layers, v, x_scale, y_scale, features: str):
        super().__init__()
        self.layers, self.v, self.x_scale, self.y_scale, self.features = layers, v, x_scale, y_scale, features

    def _transform(self, frame: DataFrame) -> DataFrame:
        rows = frame.withColumn("x", _scaled("_x", *self.x_scale)) if "_x" in frame.columns else frame.withColumn("_x", vector_to_array(self.features)).withColumn("x", _scaled("_x", *self.x_scale))
        kept = [c for c in rows.columns if c not in ("_x", self.features)]
        out = applied(rows.select(*kept), self.layers, self.v, "_y")
        (m,), (s,) = self.y_scale
        return out.withColumn("prediction", F.element_at("_y", 1) * s + m).drop("_y", "x")


def fit_regressor(train: DataFrame, hidden: list[int] = (100, 50), features: str = "features", label: str = "label", rounds: int = 60, seed: int = SEED) -> Regressor:
    """A multi-layer regressor of ``label`` on a vector column; both are scaled first."""
    rows = materialize(train.select(vector_to_array(features).alias("x"), F.array(F.col(label).cast("double")).alias("y")).where("y[0] is not null"), "to-regress")
    x_scale, y_scale = _scales(rows, "x"), _scales(rows, "y")
    layers, v = learned(rows.select(_scaled("x", *x_scale).alias("x"), _scaled("y", *y_scale).alias("y")), list(hidden), rounds, seed)
    return Regressor(layers, v, x_scale, y_scale, features)


def autoencoded(rows: DataFrame, code: int = 2, hidden: int = 16, rounds: int = 60, seed: int = SEED) -> DataFrame:
    """rows (x array, any others) with ``code``, the narrow middle of a network learned to return its input, and ``loss``, the squared error of what it returns.

    Inputs are scaled first.  An empty table gives an empty result.
    """
    rows = materialize(rows, "to-encode")
    if rows.isEmpty():
        return rows.withColumn("code", F.array().cast("array<double>")).withColumn("loss", F.lit(0.0))
    scale = _scales(rows, "x")
    inputs = rows.withColumn("_x", F.col("x")).withColumn("x", _scaled("x", *scale))
    layers, v = learned(inputs.select("x", F.col("x").alias("y")), [hidden, code, hidden], rounds, seed)
    out = applied(applied(inputs, layers, v, "code", 2), layers, v, "_back")
    loss = F.aggregate(F.zip_with("x", "_back", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
    return out.withColumn("loss", loss).withColumn("x", F.col("_x")).drop("_x", "_back")
