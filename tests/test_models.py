"""Model queries run on all rows, coordinates and labels."""

import numpy as np
import pytest

from aerolake import registry
from aerolake.operators import cluster, ml


class _Seen(Exception):
    pass


@pytest.mark.parametrize(
    ("name", "module", "function", "width"),
    [("F10_algorithms", cluster, "clustered", 64), ("F14_projection", cluster, "projected", 64), ("J4_J11_device_classifiers", ml, "train_device", 64), ("J5_anomalies", ml, "anomaly_scores", 8), ("F1_best_k", cluster, "best_k", 8)],
)
def test_whole_input(spark, tiny, monkeypatch, name, module, function, width):
    def seen(frame, columns, *more, **named):
        raise _Seen(frame, columns, more, named)

    monkeypatch.setattr(module, function, seen)
    with pytest.raises(_Seen) as found:
        registry.queries()[name](spark, tiny)
    frame, columns, _, named = found.value.args
    assert len(columns) == width and "most" not in named
    if width == 64:
        assert frame.count() == spark.read.parquet(f"{tiny}/embeddings.parquet").count()


def test_gate_sees_all_pairs(spark, tiny, monkeypatch):
    seen = []
    monkeypatch.setattr(ml, "retrain", lambda frame, columns: seen.append(frame.count()))
    registry.queries()["J2_retrain_gate"](spark, tiny)
    assert seen[0] > 10


def test_dbscan_of_all_coordinates(spark, tiny):
    rows = spark.read.parquet(f"{tiny}/embeddings.parquet").collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= 0.05
    core = near.sum(axis=1) >= 5
    label = np.where(core, ids, -1)
    for _ in ids:
        label = np.where(core, [min(label[n & core], default=-1) for n in near], -1)
    label = [int(c) if k else int(min(label[n & core], default=-1)) for c, k, n in zip(label, core, near, strict=True)]
    got = {r.id: r.cluster for r in registry.queries()["F11_dbscan"](spark, tiny).collect()}
    assert got == dict(zip(ids.tolist(), label, strict=True))


@pytest.mark.parametrize(("name", "module", "function"), [("J1_pair_classifier", ml, "train_pairs"), ("J2_retrain_gate", ml, "retrain"), ("J3_behaviour_classifier", ml, "train_behaviour"), ("J9_inference", ml, "train_behaviour"), ("J6_regressors", ml, "train_regressor")])
def test_features_are_worked_out_once(spark, tiny, monkeypatch, name, module, function):
    """Models that read their rows many times read a written table, not the events again."""

    def seen(frame, *more, **named):
        raise _Seen(frame)

    monkeypatch.setattr(module, function, seen)
    with pytest.raises(_Seen) as found:
        registry.queries()[name](spark, tiny)
    assert not any(f.endswith("events.parquet") for f in found.value.args[0].inputFiles())


def test_device_fits_read_dealt_tables(spark, monkeypatch):
    """The split is written once a side, and one input partition does not stay one task in every pass of a fit."""
    written, plain = [], ml.materialize

    def kept(df, name):
        out = plain(df, name)
        written.append((name, len(out.inputFiles()), out.columns))
        return out

    monkeypatch.setattr(ml, "materialize", kept)
    monkeypatch.setattr(ml, "EACH", 200)
    rows = spark.range(0, 900, 1, 1).selectExpr("id", "cast(id % 3 as double) as label", "cast(id % 3 as double) + cast(id % 5 as double) / 100 as a")
    name, _, scores = ml.train_device(rows, ["a"], ["random_forest"])
    assert name == "random_forest" and scores[name] == 1.0
    assert [(n, c) for n, _, c in written] == [("devices", ["id", "label", "features"])] * 2 and all(files > 1 for _, files, _ in written)
