"""Every registered query against its DuckDB twin."""

import math
import os

import duckdb
import pytest

from aerolake import registry

SLOW = {"F1_best_k", "J1_pair_classifier", "J4_J11_device_classifiers", "F10_algorithms", "J12_ensemble", "F13_best_algorithm"}
#: Tested on small tables against plain versions: test_affinity, test_anomaly, test_density, test_agglomerate, test_layout, test_networks.
APART = {"J5_isolation_forest", "J5_elliptic_envelope", "J5_one_class_svm", "J5_detectors", "J6_regressors", "F3_autoencoder", "F10_hdbscan", "F10_ward", "F10_mean_shift", "F10_affinity_propagation", "F14_umap", "F14_layout_quality"}


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(round(float(v), 4) + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def duck(tiny):
    c = duckdb.connect()
    for f in os.listdir(tiny):
        c.sql(f"create view {f.removesuffix('.parquet')} as from '{tiny}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, tiny, duck, name):
    df = registry.queries()[name](spark, tiny)
    columns = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())
    rel = duck.sql(registry.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted(tuple(cell(r[k]) for k in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql()) - SLOW - APART))
def test_rows(spark, tiny, name):
    df = registry.queries()[name](spark, tiny)
    rows = df.collect()
    assert df.columns and rows
    assert not any(isinstance(v, float) and math.isnan(v) for r in rows for v in r)
