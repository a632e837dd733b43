"""The map in the plane: weights and rounds against plain versions, neighbours kept against principal components."""

import numpy as np

from aerolake.operators import layout


def frame(spark, x):
    return spark.createDataFrame([(i, v) for i, v in enumerate(np.asarray(x, float).tolist())], "id long, x array<double>")


def plain_weights(x, k):
    n = len(x)
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(far, np.inf)
    w = np.zeros((n, n))
    for i in range(n):
        near = sorted(range(n), key=lambda j: (far[i, j], j))[:k]
        rho = min(far[i, j] for j in near)
        low, high = 0.0, 1e4
        for _ in range(200):
            m = (low + high) / 2
            total = sum(np.exp(-(far[i, j] - rho) / m) for j in near)
            low, high = (m, high) if total < np.log2(k) else (low, m)
        for j in near:
            w[i, j] = np.exp(-(far[i, j] - rho) / high)
    return w + w.T - w * w.T


def test_fuzzy_graph_and_a_round(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (40, 5))
    want = plain_weights(x, 6)
    links = layout.fuzzy_graph(frame(spark, x), 6)
    got = np.zeros((40, 40))
    for r in links.collect():
        got[r.id, r.other] = r.w
    assert np.allclose(got, want, atol=1e-6)
    y, sample = rng.normal(0, 3, (40, 2)), rng.normal(0, 3, (8, 2))
    places = spark.createDataFrame([(i, *v) for i, v in enumerate(y.tolist())], "id long, y0 double, y1 double")
    moved = np.array([(r.y0, r.y1) for r in layout.moved(places, links, sample, 0.5).orderBy("id").collect()])
    for i in range(40):
        a, b, force = layout.A, layout.B, np.zeros(2)
        for j in range(40):
            d, q = y[i] - y[j], ((y[i] - y[j]) ** 2).sum()
            if q > 0:
                force += want[i, j] * np.clip(-2 * a * b * q ** (b - 1) / (1 + a * q**b) * d, -4, 4) / want[i].sum()
        for z in sample:
            d, q = y[i] - z, ((y[i] - z) ** 2).sum()
            force += 5 * np.clip(2 * b / ((0.001 + q) * (1 + a * q**b)) * d, -4, 4) / len(sample)
        assert np.allclose(moved[i], y[i] + 0.5 * force, atol=1e-4)


def test_more_neighbours_kept_than_by_principal_components(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(m, 1, (30, 20)) for m in rng.normal(0, 3, (8, 20))])
    points = frame(spark, x)
    kept = [layout.preserved(points, p) for p in (layout.umap(points, rounds=12), layout.principal(points))]
    assert kept[0] > kept[1] + 0.05


def test_few_and_equal_points(spark):
    assert layout.umap(frame(spark, np.zeros((0, 2))), rounds=2).count() == 0
    for x in ([[1.0, 2.0]], np.ones((5, 3)), [[0.0], [1.0], [3.0]]):
        out = layout.umap(frame(spark, x), rounds=2).collect()
        assert len(out) == len(x) and all(np.isfinite((r.y0, r.y1)).all() for r in out)


def test_neighbours_of_the_points_are_searched_once(spark, tiny, monkeypatch):
    from aerolake.operators import layout, neighbours
    from aerolake.plans import models

    widths = []

    class Counted(neighbours.Cells):
        def __init__(self, *args, **kinds):
            super().__init__(*args, **kinds)
            widths.append(self.width)

    monkeypatch.setattr(neighbours, "Cells", Counted)
    monkeypatch.setattr(layout, "ROUNDS", 1)
    found = {r.layout: r.preserved for r in models.f14_quality(spark, tiny).collect()}
    assert widths.count(64) == 1 and widths.count(2) == 2
    assert 0 < found["principal"] < 1
