"""Forms that spread a key or a table over tasks, against plain computations."""

import numpy as np
import pytest

from aerolake import registry, runtime
from aerolake.operators import cluster, fold, ml
from pyspark.sql import functions as F


def test_silhouette_in_blocks(spark):
    rng = np.random.default_rng(1)
    x, c = rng.normal(0, 1, (60, 3)), rng.integers(0, 4, 60)
    c[0] = 9  # a cluster of one row
    x[1] = x[2]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = []
    for i in range(60):
        if (c == c[i]).sum() == 1:
            want.append(0.0)
            continue
        own = d[i][c == c[i]].sum() / ((c == c[i]).sum() - 1)
        other = min(d[i][c == k].mean() for k in set(c.tolist()) - {c[i]})
        want.append((other - own) / max(own, other))
    df = spark.createDataFrame([(v.tolist(), int(k)) for v, k in zip(x, c, strict=True)], "x array<double>, c int")
    for block in (7, 25, 2000):
        assert abs(cluster.silhouette(df, "x", "c", block) - np.mean(want)) < 1e-9
    assert cluster.silhouette(df.withColumn("c", F.lit(1)), "x", "c") == 0
    assert abs(cluster.centroid_silhouette(df, "x", "c")) <= 1


def test_elbow():
    assert cluster.elbow({2: 100.0, 3: 20.0, 4: 18.0, 5: 16.0, 6: 15.0}) == 3


def test_running_over_stretches(spark):
    rng = np.random.default_rng(2)
    rows = [(k, float(t), i, int(v)) for i, (k, t, v) in enumerate(zip(rng.choice(["a", "b"], 80), rng.integers(0, 50, 80), rng.integers(0, 3, 80), strict=True))]
    rows = [(str(k), t, i, v) for k, t, i, v in rows]
    want, total = {}, {}
    for k, _, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        total[k] = total.get(k, 0) + v
        want[i] = total[k]
    df = spark.createDataFrame(rows, "k string, ts double, event_id long, v int")
    for stretch in (3.0, 1000.0):
        assert {r.event_id: r.sum for r in fold.running(df, ["k"], "v", "sum", stretch).collect()} == want


def test_exact_quantiles(spark):
    rng = np.random.default_rng(3)
    values = np.round(rng.normal(0, 10, 301), 1).tolist() + [1e9, -1e9, 5.0, 5.0, 5.0]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    assert np.allclose(ml.exact_quantiles(df, "v", [0, 0.1, 0.5, 0.9, 1]), np.quantile(values, [0, 0.1, 0.5, 0.9, 1]))
    assert ml.exact_quantiles(df.where("v is null"), "v", [0.5]) == [None]
    assert ml.exact_quantiles(df.where("v = 5"), "v", [0.25]) == [5.0]


def test_exact_quantiles_of_odd_values(spark):
    inf, nan = float("inf"), float("nan")
    frame = lambda values: spark.createDataFrame([(v,) for v in values], "v double")
    assert ml.exact_quantiles(frame([1.0, 2.0, 3.0, inf]), "v", [0, 0.5, 0.9, 1]) == [1.0, 2.5, inf, inf]
    assert ml.exact_quantiles(frame([-inf, -inf, 4.0, nan, None, 6.0, inf]), "v", [0, 0.25, 0.3, 0.5, 0.75, 1]) == [-inf, -inf, -inf, 4.0, 6.0, inf]
    assert ml.exact_quantiles(frame([inf, inf]), "v", [0.5]) == [inf]
    assert ml.exact_quantiles(frame([nan, None]), "v", [0.5]) == [None]
    wide = [-1.7e308, -1.0, 0.0, 5e-324, 1e-320, 1.0, 1.7e308]
    assert ml.exact_quantiles(frame(wide), "v", [k / 6 for k in range(7)], parts=4) == wide
    got = ml.imputed(frame([1.0, nan, None, inf, 3.0]), ["v"])
    assert sorted(r.v for r in got.collect()) == [1.0, 3.0, 3.0, 3.0, inf]


def test_http_request_with_repeated_headers(spark):
    from aerolake.operators import dpi

    many = "".join(f"X-{i}: {i}\r\n" for i in range(1500))
    sent = ["GET /a HTTP/1.1\r\nAccept: x\r\nAccept: y\r\nHost: one\r\nhost : two:80\r\n\r\n", f"GET /b HTTP/1.1\r\n{many}Host: late\r\n", "GET /c HTTP/1.1", "nonsense", "", None]
    got = spark.createDataFrame([(k, v) for k, v in enumerate(sent)], "k int, p string").select("k", dpi.http_request(F.col("p")).alias("h")).orderBy("k").collect()
    assert [r.h and (r.h.method, r.h.url, r.h.host, r.h.user_agent) for r in got] == [("GET", "/a", "two:80", None), ("GET", "/b", "late", None), ("GET", "/c", None, None), None, None, None]


def test_split_by_hash(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(3000)] + [(9000, 7), (9001, 8), (9002, 8)], "id long, label int")
    train, test = ml.split(df)
    a, b = ({r.id for r in x.collect()} for x in (train, test))
    assert not a & b and len(a | b) == 3003 and 0.2 < len(b) / 3003 < 0.3
    assert {r.label for r in train.select("label").distinct().collect()} == {0, 1, 2, 7, 8} and 9000 in a


def test_anomalies_by_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (200, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 2]])
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(x.tolist())], "id long, a double, b double, c double")
    got = {r.id: r for r in ml.anomaly_scores(df, ["a", "b", "c"]).collect()}
    inv = np.linalg.inv(np.cov(x.T, bias=True))
    d = np.array([(v - x.mean(0)) @ inv @ (v - x.mean(0)) for v in x])
    assert np.allclose([got[i].distance for i in range(200)], d)
    assert sum(r.anomaly for r in got.values()) == 20 and all(got[i].anomaly == (d[i] > np.quantile(d, 0.9)) for i in range(200))


def test_pruned_state(spark):
    df = lambda rows, names: spark.createDataFrame(rows, names)
    kept, gone = fold.prune_state(
        df([("A", 90.0), ("B", 10.0)], "bssid string, last_seen double"), df([("x", 95.0), ("y", 5.0)], "client string, last_seen double"),
        df([("x", "A"), ("x", "B"), ("y", "A")], "client string, bssid string"), df([("n1", "beacon", "A"), ("n2", "beacon", "B"), ("n3", "probe_req", "y"), ("n3", "probe_req", "x")], "ssid string, source string, mac string"),
        df([("x", "A"), ("y", "B")], "client string, bssid string"), df([("x", "n2"), ("x", "n3")], "client string, ssid string"), 100.0, 50.0,
    )
    assert gone.first().asDict() == {"aps": 1, "clients": 1, "sequences": 2, "names": 1, "total": 5}
    got = {k: sorted(tuple(r) for r in v.collect()) for k, v in kept.items()}
    assert got["sequences"] == [("A", "x")] or got["sequences"] == [("x", "A")]
    assert {r[1] for r in got["sources"]} == {"n1", "n3"} and len(got["contacts"]) == 1 and len(got["asked"]) == 1


def test_discovered_plugins(tmp_path):
    (tmp_path / "good.py").write_text("metadata = {'name': 'g', 'dependencies': ['json', 'no_such_module']}\ndef run(state): return state + 1\n")
    (tmp_path / "bad.py").write_text("raise RuntimeError('x')\n")
    (tmp_path / "none.py").write_text("y = 1\n")
    (tmp_path / "folder").mkdir()
    (tmp_path / "folder" / "plugin.py").write_text("def run(**all): return sorted(all)\n")
    found = registry.discover(str(tmp_path))
    assert set(found) == {"good", "bad", "folder"} and found["good"]["missing"] == ["no_such_module"]
    assert registry.run(found["good"]["run"], state=1, other=2) == 2 and registry.run(found["folder"]["run"], a=1, b=2) == ["a", "b"]
    assert found["bad"]["run"] is None and "RuntimeError" in found["bad"]["error"]


def test_no_machine_folder_on_a_cluster():
    class Held:
        def __getattr__(self, name):
            return self

        def __call__(self, *a, **k):
            return self

        def isDefined(self):
            return False

    class Context(Held):
        master = "spark://somewhere:7077"

    class Session(Held):
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda *a: None)})()

    Context.getConf = lambda self: type("Conf", (), {"get": staticmethod(lambda *a: None)})()
    with pytest.raises(ValueError, match="checkpoint.dir"):
        runtime.shared_dir(Session())


def test_ensemble_and_votes(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(k), *(rng.normal(0, 1, 3) + 3 * np.eye(3)[k]).tolist()) for i, k in enumerate(rng.integers(0, 3, 300).tolist())]
    scores, models = ml.ensemble(spark.createDataFrame(rows, "id long, label double, a double, b double, c double"), ["a", "b", "c"], folds=2)
    assert set(scores) == {"random_forest", "logistic", "tree", "hard_vote", "soft_vote", "stacked"} and min(scores.values()) > 0.75 and "stacked" in models


def test_auc_by_pairs(spark):
    rng = np.random.default_rng(6)
    s, y = np.round(rng.normal(0, 1, 200), 1), rng.integers(0, 2, 200)
    want = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    df = spark.createDataFrame(list(zip(s.tolist(), y.tolist(), strict=True)), "score double, label int")
    assert abs(ml.roc_auc(df) - want) < 1e-12 and ml.roc_auc(df.where("label = 1")) == 0.5


def test_spectral_parts_two_rings(spark):
    rng = np.random.default_rng(7)
    rows = [(i, *(rng.normal(0, 0.1, 2) + (8 * (i % 2), 0)).tolist()) for i in range(80)]
    got = {r.id: r.cluster for r in cluster.spectral(spark.createDataFrame(rows, "id long, a double, b double"), ["a", "b"], 2).collect()}
    assert len(got) == 80 and len({got[i] for i in range(0, 80, 2)} & {got[i] for i in range(1, 80, 2)}) == 0


def test_silhouettes_of_several_clusterings(spark, monkeypatch):
    """One pass gives each clustering's silhouette, also where its clusters are taken a few at a time."""
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (150, 3))
    a, b = rng.integers(0, 3, 150), rng.integers(0, 50, 150)
    df = spark.createDataFrame([(v.tolist(), int(i), int(j)) for v, i, j in zip(x, a, b, strict=True)], "x array<double>, a int, b int")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))

    def plain(c):
        out = []
        for i in range(len(c)):
            own, far = (c == c[i]).sum(), [d[i][c == k].mean() for k in set(c.tolist()) - {c[i]}]
            mine = d[i][c == c[i]].sum() / max(1, own - 1)
            out.append((min(far) - mine) / max(min(far), mine) if own > 1 else 0.0)
        return np.mean(out)

    assert np.allclose(cluster.silhouettes(df, "x", ["a", "b"], 40), [plain(a), plain(b)])
    monkeypatch.setattr(cluster, "SUMS", 640)
    assert np.allclose(cluster.silhouettes(df, "x", ["a", "b"], 40), [plain(a), plain(b)])


def test_all_numbers_of_clusters_are_measured_together(spark, monkeypatch):
    """The rows are written once for all models, and one pass over the pairs measures every k."""
    rng = np.random.default_rng(6)
    rows = [(float(20 * (i % 3) + v), float(20 * (i % 3) + w)) for i, (v, w) in enumerate(rng.normal(0, 1, (60, 2)))]
    written, passes, plain, measure = [], [], cluster.materialize, cluster.silhouettes

    def kept(df, name):
        written.append(name)
        return plain(df, name)

    def seen(df, vector, clusters, *more):
        passes.append(list(clusters))
        return measure(df, vector, clusters, *more)

    monkeypatch.setattr(cluster, "materialize", kept)
    monkeypatch.setattr(cluster, "silhouettes", seen)
    df = spark.createDataFrame([(a, b) for a, b in rows] + [(None, 0.0)], "a double, b double")
    assert cluster.best_k(df, ["a", "b"]) == 3
    assert passes == [[f"c{k}" for k in range(2, 8)]] and written.count("to-cluster") == 1
    assert cluster.best_k(df.limit(1), ["a", "b"]) == 1


def test_algorithms_are_measured_together(spark, monkeypatch):
    """One pass over the pairs measures all algorithms."""
    rng = np.random.default_rng(7)
    rows = [(float(20 * (i % 3) + v), float(20 * (i % 3) + w)) for i, (v, w) in enumerate(rng.normal(0, 1, (45, 2)))]
    passes, measure = [], cluster.silhouettes

    def seen(df, vector, clusters, *more):
        passes.append(len(clusters))
        return measure(df, vector, clusters, *more)

    monkeypatch.setattr(cluster, "silhouettes", seen)
    got = cluster.best_algorithm(spark.createDataFrame(rows, "a double, b double"), ["a", "b"], 3, ("kmeans", "hierarchical", "ward")).collect()
    assert passes == [3] and [r.algorithm for r in got] == ["kmeans", "hierarchical", "ward"]
    assert got[0].silhouette > 0.8 and got[2].silhouette > 0.8 and sum(r.best for r in got) == 1


def test_a_visit_is_read_and_written_once_a_trigger():
    import pandas as pd

    from aerolake.streaming.wifi import Visits

    calls = []

    class State:
        held = None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, value):
            calls.append("update")
            self.held = value

    class Handle:
        def getValueState(self, *_):
            return State()

        def registerTimer(self, at):
            calls.append(("set", at))

        def deleteTimer(self, at):
            calls.append(("unset", at))

    visits = Visits(10.0)
    visits.init(Handle())
    frame = lambda rows: pd.DataFrame([(t, i, b) for i, (t, b) in enumerate(rows)], columns=["ts", "event_id", "bssid"])
    first = frame([(float(t % 7), "ab"[t % 2] if t % 3 else None) for t in range(60)])
    assert [len(p) for p in visits.handleInputRows(("c",), iter([first]), None)] == [0]
    assert calls == ["get", ("set", 16001), "update"]
    calls.clear()
    (out,) = visits.handleInputRows(("c",), iter([frame([(12.0, "b"), (30.0, None), (31.0, "z")])]), None)
    assert out.values.tolist() == [["c", 0.0, 12.0, 61, 2, "b"]]
    assert calls == ["get", ("unset", 16001), ("set", 41001), "update"]
    assert visits.visit.held == (30.0, 31.0, 2, 41001, ["z"], [1])
