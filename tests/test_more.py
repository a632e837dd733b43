"""Matching, components, clusters, sinks, streams and the plugin registry."""

import itertools
import random
import xml.etree.ElementTree as ET

import numpy as np

from aerolake import registry
from aerolake.operators import cluster, fold, inference, topology
from aerolake.operators.components import connected_components
from aerolake.sources import sinks
from aerolake.sources.events import SCHEMA, scan, wifi_events
from aerolake.streaming import wifi as streams
from pyspark.sql import functions as F


def test_assignment_is_best():
    rng = np.random.default_rng(1)
    for rows, columns in ((1, 1), (3, 5), (4, 4), (2, 6)):
        for _ in range(10):
            w = np.where(rng.random((rows, columns)) < 0.6, rng.random((rows, columns)), 0)
            got = sum(w[i, j] for i, j in inference.assignment(w))
            best = max(sum(w[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(columns), rows))
            assert abs(got - best) < 1e-9


def test_matching_total(spark):
    rng = random.Random(2)
    edges = [(f"s{i}", f"b{j}", round(rng.random(), 3) + 0.01) for i in range(5) for j in range(6) if rng.random() < 0.6]
    got = inference.matched(spark.createDataFrame(edges, "ssid string, bssid string, score double")).collect()
    w = np.zeros((5, 6))
    for s, b, x in edges:
        w[int(s[1]), int(b[1])] = x
    best = max(sum(w[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(6), 5))
    assert abs(sum(r.score for r in got) - best) < 1e-9 and all(r.exact for r in got)
    assert len({r.ssid for r in got}) == len(got) == len({r.bssid for r in got})


def test_greedy_matching(spark):
    rng = random.Random(4)
    edges = [(f"s{i}", f"b{j}", round(rng.random(), 2) + 0.01) for i in range(8) for j in range(9) if rng.random() < 0.7]
    got = inference.matched(spark.createDataFrame(edges, "ssid string, bssid string, score double"), exact_nodes=2).collect()
    assert not any(r.exact for r in got) and len({r.ssid for r in got}) == len(got) == len({r.bssid for r in got})
    w = np.zeros((8, 9))
    for s, b, x in edges:
        w[int(s[1]), int(b[1])] = x
    best = sum(w[i, j] for i, j in inference.assignment(w))
    assert best / 2 <= sum(r.score for r in got) <= best + 1e-9
    names, points = {r.ssid for r in got}, {r.bssid for r in got}
    assert all(s in names or b in points for s, b, _ in edges)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(500, 500 + k) for k in range(50)] + [(900 + k, 901 + k) for k in range(40)] + [(7, 7)]
    got = dict(connected_components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect())
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_dbscan(spark):
    rows = [(i, [0.01 * i, 0.0]) for i in range(10)] + [(100 + i, [5 + 0.01 * i, 5.0]) for i in range(10)] + [(999, [50.0, 50.0])]
    got = {r.id: r.cluster for r in cluster.dbscan(spark.createDataFrame(rows, "id long, x array<double>"), 0.05, 3).collect()}
    assert {got[i] for i in range(10)} == {0} and {got[100 + i] for i in range(10)} == {100} and got[999] == -1


def test_silhouette(spark):
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(4)
    x = np.r_[rng.normal(0, 1, (30, 3)), rng.normal(4, 1, (20, 3))]
    c = [0] * 30 + [1] * 20
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    s = []
    for i in range(50):
        own = [j for j in range(50) if c[j] == c[i] and j != i]
        other = [j for j in range(50) if c[j] != c[i]]
        a, b = d[i, own].mean(), d[i, other].mean()
        s.append((b - a) / max(a, b))
    df = spark.createDataFrame([(Vectors.dense(v), k) for v, k in zip(x.tolist(), c, strict=True)], ["features", "cluster"])
    assert abs(cluster.silhouette(df) - np.mean(s)) < 1e-9


def test_greedy_groups(spark):
    rows = [("a", 1.0, [1, 2]), ("b", 2.0, [2, 3]), ("c", 3.0, [3]), ("d", 4.0, [9]), ("e", 5.0, [])]
    got = {r.client: r.seed for r in cluster.overlap_groups(spark.createDataFrame(rows, "client string, first double, order_hashes array<long>")).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "d"}  # not transitive


def test_sinks(spark, tiny, tmp_path):
    e = wifi_events(spark, tiny)
    sinks.append_routed(e, f"file://{tmp_path}/log")
    assert spark.read.parquet(f"file://{tmp_path}/log/events").count() == e.count()
    nodes = topology.graph_nodes(e)
    edges = topology.graph_edges(e, nodes)
    for kind, tag in (("gexf", "{http://gexf.net/1.3}node"), ("graphml", "{http://graphml.graphdrawing.org/xmlns}node")):
        sinks.write_graph(nodes, edges, f"{tmp_path}/g.{kind}", kind)
        assert len(list(ET.parse(f"{tmp_path}/g.{kind}").iter(tag))) == nodes.count()
    sinks.html_report({"Access <points>": fold.access_points(e).select("bssid", "frames")}, f"{tmp_path}/r.html")
    assert "Access &lt;points&gt;" in (tmp_path / "r.html").read_text()


def test_vendor_lists(spark, tmp_path):
    cases = {"ieee": "00-11-22   (hex)\t\tAcme Inc\n001122  (base 16) Acme\n", "nmap": "001122 Acme Inc\n# x\n", "wireshark": "00:11:22\tAcme Inc # note\n#c\n"}
    for kind, text in cases.items():
        (tmp_path / kind).write_text(text)
        assert [tuple(r) for r in sinks.vendor_prefixes(spark, f"file://{tmp_path}/{kind}", kind).collect()] == [("00:11:22", "Acme Inc")]


def test_scan_bounds(spark, tiny):
    e = wifi_events(spark, tiny)
    assert scan(e, 5, 5).count() == 0 and scan(e, "x", 9).count() == 0 and scan(e).count() == e.count()


def test_config():
    assert sinks.overlaid({"a": {"x": 1, "y": 2}, "b": 1}, {"a": {"y": 3}}, None) == {"a": {"x": 1, "y": 3}, "b": 1}


def test_plugins():
    assert registry.run(lambda events, top=3: (events, top), events=1, other=2) == (1, 3)
    assert registry.run(lambda **kw: sorted(kw), a=1, b=2) == ["a", "b"]


def test_streams_equal_batch(spark, tiny, tmp_path):
    e = wifi_events(spark, tiny)
    e = e.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMA])
    e.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    src = streams.source(spark, f"file://{tmp_path}/in")
    streams.sink(src, f"file://{tmp_path}/out", f"file://{tmp_path}/cp1", None).awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/out/events").count() == e.count()
    for name, df, mode in (("totals", streams.client_totals(src), "complete"), ("followed", streams.followed(src), "update")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/cp-{name}").trigger(availableNow=True).start().awaitTermination()
    assert {(r.client, r.packets) for r in spark.table("totals").collect()} == {(r.client, r.packets) for r in fold.clients(e).collect()}
    power = {r.client: r.transitions for r in fold.power_saves(e).collect()}
    steps = {r.client: r.n for r in fold.sequences(e).groupBy("client").agg(F.sum("monotonic").alias("n")).collect()}
    got = {r.client: (r.transitions, r.monotonic) for r in spark.table("followed").collect()}
    assert got == {c: (n, steps.get(c, 0)) for c, n in power.items()}


def test_behaviour_reads_what_it_needs(spark, tiny):
    """Some of a client's columns are the same as among all, and columns of one aggregate come from one pass over the events."""
    from aerolake.operators import features

    events = wifi_events(spark, tiny)
    whole = {r.client: r for r in features.client_behaviour(events).collect()}
    for wanted in (["rssi_std", "avg_snr"], ["packet_interval_std", "avg_session_duration"], ["unique_probes_count"], ["power_save_rate", "unique_aps_seen_count"]):
        some = features.client_behaviour(events, wanted=wanted)
        assert some.columns == ["client", *wanted]
        rows = some.collect()
        assert len(rows) == len(whole)
        assert all(abs(r[c] - whole[r.client][c]) <= 1e-9 * max(1, abs(r[c])) for r in rows for c in wanted)
    plan = features.client_behaviour(events, wanted=["rssi_std", "avg_snr"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
