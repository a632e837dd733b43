"""Matching of dense components and of long chains."""

import pytest

from aerolake.operators import inference

KINDS = "ssid string, bssid string, score double"


@pytest.mark.parametrize("parted", [False, True])
def test_dense_components_are_exact(spark, parted):
    edges = [(f"n{i}", f"p{j}", 1.0 + (i * j) % 7) for i in range(60) for j in range(60)]
    if parted:
        edges += [(f"m{i}", f"q{i}", 1.0) for i in range(12)]
    got = inference.matched(spark.createDataFrame(edges, KINDS), exact_nodes=60 if not parted else 65).collect()
    assert len(got) == (72 if parted else 60) and all(r.exact for r in got)


def test_rounds_go_on_until_no_edge_is_left(spark, monkeypatch):
    """A chain of falling scores settles one edge a round; tables are held in memory to be quick."""
    left = {"rows": None}
    rounds = 205

    class Edges:
        def __init__(self, n):
            self.n = n

        def __getattr__(self, name):
            return lambda *a, **k: self

        def isEmpty(self):  # noqa: N802
            left["rows"] = self.n
            return self.n <= 0

    def kept(df, name):
        return Edges(df.n - 1 if name == "greedy" and left["rows"] is not None else df.n)

    monkeypatch.setattr(inference, "materialize", kept)
    monkeypatch.setattr(inference, "discard", lambda df: None)
    inference.dominant(Edges(rounds))
    assert left["rows"] <= 0
