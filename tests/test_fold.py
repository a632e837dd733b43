"""The fold against a slow walk over events in order, on small random logs."""

import random

import pytest

from aerolake.functions import scalars as S
from aerolake.operators import features, fold
from aerolake.sources.events import SCHEMA, decode_ies
from pyspark.sql import functions as F

MACS = ["a8:51:ab:00:00:01", "b2:51:ab:00:00:02", "a8:51:ab:00:00:03", "", None]
APS = ["08:96:d7:00:00:01", "08:96:d7:00:00:02", "ff:ff:ff:ff:ff:ff", "junk", "", None]
NAMES = ["one", "two", "<hidden>", "", None]


def log(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.choice(["beacon", "probe_resp", "probe_req", "data", "data", "other", None])
        rows.append(
            {
                "event_id": i, "ts": None if rng.random() < 0.03 else float(rng.randrange(60)), "type": kind, "bssid": rng.choice(APS), "ssid": rng.choice(NAMES), "client": rng.choice(MACS),
                "channel": rng.choice([0, 1, 6, None]), "rssi": rng.choice([-50.0, -70.0, 0.0, None]), "noise": rng.choice([-95.0, None]), "mcs_index": rng.choice([0, 7, None]), "fcs_error": rng.choice([True, False, None]),
                "seq": rng.choice([0, 5, 100, 1200, 4090, None]), "is_powersave": rng.choice([True, False, None]), "ie_order_hash": rng.choice([0, 3, 4, None]),
                "probes": rng.choice([["one"], ["two", "<broadcast>"], [], None]), "cap": rng.choice([0, 1, 2, None]), "beacon_interval": rng.choice([0, 100, 102, None]),
            }
        )
    return rows


def valid(mac):
    import re

    return bool(mac) and re.fullmatch("([0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}", mac) is not None and int(mac[:2], 16) % 2 == 0


def walk(rows):
    out = {"packets": {}, "data": {}, "assoc": set(), "power": {}, "steps": {}, "ap_frames": {}, "ssid": {}}
    probed, on, last = {}, {}, {}
    for e in sorted((r for r in rows if r["ts"] is not None), key=lambda r: (r["ts"], r["event_id"])):
        c, b = e["client"], e["bssid"]
        if c:
            out["packets"][c] = out["packets"].get(c, 0) + 1
        if b and not valid(b):
            continue
        if b:
            out["ap_frames"].setdefault(b, 0)
            if e["type"] in ("beacon", "probe_resp", "data"):
                out["ap_frames"][b] += 1
            if e["type"] in ("beacon", "probe_resp") and e["ssid"] and e["ssid"] != "<hidden>":
                out["ssid"][b] = e["ssid"]
        if c and e["type"] == "probe_req":
            probed.setdefault(c, set()).update(e["probes"] or [])
        if c and e["type"] == "data":
            out["data"][c] = out["data"].get(c, 0) + 1
            now = bool(e["is_powersave"])
            out["power"][c] = out["power"].get(c, 0) + (now != on.get(c, False))
            on[c] = now
            if b:
                out["assoc"] |= {(s, b) for s in probed.get(c, ())}
                if e["seq"] is not None:
                    if (c, b) in last:
                        step = (e["seq"] - last[c, b]) % 4096
                        out["steps"][c, b] = out["steps"].get((c, b), 0) + (1 <= step <= 1000)
                    else:
                        out["steps"][c, b] = 0
                    last[c, b] = e["seq"]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_fold_equals_walk(spark, seed):
    rows = log(seed)
    e = spark.createDataFrame([tuple(r.get(f.name) for f in SCHEMA) for r in rows], SCHEMA)
    want = walk(rows)
    assert {r.client: r.packets for r in fold.clients(e).collect()} == want["packets"]
    assert {r.client: r.data_frames for r in fold.clients(e).collect() if r.data_frames} == want["data"]
    assert {(r.ssid, r.bssid) for r in fold.associations(e).collect()} == want["assoc"]
    assert {r.client: r.transitions for r in fold.power_saves(e).collect()} == want["power"]
    assert {(r.client, r.bssid): r.monotonic for r in fold.sequences(e).collect()} == want["steps"]
    aps = fold.access_points(e).collect()
    assert {r.bssid: r.frames for r in aps} == want["ap_frames"]
    assert {r.bssid: r.ssid for r in aps if r.ssid} == want["ssid"]


def test_stretches(spark):
    """The row before, however time is cut."""
    rng = random.Random(9)
    rows = [(rng.choice("ab"), float(rng.randrange(50)), i, i) for i in range(80)]
    df = spark.createDataFrame(rows, "k string, ts double, event_id long, v int")
    want, last = {}, {}
    for k, _, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        want[i], last[k] = last.get(k), v
    for stretch in (1.0, 7.0, 1000.0):
        assert {r.event_id: r.was.v if r.was else None for r in fold.previous(df, ["k"], ["v"], stretch).collect()} == want


def test_empty_log(spark):
    e = spark.createDataFrame([], SCHEMA)
    assert fold.clients(e).count() == 0
    assert features.pairs(e).count() == 0
    assert features.client_behaviour(e).count() == 0


def test_elements(spark):
    df = spark.createDataFrame([('{"45": ["1f0000000000000000000000"], "48": ["0100000fac040100000fac020100000fac028c00"]}',), ("bad",), (None,), ('{"x": ["1"]}',)], "j string")
    got = df.select(S.parse_ies(decode_ies(F.col("j"))).alias("p"), F.size(decode_ies(F.col("j"))).alias("n")).collect()
    p = got[0].p
    assert p.standards == ["802.11n"] and p.ht.mhz40 and p.ht.streams == 1
    assert p.rsn.pairwise == ["TKIP"] and p.rsn.akm == ["PSK"] and p.rsn.mfp_capable and not p.rsn.mfp_required
    assert [r.n for r in got] == [2, 0, 0, 0]


def test_local_admin(spark):
    macs = ["02:00:00:00:00:00", "06:00:00:00:00:00", "00:00:00:00:00:00", "zz:00", "a", "", None, "abc:00", "021:0"]
    got = [r.v for r in spark.createDataFrame([(m,) for m in macs], "m string").select(S.is_local_admin(F.col("m")).alias("v")).collect()]
    assert got == [True, True, False, True, False, False, False, False, False]


def test_moments(spark):
    parts = spark.createDataFrame([("k", 2, 1.5, 0.5), ("k", 2, 3.5, 0.5), ("e", 0, None, None)], "k string, x_n long, x_mean double, x_m2 double")
    got = {r.k: r for r in fold.merge_moments(parts, ["k"], "x").collect()}
    assert got["k"].x_n == 4 and got["k"].x_mean == 2.5 and abs((got["k"].x_m2 / 3) ** 0.5 - 1.2909944) < 1e-6
    assert got["e"].x_n == 0 and got["e"].x_mean is None
