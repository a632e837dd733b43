"""Section L: the event log as a stream.

Order-free parts are streaming aggregates; what depends on order keeps state
per client.  With all events in time order the results equal the batch ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from aerolake.sources.events import SCHEMA
from aerolake.sources.sinks import append_routed

#: Seconds without a frame after which a client's state may go.
TTL = 7200.0


def source(spark: SparkSession, folder: str, files: int = 16) -> DataFrame:
    """L1: event files of a landing folder, so many a batch at most (back-pressure)."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(folder)


def sink(events: DataFrame, folder: str, checkpoint: str, seconds: float | None = 5.0):
    """A3, L2: append each batch to its tables; seconds None takes what is there and stops."""
    trigger = {"processingTime": f"{seconds} seconds"} if seconds else {"availableNow": True}
    return events.writeStream.foreachBatch(lambda df, _: append_routed(df, folder)).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def counters(events: DataFrame) -> DataFrame:
    """L4: running totals by type and channel."""
    return events.groupBy("type", "channel").agg(F.count(F.lit(1)).alias("frames"), F.avg("rssi").alias("rssi_mean"))


def client_totals(events: DataFrame) -> DataFrame:
    """Running totals per client; mergeable parts alone."""
    return events.where("ts is not null and coalesce(client, '') != ''").groupBy("client").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("packets"), F.avg("rssi").alias("rssi_mean"))


def windowed(events: DataFrame, late: str = "2 hours", width: str = "1 hour", slide: str = "5 minutes") -> DataFrame:
    """Frames and mean signal in sliding windows; later frames than ``late`` are left out."""
    at = events.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    return at.groupBy(F.window("at", width, slide), "type").agg(F.count(F.lit(1)).alias("frames"), F.avg("rssi").alias("rssi_mean"))


def live_sessions(events: DataFrame, gap: str = "10 seconds", late: str = "2 hours") -> DataFrame:
    """Sessions per client that close when the watermark passes their gap."""
    at = events.where("client is not null").withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    return at.groupBy(F.session_window("at", gap), "client").agg(F.count(F.lit(1)).alias("frames"))


def _follower(ttl: float | None):
    """Power-save changes (C11) and forward sequence steps (C12) of one client, as a state function."""

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        was, transitions, steps, coded = state.get if state.exists else (False, 0, 0, "")
        last = dict(x.rsplit("=", 1) for x in coded.split(";") if x)
        # a trigger's rows of one client, in order
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for on, bssid, seq in zip(rows["on"], rows["bssid"], rows["seq"], strict=True):
            transitions += bool(on) != was
            was = bool(on)
            if pd.notna(seq) and bssid:
                step = (int(seq) - int(last[bssid])) % 4096 if bssid in last else 0
                steps += 1 <= step <= 1000
                last[bssid] = str(int(seq))
        state.update((was, transitions, steps, ";".join(f"{k}={v}" for k, v in last.items())))
        if ttl is not None:
            state.setTimeoutDuration(int(ttl * 1000))
        yield pd.DataFrame({"client": [key[0]], "transitions": [transitions], "monotonic": [steps]})

    return follow


def followed(events: DataFrame, ttl: float | None = None) -> DataFrame:
    """Order-dependent client state, updated with each batch.

    ttl (a live stream's TTL): seconds of the clock without frames after which a
    client's state goes.  A stream that is to end by itself needs None, since timers
    keep it going.
    """
    from aerolake.operators.fold import _usable
    from aerolake.sources.events import valid_bssid

    rows = events.where((F.col("type") == "data") & F.col("ts").isNotNull() & (F.coalesce("client", F.lit("")) != "") & _usable())
    rows = rows.select("client", "ts", "event_id", F.coalesce("is_powersave", F.lit(False)).alias("on"), F.when(valid_bssid(F.col("bssid")), F.col("bssid")).alias("bssid"), "seq")
    timeout = GroupStateTimeout.NoTimeout if ttl is None else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy("client").applyInPandasWithState(_follower(ttl), "client string, transitions long, monotonic long", "was boolean, transitions long, steps long, last string", "update", timeout)


class Visits(StatefulProcessor):
    """A client's visit, ended when it is not seen for ``ttl`` seconds of event time, by a row behind the gap or by a timer.

    State is typed: the visit's times and frames, and its frames by access point.  It is one value, read
    and written once a trigger, since every access is a call to the state store's process.
    """

    def __init__(self, ttl: float):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.visit = handle.getValueState("visit", "first double, last double, frames long, due long, bssids array<string>, counts array<long>")

    @staticmethod
    def _row(key: tuple, first: float, last: float, frames: int, points: dict[str, int]) -> tuple:
        return key[0], first, last, frames, len(points), min(points, key=lambda p: (-points[p], p)) if points else None

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out, held = [], self.visit.get()
        first, last, frames, due = held[:4] if held else (None, None, 0, None)
        points = dict(zip(held[4], held[5], strict=True)) if held else {}
        rows = pd.concat(list(rows)).sort_values(["ts", "event_id"])  # a trigger's rows of one client
        for at, bssid in zip(rows["ts"].tolist(), rows["bssid"].tolist(), strict=True):
            if frames and at - last > self.ttl:
                out.append(self._row(key, first, last, frames, points))
                frames, points = 0, {}
            first, last, frames = (min(first, at), max(last, at), frames + 1) if frames else (at, at, 1)
            if bssid is not None and bssid == bssid:
                points[bssid] = points.get(bssid, 0) + 1
        new = int((last + self.ttl) * 1000) + 1
        if due != new:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(new)
        self.visit.update((first, last, frames, new, list(points), list(points.values())))
        yield pd.DataFrame(out, columns=VISIT_NAMES)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, out = self.visit.get(), []
        if held:
            out = [self._row(key, *held[:3], dict(zip(held[4], held[5], strict=True)))]
            self.visit.clear()
        yield pd.DataFrame(out, columns=VISIT_NAMES)


VISIT = "client string, first_seen double, last_seen double, frames long, access_points int, main_point string"
VISIT_NAMES = [x.split()[0] for x in VISIT.split(", ")]


def visits(events: DataFrame, ttl: float = TTL, late: str = "2 hours") -> DataFrame:
    """clients' visits, each once it is over; the state of a client that is gone is gone too.

    Rows that come later than ``late`` behind the newest of earlier triggers are left out by the
    watermark; ``dropped`` counts them.  Needs the RocksDB state store.
    """
    from aerolake.sources.events import valid_bssid

    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = events.where("ts is not null and coalesce(client, '') != ''").select("client", "ts", "event_id", F.when(valid_bssid(F.col("bssid")), F.col("bssid")).alias("bssid"), F.timestamp_seconds("ts").alias("at")).withWatermark("at", late)
    return rows.groupBy("client").transformWithStateInPandas(Visits(ttl), VISIT, "Append", "EventTime")


def dropped(query) -> int:
    """Rows that a finished query's watermark left out, over all its batches."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
