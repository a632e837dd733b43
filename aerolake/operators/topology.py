"""Section G: roaming, topology, property graph; and the top-k report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolake.operators import fold
from aerolake.sources.events import BROADCAST


def roaming(events: DataFrame) -> DataFrame:
    """G1: how often clients moved from one access point to another, over consecutive frames that name one."""
    e = fold.timed(events).where((F.coalesce("client", F.lit("")) != "") & (F.coalesce("bssid", F.lit("")) != "")).select("client", "ts", "event_id", "bssid")
    e = fold.previous(e, ["client"], ["bssid"]).select(F.col("was.bssid").alias("source"), "bssid")
    return e.where("source != bssid").groupBy("source", F.col("bssid").alias("target")).agg(F.count(F.lit(1)).alias("moves"))


def same_channel(devices: DataFrame, key: str = "bssid", channel: str = "channel") -> DataFrame:
    """Number of other devices on a device's channel (no channel is one too), without making the pairs."""
    n = devices.groupBy(channel).agg(F.count(F.lit(1)).alias("_n"))
    return devices.alias("d").join(n.alias("n"), F.col(f"d.{channel}").eqNullSafe(F.col(f"n.{channel}"))).select(F.col(f"d.{key}").alias(key), F.col(f"d.{channel}").alias(channel), (F.col("_n") - 1).alias("neighbours"))


def same_channel_edges(devices: DataFrame, key: str = "bssid", channel: str = "channel") -> DataFrame:
    """The pairs themselves, smaller key first; for drawings of small networks."""
    a, b = devices.select(F.col(key).alias("a"), F.col(channel).alias("c")), devices.select(F.col(key).alias("b"), F.col(channel).alias("d"))
    return a.join(b, F.col("c").eqNullSafe(F.col("d")) & (F.col("a") < F.col("b"))).select("a", "b", F.col("c").alias("channel"))


def channel_occupancy(events: DataFrame, top: int = 10) -> DataFrame:
    """Access points, clients and frames by channel, with a level; the busiest ones."""
    aps = fold.access_points(events).where("channel is not null").select("bssid", "channel", "frames")
    clients = fold.seen_with(events).join(aps, "bssid").groupBy("channel").agg(F.count_distinct("client").alias("clients"))
    out = aps.groupBy("channel").agg(F.count(F.lit(1)).alias("aps"), F.sum("frames").alias("frames")).join(clients, "channel", "left")
    level = F.when(F.col("frames") > 100, "high").when(F.col("frames") > 50, "medium").otherwise("low")
    return out.select("channel", "aps", F.coalesce("clients", F.lit(0)).alias("clients"), "frames", level.alias("level")).orderBy(F.col("frames").desc(), "channel").limit(top)


def graph_nodes(events: DataFrame, least_frames: int = 0, least_seconds: float = 0.0) -> DataFrame:
    """Access points and clients as nodes of a property graph, filtered by activity and duration."""
    ap = fold.access_points(events).select(F.col("bssid").alias("id"), F.lit("ap").alias("kind"), F.coalesce("ssid", F.lit("<unknown>")).alias("label"), "channel", "rssi_mean", F.col("frames").alias("packets"), "first_seen", F.coalesce("last_active", "first_seen").alias("last_seen"))
    client = fold.clients(events).select(F.col("client").alias("id"), F.lit("client").alias("kind"), F.col("client").alias("label"), "rssi_mean", "packets", "first_seen", "last_seen")
    both = ap.unionByName(client, allowMissingColumns=True)
    return both.where((F.col("packets") >= least_frames) & (F.col("last_seen") - F.col("first_seen") >= least_seconds))


def graph_edges(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """Associations between nodes that both exist; weight at least 0.1, by mean signal."""
    ids = nodes.select("id", "kind", "rssi_mean")
    client = ids.where("kind = 'client'").select(F.col("id").alias("client"), F.coalesce("rssi_mean", F.lit(-100.0)).alias("r"))
    ap = ids.where("kind = 'ap'").select(F.col("id").alias("bssid"))
    return fold.seen_with(events).join(client, "client").join(ap, "bssid", "left_semi").select(F.col("client").alias("source"), F.col("bssid").alias("target"), F.greatest(F.lit(0.1), 100 + F.col("r")).alias("weight"))


def attribute_types(nodes: DataFrame) -> DataFrame:
    """(name, type, held): attributes, their graph types, and how many nodes hold a value; one that none holds is a string."""
    kinds = {"int": "integer", "bigint": "long", "smallint": "integer", "double": "float", "float": "float", "boolean": "boolean"}
    own = [(name, kinds.get(kind, "string")) for name, kind in nodes.dtypes if name != "id"]
    held = nodes.agg(*[F.count(name).alias(name) for name, _ in own])
    rows = held.select(F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type"), F.col(name).alias("held")) for name, kind in own])).alias("a")).select("a.*")
    return rows.withColumn("type", F.when(F.col("held") > 0, F.col("type")).otherwise("string"))


def layout(aps: DataFrame, spread: tuple[float, float] = (3.0, 0.3)) -> DataFrame:
    """Places of access points for a drawing: by channel, by signal, and in three layers."""
    vendor = aps.withColumn("_vendor", F.substring("bssid", 1, 8))  # addresses are counted by their first three octets, so no task orders all
    sizes = vendor.groupBy("_vendor").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_vendor", (F.sum("_n").over(Window.orderBy("_vendor")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_vendor").orderBy("bssid")) - 1
    placed = vendor.withColumn("_i", inside).join(before, "_vendor").withColumn("_i", F.col("_i") + F.col("_before"))
    return placed.select("bssid", ((F.coalesce("channel", F.lit(1)) - 1) * spread[0]).alias("x"), ((F.coalesce("rssi_mean", F.lit(-100.0)) + 100) * spread[1]).alias("y"), ((F.col("_i") % 3) * 2).cast("double").alias("z"))


def probed_names(events: DataFrame, top: int = 20) -> DataFrame:
    """Names by the number of clients that probed for them."""
    n = fold.probes(events).where(F.col("ssid") != BROADCAST).groupBy("ssid").agg(F.count(F.lit(1)).alias("clients"))
    return n.orderBy(F.col("clients").desc(), "ssid").limit(top)


def busiest(frame: DataFrame, by: str, key: str, top: int = 20) -> DataFrame:
    """The top rows of a report by one count."""
    return frame.orderBy(F.col(by).desc(), key).limit(top)
