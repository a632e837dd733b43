"""Section H: signal, traffic and activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolake.functions import scalars as S
from aerolake.operators.fold import previous, timed

NOISE = -95.0
zero = lambda c: F.coalesce(c, F.lit(0.0))


def device_events(events: DataFrame) -> DataFrame:
    """H1: events by device (client, else access point)."""
    device = F.coalesce(F.when(F.col("client") != "", F.col("client")), F.when(F.col("bssid") != "", F.col("bssid")))
    return timed(events).withColumn("device", device).where("device is not null")


def signal_rows(events: DataFrame) -> DataFrame:
    """H1: device, ts, rssi, noise (-95 if unknown), channel (0 if unknown), error."""
    return device_events(events).where("rssi is not null").select("device", "ts", "event_id", "rssi", F.coalesce("noise", F.lit(NOISE)).alias("noise"), F.coalesce("channel", F.lit(0)).alias("channel"), F.coalesce("fcs_error", F.lit(False)).alias("error"))


def traffic_rows(events: DataFrame) -> DataFrame:
    """H1: device, ts, size and direction of data frames."""
    return device_events(events).where("type = 'data'").select("device", "ts", "event_id", F.coalesce("packet_size", F.lit(0)).alias("size"), F.when(F.coalesce("from_ds", F.lit(False)), "upload").otherwise("download").alias("direction"), F.coalesce("channel", F.lit(0)).alias("channel"))


def activity_rows(events: DataFrame) -> DataFrame:
    """H1: device, ts, level 1 for data and beacons, 0.5 for the rest, channel."""
    return device_events(events).select("device", "ts", F.when(F.col("type").isin("data", "beacon"), F.lit(1.0).cast("double")).otherwise(F.lit(0.5).cast("double")).alias("level"), F.coalesce("channel", F.lit(0)).alias("channel"))


def signal_quality(rows: DataFrame) -> DataFrame:
    """H2: a row per device."""
    snr = F.col("rssi") - F.col("noise")
    std = zero(F.stddev_samp("rssi"))
    return rows.groupBy("device").agg(
        F.count(F.lit(1)).alias("n"), F.avg("rssi").alias("rssi_mean"), std.alias("rssi_std"), F.min("rssi").alias("rssi_min"), F.max("rssi").alias("rssi_max"),
        F.avg(snr).alias("snr_mean"), zero(F.stddev_samp(snr)).alias("snr_std"), F.min(snr).alias("snr_min"), F.max(snr).alias("snr_max"), (F.count_if("error") / F.count(F.lit(1))).alias("packet_error_rate"),
        (1 / (1 + std)).alias("stability"), F.least(F.lit(1.0), F.count(F.lit(1)) / 1000.0).alias("utilisation"), (F.avg("rssi") - F.avg("noise")).alias("snr_of_means"),
    )


def traffic_pattern(rows: DataFrame, burst_gap: float = 0.1) -> DataFrame:
    """H3-H5: volume, rates, bursts (runs of gaps below ``burst_gap``) and peak over adjacent frames, per device."""
    r = previous(rows, ["device"], ["ts", "size"])
    r = r.withColumns({"gap": F.col("ts") - F.col("was.ts"), "before": F.col("was.size")}).drop("was")
    r = r.withColumn("close", F.coalesce(F.col("gap") < burst_gap, F.lit(False)))
    r = previous(r, ["device"], ["close"])
    r = r.withColumn("starts", F.col("close") & ~F.coalesce("was.close", F.lit(False)))
    span = F.max("ts") - F.min("ts")
    rate = lambda d: F.when(span > 0, F.sum(F.when(F.col("direction") == d, F.col("size")).otherwise(0)) * 8 / (span * 1e6)).otherwise(0.0)
    peak = F.max(F.when(F.col("gap") > 0, (F.col("size") + F.col("before")) * 8 / (F.col("gap") * 1e6)))
    return r.groupBy("device").agg(
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("packets"), rate("upload").alias("upload_mbps"), rate("download").alias("download_mbps"), F.avg("size").alias("size_mean"), zero(F.avg("gap") * 1000).alias("gap_ms"),
        zero(F.var_samp("size")).alias("size_variance"), F.count_if("starts").alias("bursts"), zero(peak).alias("peak_mbps"),
    )


def activity_slots(rows: DataFrame, seconds: float = 900.0) -> DataFrame:
    """H6: mean level in slots from a device's first event on; empty slots are 0."""
    start = rows.groupBy("device").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    all_ = start.select("device", F.explode(F.sequence(F.lit(0), F.floor((F.col("end") - F.col("start")) / seconds).cast("int"))).alias("slot"))
    held = rows.join(start, "device").groupBy("device", F.floor((F.col("ts") - F.col("start")) / seconds).cast("int").alias("slot")).agg(F.avg("level").alias("level"))
    return all_.join(held, ["device", "slot"], "left").select("device", "slot", zero(F.col("level")).alias("level"))


def channel_activity(rows: DataFrame) -> DataFrame:
    """H6: a row per device and channel (0: none known) with the levels seen there summed up, whatever their number; a list of them would grow with the log."""
    level = F.col("level")
    return rows.groupBy("device", "channel").agg(F.count("level").alias("events"), F.avg(level).alias("level_mean"), F.min(level).alias("level_min"), F.max(level).alias("level_max"))


def activity_pattern(slots: DataFrame) -> DataFrame:
    """H6, H7: kind of activity and peak slots (above mean plus deviation) per device."""
    stats = slots.groupBy("device").agg(F.count(F.lit(1)).alias("slots"), F.avg("level").alias("mean"), zero(F.stddev_samp("level")).alias("std"), zero(F.var_samp("level")).alias("var"))
    kind = F.when(F.col("var") < 0.1, "constant").when(F.col("var") > 1.0, "bursty").when(F.col("slots") > 24, "periodic").otherwise("random")
    peaks = slots.join(stats, "device").groupBy("device").agg(F.count_if(F.col("level") > F.col("mean") + F.col("std")).alias("peaks"))
    return stats.join(peaks, "device").select("device", "slots", F.col("mean").alias("level_mean"), "peaks", kind.alias("pattern"))


def health(rssi: Column) -> Column:
    """H8: health score of a mean signal."""
    return F.when(rssi > -50, 1.0).when(rssi > -70, 0.7).otherwise(0.3)


def network_insights(signals: DataFrame, traffic: DataFrame) -> DataFrame:
    """H8, H9: one row over all devices, with advice."""
    s = signals.agg(F.count(F.lit(1)).alias("devices"), F.avg("rssi_mean").alias("rssi_mean"), F.min("rssi_mean").alias("rssi_min"), F.max("rssi_mean").alias("rssi_max"), zero(F.stddev_samp("rssi_mean")).alias("rssi_std"), F.avg("snr_mean").alias("snr_mean"))
    t = traffic.agg(zero(F.sum(F.col("upload_mbps") + F.col("download_mbps"))).alias("throughput_mbps"))
    out = s.join(F.broadcast(t))  # one row each
    advice = F.array_compact(F.array(F.when(F.col("rssi_mean") < -70, "weak signal"), F.when(F.col("throughput_mbps") > 100, "high throughput")))
    return out.select("*", health(F.col("rssi_mean")).alias("health"), F.array_join(advice, "; ").alias("advice"))


def device_histogram(signals: DataFrame) -> DataFrame:
    """H9: devices by type."""
    return signals.groupBy(S.device_by_signal(F.col("rssi_mean")).alias("device_type")).agg(F.count(F.lit(1)).alias("devices"))


def signal_pivot(rows: DataFrame, channels: list[int]) -> DataFrame:
    """Mean signal by device type and channel; the channels are given, so no extra pass finds them."""
    kinds = signal_quality(rows).select("device", S.device_by_signal(F.col("rssi_mean")).alias("device_type"))
    return rows.join(kinds, "device").groupBy("device_type").pivot("channel", channels).agg(F.avg("rssi"))


def time_series(events: DataFrame) -> DataFrame:
    """Signal and traffic rows in one long frame."""
    s = signal_rows(events).select("device", "ts", F.lit("signal").alias("kind"), "rssi")
    t = traffic_rows(events).select("device", "ts", F.lit("traffic").alias("kind"), (F.col("size") / 1024).alias("throughput_kb"))
    return s.unionByName(t, allowMissingColumns=True)


def padded_levels(slots: DataFrame) -> DataFrame:
    """Levels per device as arrays of equal length, gaps null at the end."""
    longest = slots.agg((F.max("slot") + 1).alias("width"))
    per = slots.groupBy("device").agg(F.array_sort(F.collect_list(F.struct("slot", "level"))).alias("x"))
    return per.join(F.broadcast(longest)).select("device", F.concat(F.col("x.level"), F.array_repeat(F.lit(None).cast("double"), F.col("width") - F.size("x"))).alias("levels"))


def value_counts(frame: DataFrame, column: str) -> DataFrame:
    """Rows by value."""
    return frame.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
