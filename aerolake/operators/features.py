"""Section D: features of pairs, clients, access points and of the tabular frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolake.functions import scalars as S
from aerolake.operators import fold
from aerolake.runtime import materialize
from aerolake.sources.events import BROADCAST, HIDDEN

EPS = 1e-6
#: Names of public networks (fixed values).
PUBLIC = ("xfinitywifi", "eduroam", "Telekom_FON", "Vodafone Homespot", "cablewifi", "Spectrum Mobile")


def zero(c: str) -> Column:
    """A count that is 0 where there is none."""
    return F.coalesce(F.col(c), F.lit(0))


def pairs(events: DataFrame) -> DataFrame:
    """19 features of every (ssid, bssid) that some source supports, hidden names left out."""
    # Two small tables that several parts need are made once, instead of from a scan each.
    asked, met = materialize(fold.probes(events), "probes"), materialize(fold.contacts(events), "contacts")
    support = asked.select("client", "ssid").join(met.select("client", "bssid"), "client")
    seq = fold.sequences(events)
    backed = support.join(seq, ["client", "bssid"], "left").groupBy("ssid", "bssid").agg(F.count(F.lit(1)).alias("supporting_clients"), F.sum(zero("monotonic")).alias("seq_support"))
    aps, parsed = fold.access_points(events), F.col("parsed")
    aps = aps.join(fold.interval_modes(events), "bssid", "left").join(fold.element_sets(events), "bssid", "left").withColumn("parsed", S.parse_ies(F.col("ies")))
    known = S.is_local_admin(F.col("bssid"))
    return (
        fold.name_map(events, asked, met).where(F.col("ssid") != HIDDEN).join(backed, ["ssid", "bssid"], "left").join(aps.drop("ssid"), "bssid", "left")
        .select(
            "ssid", "bssid", zero("beacons").alias("beacon_count"), zero("probe_resps").alias("probe_resp_count"), zero("supporting_clients").alias("supporting_clients"),
            F.coalesce("rssi_mean", F.lit(0.0)).alias("rssi_mean"), F.coalesce("rssi_std", F.lit(0.0)).alias("rssi_std"), zero("channel").alias("channel"),
            zero("interval_mode").alias("beacon_interval_mode"), zero("interval_mode_count").alias("beacon_interval_consistency"), F.coalesce(F.size("caps"), F.lit(0)).alias("cap_count"),
            F.coalesce(F.aggregate(F.map_values("ies"), F.lit(0), lambda n, v: n + F.size(v)), F.lit(0)).alias("ie_count"), zero("seq_support").alias("seq_support"), known.cast("int").alias("vendor_known"),
            F.array_contains(parsed["standards"], "802.11ax").cast("int").alias("ap_supports_11ax"), F.coalesce(parsed["vht"]["mu_beamformer"], F.lit(False)).cast("int").alias("ap_mu_mimo_capable"),
            (zero("probe_resps") / (zero("beacons") + EPS)).alias("probe_to_beacon_ratio"), (zero("supporting_clients") / (zero("beacons") + EPS)).alias("client_to_beacon_ratio"),
            S.ie_fingerprint(F.col("ies")).alias("ie_fingerprint"),
        )
    )


def client_technical(events: DataFrame) -> DataFrame:
    """D3: what a client's last probe elements and frames say it can do."""
    c = fold.clients(events)
    seen = fold.seen_with(events).groupBy("client").agg(F.count(F.lit(1)).alias("seen_with_ap_count"))
    asked = fold.probes(events).groupBy("client").agg(F.count(F.lit(1)).alias("probe_count"))
    ies = fold.last_elements(events).withColumn("p", S.parse_ies(F.col("ies")))
    power = fold.power_saves(events)
    has = lambda f, v: F.coalesce(F.array_contains(f, v), F.lit(False)).cast("int")
    p = F.col("p")
    return (
        c.join(asked, "client", "left").join(seen, "client", "left").join(ies, "client", "left").join(power, "client", "left")
        .select(
            "client", S.vendor(F.col("client"), F.lit(None).cast("string")).alias("vendor"), has(p["standards"], "802.11n").alias("supports_11n"), has(p["standards"], "802.11ac").alias("supports_11ac"),
            has(p["standards"], "802.11ax").alias("supports_11ax"), zero("probe_count").alias("probe_count"), zero("seen_with_ap_count").alias("seen_with_ap_count"),
            (F.coalesce("last_powersave", F.lit(0.0)) > 0).cast("int").alias("was_in_powersave"), S.is_local_admin(F.col("client")).cast("int").alias("is_randomized_mac"),
            F.coalesce(p["ht"]["mhz40"], F.lit(False)).cast("int").alias("ht_40mhz"), F.coalesce(p["vht"]["mhz160"], F.lit(False)).cast("int").alias("vht_160mhz"), F.coalesce(p["ht"]["streams"], F.lit(0)).alias("mimo_streams"),
            has(p["vendors"], "Apple").alias("has_apple_ie"), has(p["vendors"], "Microsoft").alias("has_ms_ie"),
        )
    )


def sessions(events: DataFrame, gap: float = 10.0) -> DataFrame:
    """Sessions of a client's frames, parted by gaps of more than ``gap`` seconds; single frames are none."""
    e = fold.previous(fold.timed(events).where(F.coalesce("client", F.lit("")) != "").select("client", "ts", "event_id"), ["client"], ["ts"])
    e = fold.running(e.withColumn("starts", F.coalesce((F.col("ts") - F.col("was.ts") > gap).cast("int"), F.lit(0))), ["client"], "starts", "session")
    s = e.groupBy("client", "session").agg(F.min("ts").alias("start"), (F.max("ts") - F.min("ts")).alias("duration"), F.count(F.lit(1)).alias("packets"))
    return s.where("packets > 1")


def client_behaviour(events: DataFrame, least: int = 5, wanted: list[str] | None = None) -> DataFrame:
    """How a client behaves; only clients with at least ``least`` frames.

    session_frequency divides by the whole duration, session_frequency_ref by that
    of the last session (by the whole where there is none).  wanted: the columns besides
    the client, all by default; what none of them comes from is not worked out, so that
    the events are read and shuffled no more often than these need.
    """
    n = F.when(F.col("widest") > 0, zero("n")).otherwise(0)
    real = lambda c, on=True: F.when(F.lit(on) & (n > 0), F.col(c)).otherwise(0.0)
    columns = {
        "packet_interval_mean": F.col("packet_interval_mean"), "packet_interval_std": F.col("packet_interval_std"), "data_to_mgmt_ratio": F.col("data_frames") / (F.col("data_frames") + F.col("mgmt_frames") + EPS), "rssi_std": F.col("rssi_std"),
        "power_save_rate": zero("transitions") / (F.col("duration") + EPS), "unique_probes_count": zero("unique_probes_count"), "unique_aps_seen_count": zero("unique_aps_seen_count"),
        "avg_mcs_rate": F.coalesce("mcs_avg", F.lit(0.0)), "max_mcs_rate": zero("mcs_max"), "probed_ssid_diversity": zero("probed_ssid_diversity"), "probed_public_ssids": zero("probed_public_ssids"),
        "avg_snr": F.when(F.col("noise_n") > 0, F.col("rssi_mean") - F.col("noise_mean")).otherwise(0.0), "fcs_error_rate": F.col("fcs_errors") / F.col("packets"), "os_fingerprint_diversity": F.size("order_hashes"),
        "avg_session_duration": real("avg_session_duration"), "avg_packets_per_session": real("avg_packets_per_session"), "session_frequency": n / (F.col("duration") / 60 + EPS),
        "session_frequency_ref": n / (F.coalesce("last_duration", "duration") / 60 + EPS),
    }
    names = list(columns) if wanted is None else wanted
    of = lambda *some: any(c in names for c in some)
    in_sessions = of("avg_session_duration", "avg_packets_per_session", "session_frequency", "session_frequency_ref")
    out = fold.clients(events).where(F.col("packets") >= least).withColumn("duration", F.col("last_seen") - F.col("first_seen"))
    if in_sessions or of("packet_interval_mean", "packet_interval_std"):
        gaps = fold.previous(fold.timed(events).where(F.coalesce("client", F.lit("")) != "").select("client", "ts", "event_id"), ["client"], ["ts"]).select("client", (F.col("ts") - F.col("was.ts")).alias("d"))
        out = out.join(gaps.groupBy("client").agg(F.avg("d").alias("packet_interval_mean"), F.stddev_pop("d").alias("packet_interval_std"), F.max(F.abs("d")).alias("widest")), "client")
    if in_sessions:
        out = out.join(sessions(events).groupBy("client").agg(F.count(F.lit(1)).alias("n"), F.avg("duration").alias("avg_session_duration"), F.avg("packets").alias("avg_packets_per_session"), F.max_by("duration", "session").alias("last_duration")), "client", "left")
    if of("unique_probes_count", "probed_ssid_diversity", "probed_public_ssids"):
        asked = fold.probes(events).groupBy("client").agg(F.count(F.lit(1)).alias("unique_probes_count"), F.count_if(F.col("ssid") != BROADCAST).alias("probed_ssid_diversity"), F.count_if(F.col("ssid").isin(*PUBLIC)).alias("probed_public_ssids"))
        out = out.join(asked, "client", "left")
    if of("unique_aps_seen_count"):
        out = out.join(fold.seen_with(events).groupBy("client").agg(F.count(F.lit(1)).alias("unique_aps_seen_count")), "client", "left")
    if of("power_save_rate"):
        out = out.join(fold.power_saves(events), "client", "left")
    return out.select("client", *[columns[c].alias(c) for c in names])


def correlated(events: DataFrame) -> DataFrame:
    """randomised clients with one and the same set of probed names, in groups of several."""
    sets = fold.probes(events).where(S.is_local_admin(F.col("client"))).groupBy("client").agg(F.array_join(F.array_sort(F.collect_set("ssid")), "|").alias("probed"), F.min("first").alias("first"))
    groups = sets.groupBy("probed").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("client")), ", ").alias("macs"), F.min_by("client", "first").alias("representative"))
    return groups.where("n > 1")


def client_frame(events: DataFrame, correlate: bool = True) -> DataFrame:
    """Technical and behavioural features side by side, missing ones 0; correlated clients are one row."""
    both = client_technical(events).join(client_behaviour(events), "client", "left")
    both = both.fillna(0.0)
    if not correlate:
        return both.withColumn("original_macs", F.col("client"))
    groups = correlated(events)
    member = groups.select(F.explode(F.split("macs", ", ")).alias("client"), "macs", "representative", "n")
    tagged = both.join(member, "client", "left").where("representative is null or client = representative")
    return tagged.withColumn("original_macs", F.coalesce("macs", "client")).withColumn("label", F.coalesce(F.format_string("Gruppe (%d MACs)", F.col("n")), F.col("client"))).drop("macs", "representative", "n")


def ap_features(events: DataFrame) -> DataFrame:
    """A row per access point."""
    aps = fold.access_points(events).join(fold.interval_modes(events), "bssid", "left").join(fold.element_sets(events), "bssid", "left").withColumn("p", S.parse_ies(F.col("ies")))
    p = F.col("p")
    has = lambda f, v: F.coalesce(F.array_contains(f, v), F.lit(False)).cast("int")
    return aps.select(
        "bssid", F.coalesce("ssid", F.lit("<unknown>")).alias("ssid"), F.coalesce(S.vendor(F.col("bssid"), F.lit(None).cast("string")), F.lit("Unknown")).alias("vendor"), zero("channel").alias("channel"), zero("interval_mode").alias("beacon_interval_mode"),
        (zero("interval_mode_count") / F.greatest(zero("beacons"), F.lit(1))).alias("beacon_consistency"), F.coalesce("rssi_mean", F.lit(-100.0)).alias("rssi_mean"), "rssi_std", F.size("caps").alias("cap_count"), S.ie_fingerprint(F.col("ies")).alias("ie_fingerprint"),
        has(p["rsn"]["pairwise"], "TKIP").alias("supports_tkip"), has(p["rsn"]["akm"], "EAP").alias("is_enterprise_auth"), F.coalesce(p["rsn"]["mfp_capable"], F.lit(False)).cast("int").alias("mfp_capable"), F.coalesce(p["rsn"]["mfp_required"], F.lit(False)).cast("int").alias("mfp_required"),
        has(p["roaming"], "802.11k").alias("supports_11k"), has(p["roaming"], "802.11v").alias("supports_11v"), has(p["roaming"], "802.11r").alias("supports_11r"), "frames",
    )


def rolling_signal(frame: DataFrame, value: str, order: list[str], keys: list[str], rows: int = 5) -> DataFrame:
    """Mean, deviation, least and most of the last ``rows`` rows, per key (no keys: over the whole frame, one task)."""
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(*order).rowsBetween(1 - rows, 0)
    return frame.withColumns({f"{value}_roll_mean": F.avg(value).over(w), f"{value}_roll_std": F.stddev_samp(value).over(w), f"{value}_roll_min": F.min(value).over(w), f"{value}_roll_max": F.max(value).over(w)})


def distinct_counts(frame: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Distinct values per key, joined back to each row."""
    counts = frame.groupBy(key).agg(*[F.count_distinct(v).alias(f"{key}_{v}_count") for v in values])
    return frame.join(counts, key, "left")


def scaled(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Zero mean and unit population deviation; a constant column becomes 0."""
    stats = frame.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = frame.join(F.broadcast(stats))  # one row
    return out.withColumns({c: F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0) for c in columns}).drop(*stats.columns)


def cleaned(frame: DataFrame, signal: str, frequency: str, numbers: list[str], words: list[str]) -> DataFrame:
    """Signals clipped to [-100, 0], frequencies 2.4 or 5.0, gaps filled with medians and modes."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c))
    base = frame.withColumn(signal, F.when(finite(signal).isNotNull(), F.greatest(F.lit(-100.0), F.least(F.lit(0.0), finite(signal))))).withColumn(frequency, F.when(F.col(frequency).isin(2.4, 5.0), F.col(frequency)).otherwise(2.4))
    base = base.withColumns({c: finite(c) for c in numbers})
    fills = base.agg(*[F.median(c).alias(f"_m_{c}") for c in [signal, *numbers]], *[F.mode(c, deterministic=True).alias(f"_m_{c}") for c in words])
    out = base.join(F.broadcast(fills))  # one row
    return out.withColumns({c: F.coalesce(c, f"_m_{c}") for c in [signal, *numbers]}).withColumns({c: F.coalesce(c, f"_m_{c}", F.lit("Unknown")) for c in words}).drop(*fills.columns)


def device_fingerprints(events: DataFrame) -> DataFrame:
    """A stable MD5 of what a client sends and asks for, marked empty for clients without frames that count."""
    c = fold.clients(events)
    asked = fold.probes(events).groupBy("client").agg(F.count(F.lit(1)).alias("probes"))
    j = c.join(asked, "client", "left")
    said = F.concat_ws("|", F.lit("fp"), F.format_string("data=%d", "data_frames"), F.format_string("mgmt=%d", "mgmt_frames"), F.format_string("probes=%d", zero("probes")), F.format_string("rand=%s", S.is_local_admin(F.col("client")).cast("string")), F.array_join(F.transform("order_hashes", lambda x: x.cast("string")), ","))
    idle = (F.col("data_frames") == 0) & (F.col("mgmt_frames") == 0) & (zero("probes") == 0)
    return j.select("client", F.when(idle, F.md5(F.concat(F.lit("empty:"), "client"))).otherwise(F.md5(said)).alias("fingerprint"), S.device_class(S.is_local_admin(F.col("client")), zero("probes"), F.col("data_frames"), F.col("mgmt_frames")).alias("device_class"))


def plugin_vectors(events: DataFrame) -> DataFrame:
    """Plain numbers per client for plugins; vendors as a stable hash."""
    c = fold.clients(events)
    asked = fold.probes(events).groupBy("client").agg(F.count(F.lit(1)).alias("probes"))
    span = fold.timed(events).where(F.coalesce("client", F.lit("")) != "").groupBy("client").agg(F.min("rssi").alias("rssi_min"), F.max("rssi").alias("rssi_max"))
    duration = F.col("last_seen") - F.col("first_seen")
    return c.join(asked, "client", "left").join(span, "client").select("client", duration.alias("duration"), (F.col("packets") / (duration + EPS)).alias("rate"), zero("probes").alias("probes"), "rssi_mean", "rssi_std", "rssi_min", "rssi_max", (F.crc32(S.oui_key(F.col("client")).cast("binary")) % 1000).alias("vendor_hash"))
