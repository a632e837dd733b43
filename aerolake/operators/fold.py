"""Section C: the event fold as aggregates.

Order matters in places; it is always (ts, event_id).  Rows without ts take no
part.  A frame whose access point address is given but invalid counts for its
client's totals and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolake.sources.events import BROADCAST, HIDDEN, MGMT, ordering, valid_bssid


#: Seconds of a stretch of one key's rows that a task orders; a busy key is spread over its stretches.
STRETCH = 86_400.0


def previous(rows: DataFrame, keys: list[str], values: list[str], stretch: float = STRETCH) -> DataFrame:
    """rows with ``was``, a struct of the values of the key's row before in (ts, event_id) order; null for its first.

    Rows are ordered within stretches of time, so that no key is ordered by one task;
    a stretch's first row gets the last row of the stretch before, of which there is
    one row a key and stretch.
    """
    held = rows.withColumn("_s", F.floor(F.col("ts") / stretch))
    inside = Window.partitionBy(*keys, "_s").orderBy("ts", "event_id")
    held = held.withColumn("_v", F.struct(*values)).withColumn("_in", F.lag("_v").over(inside))
    tails = held.groupBy(*keys, "_s").agg(F.max_by("_v", F.struct("ts", "event_id")).alias("_tail"))
    tails = tails.withColumn("_before", F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_s"))).drop("_tail")
    return held.join(tails, [*keys, "_s"]).withColumn("was", F.coalesce("_in", "_before")).drop("_s", "_v", "_in", "_before")


def running(rows: DataFrame, keys: list[str], value: str, name: str, stretch: float = STRETCH) -> DataFrame:
    """rows with the sum of a value over the key's rows up to each, in (ts, event_id) order.

    Summed within stretches, to which the totals of the key's earlier stretches are added.
    """
    held = rows.withColumn("_s", F.floor(F.col("ts") / stretch))
    inside = Window.partitionBy(*keys, "_s").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    totals = held.groupBy(*keys, "_s").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    return held.withColumn("_in", F.sum(value).over(inside)).join(totals, [*keys, "_s"]).withColumn(name, F.col("_in") + F.col("_before")).drop("_s", "_in", "_before")


def timed(events: DataFrame) -> DataFrame:
    """Events that the fold sees."""
    return events.where("ts is not null")


def _given(c: str) -> Column:
    """A value that is neither null nor empty nor 0."""
    col = F.col(c)
    return F.when((col.cast("string") != "") & (col.cast("string") != "0"), col)


def _usable() -> Column:
    """The frame names no access point, or a valid one."""
    return (F.coalesce("bssid", F.lit("")) == "") | valid_bssid(F.col("bssid"))


def moments(value: Column, name: str) -> list[Column]:
    """Mergeable count, mean and sample deviation (0 below two values)."""
    return [F.count(value).alias(f"{name}_n"), F.avg(value).alias(f"{name}_mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias(f"{name}_std")]


def merge_moments(parts: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Combine partial (n, mean, m2) rows of snapshots by key; exact, in one aggregate."""
    n, mean, m2 = F.col(f"{name}_n"), F.col(f"{name}_mean"), F.col(f"{name}_m2")
    total = F.sum(n)
    centre = F.sum(n * F.coalesce(mean, F.lit(0.0))) / F.when(total > 0, total)
    spread = F.sum(F.coalesce(m2, F.lit(0.0)) + n * F.coalesce(mean * mean, F.lit(0.0))) - total * centre * centre
    return parts.groupBy(*keys).agg(total.alias(f"{name}_n"), centre.alias(f"{name}_mean"), F.greatest(F.lit(0.0), F.coalesce(spread, F.lit(0.0))).alias(f"{name}_m2"))


def clients(events: DataFrame) -> DataFrame:
    """A row per client."""
    e = timed(events).where(F.coalesce("client", F.lit("")) != "")
    data, usable = F.col("type") == "data", _usable()
    return e.groupBy("client").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("packets"), *moments(F.col("rssi"), "rssi"), *moments(F.col("noise"), "noise"),
        F.count_if(F.col("fcs_error")).alias("fcs_errors"), F.array_sort(F.collect_set(_given("ie_order_hash"))).alias("order_hashes"),
        F.count_if(data & usable).alias("data_frames"), F.count_if((F.col("type") == "probe_req") & usable).alias("mgmt_frames"),
        F.avg(F.when(data & usable, F.col("mcs_index"))).alias("mcs_avg"), F.max(F.when(data & usable, F.col("mcs_index"))).alias("mcs_max"),
    )


def client_snapshot(events: DataFrame) -> DataFrame:
    """Mergeable state per client, to be stored and combined with later events."""
    e = timed(events).where(F.coalesce("client", F.lit("")) != "")
    return e.groupBy("client").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("packets"), F.count_if(F.col("fcs_error")).alias("fcs_errors"), F.count("rssi").alias("rssi_n"), F.avg("rssi").alias("rssi_mean"), (F.var_pop("rssi") * F.count("rssi")).alias("rssi_m2"))


def merged_snapshots(old: DataFrame, new: DataFrame) -> DataFrame:
    """One snapshot of two that share no events."""
    both = old.unionByName(new)
    counts = both.groupBy("client").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("packets").alias("packets"), F.sum("fcs_errors").alias("fcs_errors"))
    return counts.join(merge_moments(both, ["client"], "rssi"), "client")


def resumed(snapshot: DataFrame, events: DataFrame, watermark: float) -> DataFrame:
    """A stored snapshot brought up to date with the events after its newest one (of any kind)."""
    return merged_snapshots(snapshot, client_snapshot(events.where(F.col("ts") > watermark)))


def access_points(events: DataFrame) -> DataFrame:
    """A row per valid access point; noise and frame errors come from management frames alone."""
    e = timed(events).where(valid_bssid(F.col("bssid")))
    mgmt, data = F.col("type").isin(*MGMT), F.col("type") == "data"
    at, last = ordering(), lambda c, keep: F.max_by(c, F.when(keep & c.isNotNull(), ordering()))
    name = F.when(F.col("ssid") != HIDDEN, _given("ssid"))
    return e.groupBy("bssid").agg(
        F.min("ts").alias("first_seen"), F.max(F.when(mgmt | data, F.col("ts"))).alias("last_active"), F.max_by("ts", at).alias("last_event"), F.count_if(mgmt | data).alias("frames"),
        *moments(F.when(mgmt | data, F.col("rssi")), "rssi"), *moments(F.when(mgmt, F.col("noise")), "noise"), F.count_if(mgmt & F.col("fcs_error")).alias("fcs_errors"),
        last(_given("channel"), mgmt).alias("channel"), last(name, mgmt).alias("ssid"), F.count_if(F.col("type") == "beacon").alias("beacons"), F.count_if(F.col("type") == "probe_resp").alias("probe_resps"),
        F.array_sort(F.collect_set(F.when(mgmt, _given("cap")))).alias("caps"), last(_given("beacon_timestamp"), mgmt).alias("beacon_timestamp"),
    ).withColumn("uptime", F.col("beacon_timestamp") / 1e6)


def interval_modes(events: DataFrame) -> DataFrame:
    """An access point's most frequent beacon interval; of equals the one seen first."""
    e = timed(events).where(valid_bssid(F.col("bssid")) & F.col("type").isin(*MGMT)).select("bssid", _given("beacon_interval").alias("interval"), ordering().alias("at")).where("interval is not null")
    n = e.groupBy("bssid", "interval").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    best = F.min_by(F.struct("interval", "n"), F.struct((-F.col("n")).alias("m"), "first"))
    return n.groupBy("bssid").agg(best.alias("b"), F.count(F.lit(1)).alias("interval_kinds")).select("bssid", F.col("b.interval").alias("interval_mode"), F.col("b.n").alias("interval_mode_count"), "interval_kinds")


def element_sets(events: DataFrame) -> DataFrame:
    """Per access point, information elements with their values in order of first sight, as a map."""
    e = timed(events).where(valid_bssid(F.col("bssid")) & F.col("type").isin(*MGMT))
    one = e.select("bssid", ordering().alias("at"), F.explode("ies").alias("ie", "values")).select("bssid", "ie", "at", F.posexplode("values").alias("pos", "value"))
    seen = one.groupBy("bssid", "ie", "value").agg(F.min(F.struct("at", "pos")).alias("first"))
    per = seen.groupBy("bssid", "ie").agg(F.array_sort(F.collect_list(F.struct("first", "value"))).alias("vs"))
    return per.groupBy("bssid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ie", F.col("vs.value").alias("v"))))).alias("ies"))


def probes(events: DataFrame) -> DataFrame:
    """(client, ssid, first) for each name that a client probed for, with its first order."""
    e = timed(events).where((F.col("type") == "probe_req") & (F.coalesce("client", F.lit("")) != "") & _usable())
    one = e.select("client", ordering().alias("at"), F.explode("probes").alias("ssid")).where("ssid is not null")
    return one.groupBy("client", "ssid").agg(F.min("at").alias("first"))


def last_elements(events: DataFrame) -> DataFrame:
    """A client's elements of its last probe request that has any."""
    e = timed(events).where((F.col("type") == "probe_req") & (F.coalesce("client", F.lit("")) != "") & _usable() & (F.size("ies") > 0))
    return e.groupBy("client").agg(F.max_by("ies", ordering()).alias("ies"))


def data_frames(events: DataFrame) -> DataFrame:
    """Data frames between a client and a valid access point."""
    return timed(events).where((F.col("type") == "data") & (F.coalesce("client", F.lit("")) != "") & valid_bssid(F.col("bssid")))


def contacts(events: DataFrame) -> DataFrame:
    """(client, bssid, last) of data frames, with the order of the last one."""
    return data_frames(events).groupBy("client", "bssid").agg(F.max(ordering()).alias("last"))


def seen_with(events: DataFrame) -> DataFrame:
    """Distinct (client, bssid) of data frames."""
    return data_frames(events).select("client", "bssid").distinct()


def associations(events: DataFrame, asked: DataFrame | None = None, met: DataFrame | None = None) -> DataFrame:
    """(ssid, bssid) where some client sent data to bssid after probing for ssid.

    Both sides shrink to one row per pair before they meet: the first probe against
    the last data frame.  asked, met: ``probes`` and ``contacts``, where they are at hand.
    """
    asked, met = asked or probes(events), met or contacts(events)
    return asked.join(met, "client").where("first < last").select("ssid", "bssid").distinct()


def name_sources(events: DataFrame, asked: DataFrame | None = None, met: DataFrame | None = None) -> DataFrame:
    """Distinct (ssid, source, mac)."""
    e = timed(events)
    asked = asked or probes(e)
    named = e.where(valid_bssid(F.col("bssid")) & F.col("type").isin(*MGMT) & (F.coalesce("ssid", F.lit("")) != "")).select("ssid", F.col("type").alias("source"), F.col("bssid").alias("mac"))
    linked = associations(e, asked, met).select("ssid", F.lit("client_probe_assoc").alias("source"), F.col("bssid").alias("mac"))
    return named.unionByName(asked.select("ssid", F.lit("probe_req").alias("source"), F.col("client").alias("mac"))).unionByName(linked).distinct()


def name_map(events: DataFrame, asked: DataFrame | None = None, met: DataFrame | None = None) -> DataFrame:
    """Distinct (ssid, bssid) that any source supports."""
    return name_sources(events, asked, met).where("source != 'probe_req'").select("ssid", F.col("mac").alias("bssid")).distinct()


def power_saves(events: DataFrame) -> DataFrame:
    """C11: changes of the power-save bit over a client's data frames, from off; last time it was on."""
    e = timed(events).where((F.col("type") == "data") & (F.coalesce("client", F.lit("")) != "") & _usable())
    e = previous(e.select("client", "ts", "event_id", F.coalesce("is_powersave", F.lit(False)).alias("on")), ["client"], ["on"])
    return e.groupBy("client").agg(F.count_if(F.col("on") != F.coalesce("was.on", F.lit(False))).alias("transitions"), F.coalesce(F.max(F.when(F.col("on"), F.col("ts"))), F.lit(0.0)).alias("last_powersave"))


def sequences(events: DataFrame) -> DataFrame:
    """Forward steps (1 to 1000, modulo 4096) of sequence numbers per client and access point."""
    e = previous(data_frames(events).where("seq is not null").select("client", "bssid", "ts", "event_id", "seq"), ["client", "bssid"], ["seq"])
    step = F.pmod(F.col("seq") - F.col("was.seq"), F.lit(4096))
    return e.groupBy("client", "bssid").agg(F.count_if(step.between(1, 1000)).alias("monotonic"))


def identities(events: DataFrame) -> DataFrame:
    """Last hostname asked for by DHCP (may be null), and last address by ARP for clients seen before."""
    e = timed(events)
    hosts = e.where((F.coalesce("client", F.lit("")) != "") & ((F.col("type") == "dhcp_req") | F.col("hostname").isNotNull())).groupBy("client").agg(F.max_by(F.struct("hostname"), ordering()).alias("h"))
    first = e.where(F.coalesce("client", F.lit("")) != "").groupBy("client").agg(F.min(ordering()).alias("first"))
    arps = e.where("arp_mac is not null and arp_ip is not null").select(F.col("arp_mac").alias("client"), "arp_ip", ordering().alias("at"))
    ips = arps.join(first, "client").where("first <= at").groupBy("client").agg(F.max_by("arp_ip", "at").alias("ip"))
    return hosts.join(ips, "client", "full").select("client", F.col("h.hostname").alias("hostname"), "ip")


def prune(entities: DataFrame, now: float, ttl: float = 7200.0, seen: str = "last_seen") -> DataFrame:
    """C14: entities seen within the last ``ttl`` seconds."""
    return entities.where(F.lit(now) - F.col(seen) <= ttl)


def prune_state(aps: DataFrame, clients: DataFrame, sequences: DataFrame, sources: DataFrame, contacts: DataFrame, asked: DataFrame, now: float, ttl: float = 7200.0) -> tuple[dict[str, DataFrame], DataFrame]:
    """C14: the whole state without what was last seen more than ``ttl`` seconds ago, and a row of how much went.

    aps (bssid, last_seen) and clients (client, last_seen) go by age; sequences (client,
    bssid) with either; of sources (ssid, source, mac) only live addresses stay, so a
    name without any goes, and its probes (asked: client, ssid) with it; contacts (client,
    bssid) go with their access point.
    """
    live_aps, live_clients = prune(aps, now, ttl), prune(clients, now, ttl)
    old_aps = aps.where(F.lit(now) - F.col("last_seen") > ttl).select("bssid")
    old_clients = clients.where(F.lit(now) - F.col("last_seen") > ttl).select("client")
    live = live_aps.select(F.col("bssid").alias("mac")).unionByName(live_clients.select(F.col("client").alias("mac"))).distinct()
    kept = {
        "aps": live_aps, "clients": live_clients,
        "sequences": sequences.join(old_aps, "bssid", "left_anti").join(old_clients, "client", "left_anti"),
        "sources": sources.join(live, "mac", "left_semi"),
        "contacts": contacts.join(old_aps, "bssid", "left_anti"),
    }
    kept["asked"] = asked.join(sources.select("ssid").distinct().join(kept["sources"], "ssid", "left_anti"), "ssid", "left_anti")
    size = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    gone = size(old_aps, "aps").crossJoin(size(old_clients, "clients"))  # one-row tables
    gone = gone.crossJoin(size(sequences, "_a")).crossJoin(size(kept["sequences"], "_b")).crossJoin(sources.agg(F.count_distinct("ssid").alias("_c"))).crossJoin(kept["sources"].agg(F.count_distinct("ssid").alias("_d")))
    gone = gone.select("aps", "clients", (F.col("_a") - F.col("_b")).alias("sequences"), (F.col("_c") - F.col("_d")).alias("names"))
    return kept, gone.withColumn("total", F.col("aps") + F.col("clients") + F.col("sequences") + F.col("names"))


def channel_ranking(events: DataFrame, top: int = 6, repeat: int = 3) -> DataFrame:
    """C17: channels by activity and signal of their access points; the best ones come ``repeat`` times."""
    aps = access_points(events).where("channel is not null")
    score = F.sum(F.col("frames") + (100 + F.coalesce("rssi_mean", F.lit(-100.0))) / 10)
    ranked = aps.groupBy("channel").agg(F.count(F.lit(1)).alias("aps"), score.alias("score"))
    place = F.row_number().over(Window.orderBy(F.col("score").desc(), "channel"))  # a row a channel
    return ranked.withColumn("place", place).withColumn("visits", F.when(F.col("place") <= top, repeat).otherwise(1))


def named(c: Column) -> Column:
    """A network name that a report may show."""
    return c.isNotNull() & ~c.isin(HIDDEN, BROADCAST, "")
