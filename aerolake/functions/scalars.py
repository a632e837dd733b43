"""Scalar functions (B1-B23) as column expressions; no Python runs per row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from aerolake.sources.events import valid_bssid  # noqa: F401  B2

#: Fixed values.
RANDOM_VENDOR = "(Lokal / Randomisiert)"
IE_VENDORS = {"0017f2": "Apple", "0050f2": "Microsoft", "506f9a": "Wi-Fi Alliance"}
CIPHERS = {"000fac02": "TKIP", "000fac04": "CCMP"}
AKMS = {"000fac01": "EAP", "000fac02": "PSK"}
DNS_TYPES = {1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 12: "PTR", 15: "MX", 16: "TXT", 28: "AAAA", 33: "SRV"}
DHCP_TYPES = {1: "DISCOVER", 2: "OFFER", 3: "REQUEST", 4: "DECLINE", 5: "ACK", 6: "NAK", 7: "RELEASE", 8: "INFORM"}


def is_local_admin(mac: Column) -> Column:
    """B1: the locally administered bit of the first octet; True for two characters that are no hex."""
    first = F.substring_index(mac, ":", 1)
    usable = (F.length(mac) >= 2) & mac.contains(":") & (F.length(first) == 2)
    hex_ = first.rlike("^[0-9A-Fa-f]{2}$")
    return F.coalesce(F.when(~usable, False).when(~hex_, True).otherwise(F.conv(F.when(hex_, first).otherwise("0"), 16, 10).cast("int").bitwiseAND(2) != 0), F.lit(False))


def oui_key(mac: Column) -> Column:
    """The vendor prefix that a MAC is looked up by."""
    return F.upper(F.substring(F.translate(mac, "-", ":"), 1, 8))


def vendor(mac: Column, found: Column) -> Column:
    """Vendor of a MAC, given what the prefix table has for it."""
    return F.when(is_local_admin(mac), RANDOM_VENDOR).otherwise(found)


def clever_vendor(mac: Column, found: Column, hostname: Column, apple: Column, microsoft: Column, direct: Column) -> Column:
    """Vendor, else hostname, else N/A or randomised with what the vendor elements hint at; null for no MAC."""
    local = is_local_admin(mac)
    hint = F.when(apple, "Apple?").when(microsoft, "Microsoft?").when(direct, "Android/Smart?")
    base = F.when(local, RANDOM_VENDOR).otherwise("N/A")
    guess = F.when(hint.isNotNull(), F.concat(base, F.lit(" ("), hint, F.lit(")"))).otherwise(base)
    return F.when(F.coalesce(mac, F.lit("")) != "", F.when(~local & found.isNotNull(), found).when(F.coalesce(hostname, F.lit("")) != "", hostname).otherwise(guess))


def ie_fingerprint(ies: Column) -> Column:
    """MD5 of ``id:sorted values`` in order of id; null for none."""
    parts = F.transform(F.array_sort(F.map_entries(ies)), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), F.array_join(F.array_sort(e["value"]), ",")))
    return F.when(F.size(ies) > 0, F.md5(F.array_join(parts, "|")))


def byte_at(hex_: Column, k: int) -> Column:
    """The k-th byte of a hex string; null beyond its end or where it is no hex."""
    two = F.substring(hex_, 2 * k + 1, 2)
    return F.when(two.rlike("^[0-9A-Fa-f]{2}$"), F.conv(two, 16, 10).cast("int"))


def _has(ies: Column, ie: int) -> Column:
    return F.coalesce(F.map_contains_key(ies, F.lit(ie)), F.lit(False))


def _starts(ies: Column, ie: int, prefix: str) -> Column:
    return F.coalesce(F.exists(F.element_at(ies, F.lit(ie)), lambda x: F.lower(x).startswith(prefix)), F.lit(False))


def _first(ies: Column, ie: int) -> Column:
    return F.try_element_at(F.try_element_at(ies, F.lit(ie)), F.lit(1))


def ht_capabilities(hex_: Column) -> Column:
    """40 MHz bit and spatial streams (null below 12 bytes)."""
    sets = [byte_at(hex_, k) for k in range(4, 8)]
    streams = F.when(F.length(hex_) >= 24, reduce(lambda out, k: F.when(sets[k] != 0, k + 1).otherwise(out), range(4), F.lit(1)))
    return F.struct(F.coalesce(byte_at(hex_, 0).bitwiseAND(2) != 0, F.lit(False)).alias("mhz40"), streams.alias("streams"))


def vht_capabilities(hex_: Column) -> Column:
    """160 MHz (bits 2-3 are 1) and MU beamformer (bit 19), little-endian."""
    return F.struct(F.coalesce(F.shiftright(byte_at(hex_, 0), 2).bitwiseAND(3) == 1, F.lit(False)).alias("mhz160"), F.coalesce(byte_at(hex_, 2).bitwiseAND(8) != 0, F.lit(False)).alias("mu_beamformer"))


def rsn_details(hex_: Column) -> Column:
    """Pairwise ciphers, key managements, protected-management capability and requirement."""
    count = lambda at: F.coalesce(F.expr("0") + F.conv(F.concat(hex_.substr(at + F.lit(2), F.lit(2)), hex_.substr(at, F.lit(2))), 16, 10).cast("int"), F.lit(0))
    names = lambda at, n, table: F.array_compact(F.transform(F.when(n > 0, F.sequence(F.lit(0), F.least(n, F.lit(64)) - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.lower(hex_.substr(at + i * 8, F.lit(8))))))
    pairs_at = F.lit(17)
    pairs = count(F.lit(13))
    akm_at = pairs_at + pairs * 8
    akms = count(akm_at)
    caps_at = akm_at + 4 + akms * 8
    caps = F.conv(F.concat(hex_.substr(caps_at + F.lit(2), F.lit(2)), hex_.substr(caps_at, F.lit(2))), 16, 10).cast("int")
    return F.struct(
        names(pairs_at, pairs, CIPHERS).alias("pairwise"), names(akm_at + 4, akms, AKMS).alias("akm"),
        F.coalesce(caps.bitwiseAND(128) != 0, F.lit(False)).alias("mfp_capable"), F.coalesce(caps.bitwiseAND(64) != 0, F.lit(False)).alias("mfp_required"),
    )


def parse_ies(ies: Column) -> Column:
    """B6 with B7-B9: what the information elements say, as one struct; empty lists for null."""
    present = lambda *pairs: F.array_sort(F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in pairs])))
    return F.struct(
        present((_has(ies, 48), "WPA2/3")).alias("security"),
        present((_has(ies, 45) | _has(ies, 61), "802.11n"), (_has(ies, 191), "802.11ac"), (_starts(ies, 255, "23"), "802.11ax")).alias("standards"),
        present((_has(ies, 55), "802.11r"), (_starts(ies, 221, "506f9a10"), "802.11v"), (_starts(ies, 221, "000b86") | _starts(ies, 221, "004096"), "802.11k")).alias("roaming"),
        _starts(ies, 221, "506f9a09").alias("wifi_direct"),
        present(*[(_starts(ies, 221, oui), name) for oui, name in IE_VENDORS.items()]).alias("vendors"),
        F.when(_has(ies, 45), ht_capabilities(_first(ies, 45))).alias("ht"),
        F.when(_has(ies, 191), vht_capabilities(_first(ies, 191))).alias("vht"),
        F.when(_has(ies, 48), rsn_details(_first(ies, 48))).alias("rsn"),
    )


def channel_of(mhz: Column) -> Column:
    """Channel of a frequency."""
    return F.when(mhz.between(2412, 2484), F.floor((mhz - 2407) / 5)).when(mhz.between(5180, 5825), F.floor((mhz - 5000) / 5)).cast("int")


def sequence_of(control: Column) -> Column:
    """Sequence number of a sequence-control field; none for 0."""
    return F.when(control != 0, F.shiftright(control, 4))


def host_device(hostname: Column) -> Column:
    """Device type by hostname; the first rule that fits."""
    h = F.lower(hostname)
    return F.when(h.contains("iphone") | h.contains("android"), "smartphone").when(h.contains("laptop"), "laptop").when(h.contains("desktop"), "desktop")


def by_rules(hostname: Column, rules: dict[str, str]) -> Column:
    """The first rule (name -> pattern, in order) that a hostname matches, whatever its case."""
    return F.coalesce(*[F.when(hostname.rlike(f"(?i){pattern}"), F.lit(name)) for name, pattern in rules.items()])


def signal_quality(rssi: Column) -> Column:
    """B13."""
    return F.when(rssi >= -30, "excellent").when(rssi >= -50, "good").when(rssi >= -70, "fair").otherwise("poor")


def device_by_signal(mean_rssi: Column, agent: Column | None = None) -> Column:
    """By user agent where one tells, else by mean signal (-100 if unknown)."""
    level = F.coalesce(mean_rssi, F.lit(-100.0))
    by_level = F.when(level > -50, "AP/Router").when(level > -70, "Client (Near)").otherwise("Client (Far)")
    if agent is None:
        return by_level
    a = F.lower(agent)
    return F.when(a.contains("android"), "Android Device").when(a.contains("iphone") | a.contains("ipad"), "iOS Device").when(a.contains("windows"), "Windows Device").when(a.contains("linux"), "Linux Device").otherwise(by_level)


def device_by_prefix(mac: Column) -> Column:
    """Virtual machines by vendor prefix (fixed values)."""
    p = F.upper(F.substring(mac, 1, 8))
    return F.when(p.isin("00:50:56", "08:00:27"), "Virtual").when(p.isin("00:1B:44", "00:0C:29"), "VMware").when(p == "52:54:00", "QEMU").otherwise("Physical")


def role(is_ap: Column, is_client: Column, is_bridge: Column) -> Column:
    """Role of a device; the first flag that is set."""
    return F.when(is_ap, "ap").when(is_client, "client").when(is_bridge, "bridge").otherwise("unknown")


def device_class(randomized: Column, probes: Column, data: Column, mgmt: Column) -> Column:
    """By counts of what a device sent."""
    return F.when(randomized & (probes > 5), "mobile_device").when(randomized, "iot_device").when(data > 100, "laptop").when(mgmt > 50, "smartphone").otherwise("unknown")


def validation_errors(mac: Column, ssid: Column, channel: Column, ts: Column, rssi: Column, longest: int = 32) -> Column:
    """Codes of what is wrong with a row; nulls are not wrong."""
    checks = (
        (~mac.rlike("^([0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}$"), "INVALID_MAC"), (F.length(ssid) > longest, "SSID_TOO_LONG"), ((channel < 1) | (channel > 165), "INVALID_CHANNEL"),
        ((ts < 0) | (ts > 4102444800), "INVALID_TIMESTAMP"), ((rssi < -100) | (rssi > 0), "INVALID_RSSI"),
    )
    return F.array_compact(F.array(*[F.when(bad, F.lit(code)) for bad, code in checks]))


def time_features(ts: Column) -> dict[str, Column]:
    """Of a timestamp; constants where there is none."""
    return {"hour": F.coalesce(F.hour(ts), F.lit(12)), "day_of_week": F.coalesce(F.weekday(ts), F.lit(0)), "is_weekend": F.coalesce((F.weekday(ts) >= 5).cast("int"), F.lit(0)), "month": F.coalesce(F.month(ts), F.lit(1))}


def score_label(score: Column) -> Column:
    """B23."""
    return F.when(score >= 0.75, "high").when(score >= 0.40, "medium").otherwise("low")
