"""The frame-level event table: schema, adapter, scans and decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds of frames (fixed values).
MGMT = ("beacon", "probe_resp")
TYPES = ("beacon", "probe_resp", "probe_req", "data", "dns_query", "arp_map", "dhcp_req")
HIDDEN, BROADCAST = "<hidden>", "<broadcast>"

#: The full event row; every column may be null.
SCHEMA = T.StructType(
    [
        T.StructField(name, kind, True)
        for name, kind in (
            ("event_id", T.LongType()), ("ts", T.DoubleType()), ("type", T.StringType()), ("bssid", T.StringType()), ("ssid", T.StringType()), ("client", T.StringType()),
            ("channel", T.IntegerType()), ("rssi", T.DoubleType()), ("noise", T.DoubleType()), ("mcs_index", T.IntegerType()), ("fcs_error", T.BooleanType()), ("seq", T.IntegerType()),
            ("beacon_interval", T.IntegerType()), ("cap", T.IntegerType()), ("beacon_timestamp", T.LongType()), ("is_powersave", T.BooleanType()), ("ie_order_hash", T.LongType()),
            ("ies", T.MapType(T.IntegerType(), T.ArrayType(T.StringType()))), ("probes", T.ArrayType(T.StringType())), ("dns_query", T.StringType()), ("hostname", T.StringType()),
            ("arp_mac", T.StringType()), ("arp_ip", T.StringType()), ("packet_size", T.IntegerType()), ("from_ds", T.BooleanType()),
        )
    ]
)

_RSN = "case k % 4 when 0 then '0100000fac040100000fac040100000fac028000' when 1 then '0100000fac040200000fac04000fac020100000fac01c000' else '0100000fac020100000fac020100000fac020000' end"
_HT = "case k % 3 when 0 then 'ef011bffff000000000000' when 1 then '2c0103ff0000000000000000' else '0200' end"


def wifi_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project the generic ``events`` table to the event schema, column by column.

    Deterministic and a pure projection, so filters on it reach the Parquet scan
    where they are on columns that it keeps (event_id).
    """
    return wifi_view(spark.read.parquet(f"{sf_dir}/events.parquet"))


def wifi_view(raw: DataFrame) -> DataFrame:
    """The projection itself, of a batch or a stream of generic events."""
    base = raw.selectExpr(
        "event_id", "(unix_micros(cast(ts as timestamp)) / 1e6D - 1704067200D) / 3600D as ts", "user_id as u", "value as v", "cast(regexp_extract(props, '[0-9]+', 0) as int) as k",
        "case event_type when 'view' then 'beacon' when 'error' then 'probe_resp' when 'signup' then 'probe_req' else 'data' end as type",
    )
    base = base.selectExpr("*", "cast((u * 7 + k % 3) % 97 as int) as apn", "cast(((u * 7 + k % 4) % 97) % 40 as int) as prn", "type in ('beacon', 'probe_resp') as mgmt")
    ies = (
        "case when type = 'data' then null else map_filter(map("
        f"0, array(concat('net', cast(apn % 40 as string))), 48, case when k % 5 < 3 then array({_RSN}) end, "
        f"45, case when k % 2 = 0 then array({_HT}) end, 191, case when k % 7 = 0 then array(case when k % 14 = 0 then '04000800' else '00000000' end) end, "
        "221, case when k % 6 = 0 then array('0017f20a01', '506f9a10aa') when k % 6 = 1 then array('0050f20201') end, 255, case when k % 9 = 0 then array('230100') end, "
        "55, case when k % 8 = 0 then array('01') end), (i, x) -> x is not null) end"
    )
    return base.selectExpr(
        "event_id", "ts", "type",
        "case when type = 'probe_req' then null when type = 'data' and event_id % 11 = 0 then 'ff:ff:ff:ff:ff:ff' else concat('08:96:d7:00:00:', format_string('%02x', apn)) end as bssid",
        "case when mgmt then case when event_id % 13 = 0 then '<hidden>' else concat('net', cast(apn % 40 as string)) end end as ssid",
        "case when not mgmt then concat(case when u % 3 = 0 then 'b2' else 'a8' end, ':51:ab:00:', format_string('%02x', cast(u div 256 as int)), ':', format_string('%02x', cast(u % 256 as int))) end as client",
        "case apn % 7 when 0 then 1 when 1 then 6 when 2 then 11 when 3 then 36 when 4 then 40 when 5 then 44 else 48 end as channel",
        "cast(-30 - floor(v) % 60 as double) as rssi", "case when k % 7 = 0 then null else cast(-95 + k % 5 as double) end as noise",
        "case when type = 'data' then k % 10 end as mcs_index", "k % 25 = 0 as fcs_error", "case when type = 'data' and k % 9 <> 0 then cast((event_id * 37) % 4096 as int) end as seq",
        "case when type = 'beacon' then 100 + (k % 3) * 2 end as beacon_interval", "case when mgmt then k % 4 end as cap", "case when type = 'beacon' then cast(event_id * 1000 as bigint) end as beacon_timestamp",
        "case when type = 'data' then k % 2 = 0 end as is_powersave", "case when type = 'probe_req' then cast(u % 17 as bigint) end as ie_order_hash",
        f"{ies} as ies", "case when type = 'probe_req' then array(case when k % 10 = 0 then '<broadcast>' else concat('net', cast(prn as string)) end) end as probes",
        "case when type = 'data' and k % 12 = 0 then concat(case when k % 24 = 0 then 'malware.' else 'www.' end, 'site', cast(u % 9 as string), '.example.com') end as dns_query",
        "case when type = 'data' and k % 33 = 0 then case u % 3 when 0 then 'Anna-iPhone' when 1 then 'work-laptop' else '' end end as hostname",
        "case when type = 'data' and k % 45 = 0 then concat('a8:51:ab:00:00:', format_string('%02x', cast(u % 256 as int))) end as arp_mac",
        "case when type = 'data' and k % 45 = 0 then concat('10.0.', cast(u % 200 as string), '.', cast(k as string)) end as arp_ip",
        "64 + (k * 13) % 1400 as packet_size", "k % 3 = 0 as from_ds",
    )


def scan(events: DataFrame, start: float | None = None, end: float | None = None) -> DataFrame:
    """A1: the 13 stored columns of events strictly between the bounds, by time; nonsense bounds give nothing."""
    kept = events.select("ts", "type", "bssid", "ssid", "client", "channel", "ies", "seq", "rssi", "beacon_interval", "cap", "beacon_timestamp", "is_powersave", "event_id")
    for bound in (start, end):
        if bound is not None and not isinstance(bound, (int, float)):
            return kept.limit(0)
    if start is not None and end is not None and start >= end:
        return kept.limit(0)
    if start is not None:
        kept = kept.where(F.col("ts") > start)
    if end is not None:
        kept = kept.where(F.col("ts") < end)
    return kept.orderBy("ts", "event_id").drop("event_id")


def decode_ies(text: Column) -> Column:
    """A2: information elements from JSON text; bad JSON is an empty map, keys that are no numbers go."""
    parsed = F.coalesce(F.from_json(text, "map<string,array<string>>"), F.create_map().cast("map<string,array<string>>"))
    return F.transform_keys(F.map_filter(parsed, lambda k, _: k.rlike("^[0-9]{1,3}$")), lambda k, _: k.cast("int"))


def valid_bssid(mac: Column) -> Column:
    """B2: six hex pairs and a unicast first octet."""
    return F.coalesce(mac.rlike("^([0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}$") & (F.conv(F.substring(mac, 1, 2), 16, 10).cast("int").bitwiseAND(1) == 0), F.lit(False))


def ordering() -> Column:
    """Events in order: time, then id."""
    return F.struct("ts", "event_id")
