"""DuckDB twins of the registered queries, written on their own from the definitions."""

from __future__ import annotations

#: Common table expressions, in an order in which each needs earlier ones only.
VIEWS = {
    "raw": """
  select event_id, (epoch_us(ts) / 1e6 - 1704067200) / 3600 as ts, user_id as u, value as v, regexp_extract(props, '[0-9]+', 0)::int as k,
         case event_type when 'view' then 'beacon' when 'error' then 'probe_resp' when 'signup' then 'probe_req' else 'data' end as type, ts as tm from events""",
    "base": """
  select *, ((u * 7 + k % 3) % 97)::int as apn, (((u * 7 + k % 4) % 97) % 40)::int as prn, type in ('beacon', 'probe_resp') as mgmt from raw""",
    "e": """
  select event_id, ts, type, u, k, v, tm, mgmt, apn,
    case when type = 'probe_req' then null when type = 'data' and event_id % 11 = 0 then 'ff:ff:ff:ff:ff:ff' else '08:96:d7:00:00:' || printf('%02x', apn) end as bssid,
    case when mgmt then case when event_id % 13 = 0 then '<hidden>' else 'net' || (apn % 40) end end as ssid,
    case when not mgmt then (case when u % 3 = 0 then 'b2' else 'a8' end) || ':51:ab:00:' || printf('%02x', (u // 256)::int) || ':' || printf('%02x', (u % 256)::int) end as client,
    [1, 6, 11, 36, 40, 44, 48][apn % 7 + 1] as channel, (-30 - floor(v)::bigint % 60)::double as rssi, case when k % 7 <> 0 then (-95 + k % 5)::double end as noise,
    case when type = 'data' then k % 10 end as mcs, k % 25 = 0 as fcs, case when type = 'data' and k % 9 <> 0 then (event_id * 37) % 4096 end as seq,
    case when type = 'beacon' then 100 + (k % 3) * 2 end as bi, case when mgmt then k % 4 end as cap, case when type = 'beacon' then event_id * 1000 end as bt,
    case when type = 'data' then k % 2 = 0 end as ps, case when type = 'probe_req' then u % 17 end as oh,
    case when type = 'probe_req' then case when k % 10 = 0 then '<broadcast>' else 'net' || prn end end as probe,
    case when type = 'data' and k % 12 = 0 then (case when k % 24 = 0 then 'malware.' else 'www.' end) || 'site' || (u % 9) || '.example.com' end as dns,
    case when type = 'data' and k % 33 = 0 then case u % 3 when 0 then 'Anna-iPhone' when 1 then 'work-laptop' else '' end end as hostname,
    case when type = 'data' and k % 45 = 0 then 'a8:51:ab:00:00:' || printf('%02x', (u % 256)::int) end as arp_mac, case when type = 'data' and k % 45 = 0 then '10.0.' || (u % 200) || '.' || k end as arp_ip,
    64 + (k * 13) % 1400 as size, k % 3 = 0 as from_ds,
    case when type <> 'data' then 'net' || (apn % 40) end as ie0,
    case when type <> 'data' and k % 5 < 3 then case k % 4 when 0 then '0100000fac040100000fac040100000fac028000' when 1 then '0100000fac040200000fac04000fac020100000fac01c000' else '0100000fac020100000fac020100000fac020000' end end as ie48,
    case when type <> 'data' and k % 2 = 0 then case k % 3 when 0 then 'ef011bffff000000000000' when 1 then '2c0103ff0000000000000000' else '0200' end end as ie45,
    case when type <> 'data' and k % 7 = 0 then case when k % 14 = 0 then '04000800' else '00000000' end end as ie191,
    case when type <> 'data' and k % 6 = 0 then ['0017f20a01', '506f9a10aa'] when type <> 'data' and k % 6 = 1 then ['0050f20201'] end as ie221,
    case when type <> 'data' and k % 9 = 0 then '230100' end as ie255, case when type <> 'data' and k % 8 = 0 then '01' end as ie55
  from base""",
    "ap_rows": "select * from e where bssid like '08:%'",
    "df": "select * from e where type = 'data' and bssid like '08:%'",
    "c1": """
  select client, min(ts) as first_seen, max(ts) as last_seen, count(*) as packets, count(rssi) as rssi_n, avg(rssi) as rssi_mean, coalesce(stddev_samp(rssi), 0) as rssi_std,
         count(noise) as noise_n, avg(noise) as noise_mean, coalesce(stddev_samp(noise), 0) as noise_std, count(*) filter (fcs) as fcs_errors,
         list_sort(list_distinct(list(nullif(oh, 0)) filter (nullif(oh, 0) is not null))) as hashes,
         count(*) filter (type = 'data' and bssid like '08:%') as data_frames, count(*) filter (type = 'probe_req') as mgmt_frames,
         avg(mcs) filter (bssid like '08:%') as mcs_avg, max(mcs) filter (bssid like '08:%') as mcs_max
  from e where client is not null group by client""",
    "c3": """
  select bssid, min(ts) as first_seen, max(ts) as last_active, count(*) as frames, avg(rssi) as rssi_mean, coalesce(stddev_samp(rssi), 0) as rssi_std,
         count(noise) filter (mgmt) as noise_n, avg(noise) filter (mgmt) as noise_mean, count(*) filter (mgmt and fcs) as fcs_errors,
         arg_max(channel, ts) filter (mgmt) as channel, arg_max(ssid, ts) filter (mgmt and ssid <> '<hidden>') as ssid,
         count(*) filter (type = 'beacon') as beacons, count(*) filter (type = 'probe_resp') as probe_resps,
         list_sort(list_distinct(coalesce(list(cap) filter (mgmt and cap <> 0), []))) as caps, arg_max(bt, ts) filter (type = 'beacon' and bt <> 0) as bt
  from ap_rows group by bssid""",
    "modes": """
  select bssid, bi as interval_mode, n as interval_mode_count from (
    select bssid, bi, count(*) as n, row_number() over (partition by bssid order by count(*) desc, min(ts)) as r from ap_rows where bi is not null group by bssid, bi) where r = 1""",
    "iev": """
  select bssid, ie, val, min(ts) as first from (
    select bssid, ts, 0 as ie, ie0 as val from ap_rows where mgmt union all select bssid, ts, 48, ie48 from ap_rows where mgmt union all select bssid, ts, 45, ie45 from ap_rows where mgmt
    union all select bssid, ts, 191, ie191 from ap_rows where mgmt union all select bssid, ts, 255, ie255 from ap_rows where mgmt union all select bssid, ts, 55, ie55 from ap_rows where mgmt
    union all select bssid, ts, 221, unnest(ie221) from ap_rows where mgmt) where val is not null group by bssid, ie, val""",
    "fp": """
  select bssid, md5(string_agg(ie || ':' || vs, '|' order by ie)) as fp, sum(n)::bigint as ie_count from (
    select bssid, ie, string_agg(val, ',' order by val) as vs, count(*) as n from iev group by bssid, ie) group by bssid""",
    "pr": "select client, probe as ssid, min(ts) as first from e where type = 'probe_req' group by client, probe",
    "sw": "select distinct client, bssid from df",
    "assoc": """
  select distinct pr.ssid, d.bssid from pr join (select client, bssid, max(ts) as last from df group by client, bssid) d on pr.client = d.client and pr.first < d.last""",
    "src": """
  select distinct ssid, type as source, bssid as mac from ap_rows where mgmt union select ssid, 'probe_req', client from pr union select ssid, 'client_probe_assoc', bssid from assoc""",
    "nm": "select distinct ssid, mac as bssid from src where source <> 'probe_req'",
    "psv": """
  select client, count(*) filter (ps is distinct from was) as transitions, coalesce(max(ts) filter (ps), 0) as last_powersave from (
    select client, ts, ps, coalesce(lag(ps) over (partition by client order by ts, event_id), false) as was from df) group by client""",
    "seqs": """
  select client, bssid, count(*) filter (step between 1 and 1000) as monotonic from (
    select client, bssid, (seq - lag(seq) over (partition by client, bssid order by ts, event_id) + 4096) % 4096 as step from df where seq is not null) group by client, bssid""",
    "back": """
  select pr.ssid, sw.bssid, count(*) as sup, coalesce(sum(seqs.monotonic), 0)::bigint as seq_support from pr join sw on pr.client = sw.client
  left join seqs on seqs.client = sw.client and seqs.bssid = sw.bssid group by pr.ssid, sw.bssid""",
    "d1": """
  select nm.ssid, nm.bssid, coalesce(beacons, 0) as beacon_count, coalesce(probe_resps, 0) as probe_resp_count, coalesce(sup, 0) as supporting_clients, coalesce(rssi_mean, 0) as rssi_mean,
         coalesce(rssi_std, 0) as rssi_std, coalesce(channel, 0) as channel, coalesce(interval_mode, 0) as beacon_interval_mode, coalesce(interval_mode_count, 0) as beacon_interval_consistency,
         coalesce(len(caps), 0) as cap_count, coalesce(ie_count, 0) as ie_count, coalesce(seq_support, 0) as seq_support, fp
  from nm left join back on nm.ssid = back.ssid and nm.bssid = back.bssid left join c3 on nm.bssid = c3.bssid left join modes on nm.bssid = modes.bssid left join fp on nm.bssid = fp.bssid where nm.ssid <> '<hidden>'""",
    "norm": """
  select greatest(1, quantile_cont(beacon_count, 0.9)) as nb, greatest(1, quantile_cont(probe_resp_count, 0.9)) as np, greatest(1, quantile_cont(supporting_clients, 0.9)) as nc, greatest(1, quantile_cont(seq_support, 0.9)) as ns from d1""",
    "sc": """
  select d1.*, 0.30 * least(1, beacon_count / (nb + 1e-6)) + 0.20 * least(1, probe_resp_count / (np + 1e-6)) + 0.25 * least(1, supporting_clients / (nc + 1e-6))
         + 0.05 * least(1, seq_support / (ns + 1e-6)) + 0.10 + 0.10 * greatest(0, 1 - rssi_std / (20 + 1e-6)) as score from d1, norm""",
    "ses": """
  select client, s, min(ts) as start, max(ts) - min(ts) as duration, count(*) as packets from (
    select client, ts, sum(case when d > 10 then 1 else 0 end) over (partition by client order by ts, event_id) as s from (
      select client, ts, event_id, ts - lag(ts) over (partition by client order by ts, event_id) as d from e where client is not null)) group by client, s having count(*) > 1""",
    "gaps": """
  select client, avg(d) as im, stddev_pop(d) as isd from (select client, ts - lag(ts) over (partition by client order by ts, event_id) as d from e where client is not null) group by client""",
    "dev": "select coalesce(client, bssid) as device, * from e",
    "sig": "select device, ts, event_id, rssi, coalesce(noise, -95) as noise, channel, fcs from dev",
    "h2": """
  select device, count(*) as n, avg(rssi) as rssi_mean, coalesce(stddev_samp(rssi), 0) as rssi_std, min(rssi) as rssi_min, max(rssi) as rssi_max, avg(rssi - noise) as snr_mean, coalesce(stddev_samp(rssi - noise), 0) as snr_std,
         min(rssi - noise) as snr_min, max(rssi - noise) as snr_max, count(*) filter (fcs) / count(*) as packet_error_rate, least(1.0, count(*) / 1000.0) as utilisation from sig group by device""",
    "tr": """
  select device, ts, size, case when from_ds then 'upload' else 'download' end as direction, ts - lag(ts) over w as gap, lag(size) over w as before from dev where type = 'data' window w as (partition by device order by ts, event_id)""",
    "tr2": "select *, coalesce(gap < 0.1, false) and not coalesce(lag(coalesce(gap < 0.1, false)) over (partition by device order by ts), false) as starts from tr",
    "h3": """
  select device, sum(size)::bigint as bytes, count(*) as packets, coalesce(sum(size) filter (direction = 'upload'), 0) as up, coalesce(sum(size) filter (direction = 'download'), 0) as down, max(ts) - min(ts) as span, avg(size) as size_mean,
         coalesce(avg(gap) * 1000, 0) as gap_ms, coalesce(var_samp(size), 0) as size_variance, count(*) filter (starts) as bursts, coalesce(max((size + before) * 8 / (gap * 1e6)) filter (gap > 0), 0) as peak_mbps from tr2 group by device""",
    "act": "select device, ts, case when type in ('data', 'beacon') then 1.0::double else 0.5::double end as level, min(ts) over (partition by device) as start from dev",
    "slots": """
  select g.device, g.slot, coalesce(level, 0) as level from (select device, unnest(range(0, (floor((max(ts) - min(ts)) / 60) + 1)::bigint))::int as slot from act group by device) g
  left join (select device, floor((ts - start) / 60)::int as slot, avg(level) as level from act group by all) x on g.device = x.device and g.slot = x.slot""",
    "dq": "select client, ts, event_id, dns as domain, dns like '%malware%' as bad from e where dns is not null",
    "sets": "select client, string_agg(distinct ssid, '|' order by ssid) as probed from pr where client like 'b2%' group by client",
    "tab": """
  select event_id, tm, u, v, k, case when k % 11 <> 0 then least(0, greatest(-100, -v / 4)) end as signal, case when k % 5 = 0 then 5.0 when k % 7 = 0 then 3.1 else 2.4 end as frequency, case when k % 13 = 0 then null else k::double end as rate,
         case when k % 17 = 0 then null else ['WPA2', 'WPA3', 'Open'][k % 3 + 1] end as encryption from raw""",
}


def sql(body: str, *views: str) -> str:
    """``body`` with the views it needs, and theirs."""
    need: set[str] = set()

    def add(name: str) -> None:
        if name not in need:
            need.add(name)
            words = set(VIEWS[name].replace(",", " ").replace("(", " ").replace(")", " ").replace(".", " ").split())
            for other in VIEWS:
                if other in words and other != name:
                    add(other)

    for v in views:
        add(v)
    return "with " + ", ".join(f"{n} as ({VIEWS[n]})" for n in VIEWS if n in need) + "\n" + body


def nibble(text: str, at: int) -> str:
    """A hex digit's value, in portable SQL."""
    return f"(strpos('0123456789abcdef', substr({text}, {at}, 1)) - 1)"


def byte(text: str, k: int) -> str:
    """The k-th byte of a hex text."""
    return f"({nibble(text, 2 * k + 1)} * 16 + {nibble(text, 2 * k + 2)})"
