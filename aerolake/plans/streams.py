"""Queries that run the log through Structured Streaming; with all events there, the results equal the batch ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.plans.oracle import sql
from aerolake.plans.wifi import r6
from aerolake.registry import query
from aerolake.runtime import fresh_path
from aerolake.sources.events import SCHEMA, wifi_events, wifi_view
from aerolake.streaming import wifi as streams


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return wifi_view(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]"))


def drained(df: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there; its batches' results, from the shared folder."""
    spark = df.sparkSession
    out, at = fresh_path(spark, "stream"), fresh_path(spark, "stream-state")
    schema = df.schema
    df.writeStream.outputMode(mode).option("checkpointLocation", at).trigger(availableNow=True).foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")).start().awaitTermination()
    return spark.read.schema(schema.add("batch", "long")).option("basePath", out).parquet(f"{out}/*")


def last_batch(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The latest row of each key."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), "batch").alias("r")).select(*keys, "r.*").drop("batch")


@query("L4_stream_counters", sql("select type, channel, count(*) as frames, round(avg(rssi), 6) as rssi_mean from e group by type, channel", "e"))
def l4(spark, sf_dir):
    rows = drained(streams.counters(streamed(spark, sf_dir)), "update")
    return last_batch(rows, ["type", "channel"]).select("type", "channel", "frames", r6("rssi_mean"))


@query("L6_stream_clients", sql("select client, round(first_seen, 6) as first_seen, round(last_seen, 6) as last_seen, packets, round(rssi_mean, 6) as rssi_mean from c1", "c1"))
def l6(spark, sf_dir):
    rows = drained(streams.client_totals(streamed(spark, sf_dir)), "update")
    return last_batch(rows, ["client"]).select("client", r6("first_seen"), r6("last_seen"), "packets", r6("rssi_mean"))


@query("L6_stream_followed", sql("select psv.client, transitions, coalesce(n, 0)::bigint as monotonic from psv left join (select client, sum(monotonic) as n from seqs group by client) s on s.client = psv.client", "psv", "seqs"))
def l6f(spark, sf_dir):
    rows = drained(streams.followed(streamed(spark, sf_dir)), "update")
    return rows.groupBy("client").agg(F.max("transitions").alias("transitions"), F.max("monotonic").alias("monotonic"))


@query("L8_stream_windows", sql("select type, floor(ts / 60)::bigint as minute, count(*) as frames, round(avg(rssi), 6) as rssi_mean from e group by 1, 2", "e"))
def l8(spark, sf_dir):
    rows = drained(streams.windowed(streamed(spark, sf_dir), width="1 minute", slide="1 minute"), "update")
    return last_batch(rows, ["window", "type"]).select("type", F.floor(F.unix_micros("window.start") / 60_000_000).alias("minute"), "frames", r6("rssi_mean"))


#: Parts of the log's time that arrive one after another; one of so many early events comes three parts late.
PARTS, TARDY = 6, 37
#: Rows of a landed file, about, and files of a part at most.
LANDED, FILES = 100_000, 64


def late_visits(spark, sf_dir):
    """The log lands part by part, some rows long after their time; visits end by gaps and timers, tardy rows are counted and left out."""
    events = wifi_events(spark, sf_dir).where("client is not null")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    span, folder = last - first, fresh_path(spark, "landing")
    part = F.least(F.lit(PARTS - 1), F.floor((F.col("ts") - first) / (span / PARTS)).cast("int"))
    tardy = (F.col("event_id") % TARDY == 0) & (part <= PARTS - 4)
    landed = events.withColumn("_part", part + F.when(tardy, 3).otherwise(0))
    rows = {r["_part"]: r["count"] for r in landed.groupBy("_part").count().collect()}  # a row a part
    files = max(1, min(FILES, min(rows.get(k, 0) for k in range(PARTS)) // LANDED))  # the same of every part: a trigger takes a part
    for k in range(PARTS):  # files are taken in the order of their making
        part_ = landed.where(F.col("_part") == k).drop("_part")
        (part_.repartition(files) if files > 1 else part_.coalesce(1)).write.mode("append").parquet(folder)
    out, at = fresh_path(spark, "visits"), fresh_path(spark, "visits-state")
    found = streams.visits(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(folder), span / 20, f"{int(span * 1000 / 12)} milliseconds")
    query_ = found.writeStream.outputMode("append").option("checkpointLocation", at).trigger(availableNow=True).format("parquet").option("path", out).start()
    query_.awaitTermination()
    return spark.read.schema(found.schema).parquet(out).withColumn("dropped", F.lit(streams.dropped(query_)).cast("long"))


@query("L5_L7_stream_visits", sql(f"""
, span as (select min(ts) as a, max(ts) as z from e where client is not null),
rows_ as (select event_id, ts, client, case when regexp_matches(bssid, '^([0-9A-Fa-f]{{2}}:){{5}}[0-9A-Fa-f]{{2}}$') and bssid not like 'ff:%' then bssid end as point,
  event_id % {TARDY} = 0 and least({PARTS - 1}, floor((ts - a) / ((z - a) / {PARTS}))) <= {PARTS - 4} as tardy, (z - a) / 20 as gap from e, span where client is not null),
steps as (select *, (ts - lag(ts) over (partition by client order by ts, event_id) > gap)::int as fresh from rows_ where not tardy),
seen as (select client, ts, point, gap, coalesce(sum(fresh) over (partition by client order by ts, event_id), 0) as visit from steps),
points as (select client, visit, point, count(*) as n from seen where point is not null group by all),
main as (select client, visit, count(*)::int as access_points, arg_min(point, (-n, point)) as main_point from points group by client, visit),
v as (select client, visit, min(ts) as first_seen, max(ts) as last_seen, count(*) as frames, any_value(gap) as gap, max(visit) over (partition by client) as last_visit from seen group by client, visit)
select client, round(first_seen, 6) as first_seen, round(last_seen, 6) as last_seen, frames, coalesce(access_points, 0)::int as access_points, main_point, (select count(*) from rows_ where tardy) as dropped
from v left join main using (client, visit) where visit < last_visit or floor((last_seen + gap) * 1000) + 1 <= (select floor(z * 1000) - floor((z - a) * 1000 / 12) from span)""", "e"))
def l5(spark, sf_dir):
    return late_visits(spark, sf_dir).select("client", r6("first_seen"), r6("last_seen"), "frames", "access_points", "main_point", "dropped")
