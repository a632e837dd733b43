"""Section A: sinks, upserts and exports; and text sources."""

from __future__ import annotations

from string import Template
from xml.sax.saxutils import XMLGenerator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.operators.topology import attribute_types


def routed(events: DataFrame) -> dict[str, DataFrame]:
    """A3: the tables that a batch of events goes to; fields decide, not types alone."""
    host = F.col("hostname").isNotNull() & F.col("client").isNotNull()
    dns = F.col("dns_query").isNotNull()
    arp = F.col("arp_mac").isNotNull() & F.col("arp_ip").isNotNull()
    return {
        "events": events.where(F.col("ts").isNotNull() & F.col("type").isin("beacon", "probe_resp", "probe_req", "data")),
        "dns_queries": events.where(dns).select("ts", "client", F.col("dns_query").alias("domain")),
        "hostnames": events.where(host).select("ts", F.col("client").alias("mac"), "hostname"),
        "addresses": events.where(arp).select("ts", F.col("arp_mac").alias("mac"), F.col("arp_ip").alias("ip_address")),
    }


def append_routed(events: DataFrame, folder: str) -> None:
    """A3, A4: append a batch to its tables, partitioned by day."""
    for name, rows in routed(events).items():
        rows.withColumn("day", F.to_date(F.timestamp_seconds("ts"))).write.mode("append").partitionBy("day").parquet(f"{folder}/{name}")


def validated(events: DataFrame) -> DataFrame:
    """A5: rows with a time and a possible signal; addresses in upper case."""
    return events.where(F.col("ts").isNotNull() & (F.col("rssi").isNull() | F.col("rssi").between(-100, 0))).withColumns({"bssid": F.upper("bssid"), "client": F.upper("client")})


def migrated(table: DataFrame, columns: dict[str, str], version: int) -> DataFrame:
    """A table brought to a schema version: missing columns are null, the version is stated."""
    missing = {n: F.lit(None).cast(t) for n, t in columns.items() if n not in table.columns}
    return table.withColumns(missing).select(*columns).withColumn("schema_version", F.lit(version))


def latest_labels(labels: DataFrame) -> DataFrame:
    """Newest given label of each (ssid, bssid); of equal times the smallest id."""
    kept = labels.where("label is not null")
    return kept.groupBy("ssid", "bssid").agg(F.max_by("label", F.struct("ts", (-F.col("id")).alias("i"))).alias("label"))


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """Device table (mac, device_type, source, ts, hostname, ip_address) after new rows.

    The latest device type wins, the first hostname that is not empty, the latest address.
    """
    both = old.unionByName(new, allowMissingColumns=True)
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts"))).alias(c)
    return both.groupBy("mac").agg(latest("device_type"), latest("source"), F.max("ts").alias("ts"), F.min_by("hostname", F.when(F.coalesce("hostname", F.lit("")) != "", F.col("ts"))).alias("hostname"), latest("ip_address"))


def vendor_prefixes(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(prefix AA:BB:CC, vendor) of a vendor list: ieee, nmap or wireshark; the last line of a prefix wins."""
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    v = F.col("value")
    if kind == "ieee":
        rows = lines.select("line", F.regexp_replace(F.regexp_extract(v, r"^\s*([0-9A-Fa-f]{2}-[0-9A-Fa-f]{2}-[0-9A-Fa-f]{2})\s+\(hex\)", 1), "-", ":").alias("p"), F.trim(F.regexp_extract(v, r"\(hex\)\s*(.*)$", 1)).alias("vendor"))
    elif kind == "nmap":
        raw = F.regexp_extract(v, r"^([0-9A-Fa-f]{6})\s", 1)
        rows = lines.select("line", F.when(raw != "", F.concat_ws(":", F.substring(raw, 1, 2), F.substring(raw, 3, 2), F.substring(raw, 5, 2))).otherwise("").alias("p"), F.trim(F.regexp_extract(v, r"^[0-9A-Fa-f]{6}\s+(.*)$", 1)).alias("vendor"))
    else:
        rows = lines.select("line", F.regexp_extract(v, r"^([0-9A-Fa-f]{2}:[0-9A-Fa-f]{2}:[0-9A-Fa-f]{2})\t", 1).alias("p"), F.trim(F.regexp_replace(F.regexp_extract(v, r"^[^\t]+\t([^\t]*)", 1), r"\s*#.*$", "")).alias("vendor"))
    return rows.where("p != '' and vendor != ''").groupBy(F.upper("p").alias("prefix")).agg(F.max_by("vendor", "line").alias("vendor"))


def overlaid(base: dict, *layers: dict) -> dict:
    """Configuration with layers laid over it, sections merged one level deep."""
    out = dict(base)
    for layer in layers:
        for k, v in (layer or {}).items():
            out[k] = {**out[k], **v} if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, kind: str = "gexf") -> None:
    """A property graph as GEXF 1.3 or GraphML.

    Rows are fetched partition by partition and written as they come: no tree of the
    whole graph is held.
    """
    types = list(enumerate((r["name"], r["type"]) for r in attribute_types(nodes).collect()))  # a row a column
    gexf = kind == "gexf"
    with open(path, "w", encoding="utf-8") as file:
        out = XMLGenerator(file, "utf-8", short_empty_elements=True)

        def element(tag: str, attributes: dict, text: str = "") -> None:
            out.startElement(tag, attributes)
            out.characters(text)
            out.endElement(tag)

        out.startDocument()
        if gexf:
            out.startElement("gexf", {"xmlns": "http://gexf.net/1.3", "version": "1.3"})
            out.startElement("graph", {"defaultedgetype": "undirected"})
            out.startElement("attributes", {"class": "node"})
            for i, (name, t) in types:
                element("attribute", {"id": str(i), "title": name, "type": t})
            out.endElement("attributes")
            out.startElement("nodes", {})
        else:
            out.startElement("graphml", {"xmlns": "http://graphml.graphdrawing.org/xmlns"})
            for i, (name, t) in types:
                element("key", {"id": str(i), "for": "node", "attr.name": name, "attr.type": {"integer": "int", "float": "double"}.get(t, t)})
            element("key", {"id": "w", "for": "edge", "attr.name": "weight", "attr.type": "double"})
            out.startElement("graph", {"edgedefault": "undirected"})
        for row in nodes.toLocalIterator():
            given = [(str(i), str(row[name])) for i, (name, _) in types if row[name] is not None]
            out.startElement("node", {"id": str(row["id"])} | ({"label": str(row["id"])} if gexf else {}))
            if gexf:
                out.startElement("attvalues", {})
                for i, value in given:
                    element("attvalue", {"for": i, "value": value})
                out.endElement("attvalues")
            else:
                for i, value in given:
                    element("data", {"key": i}, value)
            out.endElement("node")
        if gexf:
            out.endElement("nodes")
            out.startElement("edges", {})
        for i, row in enumerate(edges.toLocalIterator()):
            ends = {"id": str(i), "source": str(row["source"]), "target": str(row["target"])}
            out.startElement("edge", ends | ({"weight": str(row["weight"])} if gexf else {}))
            if not gexf:
                element("data", {"key": "w"}, str(row["weight"]))
            out.endElement("edge")
        if gexf:
            out.endElement("edges")
        out.endElement("graph")
        out.endElement("gexf" if gexf else "graphml")
        out.endDocument()


def html_report(tables: dict[str, DataFrame], path: str, title: str = "Report", most: int = 200) -> None:
    """Small tables as one HTML page; at most ``most`` rows of each are shown, and the count of all."""
    from html import escape

    parts = []
    for name, df in tables.items():
        rows = df.limit(most).collect()
        head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in rows)
        parts.append(f"<h2>{escape(name)} ({df.count()})</h2><table><tr>{head}</tr>{body}</table>")
    page = Template("<!DOCTYPE html><html><head><meta charset='utf-8'><title>$title</title></head><body><h1>$title</h1>$body</body></html>")
    with open(path, "w", encoding="utf-8") as file:
        file.write(page.substitute(title=escape(title), body="".join(parts)))


def prometheus_lines(points: DataFrame, last: int = 100) -> DataFrame:
    """Metric points (ts, name, value, labels map) as exposition lines; the last ones of each series."""
    from pyspark.sql import Window

    pairs = F.array_sort(F.map_entries("labels"))
    series = F.concat(F.col("name"), F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))), ","), F.lit("}"))).otherwise(""))
    w = Window.partitionBy("series").orderBy(F.col("ts").desc())
    line = F.concat_ws(" ", "series", F.col("value").cast("string"), F.round(F.col("ts") * 1000).cast("bigint").cast("string"))
    return points.withColumn("series", series).withColumn("place", F.row_number().over(w)).where(F.col("place") <= last).select("series", "ts", line.alias("line"))


def metric_json(points: DataFrame, last: int = 100) -> DataFrame:
    """The same points as one JSON text a series: its name, labels, and its last points in order of time."""
    from pyspark.sql import Window

    w = Window.partitionBy("name", "_labels").orderBy(F.col("ts").desc())
    kept = points.withColumn("_labels", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("labels"))))).withColumn("place", F.row_number().over(w)).where(F.col("place") <= last)
    held = kept.groupBy("name", "_labels").agg(F.array_sort(F.collect_list(F.struct(F.col("ts").alias("timestamp"), "value"))).alias("points"))  # at most ``last`` of them
    return held.select("name", F.to_json(F.struct("name", F.from_json("_labels", "map<string,string>").alias("labels"), "points")).alias("json"))


def labelled(ssid: Column, bssid: Column, label: Column, source: str, ts: float) -> list[Column]:
    """A label row, trimmed and stamped."""
    return [F.trim(ssid).alias("ssid"), F.trim(bssid).alias("bssid"), label.cast("int").alias("label"), F.lit(source).alias("source"), F.lit(float(ts)).alias("ts")]


def write_inference(rows: DataFrame, path: str) -> None:
    """Inference results as JSON lines."""
    rows.select("ssid", "bssid", "score", "label").write.mode("overwrite").json(path)


def write_enhanced(signals: DataFrame, traffic: DataFrame, reports: DataFrame, folder: str) -> None:
    """Per-device reports as JSON, signal and traffic rows as CSV."""
    reports.write.mode("overwrite").json(f"{folder}/report")
    signals.select(F.col("device").alias("mac"), F.col("ts").alias("timestamp"), "rssi", "noise", "channel").write.mode("overwrite").csv(f"{folder}/signals", header=True)
    traffic.select(F.col("device").alias("mac"), F.col("ts").alias("timestamp"), "size", "direction", "channel").write.mode("overwrite").csv(f"{folder}/traffic", header=True)


def write_labels(labels: DataFrame, path: str) -> None:
    """The latest labels as CSV."""
    latest_labels(labels).select("ssid", "bssid", "label").write.mode("overwrite").csv(path, header=True)


def training_labels(devices: DataFrame) -> DataFrame:
    """(mac, device_type) of labelled devices."""
    return devices.where("device_type is not null").select("mac", "device_type")
