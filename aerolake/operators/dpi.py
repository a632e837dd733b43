"""Section I: what packets carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolake.functions.scalars import DHCP_TYPES, DNS_TYPES
from aerolake.operators.fold import timed

#: Names that mark a domain as bad (fixed values).
BAD_DOMAINS = ("malware", "phishing", "botnet")


def protocol(transport: Column, port: Column) -> Column:
    """By transport and destination port."""
    return (
        F.when((transport == "tcp") & port.isin(80, 8080, 8000), "HTTP").when((transport == "tcp") & port.isin(443, 8443), "HTTPS")
        .when((transport == "udp") & (port == 53), "DNS").when((transport == "udp") & port.isin(67, 68), "DHCP").when(transport == "arp", "ARP").otherwise("OTHER")
    )


def http_request(payload: Column) -> Column:
    """Method, url, headers and what is suspicious; null where the first line is no request.  Of repeated headers the last counts."""
    lines = F.split(payload, "\r?\n")
    first = F.split(F.trim(F.element_at(lines, 1)), " +")
    rest = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    said = lambda name: F.try_element_at(F.filter(rest, lambda x: x.contains(":") & (F.lower(F.trim(F.substring_index(x, ":", 1))) == name)), F.lit(-1))
    header = lambda name: F.trim(F.regexp_replace(said(name), "^[^:]*:", ""))
    url = F.lower(F.try_element_at(first, F.lit(2)))
    agent = header("user-agent")
    flags = F.array_compact(F.array(F.when(url.contains("admin") | url.contains("login") | url.contains("config"), "admin_access"), F.when(url.contains("sql") | url.contains("union"), "sql_injection"), F.when(F.length(agent) > 200, "long_user_agent")))
    return F.when((F.size(first) >= 3) & ~payload.startswith("HTTP/"), F.struct(F.element_at(first, 1).alias("method"), F.try_element_at(first, F.lit(2)).alias("url"), agent.alias("user_agent"), header("host").alias("host"), flags.alias("flags")))


def http_response(payload: Column) -> Column:
    """Status, content type and length; null for what does not start as a response."""
    pick = lambda name: F.nullif(F.trim(F.regexp_extract(payload, rf"(?im)^{name}:([^\r\n]*)", 1)), F.lit(""))
    return F.when(payload.startswith("HTTP/1."), F.struct(F.regexp_extract(payload, r"^HTTP/1\.\d (\d+)", 1).try_cast("int").alias("status"), pick("content-type").alias("content_type"), pick("content-length").try_cast("bigint").alias("content_length")))


def dns_type(number: Column) -> Column:
    """I4: name of a query type."""
    table = F.create_map(*[F.lit(x) for kv in DNS_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, number), F.format_string("TYPE%d", number))


def dhcp_type(number: Column) -> Column:
    """Name of a message type."""
    table = F.create_map(*[F.lit(x) for kv in DHCP_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, number), F.format_string("TYPE%d", number))


def clean_domain(name: Column) -> Column:
    """I4: without the final dots."""
    return F.regexp_replace(name, r"\.+$", "")


def is_bad_domain(name: Column) -> Column:
    """I4: some listed name is part of it."""
    return F.coalesce(F.lower(name).rlike("|".join(BAD_DOMAINS)), F.lit(False))


def dns_rows(events: DataFrame) -> DataFrame:
    """I4: a row per query that an event carries; routed by the field, not by the type."""
    return timed(events).where("dns_query is not null and client is not null").select("client", "ts", "event_id", clean_domain(F.col("dns_query")).alias("domain")).withColumn("bad", is_bad_domain(F.col("domain")))


def requests(packets: DataFrame) -> DataFrame:
    """HTTP requests of packets (client, payload text): client, method, url, user_agent, host, flags."""
    return packets.select("client", http_request(F.col("payload")).alias("h")).where("h is not null and client is not null").select("client", "h.*")


def device_prints(events: DataFrame, http: DataFrame | None = None) -> DataFrame:
    """Per client its protocols, what it asked for and what of that is suspicious.

    http: rows of ``requests``; with them come their number, the agents and the flags
    raised, one each time.
    """
    dns = dns_rows(events).groupBy("client").agg(F.count(F.lit(1)).alias("queries"), F.array_join(F.array_sort(F.collect_set("domain")), ",").alias("domains"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("bad"), F.col("domain")))), ",").alias("suspicious"))
    if http is None:
        return dns
    flags = F.array_join(F.array_sort(F.flatten(F.collect_list("flags"))), ",")
    web = http.groupBy("client").agg(F.count(F.lit(1)).alias("requests"), F.array_join(F.array_sort(F.collect_set("user_agent")), ",").alias("user_agents"), flags.alias("flags"))
    both = dns.join(web, "client", "full")
    protocols = F.concat_ws(",", F.when(F.col("queries").isNotNull(), "DNS"), F.when(F.col("requests").isNotNull(), "HTTP"))
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("domains", "suspicious", "user_agents", "flags")]
    return both.select("client", protocols.alias("protocols"), F.coalesce("queries", F.lit(0)).alias("queries"), F.coalesce("requests", F.lit(0)).alias("requests"), *texts)


def insights(events: DataFrame) -> DataFrame:
    """Totals."""
    return dns_rows(events).agg(F.count(F.lit(1)).alias("queries"), F.count_distinct("domain").alias("domains"), F.count_distinct(F.when(F.col("bad"), F.col("domain"))).alias("bad_domains"), F.count_distinct("client").alias("clients"))


def agent_devices(http: DataFrame) -> DataFrame:
    """Requests by the device that their agent names; agents that name none are left out."""
    agent = F.lower("user_agent")
    kind = F.when(agent.contains("android"), "Android").when(agent.contains("iphone") | agent.contains("ipad"), "iOS").when(agent.contains("windows"), "Windows").when(agent.contains("linux"), "Linux")
    return http.select(kind.alias("device")).where("device is not null").groupBy("device").agg(F.count(F.lit(1)).alias("n"))


def dhcp(payload: Column) -> Column:
    """A DHCP message (binary) as message, client, requested and server address, hostname, vendor class and lease; null for anything else.

    Options are read one after another: code, length, value; 0 fills and 255 ends.
    """
    # bound once as an element of a list: a column inside a lambda is worked out anew wherever it is named
    return F.element_at(F.transform(F.array(F.lower(F.hex(payload))), _dhcp_text), 1)


def _dhcp_text(text: Column) -> Column:
    """``dhcp`` of the message's hex digits."""
    entry = "struct<at:bigint,found:array<struct<code:bigint,value:string>>>"
    empty = F.array().cast("array<struct<code:bigint,value:string>>")

    def options(tail: Column) -> Column:
        number = lambda at: F.conv(F.substr(tail, at, F.lit(2)), 16, 10).cast("bigint")

        def step(state: Column, _: Column) -> Column:
            at = state["at"]
            code, size = number(at), F.coalesce(number(at + 2), F.lit(0))
            more = F.array_append(state["found"], F.struct(code.alias("code"), F.substr(tail, at + 4, size * 2).alias("value")))
            return (
                F.when((at > F.length(tail)) | (code == 255), F.struct(F.length(tail).cast("bigint") + 1, state["found"]).cast(entry))
                .when(code == 0, F.struct(at + 2, state["found"]).cast(entry)).otherwise(F.struct(at + 4 + size * 2, more).cast(entry))
            )

        places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(tail) / 2).cast("int"))
        return F.aggregate(places, F.struct(F.lit(1).cast("bigint"), empty).cast(entry), step)["found"]

    def read(found: Column) -> Column:
        option = lambda k: F.try_element_at(F.filter(found, lambda o: o["code"] == k), F.lit(1))["value"]
        words = lambda k: F.nullif(F.decode(F.unhex(option(k)), "utf-8"), F.lit(""))
        address = lambda at: F.concat_ws(".", *[F.conv(F.substr(text, F.lit(2 * (at + i) + 1), F.lit(2)), 16, 10) for i in range(4)])
        mac = F.concat_ws(":", *[F.substr(text, F.lit(2 * (28 + i) + 1), F.lit(2)) for i in range(6)])
        return F.struct(
            dhcp_type(F.coalesce(F.conv(option(53), 16, 10).cast("int"), F.lit(0))).alias("message"), mac.alias("client"), address(16).alias("requested_ip"), address(20).alias("server_ip"),
            words(12).alias("hostname"), words(60).alias("vendor_class"), F.conv(option(51), 16, 10).cast("bigint").alias("lease"),
        )

    tails = F.array(F.substr(text, F.lit(240 * 2 + 1), F.length(text)))
    message = F.element_at(F.transform(F.transform(tails, options), read), 1)
    return F.when((F.length(text) >= 240 * 2) & (F.substr(text, F.lit(236 * 2 + 1), F.lit(8)) == "63825363"), message)


def top_queries(events: DataFrame, top: int = 5) -> DataFrame:
    """I8: each client's most frequent domains."""
    n = dns_rows(events).groupBy("client", "domain").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("client").orderBy(F.col("n").desc(), "domain"))
    return n.withColumn("place", place).where(F.col("place") <= top)
