"""What a DHCP message costs to read."""

import time

import duckdb
from pyspark.sql import functions as F

from aerolake import registry
from aerolake.operators import dpi


def test_messages_are_read_once(spark):
    """Long messages in good time: their text is not worked out anew for every option, nor for every field."""
    head = "0201060000000000" + "00" * 8 + "0a000102" + "0a000001" + "00" * 4 + "a851ab000102" + "00" * 202 + "63825363"
    options = "350103" + "00" * 200 + "".join(f"e102{i:04x}" for i in range(200)) + "0c0361626333040000000eff0000"
    message = F.unhex(F.concat(F.lit(head + options), F.lpad(F.hex("id"), 4, "0")))
    rows = spark.range(1000).select("id", F.inline(F.array(dpi.dhcp(message))))
    began = time.time()
    got = rows.groupBy("message", "client", "requested_ip", "server_ip", "hostname", "vendor_class", "lease").count().collect()
    took = time.time() - began
    assert [tuple(r)[1:] for r in got] == [("a8:51:ab:00:01:02", "10.0.1.2", "10.0.0.1", "abc", None, 14, 1000)]
    assert took < 60


def test_no_message(spark):
    for payload in ("", "00" * 239, "00" * 240, None):
        assert spark.range(1).select(dpi.dhcp(F.unhex(F.lit(payload))).alias("d")).first()["d"] is None


def test_users_of_any_number(spark, tiny, tmp_path):
    """Users whose address has more than six bytes come out as their SQL twin has them."""
    path, name = f"{tmp_path}/events.parquet", "I5_dhcp_messages"
    duckdb.sql(f"copy (select event_id, ts, user_id + 64000 + event_id * 1000 as user_id, event_type, value, props from '{tiny}/events.parquet') to '{path}' (format parquet)")
    db = duckdb.connect()
    db.sql(f"create view events as from '{path}'")
    want = db.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))
