"""Operator 5: WARC archives as a chunked record table.

Archives are files of gzip members, one record each (WARC/1.1, records framed by
Content-Length).  Writers and readers stream: a payload travels as rows
(record_id, chunk_no, data) of bounded size, each row carrying the SHA-256 of the
payload so far, so no record is ever held whole on the read side.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.llm.common import small_batches, table
from aerolake.runtime import broadcastable, fresh_path, materialize

#: Bytes of a chunk row; payloads below MIN_REVISIT bytes are never revisits.
CHUNK, MIN_REVISIT = 1 << 20, 100
#: Tasks that read archives at most; beyond, a task reads several files one after another.
READERS = 50_000
#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_uri(page_id) -> str:
    """The record's identifier; the same page always gets the same."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _filesystem(uri: str):
    """(opener for reading, opener for writing, mover, folder maker) of a shared folder."""
    if "://" not in uri or uri.startswith("file:"):
        path = uri.removeprefix("file://").removeprefix("file:")
        return path, lambda p: open(p, "rb"), lambda p: open(p, "wb"), os.replace, lambda p: os.makedirs(p, exist_ok=True)
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return path, system.open_input_stream, system.open_output_stream, system.move, lambda p: system.create_dir(p, recursive=True)


def choose_originals(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html, payload_bytes, digest, refers_to (null for responses).

    Of payloads equal under SHA-256 and length, of at least ``min_bytes`` bytes,
    the smallest page_id is the response.  Null html is an empty payload.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.octet_length(payload).cast("bigint").alias("payload_bytes"), F.sha2(payload, 256).alias("digest"))
    firsts = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first_id")
    firsts = F.broadcast(firsts) if broadcastable(firsts, 80) else firsts
    return rows.join(firsts, "digest", "left").withColumn("refers_to", F.when(F.col("page_id") != F.col("first_id"), F.col("first_id"))).drop("first_id")


def _header(fields: list[tuple[str, object]]) -> bytes:
    clean = lambda v: str(v).replace("\r", "%0D").replace("\n", "%0A")
    return VERSION + b"\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in fields if v is not None).encode() + b"\r\n"


def write_archives(rows: DataFrame, folder: str, most_bytes: int = 1 << 30, level: int = 1) -> DataFrame:
    """Write a record per row of ``choose_originals``; returns (path, records) of the archives that committed tasks made.

    Each attempt writes files of its own and renames them when whole, so a lost or
    doubled attempt leaves no broken archive; only reported paths count.
    """

    def of_batches(batches):
        root, _, create, move, make = _filesystem(folder)
        make(root)
        out = path = None
        n = size = 0

        def finish():
            out.close()
            move(path + ".open", path)
            return pa.RecordBatch.from_pydict({"path": [path], "records": [n]}, pa.schema([("path", pa.string()), ("records", pa.int64())]))

        for batch in batches:
            page, url, payload, length, digest, refers = (batch.column(k) for k in ("page_id", "url", "payload", "payload_bytes", "digest", "refers_to"))
            for k in range(batch.num_rows):
                if out is None:
                    path, n, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = create(path + ".open")
                to = refers[k].as_py()
                bytes_ = length[k].as_py()
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {bytes_}\r\n\r\n".encode()
                body = memoryview(payload[k].as_buffer()) if to is None and bytes_ else memoryview(b"")
                head = _header(
                    [
                        ("WARC-Type", "response" if to is None else "revisit"),
                        ("WARC-Record-ID", record_uri(page[k].as_py())),
                        ("WARC-Target-URI", url[k].as_py()),
                        ("WARC-Page-ID", page[k].as_py()),
                        ("WARC-Date", "1970-01-01T00:00:00Z"),
                        ("WARC-Payload-Digest", f"sha256:{digest[k].as_py()}"),
                        ("WARC-Refers-To", None if to is None else record_uri(to)),
                        ("WARC-Refers-To-Page-ID", to),
                        ("WARC-Profile", None if to is None else PROFILE),
                        ("Content-Type", "application/http; msgtype=response"),
                        ("Content-Length", len(http) + len(body)),
                    ]
                )
                gz = zlib.compressobj(level, wbits=31)
                for part in (head, http, *(body[i : i + CHUNK] for i in range(0, len(body), CHUNK)), b"\r\n\r\n"):
                    coded = gz.compress(part)
                    size += len(coded)
                    out.write(coded)
                size += out.write(gz.flush()) or 0
                n += 1
                if size >= most_bytes:
                    yield finish()
                    out = None
        if out is not None:
            yield finish()

    return rows.mapInArrow(of_batches, "path string, records long")


class _Members:
    """Bytes of a file of gzip members, decompressed in bounded pieces."""

    def __init__(self, file):
        self.file, self.raw, self.held, self.z = file, b"", b"", None

    def more(self) -> bool:
        """Hold some more bytes; False at the end."""
        while True:
            if not self.raw:
                self.raw = self.file.read(1 << 18)
                if not self.raw:
                    return False
            if self.z is None:
                self.z = zlib.decompressobj(wbits=31)
            got = self.z.decompress(self.raw, CHUNK)
            self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if self.z.eof:
                self.z = None
            if got:
                self.held += got
                return True

    def upto(self, mark: bytes) -> bytes | None:
        """What comes before the mark, which is passed; None at the end of the file."""
        while (at := self.held.find(mark)) < 0:
            if not self.more():
                if self.held.strip():
                    raise ValueError("archive is cut off inside a record")
                return None
        found, self.held = self.held[:at], self.held[at + len(mark) :]
        return found

    def take(self, most: int) -> bytes:
        """Some of the next ``most`` bytes, at least one."""
        if not self.held and not self.more():
            raise ValueError("archive is cut off inside a record")
        found, self.held = self.held[:most], self.held[most:]
        return found


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8").split("\r\n")[1:])}


def read_chunks(archives: DataFrame, folder: str, with_data: bool = True) -> DataFrame:
    """The chunked record table of archives (path): a row per chunk, and one for an empty payload.

    record_id, chunk_no, data, digest_so_far (SHA-256 of the payload up to here),
    last, bytes_so_far, page_id, url, record_type, header_digest, header_bytes,
    refers_to.  with_data=False leaves data null.
    """
    schema = pa.schema([("record_id", pa.string()), ("chunk_no", pa.int32()), ("data", pa.binary()), ("digest_so_far", pa.string()), ("last", pa.bool_()), ("bytes_so_far", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("header_digest", pa.string()), ("header_bytes", pa.int64()), ("refers_to", pa.int64())])

    def records(stream):
        while (head := stream.upto(b"\r\n\r\n")) is not None:
            field = _fields(head.lstrip(b"\r\n"))
            left = int(field["content-length"])
            http = _fields(block := stream.upto(b"\r\n\r\n"))
            left -= len(block) + 4
            number = lambda k, f=field: int(f[k]) if k in f else None
            rest = (number("warc-page-id"), field.get("warc-target-uri"), field["warc-type"], field["warc-payload-digest"].removeprefix("sha256:"), int(http["content-length"]), number("warc-refers-to-page-id"))
            so_far, chunk, done = hashlib.sha256(), 0, 0
            while True:
                room, parts = min(left, CHUNK), []
                while room:
                    parts.append(stream.take(room))
                    room -= len(parts[-1])
                data = b"".join(parts)
                left -= len(data)
                done += len(data)
                so_far.update(data)
                yield (field["warc-record-id"], chunk, data if with_data else None, so_far.hexdigest(), not left, done, *rest)
                chunk += 1
                if not left:
                    break
            if stream.upto(b"\r\n\r\n") != b"":
                raise ValueError("a record's length is wrong")

    def of_batches(batches):
        _, opened, *_ = _filesystem(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with opened(path) as file:
                    rows, held = [], 0
                    for row in records(_Members(file)):
                        rows.append(row)
                        held += len(row[2] or b"") + 200
                        if held > 4 * CHUNK:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    kinds = "record_id string, chunk_no int, data binary, digest_so_far string, last boolean, bytes_so_far long, page_id long, url string, record_type string, header_digest string, header_bytes long, refers_to long"
    # A file is a task's worth.  A stated number of partitions stays as it is, whereas small ones dealt by a key would be joined into one task.
    paths = archives.select("path")
    return paths.repartition(max(1, min(paths.count(), READERS))).mapInArrow(of_batches, kinds)


def round_trip(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Write pages (page_id, url, html, any others) as WARC records in the shared folder and read them back.

    One row per page: page_id, payload_bytes, payload_digest, record_type,
    refers_to, url.  Null html is an empty payload, always a response; repeated rows
    give repeated records, all of which are responses if the id is the smallest.  A
    null page_id stays null and never is the one referred to unless alone; a null
    url leaves the field out.  Extra columns are ignored; an empty table gives an
    empty result.  A response's length and digest are those of the bytes read; a
    revisit's are those its record states, which hold for the response it names.
    """
    spark = pages.sparkSession
    small_batches(spark, 200)
    folder = fresh_path(spark, "warc")
    written = materialize(write_archives(choose_originals(pages, min_bytes), folder), "warc-list")  # writing ends here
    ends = read_chunks(written, folder, with_data=False).where("last")
    response = F.col("record_type") == "response"
    return ends.select(
        "page_id",
        F.when(response, F.col("bytes_so_far")).otherwise(F.col("header_bytes")).alias("payload_bytes"),
        F.when(response, F.col("digest_so_far")).otherwise(F.col("header_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
        "url",
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over all pages."""
    return round_trip(table(spark, sf_dir, "pages"))


ORACLE = """
with p as (
  select page_id, url, coalesce(html, '') as h, octet_length(encode(coalesce(html, ''))) as payload_bytes from pages),
q as (select *, sha256(h) as payload_digest, min(page_id) over (partition by h) as first_id from p)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
       case when payload_bytes >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id <> first_id then first_id end as refers_to,
       url
from q"""
