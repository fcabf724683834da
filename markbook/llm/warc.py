"""WARC archives: one gzip member per record, written and read back by streams."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markbook.llm.common import bits_table, buckets_for, filesystem, maybe_in, settled, work_dir

#: an archive is closed once it has so many bytes
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 18
DATE = "2000-01-01T00:00:00Z"
# fixed values of the format
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
IDENTITY = "urn:page:"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# --- one record ----------------------------------------------------------------------------------------------
def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member with one record: a response, or a revisit of ``refers_to`` that has the HTTP header only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if refers_to is None else head
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{IDENTITY}{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", " ".join((url or "").split())),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
    ]
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{IDENTITY}{refers_to}>"), ("WARC-Profile", PROFILE)]
    fields.append(("Content-Length", str(len(block))))
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in fields if v)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


class Damaged(ValueError):
    """An archive that breaks the format or a digest."""


def _fields(lines: bytes) -> dict[str, str]:
    pairs = (line.decode("utf-8", "replace").partition(":") for line in lines.split(b"\r\n") if line)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


class RecordReader:
    """Takes decompressed bytes of one member as they come; frames the block by Content-Length and digests it on the way."""

    def __init__(self) -> None:
        self.buffer, self.header, self.left = bytearray(), None, -1
        self.block, self.digest = bytearray(), hashlib.sha1()

    def feed(self, data: bytes) -> None:
        self.buffer += data
        if self.header is None:
            end = self.buffer.find(b"\r\n\r\n")
            if end < 0:
                return
            version, _, lines = bytes(self.buffer[:end]).partition(b"\r\n")
            if not version.startswith(b"WARC/"):
                raise Damaged("no WARC header")
            self.header = _fields(lines)
            if not self.header.get("content-length", "").isdigit():
                raise Damaged("no Content-Length")
            self.left = int(self.header["content-length"])
            del self.buffer[: end + 4]
        if self.left:
            part = bytes(self.buffer[: self.left])
            self.digest.update(part)
            self.block += part
            self.left -= len(part)
            del self.buffer[: len(part)]

    def close(self) -> dict:
        if self.header is None or self.left or bytes(self.buffer) != b"\r\n\r\n":
            raise Damaged("the member ends inside its record")
        found = base64.b32encode(self.digest.digest()).decode()
        if self.header.get("warc-block-digest", f"sha1:{found}") != f"sha1:{found}":
            raise Damaged("the block digest differs")
        head, _, payload = bytes(self.block).partition(b"\r\n\r\n")
        http = _fields(head.partition(b"\r\n")[2])
        digest = self.header.get("warc-payload-digest", "").removeprefix("sha1:")
        kind = self.header.get("warc-type")
        if kind == "response" and (digest != base32_sha1(payload) or http.get("content-length") != str(len(payload))):
            raise Damaged("the payload digest or length differs")
        number = lambda name: self.header.get(name, "").removeprefix(f"<{IDENTITY}").removesuffix(">")
        return {
            "page_id": int(number("warc-record-id")) if number("warc-record-id") else None,
            "url": self.header.get("warc-target-uri"),
            "record_type": kind,
            "refers_to": int(number("warc-refers-to")) if number("warc-refers-to") else None,
            "payload": payload if kind == "response" else None,
            "payload_bytes": int(http.get("content-length", 0)),
            "payload_digest": digest,
        }


def read_records(stream, chunk: int = CHUNK) -> Iterator[dict]:
    """Records of one archive in order. Memory holds one record and one chunk, whatever the size of the archive."""
    member, reader, pending = zlib.decompressobj(31), RecordReader(), b""
    begun = False
    while data := pending or stream.read(chunk):
        pending, begun = b"", True
        try:
            while True:  # output may be left after the input is used up
                out = member.decompress(data, 4 * chunk)
                reader.feed(out)
                data = member.unconsumed_tail
                if member.eof or (not data and len(out) < 4 * chunk):
                    break
        except zlib.error as error:
            raise Damaged(str(error)) from error
        if member.eof:
            yield reader.close()
            pending, begun = member.unused_data, False
            member, reader = zlib.decompressobj(31), RecordReader()
    if begun:
        raise Damaged("the archive ends inside a member")


# --- archives ------------------------------------------------------------------------------------------------
RECORD = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"
ARROW = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
     ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
)


def with_references(pages: DataFrame, least: int = 0, most_bits: int = 1 << 26) -> DataFrame:
    """(page_id, url, payload, refers_to): of equal payloads of ``least`` bytes or more the largest page_id has no reference.

    Digests are grouped in a narrow table. Pages that refer to none, nearly all, pass straight from the scan to their
    archive; those that a bounded bit table knows meet the list of references in a shuffle.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), html.alias("payload"))
    digests = settled(
        rows.select("page_id", F.sha1("payload").alias("_d"), F.length("payload").alias("_n")), "warc-digests"
    )
    large = digests.where(F.col("_n") >= least)
    kept = settled(large.groupBy("_d").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("_c")), "warc-kept")
    again = large.join(kept.where("_c > 1 and refers_to is not null"), "_d")
    revisits = settled(
        again.where("page_id is null or page_id <> refers_to").select(F.col("page_id").alias("_id"), "_d", "refers_to").distinct(),
        "warc-revisits",
    )
    buckets = buckets_for(revisits.count(), most_bits)
    bits = settled(bits_table(revisits, "_id", buckets), "warc-bits")
    marked = maybe_in(rows, F.col("page_id"), bits, buckets)
    straight = marked.where(~F.col("_maybe")).select("page_id", "url", "payload", F.lit(None).cast("bigint").alias("refers_to"))
    checked = marked.where("_maybe").withColumn("_d", F.sha1("payload")).alias("m").join(
        revisits.alias("r"), (F.col("m._d") == F.col("r._d")) & F.col("m.page_id").eqNullSafe(F.col("r._id")), "left"
    )
    return straight.unionByName(checked.select("m.page_id", "m.url", "m.payload", "r.refers_to"))


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write (page_id, url, payload, refers_to) below ``folder``; a settled table of (path, records, bytes) names the files.

    Each task streams its rows into archives of its own, named anew in every attempt. Only archives in the table count, so
    what a lost or repeated task leaves behind is never read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)
        out, name, count, size = None, "", 0, 0

        def named() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pylist([{"path": name, "records": count, "bytes": size}])

        for batch in batches:
            for page, url, payload, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, count, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(name, compression=None)
                data = record(page, url, payload, refers)
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= archive_bytes:
                    yield named()
                    out = None
        if out is not None:
            yield named()

    rows = records.select("page_id", "url", "payload", "refers_to")
    return settled(rows.mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """All records of the archives in ``manifest``, payloads of responses included. A damaged archive fails with its path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    try:
                        for row in read_records(stream):
                            rows.append(row)
                            size += len(row["payload"] or b"")
                            if size > 8_000_000 or len(rows) >= 5000:
                                yield pa.RecordBatch.from_pylist(rows, ARROW)
                                rows, size = [], 0
                    except Damaged as error:
                        raise Damaged(f"{path}: {error}") from error
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)

    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(tasks).mapInArrow(run, RECORD)


def archived(pages: DataFrame) -> DataFrame:
    """Pages written to archives in the shared folder and read back: one row per page.

    page_id, url, record_type, refers_to, payload (responses), payload_bytes, payload_digest (both of the full payload).

    A null html is an empty payload; empty payloads are equal like others. Null or many-line urls are written as the format
    allows (left out, joined by spaces). Rows that repeat a page_id and its html are one page: they have the same type. Rows
    without page_id are read back without one and revisit any equal page that has one. Payloads of any length are one record
    each. No pages give no archives and no rows. Other columns are not read.
    """
    folder = work_dir(pages.sparkSession, "warc")
    return read_archives(write_archives(with_references(pages), folder), folder)


# the digest in base 32, five bits a letter, from its hexadecimal form
WARC_SQL = """
with p as (select page_id, coalesce(html, '') as payload from pages),
h as (select page_id, octet_length(encode(payload)) as n, sha1(payload) as d from p)
select page_id, n::bigint as payload_bytes,
       array_to_string([
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                ((('0x' || substr(d, (5 * (i // 4) + 1)::int, 5))::int >> (15 - 5 * (i % 4))::int) & 31) + 1, 1)
         for i in range(32)], '') as payload_digest,
       case when page_id = max(page_id) over w then 'response' else 'revisit' end as record_type,
       case when page_id <> max(page_id) over w then max(page_id) over w end as refers_to
from h window w as (partition by d)"""
