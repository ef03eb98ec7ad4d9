"""WARC archives: one gzip member per record, written and read back sequentially.

write() makes archives (rows of about ARCHIVE_BYTES) from pages; read() goes through each with incremental
zlib decompression, frames records by content length and verifies block and payload digests. Pages whose
payload a smaller page_id has too become revisit records without the payload.

Cases: a null payload is empty; a null url is written as urn:page:<id>; of repeated rows with the smallest
page_id all are responses; a null page_id counts as larger than any, and revisits a response only if one has
an id; a damaged archive raises WarcError. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import cut, lean, ship, small_ids

ARCHIVE_BYTES, CHUNK = 1 << 20, 1 << 16
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


class WarcError(ValueError):
    pass


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += payload if refers_to is None else b""
    uri = "".join((url or f"urn:page:{page_id}").split()) or f"urn:page:{page_id}"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", f"X-Page-ID: {'' if page_id is None else page_id}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n") + packer.flush()


def members(archive: bytes) -> Iterator[bytes]:
    """The contents of each gzip member, decompressed CHUNK by CHUNK."""
    at, held = 0, b""
    while at < len(archive) or held:
        unzip, out = zlib.decompressobj(31), []
        while not unzip.eof:
            if not held:
                held, at = archive[at : at + CHUNK], at + CHUNK
                if not held:
                    raise WarcError("a member is cut short")
            try:
                out.append(unzip.decompress(held))
            except zlib.error as e:
                raise WarcError(str(e)) from e
            held = unzip.unused_data
        yield b"".join(out)


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers (lower-case names), HTTP header, HTTP body of a record; digests of what is there are verified."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError("no record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    block = rest[:n]
    if len(block) < n or rest[n:] != b"\r\n\r\n":
        raise WarcError("content length and record differ")
    if fields.get("warc-block-digest", "sha1:" + digest(block)) != "sha1:" + digest(block):
        raise WarcError("block digest")
    http, _, body = block.partition(b"\r\n\r\n")
    if fields["warc-type"] == "response" and fields["warc-payload-digest"] != "sha1:" + digest(body):
        raise WarcError("payload digest")
    return fields, http, body


def read_archive(archive: bytes) -> Iterator[tuple]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload or None) of each record."""
    for raw in members(archive):
        fields, http, body = parse(raw)
        length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        kind, page, refers = fields["warc-type"], fields["x-page-id"], fields.get("x-refers-to-page")
        if kind == "response" and length != len(body):
            raise WarcError("payload length")
        yield int(page) if page else None, length, fields["warc-payload-digest"].removeprefix("sha1:"), kind, int(refers) if refers else None, body if kind == "response" else None


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, sha1, refers_to) of the pages (page_id, data) whose payload has a smaller page_id: ids and hashes are shuffled, payloads aren't."""
    marked = pages.select("page_id", F.sha1("data").alias("sha1"))
    firsts = marked.groupBy("sha1").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 AND refers_to IS NOT NULL").drop("n")
    return marked.join(firsts, "sha1").where("page_id IS NULL OR page_id > refers_to").select("page_id", "sha1", "refers_to").distinct()


def write(df: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """(archive binary): gzip members one after another, about ARCHIVE_BYTES in a row; a larger record has a row of its own."""
    pages = df.select(F.col(f"`{key}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit("")).cast("binary").alias("data"))
    again = cut(revisits(pages), "warc-revisits")
    again = again.withColumnsRenamed({"page_id": "again_id", "sha1": "again_sha1"})
    on = F.col("page_id").eqNullSafe(F.col("again_id")) & (F.sha1("data") == F.col("again_sha1"))
    rows = pages.join(F.broadcast(again) if small_ids(again) else again, on, "left").select("page_id", "url", "data", "refers_to")

    def pack(batches):
        held, n = [], 0
        for b in batches:
            for i in range(b.num_rows):
                held.append(record(*(b.column(k)[i].as_py() for k in range(4))))
                n += len(held[-1])
                if n >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["archive"])
                    held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["archive"])

    ship(df.sparkSession)
    return rows.mapInArrow(lean(pack), "archive binary")


def read(archives: DataFrame) -> DataFrame:
    """The records of archives (column archive), without payloads."""

    def unpack(batches):
        for b in batches:
            for i in range(b.num_rows):
                cols = list(zip(*(r[:5] for r in read_archive(b.column(0)[i].as_py())), strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    ship(archives.sparkSession)
    return archives.select("archive").mapInArrow(lean(unpack), RECORDS)


def round_trip(df: DataFrame) -> DataFrame:
    """Write pages to archives in the shared folder and read their records back."""
    return read(cut(write(df), "warc"))
