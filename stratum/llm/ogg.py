"""Media columns in Ogg: page checksums, lacing values, demultiplexed logical streams, granule positions.

A text becomes the physical stream of two multiplexed logical streams: 8-bit samples (one packet for each
576) and a note (one packet: the count of bytes before padding). Reading verifies every page's checksum and
sequence number, joins packets from lacing values, parts the streams by serial number, and takes times from
granule positions (SAMPLE_RATE samples a second).

Cases: a null or empty text is stored as 576 bytes of 255; equal texts give equal streams; long texts span
pages; a damaged stream raises OggError. Extra columns are ignored; repeated rows and rows with a null id each give
a row; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import keyed_bytes, per_document

BLOCK, SAMPLE_RATE = 576, 48_000
SAMPLES, NOTE = 0x53414D50, 0x4E4F5445  # serial numbers of the two logical streams
CONTINUED, FIRST, LAST = 1, 2, 4
HEADER = struct.Struct("<4sBBqIIIB")
REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class OggError(ValueError):
    pass


def page_crc(data: bytes) -> int:
    """The container's checksum (polynomial 04c11db7, most significant bit first, no inversion), from zlib's mirrored one."""
    mirrored = zlib.crc32(data.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{mirrored:032b}"[::-1], 2)


class Writer:
    """Pages of one logical stream: packets are laced until a page has 255 lacing values."""

    def __init__(self, serial: int):
        self.serial, self.seq, self.granule = serial, 0, -1
        self.lacing, self.body, self.open, self.first = bytearray(), [], False, True

    def packet(self, data: bytes, granule: int, flush: bool = False) -> list[bytes]:
        out, values = [], bytes([255]) * (len(data) // 255) + bytes([len(data) % 255])
        done = 0
        while values:
            room = 255 - len(self.lacing)
            if not room:
                out.append(self.page())
                continue
            part, values = values[:room], values[room:]
            n = sum(part) if part[-1] < 255 else 255 * len(part)
            self.lacing += part
            self.body.append(data[done : done + n])
            done += n
            if values:  # the packet goes on in the next page
                out.append(self.page(continues=True))
            else:
                self.granule = granule
        if flush:
            out.append(self.page())
        return out

    def page(self, continues: bool = False, last: bool = False) -> bytes:
        kind = CONTINUED * self.open | FIRST * self.first | LAST * last
        head = HEADER.pack(b"OggS", 0, kind, self.granule, self.serial, self.seq, 0, len(self.lacing)) + self.lacing
        raw = b"".join([head, *self.body])
        crc = page_crc(raw)
        self.seq, self.first, self.open, self.granule = self.seq + 1, False, continues, -1
        self.lacing, self.body = bytearray(), []
        return raw[:22] + struct.pack("<I", crc) + raw[26:]


def write(data: bytes) -> bytes:
    """data, padded with 255 to a positive multiple of BLOCK, as a multiplexed Ogg stream."""
    payload = data + b"\xff" * (-len(data) % BLOCK if data else BLOCK)
    sound, note = Writer(SAMPLES), Writer(NOTE)
    pages = sound.packet(struct.pack("<8sIBB", b"PCM8\0\0\0\0", SAMPLE_RATE, 1, 8), 0, flush=True)
    pages += note.packet(struct.pack("<8s", b"NOTE\0\0\0\0"), 0, flush=True)
    for at in range(0, len(payload), BLOCK):
        pages += sound.packet(payload[at : at + BLOCK], at + BLOCK)
    note.packet(struct.pack("<Q", len(data)), 1)
    return b"".join([*pages, note.page(last=True), sound.page(last=True)])


def read(stream: bytes) -> dict[int, list[tuple[bytes, int]]]:
    """Packets of each logical stream as (bytes, granule position of the page it ends in, or -1 if another packet ends that page)."""
    out: dict[int, list] = {}
    parts: dict[int, list[bytes]] = {}
    expected: dict[int, int] = {}
    ended: set[int] = set()
    at = 0
    while at < len(stream):
        if len(stream) - at < 27:
            raise OggError("a page is cut short")
        mark, version, kind, granule, serial, seq, crc, n = HEADER.unpack_from(stream, at)
        if mark != b"OggS" or version:
            raise OggError(f"no page at {at}")
        lacing = stream[at + 27 : at + 27 + n]
        body = at + 27 + n
        end = body + sum(lacing)
        if len(lacing) < n or end > len(stream):
            raise OggError("a page is cut short")
        if page_crc(b"".join([stream[at : at + 22], b"\0\0\0\0", stream[at + 26 : end]])) != crc:
            raise OggError(f"checksum of the page at {at}")
        if (serial in expected) == bool(kind & FIRST) or expected.get(serial, 0) != seq or serial in ended:
            raise OggError(f"stream {serial:#x} lacks a page before {seq}")
        held = parts.setdefault(serial, [])
        if bool(held) != bool(kind & CONTINUED):
            raise OggError(f"stream {serial:#x} breaks a packet")
        packets, whole = out.setdefault(serial, []), []
        run = 0
        for value in lacing:
            run += value
            if value < 255:
                held.append(stream[body : body + run])
                whole.append(b"".join(held))
                held.clear()
                body, run = body + run, 0
        if run:
            held.append(stream[body : body + run])
        packets += [(p, granule if i == len(whole) - 1 else -1) for i, p in enumerate(whole)]
        expected[serial] = seq + 1
        if kind & LAST:
            ended.add(serial)
        at = end
    if ended != set(out) or any(parts.values()):
        raise OggError("a stream has no end")
    return out


def timestamps(packets: list[tuple[bytes, int]]) -> list[float]:
    """End time of each data packet in seconds, from granule positions: a packet that ends a page ends at the page's granule, those before it in the page earlier by the samples behind them. A stream may start at any granule; from page to page granules must advance by the samples between."""
    out: list[float] = []
    last, behind = None, 0
    for data, granule in reversed(packets):
        if granule >= 0:
            if last is not None and last - behind != granule:
                raise OggError(f"granule position {granule} where samples begin at {last - behind}")
            last, behind = granule, 0
        elif last is None:
            raise OggError("the last packet has no granule position")
        if last < behind + len(data):
            raise OggError("samples before the position 0")
        out.append((last - behind) / SAMPLE_RATE)
        behind += len(data)
    return out[::-1]


def decode(stream: bytes) -> tuple[bytes, int, list[float]]:
    """The payload, the count of bytes before padding, and the packets' end times."""
    streams = read(stream)
    sound, note = streams[SAMPLES], streams[NOTE]
    mark, rate, channels, bits = struct.unpack("<8sIBB", sound[0][0])
    if (mark[:4], rate, channels, bits) != (b"PCM8", SAMPLE_RATE, 1, 8):
        raise OggError("unknown samples")
    times = timestamps(sound[1:])
    return b"".join(p for p, _ in sound[1:]), struct.unpack("<Q", note[1][0])[0], times


def features(payload: bytes, times: list[float], pages: int) -> str:
    """Packets, pages, seconds, mean, root mean square about 128, and sign changes about 128."""
    x = np.frombuffer(payload, np.uint8).astype(np.int16) - 128
    turns = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    total, power = int(x.sum(dtype=np.int64)), int((x.astype(np.int32) ** 2).sum(dtype=np.int64))
    return f"packets={len(times)};pages={pages};seconds={times[-1]:.6f};mean={total / len(x):.6f};rms={(power / len(x)) ** 0.5:.6f};turns={turns}"


def store(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, media binary): the column of Ogg streams."""
    return per_document(keyed_bytes(df, key, text), lambda: lambda data: (write(data),), "media binary")


def described(stream: bytes) -> tuple:
    payload, n, times = decode(stream)
    return n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stream), hashlib.sha256(stream).hexdigest(), features(payload, times, stream.count(b"OggS\0"))


def describe(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """What store() stored, read back: a row for each (doc_id, media) row."""
    return per_document(df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{media}`").alias("data")), lambda: described, "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store each text as a column of streams, read that column back and describe it. The streams are not carried on; store() gives them."""
    return describe(store(df, key, text))
