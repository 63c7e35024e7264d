"""Ogg media columns: pages with checksums, lacing, logical streams and granule positions.

`to_ogg` turns a text column into an Ogg file per row (two logical streams of 8-bit samples,
one channel each, frames dealt in turn). `read_ogg` verifies every page's checksum, reassembles
packets from lacing values across pages, demultiplexes the streams by serial number and derives
the times of pages and packets from granule positions, each of which must agree with the samples that have ended there.

Cases: a null or empty text is one frame of padding; a page that fails its checksum, a gap in page
numbers or a missing capture pattern raises OggError; equal texts give equal files.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME = 576
RATE = 8000
PAD = 255
_HEAD = struct.Struct("<4sBBqIIIB")
_CODEC = struct.Struct("<8sBBHIQ")
_MAGIC = b"\x80pcm-u8\x00"
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
CONTINUED, FIRST, LAST = 1, 2, 4


class OggError(ValueError):
    """The bytes are no sound Ogg file."""


def checksum(page: bytes) -> int:
    """Ogg's CRC (polynomial 04c11db7, most significant bit first, from 0), by zlib's mirrored one."""
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "big").translate(_REVERSED), "little")


def _page(body: bytes, lacing: bytes, flags: int, granule: int, serial: int, number: int) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing))
    crc = checksum(head + lacing + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + lacing + body


def lace(length: int) -> bytes:
    """The lacing values of a packet."""
    return b"\xff" * (length // 255) + bytes([length % 255])


def write_stream(packets: list[bytes], granules: list[int], serial: int) -> list[tuple[int, bytes]]:
    """(granule, page) of a logical stream: the first packet has the first page, others fill pages of 255 lacing values, and run over."""
    pages = [(0, _page(packets[0], lace(len(packets[0])), FIRST | (LAST if len(packets) == 1 else 0), 0, serial, 0))]
    values = b"".join(lace(len(p)) for p in packets[1:])
    if not values:
        return pages
    body = b"".join(packets[1:])
    v = np.frombuffer(values, np.uint8)
    ends = np.cumsum(v, dtype=np.int64)
    done = np.cumsum(v < 255)
    at = 0
    for k in range(0, len(v), 255):
        stop = min(k + 255, len(v))
        had = int(done[k - 1]) if k else 0
        flags = (CONTINUED if k and v[k - 1] == 255 else 0) | (LAST if stop == len(v) else 0)
        granule = granules[int(done[stop - 1])] if done[stop - 1] > had else -1
        pages.append((granule, _page(body[at : ends[stop - 1]], values[k:stop], flags, granule, serial, len(pages))))
        at = int(ends[stop - 1])
    return pages


def padded(data: bytes) -> bytes:
    return data + bytes([PAD]) * (-len(data) % FRAME if data else FRAME)


def encode(data: bytes) -> bytes:
    """The Ogg file of some bytes: padded to whole frames, which two streams take in turn."""
    frames = np.frombuffer(padded(data), np.uint8).reshape(-1, FRAME)
    base = zlib.crc32(data)
    pages: list[tuple[int, int, bytes]] = []
    for c in (0, 1):
        own = frames[c::2].tobytes()
        packets = [_CODEC.pack(_MAGIC, c, 2, FRAME, RATE, len(data))] + [own[i : i + FRAME] for i in range(0, len(own), FRAME)]
        granules = [0] + [(2 * i + c + 1) * FRAME for i in range(len(packets) - 1)]
        pages += [(g if g >= 0 else granules[-1], c, p) for g, p in write_stream(packets, granules, (base + c) & 0xFFFFFFFF)]
    heads = [p for p in pages if p[0] == 0]
    rest = sorted((p for p in pages if p[0]), key=lambda p: p[0])
    return b"".join(p for _, _, p in heads + rest)


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)  # of pages that end a packet
    ends: list[int] = field(default_factory=list)  # packets complete at the end of each of these pages
    pages: int = 0
    ended: bool = False
    open: list[bytes] | None = None


def read(media: bytes) -> dict[int, Stream]:
    """The logical streams of an Ogg file by serial number, in order of appearance."""
    streams: dict[int, Stream] = {}
    at, n = 0, len(media)
    while at < n:
        if n - at < 27 or media[at : at + 4] != b"OggS":
            raise OggError(f"no page at byte {at}")
        _, version, flags, granule, serial, number, crc, count = _HEAD.unpack_from(media, at)
        lacing = media[at + 27 : at + 27 + count]
        size = 27 + count + sum(lacing)
        if version or len(lacing) < count or at + size > n:
            raise OggError(f"page at byte {at} is cut short or of another version")
        page = media[at : at + size]
        if checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            raise OggError(f"checksum of the page at byte {at}")
        if flags & FIRST:
            if serial in streams:
                raise OggError(f"stream {serial} begins twice")
            streams[serial] = Stream(serial)
        s = streams.get(serial)
        if s is None or s.ended or number != s.pages:
            raise OggError(f"page {number} of stream {serial} is out of order")
        if bool(flags & CONTINUED) != (s.open is not None):
            raise OggError(f"a packet of stream {serial} is broken")
        parts, pos, length, before = s.open or [], 27 + count, 0, len(s.packets)
        for v in lacing:
            length += v
            if v < 255:
                whole = page[pos : pos + length]
                s.packets.append(b"".join([*parts, whole]) if parts else whole)
                parts, pos, length = [], pos + length, 0
        s.open = [*parts, page[pos : pos + length]] if count and lacing[-1] == 255 else None
        if len(s.packets) > before:
            if granule < 0 or (s.granules and granule < s.granules[-1]):
                raise OggError(f"granule position of page {number} of stream {serial}")
            s.granules.append(granule)
            s.ends.append(len(s.packets))
        elif granule != -1:
            raise OggError(f"page {number} of stream {serial} ends no packet, but has a granule position")
        s.pages += 1
        s.ended = bool(flags & LAST)
        at += size
    if bad := [s.serial for s in streams.values() if s.open is not None or not s.ended]:
        raise OggError(f"streams without end: {bad}")
    return streams


@dataclass
class Decoded:
    payload: bytes
    n_bytes: int
    rate: int
    seconds: float
    pages: int
    streams: int
    times: list[tuple[int, int, float]]  # (stream, packets complete, seconds at the end) of each page that ends a packet


def packet_times(stream: Stream, channel: int, channels: int, frame: int, rate: int) -> list[float]:
    """Seconds at the end of each packet of frames, which channels take in turn: those that end a page by its granule position, which must agree, others by counting on from there."""
    out: list[float] = []
    for granule, end in zip(stream.granules, stream.ends, strict=True):
        place = ((end - 2) * channels + channel + 1) * frame if end > 1 else 0  # the first packet is the head, at 0
        if granule != place:
            raise OggError(f"granule position {granule} of stream {stream.serial} where {place} samples have ended")
        out += [(granule - (end - 1 - k) * channels * frame) / rate for k in range(len(out) + 1, end)]
    return out


def decode(media: bytes) -> Decoded:
    """The payload of a file made by encode(), its frames put together again from both streams."""
    streams = list(read(media).values())
    heads = [_CODEC.unpack(s.packets[0]) for s in streams]
    if not heads or any(h[0] != _MAGIC or h[2] != len(streams) for h in heads):
        raise OggError("another codec")
    frames: list[bytes] = [b""] * sum(len(s.packets) - 1 for s in streams)
    _, _, _, frame, rate, n_bytes = heads[0]
    times = []
    for h, s in zip(heads, streams, strict=True):
        frames[h[1] :: len(streams)] = s.packets[1:]
        ended = packet_times(s, h[1], len(streams), frame, rate)
        times += [(h[1], e - 1, ended[e - 2]) for e in s.ends if e > 1]
    last = max(s.granules[-1] for s in streams)
    payload = b"".join(frames)
    if last != len(payload) or len(payload) % frame:
        raise OggError("granule positions differ from the samples read")
    return Decoded(payload, n_bytes, rate, last / rate, sum(s.pages for s in streams), len(streams), times)


def features(d: Decoded) -> str:
    """Time, level and crossings of the sample mean level, from the samples read back."""
    x = np.frombuffer(d.payload, np.uint8)
    total = int(x.sum(dtype=np.int64))
    energy = int(np.dot(x.astype(np.float32), x.astype(np.float32))) if len(x) < 256 else int((np.bincount(x, minlength=256) * np.arange(256, dtype=np.int64) ** 2).sum())
    high = x >= 128
    crossings = int(np.count_nonzero(high[1:] != high[:-1]))
    return f"ms={round(d.seconds * 1000)};streams={d.streams};pages={d.pages};sum={total};energy={energy};peak={int(x.max())};crossings={crossings}"


def to_ogg(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, media): the Ogg file of each row's UTF-8 text. Other columns are left out, so their names can't clash."""
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                media = [encode((t or "").encode()) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(media, pa.binary())], names=["id", "media"])

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, media binary").withColumnRenamed("id", id_col)


def read_ogg(df: DataFrame, id_col: str, media_col: str = "media") -> DataFrame:
    """(id, n_bytes, payload, media_bytes, media_sha256, seconds, page_ends, feature) of each Ogg file; raises on an unsound one.

    page_ends: (stream, packets, seconds) of each page that ends a packet: frames read of its stream so far, and the time they end.
    """
    src = df.select(F.col(id_col).alias("id"), F.col(media_col).alias("m"))
    kind = src.schema["id"].dataType.simpleString()
    ends = pa.list_(pa.struct([("stream", pa.int32()), ("packets", pa.int32()), ("seconds", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                media = part.column(1).to_pylist()
                got = [decode(m) for m in media]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([d.n_bytes for d in got], pa.int64()), pa.array([d.payload for d in got], pa.binary()), pa.array([len(m) for m in media], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media]), pa.array([d.seconds for d in got], pa.float64()), pa.array([[dict(zip(("stream", "packets", "seconds"), t, strict=True)) for t in d.times] for d in got], ends), pa.array([features(d) for d in got])],
                    names=["id", "n_bytes", "payload", "media_bytes", "media_sha256", "seconds", "page_ends", "feature"],
                )

    out = f"id {kind}, n_bytes long, payload binary, media_bytes long, media_sha256 string, seconds double, page_ends array<struct<stream:int,packets:int,seconds:double>>, feature string"
    return src.mapInArrow(run, out).withColumnRenamed("id", id_col)
