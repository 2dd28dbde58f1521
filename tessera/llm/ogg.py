"""Media columns in the Ogg container: pages with checksums, packets from lacing values, streams and timestamps.

`store` writes each text's bytes losslessly as 8-bit samples (packets of one logical stream, granule position = samples
so far) beside a second logical stream with one packet of facts, pages of both interleaved. `describe` reads such a
column again: it verifies page checksums, reassembles packets (also over pages), takes the streams apart and derives
timestamps from granule positions. Both are map-side only: nothing is shuffled and one row is in memory at a time.
`media_features` keeps the column as a table in the shared folder between the two.
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

from tessera.llm.common import new_folder

RATE = 8000
#: Samples in a packet.
PACKET = 8192
UNIT = 64
SAMPLES, FACTS = 1, 2
_HEADER = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
#: One row's bytes go out in batches of about so many.
BATCH_BYTES = 8 << 20


def checksum(page: bytes) -> int:
    """Ogg's CRC-32 (polynomial 0x04c11db7, not reflected, from zero), by way of zlib's reflected one."""
    crc = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{crc:032b}"[::-1], 2)


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEADER.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing))
    page = head + lacing + body
    return page[:22] + checksum(page).to_bytes(4, "little") + page[26:]


def pages_of(serial: int, packets: list[bytes], granules: list[int]) -> list[bytes]:
    """The pages of one logical stream; granules are the positions at the packets' ends."""
    segments: list[tuple[bytes, int | None]] = []
    for packet, granule in zip(packets, granules, strict=True):
        whole = len(packet) // 255
        segments += [(packet[255 * k : 255 * k + 255], None) for k in range(whole)]
        segments.append((packet[255 * whole :], granule))
    out, head = [], len(packets[0]) // 255 + 1  # the first packet, the stream's header, has its pages for itself
    for number, at in enumerate([*range(0, head, 255), *range(head, len(segments), 255)]):
        part = segments[at : min(at + 255, head) if at < head else at + 255]
        ended = [g for _, g in part if g is not None]
        flags = (at > 0 and segments[at - 1][1] is None) | (2 * (at == 0)) | (4 * (at + len(part) >= len(segments)))
        out.append(_page(flags, ended[-1] if ended else -1, serial, number, bytes(len(s) for s, _ in part), b"".join(s for s, _ in part)))
    return out


def encode(data: bytes) -> bytes:
    """The container for a text's bytes, padded with zero bytes to a positive multiple of 64."""
    payload = data + bytes(-len(data) % UNIT or (UNIT if not data else 0))
    packets = [payload[k : k + PACKET] for k in range(0, len(payload), PACKET)]
    ends = np.cumsum([len(p) for p in packets]).tolist()
    head = b"samples8" + struct.pack("<II", RATE, 1)
    samples = pages_of(SAMPLES, [head, *packets], [0, *ends])
    facts = pages_of(FACTS, [b"facts" + struct.pack("<q", len(data))], [len(payload)])
    return b"".join([samples[0], facts[0], *samples[1:]])


@dataclass
class Stream:
    """What one logical stream held."""

    packets: list[bytes] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)  # granule positions at the packets' ends; -1 where not known
    pages: int = 0
    lost: int = 0  # gaps in page numbers
    opened: bool = False
    closed: bool = False
    _open: list[bytes] = field(default_factory=list)
    _next: int | None = None


def decode(media: bytes) -> tuple[dict[int, Stream], int]:
    """The logical streams by serial number, and how many damaged places were passed over."""
    streams: dict[int, Stream] = {}
    at, damaged = 0, 0
    while at < len(media):
        if media[at : at + 4] != b"OggS" or at + 27 > len(media):
            damaged, at = damaged + 1, media.find(b"OggS", at + 1)
            if at < 0:
                break
            continue
        _, version, flags, granule, serial, number, crc, n = _HEADER.unpack_from(media, at)
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        page = media[at:end]
        if version or len(lacing) < n or end > len(media) or checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            damaged, at = damaged + 1, media.find(b"OggS", at + 4)
            if at < 0:
                break
            continue
        s = streams.setdefault(serial, Stream())
        if s._next is not None and number != s._next:
            s.lost += 1
            s._open = []
        s._next, s.pages = number + 1, s.pages + 1
        s.opened, s.closed = s.opened or bool(flags & 2), s.closed or bool(flags & 4)
        if not flags & 1:
            s._open = []
        skip = bool(flags & 1) and not s._open  # the start of this packet was lost
        body, ended = at + 27 + n, 0
        start = body
        for size in lacing:
            body += size
            if size < 255:
                if not skip:
                    s.packets.append(b"".join([*s._open, media[start:body]]))
                    s.ends.append(-1)
                    ended += 1
                s._open, start, skip = [], body, False
        if start < body and not skip:
            s._open.append(media[start:body])
        back = granule
        for k in range(len(s.ends) - 1, len(s.ends) - 1 - ended, -1):
            s.ends[k] = back
            back -= len(s.packets[k])
        at = end
    return streams, damaged


def feature_text(samples: Stream, n_streams: int, damaged: int) -> str:
    """Facts and plain measures of the samples; equal media give equal text."""
    data = np.frombuffer(b"".join(samples.packets[1:]), np.uint8)
    counts = np.bincount(data, minlength=256).astype(np.float64)
    values, total = np.arange(256) - 128.0, max(1, len(data))
    mean = float((counts * values).sum() / total)
    power = float((counts * values**2).sum() / total)
    share = counts[counts > 0] / total
    seconds = (samples.ends[-1] if samples.ends else 0) / RATE
    starts = [round((e - len(p)) / RATE, 3) for e, p in zip(samples.ends[1:], samples.packets[1:], strict=True)]
    return (
        f"streams={n_streams};pages={samples.pages};packets={len(samples.packets)};damaged={damaged};seconds={seconds:.6f};last_start={starts[-1] if starts else 0:.3f};"
        f"mean={mean:.4f};rms={power**0.5:.4f};entropy={float(-(share * np.log2(share)).sum()) + 0.0:.4f}"
    )


def _sized(rows: Iterator[tuple], schema: pa.Schema, weigh: int) -> Iterator[pa.RecordBatch]:
    """Rows in batches of some BATCH_BYTES by the length of one column."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[weigh])
        if size >= BATCH_BYTES or len(held) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def store(docs: DataFrame) -> DataFrame:
    """Columns doc_id and media (the container's bytes) for every row; a null text is an empty one."""
    schema = pa.schema([("doc_id", pa.int64()), ("media", pa.binary())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sized(((i, encode(t.as_py())) for b in batches for i, t in zip(b["doc_id"].to_pylist(), b["data"], strict=True)), schema, 1)

    data = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data")
    return docs.select(F.col("doc_id").cast("long"), data).mapInArrow(write, "doc_id long, media binary")


def describe(media: DataFrame) -> DataFrame:
    """What a media column holds, read from its bytes: sizes, digests of payload and container, features.

    Null or foreign bytes give nulls and the feature 'unreadable'; damaged pages are passed over and counted.
    """
    kinds = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    kind_of = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(name, kind_of[kind]) for name, kind in (x.split() for x in kinds.split(", "))])

    def row(doc_id: int | None, data: bytes | None) -> tuple:
        streams, damaged = decode(data) if data else ({}, 0)
        facts = next((p for p in streams.get(FACTS, Stream()).packets if p[:5] == b"facts"), None)
        if SAMPLES not in streams or not facts:
            return (doc_id, None, None, None, None, None if data is None else len(data), None if data is None else hashlib.sha256(data).hexdigest(), "unreadable")
        payload = b"".join(streams[SAMPLES].packets[1:])
        return (doc_id, struct.unpack_from("<q", facts, 5)[0], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature_text(streams[SAMPLES], len(streams), damaged))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sized((row(i, m.as_py()) for b in batches for i, m in zip(b["doc_id"].to_pylist(), b["media"], strict=True)), schema, 7)

    return media.select("doc_id", "media").mapInArrow(read, kinds)


def media_features(docs: DataFrame) -> DataFrame:
    """Store every row's text as media in a table, read the stored bytes back and describe them; rows keep their number."""
    place = new_folder(docs.sparkSession, "media")
    store(docs).write.option("compression", "zstd").parquet(place)
    return describe(docs.sparkSession.read.schema("doc_id long, media binary").parquet(place))
