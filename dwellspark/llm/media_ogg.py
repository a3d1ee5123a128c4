"""Operator 10: media columns in Ogg.

write() stores bytes as Ogg pages: the payload is cut into packets, dealt round robin to logical streams, laced
into segments of at most 255 bytes and written as pages of the streams in turn. read() verifies each page's
checksum, order and flags, reassembles packets from lacing values, demultiplexes the streams, and derives each
packet's time from the granule positions. Samples are 8-bit, one byte each.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellspark.llm.common import by_batch, texts

#: Fixed by the format: the page header without its lacing values, and the flags.
HEADER = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
MAGIC = b"\x80pcm8\x00"
IDENT = struct.Struct("<6sBBIQ")
BLOCK, PACKET, STREAMS, RATE = 192, 960, 2, 8000
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """CRC-32 of polynomial 0x04C11DB7, most significant bit first, from 0, not inverted. zlib has the mirrored
    one; it is fed mirrored bytes, and its result is mirrored back."""
    mirrored = ~zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) & 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    blank = HEADER.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body
    return blank[:22] + struct.pack("<I", checksum(blank)) + blank[26:]


def _pages(packets: list[bytes], serial: int, segments: int) -> list[bytes]:
    """Pages of one stream. The first packet has a page of its own; later ones fill pages of `segments` segments
    and run on over page ends. A page's granule position is that of the last packet that ends there, or -1."""
    pages = [_page(FIRST | (LAST if len(packets) == 1 else 0), 0, serial, 0, bytes([len(packets[0])]), packets[0])]
    lacing, body, done, granule, carried = bytearray(), [], -1, 0, False
    for k, packet in enumerate(packets[1:], 1):
        at, granule = 0, granule + len(packet)
        values = [255] * (len(packet) // 255) + [len(packet) % 255]
        for i, v in enumerate(values):
            lacing.append(v)
            body.append(packet[at : at + v])
            at += v
            ended = i == len(values) - 1
            done = granule if ended else done
            over = ended and k == len(packets) - 1
            if len(lacing) == segments or over:
                pages.append(_page(CONTINUED * carried | LAST * over, done, serial, len(pages), bytes(lacing), b"".join(body)))
                lacing, body, done, carried = bytearray(), [], -1, not ended
    return pages


def write(payload: bytes, packet: int = PACKET, streams: int = STREAMS, rate: int = RATE, segments: int = 255) -> bytes:
    """Deterministic: equal payloads give equal files. Serial numbers come from the payload."""
    if not 0 < segments <= 255 or streams < 1 or packet < 1 or rate < 1:
        raise ValueError("segments are 1 to 255 a page; packet, streams and rate are positive")
    base, runs = zlib.crc32(payload), []
    cut = [payload[i : i + packet] for i in range(0, len(payload), packet)]
    for s in range(streams):
        ident = IDENT.pack(MAGIC, s, streams, rate, len(payload))
        runs.append(_pages([ident, *cut[s::streams]], (base + s) & 0xFFFFFFFF, segments))
    out = [run[0] for run in runs]  # all first pages come before any other
    for i in range(1, max(map(len, runs))):
        out += [run[i] for run in runs if i < len(run)]
    return b"".join(out)


@dataclass
class Stream:
    serial: int
    number: int
    rate: int = 0
    size: int = 0
    pages: int = 0
    packets: list[bytes] = field(default_factory=list)
    times: list[float] = field(default_factory=list)
    granule: int = 0
    ended: bool = False


def read(media: bytes) -> tuple[bytes, list[Stream]]:
    """The payload and its streams. ValueError, with the place, if anything is damaged, missing or out of order."""
    found: dict[int, Stream] = {}
    open_parts: dict[int, list[bytes]] = {}
    at, total = 0, 0
    while at < len(media):
        if len(media) < at + 27:
            raise ValueError(f"cut off at byte {at}")
        magic, version, flags, granule, serial, number, crc, count = HEADER.unpack_from(media, at)
        lacing = media[at + 27 : at + 27 + count]
        end = at + 27 + count + sum(lacing)
        if magic != b"OggS" or version or len(lacing) < count or end > len(media):
            raise ValueError(f"no whole page at byte {at}")
        page = media[at:end]
        if checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            raise ValueError(f"checksum of the page at byte {at}")
        if (stream := found.get(serial)) is None:
            if not flags & FIRST:
                raise ValueError(f"stream {serial} starts without its first page")
            stream = found[serial] = Stream(serial, len(found))
            open_parts[serial] = []
        if number != stream.pages or stream.ended or bool(flags & CONTINUED) != bool(open_parts[serial]):
            raise ValueError(f"page {number} of stream {serial} is out of order")
        stream.pages += 1
        parts, place, whole = open_parts[serial], 27 + count, []
        for v in lacing:
            parts.append(page[place : place + v])
            place += v
            if v < 255:
                whole.append(b"".join(parts))
                parts.clear()
        if flags & FIRST:
            if len(whole) != 1 or len(whole[0]) != IDENT.size:
                raise ValueError(f"stream {serial} has another kind of data")
            mark, stream.number, total, stream.rate, stream.size = IDENT.unpack(whole[0])
            if mark != MAGIC:
                raise ValueError(f"stream {serial} has another kind of data")
        elif whole:
            # The granule position is the end of the page's last whole packet; earlier ends follow from the lengths.
            last = granule
            ends = []
            for packet in reversed(whole):
                ends.append(last)
                last -= len(packet)
            if last != stream.granule:
                raise ValueError(f"granule position of page {number} of stream {serial}")
            stream.times += [(e - len(p)) / stream.rate for e, p in zip(reversed(ends), whole)]
            stream.packets += whole
            stream.granule = granule
        elif granule != -1:
            raise ValueError(f"page {number} of stream {serial} ends no packet and has a granule position")
        stream.ended = bool(flags & LAST)
        at = end
    streams = sorted(found.values(), key=lambda s: s.number)
    if not streams or len(streams) != total or any(not s.ended or open_parts[s.serial] for s in streams):
        raise ValueError("a stream is missing or has no end")
    payload = [b""] * sum(len(s.packets) for s in streams)
    for s in streams:
        payload[s.number :: total] = s.packets
    whole = b"".join(payload)
    if any(s.size != len(whole) for s in streams):
        raise ValueError("the payload has another length than noted")
    return whole, streams


def describe(streams: list[Stream]) -> str:
    """Features of a file: pages, packets, samples, and the start of the last packet in seconds, stream by stream."""
    return ";".join(f"{s.number}:pages={s.pages},packets={len(s.packets)},samples={s.granule},last={s.times[-1] if s.times else 0:.6f}" for s in streams)


def payload_of(text: str | None, block: int = BLOCK) -> bytes:
    """UTF-8 with spaces up to a positive multiple of block; null is as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (-len(raw) % block if raw else block)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (unpadded), media (the Ogg file) for each row, nulls and repeated rows included."""
    rows = texts(docs, id_col, text_col)

    def run(batch: pa.RecordBatch):
        given = batch.column(1).to_pylist()
        sizes = [len((t or "").encode("utf-8", "surrogatepass")) for t in given]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array([write(payload_of(t)) for t in given], pa.binary())], ["doc_id", "n_bytes", "media"])

    return by_batch(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


_DIGESTS = [
    ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()),
    ("media_sha256", pa.string()), ("feature", pa.string()), ("error", pa.string()),
]


def _digested(media: bytes | None) -> tuple:
    if media is None:
        return (None,) * 7
    try:
        payload, streams = read(media)
    except ValueError as e:
        return None, None, None, len(media), hashlib.sha256(media).hexdigest(), None, str(e)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), describe(streams), None


def decode(files: DataFrame) -> DataFrame:
    """files: doc_id, n_bytes, media. What is read back, as digests and features; a damaged file has its fault in
    column error and nulls elsewhere, a null file has nulls."""

    def run(batch: pa.RecordBatch):
        found = list(zip(*[_digested(m) for m in batch.column(2).to_pylist()])) or [()] * len(_DIGESTS)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v, t) for v, (_, t) in zip(found, _DIGESTS))], ["doc_id", "n_bytes", *(n for n, _ in _DIGESTS)])

    kinds = {pa.int64(): "long", pa.string(): "string"}
    schema = f"doc_id {files.schema['doc_id'].dataType.simpleString()}, n_bytes long, " + ", ".join(f"{n} {kinds[t]}" for n, t in _DIGESTS)
    return by_batch(files.select("doc_id", "n_bytes", "media"), run, schema)


def op10_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))).drop("error")
