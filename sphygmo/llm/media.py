"""Media columns: Ogg containers written and read page by page."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sphygmo.llm.common import segments, table

#: Samples (8 bit, one channel) a second, and samples in a packet of a stored payload.
RATE, PACKET = 8000, 4000
#: Payloads are filled up with bytes 0 to a multiple of this.
UNIT = 64
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
_HEAD = struct.Struct("<4sBBqIIIB")
_FRESH, _FIRST, _LAST = 1, 2, 4


def page_checksum(page: bytes) -> int:
    """CRC-32 of polynomial 0x04c11db7, high bit first, from 0, no final flip (RFC 3533).

    That is the common reflected CRC-32 of the bit-reversed bytes, reversed, without its two flips.
    """
    flipped = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(flipped.to_bytes(4, "little").translate(_REVERSED), "big")


def write_stream(packets: list[bytes], granules: list[int], serial: int) -> list[bytes]:
    """Pages of one logical stream; ``granules`` has the position at the end of each packet.

    A page takes 255 lacing values at most. Packets run on over pages; a page on which no packet ends has position -1.
    """
    lacing: list[tuple[int, int]] = []  # value, position if the packet ends here, else -1
    for packet, at in zip(packets, granules, strict=True):
        whole, rest = divmod(len(packet), 255)
        lacing += [(255, -1)] * whole + [(rest, at)]
    data, pages, used = b"".join(packets), [], 0
    for number, k in enumerate(range(0, max(1, len(lacing)), 255)):
        part = lacing[k : k + 255]
        size = sum(v for v, _ in part)
        ends = [at for _, at in part if at >= 0]
        flags = _FRESH * (k > 0 and lacing[k - 1][0] == 255) | _FIRST * (k == 0) | _LAST * (k + 255 >= len(lacing))
        head = _HEAD.pack(b"OggS", 0, flags, ends[-1] if ends else -1, serial, number, 0, len(part)) + bytes(v for v, _ in part)
        page = head + data[used : used + size]
        used += size
        pages.append(page[:22] + page_checksum(page).to_bytes(4, "little") + page[26:])
    return pages


def write_media(payload: bytes) -> bytes:
    """An Ogg file of two logical streams: the payload as 8-bit samples, and one note with its length and CRC-32.

    The streams' first pages stand first and their other pages alternate. Serial numbers come from the payload, so equal
    payloads make equal files.
    """
    serial = zlib.crc32(payload) & 0xFFFFFFFE
    head = b"PCM8" + struct.pack("<IQ", RATE, len(payload))
    packets = [payload[k : k + PACKET] for k in range(0, len(payload), PACKET)]
    ends = list(np.cumsum([len(p) for p in packets], dtype=np.int64))
    sound = write_stream([head, *packets], [0, *map(int, ends)], serial)
    note = write_stream([b"NOTE", struct.pack("<QI", len(payload), zlib.crc32(payload))], [0, len(payload)], serial + 1)
    return b"".join([sound[0], *note, *sound[1:]])


def read_media(media: bytes | None) -> dict:
    """Streams of an Ogg file by serial number: packets, positions, and what is wrong.

    Every page is checked (capture pattern, length, checksum, sequence number). A page with a wrong checksum is left
    out and counted in ``bad``; the packets that it touches are dropped whole, the others stay. Null media: no streams.
    """
    streams: dict[int, dict] = {}
    bad, at, media = 0, 0, media or b""
    while at < len(media):
        if media[at : at + 4] != b"OggS" or len(media) < at + 27:
            bad, at = bad + 1, media.find(b"OggS", at + 1)
            if at < 0:
                break
            continue
        _, _, flags, granule, serial, number, checksum, n = _HEAD.unpack_from(media, at)
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        page = media[at:end]
        if len(lacing) < n or len(media) < end or page_checksum(page[:22] + b"\0\0\0\0" + page[26:]) != checksum:
            bad, at = bad + 1, media.find(b"OggS", at + 4)
            if at < 0:
                break
            continue
        s = streams.setdefault(serial, {"packets": [], "ends": [], "next": 0, "open": None, "last": -1, "pages": 0, "gaps": 0, "closed": False})
        if number != s["next"]:
            s["gaps"], s["open"] = s["gaps"] + 1, None
        s["next"], s["pages"], s["closed"] = number + 1, s["pages"] + 1, bool(flags & _LAST)
        skip = bool(flags & _FRESH) and s["open"] is None  # runs on from a page that is lost
        parts, used = ([] if skip or not flags & _FRESH else s["open"]), at + 27 + n
        s["open"] = None
        done = 0
        for k, v in enumerate(lacing):
            parts.append(media[used : used + v])
            used += v
            if v < 255:
                if not skip:
                    s["packets"].append(b"".join(parts))
                    s["ends"].append(-1)
                    done += 1
                parts, skip = [], False
            elif k == len(lacing) - 1:
                s["open"] = None if skip else parts
        if done:
            s["ends"][-1], s["last"] = granule, granule
        at = end
    return {"streams": streams, "bad": bad}


def timestamps(stream: dict, rate: int = RATE) -> list[float]:
    """Seconds at the end of each packet: a page gives the position of the last packet that ends on it; those before it
    follow from the packets' own lengths (one byte is one sample), counted back."""
    out, after = [], None
    for packet, end in zip(reversed(stream["packets"]), reversed(stream["ends"]), strict=True):
        here = end if end >= 0 else after
        out.append(max(0, here or 0) / rate)
        after = (here or 0) - len(packet)
    return out[::-1]


def samples(found: dict) -> bytes:
    """The payload of the sound stream of :func:`write_media`; empty if there is none."""
    for s in found["streams"].values():
        if s["packets"] and s["packets"][0][:4] == b"PCM8":
            return b"".join(s["packets"][1:])
    return b""


def feature(found: dict, payload: bytes) -> str:
    """streams, pages, packets, bad pages, seconds, and the samples' mean, deviation and zero share, joined by ';'."""
    x = np.frombuffer(payload, np.uint8)
    sound = next((s for s in found["streams"].values() if s["packets"] and s["packets"][0][:4] == b"PCM8"), None)
    seconds = timestamps(sound)[-1] if sound else 0.0
    total, squares = int(x.sum(dtype=np.uint64)), int((x.astype(np.uint32) ** 2).sum(dtype=np.uint64))
    mean = total / max(1, len(x))
    deviation = max(0.0, squares / max(1, len(x)) - mean * mean) ** 0.5
    packets = sum(len(s["packets"]) for s in found["streams"].values())
    pages = sum(s["pages"] for s in found["streams"].values())
    return f"streams={len(found['streams'])};pages={pages};packets={packets};bad={found['bad']};seconds={seconds:.6f};mean={mean:.4f};deviation={deviation:.4f};zeros={int((x == 0).sum())}"


def with_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as UTF-8, filled up with bytes 0 to a positive multiple of 64, as Ogg.

    Null and empty texts make 64 bytes 0. Each row is a row of the result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = [t.as_py() or "" for t in batch.column(1)]
            for k, end in segments(whole, 128):
                part, raw = batch.slice(k, end - k), [t.encode() for t in whole[k:end]]
                media = [write_media(r + bytes(max(UNIT, -(-len(r) // UNIT) * UNIT) - len(r))) for r in raw]
                yield pa.record_batch([part.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of each row's
    media, from the bytes as read back. Null or damaged media: what can be read, with the bad pages counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for blob in batch.column(2):
                raw = blob.as_py() or b""
                found = read_media(raw)
                payload = samples(found)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(found, payload)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.record_batch([batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as an Ogg stream of 8-bit samples, read back: digests and features."""
    return media_features(with_media(table(spark, sf_dir, "documents")))
