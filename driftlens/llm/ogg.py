"""Media columns in Ogg: pages with checksums, lacing, several logical streams, granule positions.

mux() interleaves packets of several logical streams as pages; demux() verifies
every page's checksum and sequence number, reassembles packets from lacing
values over page borders and derives a time for each packet from granule
positions. Damaged input raises OggError.

media_features() stores each text as 8-bit samples in two logical streams (the
even and the odd frames), reads the stored bytes back and computes features
from what it has read. Null texts count as empty; empty texts are one frame of
padding; equal texts have equal values; null ids are kept; a repeated row gives
a repeated result; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from driftlens.llm.common import map_rows, table, texts

FRAME, RATE, PAGE_SEGMENTS = 576, 8000, 60
_CONTINUED, _FIRST, _LAST = 1, 2, 4
_HEAD = struct.Struct("<4sBBqIIIB")
_NO_GRANULE = -1
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    """Bytes that are not a valid Ogg file."""


def page_checksum(page: bytes) -> int:
    """CRC with polynomial 0x04C11DB7, no reflection, start and end 0.

    zlib computes the reflected form: mirroring the bits of every byte before
    and of the result after gives the plain one at zlib's speed.
    """
    crc = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_MIRROR), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    page = bytearray(_HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body)
    page[22:26] = page_checksum(bytes(page)).to_bytes(4, "little")
    return bytes(page)


def _pages(serial: int, packets: list[bytes], granules: list[int]) -> list[bytes]:
    """The pages of one logical stream; the first packet, its header, has a page of its own."""
    out = [_page(_FIRST | (_LAST if len(packets) == 1 else 0), granules[0], serial, 0, _laces(packets[0]), packets[0])]
    lacing, ends = bytearray(), []
    for packet, granule in zip(packets[1:], granules[1:], strict=True):
        lacing += _laces(packet)
        ends.append((len(lacing), granule))
    body, at, carried = b"".join(packets[1:]), 0, False
    for start in range(0, len(lacing), PAGE_SEGMENTS):
        part = bytes(lacing[start : start + PAGE_SEGMENTS])
        stop = start + len(part)
        done = [g for e, g in ends if start < e <= stop]
        flags = (_CONTINUED if carried else 0) | (_LAST if stop == len(lacing) else 0)
        size = sum(part)
        out.append(_page(flags, done[-1] if done else _NO_GRANULE, serial, len(out), part, body[at : at + size]))
        at, carried = at + size, part[-1] == 255
    return out


def _laces(packet: bytes) -> bytes:
    return b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])


def mux(streams: dict[int, tuple[list[bytes], list[int]]]) -> bytes:
    """An Ogg file of {serial: (packets, granule position after each)}; the first packet of each is its header."""
    pages = [_pages(serial, *x) for serial, x in streams.items()]
    out = [p.pop(0) for p in pages]
    for k in range(max(map(len, pages), default=0)):
        out += [p[k] for p in pages if k < len(p)]
    return b"".join(out)


def demux(data: bytes) -> dict[int, list[tuple[bytes, int | None]]]:
    """{serial: [(packet, granule position, or None where the page states it for a later packet)]}."""
    streams: dict[int, list[tuple[bytes, int | None]]] = {}
    partial: dict[int, list[bytes]] = {}
    number: dict[int, int] = {}
    closed: set[int] = set()
    at = 0
    while at < len(data):
        if len(data) - at < _HEAD.size:
            raise OggError(f"a page is cut off at {at}")
        magic, version, flags, granule, serial, sequence, crc, n = _HEAD.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise OggError(f"no page at {at}")
        lacing = data[at + _HEAD.size : at + _HEAD.size + n]
        size = _HEAD.size + n + sum(lacing)
        page = data[at : at + size]
        if len(lacing) < n or len(page) < size:
            raise OggError(f"a page is cut off at {at}")
        if page_checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            raise OggError(f"the checksum of the page at {at} is wrong")
        if bool(flags & _FIRST) == (serial in streams) or serial in closed or number.get(serial, 0) != sequence:
            raise OggError(f"a page of stream {serial} is missing or out of order at {at}")
        packets, rest = streams.setdefault(serial, []), partial.setdefault(serial, [])
        if bool(flags & _CONTINUED) != bool(rest):
            raise OggError(f"a packet of stream {serial} is broken at {at}")
        number[serial] = sequence + 1
        first, begin, pos = len(packets), _HEAD.size + n, _HEAD.size + n
        for lace in lacing:
            pos += lace
            if lace < 255:
                rest.append(page[begin:pos])
                packets.append((b"".join(rest), None))
                rest.clear()
                begin = pos
        if begin < pos:
            rest.append(page[begin:pos])
        if len(packets) > first:
            packets[-1] = (packets[-1][0], granule)
        if flags & _LAST:
            closed.add(serial)
        at += size
    if missing := set(streams) - closed:
        raise OggError(f"streams {sorted(missing)} do not end")
    return streams


def packet_times(packets: list[tuple[bytes, int | None]], samples: Callable[[bytes], int], rate: int) -> list[float]:
    """The second at which each packet after the header ends.

    A page states the position of the last packet that it ends; positions of
    earlier ones follow by counting back the samples of the packets between.
    """
    at: list[int] = [0] * len(packets)
    known: int | None = None
    for k in range(len(packets) - 1, 0, -1):
        packet, granule = packets[k]
        known = granule if granule is not None else known
        at[k] = known or 0
        if known is not None:
            known -= samples(packet)
    return [x / rate for x in at[1:]]


def store(payload: bytes) -> bytes:
    """Frames of 8-bit samples in two logical streams, even and odd frames."""
    streams = {}
    for which in (0, 1):
        frames = [payload[k : k + FRAME] for k in range(which * FRAME, len(payload), 2 * FRAME)]
        head = b"\x01u8frames" + struct.pack("<BIH", which, RATE, FRAME)
        streams[which + 1] = ([head, *frames], [0, *range(FRAME, FRAME * len(frames) + 1, FRAME)])
    return mux(streams)


def load(media: bytes) -> tuple[bytes, dict[int, list[float]]]:
    """The payload that store() stored, and the end times of the frames of each stream."""
    frames, times = {}, {}
    for serial, packets in demux(media).items():
        which, rate, size = struct.unpack("<BIH", packets[0][0][9:])
        if packets[0][0][:9] != b"\x01u8frames" or size != FRAME:
            raise OggError(f"stream {serial} has an unknown header")
        frames[which], times[which] = [p for p, _ in packets[1:]], packet_times(packets, len, rate)
    out = [b""] * (len(frames[0]) + len(frames[1]))
    out[0::2], out[1::2] = frames[0], frames[1]
    return b"".join(out), times


def feature(payload: bytes, times: dict[int, list[float]]) -> str:
    """Frames and seconds by stream, and the level, peak and sign changes of the samples around 128."""
    x = np.frombuffer(payload, np.uint8).astype(np.int32) - 128
    turns = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    seconds = "/".join(f"{times[k][-1] if times[k] else 0:.3f}" for k in sorted(times))
    frames = "/".join(str(len(times[k])) for k in sorted(times))
    return f"frames={frames};seconds={seconds};mean={x.mean():.4f};rms={float(np.sqrt((x * x).mean())):.4f};peak={int(np.abs(x).max())};turns={turns}"


def _pack(columns: dict[str, list]) -> dict[str, list]:
    raw = [t.encode() for t in columns["text"]]
    padded = [r + b"\xff" * (-len(r) % FRAME if r else FRAME) for r in raw]
    return {"doc_id": columns["doc_id"], "n_bytes": [len(r) for r in raw], "media": [store(p) for p in padded]}


def _features(columns: dict[str, list]) -> dict[str, list]:
    back = [load(m) for m in columns["media"]]
    return {
        "doc_id": columns["doc_id"],
        "n_bytes": columns["n_bytes"],
        "payload_bytes": [len(p) for p, _ in back],
        "payload_sha256": [hashlib.sha256(p).hexdigest() for p, _ in back],
        "tail_crc32": [zlib.crc32(p[-32:]) for p, _ in back],
        "media_bytes": [len(m) for m in columns["media"]],
        "media_sha256": [hashlib.sha256(m).hexdigest() for m in columns["media"]],
        "feature": [feature(*x) for x in back],
    }


def to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every text as an Ogg file in a binary column."""
    return map_rows(texts(docs), lambda: _pack, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Reads a media column back and digests it, one row for each row."""
    return map_rows(media.select("doc_id", "n_bytes", "media"), lambda: _features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op10_media_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(to_media(table(spark, sf_dir, "documents")))
