import hashlib
import math
import random
import struct
import zlib

import pytest
from driftlens.llm import ogg


def slow_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if crc & 0x80000000 else crc << 1
    return crc


def test_checksum():
    for data in (b"", b"OggS", bytes(range(256)), random.Random(1).randbytes(999)):
        assert ogg.page_checksum(data) == slow_crc(data)


def test_packets_over_pages_and_times():
    rng = random.Random(2)
    streams = {}
    for serial in (7, 9):
        sizes = [9, 0, 255, 254, 510, 70_000, 1, 16_000]
        streams[serial] = ([rng.randbytes(n) for n in sizes], [0, *[sum(sizes[1 : k + 1]) for k in range(1, len(sizes))]])
    back = ogg.demux(ogg.mux(streams))
    for serial, (packets, granules) in streams.items():
        assert [p for p, _ in back[serial]] == packets
        assert ogg.packet_times(back[serial], len, 100) == [g / 100 for g in granules[1:]]


def test_damage_is_found():
    media = ogg.store(bytes(576 * 200))
    for at in (0, 30, len(media) // 2, len(media) - 1):
        broken = bytearray(media)
        broken[at] ^= 1
        with pytest.raises(ogg.OggError):
            ogg.demux(bytes(broken))
    with pytest.raises(ogg.OggError):
        ogg.demux(media[:-10])
    size = struct.unpack_from("B", media, 26)[0]
    with pytest.raises(ogg.OggError):  # a page is missing
        ogg.demux(media[27 + size + sum(media[27 : 27 + size]) :])


def test_query_over_odd_rows(odd, none):
    rows = ogg.media_features(ogg.to_media(odd)).collect()
    assert len(rows) == 12
    texts = {r.doc_id: (r.text or "").encode() for r in odd.collect()}
    for r in rows:
        payload = texts[r.doc_id] + b"\xff" * (-len(texts[r.doc_id]) % 576 if texts[r.doc_id] else 576) if r.doc_id else None
        if payload:
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(texts[r.doc_id]), len(payload), hashlib.sha256(payload).hexdigest())
    assert ogg.media_features(ogg.to_media(none)).count() == 0


def brute_feature(payload):
    samples, n = [b - 128 for b in payload], len(payload) // 576
    frames = [(n + 1) // 2, n // 2]
    seconds = "/".join(f"{f * 576 / ogg.RATE:.3f}" for f in frames)
    mean = sum(samples) / len(samples)
    rms = math.sqrt(sum(v * v for v in samples) / len(samples))
    turns = sum((a < 0) != (b < 0) for a, b in zip(samples, samples[1:]))
    return f"frames={frames[0]}/{frames[1]};seconds={seconds};mean={mean:.4f};rms={rms:.4f};peak={max(map(abs, samples))};turns={turns}"


def test_digests_against_brute_force(spark):
    rng = random.Random(4)
    texts = {k: "".join(chr(rng.choice((rng.randrange(32, 127), rng.randrange(160, 3000)))) for _ in range(n)) for k, n in enumerate((0, 1, 31, 575, 576, 577, 4000))}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    media = {r.doc_id: bytes(r.media) for r in ogg.to_media(docs).collect()}
    for r in ogg.media_features(ogg.to_media(docs)).collect():
        raw = texts[r.doc_id].encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-32:]), len(media[r.doc_id]), hashlib.sha256(media[r.doc_id]).hexdigest())
        assert r.feature == brute_feature(payload)
