"""Ogg: round trips, the container's rules, damage."""

import hashlib
import random
import zlib

import pytest

from seqloom.llm import ogg


def slow_checksum(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if crc & 0x80000000 else (crc << 1) & 0xFFFFFFFF
    return crc


def test_checksum_is_the_polynomial():
    for data in (b"", b"\0", b"OggS", bytes(range(256))):
        assert ogg.checksum(data) == slow_checksum(data)


@pytest.mark.parametrize("length", [64, 4032, 4096, 4160, 65024, 65088, 300_032])
def test_payloads_come_back(length):
    payload = random.Random(length).randbytes(length)
    media = ogg.encode(payload, length - 3)
    back, n_bytes, times, pages = ogg.decode(media)
    assert back == payload and n_bytes == length - 3 and pages == len(list(ogg.read_pages(media)))
    assert times == [min(k, length) / ogg.RATE for k in range(ogg.PACKET, length + ogg.PACKET, ogg.PACKET)]


@pytest.mark.parametrize("size", [0, 1, 254, 255, 256, 510, 65025, 65026, 130_050])
def test_any_packet_is_laced_and_reassembled(size):
    packets = [(b"head", 0), (b"a" * size, 5), (b"b" * 255, 9), (b"", 9), (b"c", 10)]
    pages = ogg.write_stream(packets, 7)
    found = ogg.demultiplex(b"".join(p for _, p in pages))
    assert [d for d, _ in found[7]] == [d for d, _ in packets]
    assert found[7][-1][1] == 10


def test_interleaved_streams_are_parted():
    one, two = ogg.write_stream([(b"1", 0), (b"x" * 70_000, 3)], 1), ogg.write_stream([(b"2", 0), (b"y" * 70_000, 4)], 2)
    media = b"".join(p for pair in zip(one, two, strict=True) for _, p in pair)
    found = ogg.demultiplex(media)
    assert found[1][1] == (b"x" * 70_000, 3) and found[2][1] == (b"y" * 70_000, 4)


def test_damage_is_found():
    media = ogg.encode(bytes(70_016), 70_000)
    starts = list(ogg._starts(media))
    for at in (0, 30, 5000, len(media) - 1):
        bad = bytearray(media)
        bad[at] ^= 1
        with pytest.raises(ogg.Damaged):
            ogg.decode(bytes(bad))
    with pytest.raises(ogg.Damaged, match="no end"):
        ogg.decode(media[: starts[-1]])
    with pytest.raises(ogg.Damaged, match="out of place"):
        ogg.decode(media[: starts[2]] + media[starts[3] :])
    with pytest.raises(ogg.Damaged, match="short page"):
        ogg.decode(media[:-5])


def test_media_columns(spark):
    texts = {0: "", 1: None, 2: "é🙂" * 40, 3: "x" * 64, 4: "x" * 65, 5: "y" * 200_000, 6: "x" * 64}
    frame = spark.createDataFrame([(k, t, 9) for k, t in texts.items()], "doc_id long, text string, media int")
    found = {r["doc_id"]: r for r in ogg.read_media(ogg.write_media(frame)).collect()}
    for k, text in texts.items():
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        row = found[k]
        assert (row["n_bytes"], row["payload_bytes"], row["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert row["tail_crc32"] == zlib.crc32(payload[-64:]) and row["problem"] is None
    assert found[3][1:] == found[6][1:] and found[0]["media_sha256"] == found[1]["media_sha256"]
    bad = spark.createDataFrame([(1, None), (2, b"junk"), (3, b"")], "doc_id long, media binary")
    assert {r["doc_id"]: r["problem"] is not None for r in ogg.read_media(bad).collect()} == {1: True, 2: True, 3: True}
