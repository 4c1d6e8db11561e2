"""Media columns: Ogg physical streams in a binary column.

Writing: a payload becomes the 8-bit mono samples of one logical stream, beside a second logical
stream with a note on them; both are cut into packets, laced into pages with checksums and granule
positions, and interleaved. Reading: page checksums are verified, packets are reassembled from the
lacing values, logical streams are demultiplexed by serial number, and timestamps follow from the
granule positions. Spark partitions the rows; the helpers here handle one value at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seqloom.plans.shipping import ship_package

#: Fixed values of the container format: capture pattern, header layout, flags, segments of a page.
CAPTURE = b"OggS"
HEADER = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
SEGMENTS = 255
#: Samples a second, samples of a packet, and the bytes to which payloads are padded.
RATE, PACKET, PAD = 8000, 4096, 64
#: Serial numbers of the two logical streams.
SAMPLES, NOTES = 1, 2
HEAD = struct.Struct("<8sIQ")
HEAD_MARK = b"PCM8MONO"

_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(page: bytes) -> int:
    """The container's CRC: polynomial 0x04C11DB7 from the highest bit, no start or end value.

    It is zlib's CRC of the bit-reversed bytes, bit-reversed, without zlib's inversions.
    """
    crc = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    def with_crc(crc: int) -> bytes:
        return HEADER.pack(CAPTURE, 0, flags, granule, serial, number, crc, len(lacing)) + lacing + body

    return with_crc(checksum(with_crc(0)))


def write_stream(packets: list[tuple[bytes, int]], serial: int) -> list[tuple[int, bytes]]:
    """Pages of one logical stream, as (granule position or -1, page).

    ``packets``: (bytes, granule position at the packet's end). A page takes up to 255 lacing
    values; packets run on over pages. The first packet has a page of its own, as headers must.
    """
    pages: list[tuple[int, bytes]] = []
    lacing, body, granule, flags, number = bytearray(), bytearray(), -1, FIRST, 0

    def flush(last: bool, runs_on: bool) -> None:
        nonlocal lacing, body, granule, flags, number
        pages.append((granule, _page(flags | LAST * last, granule, serial, number, bytes(lacing), bytes(body))))
        number += 1
        lacing, body, granule, flags = bytearray(), bytearray(), -1, CONTINUED * runs_on

    for k, (data, end) in enumerate(packets):
        values = bytes([255]) * (len(data) // 255) + bytes([len(data) % 255])
        at = 0
        while values:
            room = SEGMENTS - len(lacing)
            now, values = values[:room], values[room:]
            lacing += now
            body += data[at : at + sum(now)]
            at += sum(now)
            if not values:
                granule = end
            if values or len(lacing) == SEGMENTS or k == 0 or k == len(packets) - 1:
                flush(k == len(packets) - 1 and not values, bool(values))
    return pages


def encode(payload: bytes, n_bytes: int) -> bytes:
    """A physical stream of ``payload`` as samples, with a note of its unpadded length."""
    head = HEAD.pack(HEAD_MARK, RATE, len(payload))
    cut = [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET)]
    samples = write_stream([(head, 0), *cut], SAMPLES)
    notes = write_stream([(b"NOTES", 0), (str(n_bytes).encode(), len(payload))], NOTES)
    # all first pages stand before any other; the note comes with the first samples
    return b"".join(p for _, p in [samples[0], notes[0], *samples[1:2], *notes[1:], *samples[2:]])


class Damaged(ValueError):
    """A page that cannot be used: wrong mark, checksum, length or place."""


def read_pages(media: bytes) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
    """(flags, granule, serial, number, lacing, body) of each page; raises ``Damaged``."""
    at, view = 0, memoryview(media)
    while at < len(media):
        if len(media) - at < HEADER.size:
            raise Damaged(f"short page at {at}")
        mark, version, flags, granule, serial, number, crc, count = HEADER.unpack_from(media, at)
        if mark != CAPTURE or version:
            raise Damaged(f"no page at {at}")
        lacing = bytes(view[at + HEADER.size : at + HEADER.size + count])
        start = at + HEADER.size + count
        end = start + sum(lacing)
        if len(lacing) < count or end > len(media):
            raise Damaged(f"short page at {at}")
        if checksum(bytes(view[at : at + 22]) + b"\0\0\0\0" + bytes(view[at + 26 : end])) != crc:
            raise Damaged(f"checksum at {at}")
        yield flags, granule, serial, number, lacing, bytes(view[start:end])
        at = end


def demultiplex(media: bytes) -> dict[int, list[tuple[bytes, int]]]:
    """Packets of each logical stream, as (bytes, granule position or -1 where a page gives none).

    Raises ``Damaged`` on a bad page, a gap in page numbers, or a stream without its end.
    """
    packets: dict[int, list[tuple[bytes, int]]] = {}
    part: dict[int, bytearray] = {}
    numbers: dict[int, int] = {}
    ended: dict[int, bool] = {}
    for flags, granule, serial, number, lacing, body in read_pages(media):
        if bool(flags & FIRST) != (serial not in numbers) or number != numbers.get(serial, -1) + 1:
            raise Damaged(f"page {number} of stream {serial} is out of place")
        if bool(flags & CONTINUED) != (serial in part):
            raise Damaged(f"page {number} of stream {serial} does not follow on")
        numbers[serial], ended[serial] = number, bool(flags & LAST)
        own, at, last = packets.setdefault(serial, []), 0, -1
        open_packet = part.pop(serial, bytearray())
        length = 0
        for value in lacing:
            length += value
            if value < 255:
                own.append((bytes(open_packet + body[at : at + length]), -1))
                open_packet, at, length, last = bytearray(), at + length, 0, len(own) - 1
        if lacing and lacing[-1] == 255:
            part[serial] = open_packet + body[at:]
        if last >= 0:
            own[last] = (own[last][0], granule)
    if part or not all(ended.values()):
        raise Damaged("a stream has no end")
    return packets


def timestamps(packets: list[tuple[bytes, int]], rate: int) -> list[float]:
    """Seconds at which each packet of samples ends, from the granule positions.

    Where a page ends with a packet, its granule position counts; packets before it on the page
    are counted back from there by their lengths.
    """
    ends, at = [0] * len(packets), None
    for k in range(len(packets) - 1, -1, -1):
        data, granule = packets[k]
        at = granule if granule >= 0 else at
        if at is None:
            raise Damaged("no granule position")
        ends[k] = at
        at -= len(data)
    return [e / rate for e in ends]


def decode(media: bytes) -> tuple[bytes, int, list[float], int]:
    """(payload, unpadded length, end time of each packet, number of pages)."""
    streams = demultiplex(media)
    if SAMPLES not in streams or NOTES not in streams:
        raise Damaged("a stream is missing")
    (head, _), *cut = streams[SAMPLES]
    mark, rate, length = HEAD.unpack(head)
    payload = b"".join(d for d, _ in cut)
    times = timestamps(cut, rate)
    if mark != HEAD_MARK or len(payload) != length or times[-1:] != [length / rate]:
        raise Damaged("header and samples differ")
    return payload, int(streams[NOTES][1][0]), times, sum(1 for _ in _starts(media))


def _starts(media: bytes) -> Iterator[int]:
    at = 0
    while at < len(media):
        yield at
        count = media[at + 26]
        at += HEADER.size + count + sum(media[at + HEADER.size : at + HEADER.size + count])


def features(payload: bytes, times: list[float]) -> str:
    """Integer features of 8-bit samples around 128: length, packets, level and crossings."""
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int16) - 128
    power = int(np.dot(x.astype(np.int64), x.astype(np.int64))) if len(x) < 1 << 20 else sum(int(np.dot(c, c)) for c in np.array_split(x.astype(np.int64), len(x) >> 19))
    signs = x >= 0
    crossings = int(np.count_nonzero(signs[1:] != signs[:-1]))
    return (
        f"ms={round(times[-1] * 1000)};packets={len(times)};mean={round(1000 * int(x.sum(dtype=np.int64)) / len(x))}"
        f";rms={round(1000 * (power / len(x)) ** 0.5)};peak={int(np.abs(x).max())};crossings={crossings}"
    )


def write_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", media_col: str = "media") -> DataFrame:
    """Store each text, as UTF-8 padded with bytes 0 to a positive multiple of 64, as Ogg.

    Returns (id, ``media_col`` binary). Null and empty texts are 64 bytes 0. Every row gives a row,
    repeated ones too; further columns are ignored. Equal texts give equal bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for start, stop in _slices(texts):
                media = []
                for text in texts[start:stop]:
                    raw = (text.as_py() or "").encode()
                    media.append(encode(raw + bytes(-len(raw) % PAD or (PAD if not raw else 0)), len(raw)))
                yield pa.RecordBatch.from_arrays([ids[start:stop], pa.array(media, pa.binary())], [id_col, media_col])

    ship_package(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, `{media_col}` binary")


def _slices(column: pa.Array, most: int = 16 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch with about ``most`` bytes of values each."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for k, n in enumerate(sizes):
        total += int(n)
        if total >= most:
            yield start, k + 1
            start, total = k + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def read_media(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Read stored Ogg values back.

    Returns (id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature, n_pages, problem). A null or damaged value keeps its row: ``problem`` says what is
    wrong, and what could not be read is null.
    """
    fields = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages long, problem string"
    names = [f.split()[0] for f in fields.split(", ")]
    kinds = [pa.int64() if " long" in f else pa.string() for f in fields.split(", ")]

    def one(media: bytes | None) -> tuple:
        if media is None:
            return (None,) * 8 + ("no media",)
        own = (len(media), hashlib.sha256(media).hexdigest())
        try:
            payload, n_bytes, times, pages = decode(media)
        except (Damaged, struct.error, IndexError, ValueError) as error:
            return (None, None, None, None, *own, None, None, str(error) or "damaged")
        return (n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), *own, features(payload, times), pages, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*[one(m.as_py()) for m in batch.column(1)], strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(r), k) for r, k in zip(rows, kinds, strict=True))], [id_col, *names])

    ship_package(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, media_col).mapInArrow(run, f"`{id_col}` {kind}, {fields}")
