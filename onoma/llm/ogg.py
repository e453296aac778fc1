"""Ogg media columns: write, verify, reassemble and demultiplex pages; times from granule positions.

A payload is stored as unsigned 8-bit mono samples: one logical stream of PCM packets and one of
descriptive packets, multiplexed page by page. Reading goes the other way: every page's checksum is
verified, packets are put together from the lacing values (also across pages), pages are told apart
by serial number, and granule positions give each packet's time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from onoma.llm.common import read_table

CAPTURE = b"OggS"
HEADER = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
#: Samples a second of the stored streams, samples in a packet, bytes that a payload is padded to.
RATE = 8000
PACKET = 4000
BLOCK = 64
PCM_HEAD = struct.Struct("<8sHHIIBB")
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    """A page or packet that is not well formed."""


def ogg_crc(data: bytes) -> int:
    """The container's CRC: polynomial 0x04C11DB7, most significant bit first, no inversions.

    zlib's is the same polynomial mirrored and inverted, so mirroring the bytes and the result and
    undoing the inversions gives it at C speed.
    """
    mirrored = zlib.crc32(data.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_MIRROR), "big")


@dataclass
class Page:
    flags: int
    granule: int
    serial: int
    number: int
    lacing: bytes
    body: bytes


@dataclass
class Stream:
    """A logical stream: its packets, and the granule position that each page-ending packet has."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    ended: bool = False

    def seconds(self, rate: int) -> list[float | None]:
        """End time of every packet that a page's granule position dates; else None."""
        return [g / rate if g >= 0 else None for g in self.granules]


def write_page(page: Page) -> bytes:
    head = HEADER.pack(CAPTURE, 0, page.flags, page.granule, page.serial, page.number, 0, len(page.lacing))
    raw = head + page.lacing + page.body
    return raw[:22] + struct.pack("<I", ogg_crc(raw)) + raw[26:]


def paginate(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """Pages of one stream. packets: (bytes, granule position at its end). Long packets span pages."""
    pages, number, open_lacing, open_body, granule = [], 0, bytearray(), bytearray(), -1
    cont = False

    def flush(last: bool, midway: bool) -> None:
        nonlocal number, cont, granule
        flags = CONTINUED * cont | FIRST * (number == 0) | LAST * last
        pages.append(write_page(Page(flags, granule, serial, number, bytes(open_lacing), bytes(open_body))))
        open_lacing.clear(), open_body.clear()
        number, cont, granule = number + 1, midway, -1

    for k, (data, at) in enumerate(packets):
        values = b"\xff" * (len(data) // 255) + bytes([len(data) % 255])
        done = 0
        while done < len(values):
            take = values[done : done + 255 - len(open_lacing)]
            open_lacing += take
            open_body += data[done * 255 : (done + len(take)) * 255]
            done += len(take)
            if done == len(values):
                granule = at
            if len(open_lacing) == 255 and (done < len(values) or k + 1 < len(packets)):
                flush(False, done < len(values))
        if k == 0 and len(packets) > 1 and open_lacing:
            flush(False, False)  # the first page holds the head alone
    flush(True, False)
    return pages


def multiplex(streams: list[list[bytes]]) -> bytes:
    """Heads first, then the pages of all streams in turn, each stream's share in step."""
    out = [s[0] for s in streams if s]
    rest = [(k / max(1, len(s) - 1), n, p) for n, s in enumerate(streams) for k, p in enumerate(s[1:], 1)]
    return b"".join([*out, *(p for _, _, p in sorted(rest, key=lambda x: x[:2]))])


def read_pages(data: bytes) -> Iterator[Page]:
    """All pages in order; a bad capture pattern, version, length or checksum raises."""
    at, view = 0, memoryview(data)
    while at < len(data):
        if len(data) - at < HEADER.size:
            raise OggError(f"cut off in a page header at {at}")
        capture, version, flags, granule, serial, number, crc, n = HEADER.unpack_from(data, at)
        if capture != CAPTURE or version:
            raise OggError(f"no page at {at}")
        start = at + HEADER.size
        lacing = bytes(view[start : start + n])
        end = start + n + sum(lacing)
        if len(lacing) < n or end > len(data):
            raise OggError(f"cut off in a page at {at}")
        raw = bytes(view[at : at + 22]) + b"\0\0\0\0" + bytes(view[at + 26 : end])
        if ogg_crc(raw) != crc:
            raise OggError(f"checksum of the page at {at}")
        yield Page(flags, granule, serial, number, lacing, bytes(view[start + n : end]))
        at = end


def demultiplex(data: bytes) -> dict[int, Stream]:
    """Logical streams by serial number, in order of appearance, packets whole."""
    streams: dict[int, Stream] = {}
    partial: dict[int, list[bytes]] = {}
    numbers: dict[int, int] = {}
    for page in read_pages(data):
        if page.flags & FIRST:
            if page.serial in streams:
                raise OggError(f"stream {page.serial} begins twice")
            streams[page.serial], partial[page.serial], numbers[page.serial] = Stream(page.serial), [], 0
        elif page.serial not in streams:
            raise OggError(f"stream {page.serial} has no first page")
        s, open_parts = streams[page.serial], partial[page.serial]
        if page.number != numbers[page.serial]:
            raise OggError(f"stream {page.serial}: page {page.number} after {numbers[page.serial] - 1}")
        numbers[page.serial] += 1
        if bool(page.flags & CONTINUED) != bool(open_parts):
            raise OggError(f"stream {page.serial}: page {page.number} does not continue as marked")
        at = begun = 0
        ended = 0
        for v in page.lacing:
            at += v
            if v < 255:
                open_parts.append(page.body[begun:at])
                s.packets.append(b"".join(open_parts))
                s.granules.append(-1)
                open_parts.clear()
                begun, ended = at, ended + 1
        if at > begun or (page.lacing and page.lacing[-1] == 255):
            open_parts.append(page.body[begun:at])
        if ended:
            s.granules[-1] = page.granule
        s.ended |= bool(page.flags & LAST)
    if bad := [k for k, v in partial.items() if v]:
        raise OggError(f"streams {bad} end within a packet")
    return streams


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes padded with zero bytes to a positive multiple of BLOCK, and the unpadded length."""
    raw = (text or "").encode("utf-8")
    return raw + b"\0" * (-len(raw) % BLOCK or (0 if raw else BLOCK)), len(raw)


def store(payload: bytes, n_bytes: int) -> bytes:
    """The payload as an Ogg file; it depends on the payload alone."""
    serial = zlib.crc32(payload)
    head = PCM_HEAD.pack(b"PCM     ", 0, 0, 1, RATE, 8, 1)
    pcm = [(head, 0)] + [
        (payload[k : k + PACKET], min(len(payload), k + PACKET)) for k in range(0, len(payload), PACKET)
    ]
    tags = [(b"DESC    ", 0), (f"BYTES={n_bytes}\nSAMPLES={len(payload)}".encode(), len(payload))]
    return multiplex([paginate(serial, pcm), paginate(serial ^ 0xFFFFFFFF, tags)])


def load(media: bytes) -> tuple[bytes, int, list[float | None]]:
    """Payload, unpadded length and packet end times, all from the stored bytes."""
    pcm = tags = None
    for s in demultiplex(media).values():
        if s.packets[0][:8] == b"PCM     ":
            pcm = s
        elif s.packets[0] == b"DESC    ":
            tags = dict(x.split("=", 1) for x in s.packets[1].decode().split("\n"))
    if pcm is None or tags is None or not pcm.ended:
        raise OggError("the sample or the description stream is missing or cut off")
    *_, rate, bits, channels = PCM_HEAD.unpack(pcm.packets[0])
    if (bits, channels) != (8, 1):
        raise OggError("not 8-bit mono")
    return b"".join(pcm.packets[1:]), int(tags["BYTES"]), pcm.seconds(rate)[1:]


def features(payload: bytes, times: list[float | None]) -> str:
    """Signal features of the samples: duration, mean, RMS, entropy, zero crossings, peak."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / x.size
    level = np.arange(256) - 128.0
    mean = float(counts @ level) / x.size
    rms = float(counts @ level**2 / x.size) ** 0.5
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    seconds = next((t for t in reversed(times) if t is not None), 0.0)
    return (
        f"s={seconds:.4f};mean={mean:.3f};rms={rms:.3f};entropy={float(-(p * np.log2(p)).sum()) + 0.0:.4f};"
        f"zc={crossings};peak={int(counts.argmax())}"
    )


OP8_SCHEMA = (
    "doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string"
)


def media_column(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``media`` (binary): each text stored as an Ogg file.

    Null text is the empty text (one block of zero bytes). A column named ``media`` is replaced.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [n for n in b.schema.names if n != "media"]
            texts = b.column(b.schema.names.index(text_col))
            media = pa.array([store(*payload_of(t.as_py())) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), media], [*keep, "media"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "media")
    return docs.mapInArrow(run, f"{fields}, media binary")


def describe_media(docs: DataFrame) -> DataFrame:
    """Digest columns of (doc_id, media): everything is taken from the bytes as read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for m in b.column(1):
                media = m.as_py()
                payload, n_bytes, times = load(media)
                rows.append(
                    (
                        n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]),
                        len(media), hashlib.sha256(media).hexdigest(), features(payload, times),
                    )
                )
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *cols],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    return docs.select("doc_id", "media").mapInArrow(run, OP8_SCHEMA.format(kind=docs.schema["doc_id"].dataType.simpleString()))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return describe_media(media_column(docs).select("doc_id", "media"))
