"""Media columns in Ogg: pages with checksums, packets from lacing values, logical streams, times from granule positions.

A physical stream is a run of pages.  A page has the capture pattern, flags (continued packet, first page, last page), the
granule position at its end, the serial number of its logical stream, a sequence number, a checksum (CRC-32 with polynomial
0x04C11DB7, not reflected, over the page with zeros in its place) and up to 255 lacing values.  A packet is the
segments up to and with the first lacing value under 255; it may run on over pages.

``demux`` takes any Ogg bytes apart: it finds pages, verifies checksums, tells logical streams apart by serial number,
puts packets together (dropping one of which a page is missing) and gives every packet the time of its end.  ``mux`` writes
packets of several logical streams, page by page in turn.

For documents, ``mux_payload`` stores bytes as 8-bit unsigned samples: stream ``AUDIO`` has a PCM header packet and then
packets of ``FRAME`` samples at ``RATE`` Hz, whose granule positions count samples; stream ``NOTE`` has one packet with the number
of bytes before padding.  ``demux_payload`` reads both back.

Defined results: null text counts as empty, so it has one padded frame; equal texts give equal bytes (serial numbers are
constants); bytes that are no valid page are skipped and counted, never an error; repeated rows stay; an empty table gives no
rows; a column of the input that has the name of a new one is an error; memory is in proportion to one document.
"""

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .common import new_column, table, text_or_empty

FRAME = 576
RATE = 8000
PAD = b"\xff"
#: Serial numbers of the two logical streams.
AUDIO, NOTE = 0x50434D38, 0x4E4F5445
_PAGE = struct.Struct("<4sBBqIIIB")
_PCM = struct.Struct("<8sHHIIBBHI")
_FLIP = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(page: bytes) -> int:
    """The checksum of a page: the reflected CRC of zlib over mirrored bytes, mirrored back, with start and end values of 0."""
    mirrored = zlib.crc32(page.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_FLIP), "big")


def _page(serial: int, number: int, granule: int, flags: int, lacing: bytes, body: bytes) -> bytes:
    head = _PAGE.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing))
    crc = page_crc(head + lacing + body)
    return b"".join((head[:22], struct.pack("<I", crc), head[26:], lacing, body))


def pages_of(serial: int, packets: list[tuple[bytes, int]]) -> Iterator[bytes]:
    """Pages of one logical stream.  packets: bytes and the granule position at their end; the first has a page of its own."""
    number = 0
    groups = [packets[:1], packets[1:]] if len(packets) > 1 else [packets]
    for g, group in enumerate(groups):
        lacing = b"".join(b"\xff" * (len(p) // 255) + bytes([len(p) % 255]) for p, _ in group)
        body = b"".join(p for p, _ in group)
        ends, at = [], 0
        for p, granule in group:
            at += len(p) // 255 + 1
            ends.append((at, granule))
        taken = done = 0
        for s in range(0, len(lacing), 255):
            part = lacing[s : s + 255]
            size = sum(part)
            granule = -1
            while done < len(ends) and ends[done][0] <= s + len(part):
                granule = ends[done][1]
                done += 1
            last = g == len(groups) - 1 and s + len(part) == len(lacing)
            flags = (1 if s and lacing[s - 1] == 255 else 0) | (2 if number == 0 else 0) | (4 if last else 0)
            yield _page(serial, number, granule, flags, part, body[taken : taken + size])
            taken += size
            number += 1


def mux(streams: dict[int, list[tuple[bytes, int]]]) -> bytes:
    """One physical stream: first pages of all logical streams, then their pages in turn."""
    left = [pages_of(s, p) for s, p in streams.items()]
    out = []
    while left:
        for it in list(left):
            if (page := next(it, None)) is None:
                left.remove(it)
            else:
                out.append(page)
    return b"".join(out)


@dataclass
class Stream:
    """A logical stream: packets, and of each the granule position at its end (-1: not known)."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    first: bool = False
    last: bool = False
    gaps: int = 0  # places where pages are missing, ends included
    _open: list[bytes] | None = None
    _next: int | None = None

    def add(self, flags: int, number: int, granule: int, lacing: bytes, data: memoryview) -> None:
        self.pages += 1
        self.first |= bool(flags & 2)
        self.last |= bool(flags & 4)
        if self._next is not None and number != self._next:
            self.gaps += 1
            self._open = None
        self._next = number + 1
        skip = bool(flags & 1) and self._open is None  # the start of this packet is missing
        if not flags & 1:
            self._open = None
        at, start, ended = 0, 0, len(self.packets)
        for v in lacing:
            at += v
            if v < 255:
                if skip:
                    skip = False
                else:
                    self.packets.append(b"".join([*(self._open or ()), bytes(data[start:at])]))
                    self.granules.append(-1)
                self._open, start = None, at
        if start < at or (lacing and lacing[-1] == 255):
            self._open = None if skip else [*(self._open or ()), bytes(data[start:at])]
        if granule >= 0 and len(self.packets) > ended:  # the last packet that ends here is a kept one: only the first may have been dropped
            self.granules[-1] = granule


@dataclass
class Physical:
    streams: dict[int, Stream]
    pages: int
    bad_checksums: int
    skipped_bytes: int


def demux(media: bytes) -> Physical:
    """All logical streams of a physical stream; pages with wrong checksums count and are left out."""
    streams: dict[int, Stream] = {}
    view, at, pages, bad, skipped = memoryview(media), 0, 0, 0, 0
    while at < len(media):
        if media[at : at + 4] != b"OggS" or at + 27 > len(media):
            to = media.find(b"OggS", at + 1)
            to = len(media) if to < 0 else to
            skipped, at = skipped + to - at, to
            continue
        _, _, flags, granule, serial, number, crc, n = _PAGE.unpack_from(media, at)
        lacing = media[at + 27 : at + 27 + n]
        body = at + 27 + n
        end = body + sum(lacing)
        if len(lacing) < n or end > len(media) or page_crc(b"".join((view[at : at + 22], bytes(4), view[at + 26 : end]))) != crc:
            bad += 1
            skipped, at = skipped + 4, at + 4  # look for the next capture pattern
            continue
        streams.setdefault(serial, Stream()).add(flags, number, granule, lacing, view[body:end])
        pages, at = pages + 1, end
    for s in streams.values():
        s.gaps += (not s.first) + (not s.last)
    return Physical(streams, pages, bad, skipped)


def packet_ends(granules: list[int], durations: list[int], start: int = 0) -> list[int]:
    """Granule positions at the ends of all packets: known ones hold, between them the durations add up (before a known one that is ahead, pages are missing)."""
    out, at, since = [], start, 0
    for i, (g, d) in enumerate(zip(granules, durations, strict=True)):
        at += d
        if g >= 0:
            if g > at:
                out[since:] = [x + g - at for x in out[since:]]
            at, since = g, i + 1
        out.append(at)
    return out


def packet_rows(media: bytes) -> list[dict]:
    """All packets with the time of their end: rate and frame size are those of the stream's PCM header; without one only position 0 has a time."""
    rows = []
    for serial, s in demux(media).streams.items():
        if s.packets and s.packets[0][:8] == b"PCM     " and len(s.packets[0]) == _PCM.size:
            _, _, _, _, rate, bits, channels, _, _ = _PCM.unpack(s.packets[0])
            width = max(1, channels * bits // 8)
            ends = packet_ends(s.granules, [0, *(len(p) // width for p in s.packets[1:])])
            times = [g * 1000 / rate if rate else None for g in ends]
        else:
            times = [None if g else 0.0 for g in s.granules]
        rows += [{"serial": serial, "packet": i, "end_ms": t, "data": p} for i, (p, t) in enumerate(zip(s.packets, times, strict=True))]
    return rows


def padded(text: str) -> tuple[int, bytes]:
    data = text.encode()
    return len(data), data + PAD * (-len(data) % FRAME or (0 if data else FRAME))


def mux_payload(n_bytes: int, payload: bytes) -> bytes:
    """Store bytes (a multiple of ``FRAME``) as samples in an audio stream, and their unpadded number in a note stream."""
    head = _PCM.pack(b"PCM     ", 0, 0, 1, RATE, 8, 1, FRAME, 0)
    audio = [(head, 0), *((payload[i : i + FRAME], i + FRAME) for i in range(0, len(payload), FRAME))]
    return mux({AUDIO: audio, NOTE: [(struct.pack("<Q", n_bytes), 0)]})


def demux_payload(media: bytes) -> dict:
    """What was stored, and features of the stream and its samples."""
    own = demux(media)
    audio, note = own.streams.get(AUDIO, Stream()), own.streams.get(NOTE, Stream())
    samples = b"".join(audio.packets[1:])
    ends = packet_ends(audio.granules[1:], [len(p) for p in audio.packets[1:]])
    counts = [samples.count(b) for b in (b" ", b"\n", PAD)]
    loud = int(np.frombuffer(samples, np.uint8).sum(dtype=np.int64)) / max(1, len(samples))
    return {
        "n_bytes": struct.unpack("<Q", note.packets[0])[0] if note.packets else None,
        "payload": samples,
        "feature": f"streams={len(own.streams)};pages={own.pages};bad={own.bad_checksums};gaps={audio.gaps};packets={len(audio.packets)}"
        f";end_ms={ends[-1] * 1000 // RATE if ends else 0};last_granule={ends[-1] if ends else 0};mean={loud:.3f};spaces={counts[0]};lines={counts[1]};pad={counts[2]}",
    }


@pandas_udf(T.BinaryType())
def _store(texts: pd.Series) -> pd.Series:
    return pd.Series([mux_payload(*padded(t)) for t in texts], dtype=object)


_DIGEST = T.StructType([T.StructField(n, t()) for n, t in (("n_bytes", T.LongType), ("payload_bytes", T.LongType), ("payload_sha256", T.StringType), ("tail_crc32", T.LongType), ("media_bytes", T.LongType), ("media_sha256", T.StringType), ("feature", T.StringType))])


def digests(media: bytes) -> tuple:
    """``_DIGEST`` of stored bytes: everything is read back from them."""
    x = demux_payload(media)
    p = x["payload"]
    return x["n_bytes"], len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(media), hashlib.sha256(media).hexdigest(), x["feature"]


@pandas_udf(_DIGEST)
def _digests(media: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([digests(bytes(m)) for m in media], columns=_DIGEST.names)


_PACKETS = T.ArrayType(T.StructType([T.StructField(n, t()) for n, t in (("serial", T.LongType), ("packet", T.IntegerType), ("end_ms", T.DoubleType), ("data", T.BinaryType))]))


@pandas_udf(_PACKETS)
def _packets(media: pd.Series) -> pd.Series:
    return pd.Series([packet_rows(bytes(m or b"")) for m in media], dtype=object)


def store_texts(docs: DataFrame, *, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """``docs`` with an Ogg stream that holds the text's bytes."""
    new_column(docs, media_col)
    return docs.withColumn(media_col, _store(text_or_empty(text_col)))


def demux_packets(frame: DataFrame, *, media_col: str = "media", into: str = "packets") -> DataFrame:
    """``frame`` with all packets of its media column: logical stream, number, time of the end, bytes.  Null media: no packets."""
    new_column(frame, into)
    return frame.withColumn(into, _packets(F.col(media_col)))


def op1_ogg_media(spark, sf_dir: str) -> DataFrame:
    stored = store_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return stored.select("doc_id", _digests("media").alias("x")).select("doc_id", "x.*")
