"""MPEG audio columns: resynchronised frame headers, tags, variable-bitrate tables, checksums, durations, seek offsets.

parse() reads any MPEG-1/2/2.5 Layer I-III stream held in a binary column: it skips an ID3v2 tag, finds the first frame
header that is followed by another one (or by the end), steps from frame to frame by the computed length, and
resynchronises at the next such header where junk lies between. A Xing/Info or VBRI table gives the declared frame and
byte counts and the seek table; CRC-16 of protected Layer III frames is verified, protected Layer I and II frames are
counted as unchecked; an ID3v1 tag ends the stream where the frames end before it. Durations are exact: samples of each frame over the sampling rate, summed as integers.

store() writes bytes losslessly as such a stream: an ID3v2 tag, a table frame, then protected Layer III frames of
48 kHz mono whose side information declares no main data, so a player hears silence and the ancillary part of each
frame carries the payload: 192 bytes a frame, the unit of this format.

Defined results: null bytes count as empty; an empty or frameless stream has no frames and duration zero; a frame cut
off by the end is not counted; repeated rows give equal values.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from .common import per_document, table

UNIT = 192

# Fixed values of the MPEG audio formats (ISO 11172-3, 13818-3): kbit/s by (version 1 or not, layer), index 1 to 14.
BITRATES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    protected: bool
    kbps: int
    rate: int
    mono: bool
    length: int
    samples: int

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        if self.layer != 3:
            return 0
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)


_headers: dict[bytes, Header | None] = {}


def header(b: bytes) -> Header | None:
    """The four bytes as a frame header; None if they aren't one (free format included: its length isn't in it)."""
    if b in _headers:
        return _headers[b]
    out = None
    if len(b) == 4 and b[0] == 0xFF and b[1] & 0xE0 == 0xE0:
        version, layer = b[1] >> 3 & 3, 4 - (b[1] >> 1 & 3)
        bits, freq, pad = b[2] >> 4, b[2] >> 2 & 3, b[2] >> 1 & 1
        if version != 1 and layer < 4 and 0 < bits < 15 and freq < 3:
            kbps, rate = BITRATES[version == 3, layer][bits - 1], RATES[version][freq]
            samples = 384 if layer == 1 else 576 if layer == 3 and version != 3 else 1152
            length = (12000 * kbps // rate + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // rate + pad
            out = Header(version, layer, not b[1] & 1, kbps, rate, b[3] >> 6 == 3, length, samples)
    if len(_headers) < 65536:
        _headers[b] = out
    return out


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


_CRC = _crc_table()
_crcs: dict[bytes, int] = {}


def crc16(data: bytes) -> int:
    """CRC-16 of MPEG audio: polynomial 0x8005, start 0xFFFF, most significant bit first."""
    c = _crcs.get(data)
    if c is None:
        c = 0xFFFF
        for x in data:
            c = (c << 8 ^ _CRC[c >> 8 ^ x]) & 0xFFFF
        if len(_crcs) < 65536:
            _crcs[data] = c
    return c


@dataclass
class Stream:
    frames: int = 0
    samples: int = 0
    duration: Fraction = Fraction(0)
    crc_ok: int = 0
    crc_bad: int = 0
    crc_unchecked: int = 0
    resyncs: int = 0
    skipped: int = 0
    kbps_low: int = 0
    kbps_high: int = 0
    rate: int = 0
    layer: int = 0
    tags: dict[str, str] = field(default_factory=dict)
    declared_frames: int | None = None
    declared_bytes: int | None = None
    toc: tuple[int, ...] = ()
    offsets: list[int] = field(default_factory=list)
    body: list[bytes] = field(default_factory=list)


def _id3v2(data: bytes) -> tuple[int, dict[str, str]]:
    """(bytes of the ID3v2 tag at the start, its text frames)."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0, {}
    def safe(b):
        return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]

    size = safe(data[6:10])
    end, at, tags = min(10 + size, len(data)), 10, {}
    while at + 10 <= end and data[at : at + 1].isalnum():
        name = data[at : at + 4].decode("latin-1")
        n = safe(data[at + 4 : at + 8]) if data[3] >= 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        part = data[at + 10 : at + 10 + n]
        if name[0] == "T" and part:
            code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(part[0], "latin-1")
            tags[name] = part[1:].decode(code, "replace").rstrip("\0")
        at += 10 + n
    return 10 + size + 10 * (data[5] >> 4 & 1), tags


def _vbr(frame: bytes, h: Header) -> tuple[int | None, int | None, tuple[int, ...]] | None:
    """(frames, bytes, seek table) if the frame holds a Xing/Info or VBRI table."""
    at = 4 + 2 * h.protected + h.side
    if frame[at : at + 4] in (b"Xing", b"Info"):
        flags, at = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
        got = []
        for bit in (1, 2):
            got.append(int.from_bytes(frame[at : at + 4], "big") if flags & bit else None)
            at += 4 * bool(flags & bit)
        return got[0], got[1], tuple(frame[at : at + 100]) if flags & 4 else ()
    if frame[36:40] == b"VBRI":
        size, frames, entries, scale, width = *struct.unpack(">II", frame[46:54]), *struct.unpack(">HHH", frame[54:60])
        steps = [int.from_bytes(frame[62 + width * i : 62 + width * (i + 1)], "big") * scale for i in range(entries)]
        return frames, size, tuple(steps)
    return None


def parse(data: bytes | None, keep_body: bool = False) -> Stream:
    data = data or b""
    out = Stream()
    at, out.tags = _id3v2(data)
    end = len(data)
    tag = end - 128 if data[-128:-125] == b"TAG" and len(data) >= 128 else None  # bytes that a frame may still claim
    synced, ticks, kind = False, {}, None
    while at + 4 <= end:
        if at == tag:
            end = tag
            break
        h = header(data[at : at + 4])
        # a frame in sync has its neighbours' version, layer and rate; any other, and one that reaches into what may be
        # a tag, must be followed by a header or end the stream
        same = h is not None and synced and (h.version, h.layer, h.rate) == kind and not (tag and at + h.length > tag)
        if h is None or at + h.length > end or not same and not _followed(data, at + h.length, end):
            skip = data.find(b"\xff", at + 1, end)
            skip = end if skip < 0 else skip
            if tag and at < tag < skip:
                skip = tag
            out.skipped += skip - at
            if synced:
                out.resyncs += 1
            synced, at = False, skip
            continue
        frame = data[at : at + h.length]
        if h.protected and h.layer != 3:
            out.crc_unchecked += 1
        elif h.protected:
            ok = crc16(frame[2:4] + frame[6 : 6 + h.side]) == int.from_bytes(frame[4:6], "big")
            out.crc_ok += ok
            out.crc_bad += not ok
        table_ = _vbr(frame, h) if not out.frames and out.declared_frames is None else None
        if table_:
            out.declared_frames, out.declared_bytes, out.toc = table_
        else:
            out.offsets.append(at)
            out.frames += 1
            out.samples += h.samples
            ticks[h.rate] = ticks.get(h.rate, 0) + h.samples
            out.kbps_low = min(out.kbps_low or h.kbps, h.kbps)
            out.kbps_high = max(out.kbps_high, h.kbps)
            out.rate, out.layer = h.rate, h.layer
            if keep_body:
                out.body.append(frame[4 + 2 * h.protected + h.side :])
        synced, at, kind = True, at + h.length, (h.version, h.layer, h.rate)
    out.skipped += max(0, end - at)
    if tag is not None and end == tag:
        for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93)):
            if text := data[end + a : end + b].split(b"\0")[0].decode("latin-1").strip():
                out.tags.setdefault(f"v1:{name}", text)
    out.duration = sum((Fraction(n, rate) for rate, n in ticks.items()), Fraction(0))
    return out


def _followed(data: bytes, at: int, end: int) -> bool:
    """Whether a frame that ends here is followed by another header, or by the end."""
    return at >= end or header(data[at : at + 4]) is not None


# The frames of store(): MPEG-1 Layer III, protected, 80 kbit/s, 48 kHz, mono: 240 bytes, of which 4 header, 2 checksum,
# 17 side information and 217 others; 192 of these are payload.
_HEAD = bytes((0xFF, 0xFA, 0x64, 0xC0))
_FRAME = 240
_SIDE = bytes(17)
_LEAD = _HEAD + crc16(_HEAD[2:] + _SIDE).to_bytes(2, "big") + _SIDE
_PAD = bytes(_FRAME - len(_LEAD) - UNIT)


def store(payload: bytes, title: str = "payload") -> bytes:
    """The payload, a positive multiple of 192 bytes, as an MPEG audio stream."""
    if not payload or len(payload) % UNIT:
        raise ValueError(f"a positive multiple of {UNIT} bytes is needed")
    n = len(payload) // UNIT
    text = b"\x03" + title.encode()
    body = b"TIT2" + len(text).to_bytes(4, "big") + b"\0\0" + text
    size = len(body)
    tag = b"ID3\x03\0\0" + bytes((size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127)) + body
    toc = bytes(min(255, (i * n // 100 + 1) * 256 // (n + 1)) for i in range(100))
    vbr = _LEAD + b"Info" + struct.pack(">III", 7, n, (n + 1) * _FRAME) + toc
    frames = b"".join([x for i in range(0, len(payload), UNIT) for x in (_LEAD, payload[i : i + UNIT], _PAD)])
    return tag + vbr + bytes(_FRAME - len(vbr)) + frames


def load(data: bytes) -> tuple[bytes, Stream]:
    """(payload of a stream that store() has written, what parse() found); an error if any frame is missing or damaged."""
    found = parse(data, keep_body=True)
    if found.frames != found.declared_frames or len(data) != found.offsets[-1] + _FRAME or found.crc_bad or found.skipped or found.resyncs:
        raise ValueError(f"{found.frames} of {found.declared_frames} frames, {found.crc_bad} bad checksums, {found.skipped} bytes skipped")
    return b"".join([b[:UNIT] for b in found.body]), found


def seek(found: Stream, seconds: Fraction | float) -> int | None:
    """Byte offset of the frame that plays at a time, for streams of one sampling rate."""
    if not found.frames or seconds < 0 or seconds >= found.duration:
        return None
    return found.offsets[int(Fraction(seconds) * found.rate / (found.samples // found.frames))]


def describe(docs: DataFrame, id_col: str = "media_id", data: str = "media") -> DataFrame:
    """What parse() finds in a binary column, a row for each row; duration as a fraction of integers and in seconds."""

    def run(cols):
        got = [parse(x) for x in cols[data]]
        names = ("frames", "samples", "crc_ok", "crc_bad", "crc_unchecked", "resyncs", "skipped", "kbps_low", "kbps_high", "rate", "layer", "declared_frames", "declared_bytes", "toc", "offsets")
        out = {k: [getattr(g, k) for g in got] for k in names}
        return out | {"media_id": cols[id_col], "toc": [list(g.toc) for g in got], "tags": [list(g.tags.items()) for g in got], "duration_num": [g.duration.numerator for g in got], "duration_den": [g.duration.denominator for g in got], "seconds": [float(g.duration) for g in got]}

    schema = "media_id long, frames long, samples long, crc_ok long, crc_bad long, crc_unchecked long, resyncs long, skipped long, kbps_low int, kbps_high int, rate int, layer int, declared_frames long, declared_bytes long, toc array<int>, offsets array<long>, tags map<string,string>, duration_num long, duration_den long, seconds double"
    return per_document(docs, [id_col, data], run, schema)


def stored(docs: DataFrame) -> DataFrame:
    """Each text's UTF-8, padded with spaces to a positive multiple of 192, as a stream: doc_id, n_bytes, media."""

    def run(cols):
        raw = [(t or "").encode() for t in cols["text"]]
        return {"doc_id": cols["doc_id"], "n_bytes": [len(b) for b in raw], "media": [store(b.ljust(max(UNIT, -(-len(b) // UNIT) * UNIT))) for b in raw]}

    return per_document(docs, ["doc_id", "text"], run, "doc_id long, n_bytes long, media binary")


def read_back(media: DataFrame) -> DataFrame:
    """Payload digests and features of stored streams."""

    def run(cols):
        rows = []
        for doc_id, n, data in zip(cols["doc_id"], cols["n_bytes"], cols["media"], strict=True):
            payload, f = load(data)
            last = zlib.crc32(struct.pack(f"<{len(f.offsets) + 1}Q", *f.offsets, len(data)))
            what = f"mpeg1-layer{f.layer} {f.rate}Hz {f.kbps_low}-{f.kbps_high}kbps frames={f.frames}/{f.declared_frames} samples={f.samples} duration={f.duration} crc_ok={f.crc_ok} crc_bad={f.crc_bad} crc_unchecked={f.crc_unchecked} resyncs={f.resyncs} skipped={f.skipped} seek_crc32={last:08x} body_crc32={zlib.crc32(payload):08x}"
            rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), what))
        names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
        return dict(zip(names, zip(*rows, strict=True), strict=True)) if rows else {}

    return per_document(media, ["doc_id", "n_bytes", "media"], run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op10_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(stored(table(spark, sf_dir, "documents")))
