"""Media columns for MPEG audio (MPEG 1, 2 and 2.5; layers I to III).

``parse`` reads the bytes of a file: tags at either end (ID3v2, ID3v1, APE), the variable-bitrate tables Xing/Info and
VBRI, and all frames. Headers are found again after damage: a frame counts only if another header of its stream, or the
end, follows where its length says. CRC-16 is verified where frames carry it, in all three layers. Durations are exact, in
samples and sample rate, without the encoder's delay and padding where its tag says them; the offset of every frame is kept
for seeking. Tables and tags that are cut off or damaged are read as far as they go.

``wrap`` stores any bytes without loss as the ancillary data of silent MPEG-2 layer III frames (16 kHz, 144 kbit/s, mono,
with CRC): UNIT bytes to a frame of 576 samples, behind an ID3v2 tag and an Info frame with a table of seek points.
``unwrap`` gives them back.

Defined cases: a null text is an empty one, stored as one frame of padding. Bytes without frames parse to none. Equal
bytes give equal results.
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

from .common import lean, small_batches, stored, text_of

UNIT = 576
#: Fixed values of the standard. Rates in kbit/s by (MPEG 1?, layer), sample rates by version bits.
BIT_RATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


@dataclass(frozen=True)
class Header:
    version: int  # bits: 3 MPEG 1, 2 MPEG 2, 0 MPEG 2.5
    layer: int
    crc: bool
    kbps: int
    rate: int
    padding: int
    mono: bool

    @property
    def samples(self) -> int:
        return 384 if self.layer == 1 else 1152 if self.layer == 2 or self.version == 3 else 576

    @property
    def size(self) -> int:
        if self.layer == 1:
            return (12000 * self.kbps // self.rate + self.padding) * 4
        return self.samples // 8 * 1000 * self.kbps // self.rate + self.padding

    @property
    def side_info(self) -> int:
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)

    def same_stream(self, other: Header) -> bool:
        return (self.version, self.layer, self.rate) == (other.version, other.layer, other.rate)


def header(data: bytes, at: int) -> Header | None:
    if at + 4 > len(data) or data[at] != 255 or data[at + 1] & 224 != 224:
        return None
    b1, b2, b3 = data[at + 1 : at + 4]
    version, layer = b1 >> 3 & 3, 4 - (b1 >> 1 & 3)
    if version == 1 or layer == 4 or b2 >> 4 in (0, 15) or b2 >> 2 & 3 == 3 or b3 & 3 == 2:
        return None  # reserved values; free format has no lengths to go by
    kbps = BIT_RATES[version == 3, layer][b2 >> 4]
    return Header(version, layer, not b1 & 1, kbps, SAMPLE_RATES[version][b2 >> 2 & 3], b2 >> 1 & 1, b3 >> 6 == 3)


def crc16(data: bytes) -> int:
    """CRC-16 of MPEG audio: polynomial 0x8005, from ones, most significant bit first."""
    crc = 0xFFFF
    for byte in data:
        crc = (crc << 8 & 0xFFFF) ^ CRC16[crc >> 8 ^ byte]
    return crc


def _crc16_table() -> list[int]:
    table = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
        table.append(crc)
    return table


CRC16 = _crc16_table()


#: Fixed values of the standard: bits of the allocation of each subband in layer II, by table.
ALLOCATION_BITS = {
    "a": (4,) * 11 + (3,) * 12 + (2,) * 4,
    "b": (4,) * 11 + (3,) * 12 + (2,) * 7,
    "c": (4,) * 2 + (3,) * 6,
    "d": (4,) * 2 + (3,) * 10,
    "half": (4,) * 4 + (3,) * 7 + (2,) * 19,  # sample rates of MPEG 2
}


def allocation_bits(h: Header) -> tuple[int, ...]:
    if h.version != 3:
        return ALLOCATION_BITS["half"]
    each = h.kbps // (1 if h.mono else 2)
    if each <= 48:
        return ALLOCATION_BITS["d" if h.rate == 32000 else "c"]
    return ALLOCATION_BITS["a" if h.rate == 48000 or each <= 80 else "b"]


def protected_bits(h: Header, frame: bytes) -> int:
    """How many bits behind the CRC it covers: side information of layer III, allocations of layer I, and of layer II with the
    two bits of each subband that has one."""
    if h.layer == 3:
        return 8 * h.side_info
    channels, bound = 1 if h.mono else 2, 32
    if frame[3] >> 6 == 1:  # joint stereo: one allocation for both channels from the bound on
        bound = 4 * (1 + (frame[3] >> 4 & 3))
    if h.layer == 1:
        return 4 * (channels * bound + 32 - bound)
    bits, at, chosen = int.from_bytes(frame[6:70].ljust(64, b"\0"), "big"), 0, 0
    for k, n in enumerate(allocation_bits(h)):
        for _ in range(channels if k < bound else 1):
            at += n
            if bits >> (512 - at) & ((1 << n) - 1):
                chosen += channels if k >= bound else 1
    return at + 2 * chosen


def crc_holds(h: Header, frame: bytes) -> bool:
    n = protected_bits(h, frame)
    if 6 + -(-n // 8) > len(frame):
        return False
    crc = crc16(frame[2:4] + frame[6 : 6 + n // 8])
    for k in range(n % 8):  # what is left of the last byte
        bit = frame[6 + n // 8] >> (7 - k) & 1
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if crc >> 15 ^ bit else 0)
    return crc == int.from_bytes(frame[4:6], "big")


@dataclass
class Audio:
    tags: dict[str, str] = field(default_factory=dict)
    vbr: dict[str, object] = field(default_factory=dict)
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    first: Header | None = None
    samples: int = 0
    bytes_of_frames: int = 0
    crc_checked: int = 0
    crc_wrong: int = 0
    skipped: int = 0

    @property
    def duration(self) -> tuple[int, int]:
        """Samples and samples a second."""
        return max(0, self.samples - self.vbr.get("delay", 0) - self.vbr.get("padding", 0)), self.first.rate if self.first else 1


def _seven_bits(data: bytes) -> int:
    return sum((b & 127) << 7 * (len(data) - 1 - k) for k, b in enumerate(data))


def _id3v2(data: bytes, tags: dict[str, str]) -> int:
    """Text frames of an ID3 tag of version 2.2 to 2.4, and where it ends."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    major, flags, size = data[3], data[5], 10 + _seven_bits(data[6:10])
    body, at = data[10 : min(size, len(data))], 0
    if flags & 128 and major < 4:
        body = body.replace(b"\xff\0", b"\xff")
    if flags & 64 and major == 3:
        at = 4 + int.from_bytes(body[:4], "big")
    elif flags & 64 and major == 4:
        at = _seven_bits(body[:4])
    named, head = (3, 6) if major == 2 else (4, 10)
    while at + head <= len(body) and body[at] in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        name, length = body[at : at + named].decode("latin-1"), body[at + named : at + 2 * named]
        n = _seven_bits(length) if major == 4 else int.from_bytes(length, "big")
        held, kind = body[at + head : at + head + n], body[at + 9] if major == 4 else 0
        if kind & 1:  # behind four bytes of length
            held = held[4:]
        if kind & 2 or major == 4 and flags & 128:
            held = held.replace(b"\xff\0", b"\xff")
        if name[0] == "T" and held:
            codec = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(held[0], "latin-1")
            tags[name] = held[1:].decode(codec, "replace").rstrip("\0")
        at += head + n
    return min(len(data), size + (10 if flags & 16 else 0))


def _tail_tags(data: bytes, tags: dict[str, str]) -> int:
    """Where the frames end."""
    end = len(data)
    if end >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for name, a, b in (("TITLE", 3, 33), ("ARTIST", 33, 63), ("ALBUM", 63, 93), ("YEAR", 93, 97)):
            tags[f"ID3v1.{name}"] = data[end + a : end + b].decode("latin-1").rstrip("\0 ")
    if end >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size, flags = struct.unpack_from("<I", data, end - 20)[0], struct.unpack_from("<I", data, end - 12)[0]
        end = max(0, end - size - (32 if flags >> 31 else 0))
        tags["APE"] = str(size)
    return end


def _vbr(data: bytes, at: int, h: Header) -> dict[str, object]:
    frame = data[at : at + h.size]
    place = 4 + (2 if h.crc else 0) + h.side_info
    for mark_at in (place, 4 + h.side_info):
        if (mark := frame[mark_at : mark_at + 4]) in (b"Xing", b"Info") and mark_at + 8 <= len(frame):
            flags, p, out = int.from_bytes(frame[mark_at + 4 : mark_at + 8], "big"), mark_at + 8, {"kind": mark.decode()}
            for bit, name, n in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
                if flags & bit and p + n <= len(frame):
                    out[name] = list(frame[p : p + n]) if bit == 4 else int.from_bytes(frame[p : p + n], "big")
                p += n if flags & bit else 0
            if frame[p : p + 4] in (b"LAME", b"Lavc", b"Lavf", b"GOGO") and p + 24 <= len(frame):
                both = int.from_bytes(frame[p + 21 : p + 24], "big")
                out["delay"], out["padding"] = both >> 12, both & 0xFFF
            return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, n, scale, width, step = struct.unpack_from(">IIHHHH", frame, 46)
        n = min(n, (len(frame) - 62) // width) if width else 0
        table = [int.from_bytes(frame[62 + k * width : 62 + (k + 1) * width], "big") * scale for k in range(n)]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": table, "step": step}
    return {}


def _run(data: np.ndarray, at: int, size: int, end: int) -> int:
    """How many frames of one size from at on have the first one's header; those need no look at each."""
    n = (end - at) // size
    heads = data[at : at + n * size].reshape(n, size)[:, :4]
    other = np.flatnonzero((heads != heads[0]).any(1))
    return int(other[0]) if len(other) else n


def parse(data: bytes) -> Audio:
    audio = Audio()
    at, end = _id3v2(data, audio.tags), _tail_tags(data, audio.tags)
    array, offsets = np.frombuffer(data, np.uint8), []
    started = False
    while at + 4 <= end:
        h = header(data, at)
        follows = h and at + h.size <= end and (at + h.size == end or (nxt := header(data, at + h.size)) is not None and h.same_stream(nxt))
        if not h or not follows or audio.first and not h.same_stream(audio.first):
            found = data.find(b"\xff", at + 1, end)
            audio.skipped += (found if found >= 0 else end) - at
            at = found if found >= 0 else end
            continue
        if not started:
            started = True
            audio.first = h
            audio.vbr = _vbr(data, at, h)
            if audio.vbr:
                at += h.size
                continue
        n = max(1, _run(array, at, h.size, end))
        offsets.append(at + h.size * np.arange(n))
        audio.samples += n * h.samples
        audio.bytes_of_frames += n * h.size
        if h.crc:
            covered = min(h.size, 6 + (h.side_info if h.layer == 3 else 64))
            frames = array[at : at + n * h.size].reshape(n, h.size)[:, :covered]
            kinds, count = np.unique(frames, axis=0, return_counts=True)
            for kind, times in zip(kinds, count.tolist(), strict=True):
                audio.crc_checked += times
                audio.crc_wrong += times * (not crc_holds(h, kind.tobytes()))
        at += n * h.size
    if audio.skipped == 0 and at < end:
        audio.skipped = end - at
    audio.offsets = np.concatenate(offsets) if offsets else audio.offsets
    return audio


def _frame_head() -> bytes:
    head = bytes((0xFF, 0xF2, 13 << 4 | 2 << 2, 3 << 6))  # MPEG 2, layer III, CRC, 144 kbit/s, 16 kHz, mono
    side = bytes(9)
    return head + crc16(head[2:] + side).to_bytes(2, "big") + side


FRAME_HEAD = _frame_head()
FRAME = 648


def wrap(payload: bytes) -> bytes:
    """payload, a multiple of UNIT bytes, as an MPEG audio file."""
    n = len(payload) // UNIT
    frames = np.zeros((n + 1, FRAME), np.uint8)
    frames[:, : len(FRAME_HEAD)] = np.frombuffer(FRAME_HEAD, np.uint8)
    frames[1:, len(FRAME_HEAD) : len(FRAME_HEAD) + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    toc = bytes((1 + k * n // 100) * 256 // (n + 1) for k in range(100))
    info = b"Info" + struct.pack(">III", 7, n, (n + 1) * FRAME) + toc
    frames[0, len(FRAME_HEAD) : len(FRAME_HEAD) + len(info)] = np.frombuffer(info, np.uint8)
    title = b"\x03payload"
    tag = b"TIT2" + len(title).to_bytes(4, "big") + b"\0\0" + title
    return b"ID3\x04\0\0" + bytes((0, 0, 0, len(tag))) + tag + frames.tobytes()


def unwrap(data: bytes, audio: Audio) -> bytes:
    """What wrap() stored, from the frames that parse() found."""
    array = np.frombuffer(data, np.uint8)
    at = audio.offsets[:, None] + len(FRAME_HEAD)
    if len(audio.offsets) and np.array_equal(np.diff(audio.offsets), np.full(len(audio.offsets) - 1, FRAME)):
        start = int(audio.offsets[0])
        return array[start : start + FRAME * len(audio.offsets)].reshape(-1, FRAME)[:, len(FRAME_HEAD) : len(FRAME_HEAD) + UNIT].tobytes()
    return array[at + np.arange(UNIT)].tobytes()


def payload_of(text: str) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    return raw + b"\xff" * ((-len(raw)) % UNIT if raw else UNIT)


def features(audio: Audio) -> str:
    samples, rate = audio.duration
    steps = np.unique(np.diff(audio.offsets)).tolist()
    first = int(audio.offsets[0]) if len(audio.offsets) else -1
    return f"frames={len(audio.offsets)};samples={samples};rate={rate};layer={audio.first.layer if audio.first else 0};crc_ok={audio.crc_checked - audio.crc_wrong};crc_wrong={audio.crc_wrong};skipped={audio.skipped};vbr={audio.vbr.get('kind', '')}:{audio.vbr.get('frames', 0)};first={first};steps={','.join(map(str, steps[:4]))}"


def store_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of docs' texts, written and to be read from the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            media = [wrap(payload_of(t)) for t in texts]
            sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    small_batches(docs.sparkSession, 256, "4m")
    made = text_of(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), "doc_id").mapInArrow(lean(run), "doc_id bigint, n_bytes bigint, media binary")
    return stored(made, "media", compression="zstd")


def media_columns(media: DataFrame, column: str = "media") -> DataFrame:
    """Each row of media with the struct ``audio``: tags, samples, rate, frame offsets and checks of an MPEG audio column."""
    kind = "struct<samples:bigint,rate:bigint,frames:bigint,offsets:array<bigint>,tags:map<string,string>,vbr:string,crc_checked:bigint,crc_wrong:bigint,skipped:bigint>"

    @F.pandas_udf(kind)
    def parsed(data):  # noqa: ANN001, ANN202
        import pandas as pd

        rows = []
        for x in data:
            a = parse(x or b"")
            rows.append((*a.duration, len(a.offsets), a.offsets.tolist(), a.tags, a.vbr.get("kind"), a.crc_checked, a.crc_wrong, a.skipped))
        return pd.DataFrame(rows, columns=["samples", "rate", "frames", "offsets", "tags", "vbr", "crc_checked", "crc_wrong", "skipped"])

    small_batches(media.sparkSession, 256, "4m")
    return media.withColumn("audio", parsed(F.col(column)))


def media_query(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, n, media in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                audio = parse(media)
                payload = unwrap(media, audio)
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(audio)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    media = store_media(docs)
    small_batches(docs.sparkSession, 256, "4m")
    return media.mapInArrow(lean(run), "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
