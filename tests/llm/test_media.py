import hashlib
import random
import struct
import zlib

import pytest

from textquarry.llm import mpeg_audio as M


def test_odd_rows(odd, none):
    rows = M.media_query(odd).collect()
    assert len(rows) == odd.count()
    texts = {}
    for r in odd.collect():
        texts.setdefault(r["doc_id"], r["text"])
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert "crc_wrong=0;skipped=0" in r["feature"]
    same = [tuple(r) for r in rows if r["doc_id"] in (1, 9)]
    assert len({x[1:] for x in same}) == 1
    assert M.media_query(none).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 100])
def test_payloads_that_look_like_frames(n):
    payload = random.Random(n).choice([bytes([255, 0xF2, 0xD8, 0xC0]), b"ID3\x04", b"TAG", b"\xff\xfb\x90\x00"]) * 144 * n
    media = M.wrap(payload)
    audio = M.parse(media)
    assert M.unwrap(media, audio) == payload and audio.vbr["frames"] == len(payload) // 576 and audio.tags == {"TIT2": "payload"}


def test_damage_is_skipped_and_counted():
    media = bytearray(M.wrap(b"x" * 576 * 12))
    frames = M.parse(bytes(media)).offsets
    media[frames[3] + 8] ^= 255  # side information under the checksum
    cut = bytes(media[: frames[6]]) + b"\xff\xfajunk\xff" + bytes(media[frames[6] :])
    audio = M.parse(cut)
    assert audio.crc_wrong == 1 and audio.skipped == 7 and len(audio.offsets) >= 11
    for junk in (b"", b"\xff", b"\xff" * 5000, b"ID3", b"TAG", bytes(range(256)) * 9):
        M.parse(junk)


def frame(head, size):
    return head + bytes(size - 4)


def test_other_layers_rates_and_tables():
    mpeg1 = bytes((0xFF, 0xFB, 0x90, 0xC4))  # layer III, 128 kbit/s, 44.1 kHz, mono
    audio = M.parse(b"".join(frame(mpeg1, 417) for _ in range(5)) + b"TAG" + b"Song".ljust(125, b"\0"))
    assert audio.duration == (5 * 1152, 44100) and audio.tags["ID3v1.TITLE"] == "Song" and audio.skipped == 0
    layer1 = bytes((0xFF, 0xFF, 0x40, 0x00))  # MPEG 1, layer I, 128 kbit/s, 44.1 kHz
    assert M.parse(frame(layer1, 136) * 3).duration == (3 * 384, 44100)
    layer2 = bytes((0xFF, 0xFD, 0x80, 0x00))  # MPEG 1, layer II, 128 kbit/s
    assert M.parse(frame(layer2, 417) * 3).duration == (3 * 1152, 44100)
    vbri = bytearray(frame(mpeg1, 417))
    vbri[36:40] = b"VBRI"
    struct.pack_into(">IIHHHH", vbri, 46, 9999, 7, 2, 1, 2, 4)
    vbri[62:66] = struct.pack(">HH", 10, 20)
    audio = M.parse(bytes(vbri) + frame(mpeg1, 417) * 4)
    assert audio.vbr == {"kind": "VBRI", "frames": 7, "bytes": 9999, "toc": [10, 20], "step": 4} and len(audio.offsets) == 4
    mixed = frame(mpeg1, 417) + frame(bytes((0xFF, 0xFB, 0xB0, 0xC4)), 626) + frame(mpeg1, 417)
    assert M.parse(mixed).offsets.tolist() == [0, 417, 1043]


def test_media_columns(spark):
    df = spark.createDataFrame([(1, bytearray(M.wrap(b"a" * 1152))), (2, None)], "id int, media binary")
    rows = {r["id"]: r["audio"] for r in M.media_columns(df).collect()}
    assert rows[1]["frames"] == 2 and rows[1]["samples"] == 1152 and len(rows[1]["offsets"]) == 2 and rows[2]["frames"] == 0


def bitwise_crc(bits):
    crc = 0xFFFF
    for bit in bits:
        crc = ((crc << 1) & 0xFFFF) ^ (0x8005 if (crc >> 15) ^ bit else 0)
    return crc


def with_crc(head, size, covered):
    """A frame of random bytes whose checksum covers so many bits behind it."""
    body = random.Random(size + covered).randbytes(size - 6)
    bits = [b >> (7 - k) & 1 for b in head[2:4] + body for k in range(8)][: 16 + covered]
    return head + bitwise_crc(bits).to_bytes(2, "big") + body


def test_checksums_of_layers_one_and_two():
    # layer I: 4 bits a subband and channel; in joint stereo one for both from the bound on
    for head, covered in ((bytes((0xFF, 0xFE, 0x40, 0x00)), 256), (bytes((0xFF, 0xFE, 0x40, 0xC0)), 128), (bytes((0xFF, 0xFE, 0x40, 0x50)), 4 * (2 * 8 + 24))):
        frames = with_crc(head, 136, covered) * 3
        assert (M.parse(frames).crc_checked, M.parse(frames).crc_wrong) == (3, 0)
        damaged = bytearray(frames)
        damaged[8] ^= 1
        assert M.parse(bytes(damaged)).crc_wrong == 1
    # layer II at 128 kbit/s and 44.1 kHz, mono: 94 bits in 30 subbands, and two for each that has samples
    head = bytes((0xFF, 0xFC, 0x80, 0xC0))
    widths = [4] * 11 + [3] * 12 + [2] * 7
    for seed in range(20):
        chosen = [random.Random(seed * 99 + k).randrange(2**n) * (k % 3 > 0) for k, n in enumerate(widths)]
        bits = [v >> (n - 1 - b) & 1 for v, n in zip(chosen, widths, strict=True) for b in range(n)] + [1, 0] * sum(map(bool, chosen))
        raw = [b >> (7 - k) & 1 for b in head[2:4] for k in range(8)] + bits
        padded = bits + [1] * (8 * 411 - len(bits))
        body = bytes(sum(padded[8 * k + b] << (7 - b) for b in range(8)) for k in range(411))
        frame_ = head + bitwise_crc(raw).to_bytes(2, "big") + body
        audio = M.parse(frame_ * 2)
        assert (audio.crc_checked, audio.crc_wrong) == (2, 0)


def test_damaged_tables():
    mpeg1 = bytes((0xFF, 0xFB, 0x90, 0xC4))
    small = bytes((0xFF, 0xF3, 0x14, 0xC4))  # MPEG 2, 8 kbit/s, 24 kHz: frames of 24 bytes
    short = bytearray(bytes((0xFF, 0xF3, 0x28, 0xC4)) + bytes(68))  # 16 kbit/s, 16 kHz: 72 bytes
    short[36:40] = b"VBRI"
    struct.pack_into(">IIHHHH", short, 46, 1, 2, 60_000, 1, 4, 1)
    assert M.parse(bytes(short) * 3).vbr["toc"] == [0, 0]
    tiny = bytearray(bytes((0xFF, 0xF3, 0x18, 0xC4)) + bytes(32))  # 36 bytes, then what looks like a table
    assert M.parse(bytes(tiny) + b"VBRI").vbr == {}
    assert M.parse(frame(small, 24) * 4).samples == 4 * 576
    for at in range(4, 60):
        for mark in (b"Xing", b"Info", b"VBRI"):
            bad = bytearray(b"\xff" * 417)
            bad[:4], bad[at : at + 4] = mpeg1, mark
            M.parse(bytes(bad) + frame(mpeg1, 417) * 2)
            M.parse(bytes(bad[: at + 9]))


def test_delay_and_padding_are_no_music():
    info = bytearray(frame(bytes((0xFF, 0xFB, 0x90, 0xC4)), 417))
    info[21:29] = b"Info" + (1).to_bytes(4, "big")
    info[29:33] = (5).to_bytes(4, "big")
    info[33:42] = b"LAME3.100"
    info[54:57] = (576 << 12 | 1000).to_bytes(3, "big")
    audio = M.parse(bytes(info) + frame(bytes((0xFF, 0xFB, 0x90, 0xC4)), 417) * 5)
    assert audio.duration == (5 * 1152 - 576 - 1000, 44100) and audio.vbr["frames"] == 5


def test_tags_of_all_versions():
    frames = frame(bytes((0xFF, 0xFB, 0x90, 0xC4)), 417) * 2
    old = b"TT2" + (6).to_bytes(3, "big") + b"\0Title"
    assert M.parse(b"ID3\x02\0\0" + bytes((0, 0, 0, len(old))) + old + frames).tags == {"TT2": "Title"}
    title = b"TIT2" + (8).to_bytes(4, "big") + b"\0\0" + b"\x01\xff\xfe" + "Té"[:2].encode("utf-16-le") + b"\0"
    for extended, flags in ((b"", 0), ((6).to_bytes(4, "big") + bytes(6), 64)):
        body = extended + title
        assert M.parse(b"ID3\x03\0" + bytes((flags, 0, 0, 0, len(body))) + body + frames).tags["TIT2"][:2] == "Té"
    stuffed = title.replace(b"\xff", b"\xff\0")
    assert M.parse(b"ID3\x03\0" + bytes((128, 0, 0, 0, len(stuffed))) + stuffed + frames).tags["TIT2"][:2] == "Té"
    new = b"TPE1" + bytes((0, 0, 0, 9)) + b"\0\x01" + bytes(4) + b"\x03Band"
    assert M.parse(b"ID3\x04\0\0" + bytes((0, 0, 0, len(new))) + new + frames).tags == {"TPE1": "Band"}
