"""Every format's validator on a whole file, on cut ones and on files inside other bytes; whole and stored texts."""

from __future__ import annotations

import random
import struct
import time
import zlib

import pytest
from ledgerloom.llm import media
from ledgerloom.llm.common import ship
from pyspark.sql import functions as F


def _flac(frames: int = 3) -> bytes:
    """16 samples a frame, each frame constant."""
    info = struct.pack(">HH", 16, 16) + b"\0" * 6 + ((8000 << 44) | (0 << 41) | (7 << 36) | (16 * frames)).to_bytes(8, "big") + b"\0" * 16
    out = b"fLaC" + bytes([0]) + (34).to_bytes(3, "big") + info + bytes([0x81]) + (5).to_bytes(3, "big") + b"\0" * 5
    table = media._crc16_table()
    for k in range(frames):
        head = bytes([0xFF, 0xF8, 0x60, 0x00, k, 15])
        frame = head + bytes([media._crc8(head)]) + bytes([0x00, 40 + k])
        crc = 0
        for x in frame:
            crc = (crc << 8 & 0xFF00) ^ table[crc >> 8 ^ x]
        out += frame + crc.to_bytes(2, "big")
    return out


def _jpeg() -> bytes:
    return b"\xff\xd8" + b"\xff\xe0" + (16).to_bytes(2, "big") + b"JFIF\0" + b"\0" * 9 + b"\xff\xda" + (8).to_bytes(2, "big") + b"\0" * 6 + b"data\xff\x00more\xff\xd0x\xff\xd9"


def _bmp() -> bytes:
    return b"BM" + struct.pack("<IIIIiiHH", 54 + 8, 0, 54, 40, 2, 1, 1, 24) + b"\0" * 24 + b"\1" * 8


WHOLE = {"audio/flac": _flac(), "image/jpeg": _jpeg(), "image/bmp": _bmp(), "audio/wav": media.wav(b"abc")}


@pytest.mark.parametrize("kind", sorted(WHOLE))
def test_formats(kind):
    whole = WHOLE[kind]
    assert media.sniff(whole) == [(0, len(whole), kind)]
    assert media.sniff(b"before" + whole + b"after fLaC BM \xff\xd8\xff") == [(6, len(whole), kind)]
    assert all(media.sniff(whole[:k]) == [] for k in range(len(whole)))
    assert media.inspect(whole, "text/plain") == (kind, [])


def test_changed_bytes_of_a_frame_are_refused():
    whole = _flac()
    for k in range(len(whole) - 30, len(whole)):
        assert media.sniff(whole[:k] + bytes([whole[k] ^ 1]) + whole[k + 1 :]) == []


def test_many_magic_bytes_in_a_long_text():
    assert media.sniff(b"fLaC RIFF BM GIF89a \xff\xd8\xff" * 40_000) == []


def test_stored_columns(spark):
    ship(spark)
    docs = spark.createDataFrame([(1, "x" * 3_000_000), (2, None), (3, ""), (3, "same"), (3, "same")], "doc_id long, text string").withColumn("media", F.lit(1)).withColumn("declared", F.lit(2))
    got = media.media_features(media.store(docs)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.payload_bytes) for r in got) == [(1, 3_000_000, 3_000_000), (2, 0, 64), (3, 0, 64), (3, 4, 64), (3, 4, 64)]
    null = media.store(docs).withColumn("media", F.lit(None).cast("binary"))
    assert {(r.payload_bytes, r.media_bytes) for r in media.media_features(null).collect()} == {(0, 0)}


def _chunk(kind: bytes, data: bytes) -> bytes:
    return len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")


IHDR = b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", b"\0\0\0\1\0\0\0\1\x08\0\0\0\0")
SIZE = 4_000_000


def _times(unit: bytes, size: int = SIZE) -> bytes:
    return unit * (size // len(unit))


def _far(head: bytes) -> bytes:
    """Units that each begin a chunk which reaches to the same place near the end, with a wrong checksum."""
    n = len(head) + 8
    return b"".join(head + (SIZE - k * n - len(head) - 20).to_bytes(4, "big") + b"tEXt" for k in range(SIZE // n - 2))


#: Each format's worst blobs: chains from very many starts, that run together or never end.
WORST = {
    "gif of text": _times(b"GIF89aAAAAAAA!A"), "gif of short parts": _times(b"GIF89aAAAA\0AA!A" + b"\1A" * 40), "gif of images": _times(b"GIF87aAAAA\0AA,AAAAAAAAA\0"), "gif of parts": b"GIF89aAAAA\0AA!A" * 1000 + b"\1A" * 1_900_000,
    "wav in chunks": _times(b"AAAA\x0c\0\0\0RIFF\0\0\x1f\0WAVE"), "wav of empty chunks": b"RIFF\0\0\x1f\0WAVE" * 1000 + b"AAAA\0\0\0\0" * 450_000, "png in text": _times(IHDR + _chunk(b"tEXt", b"a" * 20)), "png with far checksums": _far(IHDR),
    "flac blocks": _times(b'fLaC\0\0\0"' + b"\0" * 34 + b"\1\0\0\4abcd"), "jpeg scans": _times(b"\xff\xd8\xff\xda\0\2"), "jpeg segments": _times(b"\xff\xd8\xff\xe0\0\4ab"), "bmp": _times(b"BM\0\0"), "magic": _times(b"fLaC RIFF BM GIF89a \xff\xd8\xff"),
}


@pytest.mark.parametrize("name", sorted(WORST))
def test_worst_blobs_take_linear_time(name):
    began = time.process_time()
    found = media.sniff(WORST[name])
    assert time.process_time() - began < 30 and all(m.offset + m.length <= len(WORST[name]) for m in found)


def _plain_gif(b, at):
    """Block by block, from this start alone."""
    k = at + 13 + (3 << ((b[at + 10] & 7) + 1) if at + 13 <= len(b) and b[at + 10] & 0x80 else 0)
    while at + 13 <= len(b) and k < len(b):
        if b[k] == 0x3B:
            return k + 1 - at
        if b[k] == 0x21:
            k += 2
        elif b[k] == 0x2C and k + 10 < len(b):
            k += 11 + (3 << ((b[k + 9] & 7) + 1) if b[k + 9] & 0x80 else 0)
        else:
            return 0
        while k < len(b) and b[k]:
            k += b[k] + 1
        if k >= len(b):
            return 0
        k += 1
    return 0


def test_merged_chains_equal_single_ones():
    """Blobs made of pieces of media: what is found from all starts together is what each start gives alone."""
    r = random.Random(9)
    gif = b"GIF89a\1\0\1\0\x80\0\0\0\0\0\xff\xff\xff\x2c\0\0\0\0\1\0\1\0\0\2\2D\1\0;"
    pieces = [gif, gif[:-1], gif[:20], b"!A\2ab\0", b"\0", b";", b",", b"GIF87a" + b"\0" * 7, media.wav(b"abcd"), media.wav(b"x" * 9)[:30], IHDR, IHDR + _chunk(b"IEND", b""), _chunk(b"tEXt", b"ab"), _chunk(b"IEND", b""), _flac(), _jpeg(), _bmp(), b"text", b"\xff\xd8\xff\xda\0\2", b"\xff\xd9"]
    some = 0
    for _ in range(400):
        blob = b"".join(r.choice(pieces) for _ in range(r.randrange(1, 14)))
        found = media.sniff(blob)
        alone = []
        for last, (n, kind) in media.automaton().iter(blob.decode("latin-1")):
            at = last - n + 1
            if length := media.VALID[kind](blob, at, media.Chains(blob)):
                alone.append((at, length, kind))
            if kind == "image/gif":
                assert _plain_gif(blob, at) == next((m.length for m in found if m.offset == at), 0)
        assert found == alone
        some += len(found)
    assert some > 500


def test_checksums_of_long_ranges():
    r = random.Random(2)
    blob = r.randbytes(200_000)
    chains = media.Chains(blob)
    for _ in range(200):
        a, z = sorted(r.randrange(len(blob) + 1) for _ in range(2))
        assert chains.checksum(a, z) == zlib.crc32(blob[a:z])
