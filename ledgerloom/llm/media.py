"""Media columns: signature sniffing, validation, type correction and carving.

An Aho-Corasick automaton finds every magic byte string of a blob in one pass;
a validator of each format then confirms its structure and its length.  What is
valid at offset 0 is the blob's true type, which corrects a declared one; what is
valid further on, inside or after it, is carved.

A format's blocks are chains of positions, which from many starts run together; a
blob's chains are walked once (``Chains``), and long checksums are put together from
sums of fixed steps, so validating takes time in proportion to the blob, whatever
it holds.  (Frames of FLAC, which no text can hold, are looked for in a bounded
number of bytes each.)

Edge cases: a null blob reads as empty; a blob without valid media keeps its
declared type and has no carving; magic bytes without valid structure count for
nothing; equal blobs have equal results.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from array import array
from functools import cache
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, steps

# Magic bytes and media types of the formats.
MAGIC = {
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
    b"\xff\xd8\xff": "image/jpeg",
    b"RIFF": "audio/wav",
    b"BM": "image/bmp",
    b"fLaC": "audio/flac",
}
BLOCK = 64
RATE = 8000


class Media(NamedTuple):
    offset: int
    length: int
    kind: str


class Chains:
    """Where chains of positions in one blob end.

    A format's blocks are a chain: each position tells the next, or the end.  Chains
    from different starts that meet go on alike, so each position is walked once, and
    the work on a blob is linear however many magic bytes it holds.
    """

    def __init__(self, blob: bytes):
        self.blob, self.ends, self.sums = blob, {}, None

    def end(self, kind: str, step, at: int) -> int:
        """Where the chain from ``at`` ends, 0 if it breaks; step(k): the next position, minus the end, or 0."""
        known = self.ends.get(kind)
        if known is None:
            known = self.ends[kind] = np.zeros(len(self.blob) + 2, np.int64)  # 0: not walked yet; -1: breaks
        path, found = array("q"), -1
        while at <= len(self.blob):
            if known[at]:
                found = int(known[at])
                break
            path.append(at)
            after = step(at)
            if after <= 0:
                found = -after or -1
                break
            at = after
        if path:
            known[np.frombuffer(path, np.int64)] = found
        return max(found, 0)

    def checksum(self, a: int, z: int) -> int:
        """CRC-32 of blob[a:z]; of long ranges from sums of the ranges before both ends, in steps of ``SUM_STEP``."""
        if z - a <= 2 * SUM_STEP:
            return zlib.crc32(self.blob[a:z])
        if self.sums is None:
            self.sums = [0]
            for k in range(0, len(self.blob), SUM_STEP):
                self.sums.append(zlib.crc32(self.blob[k : k + SUM_STEP], self.sums[-1]))

        def upto(k: int) -> int:
            whole = k // SUM_STEP
            return zlib.crc32(self.blob[whole * SUM_STEP : k], self.sums[whole])

        # crc(xy) = crc(x) moved by y's length, plus crc(y).
        return upto(z) ^ _times(upto(a), _moved(z - a))


SUM_STEP = 1 << 14
#: CRC-32's polynomial, lowest power first.
POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """The product of two polynomials over two elements, modulo CRC-32's."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (POLYNOMIAL if b & 1 else 0)
    return out


@cache
def _square(k: int) -> int:
    """x to the power 8 * 2**k."""
    half = _square(k - 1) if k else 0
    return _times(half, half) if k else 1 << 31 - 8


def _moved(n: int) -> int:
    """x to the power 8 * n: what moves a checksum over n bytes."""
    out, k = 1 << 31, 0
    while n >> k:
        if n >> k & 1:
            out = _times(out, _square(k))
        k += 1
    return out


def _png(b: bytes, at: int, chains: Chains) -> int:
    """Chunks with right checksums from IHDR (13 bytes long) to IEND."""

    def chunk(k: int) -> int:
        if k + 12 > len(b):
            return 0
        n = int.from_bytes(b[k : k + 4], "big")
        if k + 12 + n > len(b) or chains.checksum(k + 4, k + 8 + n) != int.from_bytes(b[k + 8 + n : k + 12 + n], "big"):
            return 0
        return -(k + 12 + n) if b[k + 4 : k + 8] == b"IEND" else k + 12 + n

    if b[at + 8 : at + 16] != b"\0\0\0\x0dIHDR":
        return 0
    end = chains.end("png", chunk, at + 8)
    return end - at if end else 0


def _gif(b: bytes, at: int, chains: Chains) -> int:
    """Blocks up to the trailer."""

    def part(k: int) -> int:
        return 0 if k >= len(b) else k + b[k] + 1 if b[k] else -(k + 1)

    def block(k: int) -> int:
        if k >= len(b):
            return 0
        if b[k] == 0x3B:
            return -(k + 1)
        if b[k] == 0x21:
            return chains.end("gif part", part, k + 2)
        if b[k] == 0x2C and k + 10 < len(b):
            return chains.end("gif part", part, k + 11 + (3 << ((b[k + 9] & 7) + 1) if b[k + 9] & 0x80 else 0))
        return 0

    if at + 13 > len(b):
        return 0
    end = chains.end("gif", block, at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0))
    return end - at if end else 0


def _jpeg(b: bytes, at: int, chains: Chains) -> int:
    """Segments up to the scan, then its end mark."""

    def scan(k: int) -> int:
        k = b.find(b"\xff", k)
        if k < 0 or k + 1 >= len(b):
            return 0
        return -(k + 2) if b[k + 1] == 0xD9 else k + 2

    def segment(k: int) -> int:
        if k + 4 > len(b) or b[k] != 0xFF:
            return 0
        n = int.from_bytes(b[k + 2 : k + 4], "big")
        if n < 2 or k + 2 + n > len(b):
            return 0
        return -chains.end("jpeg scan", scan, k + 2 + n) if b[k + 1] == 0xDA else k + 2 + n

    end = chains.end("jpeg", segment, at + 2)
    return end - at if end else 0


def wav_data(b: bytes, at: int, chains: Chains | None = None) -> tuple[int, int, int]:
    """(offset and size of the samples, size of the file), zeros if it isn't a whole WAV file."""
    chains = chains or Chains(b)
    if b[at + 8 : at + 12] != b"WAVE":
        return 0, 0, 0
    whole = int.from_bytes(b[at + 4 : at + 8], "little") + 8
    if at + whole > len(b):
        return 0, 0, 0

    def chunk(k: int, wanted: bytes) -> int:
        """The first chunk of this name, if it isn't behind the samples."""
        if k + 8 > len(b):
            return 0
        name, n = b[k : k + 4], int.from_bytes(b[k + 4 : k + 8], "little")
        if name == wanted and (name == b"data" or n >= 16):
            return -k
        return 0 if name == b"data" else k + 8 + n + (n & 1)

    form = chains.end("wav form", lambda k: chunk(k, b"fmt "), at + 12)
    data = chains.end("wav data", lambda k: chunk(k, b"data"), at + 12)
    if not form or not data or form + 24 > len(b):
        return 0, 0, 0
    channels, rate, per_s, align, bits = struct.unpack("<HIIHH", b[form + 10 : form + 24])
    n = int.from_bytes(b[data + 4 : data + 8], "little")
    right = align == channels * ((bits + 7) // 8) and per_s == rate * align and data + 8 + n <= at + whole
    return (data + 8, n, whole) if right else (0, 0, 0)


def _wav(b: bytes, at: int, chains: Chains) -> int:
    return wav_data(b, at, chains)[2]


def _bmp(b: bytes, at: int, chains: Chains) -> int:
    if at + 30 > len(b):
        return 0
    size, reserved, start, header, width, height, planes, bits = struct.unpack("<IIIIiiHH", b[at + 2 : at + 30])
    stride = (abs(width) * bits + 31) // 32 * 4
    ok = reserved == 0 and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and header >= 40 and at + size <= len(b) and start + stride * abs(height) <= size
    return size if ok else 0


# Block sizes and sample rates that a FLAC frame's header names by number; bits by sample size number.
FLAC_BLOCKS = {1: 192, **{k: 576 << (k - 2) for k in range(2, 6)}, **{k: 256 << (k - 8) for k in range(8, 16)}}


def _crc8(b: bytes) -> int:
    crc = 0
    for x in b:
        crc ^= x
        for _ in range(8):
            crc = (crc << 1 ^ 0x07) & 0xFF if crc & 0x80 else crc << 1
    return crc


@cache
def _crc16_table() -> tuple[int, ...]:
    out = []
    for k in range(256):
        crc = k << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005) & 0xFFFF if crc & 0x8000 else crc << 1
        out.append(crc)
    return tuple(out)


def _flac_header(b: bytes, at: int) -> tuple[int, int]:
    """(length of a frame's header, samples in the frame), zeros if there is none."""
    if at + 6 > len(b) or b[at] != 0xFF or b[at + 1] & 0xFE != 0xF8:
        return 0, 0
    block, rate = b[at + 2] >> 4, b[at + 2] & 15
    if block == 0 or rate == 15 or b[at + 3] & 1 or b[at + 3] >> 4 > 10:
        return 0, 0
    ones = 8 - (b[at + 4] ^ 0xFF).bit_length()  # the frame's number is coded as UTF-8 codes a character
    if ones in (1, 8):
        return 0, 0
    more = max(0, ones - 1)
    k = at + 5 + more
    samples = FLAC_BLOCKS.get(block, 0)
    for code, size in ((6, 1), (7, 2)):
        if block == code:
            samples, k = int.from_bytes(b[k : k + size], "big") + 1, k + size
    k += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    return (k + 1 - at, samples) if k < len(b) and _crc8(b[at:k]) == b[k] else (0, 0)


def _flac_frame(b: bytes, k: int, last: int, most: int) -> tuple[int, int]:
    """(end, samples) of the frame at k, zeros if there is none; it is the last one if it has ``last`` samples or more."""
    head, samples = _flac_header(b, k)
    if not head:
        return 0, 0
    crc, table = 0, _crc16_table()
    for j in range(k, min(len(b), k + head + most)):
        # Zero over a frame and its checksum; a frame ends where that is and another, or nothing, begins.
        crc = (crc << 8 & 0xFF00) ^ table[crc >> 8 ^ b[j]]
        if crc == 0 and j >= k + head + 2 and (last <= samples or _flac_header(b, j + 1)[0]):
            return j + 1, samples
    return 0, 0


def _flac(b: bytes, at: int, chains: Chains) -> int:
    """Metadata blocks from the stream's description on, then frames, each closed by its checksum, up to its count of samples.

    A frame's end is looked for in twice the bytes that its samples take uncoded.
    """

    def block(k: int) -> int:
        end = k + 4 + int.from_bytes(b[k + 1 : k + 4], "big")
        return 0 if k + 4 > len(b) or end > len(b) else -end if b[k] & 0x80 else end

    k = at + 4
    if k + 38 > len(b) or b[k] & 0x7F or int.from_bytes(b[k + 1 : k + 4], "big") != 34:
        return 0
    left = int.from_bytes(b[k + 17 : k + 22], "big") & ((1 << 36) - 1)
    channels, bits = (b[k + 16] >> 1 & 7) + 1, ((b[k + 16] & 1) << 4 | b[k + 17] >> 4) + 1
    k = chains.end("flac", block, k)
    while k and left > 0:  # a description that leaves the count open confirms the metadata only
        samples = _flac_header(b, k)[1]
        k, samples = _flac_frame(b, k, left, 64 + 2 * channels * (samples * (bits + 1) // 8 + 8))
        left -= samples
    return k - at if k else 0


VALID = {"image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "audio/wav": _wav, "image/bmp": _bmp, "audio/flac": _flac}


@cache
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic, kind in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (len(magic), kind))
    found.make_automaton()
    return found


def sniff(blob: bytes) -> list[Media]:
    """Every valid medium of a blob, by offset."""
    out, chains = [], Chains(blob)
    for last, (n, kind) in automaton().iter(blob.decode("latin-1")):
        at = last - n + 1
        if length := VALID[kind](blob, at, chains):
            out.append(Media(at, length, kind))
    return out


def inspect(blob: bytes, declared: str) -> tuple[str, list[Media]]:
    """(corrected type, what else the blob holds)."""
    found = sniff(blob)
    kind = next((m.kind for m in found if m.offset == 0), declared)
    return kind, [m for m in found if m.offset]


def wav(payload: bytes) -> bytes:
    """One channel of unsigned 8-bit samples."""
    pad = b"\x00" * (len(payload) & 1)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload + pad


def store(docs: DataFrame, declared: str = "application/octet-stream") -> DataFrame:
    """(doc_id, n_bytes, media, declared): each text's bytes, padded to a positive multiple of 64, as a WAV blob."""

    def run(batches):
        for b in steps(batches):
            blobs, sizes = [], []
            for x in b.column("text").to_pylist():
                data = (x or "").encode()
                sizes.append(len(data))
                blobs.append(wav(data + b"\x00" * (max(BLOCK, -(-len(data) // BLOCK) * BLOCK) - len(data))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())], ["doc_id", "n_bytes", "media"])

    return id_text(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary").withColumn("declared", F.lit(declared))


def media_features(media: DataFrame) -> DataFrame:
    """``store``'s rows -> digests of the samples read back from each blob, and a feature string.

    The feature: corrected type, sample count, and type@offset+length of each carved medium.
    """

    def run(batches):
        for b in steps(batches, "media"):
            out = []
            for blob, declared in zip(b.column("media").to_pylist(), b.column("declared").to_pylist(), strict=True):
                blob = blob or b""
                kind, inside = inspect(blob, declared)
                at, n, _ = wav_data(blob, 0) if kind == "audio/wav" else (0, len(blob), 0)
                payload = blob[at : at + n]
                feature = f"{kind};samples={n};carved=" + ",".join(f"{m.kind}@{m.offset}+{m.length}" for m in inside)
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(blob), hashlib.sha256(blob).hexdigest(), feature))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", *names])

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
