"""Media columns: payloads stored as audio samples or pixels, found again in byte blobs by their signatures.

A blob may hold text, framing and one or more media files under a wrong declared type. An Aho-Corasick automaton
locates every magic sequence in one scan; a validator for each format then checks structure and declared lengths and
gives the exact end, so chance occurrences fall away and the file can be carved out and decoded.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only, settle, ship

#: Payloads are padded with PAD to a positive multiple of UNIT bytes; UNIT is also the width of a stored image.
UNIT = 576
PAD = b"\xff"

#: Fixed values of the formats: magic bytes and the media type that each stands for.
MAGIC = {
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"BM": "image/bmp",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
    b"\xff\xd8\xff": "image/jpeg",
    b"RIFF": "audio/wav",
    b".snd": "audio/basic",
    b"\x1f\x8b\x08": "application/gzip",
}


@dataclass(frozen=True)
class Found:
    kind: str
    start: int
    end: int


def padded(data: bytes) -> bytes:
    return data + PAD * (-len(data) % UNIT or (0 if data else UNIT))


# Writers: 8-bit mono WAV, 8-bit grey BMP and PNG.


def write_wav(payload: bytes, rate: int = 8000) -> bytes:
    odd = b"\0" * (len(payload) % 2)
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    body = b"WAVE" + form + struct.pack("<4sI", b"data", len(payload)) + payload + odd
    return b"RIFF" + struct.pack("<I", len(body)) + body


def write_bmp(payload: bytes) -> bytes:
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256))
    height, offset = len(payload) // UNIT, 14 + 40 + len(palette)
    head = struct.pack("<2sIHHI", b"BM", offset + len(payload), 0, 0, offset)
    # A negative height stores the rows from the top down.
    return head + struct.pack("<IiiHHIIiiII", 40, UNIT, -height, 1, 8, 0, len(payload), 0, 0, 256, 0) + palette + payload


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def write_png(payload: bytes) -> bytes:
    height = len(payload) // UNIT
    rows = b"".join(b"\0" + payload[at : at + UNIT] for at in range(0, len(payload), UNIT))
    head = _chunk(b"IHDR", struct.pack(">IIBBBBB", UNIT, height, 8, 0, 0, 0, 0))
    return b"\x89PNG\r\n\x1a\n" + head + _chunk(b"IDAT", zlib.compress(rows, 1)) + _chunk(b"IEND", b"")


WRITERS = {"audio/wav": write_wav, "image/bmp": write_bmp, "image/png": write_png}


# Validators: the end of the file that starts at a place, or None.


def _png(b: bytes, at: int) -> int | None:
    pos, first = at + 8, True
    while pos + 12 <= len(b):
        (size,) = struct.unpack_from(">I", b, pos)
        kind, end = b[pos + 4 : pos + 8], pos + 12 + size
        if end > len(b) or (first and (kind != b"IHDR" or size != 13)):
            return None
        if zlib.crc32(memoryview(b)[pos + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return None
        if kind == b"IEND":
            return end
        pos, first = end, False
    return None


def _bmp(b: bytes, at: int) -> int | None:
    if at + 54 > len(b):
        return None
    size, r1, r2, offset = struct.unpack_from("<IHHI", b, at + 2)
    header, width, height, planes, bits, packed = struct.unpack_from("<IiiHHI", b, at + 14)
    if r1 or r2 or header < 40 or planes != 1 or packed or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height:
        return None
    pixels = (width * bits + 31) // 32 * 4 * abs(height)
    if offset < 14 + header or size != offset + pixels or at + size > len(b):
        return None
    return at + size


def _wav(b: bytes, at: int) -> int | None:
    if at + 12 > len(b) or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return None
    pos, seen = at + 12, set()
    while pos + 8 <= end:
        kind, size = b[pos : pos + 4], struct.unpack_from("<I", b, pos + 4)[0]
        if kind == b"fmt " and size < 16 or kind == b"data" and b"fmt " not in seen:
            return None
        seen.add(kind)
        pos += 8 + size + size % 2
    return end if pos == end and {b"fmt ", b"data"} <= seen else None


def _au(b: bytes, at: int) -> int | None:
    if at + 24 > len(b):
        return None
    offset, size, code, rate, channels = struct.unpack_from(">IIIII", b, at + 4)
    if offset < 24 or size == 0xFFFFFFFF or not 1 <= code <= 27 or not rate or not 0 < channels < 256:
        return None
    end = at + offset + size
    return end if end <= len(b) else None


def _gif(b: bytes, at: int) -> int | None:
    if at + 13 > len(b):
        return None
    flags = b[at + 10]
    pos = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)
    images = 0
    while pos < len(b):
        mark = b[pos]
        if mark == 0x3B:
            return pos + 1 if images else None
        if mark == 0x21:
            pos += 2
        elif mark == 0x2C and pos + 10 <= len(b):
            flags = b[pos + 9]
            pos += 11 + (3 << (flags & 7) + 1 if flags & 128 else 0)
            images += 1
        else:
            return None
        while pos < len(b) and b[pos]:
            pos += 1 + b[pos]
        pos += 1
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    pos, scanned = at + 2, False
    while pos + 4 <= len(b):
        if b[pos] != 0xFF:
            return None
        mark = b[pos + 1]
        if mark == 0xFF:
            pos += 1
            continue
        if mark in (0x00, 0xD8, 0xD9) or 0xD0 <= mark <= 0xD7:
            return None
        pos += 2 + struct.unpack_from(">H", b, pos + 2)[0]
        if mark == 0xDA:
            scanned = True
        if scanned:
            while True:
                pos = b.find(b"\xff", pos)
                if pos < 0 or pos + 1 >= len(b):
                    return None
                if b[pos + 1] == 0 or 0xD0 <= b[pos + 1] <= 0xD7:
                    pos += 2
                    continue
                break
            if b[pos + 1] == 0xD9:
                return pos + 2
            scanned = False
    return None


def _gzip(b: bytes, at: int) -> int | None:
    stream = zlib.decompressobj(31)
    try:
        rest = memoryview(b)[at:]
        while not stream.eof and len(rest):
            stream.decompress(rest, 1 << 20)  # output is dropped piece by piece
            rest = stream.unconsumed_tail or (b"" if not stream.eof else rest)
        return len(b) - len(stream.unused_data) if stream.eof else None
    except zlib.error:
        return None


VALIDATORS = {"image/png": _png, "image/bmp": _bmp, "image/gif": _gif, "image/jpeg": _jpeg, "audio/wav": _wav, "audio/basic": _au, "application/gzip": _gzip}


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic, kind in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (len(magic), kind))
    found.make_automaton()
    return found


_scanner = _automaton()


def sniff(blob: bytes) -> list[Found]:
    """The confirmed files in a blob, by start; hits inside a file that is already confirmed are part of it."""
    hits = sorted((last - size + 1, -size, kind) for last, (size, kind) in _scanner.iter(blob.decode("latin-1")))
    out: list[Found] = []
    done = 0
    for at, _, kind in hits:
        if at < done:
            continue
        end = VALIDATORS[kind](blob, at)
        if end is not None:
            out.append(Found(kind, at, end))
            done = end
    return out


# Readers of what the writers store.


def read_payload(kind: str, media: bytes) -> bytes:
    if kind == "audio/wav":
        pos = 12
        while media[pos : pos + 4] != b"data":
            size = struct.unpack_from("<I", media, pos + 4)[0]
            pos += 8 + size + size % 2
        return media[pos + 8 : pos + 8 + struct.unpack_from("<I", media, pos + 4)[0]]
    if kind == "image/bmp":
        return media[struct.unpack_from("<I", media, 10)[0] :]
    if kind == "image/png":
        pos, packed = 8, []
        width = struct.unpack_from(">I", media, 16)[0]
        while pos < len(media):
            size = struct.unpack_from(">I", media, pos)[0]
            if media[pos + 4 : pos + 8] == b"IDAT":
                packed.append(media[pos + 8 : pos + 8 + size])
            pos += 12 + size
        rows = zlib.decompress(b"".join(packed))
        return b"".join(rows[at + 1 : at + 1 + width] for at in range(0, len(rows), width + 1))
    raise ValueError(kind)


def store(payload: bytes) -> tuple[bytes, str]:
    """A blob that embeds the payload as media between text frames, and the type that its frame declares.

    The format follows from the payload's checksum; the declared type is right for a third of the payloads.
    """
    kinds = sorted(WRITERS)
    check = zlib.crc32(payload)
    media = WRITERS[kinds[check % 3]](payload)
    declared = kinds[check // 3 % 3]
    frame = b"--part\r\nContent-Type: " + declared.encode() + b"\r\n\r\n"
    return frame + media + b"\r\n--part--\r\n", declared


def examine(blob: bytes, declared: str) -> tuple[Found, bytes, str]:
    """The largest confirmed file (the first of equals), its bytes, and a feature: its type, place and length, and the correction."""
    files = sniff(blob)
    if not files:
        raise ValueError("no confirmed media in the stored blob")
    best = max(files, key=lambda f: (f.end - f.start, -f.start))
    media = blob[best.start : best.end]
    verdict = "declared" if best.kind == declared else f"corrected from {declared}"
    return best, media, f"{best.kind} at {best.start} length {best.end - best.start} of {len(files)}, {verdict}"


def carve(blobs: DataFrame, id_col: str, blob_col: str, declared_col: str) -> DataFrame:
    """Every confirmed file in a column of blobs: id, position, kind, start, end, bytes and whether the declared type was right.

    Null and empty blobs, and blobs without confirmed media, give no rows.
    """
    ship(blobs.sparkSession)
    schema = f"`{id_col}` {blobs.schema[id_col].dataType.simpleString()}, position int, kind string, start long, end long, media binary, type_ok boolean"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, blob, declared in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [(key, i, f.kind, f.start, f.end, blob[f.start : f.end], f.kind == declared) for i, f in enumerate(sniff(blob or b""))]
            names = [id_col, "position", "kind", "start", "end", "media", "type_ok"]
            kinds = [batch.schema.field(0).type, pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return only(blobs, id_col, blob_col, declared_col).mapInArrow(cut, schema)


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, blob, declared): every whole text as a media column, embedded in a blob under a declared type.

    A null text counts as empty, and an empty one is padded to one unit. Other columns are ignored whatever their names.
    """
    ship(docs.sparkSession)
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, blob binary, declared string"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            blobs = [store(padded(t)) for t in texts]
            columns = [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([b for b, _ in blobs], pa.binary()), pa.array([d for _, d in blobs], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_bytes", "blob", "declared"])

    return only(docs, id_col, text_col).mapInArrow(write, schema)


def described(blobs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The media of a column that stored() made, found by their signatures and read back: digests, a feature, the declared and the real type."""
    ship(blobs.sparkSession)
    schema = f"`{id_col}` {blobs.schema[id_col].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, declared_type string, media_type string"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "declared_type", "media_type"]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for size, blob, declared in zip(*(c.to_pylist() for c in batch.columns[1:])):
                found, media, feature = examine(blob, declared)
                back = read_payload(found.kind, media)
                rows.append((size, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, declared, found.kind))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=names)

    return only(blobs, id_col, "n_bytes", "blob", "declared").mapInArrow(describe, schema)


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every whole text as media in a written table, reads the stored bytes back by their signatures and describes them.

    Equal texts give equal values; repeated rows and null ids give a row each; texts of any length are stored whole; other
    columns are ignored whatever their names; an empty table gives no rows.
    """
    return described(settle(stored(docs, id_col, text_col), "media", compression="zstd"), id_col)
