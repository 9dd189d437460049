"""Media columns: types found from the bytes themselves.

An Aho-Corasick automaton over all signatures finds, in one pass, every place
where a medium may begin. A validator of the format then walks its structure and
lengths; only what it confirms counts. The medium at the start gives the true
type, which corrects the declared one; later ones are carved as embedded media.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import zlib
from collections.abc import Callable
from typing import NamedTuple

import ahocorasick
from pyspark.sql import DataFrame

from duolith.llm.common import bounded, map_texts


class Medium(NamedTuple):
    kind: str
    start: int
    end: int  # after its last byte
    body: tuple[int, int]  # where its samples or data lie


def riff(b: bytes, at: int) -> Medium | None:
    """RIFF: chunks, padded to even lengths, fill the form exactly; WAVE needs fmt before data."""
    if len(b) < at + 12:
        return None
    size, form = struct.unpack_from("<I4s", b, at + 4)
    end, place, fmt, body = at + 8 + size, at + 12, None, None
    if end > len(b) or form not in (b"WAVE", b"WEBP", b"AVI "):
        return None
    while place < end:
        if place + 8 > end:
            return None
        name, n = struct.unpack_from("<4sI", b, place)
        if place + 8 + n > end or not all(32 <= c < 127 for c in name):
            return None
        if name == b"fmt " and n >= 16:
            fmt = struct.unpack_from("<HHIIHH", b, place + 8)
        if name == b"data" and body is None:
            if form == b"WAVE" and (fmt is None or not fmt[1] or fmt[4] != fmt[1] * ((fmt[5] + 7) // 8) or n % fmt[4]):
                return None
            body = (place + 8, place + 8 + n)
        place += 8 + n + n % 2
    kind = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}[form]
    if form == b"WAVE" and body is None:
        return None
    return Medium(kind, at, end, body or (at + 12, end))


def png(b: bytes, at: int) -> Medium | None:
    """PNG: chunks with right checksums from IHDR to IEND, with IDAT between."""
    place, first, data = at + 8, None, None
    while place + 12 <= len(b):
        n, name = struct.unpack_from(">I4s", b, place)
        stop = place + 12 + n
        if stop > len(b) or zlib.crc32(b[place + 4 : stop - 4]) != struct.unpack_from(">I", b, stop - 4)[0]:
            return None
        if place == at + 8:
            if name != b"IHDR" or n != 13 or 0 in struct.unpack_from(">II", b, place + 8):
                return None
        if name == b"IDAT":
            first, data = (place if first is None else first), stop
        if name == b"IEND":
            return Medium("image/png", at, stop, (first, data)) if first is not None and n == 0 else None
        place = stop
    return None


def gif(b: bytes, at: int) -> Medium | None:
    """GIF: screen, colour tables, blocks with sub-blocks, trailer."""
    if len(b) < at + 14:
        return None
    flags, place = b[at + 10], at + 13
    place += 3 << (flags & 7) + 1 if flags & 128 else 0
    first, images = place, 0
    while place < len(b):
        mark = b[place]
        if mark == 0x3B:
            return Medium("image/gif", at, place + 1, (first, place)) if images else None
        if mark == 0x21:
            place += 2
        elif mark == 0x2C and place + 10 < len(b):
            images, local = images + 1, b[place + 9]
            place += 10 + (3 << (local & 7) + 1 if local & 128 else 0) + 1
        else:
            return None
        while place < len(b) and b[place]:
            place += 1 + b[place]
        place += 1
    return None


def bmp(b: bytes, at: int) -> Medium | None:
    """BMP: file length, data offset and header agree with each other and the image's size."""
    if len(b) < at + 54:
        return None
    size, _, data, head, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    if head not in (40, 52, 56, 64, 108, 124) or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height:
        return None
    row = (width * bits + 31) // 32 * 4
    packed = struct.unpack_from("<I", b, at + 30)[0]
    if at + size > len(b) or data < 14 + head or data > size or packed == 0 and data + row * abs(height) > size:
        return None
    return Medium("image/bmp", at, at + size, (at + data, at + size))


def jpeg(b: bytes, at: int) -> Medium | None:
    """JPEG: segments by their lengths up to the scan, a frame among them, then entropy data up to the end mark."""
    place, frame = at + 2, False
    while place + 4 <= len(b) and b[place] == 0xFF:
        mark, n = b[place + 1], struct.unpack_from(">H", b, place + 2)[0]
        if n < 2 or place + 2 + n > len(b):
            return None
        frame |= 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)
        place += 2 + n
        if mark == 0xDA:
            start = place
            while (place := b.find(b"\xff", place)) >= 0 and place + 1 < len(b):
                if b[place + 1] == 0xD9:
                    return Medium("image/jpeg", at, place + 2, (start, place)) if frame else None
                if b[place + 1] and not 0xD0 <= b[place + 1] <= 0xD7 and b[place + 1] != 0xFF:
                    break
                place += 2 if b[place + 1] != 0xFF else 1
            if place < 0 or place + 1 >= len(b):
                return None
    return None


def _crc_table(width: int, poly: int) -> list[int]:
    top, full, out = 1 << width - 1, (1 << width) - 1, []
    for v in range(256):
        v <<= width - 8
        for _ in range(8):
            v = (v << 1 ^ poly) & full if v & top else v << 1 & full
        out.append(v)
    return out


CRC8, CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)


def crc8(b: bytes) -> int:
    v = 0
    for c in b:
        v = CRC8[v ^ c]
    return v


def crc16(b: bytes) -> int:
    v = 0
    for c in b:
        v = (v << 8 & 0xFF00) ^ CRC16[v >> 8 ^ c]
    return v


class Bits:
    """Reads bits of a stretch of bytes; IndexError where it ends."""

    def __init__(self, b: bytes):
        self.told, self.at = bin(int.from_bytes(b"\1" + b, "big"))[3:], 0

    def skip(self, n: int) -> None:
        self.at += n
        if self.at > len(self.told):
            raise IndexError

    def read(self, n: int) -> int:
        self.skip(n)
        return int(self.told[self.at - n : self.at] or "0", 2)

    def unary(self) -> int:
        one = self.told.find("1", self.at)
        if one < 0:
            raise IndexError
        n, self.at = one - self.at, one + 1
        return n


#: Block sizes and sample sizes by their codes in a frame's head.
FLAC_BLOCKS = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608} | {c: 256 << c - 8 for c in range(8, 16)}
FLAC_SIZES = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


def flac_frame(b: bytes, at: int, sample_size: int) -> tuple[int, int] | None:
    """End and samples of the FLAC frame at a place: its head's checksum, each channel's coded samples, the frame's checksum."""
    if at + 6 > len(b) or b[at] != 0xFF or b[at + 1] & 0xFE != 0xF8:
        return None
    block, rate, channels, size = b[at + 2] >> 4, b[at + 2] & 15, b[at + 3] >> 4, b[at + 3] >> 1 & 7
    number = b[at + 4]
    more = 0 if number < 0x80 else f"{number:08b}".index("0") - 1 if number != 0xFF else -2
    place = at + 5 + more
    if block == 0 or rate == 15 or channels > 10 or size == 3 or b[at + 3] & 1 or more < 0 or number >= 0x80 and more == 0 or place + 6 > len(b):
        return None
    n = int.from_bytes(b[place : place + block - 5], "big") + 1 if block in (6, 7) else FLAC_BLOCKS[block]
    place += {6: 1, 7: 2}.get(block, 0) + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if place >= len(b) or crc8(b[at:place]) != b[place]:
        return None
    place, depth = place + 1, FLAC_SIZES.get(size, sample_size)
    room = 1 << 14
    while True:
        try:
            bits = Bits(b[place : place + room])
            for channel in range(channels + 1 if channels < 8 else 2):
                side = channels in (8, 10) and channel == 1 or channels == 9 and channel == 0
                if not flac_channel(bits, n, depth + side):
                    return None
            end = place + -(-bits.at // 8) + 2
            return (end, n) if end <= len(b) and crc16(b[at : end - 2]) == int.from_bytes(b[end - 2 : end], "big") else None
        except IndexError:
            if place + room >= len(b):
                return None
            room *= 4


def flac_channel(bits: Bits, n: int, depth: int) -> bool:
    """Passes over one channel's samples; false where its code is none."""
    if bits.read(1):
        return False
    kind = bits.read(6)
    if bits.read(1):
        depth -= bits.unary() + 1
    if depth <= 0:
        return False
    if kind < 2:
        bits.skip(depth if kind == 0 else depth * n)
        return True
    order = kind - 8 if 8 <= kind <= 12 else kind - 31 if kind >= 32 else -1
    if order < 0 or order > n:
        return False
    bits.skip(depth * order)
    if kind >= 32:
        precision = bits.read(4) + 1
        bits.skip(5 + precision * order)
        if precision == 16:
            return False
    method, parts = bits.read(2), 1 << bits.read(4)
    if method > 1 or n % parts or n // parts < order:
        return False
    wide = 4 + method
    for part in range(parts):
        count, rice = n // parts - (order if part == 0 else 0), bits.read(wide)
        if rice == (1 << wide) - 1:
            bits.skip(bits.read(5) * count)
        else:
            for _ in range(count):
                bits.unary()
                bits.skip(rice)
    return True


def flac(b: bytes, at: int) -> Medium | None:
    """FLAC: metadata blocks by their lengths, stream info first, then frames, up to the stream's samples or the last whole frame."""
    place, info = at + 4, b""
    while place + 4 <= len(b):
        head, n = b[place], int.from_bytes(b[place + 1 : place + 4], "big")
        if not info and (head & 127 or n != 34) or place + 4 + n > len(b):
            return None
        info, place = info or b[place + 4 : place + 38], place + 4 + n
        if head & 128:
            break
    else:
        return None
    told = int.from_bytes(info[10:18], "big")
    size, samples = (told >> 36 & 31) + 1, told & (1 << 36) - 1
    first, seen = place, 0
    while (not samples or seen < samples) and (found := flac_frame(b, place, size)):
        place, seen = found[0], seen + found[1]
    return Medium("audio/flac", at, place, (first, place)) if place > first and seen >= samples else None


PDF_MARK = re.compile(rb"%PDF-\d|startxref\s+(\d{1,18})\s+%%EOF|(?<!start)xref")


def pdf_ends(b: bytes) -> dict[int, int]:
    """Ends of the PDFs of a byte string by their places, in one pass.

    A section's startxref must point, counted from the head, at a table or stream
    object. It belongs to the innermost open head, else to the one from which it
    points at the table last seen; later sections of the same head are its updates.
    """
    ends: dict[int, int] = {}
    open_: list[int] = []
    waiting: set[int] = set()
    table = last = -1
    is_table = lambda at: at >= 0 and (b.startswith(b"xref", at) or b" obj" in b[at : at + 24] and b[at : at + 1].isdigit())
    for m in PDF_MARK.finditer(b):
        if m[0].startswith(b"%PDF-"):
            open_.append(m.start())
            waiting.add(m.start())
        elif m[0] == b"xref":
            table = m.start()
        else:
            to = int(m[1])
            while open_ and open_[-1] not in waiting:
                open_.pop()
            inner = open_[-1] if open_ else -1
            for head in (inner, last, table - to):
                if head >= 0 and head + to < m.start() and is_table(head + to) and (head in waiting or head == last and head + to >= ends[last]):
                    waiting.discard(head)
                    ends[head], last = m.end(), head
                    break
    return ends


def zip_ends(b: bytes) -> dict[int, int]:
    """Ends of the ZIP archives of a byte string by their places: an end record says where its archive begins."""
    ends: dict[int, int] = {}
    at = -1
    while (at := b.find(b"PK\5\6", at + 1)) >= 0 and at + 22 <= len(b):
        count, size, start, note = struct.unpack_from("<HIIH", b, at + 10)
        base = at - size - start
        if base >= 0 and at + 22 + note <= len(b) and (not count or b[base + start : base + start + 4] == b"PK\1\2"):
            ends.setdefault(base, at + 22 + note)
    return ends


Validator = Callable[[bytes, int], Medium | None]
#: Signatures of the formats.
SIGNATURES: dict[bytes, Validator] = {
    b"RIFF": riff,
    b"\x89PNG\r\n\x1a\n": png,
    b"GIF87a": gif,
    b"GIF89a": gif,
    b"BM": bmp,
    b"\xff\xd8\xff": jpeg,
    b"fLaC": flac,
}
#: Formats that end with a record: one pass finds all ends. The record points back, so each is found by its start.
ENDED: dict[bytes, tuple[str, Callable[[bytes], dict[int, int]]]] = {b"%PDF-": ("application/pdf", pdf_ends), b"PK\3\4": ("application/zip", zip_ends)}


def _automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for magic in (*SIGNATURES, *ENDED):
        made.add_word(magic.decode("latin-1"), magic)
    made.make_automaton()
    return made


FINDER = _automaton()


def sniff(b: bytes) -> tuple[Medium | None, list[Medium]]:
    """The medium that begins at the first byte, and the media embedded in it or after it, by place.

    Media inside an embedded medium belong to it and are not listed again.
    """
    whole, inner, after = None, [], 0
    ends: dict[bytes, dict[int, int]] = {}
    for last, magic in FINDER.iter(b.decode("latin-1")):
        at = last + 1 - len(magic)
        if at and at < after:
            continue
        if magic in ENDED:
            kind, find = ENDED[magic]
            if magic not in ends:
                ends[magic] = find(b)
            end = ends[magic].get(at)
            found = Medium(kind, at, end, (at, end)) if end else None
        else:
            found = SIGNATURES[magic](b, at)
        if found and at == 0:
            whole = found
        elif found:
            inner.append(found)
            after = found.end
    return whole, inner


def carve(b: bytes) -> list[tuple[str, bytes]]:
    """Types and bytes of the embedded media."""
    return [(m.kind, b[m.start : m.end]) for m in sniff(b)[1]]


def correct(media: DataFrame, *, key: str = "media_id") -> DataFrame:
    """True types of a table of media: key, declared (string), content (binary).

    Returns a row for each row: key, declared, detected (null where nothing is
    confirmed at the first byte), corrected (declared type wrong), length_ok (the
    medium ends with the content), embedded array<struct<type, start, length>>.
    Null and empty content has no type; other columns are not read; an empty table
    gives an empty table.
    """
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            rows = []
            for told, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                whole, inner = sniff(b or b"")
                kind = whole and whole.kind
                rows.append((kind, kind is not None and kind != told, whole is not None and whole.end == len(b), [{"type": m.kind, "start": m.start, "length": m.end - m.start} for m in inner]))
            cols = [list(c) for c in zip(*rows, strict=True)] or [[]] * 4
            item = pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64())])
            made = [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.bool_(), pa.bool_(), pa.list_(item)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=[key, "declared", "detected", "corrected", "length_ok", "embedded"])

    kind = dict(media.dtypes)[key]
    schema = f"`{key}` {kind}, declared string, detected string, corrected boolean, length_ok boolean, embedded array<struct<type: string, start: bigint, length: bigint>>"
    return bounded(media.selectExpr(f"`{key}`", "cast(declared as string) declared", "cast(content as binary) content")).mapInArrow(run, schema)


def wave(samples: bytes, rate: int = 8000) -> bytes:
    """8-bit mono PCM in a RIFF file; the samples are the bytes."""
    pad = b"\0" * (len(samples) % 2)
    head = struct.pack("<4sIHHIIHH4sI", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return b"RIFF" + struct.pack("<I", 4 + len(head) + len(samples) + len(pad)) + b"WAVE" + head + samples + pad


def text_media(docs: DataFrame, *, block: int = 64, declared: str = "application/octet-stream") -> DataFrame:
    """Stores each whole text as a medium, reads it back by its signature and describes it.

    The payload is the text's UTF-8 with zero bytes up to a positive multiple of
    `block`; it is stored as the 8-bit samples of a WAVE file under a wrong declared
    type. Returns a row for each row: doc_id, n_bytes, payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256, feature. feature is JSON: the corrected
    type, whether structure and length are confirmed, the embedded media with type,
    start and length, and the samples' mean and distinct count. Null text counts as
    empty, which gives one block of zeros; repeated rows stay; an empty table gives
    an empty table; other columns are not read.
    """

    def make(texts: list[str]) -> dict[str, list]:
        rows = []
        for text in texts:
            raw = text.encode("utf-8", "surrogatepass")
            stored = wave(raw + b"\0" * (-len(raw) % block or (0 if raw else block)))
            whole, inner = sniff(stored)
            if whole is None or whole.kind != "audio/wav":
                raise ValueError("a stored medium isn't what it was stored as")
            back = stored[slice(*whole.body)]
            feature = {
                "type": whole.kind,
                "corrected": whole.kind != declared,
                "length_ok": whole.end == len(stored),
                "embedded": [[m.kind, m.start - whole.body[0], m.end - m.start] for m in inner],
                "mean": round(sum(back) / len(back), 6),
                "distinct": len(set(back)),
            }
            rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-block:]), len(stored), hashlib.sha256(stored).hexdigest(), json.dumps(feature, separators=(",", ":"))))
        return dict(zip(("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"), zip(*rows, strict=True), strict=True))

    return map_texts(docs, make, "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
