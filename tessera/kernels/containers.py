"""Container files to ordered parts and back: JPEG, PNG, RIFF, GIF, ISO base media and JPEG XL boxes."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

MAX_DEPTH = 16


@dataclass
class Part:
    seq: int
    parent: int  # seq of the part it lies in, -1 at the top
    depth: int
    kind: str
    type: str
    offset: int
    payload: bytes


class Malformed(ValueError):
    """Bytes that are not what their container demands."""


#: Signatures in the order they are tried.
SIGNATURES = (("jpeg", 0, b"\xff\xd8"), ("png", 0, b"\x89PNG\r\n\x1a\n"), ("gif", 0, b"GIF87a"), ("gif", 0, b"GIF89a"), ("webp", 8, b"WEBP"), ("avi", 8, b"AVI "), ("jxl", 0, b"\xff\x0a"), ("jxl", 0, b"\0\0\0\x0cJXL \r\n\x87\n"), ("bmff", 4, b"ftyp"), ("tiff", 0, b"II*\0"), ("tiff", 0, b"MM\0*"))


def detect(data: bytes) -> str | None:
    for name, at, mark in SIGNATURES:
        if data[at : at + len(mark)] == mark and (at != 8 or data[:4] == b"RIFF"):
            return name
    return None


# --- JPEG

JPEG_KINDS = ((0xE1, b"Exif\0\0", "exif"), (0xE1, b"http://ns.adobe.com/xap/1.0/\0", "xmp"), (0xE1, b"http://ns.adobe.com/xmp/extension/\0", "xmp-extended"), (0xE2, b"ICC_PROFILE\0", "icc"), (0xED, b"Photoshop 3.0\0", "irb"), (0xEB, b"JP", "jumbf"), (0xE0, b"JFIF\0", "jfif"), (0xE0, b"JFXX\0", "jfxx"), (0xFE, b"", "comment"))


def jpeg_parts(data: bytes) -> Iterator[Part]:
    """Segments up to the first scan, then all that follows as one part of kind scan."""
    if data[:2] != b"\xff\xd8":
        raise Malformed("no start of image")
    at, seq = 2, 0
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise Malformed(f"no marker at {at}")
        while at + 1 < len(data) and data[at + 1] == 0xFF:
            at += 1
        marker = data[at + 1]
        if marker in (0xDA, 0xD9):
            break
        if marker == 0x01 or 0xD0 <= marker <= 0xD7:
            yield Part(seq, -1, 0, "segment", f"{marker:02X}", at, b"")
            at, seq = at + 2, seq + 1
            continue
        size = struct.unpack_from(">H", data, at + 2)[0]
        if size < 2 or at + 2 + size > len(data):
            raise Malformed(f"segment at {at} is cut off")
        payload = data[at + 4 : at + 2 + size]
        kind = next((k for m, mark, k in JPEG_KINDS if m == marker and payload.startswith(mark)), "segment")
        yield Part(seq, -1, 0, kind, f"{marker:02X}", at, payload)
        at, seq = at + 2 + size, seq + 1
    yield Part(seq, -1, 0, "scan", "DA", at, data[at:])


def jpeg_write(parts: list[Part]) -> bytes:
    out = bytearray(b"\xff\xd8")
    for p in parts:
        if p.kind == "scan":
            out += p.payload
        elif p.type == "01" or "D0" <= p.type <= "D7":
            out += bytes([0xFF, int(p.type, 16)])
        else:
            if len(p.payload) > 65533:
                raise Malformed("a segment holds 65533 bytes at most")
            out += bytes([0xFF, int(p.type, 16)]) + struct.pack(">H", len(p.payload) + 2) + p.payload
    return bytes(out)


def jpeg_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) of the first frame header with a height; a later define-lines segment settles one without."""
    width, at = None, 2
    while at + 4 <= len(data):
        if data[at] != 0xFF or data[at + 1] in (0x00, 0xFF) or 0xD0 <= data[at + 1] <= 0xD7:
            at += 1
            continue
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        if marker == 0xD9:
            break
        if (0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC)) or marker == 0xDE:
            if at + 9 <= len(data):
                height, w = struct.unpack_from(">HH", data, at + 5)
                width = w if width is None else width
                if height:
                    return w, height
        if marker == 0xDC and width is not None and at + 6 <= len(data) and (lines := struct.unpack_from(">H", data, at + 4)[0]):
            return width, lines
        at += 2 + size
    return None


# --- PNG

PNG_MARK = b"\x89PNG\r\n\x1a\n"


def png_parts(data: bytes) -> Iterator[Part]:
    if not data.startswith(PNG_MARK):
        raise Malformed("no PNG signature")
    at, seq = 8, 0
    while at + 12 <= len(data):
        size = struct.unpack_from(">I", data, at)[0]
        if at + 12 + size > len(data):
            raise Malformed(f"chunk at {at} is cut off")
        kind = data[at + 4 : at + 8].decode("latin-1")
        yield Part(seq, -1, 0, "chunk", kind, at, data[at + 8 : at + 8 + size])
        at, seq = at + 12 + size, seq + 1
        if kind == "IEND":
            break


def png_write(parts: list[Part]) -> bytes:
    out = bytearray(PNG_MARK)
    for p in parts:
        body = p.type.encode("latin-1") + p.payload
        out += struct.pack(">I", len(p.payload)) + body + struct.pack(">I", zlib.crc32(body))
    return bytes(out)


def png_text(part: Part, ceiling: int = 16 << 20) -> tuple[str, str] | None:
    """(keyword, text) of tEXt, zTXt and iTXt; None if broken or over the ceiling once inflated."""
    found = png_international(part, ceiling)
    return found[:2] if found else None


def png_international(part: Part, ceiling: int = 16 << 20) -> tuple[str, str, str, str] | None:
    """(keyword, text, language, translated keyword); the last two are empty but in iTXt."""
    key, _, rest = part.payload.partition(b"\0")
    packed, charset, language, translated = False, "latin-1", b"", b""
    if part.type == "zTXt":
        packed, rest = True, rest[1:]
    elif part.type == "iTXt":
        if len(rest) < 2 or rest[2:].count(b"\0") < 2:
            return None
        packed, rest = rest[0] == 1, rest[2:]
        language, translated, rest = rest.split(b"\0", 2)
        charset = "utf-8"
    elif part.type != "tEXt":
        return None
    if packed:
        plain = inflate(rest, ceiling)
        if plain is None:
            return None
        rest = plain
    return key.decode("latin-1"), rest.decode(charset, "replace"), language.decode("latin-1"), translated.decode("utf-8", "replace")


def inflate(data: bytes, ceiling: int) -> bytes | None:
    engine = zlib.decompressobj()
    try:
        out = engine.decompress(data, ceiling + 1)
    except zlib.error:
        return None
    return out if len(out) <= ceiling and engine.eof else None


# --- RIFF


def riff_parts(data: bytes) -> Iterator[Part]:
    """Chunks in file order, lists before what they hold; RIFX is big-endian, ds64 gives the sizes that do not fit."""
    mark = data[:4]
    if mark not in (b"RIFF", b"RIFX", b"RF64", b"BW64") or len(data) < 12:
        raise Malformed("no RIFF header")
    order = ">" if mark == b"RIFX" else "<"
    wide: dict[bytes, int] = {}
    seq = 0

    def walk(at: int, end: int, parent: int, depth: int) -> Iterator[Part]:
        nonlocal seq
        while at + 8 <= end:
            kind, size = data[at : at + 4], struct.unpack_from(order + "I", data, at + 4)[0]
            if size == 0xFFFFFFFF:
                size = wide.get(kind, size)
            stop = min(at + 8 + size, end)
            own = seq
            seq += 1
            if kind == b"LIST" and depth < MAX_DEPTH:
                yield Part(own, parent, depth, "list", data[at + 8 : at + 12].decode("latin-1"), at, b"")
                yield from walk(at + 12, stop, own, depth + 1)
            else:
                if kind == b"ds64" and size >= 28:
                    wide[b"data"] = struct.unpack_from("<Q", data, at + 16)[0]
                    for k in range(struct.unpack_from("<I", data, at + 32)[0]):
                        if at + 48 + 12 * k <= stop:
                            wide[data[at + 36 + 12 * k : at + 40 + 12 * k]] = struct.unpack_from("<Q", data, at + 40 + 12 * k)[0]
                yield Part(own, parent, depth, "chunk", kind.decode("latin-1"), at, data[at + 8 : stop])
            at += 8 + size + size % 2

    yield from walk(12, len(data), -1, 0)


def riff_write(form: str, parts: list[Part], order: str = "<") -> bytes:
    def body(parent: int) -> bytes:
        out = bytearray()
        for p in parts:
            if p.parent == parent:
                own = p.type.encode("latin-1") + body(p.seq) if p.kind == "list" else p.payload
                out += (b"LIST" if p.kind == "list" else p.type.encode("latin-1")) + struct.pack(order + "I", len(own)) + own + b"\0" * (len(own) % 2)
        return bytes(out)

    inner = form.encode("latin-1") + body(-1)
    return (b"RIFX" if order == ">" else b"RIFF") + struct.pack(order + "I", len(inner)) + inner


def webp_size(parts: list[Part]) -> tuple[int, int] | None:
    by = {p.type: p.payload for p in reversed(parts)}
    if len(x := by.get("VP8X", b"")) >= 10:
        return 1 + int.from_bytes(x[4:7], "little"), 1 + int.from_bytes(x[7:10], "little")
    if len(x := by.get("VP8L", b"")) >= 5:
        bits = int.from_bytes(x[1:5], "little")
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    if len(x := by.get("VP8 ", b"")) >= 10:
        w, h = struct.unpack_from("<HH", x, 6)
        return w & 0x3FFF, h & 0x3FFF
    return None


# --- GIF


def sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    out = bytearray()
    while True:
        if at >= len(data):
            raise Malformed("sub-blocks are cut off")
        size = data[at]
        if not size:
            return bytes(out), at + 1
        out += data[at + 1 : at + 1 + size]
        at += 1 + size


def framed(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def gif_parts(data: bytes) -> Iterator[Part]:
    """The screen, then extensions (their label as type) and frames (descriptor, local colours, code size, data)."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise Malformed("no GIF header")
    at = 13 + (3 << (data[10] & 7) + 1 if data[10] & 128 else 0)
    yield Part(0, -1, 0, "screen", data[:6].decode(), 6, data[6:at])
    seq = 1
    while at < len(data):
        mark = data[at]
        if mark == 0x3B:
            return
        if mark == 0x21 and at + 2 < len(data):
            body, end = sub_blocks(data, at + 2)
            yield Part(seq, -1, 0, "extension", f"{data[at + 1]:02X}", at, body)
        elif mark == 0x2C and at + 10 < len(data):
            head = 10 + (3 << (data[at + 9] & 7) + 1 if data[at + 9] & 128 else 0)
            body, end = sub_blocks(data, at + head + 1)
            yield Part(seq, -1, 0, "frame", "2C", at, data[at + 1 : at + head + 1] + body)
        else:
            raise Malformed(f"unknown block {mark:02X} at {at}")
        at, seq = end, seq + 1


# --- ISO base media and JPEG XL

BOXES = frozenset(b"moov trak mdia minf stbl udta edts dinf meta iprp ipco ilst moof traf jumb".split())


def box_parts(data: bytes) -> Iterator[Part]:
    """Boxes in file order, containers before what they hold; size 1 is a 64-bit size, size 0 runs to the end."""
    seq = 0

    def walk(at: int, end: int, parent: int, depth: int) -> Iterator[Part]:
        nonlocal seq
        while at + 8 <= end:
            size, kind = struct.unpack_from(">I4s", data, at)
            head = 8
            if size == 1 and at + 16 <= end:
                size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
            elif size == 0:
                size = end - at
            if size < head or at + size > end:
                yield Part(seq, parent, depth, "rest", "", at, data[at:end])
                seq += 1
                return
            own = seq
            seq += 1
            inner = at + head + (4 if kind == b"meta" else 0)
            nested = kind in BOXES and depth < MAX_DEPTH
            yield Part(own, parent, depth, "container" if nested else "box", kind.decode("latin-1"), at, data[at + head : inner] if nested else data[at + head : at + size])
            if nested:
                yield from walk(inner, at + size, own, depth + 1)
            at += size

    yield from walk(0, len(data), -1, 0)


def box_write(parts: list[Part], parent: int = -1) -> bytes:
    out = bytearray()
    for p in parts:
        if p.parent == parent:
            own = p.payload + (box_write(parts, p.seq) if p.kind == "container" else b"")
            out += own if p.kind == "rest" else struct.pack(">I", len(own) + 8) + p.type.encode("latin-1") + own
    return bytes(out)


#: Aspect ratios of JPEG XL size headers, width = height * num // den.
JXL_RATIOS = ((1, 1), (12, 10), (4, 3), (3, 2), (16, 9), (5, 4), (2, 1))


def jxl_size(code: bytes) -> tuple[int, int] | None:
    """(width, height) from a codestream's size header, bits from the lowest."""
    if code[:2] != b"\xff\x0a":
        return None
    bits, at = int.from_bytes(code[2:16], "little"), 0

    def take(n: int) -> int:
        nonlocal at
        value = bits >> at & (1 << n) - 1
        at += n
        return value

    small = take(1)

    def side() -> int:
        return 8 * (take(5) + 1) if small else take((9, 13, 18, 30)[take(2)]) + 1

    height = side()
    ratio = take(3)
    width = height * JXL_RATIOS[ratio - 1][0] // JXL_RATIOS[ratio - 1][1] if ratio else side()
    return width, height


PARSERS = {"jpeg": jpeg_parts, "png": png_parts, "gif": gif_parts, "webp": riff_parts, "avi": riff_parts, "bmff": box_parts, "jxl": box_parts}


def parts(data: bytes) -> Iterator[Part]:
    kind = detect(data)
    if kind is None or kind not in PARSERS:
        raise Malformed("format not recognised" if kind is None else f"{kind} has entries, not parts")
    return PARSERS[kind](data)
