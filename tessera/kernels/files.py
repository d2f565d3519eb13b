"""Carriers of metadata in whole files: what a file holds of each, and the file with one set, replaced or removed.

A carrier is bytes: `exif` a TIFF block, `xmp` a packet in UTF-8, `icc` a profile, `irb` Photoshop resources, `iptc` datasets,
`comment` text.  Parts that a change does not concern keep their bytes and order; files whose parts are found by place keep
these parts where they are.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable

from tessera.kernels import carriers, containers, tiff
from tessera.kernels.containers import Malformed, Part

# Headers of the carriers' homes.
EXIF_HEAD = b"Exif\0\0"
XMP_HEAD = b"http://ns.adobe.com/xap/1.0/\0"
EXTENDED_HEAD = b"http://ns.adobe.com/xmp/extension/\0"
ICC_HEAD = b"ICC_PROFILE\0"
IRB_HEAD = b"Photoshop 3.0\0"
XMP_KEYWORD = b"XML:com.adobe.xmp"
XMP_UUID = bytes.fromhex("be7acfcb97a942e89c71999491e3afac")
GIF_XMP, GIF_ICC, GIF_LOOP = b"XMP DataXMP", b"ICCRGBG1012", b"NETSCAPE2.0"
GIF_TRAILER = b"\x01" + bytes(range(255, -1, -1)) + b"\0"
VP8X_FLAGS = {"icc": 0x20, "exif": 0x08, "xmp": 0x04}
TIFF_TAGS = {"xmp": (700, 1), "iptc": (33723, 7), "irb": (34377, 7), "icc": (34675, 7)}
IPTC_RESOURCE = 0x0404


class NoHome(ValueError):
    """The container has no place for the carrier."""


# --- JPEG

_ORDER = ["jfif", "jfxx", "exif", "xmp", "xmp-extended", "icc", "jumbf", "irb", "comment"]


def _jpeg_put(data: bytes, kinds: tuple[str, ...], segments: list[tuple[int, bytes]]) -> bytes:
    """Segments of the kinds are replaced; new ones come after the last segment that stands before their kind by rule."""
    parts = [p for p in containers.jpeg_parts(data) if p.kind not in kinds]
    rank = _ORDER.index(kinds[0])
    at = max((i + 1 for i, p in enumerate(parts) if p.kind in _ORDER and _ORDER.index(p.kind) <= rank), default=0)
    return containers.jpeg_write(parts[:at] + [Part(0, -1, 0, kinds[0], f"{m:02X}", 0, body) for m, body in segments] + parts[at:])


def cut(data: bytes, size: int) -> list[bytes]:
    return [data[i : i + size] for i in range(0, len(data), size)]


def jpeg_segments(carrier: str, value: bytes) -> list[tuple[int, bytes]]:
    """A carrier as segments (marker, payload), split where one does not hold it."""
    if carrier == "exif":
        if len(value) > 65527:
            raise Malformed("an EXIF block fits one segment or none")
        return [(0xE1, EXIF_HEAD + value)]
    if carrier == "xmp":
        if len(value) <= 65533 - len(XMP_HEAD):
            return [(0xE1, XMP_HEAD + value)]
        # a packet that names the rest by its digest, and the rest in pieces
        guid = hashlib.md5(value).hexdigest().upper()
        short = f'<?xpacket begin="﻿" id="W5M0MpCehiHzreSzNTczkc9d"?><x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description rdf:about="" xmlns:xmpNote="http://ns.adobe.com/xmp/note/" xmpNote:HasExtendedXMP="{guid}"/></rdf:RDF></x:xmpmeta><?xpacket end="w"?>'.encode()
        size = 65533 - len(EXTENDED_HEAD) - 40
        return [(0xE1, XMP_HEAD + short)] + [(0xE1, EXTENDED_HEAD + guid.encode() + struct.pack(">II", len(value), i * size) + x) for i, x in enumerate(cut(value, size))]
    if carrier == "icc":
        pieces = cut(value, 65533 - 14)
        if len(pieces) > 255:
            raise Malformed("a profile fits 255 segments or none")
        return [(0xE2, ICC_HEAD + bytes([i + 1, len(pieces)]) + x) for i, x in enumerate(pieces)]
    if carrier == "irb":
        return [(0xED, IRB_HEAD + x) for x in cut(value, 65533 - len(IRB_HEAD))]
    if carrier == "jumbf":
        head, size = value[:8], 65533 - 16
        return [(0xEB, b"JP" + struct.pack(">HI", 1, i + 1) + (x if i == 0 else head + x)) for i, x in enumerate([value[:size], *cut(value[size:], size - 8)])]
    return [(0xFE, x) for x in cut(value, 65533)]


def _jpeg_get(data: bytes, carrier: str) -> bytes | None:
    parts = list(containers.jpeg_parts(data))
    own = [p.payload for p in parts if p.kind == carrier]
    if not own:
        return None
    if carrier == "exif":
        return own[0][6:]
    if carrier == "xmp":
        packet = own[0][len(XMP_HEAD) :]
        at = packet.find(b"HasExtendedXMP")
        if at >= 0:
            tail = packet[at + 14 :].lstrip(b"=\"'> \r\n\t")[:32]
            pieces = [p.payload[len(EXTENDED_HEAD) :] for p in parts if p.kind == "xmp-extended"]
            pieces = sorted((struct.unpack_from(">II", x, 32)[::-1], x[40:]) for x in pieces if x[:32] == tail and len(x) >= 40)
            whole = b"".join(x for _, x in pieces)
            if pieces and len(whole) == pieces[0][0][1] and hashlib.md5(whole).hexdigest().upper().encode() == tail:
                return whole
        return packet
    if carrier == "icc":
        chunks = {x[12]: x[14:] for x in own if len(x) > 14}  # the last of a number counts
        count = own[0][13] if len(own[0]) > 13 else 0
        return b"".join(chunks[i] for i in range(1, count + 1)) if all(i in chunks for i in range(1, count + 1)) else None
    if carrier == "irb":
        return b"".join(x[len(IRB_HEAD) :] for x in own)
    if carrier == "jumbf":
        boxes: dict[int, dict[int, bytes]] = {}
        for x in own:
            if len(x) >= 16:
                instance, number = struct.unpack_from(">HI", x, 2)
                boxes.setdefault(instance, {})[number] = x[8:]
        return b"".join(b"".join(x if i == 0 else x[8:] for i, (_, x) in enumerate(sorted(pieces.items()))) for _, pieces in sorted(boxes.items()))
    return b"".join(own)


def jpeg_end(data: bytes) -> int:
    """The place behind the end of image: markers inside entropy-coded data are stepped over, segments by their size."""
    at = 2
    while at + 1 < len(data):
        if data[at] != 0xFF:
            at = data.find(b"\xff", at)
            if at < 0:
                return len(data)
            continue
        marker = data[at + 1]
        if marker == 0xD9:
            return at + 2
        if marker in (0x00, 0x01, 0xFF) or 0xD0 <= marker <= 0xD8:
            at += 1 if marker == 0xFF else 2
        elif at + 4 <= len(data):
            at += 2 + struct.unpack_from(">H", data, at + 2)[0]
        else:
            break
    return len(data)


# --- PNG


def _png_is(part: Part, carrier: str) -> bool:
    keyword = part.payload.partition(b"\0")[0]
    text = part.type in ("tEXt", "zTXt", "iTXt")
    return {
        "exif": part.type == "eXIf",
        "icc": part.type == "iCCP",
        "xmp": text and keyword == XMP_KEYWORD,
        "irb": text and keyword == b"Raw profile type 8bim",
        "iptc": text and keyword == b"Raw profile type iptc",
        "comment": text and keyword == b"Comment",
    }.get(carrier, False)


def raw_profile(name: str, data: bytes) -> bytes:
    """A profile as lines of hex digits behind its name and size."""
    return b"\n%s\n%8d\n" % (name.encode(), len(data)) + b"".join(x + b"\n" for x in cut(data.hex().encode(), 72))


def from_raw_profile(text: bytes) -> bytes | None:
    lines = text.lstrip(b"\n").split(b"\n", 2)
    try:
        body = bytes.fromhex(b"".join(lines[2].split()).decode())
        return body if len(body) == int(lines[1]) else None
    except (IndexError, ValueError):
        return None


def _png_chunk(carrier: str, value: bytes) -> tuple[str, bytes]:
    if carrier == "exif":
        return "eXIf", value
    if carrier == "icc":
        return "iCCP", b"ICC Profile\0\0" + zlib.compress(value)
    if carrier == "xmp":
        return "iTXt", XMP_KEYWORD + b"\0\0\0\0\0" + value
    if carrier == "comment":
        return "iTXt", b"Comment\0\0\0\0\0" + value
    name = "8bim" if carrier == "irb" else "iptc"
    return "zTXt", b"Raw profile type " + name.encode() + b"\0\0" + zlib.compress(raw_profile(name, value))


def _png_get(data: bytes, carrier: str) -> bytes | None:
    part = next((p for p in containers.png_parts(data) if _png_is(p, carrier)), None)
    if part is None:
        return None
    if carrier == "exif":
        return part.payload
    if carrier == "icc":
        return containers.inflate(part.payload.partition(b"\0")[2][1:], 16 << 20)
    found = containers.png_text(part)
    if found is None:
        return None
    return from_raw_profile(found[1].encode("latin-1", "replace")) if carrier in ("irb", "iptc") else found[1].encode()


def _png_put(data: bytes, carrier: str, value: bytes | None) -> bytes:
    tail = data[_png_end(data) :]
    parts = [p for p in containers.png_parts(data) if not _png_is(p, carrier)]
    if value is not None:
        kind, body = _png_chunk(carrier, value)
        before = ("PLTE", "IDAT", "IEND") if carrier == "icc" else ("IDAT", "IEND")
        at = next((i for i, p in enumerate(parts) if p.type in before), len(parts))
        parts.insert(at, Part(0, -1, 0, "chunk", kind, 0, body))
    return containers.png_write(parts) + tail


def _png_end(data: bytes) -> int:
    last = None
    for last in containers.png_parts(data):
        pass
    return last.offset + 12 + len(last.payload) if last else 8


# --- GIF


def gif_blocks(data: bytes) -> tuple[bytes, list[tuple[str, bytes]], bytes]:
    """The header with the global colours, blocks as (kind, bytes) with their framing, and what follows the trailer."""
    parts = list(containers.gif_parts(data))
    starts = [p.offset for p in parts[1:]]
    head = 6 + len(parts[0].payload)
    end = head
    rows = []
    for i, p in enumerate(parts[1:]):
        skip = 2 if p.kind == "extension" else 11 + (3 << (data[p.offset + 9] & 7) + 1 if data[p.offset + 9] & 128 else 0)
        end = starts[i + 1] if i + 1 < len(starts) else containers.sub_blocks(data, p.offset + skip)[1]
        raw = data[p.offset : end]
        kind = "frame" if p.kind == "frame" else "comment" if p.type == "FE" else raw[3:14].decode("latin-1") if p.type == "FF" and len(raw) > 14 else f"extension-{p.type}"
        rows.append((kind, raw))
    return data[:head], rows, data[end + 1 :]


def gif_join(head: bytes, rows: list[tuple[str, bytes]], tail: bytes = b"") -> bytes:
    """Blocks in order; extensions ask for version 89a."""
    if any(k != "frame" for k, _ in rows):
        head = b"GIF89a" + head[6:]
    return head + b"".join(raw for _, raw in rows) + b"\x3b" + tail


_GIF_NAMES = {"xmp": GIF_XMP.decode(), "icc": GIF_ICC.decode(), "comment": "comment", "loop": GIF_LOOP.decode()}


def gif_extension(carrier: str, value: bytes) -> bytes:
    if carrier == "comment":
        return b"\x21\xfe" + containers.framed(value)
    if carrier == "xmp":
        return b"\x21\xff\x0b" + GIF_XMP + value + GIF_TRAILER
    return b"\x21\xff\x0b" + (GIF_ICC if carrier == "icc" else GIF_LOOP) + containers.framed(value)


def _gif_get(data: bytes, carrier: str) -> bytes | None:
    _, rows, _ = gif_blocks(data)
    own = [raw for k, raw in rows if k == _GIF_NAMES.get(carrier)]
    if not own:
        return None
    if carrier == "xmp":
        return own[0][14 : -len(GIF_TRAILER)]
    return containers.sub_blocks(own[0], 2 if carrier == "comment" else 14)[0]


def _gif_put(data: bytes, carrier: str, value: bytes | None) -> bytes:
    if carrier not in _GIF_NAMES:
        raise NoHome(f"GIF has no place for {carrier}")
    head, rows, tail = gif_blocks(data)
    name = _GIF_NAMES[carrier]
    at = next((i for i, (k, _) in enumerate(rows) if k == name), next((i for i, (k, _) in enumerate(rows) if k == "frame" or k == "extension-F9"), len(rows)))
    kept = [(k, raw) for k, raw in rows if k != name]
    if value is not None:
        kept.insert(min(at, len(kept)), (name, gif_extension(carrier, value)))
    return gif_join(head, kept, tail)


def gif_loop_count(data: bytes) -> int | None:
    body = _gif_get(data, "loop")
    return struct.unpack_from("<H", body, 1)[0] if body and len(body) >= 3 and body[0] == 1 else None


# --- RIFF: WebP and AVI

_WEBP = {"exif": "EXIF", "xmp": "XMP ", "icc": "ICCP"}


def _webp_put(data: bytes, carrier: str, value: bytes | None) -> bytes:
    if carrier not in _WEBP:
        raise NoHome(f"WebP has no place for {carrier}")
    parts = [p for p in containers.riff_parts(data) if p.type != _WEBP[carrier]]
    if not any(p.type == "VP8X" for p in parts):
        if value is None:
            return containers.riff_write("WEBP", parts)
        w, h = containers.webp_size(parts) or (1, 1)
        lossless = next((p.payload for p in parts if p.type == "VP8L"), b"")
        alpha = 0x10 if len(lossless) >= 5 and lossless[4] & 0x10 else 0
        parts.insert(0, Part(-2, -1, 0, "chunk", "VP8X", 0, bytes([alpha, 0, 0, 0]) + (w - 1).to_bytes(3, "little") + (h - 1).to_bytes(3, "little")))
    head = next(i for i, p in enumerate(parts) if p.type == "VP8X")
    old = parts[head].payload
    flags = old[0] | VP8X_FLAGS[carrier] if value is not None else old[0] & ~VP8X_FLAGS[carrier]
    parts[head] = Part(-2, -1, 0, "chunk", "VP8X", 0, bytes([flags]) + old[1:])
    if value is not None:
        parts.insert(head + 1 if carrier == "icc" else len(parts), Part(-3, -1, 0, "chunk", _WEBP[carrier], 0, value))
    return containers.riff_write("WEBP", parts)


def avi_place(data: bytes, kind: bytes, old: tuple[int, int] | None, body: bytes | None) -> bytes:
    """The file with a top-level chunk or list put, replaced (old: its place and whole size) or removed, and nothing moved.

    The old chunk becomes padding.  The new one goes where it stood, or into padding that holds it, if it leaves room for
    the padding's own header or none; else behind the last chunk."""
    out = bytearray(data)
    if old:
        at, size = old
        out[at : at + size] = b"JUNK" + struct.pack("<I", size - 8) + bytes(size - 8)
    if body is None:
        return bytes(out)
    chunk = kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    spots = [(p.offset, 8 + len(p.payload) + len(p.payload) % 2) for p in containers.riff_parts(bytes(out)) if p.type == "JUNK" and p.depth == 0]
    for at, size in spots:
        rest = size - len(chunk)
        if rest == 0 or rest >= 8:
            out[at : at + size] = chunk + (b"JUNK" + struct.pack("<I", rest - 8) + bytes(rest - 8) if rest else b"")
            return bytes(out)
    out += b"\0" * (len(out) % 2) + chunk
    out[4:8] = struct.pack("<I", len(out) - 8)
    return bytes(out)


def _riff_span(data: bytes, match: Callable[[Part], bool]) -> tuple[int, int] | None:
    p = next((p for p in containers.riff_parts(data) if match(p)), None)
    if p is None:
        return None
    size = struct.unpack_from("<I", data, p.offset + 4)[0]
    return p.offset, 8 + size + size % 2


def avi_info(data: bytes) -> dict[str, str]:
    """INFO fields; of repeated ones the first counts."""
    parts = list(containers.riff_parts(data))
    lists = {p.seq for p in parts if p.kind == "list" and p.type == "INFO"}
    out: dict[str, str] = {}
    for p in parts:
        if p.parent in lists:
            out.setdefault(p.type, p.payload.split(b"\0")[0].decode("utf-8", "replace"))
    return out


def avi_set_info(data: bytes, fields: dict[str, str]) -> bytes:
    """The file with these INFO fields and no others."""
    body = b"".join(k.encode() + struct.pack("<I", len(v) + 1) + v + b"\0" * (1 + (len(v) + 1) % 2) for k, v in ((k, v.encode()) for k, v in fields.items()))
    return avi_place(data, b"LIST", _riff_span(data, lambda p: p.kind == "list" and p.type == "INFO" and p.depth == 0), b"INFO" + body if fields else None)


def _avi_put(data: bytes, carrier: str, value: bytes | None) -> bytes:
    if carrier != "xmp":
        raise NoHome(f"AVI has no place for {carrier}")
    return avi_place(data, b"_PMX", _riff_span(data, lambda p: p.type == "_PMX"), value)


# --- ISO base media


def boxes(data: bytes):
    """(place, size, header, type) of the boxes at the top."""
    at = 0
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1 and at + 16 <= len(data):
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = len(data) - at
        if size < head or at + size > len(data):
            return
        yield at, size, head, kind
        at += size


def bmff_place(data: bytes, match: Callable[[bytes, bytes], bool], kind: bytes, body: bytes | None) -> bytes:
    """The file with a top-level box put, replaced or removed while all others stay: the old one becomes free space, which
    takes the new one if it fits with room for a header or none; else it goes to the end."""
    out = bytearray(data)
    box = None if body is None else struct.pack(">I4s", len(body) + 8, kind) + body
    for at, size, head, name in list(boxes(data)):
        if match(name, bytes(data[at + head : at + size])):
            if box is not None and (size == len(box) or size - len(box) >= 8):
                rest = size - len(box)
                out[at : at + size] = box + (struct.pack(">I4s", rest, b"free") + bytes(rest - 8) if rest else b"")
                box = None
            else:
                out[at : at + size] = struct.pack(">I4s", size, b"free") + bytes(size - 8)
    if box is not None:
        last = list(boxes(data))
        if last and struct.unpack_from(">I", data, last[-1][0])[0] == 0:  # runs to the end: give it its size
            out[last[-1][0] : last[-1][0] + 4] = struct.pack(">I", last[-1][1])
        out += box
    return bytes(out)


def _is_xmp_box(name: bytes, body: bytes) -> bool:
    return name == b"uuid" and body[:16] == XMP_UUID


def _full(body: bytes) -> tuple[int, int]:
    return body[0], int.from_bytes(body[1:4], "big")


def bmff_items(data: bytes) -> list[dict]:
    """Items of the meta box: id, type, name, content type, construction, extents as (place in the file or in idat, size)."""
    parts = list(containers.box_parts(data))
    meta = next((p for p in parts if p.type == "meta" and p.depth == 0), None)
    if meta is None:
        return []
    inner = {p.type: p for p in reversed(parts) if p.parent == meta.seq}
    items: dict[int, dict] = {}
    if (info := inner.get("iinf")) is not None:
        version, _ = _full(info.payload)
        at = 6 if version == 0 else 8
        for start, size, head, kind in boxes(info.payload[at:]):
            body = info.payload[at + start + head : at + start + size]
            if kind != b"infe" or len(body) < 8 or body[0] < 2:
                continue
            wide = 4 if body[0] >= 3 else 2
            number = int.from_bytes(body[4 : 4 + wide], "big")
            rest = body[6 + wide :]
            texts = rest[4:].split(b"\0")
            items[number] = {"id": number, "type": rest[:4].decode("latin-1"), "name": texts[0].decode("utf-8", "replace"), "content_type": texts[1].decode("latin-1") if rest[:4] == b"mime" and len(texts) > 1 else "", "construction": 0, "extents": []}
    if (loc := inner.get("iloc")) is not None:
        body = loc.payload
        version, _ = _full(body)
        offset_size, length_size, base_size, index_size = body[4] >> 4, body[4] & 15, body[5] >> 4, body[5] & 15 if version else 0
        at, wide = 6, 4 if version == 2 else 2
        count, at = int.from_bytes(body[at : at + wide], "big"), at + wide

        def take(n: int) -> int:
            nonlocal at
            value = int.from_bytes(body[at : at + n], "big")
            at += n
            return value

        for _ in range(count):
            if at >= len(body):
                break
            number = take(wide)
            method = take(2) & 15 if version else 0
            take(2)
            base = take(base_size)
            spots = []
            for _ in range(take(2)):
                if at >= len(body):
                    break
                take(index_size)
                field_at = loc.offset + 8 + at
                offset = take(offset_size)
                spots.append((base + offset, take(length_size), field_at, offset_size, length_size, base))
            if number in items and not items[number]["extents"]:  # the first of an id counts
                items[number] |= {"construction": method, "extents": spots}
    return list(items.values())


def bmff_item_data(data: bytes, item: dict) -> bytes | None:
    """The bytes of an item in the file (construction 0) or in idat (1)."""
    if item["construction"] == 1:
        source = next((p.payload for p in containers.box_parts(data) if p.type == "idat"), b"")
    elif item["construction"] == 0:
        source = data
    else:
        return None
    return b"".join(source[a : a + (n or len(source))] for a, n, *_ in item["extents"])


def bmff_set_item(data: bytes, number: int, value: bytes) -> bytes:
    """An item of one extent with other bytes: in its place if they fit, else in a new mdat at the end, the old ones zeroed."""
    item = next((i for i in bmff_items(data) if i["id"] == number), None)
    if item is None or item["construction"] != 0 or len(item["extents"]) != 1:
        raise NoHome(f"item {number} has no bytes of its own in the file")
    at, size, field_at, offset_size, length_size, base = item["extents"][0]
    out = bytearray(data)
    out[at : at + size] = bytes(size)
    if len(value) > size:
        out += struct.pack(">I4s", len(value) + 8, b"mdat")
        at = len(out)
        out += value
        if at - base < 0 or (at - base).bit_length() > 8 * offset_size:
            raise NoHome(f"item {number} cannot be pointed to at {at}")
        out[field_at : field_at + offset_size] = (at - base).to_bytes(offset_size, "big")
    else:
        out[at : at + len(value)] = value
    out[field_at + offset_size : field_at + offset_size + length_size] = len(value).to_bytes(length_size, "big")
    return bytes(out)


def bmff_add_item(data: bytes, kind: bytes, value: bytes, name: str = "") -> bytes:
    """The file with one more item at the end: its info and location are put into the meta box, which grows, and the places of
    items behind it are moved by as much.  Films, whose samples are found by place too, take no items."""
    parts = list(containers.box_parts(data))
    meta = next((p for p in parts if p.type == "meta" and p.depth == 0), None)
    own = {p.type: p for p in parts if meta is not None and p.parent == meta.seq}
    if meta is None or "iinf" not in own or "iloc" not in own or any(p.type == "moov" for p in parts):
        raise NoHome("the file takes no items")
    before = bmff_items(data)
    number = max((i["id"] for i in before), default=0) + 1
    info, loc = own["iinf"].payload, own["iloc"].payload
    version, sizes = loc[0], (loc[4] >> 4, loc[4] & 15, loc[5] >> 4, loc[5] & 15 if loc[0] else 0)
    if not sizes[0] or not sizes[1]:
        raise NoHome("places of items have no bytes")
    infe = b"\2\0\0\0" + struct.pack(">HH", number, 0) + kind + name.encode() + b"\0"
    wide = 2 if info[0] == 0 else 4
    info = info[:4] + (int.from_bytes(info[4 : 4 + wide], "big") + 1).to_bytes(wide, "big") + info[4 + wide :] + struct.pack(">I4s", len(infe) + 8, b"infe") + infe
    wide = 4 if version == 2 else 2
    entry = number.to_bytes(wide, "big") + (b"\0\0" if version else b"") + b"\0\0" + bytes(sizes[2]) + b"\0\1" + bytes(sizes[3]) + bytes(sizes[0]) + len(value).to_bytes(sizes[1], "big")
    loc = loc[:6] + (int.from_bytes(loc[6 : 6 + wide], "big") + 1).to_bytes(wide, "big") + loc[6 + wide :] + entry
    start, size, head, _ = next(b for b in boxes(data) if b[0] == meta.offset)
    body = data[start + head : start + head + 4]
    for at, n, h, k in boxes(data[start + head + 4 : start + size]):
        inner = data[start + head + 4 + at : start + head + 4 + at + n]
        fresh = {b"iinf": info, b"iloc": loc}.get(k)
        body += inner if fresh is None else struct.pack(">I4s", len(fresh) + 8, k) + fresh
    grown = struct.pack(">I4s", len(body) + 8, b"meta") + body
    out = bytearray(data[:start] + grown + data[start + size :])
    out += struct.pack(">I4s", len(value) + 8, b"mdat")
    place = len(out)
    out += value
    for item in bmff_items(bytes(out)):
        for at, _, field_at, offset_size, _, base in item["extents"]:
            if item["id"] == number:
                at = place
            elif item["construction"] == 0 and at >= start + size:
                at += len(grown) - size
            if (at - base).bit_length() > 8 * offset_size:
                raise NoHome(f"item {item['id']} cannot be pointed to at {at}")
            out[field_at : field_at + offset_size] = (at - base).to_bytes(offset_size, "big")
    return bytes(out)


def bmff_brands(data: bytes) -> tuple[str, list[str]] | None:
    box = next((data[a + h : a + n] for a, n, h, k in boxes(data) if k == b"ftyp"), None)
    return None if box is None else (box[:4].decode("latin-1"), [box[i : i + 4].decode("latin-1") for i in range(8, len(box) - 3, 4)])


def bmff_user_data(data: bytes) -> tuple[dict[str, str], dict[str, str]]:
    """QuickTime atoms of udta (u16 size, u16 language, text) and iTunes tags of ilst, by their types."""
    parts = list(containers.box_parts(data))
    by = {p.seq: p for p in parts}
    atoms: dict[str, str] = {}
    tags: dict[str, str] = {}
    for p in parts:
        parent = by.get(p.parent)
        if parent is not None and parent.type == "udta" and p.kind == "box" and len(p.payload) >= 4:
            size = struct.unpack_from(">H", p.payload)[0]
            atoms.setdefault(p.type, p.payload[4 : 4 + size].decode("utf-8", "replace"))
        if parent is not None and parent.type == "ilst":
            for a, n, h, kind in boxes(p.payload):
                body = p.payload[a + h : a + n]
                if kind == b"data" and len(body) >= 8 and struct.unpack_from(">I", body)[0] & 0xFFFFFF == 1:
                    tags.setdefault(p.type, body[8:].decode("utf-8", "replace"))
    return atoms, tags


def _bmff_get(data: bytes, carrier: str) -> bytes | None:
    if carrier == "xmp":
        return next((data[a + h + 16 : a + n] for a, n, h, k in boxes(data) if _is_xmp_box(k, data[a + h : a + n])), None)
    if carrier == "exif":
        item = next((i for i in bmff_items(data) if i["type"] == "Exif"), None)
        body = bmff_item_data(data, item) if item else None
        return body[4 + struct.unpack_from(">I", body)[0] :].removeprefix(EXIF_HEAD) if body and len(body) >= 4 else None
    if carrier == "icc":
        return next((p.payload[4:] for p in containers.box_parts(data) if p.type == "colr" and p.payload[:4] in (b"prof", b"rICC")), None)
    return None


def _bmff_put(data: bytes, carrier: str, value: bytes | None) -> bytes:
    if carrier == "xmp":
        return bmff_place(data, _is_xmp_box, b"uuid", None if value is None else XMP_UUID + value)
    if carrier == "exif":
        item = next((i for i in bmff_items(data) if i["type"] == "Exif"), None)
        if item is None:
            return data if value is None else bmff_add_item(data, b"Exif", bytes(4) + value)
        return bmff_set_item(data, item["id"], b"" if value is None else bytes(4) + value)
    if carrier == "icc":
        box = next((p for p in containers.box_parts(data) if p.type == "colr" and p.payload[:4] in (b"prof", b"rICC")), None)
        if box is None and value is None:
            return data
        if box is None or value is None or len(value) > len(box.payload) - 4:
            raise NoHome("the profile's box is in a list of properties and cannot grow or go")
        at = box.offset + 12
        return data[:at] + value.ljust(len(box.payload) - 4, b"\0") + data[at + len(box.payload) - 4 :]
    raise NoHome(f"ISO base media have no place for {carrier}")


# --- JPEG XL

JXL_MARK = b"\0\0\0\x0cJXL \r\n\x87\n"


def jxl_container(code: bytes) -> bytes:
    """A bare codestream in boxes."""
    return JXL_MARK + struct.pack(">I", 20) + b"ftypjxl \0\0\0\0jxl " + struct.pack(">I", len(code) + 8) + b"jxlc" + code


def jxl_codestream(data: bytes) -> bytes | None:
    """The codestream: bare, whole in jxlc, or the jxlp pieces in the order of their numbers (the top bit marks the last)."""
    if data[:2] == b"\xff\x0a":
        return data
    found = [(k, data[a + h : a + n]) for a, n, h, k in boxes(data)]
    whole = next((b for k, b in found if k == b"jxlc"), None)
    if whole is not None:
        return whole
    pieces = sorted((struct.unpack_from(">I", b)[0] & 0x7FFFFFFF, i, b[4:]) for i, (k, b) in enumerate(found) if k == b"jxlp" and len(b) >= 4)
    return b"".join(b for *_, b in pieces) if pieces else None


_JXL = {"exif": b"Exif", "xmp": b"xml ", "jumbf": b"jumb"}


def _jxl_get(data: bytes, carrier: str) -> bytes | None:
    if carrier not in _JXL or data[:2] == b"\xff\x0a":
        return None
    body = next((data[a + h : a + n] for a, n, h, k in boxes(data) if k == _JXL[carrier]), None)
    return body[4 + struct.unpack_from(">I", body)[0] :] if carrier == "exif" and body is not None and len(body) >= 4 else body


def _jxl_put(data: bytes, carrier: str, value: bytes | None) -> bytes:
    if carrier not in _JXL:
        raise NoHome(f"JPEG XL has no place for {carrier}")
    if data[:2] == b"\xff\x0a":
        if value is None:
            return data
        data = jxl_container(data)
    rows = [(k, data[a : a + n]) for a, n, _, k in boxes(data)]
    at = next((i for i, (k, _) in enumerate(rows) if k == _JXL[carrier]), next((i for i, (k, _) in enumerate(rows) if k in (b"jxlc", b"jxlp")), len(rows)))
    kept = [raw for k, raw in rows if k != _JXL[carrier]]
    if value is not None:
        body = bytes(4) + value if carrier == "exif" else value
        kept.insert(min(at, len(kept)), struct.pack(">I", len(body) + 8) + _JXL[carrier] + body)
    return b"".join(kept)


# --- TIFF


def _tiff_get(data: bytes, carrier: str) -> bytes | None:
    if carrier == "exif":
        return data
    if carrier not in TIFF_TAGS:
        return None
    e = next((e for e in tiff.read(data)[0] if e.ifd == "IFD0" and e.tag == TIFF_TAGS[carrier][0]), None)
    if e is None:
        return None
    return e.values if isinstance(e.values, bytes) else struct.pack(f"{'<' if data[:2] == b'II' else '>'}{len(e.values)}{tiff.TYPES[e.type][0]}", *e.values)


#: Tags that say how a TIFF file's own image lies, which stay when another EXIF block comes in.
IMAGE_TAGS = {254, 255, 256, 257, 258, 259, 262, 263, 266, 273, 277, 278, 279, 282, 283, 284, 288, 289, 290, 291, 292, 293, 296, 301, 317, 320, 322, 323, 324, 325, 330, 338, 339, 340, 341, 347, 512, 513, 514, 529, 530, 531, 532, 700, 33723, 34377, 34675}


def _tiff_put(data: bytes, carrier: str, value: bytes | None) -> bytes:
    if carrier == "exif":
        own = [e for e in tiff.read(data)[0] if e.ifd == "IFD0" and e.tag not in IMAGE_TAGS and e.tag not in tiff.SUB_IFDS]
        changes: dict = {("IFD0", e.tag): None for e in own}
        for e in tiff.read(value)[0] if value is not None else []:
            if e.ifd in ("IFD0", "ExifIFD", "GPS", "Interop") and e.tag not in tiff.SUB_IFDS and not (e.ifd == "IFD0" and e.tag in IMAGE_TAGS):
                changes[e.ifd, e.tag] = (e.type, e.values)
        return tiff.amend(tiff.amend(data, {}, ("Interop", "ExifIFD", "GPS")), changes)
    if carrier not in TIFF_TAGS:
        raise NoHome(f"TIFF has no place for {carrier}")
    tag, kind = TIFF_TAGS[carrier]
    return tiff.amend(data, {("IFD0", tag): None if value is None else (kind, value)})


# --- all of them

CARRIERS = ("exif", "xmp", "icc", "irb", "iptc", "comment", "jumbf")


def get(data: bytes, carrier: str) -> bytes | None:
    """A carrier's bytes in a file, None if it has none.  IPTC datasets are also found inside the resources."""
    kind = containers.detect(data)
    if carrier == "iptc" and kind in ("jpeg", "png", "tiff"):
        own = None if kind == "jpeg" else (_png_get if kind == "png" else _tiff_get)(data, "iptc")
        block = get(data, "irb")
        return own if own is not None else next((body for _, n, _, body in carriers.resources(block) if n == IPTC_RESOURCE), None) if block else None
    if kind == "webp":
        return next((p.payload for p in containers.riff_parts(data) if p.type == _WEBP.get(carrier)), None)
    if kind == "avi":
        return next((p.payload for p in containers.riff_parts(data) if p.type == "_PMX"), None) if carrier == "xmp" else None
    reader = {"jpeg": _jpeg_get, "png": _png_get, "gif": _gif_get, "bmff": _bmff_get, "jxl": _jxl_get, "tiff": _tiff_get}.get(kind or "")
    if reader is None:
        raise Malformed("format not recognised")
    return reader(data, carrier)


def put(data: bytes, carrier: str, value: bytes | None) -> bytes:
    """The file with a carrier set or, by None, removed; NoHome where the container has no place for it."""
    kind = containers.detect(data)
    if kind in ("jpeg", "png", "tiff") and carrier == "iptc":
        if kind == "png" and get(data, "irb") is None:
            return _png_put(data, "iptc", value)
        rows = [(n, name, body) for _, n, name, body in carriers.resources(get(data, "irb") or b"") if n != IPTC_RESOURCE]
        rows = ([(IPTC_RESOURCE, "", value)] if value is not None else []) + rows
        if kind == "tiff":
            data = _tiff_put(data, "iptc", value)
        return put(data, "irb", carriers.resources_write(rows) if rows else None)
    if kind == "jpeg":
        kinds = ("xmp", "xmp-extended") if carrier == "xmp" else (carrier,)
        if carrier not in _ORDER:
            raise NoHome(f"JPEG has no place for {carrier}")
        return _jpeg_put(data, kinds, [] if value is None else jpeg_segments(carrier, value))
    if kind == "png":
        if carrier not in ("exif", "xmp", "icc", "irb", "comment"):
            raise NoHome(f"PNG has no place for {carrier}")
        return _png_put(data, carrier, value)
    writer = {"gif": _gif_put, "webp": _webp_put, "avi": _avi_put, "bmff": _bmff_put, "jxl": _jxl_put, "tiff": _tiff_put}.get(kind or "")
    if writer is None:
        raise Malformed("format not recognised")
    return writer(data, carrier, value)


def trailing(data: bytes) -> bytes:
    """What follows the end of a JPEG, PNG or GIF image."""
    kind = containers.detect(data)
    if kind == "jpeg":
        return data[jpeg_end(data) :]
    return data[_png_end(data) :] if kind == "png" else gif_blocks(data)[2] if kind == "gif" else b""


def without_trailing(data: bytes) -> bytes:
    rest = len(trailing(data))
    return data[: len(data) - rest] if rest else data


def size(data: bytes) -> tuple[int, int] | None:
    """(width, height) of an image or film."""
    kind = containers.detect(data)
    if kind == "jpeg":
        return containers.jpeg_size(data)
    if kind == "png":
        head = next((p.payload for p in containers.png_parts(data) if p.type == "IHDR"), b"")
        return struct.unpack_from(">II", head) if len(head) >= 8 else None
    if kind == "gif":
        return struct.unpack_from("<HH", data, 6)
    if kind == "webp":
        return containers.webp_size(list(containers.riff_parts(data)))
    if kind == "avi":
        head = next((p.payload for p in containers.riff_parts(data) if p.type == "avih"), b"")
        return struct.unpack_from("<II", head, 32) if len(head) >= 40 else None
    if kind == "jxl":
        code = jxl_codestream(data)
        return containers.jxl_size(code) if code else None
    if kind == "tiff":
        by = {e.tag: e.values for e in tiff.read(data)[0] if e.ifd == "IFD0"}
        return (by[256][0], by[257][0]) if by.get(256) and by.get(257) else None
    if kind == "bmff":
        box = next((p.payload for p in containers.box_parts(data) if p.type == "ispe" and len(p.payload) >= 12), None)
        return struct.unpack_from(">II", box, 4) if box else None
    return None


def thumbnail(data: bytes) -> bytes | None:
    """The first of: the EXIF thumbnail, that of the resources (behind its header of 28 bytes), the RGB one of JFIF."""
    block = get(data, "exif")
    if block:
        by = {e.tag: e.values for e in tiff.read(block)[0] if e.ifd == "IFD1"}
        if by.get(513) and by.get(514):
            return block[by[513][0] : by[513][0] + by[514][0]]
    for number in (1036, 1033):
        body = next((b for _, n, _, b in carriers.resources(get(data, "irb") or b"") if n == number and len(b) > 28), None)
        if body:
            return body[28:]
    if containers.detect(data) == "jpeg":
        head = next((carriers.jfif(p.payload) for p in containers.jpeg_parts(data) if p.kind == "jfif"), None)
        return (head["thumb"] or None) if head else None
    return None
