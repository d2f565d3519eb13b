"""Metadata carriers: IPTC datasets, Photoshop resources, ICC profiles, JFIF, PrintIM and JUMBF descriptions."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from tessera.kernels.containers import Malformed


def iptc_datasets(data: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """(seq, record, dataset, value); long sizes are 0x8000 | bytes of the size."""
    at = seq = 0
    while at + 5 <= len(data) and data[at] == 0x1C:
        record, dataset, size = struct.unpack_from(">BBH", data, at + 1)
        at += 5
        if size & 0x8000:
            wide = size & 0x7FFF
            size = int.from_bytes(data[at : at + wide], "big")
            at += wide
        if at + size > len(data):
            raise Malformed("dataset is cut off")
        yield seq, record, dataset, data[at : at + size]
        at, seq = at + size, seq + 1


def iptc_write(sets: list[tuple[int, int, bytes]]) -> bytes:
    out = bytearray()
    for record, dataset, value in sets:
        size = struct.pack(">H", len(value)) if len(value) < 0x8000 else b"\x80\x04" + struct.pack(">I", len(value))
        out += bytes([0x1C, record, dataset]) + size + value
    return bytes(out)


def resources(data: bytes) -> Iterator[tuple[int, int, str, bytes]]:
    """(seq, id, name, data) of 8BIM blocks; bytes that are none are skipped up to the next signature."""
    at = data.find(b"8BIM")
    seq = 0
    while at >= 0 and at + 11 < len(data):
        number, length = struct.unpack_from(">HB", data, at + 4)
        name = data[at + 7 : at + 7 + length]
        body = at + 7 + length + (1 - length % 2)
        if body + 4 > len(data):
            return
        size = struct.unpack_from(">I", data, body)[0]
        if body + 4 + size > len(data):
            return
        yield seq, number, name.decode("latin-1"), data[body + 4 : body + 4 + size]
        seq += 1
        at = data.find(b"8BIM", body + 4 + size)


def resources_write(items: list[tuple[int, str, bytes]]) -> bytes:
    out = bytearray()
    for number, name, body in items:
        label = name.encode("latin-1")[:255]
        out += b"8BIM" + struct.pack(">HB", number, len(label)) + label + b"\0" * (1 - len(label) % 2) + struct.pack(">I", len(body)) + body + b"\0" * (len(body) % 2)
    return bytes(out)


def icc_header(data: bytes) -> dict | None:
    if len(data) < 132 or data[36:40] != b"acsp":
        return None
    text = lambda a: data[a : a + 4].decode("latin-1").strip("\0 ")
    year, month, day, hour, minute, second = struct.unpack_from(">6H", data, 24)
    return {
        "size": struct.unpack_from(">I", data)[0], "cmm": text(4), "version": f"{data[8]}.{data[9] >> 4}.{data[9] & 15}", "class": text(12), "space": text(16), "pcs": text(20),
        "created": f"{year:04d}-{month:02d}-{day:02d} {hour:02d}:{minute:02d}:{second:02d}" if year else None, "platform": text(40), "flags": struct.unpack_from(">I", data, 44)[0],
        "manufacturer": text(48), "model": text(52), "intent": struct.unpack_from(">I", data, 64)[0], "illuminant": [x / 65536 for x in struct.unpack_from(">3i", data, 68)], "creator": text(80),
    }


def icc_tags(data: bytes) -> Iterator[tuple[int, str, str, bytes]]:
    """(seq, signature, type, data); tags outside the profile are left out."""
    if len(data) < 132 or data[36:40] != b"acsp":
        raise Malformed("no ICC profile")
    for i in range(min(struct.unpack_from(">I", data, 128)[0], (len(data) - 132) // 12)):
        sign, at, size = struct.unpack_from(">4sII", data, 132 + 12 * i)
        if at + size <= len(data):
            yield i, sign.decode("latin-1"), data[at : at + 4].decode("latin-1"), data[at : at + size]


def icc_write(header: bytes, tags: list[tuple[str, bytes]]) -> bytes:
    """A profile of a 128-byte header and tags; equal bodies are stored once, on places of four, and the old id is zeroed."""
    at = 132 + 12 * len(tags)
    at += -at % 4
    index, heap, known = bytearray(), bytearray(), {}
    for sign, body in tags:
        if body not in known:
            known[body] = at + len(heap)
            heap += body + b"\0" * (-len(body) % 4)
        index += struct.pack(">4sII", sign.encode("latin-1").ljust(4)[:4], known[body], len(body))
    total = at + len(heap)
    head = struct.pack(">I", total) + header[4:84] + bytes(16) + header[100:128]
    return head + struct.pack(">I", len(tags)) + bytes(index).ljust(at - 132, b"\0") + bytes(heap)


def jfif(data: bytes) -> dict | None:
    if not data.startswith(b"JFIF\0") or len(data) < 14:
        return None
    major, minor, units, x, y, w, h = struct.unpack_from(">BBBHHBB", data, 5)
    return {"version": f"{major}.{minor:02d}", "units": units, "x_density": x, "y_density": y, "thumb_width": w, "thumb_height": h, "thumb": data[14 : 14 + 3 * w * h]}


def print_im(data: bytes, order: str = ">") -> tuple[str, list[tuple[int, bytes]]] | None:
    """(version, entries) of a PrintIM block; the count stands where it fills the block exactly, before or after a NUL more."""
    if not data.startswith(b"PrintIM\0"):
        return None
    version = data[8:12].decode("latin-1")
    for at in (14, 15):
        if at + 2 <= len(data) and (n := struct.unpack_from(order + "H", data, at)[0]) * 6 == len(data) - at - 2:
            break
    else:
        at = 14
        n = min(struct.unpack_from(order + "H", data, at)[0], (len(data) - at - 2) // 6) if len(data) >= 16 else 0
    return version, [(struct.unpack_from(order + "H", data, at + 2 + 6 * i)[0], data[at + 4 + 6 * i : at + 8 + 6 * i]) for i in range(n)]


def jumbf_description(data: bytes) -> dict | None:
    if len(data) < 17:
        return None
    toggles, at = data[16], 17
    out = {"uuid": data[:16].hex(), "toggles": toggles, "label": None, "id": None, "signature": None}
    if toggles & 2:
        end = data.find(b"\0", at)
        if end < 0:
            return None
        out["label"], at = data[at:end].decode("utf-8", "replace"), end + 1
    if toggles & 4:
        out["id"], at = int.from_bytes(data[at : at + 4], "big"), at + 4
    if toggles & 8:
        out["signature"] = data[at : at + 32].hex()
    return out


def picture_info(data: bytes) -> dict[str, str]:
    """Key=Value lines; [sections] and other lines are skipped, the last of a key wins."""
    lines = data.decode("latin-1").replace("\r\n", "\n").replace("\r", "\n").split("\n")
    pairs = (line.partition("=") for line in lines if "=" in line and not line.lstrip().startswith("["))
    return {k.strip(): v.strip("\0 ") for k, _, v in pairs}
