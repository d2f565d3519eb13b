"""Maker notes, Exif audio and JUMBF boxes."""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass, field

from tessera.kernels import carriers, containers, meta, tiff
from tessera.kernels.files import boxes

# --- maker notes


@dataclass(frozen=True)
class Variant:
    """How a maker's note is laid out: its first bytes, where its directory begins, byte order and what offsets count from."""

    name: str
    group: str | None
    marks: tuple[bytes, ...] = ()
    at: int | None = 0
    order: str | None = None
    local: bool = False
    pointer: int | None = None  # the place of a little-endian offset of the directory
    inner: bool = False  # a TIFF block of its own follows the mark
    thumbnails: tuple[int, ...] = ()
    text: bool = False


# Makers by what the camera's make holds, and their variants in the order they are tried.
MAKERS: dict[str, tuple[tuple[str, ...], tuple[Variant, ...]]] = {
    "Agfa": (("agfa",), (Variant("Agfa", "Olympus", (b"AGFA \0\1",), 8),)),
    "Canon": (("canon",), (Variant("Canon", "Canon"),)),
    "Casio": (("casio",), (Variant("Casio Type 2", "Casio Type 2", (b"QVC\0\0\0",), 6, ">", thumbnails=(4, 8192)), Variant("Casio Type 1", "Casio Type 1", (), 0, ">"))),
    "Epson": (("epson",), (Variant("Epson", "Olympus", (b"EPSON\0\1\0",), 8),)),
    "Fujifilm": (("fuji", "nikon"), (Variant("Fujifilm", "Fujifilm", (b"FUJIFILM",), None, "<", True, 8),)),
    "Konica Minolta": (("konica", "minolta"), (Variant("Konica Minolta (undecoded)", None, (b"MLY", b"KC", b"+M+M+M+M", b"MINOL"), None), Variant("Minolta", "Olympus", (), 0, thumbnails=(136, 129)))),
    "Kyocera": (("contax", "kyocera"), (Variant("Kyocera", "Kyocera", (b"KYOCERA \0\0\0",), 22, None, True),)),
    "Nikon": (("nikon",), (Variant("Nikon Type 1", "Nikon Type 1", (b"Nikon\0\1\0",), 8), Variant("Nikon Type 3", "Nikon Type 3", (b"Nikon\0\2\x10\0\0", b"Nikon\0\2\0\0\0"), 10, inner=True), Variant("Nikon Type 2", "Nikon Type 3"))),
    "Olympus": (("olympus",), (Variant("Olympus", "Olympus", (b"OLYMP\0\1", b"OLYMP\0\2"), 8, thumbnails=(136, 129)),)),
    "Panasonic": (("panasonic",), (Variant("Panasonic", "Panasonic", (b"Panasonic\0\0\0",), 12), Variant("Panasonic Empty Makernote", None, (b"MKED",), None))),
    "Pentax": (("pentax", "asahi"), (Variant("Pentax Type 2", "Casio Type 2", (b"AOC\0",), 6), Variant("Pentax Type 1", "Pentax"))),
    "Ricoh": (("ricoh",), (Variant("Ricoh Text", None, (b"Rv", b"Rev"), None, text=True), Variant("Ricoh Empty Makernote", None, (), None), Variant("Ricoh", "Ricoh", (b"Ricoh", b"RICOH"), 8, ">"))),
    "Sony": (("sony",), (Variant("Sony", "Sony", (b"SONY CAM \0\0\0", b"SONY DSC \0\0\0"), 12),)),
}
# Names of tags in notes.
TAG_NAMES: dict[str, dict[int, str]] = {
    "Canon": {1: "Camera Settings 1", 4: "Camera Settings 2", 6: "Image Type", 7: "Firmware Version", 8: "Image Number", 9: "Owner Name", 12: "Camera Serial Number", 15: "Custom Functions"},
    "Casio Type 1": {1: "Recording Mode", 2: "Quality", 3: "Focusing Mode", 4: "Flash Mode", 5: "Flash Intensity", 6: "Object Distance", 7: "White Balance", 10: "Digital Zoom", 11: "Sharpness", 12: "Contrast", 13: "Saturation", 20: "CCD Sensitivity"},
    "Casio Type 2": {2: "Preview Thumbnail Dimensions", 3: "Preview Thumbnail Size", 4: "Preview Thumbnail", 8: "Quality Mode", 9: "Image Size", 13: "Focus Mode", 20: "Iso Sensitivity", 25: "White Balance", 29: "Focal Length", 31: "Saturation", 32: "Contrast", 33: "Sharpness"},
}
_READERS: dict[str, Callable[[str, Note], dict]] = {}


@dataclass
class Note:
    maker: str
    variant: str
    group: str | None
    entries: list[tiff.Entry] = field(default_factory=list)
    sub: list[tiff.Entry] = field(default_factory=list)
    text: str | None = None
    raw: bytes = b""
    thumbnails: tuple[int, ...] = ()

    def values(self) -> dict[str, str | None]:
        """Tags by name; unknown ones by their number."""
        names = TAG_NAMES.get(self.group or "", {})
        return {names.get(e.tag, f"Tag 0x{e.tag:04X}"): (e.values.rstrip(b"\0").decode("utf-8", "replace").strip() if isinstance(e.values, bytes) and e.type == 2 else meta.number_text(e)) for e in self.entries}

    def thumbnail(self) -> bytes | None:
        """A picture in the note; a first byte that the maker has struck out is mended."""
        for number in self.thumbnails:
            e = next((e for e in self.entries if e.tag == number and isinstance(e.values, bytes)), None)
            if e is not None and e.values[1:2] == b"\xd8":
                return b"\xff" + e.values[1:]
        return None

    def settings(self, number: int) -> list[int]:
        """A block of 16-bit settings without its leading size."""
        e = next((e for e in self.entries if e.tag == number and not isinstance(e.values, bytes)), None)
        return [int(v) for v in e.values[1:]] if e else []

    def custom_functions(self, number: int = 15) -> dict[int, int]:
        """Functions of the high bytes and their values of the low ones."""
        return {v >> 8: v & 255 for v in self.settings(number)}


def register_maker(name: str, makes: tuple[str, ...], variants: tuple[Variant, ...], reader: Callable[[str, Note], dict] | None = None) -> None:
    """One more maker, tried after the known ones; a reader of its own gives further values."""
    MAKERS[name] = (makes, variants)
    if reader is not None:
        _READERS[name] = reader


def _matches(v: Variant, note: bytes) -> bool:
    if v.marks:
        return note.startswith(v.marks)
    return v.group is not None or not note.strip(b"\0")


def maker_of(make: str, note: bytes) -> tuple[str, Variant] | None:
    """The maker and variant of a note: Fujifilm's mark counts whatever the make, then makers in order."""
    if note.startswith(b"FUJIFILM"):
        return "Fujifilm", MAKERS["Fujifilm"][1][0]
    for name, (makes, variants) in MAKERS.items():
        if any(m in make.lower() for m in makes):
            for v in variants:
                if _matches(v, note):
                    return name, v
    return None


def read_ifd(block: bytes, at: int, order: str, base: int = 0) -> list[tiff.Entry]:
    """One directory anywhere in a block whose value offsets count from base."""
    return [e for e in tiff.read(block, at, base, order)[0] if e.ifd == "IFD0"] if 0 <= at < len(block) else []


def note_of(block: bytes) -> Note | None:
    """The maker note of an EXIF block, read by its maker's layout."""
    entries, _ = tiff.read(block)
    raw = next((e for e in entries if e.ifd == "ExifIFD" and e.tag == 37500 and isinstance(e.values, bytes)), None)
    make = next((e.values.rstrip(b"\0").decode("latin-1") for e in entries if e.ifd == "IFD0" and e.tag == 271 and isinstance(e.values, bytes)), "")
    found = maker_of(make, raw.values) if raw is not None and raw.values else None
    if found is None:
        return None
    name, v = found
    order = v.order or ("<" if block[:2] == b"II" else ">")
    note = Note(name, v.name, v.group, raw=raw.values, thumbnails=v.thumbnails)
    if v.text:
        note.text = raw.values.rstrip(b"\0").decode("latin-1")
    if v.group is None:
        return note
    if v.inner:
        note.entries = [e for e in tiff.read(raw.values[v.at :])[0] if e.ifd == "IFD0"]
        return note
    at = struct.unpack_from("<I", raw.values, v.pointer)[0] if v.pointer is not None and len(raw.values) >= v.pointer + 4 else v.at
    note.entries = read_ifd(raw.values, at, order) if v.local else read_ifd(block, raw.offset + at, order)
    if name == "Ricoh":
        own = next((e for e in note.entries if e.tag == 8193), None)
        if own is not None and isinstance(own.values, bytes) and own.values.startswith(b"[Ricoh Camera Info]"):
            note.sub = read_ifd(own.values, 20, ">")
    return note


# --- Exif audio

WAVE_FORMAT = "<HHIIHH"


def wave(data: bytes) -> dict | None:
    """The format, length in seconds and attributes of a WAVE file; the Exif list holds its attributes."""
    if data[:4] not in (b"RIFF", b"RF64") or data[8:12] != b"WAVE":
        return None
    parts = list(containers.riff_parts(data))
    head = next((p.payload for p in parts if p.type == "fmt " and len(p.payload) >= 16), None)
    size = sum(len(p.payload) for p in parts if p.type == "data")
    lists = {p.seq for p in parts if p.kind == "list" and p.type == "exif"}
    out: dict = {"attributes": {p.type: p.payload.split(b"\0")[0].decode("utf-8", "replace") for p in parts if p.parent in lists and p.type != "ecor"}, "exif": bool(lists)}
    if head is not None:
        kind, channels, rate, byte_rate, _, bits = struct.unpack_from(WAVE_FORMAT, head)
        out |= {"format": kind, "channels": channels, "rate": rate, "byte_rate": byte_rate, "bits": bits, "seconds": size / byte_rate if byte_rate >= 1 else None}
    return out


def wave_write(sound: bytes, channels: int, rate: int, bits: int, attributes: dict[str, str] | None = None) -> bytes:
    p = containers.Part
    step = channels * bits // 8
    rows = [p(0, -1, 0, "chunk", "fmt ", 0, struct.pack(WAVE_FORMAT, 1, channels, rate, rate * step, step, bits))]
    if attributes:
        rows += [p(1, -1, 0, "list", "exif", 0, b""), *(p(10 + i, 1, 1, "chunk", k, 0, v.encode() + b"\0") for i, (k, v) in enumerate(attributes.items()))]
    return containers.riff_write("WAVE", [*rows, p(2, -1, 0, "chunk", "data", 0, sound)])


# --- JUMBF

#: Content types by their four letters; a uuid is those letters and a common rest.
JUMBF_REST = bytes.fromhex("00110010800000aa00389b71")


def _box(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I4s", len(body) + 8, kind) + body


def jumbf_description(content: bytes, label: str | None = None, number: int | None = None, signature: bytes | None = None, requestable: bool = True) -> bytes:
    toggles = requestable | (label is not None) << 1 | (number is not None) << 2 | (signature is not None) << 3
    return content + JUMBF_REST + bytes([toggles]) + (label.encode() + b"\0" if label is not None else b"") + (struct.pack(">I", number) if number is not None else b"") + (signature or b"")


def jumbf_write(content: bytes, label: str, body: bytes) -> bytes:
    """A superbox of a description and one content box: `xml `, `json` or `Exif`."""
    return _box(b"jumb", _box(b"jumd", jumbf_description(content, label)) + _box(content, body))


def jumbf_xml(label: str, xml: str) -> bytes:
    return jumbf_write(b"xml ", label, xml.encode())


def jumbf_json(label: str, json: str) -> bytes:
    return jumbf_write(b"json", label, json.encode())


def jumbf_exif(label: str, block: bytes) -> bytes:
    return jumbf_write(b"Exif", label, block)


def jumbf_read(data: bytes) -> list[dict]:
    """Superboxes in order: label, content type, content, and nested ones with their depth."""
    out = []

    def walk(block: bytes, depth: int) -> None:
        for at, size, head, kind in boxes(block):
            if kind != b"jumb" or depth > containers.MAX_DEPTH:
                continue
            body = block[at + head : at + size]
            inner = [(k, body[a + h : a + n]) for a, n, h, k in boxes(body)]
            told = next((carriers.jumbf_description(b) for k, b in inner if k == b"jumd"), None)
            content = next(((k, b) for k, b in inner if k not in (b"jumd", b"jumb", b"free")), (b"", b""))
            out.append({"depth": depth, "label": told["label"] if told else None, "uuid": told["uuid"] if told else None, "type": content[0].decode("latin-1"), "content": content[1]})
            walk(body, depth + 1)

    walk(data, 0)
    return out
