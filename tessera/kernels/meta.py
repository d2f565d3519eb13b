"""What carriers say, and changes of it: fields by name, private data, conformance, and the merged view of a file's info."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable

from tessera.dims import tags as dims
from tessera.kernels import carriers, containers, files, text, tiff, xmp

IFD_OF = {"TIFF": "IFD0", "EXIF": "ExifIFD", "GPS": "GPS", "Interoperability": "Interop"}
GROUP_OF = {v: k for k, v in IFD_OF.items()} | {"IFD1": "TIFF"}
NAME_OF = {(g, t): n for g, t, n in dims.EXIF_TAGS}
BY_NAME: dict[str, tuple[str, int]] = {}
for _g, _t, _n in sorted(dims.EXIF_TAGS + dims.EXIF_ALIASES, key=lambda r: dims.RANKS.index(r[0])):
    BY_NAME.setdefault(_n.lower(), (_g, _t))
MEANINGS = {(t, v): m for t, v, m in dims.EXIF_MEANINGS}
_LOOKED_UP = {t for t, _, _ in dims.EXIF_MEANINGS}

# --- EXIF


def exif_set(block: bytes | None, values: dict) -> tuple[bytes, dict[str, bool]]:
    """The block with fields set by name, and which names are known.  Types follow the value: text is ASCII with a NUL (UTF-8
    where it must be), whole numbers LONG, others a RATIONAL of millionths, pairs RATIONALs, lists LONGs; None removes."""
    block = block or b"MM\0*\0\0\0\x08\0\0\0\0\0\0"
    changes, known = {}, {}
    for name, value in values.items():
        found = BY_NAME.get(name.lower())
        known[name] = found is not None
        if found is None:
            continue
        key = IFD_OF[found[0]], found[1]
        if value is None:
            changes[key] = None
        elif isinstance(value, str):
            changes[key] = (2 if value.isascii() else 129, value.encode() + b"\0")
        elif isinstance(value, int):
            changes[key] = (4, [value])
        elif isinstance(value, float):
            changes[key] = (5, [(round(value * 1_000_000), 1_000_000)])
        else:
            rows = list(value)
            changes[key] = (5, [tuple(x) for x in rows]) if rows and not isinstance(rows[0], int) else (4, rows)
    places = tiff.directories(block)
    gone = {k: v for k, v in changes.items() if v is not None or k[0] in places}
    return (tiff.amend(block, gone) if gone else block), known


def number_text(e: tiff.Entry) -> str:
    """Numbers as text: quotients to four decimals, unit fractions and divisions by zero as they are, floats in full."""
    if isinstance(e.values, bytes):
        return " ".join(str(x) for x in e.values)
    out = []
    for v in e.values:
        if isinstance(v, tuple):
            n, d = v
            out.append(f"{n}/{d}" if d == 0 or (abs(n) == 1 and abs(d) > 1) else f"{n / d:.4f}".rstrip("0").rstrip("."))
        else:
            out.append(text.float_text(v) if e.type == 11 else repr(v) if isinstance(v, float) and v != int(v) else str(int(v)) if isinstance(v, float) else str(v))
    return ", ".join(out)


def _special(e: tiff.Entry, order: str) -> str | None:
    raw = e.values if isinstance(e.values, bytes) else bytes(x & 255 for x in e.values if isinstance(x, int))
    if e.tag == 37121:
        return " ".join({0: "-", 1: "Y", 2: "Cb", 3: "Cr", 4: "R", 5: "G", 6: "B"}.get(x, f"?{x}") for x in raw)
    if e.tag == 530:
        key = ",".join(map(str, e.values)) if not isinstance(e.values, bytes) else ""
        return {"1,1": "YCbCr 4:4:4", "2,1": "YCbCr 4:2:2", "2,2": "YCbCr 4:2:0", "4,1": "YCbCr 4:1:1", "4,2": "YCbCr 4:1:0"}.get(key, key)
    if e.tag == 41730:
        if len(raw) < 4:
            return None
        columns, rows = struct.unpack_from(">HH", raw)
        if not columns or not rows or len(raw) < 4 + columns * rows:
            return None
        cells = [dict(enumerate("RGBCMYW")).get(x, "?") for x in raw[4 : 4 + columns * rows]]
        return " / ".join("".join(cells[i : i + columns]) for i in range(0, len(cells), columns))
    if e.tag == 513:
        return "JPEG thumbnail data"
    if e.tag == 37511:
        return "; ".join(f"{u}: {i}" for u, i in text.learning_read(raw, order).items()) or None
    if e.tag == 41997:
        value = e.values[0] if not isinstance(e.values, bytes) and e.values else 0
        return f"{value >> 8 & 255:02X}; {value & 255:02X}"
    return None


_SPECIAL = {37121, 530, 41730, 513, 37511, 41997}
_CODED = {37510, 27, 28}
_OPAQUE = {34665, 34853, 40965, 37500, 700, 33723, 34377, 50341}


def exif_text(e: tiff.Entry, order: str = ">") -> str | None:
    """An entry as people read it: meanings of values, trimmed text, coordinates, numbers."""
    group = GROUP_OF.get(e.ifd, "TIFF")
    if group != "GPS" and e.tag in _OPAQUE:
        return None
    if group != "GPS" and e.tag in _SPECIAL:
        return _special(e, order)
    if e.tag in _CODED and isinstance(e.values, bytes) and (group == "GPS") == (e.tag < 100):
        return text.coded_read(e.values)
    if group in ("TIFF", "EXIF") and e.tag in _LOOKED_UP and not isinstance(e.values, bytes) and e.values and isinstance(e.values[0], int):
        return ", ".join(MEANINGS.get((e.tag, v), f"Unknown ({v})") for v in e.values)
    if isinstance(e.values, bytes) and e.type in (2, 129):
        return e.values.rstrip(b"\0").decode("utf-8", "replace").strip()
    if group == "GPS" and e.type in (5, 10) and len(e.values) == 3 and all(d for _, d in e.values):
        a, b, c = (n / d for n, d in e.values)
        if e.tag in (2, 4):
            return f"{a:g}° {b:g}' {c:g}\""
        if e.tag == 7:
            return f"{int(a):02d}:{int(b):02d}:{int(c):02d}"
    return number_text(e)


def exif_texts(block: bytes) -> dict[str, str]:
    """Names and texts of all fields; unknown ones are named by their number."""
    order = "<" if block[:2] == b"II" else ">"
    out = {}
    for e in tiff.read(block)[0]:
        if e.ifd != "IFD1" and (found := exif_text(e, order)) is not None:
            out[NAME_OF.get((GROUP_OF.get(e.ifd, ""), e.tag), f"Tag 0x{e.tag:04X}")] = found
    return out


def exif_value(block: bytes, name: str):
    """A field's value by name: text, a number, a list."""
    found = BY_NAME.get(name.lower())
    e = next((e for e in tiff.read(block)[0] if found and e.ifd == IFD_OF[found[0]] and e.tag == found[1]), None)
    if e is None:
        return None
    if isinstance(e.values, bytes):
        return e.values.rstrip(b"\0").decode("utf-8", "replace").strip() if e.type in (2, 129) else e.values
    values = [n / d if d else None for n, d in e.values] if e.type in (5, 10) else list(e.values)
    return values[0] if len(values) == 1 else values


# --- IPTC

DATASET_OF = {n.lower(): (r, d) for r, d, n, _ in dims.IPTC_SETS} | {n.lower(): x for n, x in dims.IPTC_ALIASES.items()}
DATASET_NAME = {(r, d): n for r, d, n, _ in dims.IPTC_SETS}
#: Numbers of two bytes, and datasets that are dates or times.
IPTC_SHORTS = {(1, 0), (1, 20), (1, 22), (1, 120), (1, 122), (2, 0), (2, 200), (2, 201), (3, 0), (3, 20), (3, 30), (3, 40), (3, 50), (3, 60), (3, 84), (3, 140), (3, 145)}
IPTC_DATES = {(1, 70), (2, 30), (2, 37), (2, 47), (2, 55), (2, 62)}
IPTC_TIMES = {(1, 80), (2, 35), (2, 38), (2, 60), (2, 63)}
#: The most bytes of text datasets.
IPTC_MOST = {(1, 5): 1024, (1, 30): 10, (1, 50): 32, (1, 100): 80, (2, 5): 64, (2, 7): 64, (2, 15): 3, (2, 20): 32, (2, 22): 32, (2, 25): 64, (2, 27): 64, (2, 40): 256, (2, 65): 32, (2, 70): 10, (2, 80): 32, (2, 85): 32, (2, 90): 32, (2, 92): 32, (2, 95): 32, (2, 101): 64, (2, 103): 32, (2, 105): 256, (2, 110): 32, (2, 115): 32, (2, 116): 128, (2, 118): 128, (2, 120): 2000, (2, 121): 256, (2, 122): 32}
SCRUBBED_DATE = "19000101"
SERVICE = "TESSERA"


def dataset_id(name: str) -> tuple[int, int] | None:
    """(record, number) of a dataset by name, other name, `2#025` or the packed number."""
    if m := re.fullmatch(r"(\d+)#(\d+)", name):
        found = int(m[1]), int(m[2])
    elif name.isdigit():
        found = divmod(int(name), 256)
    else:
        return DATASET_OF.get(name.lower())
    return found if found in DATASET_NAME else None


def envelope_number(service: str, date: str) -> str:
    return f"{zlib.crc32((service + date).encode()) % 100_000_000:08d}"


def iptc_values(block: bytes) -> list[tuple[int, int, int | str]]:
    """(record, number, value) in order: numbers, and texts in the charset that 1:90 names for what follows."""
    charset, out = None, []
    for _, record, number, value in carriers.iptc_datasets(block):
        if (record, number) in IPTC_SHORTS:
            out.append((record, number, int.from_bytes(value[:2], "big")))
        elif (record, number) == (1, 90):
            charset = text.ESCAPES.get(value, charset)
            out.append((record, number, text.ESCAPES.get(value, value.decode("latin-1"))))
        else:
            out.append((record, number, text.from_charset(value, charset if record > 1 else None)))
    return out


def coerced(key: tuple[int, int], value) -> bytes:
    """A value as a dataset holds it: numbers in range, dates and times from common forms, texts cut at a character."""
    if key in IPTC_SHORTS:
        return struct.pack(">H", max(0, min(65535, int(value))))
    if key in IPTC_DATES:
        value = text.iptc_date(str(value))
    elif key in IPTC_TIMES:
        value = text.iptc_time(str(value))
    if isinstance(value, bytes):
        return value
    return text.cut_utf8(str(value), IPTC_MOST.get(key, 32767))


def iptc_set(sets: list[tuple[int, int, bytes]], name: str, value, as_read: bool = True) -> list[tuple[int, int, bytes]]:
    """Datasets with one set (a list for several) or, by None, removed.  In sets read from a file a new one comes before the
    first later record, others keep their order; sets that are built are sorted.  The envelope number follows its parts."""
    key = dataset_id(name)
    if key is None:
        raise ValueError(f"{name} is no dataset")
    values = [] if value is None else [coerced(key, v) for v in (value if isinstance(value, (list, tuple)) else [value])]
    repeats = key in dims.IPTC_REPEATS
    values = values if repeats else values[:1]
    old = [i for i, s in enumerate(sets) if s[:2] == key]
    rows = [s for s in sets if s[:2] != key]
    at = old[0] if old else next((i for i, s in enumerate(rows) if s[0] > key[0]), len(rows))
    out = rows[:at] + [(*key, v) for v in values] + rows[at:]
    if key in ((1, 30), (1, 70)):
        before, after = ({s[:2]: s[2].decode("latin-1") for s in x} for x in (sets, out))
        if (1, 30) in after and (1, 70) in after:
            stale = before.get((1, 40))
            if stale is None or stale == envelope_number(before.get((1, 30), ""), before.get((1, 70), "")):
                out = iptc_set(out, "EnvelopeNumber", envelope_number(after[1, 30], after[1, 70]))
    return out if as_read else sorted(out, key=lambda s: s[:2])


def iptc_rows(block: bytes | None) -> list[tuple[int, int, bytes]]:
    return [x[1:] for x in carriers.iptc_datasets(block)] if block else []


# --- private data


def _flags(names: Iterable[str], types: int) -> bool:
    return any(types & dims.PRIVACY[n] for n in names)


def scrub_exif(block: bytes, types: int) -> tuple[bytes, int]:
    have = {(e.ifd, e.tag) for e in tiff.read(block)[0]}
    gone = {(IFD_OF[g], t) for g, t, f in dims.PRIVATE_TAGS if types & dims.PRIVACY[f]} & have
    drop = tuple(n for n, (parent, tag) in (("Interop", tiff.PARENTS["Interop"]), ("GPS", tiff.PARENTS["GPS"])) if (parent, tag) in gone)
    if types & dims.PRIVACY["Thumbnail"] and any(i == "IFD1" for i, _ in have):
        drop += ("IFD1",)
    changes = {k: None for k in gone if k not in (tiff.PARENTS["Interop"], tiff.PARENTS["GPS"])}
    count = len(changes) + len(drop)
    return (tiff.amend(block, changes, drop) if count else block), count


def scrub_xmp(packet: str, types: int) -> tuple[str, int]:
    have = xmp.read(packet) or {}
    gone = [n for n, f in dims.PRIVATE_PROPERTIES if types & dims.PRIVACY[f] and n in have]
    return (xmp.edit(packet, dict.fromkeys(gone)) if gone else packet), len(gone)


def scrub_iptc(block: bytes, types: int) -> tuple[bytes, int]:
    sets = iptc_rows(block)
    have = {s[:2] for s in sets}
    gone = {DATASET_OF[n.lower()] for n, f in dims.PRIVATE_DATASETS if types & dims.PRIVACY[f]} & have
    count = len(gone)
    sets = [s for s in sets if s[:2] not in gone]
    by = {s[:2]: s[2].decode("latin-1") for s in sets}
    replaced: dict[tuple[int, int], str] = {}
    if types & dims.PRIVACY["Timestamp"] and by.get((1, 70), SCRUBBED_DATE) != SCRUBBED_DATE:
        replaced[1, 70] = SCRUBBED_DATE
    if types & (dims.PRIVACY["Timestamp"] | dims.PRIVACY["SerialNumber"] | dims.PRIVACY["Author"]) and (1, 40) in by:
        number = envelope_number(by.get((1, 30), SERVICE), replaced.get((1, 70), by.get((1, 70), SCRUBBED_DATE)))
        if number != by[1, 40]:
            replaced[1, 40] = number
    sets = [(*s[:2], replaced[s[:2]].encode()) if s[:2] in replaced else s for s in sets]
    return carriers.iptc_write(sets), count + len(replaced)


def scrub_resources(block: bytes, types: int) -> tuple[bytes, int]:
    """Resources and the datasets inside; the datasets are scrubbed rather than dropped."""
    gone = {i for f, ids in dims.PRIVATE_RESOURCES.items() if types & dims.PRIVACY[f] for i in ids}
    rows, count = [], 0
    for _, number, name, body in carriers.resources(block):
        if number in gone:
            count += 1
            continue
        if number == files.IPTC_RESOURCE:
            body, n = scrub_iptc(body, types)
            count += n
        rows.append((number, name, body))
    return carriers.resources_write(rows), count


def _scrub_format(data: bytes, types: int) -> tuple[bytes, int]:
    kind, count = containers.detect(data), 0
    told = types & dims.PRIVACY["Description"]
    if kind == "jpeg":
        parts = list(containers.jpeg_parts(data))
        kept = []
        for p in parts:
            if p.kind == "comment" and told:
                count += 1
            elif p.kind == "jfxx" and types & dims.PRIVACY["Thumbnail"]:
                count += 1
            elif p.kind == "jfif" and types & dims.PRIVACY["Thumbnail"] and len(p.payload) > 14 and p.payload[12] and p.payload[13]:
                kept.append(containers.Part(0, -1, 0, "jfif", p.type, 0, p.payload[:12] + b"\0\0"))
                count += 1
            elif p.type == "EC" and b"[picture info]" in p.payload[:64].lower() and _flags(("CameraModel", "SerialNumber", "Timestamp"), types):
                count += 1
            else:
                kept.append(p)
        if count:
            data = containers.jpeg_write(kept)
    elif kind == "png":
        tail = files.trailing(data)
        kept = []
        for p in containers.png_parts(data):
            key = p.payload.partition(b"\0")[0].decode("latin-1")
            if p.type in ("tEXt", "zTXt", "iTXt") and key.encode("latin-1") != files.XMP_KEYWORD and not key.startswith("Raw profile type") and _flags((*dims.PRIVATE_KEYWORDS.get(key, ()), "Description"), types):
                count += 1
            else:
                kept.append(p)
        if count:
            data = containers.png_write(kept) + tail
    elif kind == "gif" and told:
        head, rows, tail = files.gif_blocks(data)
        kept = [r for r in rows if r[0] != "comment"]
        count = len(rows) - len(kept)
        if count:
            data = files.gif_join(head, kept, tail)
    elif kind == "avi":
        fields = files.avi_info(data)
        gone = {i for f, ids in dims.PRIVATE_INFO.items() if types & dims.PRIVACY[f] for i in ids} & fields.keys()
        if gone:
            data = files.avi_set_info(data, {k: v for k, v in fields.items() if k not in gone})
            count += len(gone)
        span = files._riff_span(data, lambda p: p.type == "IDIT" and p.depth == 0)
        if types & dims.PRIVACY["Timestamp"] and span:
            data, count = files.avi_place(data, b"IDIT", span, None), count + 1
    if types and kind in ("jpeg", "gif") and files.trailing(data):
        data, count = files.without_trailing(data), count + 1
    return data, count


def scrub(data: bytes, types: int = -1) -> tuple[bytes, dict[str, int]]:
    """The file without what the privacy flags name, and how much went by carrier."""
    counts: dict[str, int] = {}
    for carrier, run in (("exif", scrub_exif), ("xmp", None), ("irb", scrub_resources), ("iptc", scrub_iptc)):
        if carrier == "iptc" and files.get(data, "irb") is not None:
            continue  # its datasets went with the resources
        block = files.get(data, carrier)
        if not block:
            continue
        if carrier == "xmp":
            after, n = scrub_xmp(block.decode("utf-8", "replace"), types)
            after = after.encode()
        else:
            after, n = run(block, types)
        if n:
            data = after if carrier == "exif" and containers.detect(data) == "tiff" else files.put(data, carrier, after)
            counts[carrier] = n
    data, n = _scrub_format(data, types)
    if n:
        counts["format"] = n
    return data, counts


# --- conformance

#: Categories of departures; SAFE ones are repaired without inventing anything.
TYPE, REQUIRED, INVENTED, STRUCTURE, ADVISORY = 1, 2, 4, 8, 16
SAFE = TYPE | REQUIRED | STRUCTURE


def _exif_due(block: bytes, in_tiff: bool) -> list[tuple[str, tuple[str, int], tuple[int, object] | None]]:
    entries, _ = tiff.read(block)
    have = {e.ifd for e in entries}
    version = ("ExifIFD:ExifVersion", ("ExifIFD", 36864), (7, b"0300" if any(e.type == 129 for e in entries) else b"0232"))
    colour = ("ExifIFD:ColorSpace", ("ExifIFD", 40961), (3, [65535]))
    if not in_tiff:
        due = [("IFD0:YCbCrPositioning", ("IFD0", 531), (3, [1]))]
        inner = [version, ("ExifIFD:ComponentsConfiguration", ("ExifIFD", 37121), (7, b"\1\2\3\0")), colour, ("ExifIFD:PixelXDimension", ("ExifIFD", 40962), None), ("ExifIFD:PixelYDimension", ("ExifIFD", 40963), None)]
    elif any(e.ifd == "IFD0" and e.tag in (273, 324) for e in entries):
        due = [("IFD0:XResolution", ("IFD0", 282), (5, [(72, 1)])), ("IFD0:YResolution", ("IFD0", 283), (5, [(72, 1)]))]
        inner = [version, ("ExifIFD:FlashpixVersion", ("ExifIFD", 40960), (7, b"0100")), colour]
    else:
        return []
    due += inner if "ExifIFD" in have else []
    due += [("GPS:GPSVersionID", ("GPS", 0), (1, b"\2\3\0\0"))] if "GPS" in have else []
    keys = {(e.ifd, e.tag) for e in entries}
    return [d for d in due if d[1] not in keys]


def _iptc_due(sets: list[tuple[int, int, bytes]]) -> list[tuple[str, int, str, object]]:
    """(dataset, category, what is wrong, the value that mends it or None to remove it)."""
    have = {s[:2]: s[2].decode("latin-1") for s in sets}
    name = lambda k: f"{k[0]}#{k[1]:03d}"
    out: list[tuple[str, int, str, object]] = [(name(k), REQUIRED, "required and missing", v) for k, v in (((1, 0), 4), ((1, 20), 1), ((1, 22), 4)) if k not in have]
    service, date = have.get((1, 30), SERVICE), have.get((1, 70), SCRUBBED_DATE)
    out += [(name(k), INVENTED, "required and missing", v) for k, v in (((1, 30), service), ((1, 70), date), ((1, 40), envelope_number(service, date))) if k not in have]
    for record in (2, 3):
        used = any(k[0] == record and k[1] for k in have)
        if used and (record, 0) not in have:
            out.append((name((record, 0)), REQUIRED, "required and missing", 4))
        if not used and (record, 0) in have:
            out.append((name((record, 0)), STRUCTURE, "a record version with no dataset in its record", None))
    return out


def form_problem(form: str, due: str) -> str:
    if due in ("Simple", "Struct"):
        return "expected a simple value" if due == "Simple" else "expected a structure"
    return f"expected an rdf:{due} array" + (f", found rdf:{form}" if form in ("Alt", "Bag", "Seq") else "")


def problems(data: bytes, types: int = -1) -> list[tuple[str, str, int, str]]:
    """(carrier, field, category, what is wrong) of a file."""
    out = []
    kind = containers.detect(data)
    if block := files.get(data, "exif"):
        out += [("EXIF", label, REQUIRED, "required and missing") for label, _, _ in _exif_due(block, kind == "tiff")]
        if any(e.ifd == "IFD0" and e.tag == 33723 and e.type != 4 for e in tiff.read(block)[0]):
            out.append(("EXIF", "IFD0:IPTC-NAA", TYPE, "expected type LONG"))
    if packet := files.get(data, "xmp"):
        out += [("XMP", name, TYPE, form_problem(form, due)) for name, form, due in xmp.departures(xmp.read(packet.decode("utf-8", "replace")) or {})]
    if sets := iptc_rows(files.get(data, "iptc")):
        out += [("IPTC", field, category, said) for field, category, said, _ in _iptc_due(sets)]
    return [p for p in out if types & p[2]]


def conform(data: bytes, types: int = SAFE) -> tuple[bytes, int]:
    """The file with the departures of these categories mended, and how many were."""
    count, kind = 0, containers.detect(data)
    if (block := files.get(data, "exif")) and types & (REQUIRED | TYPE):
        changes: dict = {}
        for _, key, value in _exif_due(block, kind == "tiff") if types & REQUIRED else []:
            wide = files.size(data) if key[1] in (40962, 40963) and kind == "jpeg" else None
            value = (4, [wide[key[1] - 40962]]) if wide else value
            if value is not None:
                changes[key] = value
        own = next((e for e in tiff.read(block)[0] if e.ifd == "IFD0" and e.tag == 33723 and e.type != 4), None)
        if types & TYPE and own is not None and isinstance(own.values, bytes):
            order = "<" if block[:2] == b"II" else ">"
            raw = own.values + b"\0" * (-len(own.values) % 4)
            changes["IFD0", 33723] = (4, list(struct.unpack(f"{order}{len(raw) // 4}I", raw)))
        if changes:
            after = tiff.amend(block, changes)
            data = after if kind == "tiff" else files.put(data, "exif", after)
            count += len(changes)
    if (packet := files.get(data, "xmp")) and types & TYPE:
        told = packet.decode("utf-8", "replace")
        have, changes = xmp.read(told) or {}, {}
        for name, _, due in xmp.departures(have):
            if due in ("Alt", "Bag", "Seq"):
                value = xmp.plain(have[name])
                items = list(value.values()) if isinstance(value, dict) and have[name]["form"] == "Alt" else value if isinstance(value, list) else [value]
                if xmp.DECLARED[name] != "LangAlt":
                    changes[name] = items
                elif items and isinstance(items[0], str):
                    changes[name] = {"x-default": items[0]}
        if changes:
            data = files.put(data, "xmp", xmp.edit(told, changes).encode())
            count += len(changes)
    if sets := iptc_rows(files.get(data, "iptc")):
        due = [d for d in _iptc_due(sets) if types & d[1]]
        for field, _, _, value in due:
            sets = iptc_set(sets, field, value)
        if due:
            data = files.put(data, "iptc", carriers.iptc_write(sets))
            count += len(due)
    return data, count


# --- the merged view

# Fields of the view, their datasets with the most bytes, and their Photoshop properties.
INFO_IPTC = {"title": ("ObjectName", 64), "author": ("By-line", 32), "authorsposition": ("By-lineTitle", 32), "caption": ("Caption-Abstract", 2000), "captionwriter": ("Writer-Editor", 32), "copyrightnotice": ("CopyrightNotice", 128), "keywords": ("Keywords", 64), "category": ("Category", 3), "supplementalcategories": ("SupplementalCategories", 32), "city": ("City", 32), "state": ("Province-State", 32), "country": ("Country-PrimaryLocationName", 64), "credit": ("Credit", 32), "source": ("Source", 32), "headline": ("Headline", 256), "instructions": ("SpecialInstructions", 256), "transmissionreference": ("OriginalTransmissionReference", 32)}
INFO_XMP = {"authorsposition": "AuthorsPosition", "captionwriter": "CaptionWriter", "category": "Category", "city": "City", "state": "State", "country": "Country", "credit": "Credit", "source": "Source", "headline": "Headline", "instructions": "Instructions", "transmissionreference": "TransmissionReference"}
INFO_FIELDS = ["title", "author", "authorsposition", "caption", "captionwriter", "jobname", "copyrightstatus", "copyrightnotice", "ownerurl", "keywords", "category", "supplementalcategories", "date", "city", "state", "country", "credit", "source", "headline", "instructions", "transmissionreference", "urgency"]
INFO_LISTS = ("keywords", "supplementalcategories")


def info(data: bytes) -> dict:
    """The 22 fields over XMP, then IPTC, then resources, then EXIF: the first text that is not empty counts, lists are joined in
    order without repeats, several authors stand in one text."""
    out: dict = {}

    def merge(field: str, value) -> None:
        if isinstance(value, list):
            values = [v.strip() for v in value if isinstance(v, str) and v.strip()]
            if field in INFO_LISTS:
                own = out.setdefault(field, [])
                own += [v for i, v in enumerate(values) if v not in own and v not in values[:i]]
                if not own:
                    del out[field]
                return
            value = ", ".join(values)
        if isinstance(value, str) and value and not out.get(field):
            if field in INFO_LISTS:
                merge(field, [value])
            else:
                out[field] = value.strip()

    if packet := files.get(data, "xmp"):
        p = xmp.read(packet.decode("utf-8", "replace")) or {}
        first = lambda n: (xmp.list_of(p.get(n)) or [None])[0]
        merge("title", xmp.text_of(p.get("dc:title")))
        merge("caption", xmp.text_of(p.get("dc:description")))
        merge("copyrightnotice", xmp.text_of(p.get("dc:rights")))
        merge("author", xmp.list_of(p.get("dc:creator")))
        merge("keywords", xmp.list_of(p.get("dc:subject")))
        for field, name in INFO_XMP.items():
            merge(field, first(f"photoshop:{name}"))
        merge("supplementalcategories", xmp.list_of(p.get("photoshop:SupplementalCategories")))
        merge("date", first("photoshop:DateCreated"))
        merge("urgency", first("photoshop:Urgency"))
        if (marked := first("xmpRights:Marked")) is not None:
            out["copyrightstatus"] = "Copyrighted Work" if marked.lower() == "true" else "Public Domain"
        merge("ownerurl", first("xmpRights:WebStatement"))
        job = p.get("xmpBJ:JobRef")
        job = next(iter(job["items"]), None) if isinstance(job, dict) and "items" in job else job
        merge("jobname", next((v for k, v in job.get("fields", {}).items() if k.split(":")[-1] == "name"), None) if isinstance(job, dict) else job)
    values: dict = {}
    for r, d, v in iptc_values(files.get(data, "iptc") or b""):
        values.setdefault((r, d), []).append(v)
    for field, (name, _) in INFO_IPTC.items():
        own = values.get(DATASET_OF[name.lower()])
        merge(field, own if own and len(own) > 1 else own[0] if own else None)
    if values and re.fullmatch(r"\d{8}", date := str(values.get((2, 55), [""])[0])):
        merge("date", f"{date[:4]}-{date[4:6]}-{date[6:]}")
    if str(values.get((2, 10), [""])[0]) in "12345678":
        merge("urgency", str(values.get((2, 10), [""])[0]))
    resources = {n: body for _, n, _, body in carriers.resources(files.get(data, "irb") or b"")}
    if 1034 in resources and not out.get("copyrightstatus"):
        out["copyrightstatus"] = "Copyrighted Work" if resources[1034][:1] not in (b"", b"\0") else "Unknown"
    if 1035 in resources:
        merge("ownerurl", resources[1035].rstrip(b"\0").decode("utf-8", "replace"))
    if block := files.get(data, "exif"):
        for field, name in (("author", "Artist"), ("caption", "ImageDescription"), ("copyrightnotice", "Copyright")):
            merge(field, exif_value(block, name))
    return out


def apply_info(data: bytes, fields: dict) -> bytes:
    """A JPEG or TIFF with the view's fields written to all four carriers; fields that are not given are removed from them."""
    if unknown := set(fields) - set(INFO_FIELDS):
        raise ValueError(f"{sorted(unknown)[0]} is no field")
    own = {k: v for k, v in fields.items() if v}
    one = lambda f: (", ".join(own[f]) if isinstance(own[f], list) else own[f]) if f in own else None
    date = one("date")
    if date and not re.fullmatch(r"\d{4}-\d{2}-\d{2}", date):
        raise ValueError(f"{date} is no date")
    urgency = one("urgency") if str(own.get("urgency", "")) in list("12345678") else None
    sets = iptc_rows(files.get(data, "iptc"))
    for field, (name, most) in INFO_IPTC.items():
        value = own.get(field)
        limited = [text.cut_utf8(v, most) for v in ([value] if isinstance(value, str) else value or [])]
        sets = iptc_set(sets, name, limited or None)
    sets = iptc_set(sets, "DateCreated", date.replace("-", "") if date else None)
    sets = iptc_set(sets, "Urgency", urgency)
    if not any(s[:2] == (2, 0) for s in sets):
        sets = iptc_set(sets, "ApplicationRecordVersion", 4)
    alt = lambda v: {"x-default": v} if v else None
    status = own.get("copyrightstatus")
    properties: dict = {"dc:title": alt(one("title")), "dc:description": alt(one("caption")), "dc:rights": alt(one("copyrightnotice")), "dc:creator": [one("author")] if one("author") else None, "dc:subject": list(own.get("keywords", [])) or None}
    properties |= {f"photoshop:{name}": one(field) for field, name in INFO_XMP.items()}
    properties |= {"photoshop:SupplementalCategories": list(own.get("supplementalcategories", [])) or None, "photoshop:DateCreated": date, "photoshop:Urgency": urgency}
    properties |= {"xmpRights:Marked": {"Copyrighted Work": True, "Public Domain": False}.get(status), "xmpRights:WebStatement": one("ownerurl"), "xmpBJ:JobRef": [{"stJob:name": one("jobname")}] if one("jobname") else None}
    packet = files.get(data, "xmp")
    block, _ = exif_set(files.get(data, "exif"), {"Artist": one("author"), "ImageDescription": one("caption"), "Copyright": one("copyrightnotice")})
    if containers.detect(data) == "tiff":
        data = block
    else:
        data = files.put(data, "exif", block)
    data = files.put(data, "xmp", xmp.edit(packet.decode("utf-8", "replace") if packet else None, properties).encode())
    data = files.put(data, "iptc", carriers.iptc_write(sets))
    rows = [(n, name, body) for _, n, name, body in carriers.resources(files.get(data, "irb") or b"") if n not in (1034, 1035)]
    rows += [(1034, "", b"\1" if status == "Copyrighted Work" else b"\0")] if status in ("Copyrighted Work", "Public Domain") else []
    rows += [(1035, "", one("ownerurl").encode())] if one("ownerurl") else []
    return files.put(data, "irb", carriers.resources_write(rows))
