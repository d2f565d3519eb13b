"""Texts, dates and small tables that carriers store in forms of their own."""

from __future__ import annotations

import re
import struct
from datetime import datetime, timedelta, timezone

import numpy as np

#: Escapes that name a charset in IPTC 1:90, of ISO 2022.
ESCAPES = {b"\x1b%G": "utf-8", b"\x1b%5": "utf-8", b"\x1b.A": "iso8859-1", b"\x1b-A": "iso8859-1", b"\x1b-B": "iso8859-2", b"\x1b-C": "iso8859-3", b"\x1b-D": "iso8859-4", b"\x1b-L": "iso8859-5", b"\x1b-G": "iso8859-6", b"\x1b-F": "iso8859-7", b"\x1b-H": "iso8859-8", b"\x1b-M": "iso8859-9", b"\x1b-b": "iso8859-15", b"\x1b/G": "utf-8"}


def from_charset(raw: bytes, charset: str | None) -> str:
    """Text in a charset; without one, or where the bytes are not of it, UTF-8, else Latin-1."""
    for name in (charset, "utf-8"):
        if name:
            try:
                return raw.decode(name)
            except UnicodeDecodeError:
                pass
    return raw.decode("latin-1")


def coded_read(raw: bytes) -> str:
    """Exif's coded text: eight bytes name ASCII, UNICODE (UTF-16, big-endian unless a mark says else) or JIS."""
    head, body = raw[:8], raw[8:]
    if head.startswith(b"ASCII"):
        out = body.decode("utf-8", "replace")
    elif head.startswith(b"UNICODE"):
        order = "utf-16-le" if body[:2] == b"\xff\xfe" else "utf-16-be"
        out = (body[2:] if body[:2] in (b"\xff\xfe", b"\xfe\xff") else body).decode(order, "ignore")
    elif head.startswith(b"JIS"):
        out = body.decode("iso2022_jp", "ignore")
    else:
        out = raw.decode("utf-8", "replace")
    return out.rstrip("\0").strip()


def coded_write(text: str, charset: str | None = None) -> bytes:
    charset = (charset or ("ASCII" if text.isascii() else "UNICODE")).upper()
    if charset == "UNICODE":
        return b"UNICODE\0" + text.encode("utf-16-be", "ignore")
    if charset == "JIS":
        return b"JIS\0\0\0\0\0" + text.encode("iso2022_jp", "ignore")
    return b"ASCII\0\0\0" + text.encode()


def float_text(value: float) -> str:
    """The fewest digits that give the same single-precision float again."""
    with np.errstate(over="ignore"):
        for digits in range(1, 10):
            out = f"{value:.{digits}G}"
            if np.float32(float(out)) == np.float32(value):
                break
    return out


def cut_utf8(text: str, most: int) -> bytes:
    """UTF-8 of at most so many bytes that does not end inside a character."""
    return text.encode()[:most].decode("utf-8", "ignore").encode()


_DATE_FORMS = ("%Y-%m-%d", "%Y/%m/%d", "%Y:%m:%d", "%d.%m.%Y", "%d %B %Y", "%d %b %Y", "%B %d, %Y", "%m/%d/%Y")
_TIME_FORMS = ("%H:%M:%S%z", "%H:%M:%S", "%H:%M%z", "%H:%M", "%H%M%S", "%I:%M %p")


def _instant(value: str) -> datetime | None:
    if re.fullmatch(r"-?\d{1,7}|-?\d{9,11}", value):
        return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=int(value))
    value = value.strip()
    try:
        return datetime.fromisoformat(value.replace("Z", "+00:00"))
    except ValueError:
        pass
    for form in (*_DATE_FORMS, *(f"{d} {t}" for d in _DATE_FORMS for t in _TIME_FORMS)):
        try:
            return datetime.strptime(value, form)
        except ValueError:
            continue
    return None


def iptc_date(value: str) -> str:
    """CCYYMMDD from that form, seconds since 1970 or a date in a common form; else ValueError."""
    if re.fullmatch(r"\d{8}", value):
        return value
    found = _instant(value)
    if found is None:
        raise ValueError(f"{value} is no date")
    return found.strftime("%Y%m%d")


def iptc_time(value: str) -> str:
    """HHMMSS+HHMM from that form, seconds since 1970 or a time in a common form; times without a zone are UTC."""
    if re.fullmatch(r"\d{6}[+-]\d{4}", value):
        return value
    found = _instant(value) if not re.match(r"^\d{1,2}:\d{2}", value) else None
    for form in _TIME_FORMS:
        if found is None:
            try:
                found = datetime.strptime(value.strip(), form)
            except ValueError:
                continue
    if found is None:
        raise ValueError(f"{value} is no time")
    return found.strftime("%H%M%S") + (found.strftime("%z").replace(":", "")[:5] or "+0000")


def recording_time(seconds: float) -> str:
    """hh:mm:ss.sub of a time of day."""
    whole = int(seconds)
    return f"{whole // 3600 % 24:02d}:{whole // 60 % 60:02d}:{whole % 60:02d}.{int((seconds - whole) * 100):02d}"


# --- a profile's localised texts, and opt-outs from learning


def mluc_read(raw: bytes) -> dict[str, str]:
    """Texts by language and country, as `en-US`."""
    if raw[:4] != b"mluc" or len(raw) < 16:
        return {}
    count, size = struct.unpack_from(">II", raw, 8)
    out = {}
    for i in range(min(count, (len(raw) - 16) // max(size, 12))):
        language, length, at = struct.unpack_from(">4sII", raw, 16 + i * size)
        if at + length <= len(raw):
            name = language[:2].decode("latin-1") + ("-" + language[2:].decode("latin-1") if language[2:].strip(b"\0 ") else "")
            out[name] = raw[at : at + length].decode("utf-16-be", "replace")
    return out


def mluc_write(texts: dict[str, str]) -> bytes:
    at, head, body = 16 + 12 * len(texts), bytearray(), bytearray()
    for name, text in texts.items():
        raw = text.encode("utf-16-be")
        language, _, country = name.partition("-")
        head += struct.pack(">2s2sII", language.encode("latin-1"), country.encode("latin-1"), len(raw), at + len(body))
        body += raw
    return b"mluc" + bytes(4) + struct.pack(">II", len(texts), 12) + bytes(head) + bytes(body)


def mluc_text(texts: dict[str, str]) -> str | None:
    """The English one, else the first."""
    return next((t for n, t in texts.items() if n.startswith("en")), next(iter(texts.values()), None))


def learning_read(raw: bytes, order: str = ">") -> dict[int, int]:
    """Usages and intentions of an opt-out block."""
    if len(raw) < 6:
        return {}
    count = struct.unpack_from(order + "H", raw)[0]
    if not count or len(raw) < 2 + 4 * count:
        return {}
    return dict(struct.unpack_from(order + "HH", raw, 2 + 4 * i) for i in range(count))


def learning_write(sets: dict[int, int], order: str = ">") -> bytes:
    """Usage 0 comes first, the rest as given."""
    rows = ([(0, sets[0])] if 0 in sets else []) + [(u, i) for u, i in sets.items() if u]
    return struct.pack(order + "H", len(rows)) + b"".join(struct.pack(order + "HH", *r) for r in rows)
