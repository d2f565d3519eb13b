"""TIFF blocks: image file directories to entries and back, in either byte order."""

from __future__ import annotations

import struct
from dataclasses import dataclass

#: TIFF data types as (struct letter of one part, parts of one value).
TYPES = {1: ("B", 1), 2: ("B", 1), 3: ("H", 1), 4: ("I", 1), 5: ("I", 2), 6: ("b", 1), 7: ("B", 1), 8: ("h", 1), 9: ("i", 1), 10: ("i", 2), 11: ("f", 1), 12: ("d", 1), 129: ("B", 1)}
SUB_IFDS = {34665: "ExifIFD", 34853: "GPS", 40965: "Interop"}
MAX_IFDS = 64


@dataclass
class Entry:
    ifd: str
    tag: int
    type: int
    values: list  # ints or floats; rationals as (num, den); kinds 1, 2, 7 and 129 as bytes
    offset: int = 0


def read(data: bytes, first: int | None = None, base: int = 0, order: str | None = None) -> tuple[list[Entry], list[str]]:
    """All entries with warnings.  Unknown types, entries past the end and directories met twice are skipped and warned of.

    first, base and order read a directory inside another block, whose value offsets count from base."""
    warnings: list[str] = []
    if first is None:
        order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
        if order is None or len(data) < 8:
            return [], ["not a TIFF block"]
        first = struct.unpack_from(order + "I", data, 4)[0]
    found: list[Entry] = []
    seen: set[int] = set()
    todo, number = [("IFD0", first)], 0
    while todo:
        name, at = todo.pop(0)
        if at in seen or len(seen) >= MAX_IFDS:
            warnings.append(f"{name}: directory at {at} is repeated or one too many")
            continue
        seen.add(at)
        if at + 2 > len(data):
            warnings.append(f"{name}: directory at {at} is outside")
            continue
        count = struct.unpack_from(order + "H", data, at)[0]
        whole = min(count, (len(data) - at - 2) // 12)
        if whole < count:
            warnings.append(f"{name}: {count - whole} entries are cut off")
        for i in range(whole):
            tag, kind, n, raw = struct.unpack_from(order + "HHI4s", data, at + 2 + 12 * i)
            if kind not in TYPES:
                warnings.append(f"{name}: tag {tag} has unknown type {kind}")
                continue
            letter, parts = TYPES[kind]
            size = struct.calcsize(letter) * parts * n
            place = at + 10 + 12 * i if size <= 4 else struct.unpack(order + "I", raw)[0] + base
            if place + size > len(data):
                warnings.append(f"{name}: tag {tag} is outside")
                continue
            body = data[place : place + size]
            values: list | bytes = body if kind in (1, 2, 7, 129) else list(struct.unpack(f"{order}{n * parts}{letter}", body))
            if parts == 2:
                values = list(zip(values[::2], values[1::2], strict=True))
            found.append(Entry(name, tag, kind, values, place))
            if tag in SUB_IFDS and kind == 4 and n == 1:
                todo.append((SUB_IFDS[tag], values[0]))
        end = at + 2 + 12 * count
        if name.startswith("IFD") and end + 4 <= len(data) and (after := struct.unpack_from(order + "I", data, end)[0]):
            number += 1
            todo.append((f"IFD{number}", after))
    return found, warnings


def write(entries: list[Entry], order: str = "<") -> bytes:
    """A block of the entries: IFD0 and its like in a chain, sub-directories behind their pointers, values on even places."""
    by_ifd: dict[str, dict[int, Entry]] = {}
    for e in entries:
        by_ifd.setdefault(e.ifd, {})[e.tag] = e
    for tag, name in SUB_IFDS.items():
        parent = "ExifIFD" if name == "Interop" else "IFD0"
        by_ifd.setdefault("IFD0", {}).pop(tag, None)
        if name in by_ifd:
            by_ifd.setdefault(parent, {})[tag] = Entry(parent, tag, 4, [0])
    chain = sorted((n for n in by_ifd if n.startswith("IFD")), key=lambda n: int(n[3:]))
    names = chain + [n for n in ("ExifIFD", "GPS", "Interop") if n in by_ifd]
    at, place = 8, {}
    for n in names:
        place[n] = at
        at += 6 + 12 * len(by_ifd[n])
    heap = bytearray()
    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", place[names[0]]))
    for n in names:
        out += struct.pack(order + "H", len(by_ifd[n]))
        for tag, e in sorted(by_ifd[n].items()):
            letter, parts = TYPES[e.type]
            values = [place[SUB_IFDS[tag]]] if tag in SUB_IFDS and SUB_IFDS[tag] in place else e.values
            if isinstance(values, bytes):
                body = values
            else:
                flat = [x for v in values for x in v] if parts == 2 else values
                body = struct.pack(f"{order}{len(flat)}{letter}", *flat)
            count = len(body) // (struct.calcsize(letter) * parts)
            if len(body) > 4:
                heap += b"\0" * ((at + len(heap)) % 2)
                raw = struct.pack(order + "I", at + len(heap))
                heap += body
            else:
                raw = body.ljust(4, b"\0")
            out += struct.pack(order + "HHI", tag, e.type, count) + raw
        follow = chain[chain.index(n) + 1] if n in chain and n != chain[-1] else None
        out += struct.pack(order + "I", place[follow] if follow else 0)
    return bytes(out + heap)


# --- changes that leave everything else where it is

PARENTS = {"Interop": ("ExifIFD", 40965), "ExifIFD": ("IFD0", 34665), "GPS": ("IFD0", 34853)}


def _packed(kind: int, values, order: str) -> tuple[int, bytes]:
    """(count, bytes) of a value."""
    letter, parts = TYPES[kind]
    if isinstance(values, bytes):
        body = values
    else:
        flat = [x for v in values for x in v] if parts == 2 else list(values)
        body = struct.pack(f"{order}{len(flat)}{letter}", *flat)
    return len(body) // (struct.calcsize(letter) * parts), body


def _table(data: bytes, at: int, order: str) -> tuple[dict[int, bytes], int]:
    """A directory's raw entries by tag, and the offset of the next directory."""
    count = min(struct.unpack_from(order + "H", data, at)[0], (len(data) - at - 2) // 12)
    rows = [bytes(data[at + 2 + 12 * i : at + 14 + 12 * i]) for i in range(count)]
    end = at + 2 + 12 * count
    return {struct.unpack_from(order + "H", r)[0]: r for r in rows}, struct.unpack_from(order + "I", data, end)[0] if end + 4 <= len(data) else 0


def directories(data: bytes) -> dict[str, int]:
    """Names and offsets of the directories that amend() may change."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None or len(data) < 8:
        raise ValueError("not a TIFF block")
    found = {"IFD0": struct.unpack_from(order + "I", data, 4)[0]}
    for name in ("ExifIFD", "GPS", "Interop"):
        parent, tag = PARENTS[name]
        if parent in found and (raw := _table(data, found[parent], order)[0].get(tag)):
            found[name] = struct.unpack_from(order + "I", raw, 8)[0]
    if after := _table(data, found["IFD0"], order)[1]:
        found["IFD1"] = after
    return {n: a for n, a in found.items() if a + 2 <= len(data)}


def amend(data: bytes, changes: dict[tuple[str, int], tuple[int, object] | None], drop: tuple[str, ...] = ()) -> bytes:
    """The block with entries set or, by None, removed, and whole directories dropped.

    Changed directories and values are put behind the end and pointed to; what else the block holds stays at its place.  What
    is removed or replaced is overwritten with zeros where it lay, unless another entry names the same bytes."""
    order = "<" if data[:2] == b"II" else ">"
    out, places = bytearray(data), directories(data)
    tables = {n: _table(data, a, order) for n, a in places.items()}
    spans: dict[tuple[int, int], int] = {}  # places of values and how many entries name them

    def span(raw: bytes) -> tuple[int, int] | None:
        kind, n, at = struct.unpack_from(order + "HII", raw, 2)
        size = struct.calcsize(TYPES[kind][0]) * TYPES[kind][1] * n if kind in TYPES else 0
        return (at, size) if size > 4 and at + size <= len(data) else None

    for rows, _ in tables.values():
        for raw in rows.values():
            if s := span(raw):
                spans[s] = spans.get(s, 0) + 1

    def wipe(raw: bytes) -> None:
        if s := span(raw):
            spans[s] -= 1
            if not spans[s]:
                out[s[0] : s[0] + s[1]] = bytes(s[1])

    def wipe_table(name: str) -> None:
        at = places[name]
        size = 2 + 12 * struct.unpack_from(order + "H", data, at)[0] + 4
        out[at : at + size] = bytes(min(size, len(data) - at))

    work: dict[str, dict[int, tuple[int, object] | None]] = {}
    for (name, tag), value in changes.items():
        work.setdefault(name, {})[tag] = value
    follow = tables["IFD0"][1] if "IFD0" in tables else 0
    for name in drop:
        if name in tables:
            rows = tables.pop(name)[0]
            if name == "IFD1" and 513 in rows and 514 in rows:  # the thumbnail's bytes
                at, size = (struct.unpack_from(order + "I", rows[t], 8)[0] for t in (513, 514))
                out[at : at + size] = bytes(max(0, min(size, len(data) - at)))
            for raw in rows.values():
                wipe(raw)
            wipe_table(name)
            work.pop(name, None)
            if name in PARENTS:
                parent, tag = PARENTS[name]
                work.setdefault(parent, {})[tag] = None
            else:
                follow = 0
                work.setdefault("IFD0", {})
    for name in ("Interop", "ExifIFD", "GPS", "IFD1", "IFD0"):
        if name not in work:
            continue
        rows = dict(tables.get(name, ({}, 0))[0])
        for tag, value in work[name].items():
            if (old := rows.pop(tag, None)) is not None:
                wipe(old)
            if value is not None:
                count, body = _packed(value[0], value[1], order)
                if len(body) > 4:
                    out += b"\0" * (len(out) % 2)
                    raw = struct.pack(order + "I", len(out))
                    out += body
                else:
                    raw = body.ljust(4, b"\0")
                rows[tag] = struct.pack(order + "HHI", tag, value[0], count) + raw
        if name in tables:
            wipe_table(name)
        out += b"\0" * (len(out) % 2)
        at = len(out)
        after = follow if name == "IFD0" else tables.get(name, ({}, 0))[1] if name == "IFD1" else 0
        out += struct.pack(order + "H", len(rows)) + b"".join(rows[t] for t in sorted(rows)) + struct.pack(order + "I", after)
        if name == "IFD0":
            out[4:8] = struct.pack(order + "I", at)
        elif name == "IFD1":
            follow = at
            work.setdefault("IFD0", {})
        else:
            parent, tag = PARENTS[name]
            work.setdefault(parent, {})[tag] = (4, [at])
    return bytes(out)


def first_fit(cursor: int, size: int, pins: list[tuple[int, int]]) -> tuple[int, int]:
    """(place, new cursor) of the first even gap of size bytes from cursor on, around pinned [start, end) spans."""
    at = cursor + cursor % 2
    for start, end in sorted(pins):
        if at + size <= start:
            break
        if end > at:
            at = end + end % 2
    return at, at + size


#: Pairs of tags that name blocks of bytes by offsets and sizes: strips, free blocks, tiles, a thumbnail.
BLOCK_TAGS = {"strip": (273, 279), "free": (288, 289), "tile": (324, 325), "thumbnail": (513, 514)}


def blocks(entries: list[Entry]) -> list[tuple[str, str, int, int, int]]:
    """(directory, kind, number, offset, size) of the bytes that entries name outside their directories."""
    by = {(e.ifd, e.tag): e.values for e in entries if not isinstance(e.values, bytes)}
    out = []
    for name in dict.fromkeys(e.ifd for e in entries):
        for kind, (offsets, sizes) in BLOCK_TAGS.items():
            if (name, offsets) in by and (name, sizes) in by:
                out += [(name, kind, i, a, n) for i, (a, n) in enumerate(zip(by[name, offsets], by[name, sizes], strict=False))]
    return out


def scan(source, size: int, max_tag: int = 16 << 20) -> tuple[list[Entry], list[str]]:
    """Entries of a TIFF file that is read by place: source(offset, length) gives bytes.  Only tables and values are read; values
    over max_tag bytes are skipped with a warning."""
    head = source(0, 8)
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(head[:4])
    if order is None:
        return [], ["not a TIFF block"]
    found, warnings, seen, number = [], [], set(), 0
    todo = [("IFD0", struct.unpack(order + "I", head[4:8])[0])]
    while todo:
        name, at = todo.pop(0)
        if at in seen or len(seen) >= MAX_IFDS or at + 2 > size:
            warnings.append(f"{name}: directory at {at} is repeated, outside or one too many")
            continue
        seen.add(at)
        count = struct.unpack(order + "H", source(at, 2))[0]
        table = source(at + 2, min(12 * count + 4, size - at - 2))
        for i in range(min(count, len(table) // 12)):
            tag, kind, n, raw = struct.unpack_from(order + "HHI4s", table, 12 * i)
            if kind not in TYPES:
                warnings.append(f"{name}: tag {tag} has unknown type {kind}")
                continue
            letter, parts = TYPES[kind]
            length = struct.calcsize(letter) * parts * n
            place = at + 10 + 12 * i if length <= 4 else struct.unpack(order + "I", raw)[0]
            if place + length > size or length > max_tag:
                warnings.append(f"{name}: tag {tag} is outside or over {max_tag} bytes")
                continue
            body = raw[:length] if length <= 4 else source(place, length)
            values: list | bytes = body if kind in (1, 2, 7, 129) else list(struct.unpack(f"{order}{n * parts}{letter}", body))
            if parts == 2:
                values = list(zip(values[::2], values[1::2], strict=True))
            found.append(Entry(name, tag, kind, values, place))
            if tag in SUB_IFDS and kind == 4 and n == 1:
                todo.append((SUB_IFDS[tag], values[0]))
        if name.startswith("IFD") and len(table) >= 12 * count + 4 and (after := struct.unpack_from(order + "I", table, 12 * count)[0]):
            number += 1
            todo.append((f"IFD{number}", after))
    return found, warnings
