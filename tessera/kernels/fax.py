"""CCITT fax coding of bilevel rows: Modified Huffman, Group 3 (one and two dimensions) and Group 4.

Rows are packed from the highest bit, 1 is black.  Positions where the colour changes are found by numpy; runs and modes are
then written and read as codes of T.4 and T.6.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np

MODIFIED_HUFFMAN, GROUP3, GROUP3_2D, GROUP4 = 1, 2, 3, 4
# Codes of T.4 in hexadecimal with their lengths, for runs of 0 to 63 and of 64, 128 .. 1728; then of 1792 .. 2560.
WHITE = """
35:8 07:6 07:4 08:4 0B:4 0C:4 0E:4 0F:4 13:5 14:5 07:5 08:5 08:6 03:6 34:6 35:6 2A:6 2B:6 27:7 0C:7 08:7 17:7 03:7 04:7 28:7 2B:7
13:7 24:7 18:7 02:8 03:8 1A:8 1B:8 12:8 13:8 14:8 15:8 16:8 17:8 28:8 29:8 2A:8 2B:8 2C:8 2D:8 04:8 05:8 0A:8 0B:8 52:8 53:8 54:8
55:8 24:8 25:8 58:8 59:8 5A:8 5B:8 4A:8 4B:8 32:8 33:8 34:8
1B:5 12:5 17:6 37:7 36:8 37:8 64:8 65:8 68:8 67:8 CC:9 CD:9 D2:9 D3:9 D4:9 D5:9 D6:9 D7:9 D8:9 D9:9 DA:9 DB:9 98:9 99:9 9A:9 18:6 9B:9
"""
BLACK = """
37:10 02:3 03:2 02:2 03:3 03:4 02:4 03:5 05:6 04:6 04:7 05:7 07:7 04:8 07:8 18:9 17:10 18:10 08:10 67:11 68:11 6C:11 37:11 28:11
17:11 18:11 CA:12 CB:12 CC:12 CD:12 68:12 69:12 6A:12 6B:12 D2:12 D3:12 D4:12 D5:12 D6:12 D7:12 6C:12 6D:12 DA:12 DB:12 54:12 55:12
56:12 57:12 64:12 65:12 52:12 53:12 24:12 37:12 38:12 27:12 28:12 58:12 59:12 2B:12 2C:12 5A:12 66:12 67:12
0F:10 C8:12 C9:12 5B:12 33:12 34:12 35:12 6C:13 6D:13 4A:13 4B:13 4C:13 4D:13 72:13 73:13 74:13 75:13 76:13 77:13 52:13 53:13 54:13
55:13 5A:13 5B:13 64:13 65:13
"""
LONG = "08:11 0C:11 0D:11 12:12 13:12 14:12 15:12 16:12 17:12 1C:12 1D:12 1E:12 1F:12"
# Modes of two-dimensional rows.
PASS, HORIZONTAL = "0001", "001"
VERTICAL = {0: "1", 1: "011", 2: "000011", 3: "0000011", -1: "010", -2: "000010", -3: "0000010"}
EOL = "000000000001"


def _codes(text: str) -> dict[int, str]:
    runs = [*range(64), *range(64, 1729, 64), *range(1792, 2561, 64)]
    pairs = (word.split(":") for word in (text + LONG).split())
    return {run: f"{int(code, 16):0{int(size)}b}" for run, (code, size) in zip(runs, pairs, strict=True)}


CODES = (_codes(WHITE), _codes(BLACK))
RUNS = tuple({code: run for run, code in table.items()} for table in CODES)
MODES = {PASS: "pass", HORIZONTAL: "horizontal"} | {code: shift for shift, code in VERTICAL.items()}


def changes(row: np.ndarray) -> list[int]:
    """Places of a row of bits where the colour differs from the pixel before; before the first one is white."""
    return np.flatnonzero(np.diff(row.astype(np.int8), prepend=0)).tolist()


def _run(length: int, colour: int) -> str:
    out = ""
    while length > 2623:
        out += CODES[colour][2560]
        length -= 2560
    if length > 63:
        out += CODES[colour][length // 64 * 64]
    return out + CODES[colour][length % 64]


def _row_1d(at: list[int], columns: int) -> str:
    edges = [0, *at, columns]
    return "".join(_run(b - a, i % 2) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)))


def _beside(at: list[int], a0: int, colour: int, columns: int) -> tuple[int, int]:
    """b1 and b2 of the reference row: its first change right of a0 to the other colour than ours, and the next one."""
    i = bisect_right(at, a0)
    i += i % 2 != colour
    return (at[i] if i < len(at) else columns), (at[i + 1] if i + 1 < len(at) else columns)


def _row_2d(at: list[int], above: list[int], columns: int) -> str:
    out, a0, colour, edges = [], -1, 0, [*at, columns, columns, columns]
    while a0 < columns:
        i = bisect_right(at, a0)
        i += i % 2 != colour
        a1 = edges[min(i, len(at))]
        b1, b2 = _beside(above, a0, colour, columns)
        if b2 < a1:
            out.append(PASS)
            a0 = b2
        elif abs(a1 - b1) <= 3:
            out.append(VERTICAL[a1 - b1])
            a0, colour = a1, 1 - colour
        else:
            a2 = edges[min(i, len(at)) + 1]
            out.append(HORIZONTAL + _run(a1 - max(a0, 0), colour) + _run(a2 - a1, 1 - colour))
            a0 = a2
        if a0 >= columns:
            break
    return "".join(out)


def _pack(bits: str) -> bytes:
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big") if bits else b""


def encode(data: bytes, columns: int, mode: int = GROUP4, k: int = 4) -> bytes:
    """Rows of whole bytes as fax codes; in mode 3 every k-th row has one dimension."""
    wide = (columns + 7) // 8
    rows = np.unpackbits(np.frombuffer(data[: len(data) // wide * wide], np.uint8).reshape(-1, wide), axis=1)[:, :columns]
    out, above = [], []
    for i, row in enumerate(rows):
        at = changes(row)
        if mode == MODIFIED_HUFFMAN:
            bits = _row_1d(at, columns)
            out.append(bits + "0" * (-len(bits) % 8))
        elif mode == GROUP3:
            out.append(EOL + _row_1d(at, columns))
        elif mode == GROUP3_2D:
            out.append(EOL + ("1" + _row_1d(at, columns) if i % k == 0 else "0" + _row_2d(at, above, columns)))
        else:
            out.append(_row_2d(at, above, columns))
        above = at
    out.append({GROUP3: EOL * 6, GROUP3_2D: (EOL + "1") * 6, GROUP4: EOL * 2}.get(mode, ""))
    return b"".join(_pack(x) for x in out) if mode == MODIFIED_HUFFMAN else _pack("".join(out))


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8)).tobytes().translate(bytes([48, 49]) + bytes(254)).decode()
        self.at = 0

    def code(self, table: dict, longest: int = 13):
        for n in range(1, longest + 1):
            found = table.get(self.bits[self.at : self.at + n])
            if found is not None and len(self.bits) >= self.at + n:
                self.at += n
                return found
        return None

    def run(self, colour: int) -> int | None:
        total = 0
        while (part := self.code(RUNS[colour])) is not None:
            total += part
            if part < 64:
                return total
        return None

    def skip_eol(self) -> bool:
        """Past fill bits and an end of line, if one stands here."""
        end = self.at
        while end < len(self.bits) and self.bits[end] == "0":
            end += 1
        if end - self.at >= 11 and end < len(self.bits):
            self.at = end + 1
            return True
        return False


def _read_1d(r: _Reader, columns: int) -> list[int] | None:
    at, x, colour = [], 0, 0
    while x < columns:
        n = r.run(colour)
        if n is None:
            return None
        x += n
        at.append(min(x, columns))
        colour = 1 - colour
    return at


def _read_2d(r: _Reader, above: list[int], columns: int) -> list[int] | None:
    at, a0, colour = [], -1, 0
    while a0 < columns:
        b1, b2 = _beside(above, a0, colour, columns)
        mode = r.code(MODES, 7)
        if mode is None:
            return None
        if mode == "pass":
            a0 = b2
        elif mode == "horizontal":
            first, second = r.run(colour), r.run(1 - colour)
            if first is None or second is None:
                return None
            at += [min(max(a0, 0) + first, columns), min(max(a0, 0) + first + second, columns)]
            a0 = at[-1]
        else:
            a0 = max(0, min(b1 + mode, columns))
            at.append(a0)
            colour = 1 - colour
    return at


def decode(data: bytes, columns: int, mode: int = GROUP4, rows: int | None = None) -> bytes:
    """Rows of whole bytes up to the end of the codes or the row that is broken."""
    r, out, above = _Reader(data), [], []
    while rows is None or len(out) < rows:
        if mode == MODIFIED_HUFFMAN:
            r.at += -r.at % 8
        if mode == GROUP4 and r.bits.startswith(EOL, r.at):
            break
        plain = True
        if mode in (GROUP3, GROUP3_2D):
            ends = 0
            while r.skip_eol():
                ends += 1
                if mode == GROUP3_2D:
                    plain = r.bits[r.at : r.at + 1] == "1"
                    r.at += 1
            if ends > 1 and out:
                break
        if r.at >= len(r.bits):
            break
        at = _read_2d(r, above, columns) if mode == GROUP4 or not plain else _read_1d(r, columns)
        if at is None:
            break
        row = np.zeros(columns + 1, np.uint8)
        np.add.at(row, np.array(at, np.int64), 1)
        out.append(np.packbits(np.cumsum(row[:-1]) % 2).tobytes())
        above = changes(np.cumsum(row[:-1]) % 2)
    return b"".join(out)
