"""Byte codecs: PackBits, LZW as TIFF and as GIF have it, and incremental forms of them."""

from __future__ import annotations

import numpy as np


class PackBits:
    """Run lengths: n < 128 copies n + 1 bytes, n > 128 repeats one 257 - n times, 128 is nothing."""

    @staticmethod
    def encode(data: bytes) -> bytes:
        if not data:
            return b""
        cells = np.frombuffer(data, np.uint8)
        starts = np.flatnonzero(np.diff(cells, prepend=cells[0] ^ 1))
        sizes = np.diff(np.append(starts, len(cells)))
        out, at = bytearray(), 0
        for start, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            PackBits._copied(out, data, at, start)
            value = data[start : start + 1]
            out += (b"\x81" + value) * (size // 128)
            if size % 128:  # a single byte left over is a copied one
                out += bytes([257 - size % 128]) + value if size % 128 > 1 else b"\0" + value
            at = start + size
        PackBits._copied(out, data, at, len(data))
        return bytes(out)

    @staticmethod
    def _copied(out: bytearray, data: bytes, at: int, end: int) -> None:
        for a in range(at, end, 128):
            part = data[a : min(a + 128, end)]
            out.append(len(part) - 1)
            out += part

    def __init__(self) -> None:
        self.held = b""

    def add(self, chunk: bytes) -> bytes:
        """What can be decoded so far; an unfinished packet waits."""
        data, out, at = self.held + chunk, bytearray(), 0
        while at < len(data):
            n = data[at]
            size = 1 if n == 128 else 2 if n > 128 else n + 2
            if at + size > len(data):
                break
            out += data[at + 1 : at + size] if n < 128 else data[at + 1 : at + 2] * (257 - n) if n > 128 else b""
            at += size
        self.held = data[at:]
        return bytes(out)

    def finish(self) -> bytes:
        """A literal that is cut off still gives what it has."""
        rest, self.held = self.held, b""
        return rest[1:] if rest and rest[0] < 128 else b""

    @classmethod
    def decode(cls, data: bytes) -> bytes:
        own = cls()
        return own.add(data) + own.finish()


class Lzw:
    """LZW of up to 12 bits.  tiff: most significant bit first and widths change a code early; else as GIF has it.

    A code's width follows from its number since the last clearing code, so that codes are cut out of, and put into, bits for
    many at once."""

    def __init__(self, bits: int = 8, tiff: bool = True) -> None:
        self.bits, self.tiff = bits, tiff
        self.clear, self.stop = 1 << bits, (1 << bits) + 1
        self.held, self.skip = b"", 0  # bytes that wait, and how many bits of them are used
        self.ended = False
        self._reset()

    def _reset(self) -> None:
        self.table = [bytes([i]) for i in range(self.clear)] + [b"", b""]
        self.last, self.count = b"", 0  # codes since the clearing one

    def add(self, chunk: bytes) -> bytes:
        out: list[bytes] = []
        data = self.held + chunk
        at = self.skip
        while not self.ended:
            widths = code_widths(self.bits, self.tiff, self.count, 4096)
            ends = at + np.cumsum(widths)
            ends = ends[: np.searchsorted(ends, 8 * len(data), side="right")]
            if not len(ends):
                break
            codes = cut_codes(data, ends - widths[: len(ends)], widths[: len(ends)], self.tiff)
            marks = np.flatnonzero((codes == self.clear) | (codes == self.stop))
            n = int(marks[0]) if len(marks) else len(codes)
            self._words(codes[:n].tolist(), out)
            if len(marks):
                at = int(ends[n])
                if codes[n] == self.stop:
                    self.ended = True
                self._reset()
            else:
                at = int(ends[-1])
                self.count += n
        self.held, self.skip = data[at // 8 :], at % 8
        return b"".join(out)

    def _words(self, codes: list[int], out: list[bytes]) -> None:
        table, last = self.table, self.last
        for code in codes:
            if code < len(table):
                word = table[code]
            elif last and code == len(table):
                word = last + last[:1]
            else:
                raise ValueError(f"code {code} is not known yet")
            out.append(word)
            if last and len(table) < 4096:
                table.append(last + word[:1])
            last = word
        self.last = last

    @classmethod
    def decode(cls, data: bytes, bits: int = 8, tiff: bool = True) -> bytes:
        return cls(bits, tiff).add(data)

    @staticmethod
    def encode(data: bytes, bits: int = 8, tiff: bool = True) -> bytes:
        """Codes of the longest known words; the table is cleared when it is full."""
        clear, stop = 1 << bits, (1 << bits) + 1
        codes, widths, since = [clear], [np.array([bits + 1])], 1
        table: dict[int, int] = {}
        size, word = stop + 1, -1
        for byte in data:
            if word < 0:
                word = byte
                continue
            key = word << 8 | byte
            found = table.get(key)
            if found is not None:
                word = found
                continue
            codes.append(word)
            if size < 4094:
                table[key] = size
                size += 1
            else:
                codes.append(clear)
                widths.append(code_widths(bits, tiff, 0, len(codes) - since))
                since, size = len(codes), stop + 1
                table = {}
            word = byte
        if word >= 0:
            codes.append(word)
        codes.append(stop)
        widths.append(code_widths(bits, tiff, 0, len(codes) - since))
        return put_codes(np.array(codes, np.uint64), np.concatenate(widths), tiff)


def code_widths(bits: int, tiff: bool, first: int, count: int) -> np.ndarray:
    """Bits of codes by their number since the clearing one: the table has an entry less than codes that came before."""
    entries = (1 << bits) + 2 + np.maximum(np.arange(first, first + count) - 1, 0)
    known = entries + tiff
    return np.clip(np.where(known >= 1 << bits + 1, np.floor(np.log2(np.maximum(known, 1))).astype(np.int64) + 1, bits + 1), bits + 1, 12)


def cut_codes(data: bytes, starts: np.ndarray, widths: np.ndarray, high_first: bool) -> np.ndarray:
    """Codes at bit offsets."""
    first = int(starts[0]) // 8
    raw = np.frombuffer(data[first : (int(starts[-1]) + 12) // 8 + 1] + bytes(4), np.uint8).astype(np.uint32)
    at = starts // 8 - first
    shift = (starts % 8).astype(np.uint32)
    if high_first:
        three = raw[at] << 16 | raw[at + 1] << 8 | raw[at + 2]
        return (three >> (24 - shift - widths).astype(np.uint32)) & ((1 << widths) - 1).astype(np.uint32)
    three = raw[at] | raw[at + 1] << 8 | raw[at + 2] << 16
    return (three >> shift) & ((1 << widths) - 1).astype(np.uint32)


def put_codes(codes: np.ndarray, widths: np.ndarray, high_first: bool) -> bytes:
    """Codes in a row as bytes."""
    ends = np.cumsum(widths)
    owner = np.repeat(np.arange(len(codes)), widths)
    inside = np.arange(int(ends[-1])) - np.repeat(ends - widths, widths)
    shift = np.repeat(widths, widths) - 1 - inside if high_first else inside
    flags = ((codes[owner] >> shift.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(flags, bitorder="big" if high_first else "little").tobytes()
