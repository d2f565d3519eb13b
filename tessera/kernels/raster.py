"""Pixels of TIFF, GIF and PNG images with numpy, and what libraries of images offer behind one interface.

Pictures are arrays of uint8: (height, width, 3) RGB, (height, width) grey or indexes.
"""

from __future__ import annotations

import struct
import zlib
from typing import Protocol

import numpy as np

from tessera.kernels import codecs, containers, fax, files, tiff
from tessera.kernels.containers import Malformed, Part

REVERSED = np.array([int(f"{i:08b}"[::-1], 2) for i in range(256)], np.uint8)


def samples(data: bytes, bits: int, order: str = ">") -> np.ndarray:
    """Unsigned samples of 1, 2, 4, 8, 16 or 32 bits, packed from the highest bit."""
    raw = np.frombuffer(data, np.uint8)
    if bits in (1, 2, 4):
        shifts = np.arange(8 - bits, -1, -bits, dtype=np.uint8)
        return ((raw[:, None] >> shifts) & ((1 << bits) - 1)).ravel()
    if bits == 8:
        return raw
    size = bits // 8
    if bits == 24:
        cells = raw[: len(raw) // 3 * 3].reshape(-1, 3).astype(np.uint32)
        cells = cells if order == ">" else cells[:, ::-1]
        return cells[:, 0] << 16 | cells[:, 1] << 8 | cells[:, 2]
    return np.frombuffer(data[: len(data) // size * size], f"{order}u{size}")


def floats(data: bytes, bits: int, order: str = ">") -> np.ndarray:
    """Samples of 16, 24, 32 or 64 bits as floats; those of 24 have 7 bits of exponent and 16 of fraction."""
    if bits == 24:
        raw = samples(data, 24, order).astype(np.int64)
        sign, power, part = np.where(raw >> 23, -1.0, 1.0), (raw >> 16 & 127), (raw & 0xFFFF) / 65536
        usual = np.ldexp(1 + part, (power - 63).astype(np.int32))
        return sign * np.where(power == 0, np.ldexp(part, -62), np.where(power == 127, np.where(part > 0, np.nan, np.inf), usual))
    return np.frombuffer(data[: len(data) // (bits // 8) * (bits // 8)], f"{order}f{bits // 8}").astype(float)


def predict(rows: np.ndarray, step: int) -> np.ndarray:
    """Differences from the sample of the pixel before, per row, in the samples' own width."""
    out = rows.copy()
    out[:, step:] = rows[:, step:] - rows[:, :-step]
    return out


def unpredict(rows: np.ndarray, step: int) -> np.ndarray:
    """Running sums per row and channel that wrap in the samples' own width; wider samples carry across their bytes."""
    pad = -rows.shape[1] % step
    cells = np.pad(rows, ((0, 0), (0, pad))).reshape(len(rows), -1, step)
    return np.cumsum(cells, axis=1, dtype=rows.dtype).reshape(len(rows), -1)[:, : rows.shape[1]]


def float_predict(data: bytes, rows: int, per_row: int, size: int, step: int, order: str = ">") -> bytes:
    """Rows of floats as byte planes, highest bytes first, then differences of bytes."""
    cells = np.frombuffer(data, np.uint8).reshape(rows, per_row, size)
    planes = (cells if order == ">" else cells[:, :, ::-1]).transpose(0, 2, 1).reshape(rows, -1)
    return predict(planes, step).tobytes()


def float_unpredict(data: bytes, rows: int, per_row: int, size: int, step: int, order: str = ">") -> bytes:
    planes = unpredict(np.frombuffer(data, np.uint8).reshape(rows, -1), step).reshape(rows, size, per_row).transpose(0, 2, 1)
    return np.ascontiguousarray(planes if order == ">" else planes[:, :, ::-1]).tobytes()


# --- colours


def cmyk_to_rgb(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.int32)
    return ((255 - x[..., :3]) * (255 - x[..., 3:4]) // 255).astype(np.uint8)


def rgb_to_cmyk(x: np.ndarray) -> np.ndarray:
    x = 255 - x.astype(float)
    k = x.min(-1, keepdims=True)
    rest = np.divide((x - k) * 255, 255 - k, out=np.zeros_like(x), where=k < 255)
    return np.concatenate([np.floor(rest + 0.5), k], -1).astype(np.uint8)


def ycbcr_to_rgb(x: np.ndarray) -> np.ndarray:
    y, cb, cr = x[..., 0].astype(float), x[..., 1].astype(float) - 128, x[..., 2].astype(float) - 128
    out = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1)
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def lab_to_rgb(lightness: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """CIE L*a*b* under D50 as sRGB: Bradford-adapted matrix and the sRGB curve."""
    fy = (lightness + 16) / 116
    xyz = np.stack([fy + a / 500, fy, fy - b / 200], -1)
    xyz = np.where(xyz > 6 / 29, xyz**3, (xyz - 4 / 29) * 3 * (6 / 29) ** 2) * np.array([0.9642, 1.0, 0.8249])
    matrix = np.array([[3.1338561, -1.6168667, -0.4906146], [-0.9787684, 1.9161415, 0.0334540], [0.0719453, -0.2289914, 1.4052427]])
    light = np.clip(xyz @ matrix.T, 0, 1)
    return np.floor(255 * np.where(light <= 0.0031308, 12.92 * light, 1.055 * light ** (1 / 2.4) - 0.055) + 0.5).astype(np.uint8)


# --- TIFF

#: Numbers of compressions.
NONE, HUFFMAN, FAX3, FAX4, LZW, DEFLATE, ADOBE_DEFLATE, PACKBITS = 1, 2, 3, 4, 5, 32946, 8, 32773


def _inflated(kind: int, raw: bytes, width: int, rows: int, options: int, fill: int) -> bytes:
    if fill == 2 and kind in (NONE, HUFFMAN, FAX3, FAX4):
        raw = REVERSED[np.frombuffer(raw, np.uint8)].tobytes()
    if kind == LZW:
        return codecs.Lzw.decode(raw)
    if kind == PACKBITS:
        return codecs.PackBits.decode(raw)
    if kind in (DEFLATE, ADOBE_DEFLATE):
        return zlib.decompressobj().decompress(raw)
    if kind in (HUFFMAN, FAX3, FAX4):
        mode = {HUFFMAN: fax.MODIFIED_HUFFMAN, FAX3: fax.GROUP3_2D if options & 1 else fax.GROUP3, FAX4: fax.GROUP4}[kind]
        return fax.decode(raw, width, mode, rows)
    if kind != NONE:
        raise Malformed(f"compression {kind} is not read")
    return raw


def tiff_rgb(data: bytes, max_pixels: int = 1 << 28) -> np.ndarray:
    """The first directory's image as RGB: strips or tiles, chunky or planar, unsigned, signed or float samples, and white- or
    black-is-zero, RGB, palette, mask, CMYK, YCbCr and L*a*b* colours."""
    order = "<" if data[:2] == b"II" else ">"
    tag = {e.tag: e.values for e in tiff.read(data)[0] if e.ifd == "IFD0"}
    one = lambda t, other: (list(tag[t]) or [other])[0] if t in tag else other
    if 256 not in tag or 257 not in tag:
        raise Malformed("the image has no size")
    width, height, channels = one(256, 0), one(257, 0), one(277, 1)
    if not width or not height or width * height > max_pixels:
        raise Malformed(f"{width} x {height} pixels are none or too many")
    bits, kind, photo, planar, form = one(258, 1), one(259, 1), one(262, 1), one(284, 1), one(339, 1)
    predictor, fill, options = one(317, 1), one(266, 1), one(292, 0)
    tiled = 322 in tag
    wide, tall = (one(322, 0), one(323, 0)) if tiled else (width, min(one(278, height), height))
    offsets, sizes = (tag.get(324), tag.get(325)) if tiled else (tag.get(273), tag.get(279))
    if not offsets or not sizes or not wide or not tall:
        raise Malformed("the image has no strips or tiles")
    across, down = -(-width // wide), -(-height // tall)
    planes = channels if planar == 2 else 1
    per = 1 if planar == 2 else channels
    row_bytes = -(-wide * per * bits // 8)
    out = np.zeros((height, width, channels))
    sub = tuple(tag.get(530, (2, 2)))[:2] if photo == 6 and planar == 1 and channels == 3 else (1, 1)
    for i, (at, size) in enumerate(zip(offsets, sizes, strict=False)):
        plane, place = divmod(i, across * down)
        if plane >= planes:
            break
        y, x = place // across * tall, place % across * wide
        rows = tall if tiled else min(tall, height - y)
        raw = _inflated(kind, data[at : at + size], wide, rows, options, fill)
        if sub != (1, 1):
            block = _subsampled(raw, wide, rows, *sub)
        else:
            raw = raw[: rows * row_bytes].ljust(rows * row_bytes, b"\0")
            if predictor == 3:
                raw = float_unpredict(raw, rows, wide * per, bits // 8, per, order)
            lines = np.frombuffer(raw, np.uint8).reshape(rows, row_bytes)
            if form == 3:
                cells = floats(raw, bits, order).reshape(rows, -1)
            else:
                cells = np.stack([samples(line.tobytes(), bits, order) for line in lines]) if bits < 8 else samples(raw, bits, order).reshape(rows, -1)
                if predictor == 2 and bits in (8, 16, 32):
                    cells = unpredict(cells.astype(f"u{bits // 8}"), per)
                if form == 2:
                    cells = np.where(cells >= 1 << bits - 1, cells.astype(np.int64) - (1 << bits), cells.astype(np.int64)) + (1 << bits - 1)
            block = cells[:, : wide * per].reshape(rows, wide, per)
        part = block[: height - y, : width - x]
        if planar == 2:
            out[y : y + part.shape[0], x : x + part.shape[1], plane] = part[..., 0]
        else:
            out[y : y + part.shape[0], x : x + part.shape[1]] = part
    if photo == 3:
        index = out[..., 0].astype(np.int64)
        table = np.array(tag.get(320, []), np.int64)
        n = len(table) // 3
        index = np.where(index < n, index, 0)
        return (np.stack([table[index + k * n] for k in range(3)], -1) >> 8).astype(np.uint8) if n else np.zeros((height, width, 3), np.uint8)
    top = 1.0 if form == 3 else float((1 << bits) - 1)
    if photo == 8:
        scale = lambda v: np.where(v > top / 2, v - (top + 1), v) * (127 / (top // 2))
        return lab_to_rgb(out[..., 0] * (100 / top), scale(out[..., 1]), scale(out[..., 2]))
    byte = np.clip(np.floor(out * (255 / top) + 0.5), 0, 255).astype(np.uint8)
    if photo in (0, 1, 4):
        grey = 255 - byte[..., 0] if photo == 0 else byte[..., 0]
        return np.repeat(grey[..., None], 3, -1)
    if photo == 5:
        return cmyk_to_rgb(byte[..., :4])
    if photo == 6:
        return ycbcr_to_rgb(byte[..., :3])
    if photo != 2 or channels < 3:
        raise Malformed(f"colours of kind {photo} are not read")
    return byte[..., :3].copy()


def _subsampled(raw: bytes, wide: int, rows: int, sx: int, sy: int) -> np.ndarray:
    """Units of sx * sy lights and a pair of colours as full pixels."""
    across, down = -(-wide // sx), -(-rows // sy)
    unit = sx * sy + 2
    cells = np.frombuffer(raw[: across * down * unit].ljust(across * down * unit, b"\0"), np.uint8).reshape(down, across, unit)
    light = cells[..., : sx * sy].reshape(down, across, sy, sx).transpose(0, 2, 1, 3).reshape(down * sy, across * sx)
    colour = [np.repeat(np.repeat(cells[..., sx * sy + k], sy, 0), sx, 1) for k in range(2)]
    return np.stack([light, *colour], -1)[:rows, :wide]


def tiff_encode(image: np.ndarray, compression: int = LZW, rows_per_strip: int = 64, order: str = "<", predictor: bool = False) -> bytes:
    """RGB, grey or (fax) black-and-white pixels as a TIFF file."""
    height, width = image.shape[:2]
    bilevel = compression in (HUFFMAN, FAX3, FAX4)
    grey = image.ndim == 2
    strips = []
    for y in range(0, height, rows_per_strip):
        part = image[y : y + rows_per_strip]
        if bilevel:
            black = (part if grey else mono(part)) < 128
            mode = {HUFFMAN: fax.MODIFIED_HUFFMAN, FAX3: fax.GROUP3, FAX4: fax.GROUP4}[compression]
            strips.append(fax.encode(np.packbits(black, axis=1).tobytes(), width, mode))
            continue
        cells = part.reshape(len(part), -1)
        raw = (predict(cells, 1 if grey else 3) if predictor else cells).tobytes()
        strips.append({NONE: bytes, LZW: codecs.Lzw.encode, PACKBITS: codecs.PackBits.encode, ADOBE_DEFLATE: zlib.compress, DEFLATE: zlib.compress}[compression](raw))
    e = tiff.Entry
    depth = [1] if bilevel else [8] if grey else [8, 8, 8]
    entries = [e("IFD0", 256, 4, [width]), e("IFD0", 257, 4, [height]), e("IFD0", 258, 3, depth), e("IFD0", 259, 3, [compression]), e("IFD0", 262, 3, [0 if bilevel else 1 if grey else 2]), e("IFD0", 277, 3, [len(depth)]), e("IFD0", 278, 4, [rows_per_strip]), e("IFD0", 279, 4, [len(s) for s in strips]), e("IFD0", 273, 4, [0] * len(strips))]
    if predictor and not bilevel:
        entries.append(e("IFD0", 317, 3, [2]))
    head = len(tiff.write(entries, order))
    at = [head + sum(map(len, strips[:i])) for i in range(len(strips))]
    entries[8] = e("IFD0", 273, 4, at)
    return tiff.write(entries, order) + b"".join(strips)


# --- GIF


def interlaced_rows(height: int) -> np.ndarray:
    """The row that each stored row of an interlaced frame is."""
    return np.concatenate([np.arange(start, height, step) for start, step in ((0, 8), (4, 8), (2, 4), (1, 2))]).astype(np.int64)


def gif_frame(raw: bytes, colours: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """(indexes, palette) of a frame's block with its framing; the frame's own colours come before the given ones."""
    _, _, width, height, flags = struct.unpack_from("<HHHHB", raw, 1)
    at = 10
    if flags & 128:
        size = 3 << (flags & 7) + 1
        colours, at = raw[10 : 10 + size], 10 + size
    body, _ = containers.sub_blocks(raw, at + 1)
    index = np.frombuffer(codecs.Lzw.decode(body, raw[at], False)[: width * height].ljust(width * height, b"\0"), np.uint8).reshape(height, width)
    if flags & 64:
        out = np.empty_like(index)
        out[interlaced_rows(height)] = index
        index = out
    return index, np.frombuffer(colours[: len(colours) // 3 * 3], np.uint8).reshape(-1, 3)


def gif_frame_write(index: np.ndarray, palette: np.ndarray, left: int = 0, top: int = 0, interlace: bool = False) -> bytes:
    """A frame's block with its own colours."""
    height, width = index.shape
    bits = max(1, int(len(palette) - 1).bit_length())
    colours = palette.astype(np.uint8).tobytes().ljust(3 << bits, b"\0")
    cells = index[interlaced_rows(height)] if interlace else index
    code = max(2, bits)
    return b"\x2c" + struct.pack("<HHHHB", left, top, width, height, 128 | 64 * interlace | bits - 1) + colours + bytes([code]) + containers.framed(codecs.Lzw.encode(cells.astype(np.uint8).tobytes(), code, False))


def gif_images(data: bytes) -> list[np.ndarray]:
    """Each frame's own pixels as RGB; indexes outside the palette are its first colour."""
    head, rows, _ = files.gif_blocks(data)
    out = []
    for kind, raw in rows:
        if kind == "frame":
            index, palette = gif_frame(raw, head[13:])
            palette = palette if len(palette) else np.zeros((1, 3), np.uint8)
            out.append(palette[np.where(index < len(palette), index, 0)])
    return out


def gif_encode(images: list[np.ndarray], delays: list[int] | None = None, colours: int = 256) -> bytes:
    """RGB pictures as frames with palettes of their own; several loop without end."""
    height, width = (max(i.shape[k] for i in images) for k in (0, 1))
    rows = [("loop", files.gif_extension("loop", b"\1\0\0"))] if len(images) > 1 else []
    for n, image in enumerate(images):
        index, palette = quantise(image, colours)
        if len(images) > 1:
            rows.append(("extension-F9", b"\x21\xf9\x04\0" + struct.pack("<H", (delays or [10] * len(images))[n]) + b"\0\0"))
        rows.append(("frame", gif_frame_write(index, palette)))
    return files.gif_join(b"GIF89a" + struct.pack("<HHBBB", width, height, 0, 0, 0), rows)


# --- PNG

_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _unfilter(raw: bytes, rows: int, row_bytes: int, step: int) -> np.ndarray:
    cells = np.frombuffer(raw[: rows * (row_bytes + 1)].ljust(rows * (row_bytes + 1), b"\0"), np.uint8).reshape(rows, row_bytes + 1)
    out = np.zeros((rows, row_bytes), np.uint8)
    above = np.zeros(row_bytes, np.uint8)
    for y in range(rows):
        kind, line = cells[y, 0], cells[y, 1:]
        if kind == 1:
            line = unpredict(line[None], step)[0]
        elif kind == 2:
            line = line + above
        elif kind in (3, 4):
            own, up = line.tolist(), above.tolist()
            for i in range(row_bytes):
                a = own[i - step] if i >= step else 0
                if kind == 3:
                    own[i] = own[i] + (a + up[i] >> 1) & 255
                else:
                    c = up[i - step] if i >= step else 0
                    p = a + up[i] - c
                    pa, pb, pc = abs(p - a), abs(p - up[i]), abs(p - c)
                    own[i] = own[i] + (a if pa <= pb and pa <= pc else up[i] if pb <= pc else c) & 255
            line = np.array(own, np.uint8)
        out[y] = above = line
    return out


def png_rgb(data: bytes, max_pixels: int = 1 << 28) -> np.ndarray:
    """A PNG's pixels as RGB: all colour kinds and depths, whole or interlaced; opacity is left out."""
    parts = list(containers.png_parts(data))
    width, height, depth, kind, _, _, lace = struct.unpack_from(">IIBBBBB", parts[0].payload)
    if width * height > max_pixels or kind not in _CHANNELS:
        raise Malformed(f"{width} x {height} pixels of kind {kind} are not read")
    raw = zlib.decompressobj().decompress(b"".join(p.payload for p in parts if p.type == "IDAT"))
    channels = _CHANNELS[kind]
    step = max(1, channels * depth // 8)
    out = np.zeros((height, width, channels), np.int64)
    at = 0
    for y0, x0, dy, dx in ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1)) if lace else ((0, 0, 1, 1),):
        rows, wide = len(range(y0, height, dy)), len(range(x0, width, dx))
        if not rows or not wide:
            continue
        row_bytes = -(-wide * channels * depth // 8)
        lines = _unfilter(raw[at:], rows, row_bytes, step)
        at += rows * (row_bytes + 1)
        cells = np.stack([samples(line.tobytes(), depth)[: wide * channels] for line in lines])
        out[y0::dy, x0::dx] = cells.reshape(rows, wide, channels)
    if kind == 3:
        palette = np.frombuffer(next((p.payload for p in parts if p.type == "PLTE"), b"\0\0\0"), np.uint8).reshape(-1, 3)
        return palette[np.where(out[..., 0] < len(palette), out[..., 0], 0)]
    byte = (out >> 8 if depth == 16 else out * 255 // ((1 << depth) - 1)).astype(np.uint8)
    return np.repeat(byte[..., :1], 3, -1) if channels < 3 else byte[..., :3].copy()


def _png_body(image: np.ndarray) -> tuple[bytes, bytes]:
    height, width = image.shape[:2]
    cells = image.reshape(height, -1)
    lines = predict(cells, 1 if image.ndim == 2 else 3)
    raw = np.concatenate([np.ones((height, 1), np.uint8), lines], 1).tobytes()
    return struct.pack(">IIBBBBB", width, height, 8, 0 if image.ndim == 2 else 2, 0, 0, 0), zlib.compress(raw)


def png_encode(image: np.ndarray) -> bytes:
    head, body = _png_body(image)
    return containers.png_write([Part(0, -1, 0, "chunk", k, 0, b) for k, b in (("IHDR", head), ("IDAT", body), ("IEND", b""))])


def apng_encode(images: list[np.ndarray], delays: list[tuple[int, int]], plays: int = 0) -> bytes:
    """RGB pictures of one size as an animation; the first is the picture that others see."""
    head, _ = _png_body(images[0])
    rows = [("IHDR", head), ("acTL", struct.pack(">II", len(images), plays))]
    number = 0
    for n, image in enumerate(images):
        height, width = image.shape[:2]
        rows.append(("fcTL", struct.pack(">IIIIIHHBB", number, width, height, 0, 0, *delays[n], 0, 0)))
        number += 1
        body = _png_body(image)[1]
        rows.append(("IDAT", body) if n == 0 else ("fdAT", struct.pack(">I", number) + body))
        number += n > 0
    rows.append(("IEND", b""))
    return containers.png_write([Part(0, -1, 0, "chunk", k, 0, b) for k, b in rows])


def apng_frames(data: bytes) -> list[dict]:
    """Frames with their place, delay, blending and a PNG of each: fcTL begins one, IDAT after it or fdAT belong to it."""
    parts = list(containers.png_parts(data))
    shared = [p for p in parts if p.type in ("PLTE", "tRNS", "gAMA", "sRGB", "iCCP")]
    out: list[dict] = []
    for p in parts:
        if p.type == "fcTL":
            number, w, h, x, y, num, den, dispose, blend = struct.unpack_from(">IIIIIHHBB", p.payload)
            out.append({"number": number, "width": w, "height": h, "x": x, "y": y, "delay": num / (den or 100), "dispose": dispose, "blend": blend, "data": b""})
        elif p.type in ("IDAT", "fdAT") and out:
            out[-1]["data"] += p.payload[4:] if p.type == "fdAT" else p.payload
    head = parts[0].payload
    for f in out:
        rows = [("IHDR", struct.pack(">II", f["width"], f["height"]) + head[8:]), *((p.type, p.payload) for p in shared), ("IDAT", f["data"]), ("IEND", b"")]
        f["png"] = containers.png_write([Part(0, -1, 0, "chunk", k, 0, b) for k, b in rows])
    return out


# --- pictures


def resample(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Means of the source pixels that each new one covers; where it covers none, the nearest."""
    rows, columns = image.shape[:2]
    out = image.astype(float)
    for axis, (old, new) in enumerate(((rows, height), (columns, width))):
        start = np.arange(new) * old // new
        end = np.maximum(start + 1, (np.arange(new) + 1) * old // new)
        sums = np.concatenate([np.zeros_like(out.take([0], axis)), np.cumsum(out, axis)], axis)
        shape = [1] * out.ndim
        shape[axis] = new
        out = (sums.take(end, axis) - sums.take(start, axis)) / (end - start).reshape(shape)
    return np.floor(out + 0.5).astype(np.uint8)


def mono(image: np.ndarray) -> np.ndarray:
    """Lights of RGB pixels by the weights of CCIR 601, summed from red to blue: a matrix product may sum in another order, which
    tells at halves."""
    r, g, b = np.moveaxis(image.astype(float), -1, 0)
    return np.floor(0.299 * r + 0.587 * g + 0.114 * b + 0.5).astype(np.uint8)


def quantise(image: np.ndarray, colours: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(indexes, palette): the picture's own colours in order of first appearance, or boxes cut at medians if there are more."""
    flat = image.reshape(-1, 3)
    kinds, first, place, count = np.unique(flat, axis=0, return_index=True, return_inverse=True, return_counts=True)
    place = place.reshape(-1)
    if len(kinds) <= colours:
        order = np.argsort(first, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return rank[place].reshape(image.shape[:2]).astype(np.uint8), kinds[order]
    boxes = [np.arange(len(kinds))]
    while len(boxes) < colours:
        spans = [np.ptp(kinds[b].astype(int), axis=0).max() if len(b) > 1 else -1 for b in boxes]
        widest = int(np.argmax(spans))
        if spans[widest] <= 0:
            break
        box = boxes.pop(widest)
        axis = int(np.ptp(kinds[box].astype(int), axis=0).argmax())
        box = box[np.argsort(kinds[box, axis], kind="stable")]
        half = np.searchsorted(np.cumsum(count[box]), count[box].sum() / 2) + 1
        half = min(max(1, int(half)), len(box) - 1)
        boxes += [box[:half], box[half:]]
    palette = np.stack([np.floor(np.average(kinds[b], axis=0, weights=count[b]) + 0.5) for b in boxes]).astype(np.uint8)
    own = np.empty(len(kinds), np.int64)
    for i, b in enumerate(boxes):
        own[b] = i
    return own[place].reshape(image.shape[:2]).astype(np.uint8), palette


# --- libraries


class Library(Protocol):
    """What a library of images offers; can() tells which of decode:<format>, encode:<format>, resample, mono, quantise, cmyk."""

    def can(self, capability: str) -> bool: ...

    def decode(self, data: bytes) -> np.ndarray: ...

    def encode(self, image: np.ndarray, kind: str) -> bytes: ...


class NumpyLibrary:
    """The library of this module; JPEG, WebP and JPEG XL pixels need another one."""

    READ = {"png": png_rgb, "tiff": tiff_rgb, "gif": lambda d: gif_images(d)[0]}
    WRITE = {"png": png_encode, "tiff": tiff_encode, "gif": lambda i: gif_encode([i])}

    def can(self, capability: str) -> bool:
        return capability in {*(f"decode:{k}" for k in self.READ), *(f"encode:{k}" for k in self.WRITE), "resample", "mono", "quantise", "cmyk", "icc"}

    def decode(self, data: bytes) -> np.ndarray:
        kind = containers.detect(data)
        if kind not in self.READ:
            raise Malformed(f"{kind} pixels are not read")
        return self.READ[kind](data)

    def encode(self, image: np.ndarray, kind: str) -> bytes:
        if kind not in self.WRITE:
            raise Malformed(f"{kind} pixels are not written")
        return self.WRITE[kind](image)


LIBRARIES: dict[str, Library] = {"numpy": NumpyLibrary()}


def register_library(name: str, library: Library) -> None:
    LIBRARIES[name] = library


def capable(capability: str, name: str | None = None) -> Library | None:
    """The library of a name if it can, else the first that can."""
    rows = [LIBRARIES[name]] if name else list(LIBRARIES.values())
    return next((x for x in rows if x.can(capability)), None)


# --- thumbnails and captions

CAPTION = (460, 128)


def caption_read(raw: bytes) -> np.ndarray:
    """IPTC's rasterised caption: 460 by 128 bits in columns from the left, each from the bottom; True is ink."""
    bits = np.unpackbits(np.frombuffer(raw.ljust(7360, b"\0")[:7360], np.uint8)).reshape(CAPTION)
    return bits.T[::-1].astype(bool)


def caption_write(ink: np.ndarray) -> bytes:
    cells = np.zeros((CAPTION[1], CAPTION[0]), bool)
    cells[: ink.shape[0], : ink.shape[1]] = ink[: CAPTION[1], : CAPTION[0]]
    return np.packbits(cells[::-1].T).tobytes()


def jfxx_thumbnail(image: np.ndarray, jpeg: bytes | None = None) -> bytes:
    """A JFXX payload in the smallest of its forms: JPEG bytes where given, a palette of 256 colours, RGB."""
    height, width = image.shape[:2]
    if width > 255 or height > 255:
        image = resample(image, min(width, 255), min(height, 255))
        height, width = image.shape[:2]
    index, palette = quantise(image)
    forms = [b"JFXX\0\x13" + bytes([width, height]) + image.tobytes(), b"JFXX\0\x11" + bytes([width, height]) + palette.tobytes().ljust(768, b"\0") + index.tobytes()]
    if jpeg is not None:
        forms.append(b"JFXX\0\x10" + jpeg)
    return min(forms, key=len)


def jfxx_image(raw: bytes) -> np.ndarray | bytes | None:
    """The picture of a JFXX payload, or its JPEG bytes."""
    if not raw.startswith(b"JFXX\0") or len(raw) < 8:
        return None
    kind, width, height = raw[5], raw[6], raw[7]
    if kind == 0x10:
        return raw[6:]
    if kind == 0x11:
        palette = np.frombuffer(raw[8:776], np.uint8).reshape(-1, 3)
        return palette[np.frombuffer(raw[776 : 776 + width * height], np.uint8).reshape(height, width)]
    return np.frombuffer(raw[8 : 8 + 3 * width * height], np.uint8).reshape(height, width, 3) if kind == 0x13 else None
