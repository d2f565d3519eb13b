import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.kernels import carriers, codecs, containers, raster, tiff
from tessera.kernels.containers import Part

BYTES = st.one_of(st.binary(max_size=400), st.builds(lambda b, n: b * n, st.binary(min_size=1, max_size=6), st.integers(1, 900)))


@settings(deadline=None, max_examples=150)
@given(BYTES, st.integers(1, 50))
def test_codecs_round_trip_in_any_chunks(data, step):
    for encode, decode, fresh in [(codecs.PackBits.encode, codecs.PackBits.decode, codecs.PackBits), (codecs.Lzw.encode, codecs.Lzw.decode, codecs.Lzw), (lambda x: codecs.Lzw.encode(x, 8, False), lambda x: codecs.Lzw.decode(x, 8, False), lambda: codecs.Lzw(8, False))]:
        coded = encode(data)
        assert decode(coded) == data
        own = fresh()
        out = b"".join(own.add(coded[i : i + step]) for i in range(0, len(coded), step))
        assert out + (own.finish() if hasattr(own, "finish") else b"") == data


def test_codecs_know_the_published_examples():
    # the 10 x 10 sample image of many GIF tutorials, and the example of the TIFF 6.0 text
    coded = bytes.fromhex("8C2D99872A1CDC33A00275EC95FAA8DE608C04914C01")
    pixels = codecs.Lzw.decode(coded, 2, False)
    assert len(pixels) == 100 and pixels[:10] == b"\1\1\1\1\1\2\2\2\2\2"
    assert codecs.Lzw.encode(pixels, 2, False) == coded
    tiff_codes = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    packed = int(tiff_codes.ljust(-(-len(tiff_codes) // 8) * 8, "0"), 2).to_bytes(-(-len(tiff_codes) // 8), "big")
    assert codecs.Lzw.decode(packed) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    assert codecs.PackBits.decode(bytes.fromhex("FEAA028000 2AFDAA0380002A22F7AA".replace(" ", ""))) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")


@pytest.mark.parametrize("order", "<>")
def test_tiff_round_trip(order):
    e = tiff.Entry
    entries = [e("IFD0", 271, 2, b"maker\0"), e("IFD0", 258, 3, [8, 8, 8]), e("ExifIFD", 33434, 5, [(1, 125)]), e("ExifIFD", 37380, 10, [(-1, 3)]), e("GPS", 2, 5, [(34, 1), (3, 1), (3000, 100)]), e("IFD1", 256, 4, [2**32 - 1]), e("IFD0", 40000, 12, [1.5, -2.25]), e("IFD0", 40001, 6, [-3, 4])]
    found, warnings = tiff.read(tiff.write(entries, order))
    assert not warnings
    assert {(x.ifd, x.tag, x.type): x.values for x in found if x.tag not in tiff.SUB_IFDS} == {(x.ifd, x.tag, x.type): x.values for x in entries}


def test_tiff_survives_loops_and_cuts():
    block = bytearray(tiff.write([tiff.Entry("IFD0", 271, 2, b"longer than four\0"), tiff.Entry("IFD0", 256, 3, [7])]))
    struct.pack_into("<I", block, 8 + 2 + 24, 8)  # the chain points at its start
    found, warnings = tiff.read(bytes(block))
    assert [x.tag for x in found] == [256, 271] and len(warnings) == 1
    for n in range(len(block)):
        tiff.read(bytes(block[:n]))
    assert tiff.read(b"nothing")[1]


def test_containers_round_trip():
    rng = random.Random(1)
    jpeg = containers.jpeg_write([Part(0, -1, 0, "", "E1", 0, b"Exif\0\0xx"), Part(1, -1, 0, "", "FE", 0, b"hi"), Part(2, -1, 0, "scan", "DA", 0, b"\xff\xda\0\2ab\xff\xd9")])
    png = containers.png_write([Part(0, -1, 0, "", "IHDR", 0, bytes(13)), Part(1, -1, 0, "", "IDAT", 0, rng.randbytes(99)), Part(2, -1, 0, "", "IEND", 0, b"")])
    riff = containers.riff_write("WEBP", [Part(0, -1, 0, "chunk", "VP8X", 0, b"\x10\0\0\0" + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")), Part(1, -1, 0, "list", "abcd", 0, b""), Part(2, 1, 1, "chunk", "odd ", 0, b"123")])
    boxes = containers.box_write([Part(0, -1, 0, "box", "ftyp", 0, b"isom"), Part(1, -1, 0, "container", "moov", 0, b""), Part(2, 1, 1, "container", "meta", 0, bytes(4)), Part(3, 2, 2, "box", "hdlr", 0, b"x")])
    for data, write, kind in [(jpeg, containers.jpeg_write, "jpeg"), (png, containers.png_write, "png"), (riff, lambda p: containers.riff_write("WEBP", p), "webp"), (boxes, containers.box_write, "bmff")]:
        assert containers.detect(data) == kind
        assert write(list(containers.parts(data))) == data
    assert containers.webp_size(list(containers.parts(riff))) == (100, 50)
    assert [p.kind for p in containers.parts(jpeg)] == ["exif", "comment", "scan"]


def test_sizes():
    assert containers.jxl_size(bytes.fromhex("ff0acb060013880200f000b5")) == (64, 48)
    frame = lambda h: b"\xff\xc0\0\x0b\x08" + struct.pack(">HH", h, 30) + b"\1\1\1\1"
    assert containers.jpeg_size(b"\xff\xd8" + frame(20)) == (30, 20)
    assert containers.jpeg_size(b"\xff\xd8" + frame(0) + b"\xff\xdc\0\4\0\x28") == (30, 40)


def test_gif_blocks():
    screen = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x80, 0, 0) + bytes(6)
    data = screen + b"\x21\xf9\4\1\2\0\3\0" + b"\x2c" + bytes(8) + b"\0\2" + containers.framed(b"z" * 300) + b"\x21\xfe" + containers.framed(b"note") + b"\x3b"
    got = list(containers.parts(data))
    assert [(p.kind, p.type) for p in got] == [("screen", "GIF89a"), ("extension", "F9"), ("frame", "2C"), ("extension", "FE")]
    assert got[2].payload[-300:] == b"z" * 300 and got[3].payload == b"note"
    with pytest.raises(containers.Malformed):
        list(containers.parts(data[:-3]))


def test_carriers():
    sets = [(2, 25, b"a"), (2, 25, b"b" * 40000), (1, 90, b"\x1b%G")]
    assert [x[1:] for x in carriers.iptc_datasets(carriers.iptc_write(sets))] == sets
    items = [(1028, "", b"abc"), (2000, "even", b""), (1, "odd", b"xy")]
    assert [x[1:] for x in carriers.resources(b"??" + carriers.resources_write(items))] == items
    header = bytearray(128)
    header[8:10], header[36:40] = b"\x04\x30", b"acsp"
    profile = carriers.icc_write(bytes(header), [("desc", b"one body"), ("cprt", b"one body"), ("wtpt", b"xyz")])
    assert [(s, d) for _, s, _, d in carriers.icc_tags(profile)] == [("desc", b"one body"), ("cprt", b"one body"), ("wtpt", b"xyz")]
    assert len(profile) == struct.unpack(">I", profile[:4])[0] and carriers.icc_header(profile)["version"] == "4.3.0"
    assert carriers.picture_info(b"[x]\r\nA=1\rA=2\nB = z\0") == {"A": "2", "B": "z"}
    assert carriers.jfif(b"JFIF\0\1\2\1\0\x48\0\x48\0\0")["version"] == "1.02"
    assert carriers.print_im(b"PrintIM\x000300\0\0\0\1" + b"\0\2abcd") == ("0300", [(2, b"abcd")])
    assert carriers.jumbf_description(bytes(16) + b"\3label\0")["label"] == "label"


@settings(deadline=None, max_examples=200)
@given(st.sampled_from([b"\xff\xd8", containers.PNG_MARK, b"GIF89a", b"RIFF\0\0\0\0AVI ", b"\0\0\0\x08ftyp", b"\xff\x0a"]), st.binary(max_size=200))
def test_broken_files_only_raise_malformed(mark, rest):
    try:
        list(containers.parts(mark + rest))
    except containers.Malformed:
        pass


def test_lights_at_halves():
    """Pixels whose light is a half: 0.299 R + 0.587 G + 0.114 B + 0.5, summed in this order, tells which way they go."""
    pixels = [(223, 75, 7), (53, 165, 7), (223, 75, 7), (0, 0, 0), (255, 255, 255)]
    want = [int(np.floor(0.299 * r + 0.587 * g + 0.114 * b + 0.5)) for r, g, b in pixels]
    assert want[:2] == [112, 113]
    assert raster.mono(np.array([pixels], np.uint8))[0].tolist() == want
    assert [int(raster.mono(np.array([[p]], np.uint8))[0, 0]) for p in pixels] == want
