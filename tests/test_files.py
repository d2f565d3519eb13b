"""Changes of whole files, what carriers say, pixels, codes and profiles, by properties and published examples."""

import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.kernels import carriers, containers, fax, files, icc, meta, notes, raster, text, tiff, xmp
from tessera.sources import media, ranges

P, E = containers.Part, tiff.Entry
JPEG = containers.jpeg_write([P(0, -1, 0, "", "E0", 0, b"JFIF\0\1\2\1\0\x48\0\x48\0\0"), P(1, -1, 0, "", "C0", 0, b"\x08" + struct.pack(">HHB", 5, 6, 3)), P(2, -1, 0, "scan", "DA", 0, b"\xff\xda\0\2\1\2\xff\0\3\xff\xd9TRAIL")])
PNG = containers.png_write([P(0, -1, 0, "", "IHDR", 0, struct.pack(">IIBBBBB", 4, 3, 8, 2, 0, 0, 0)), P(1, -1, 0, "", "IDAT", 0, zlib.compress(bytes(39))), P(2, -1, 0, "", "IEND", 0, b"")]) + b"TRAIL"
GIF = b"GIF87a" + struct.pack("<HHBBB", 2, 2, 0x80, 0, 0) + bytes(6) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 2, 2, 0) + b"\x02\x02\x44\x01\x00\x3bTRAIL"
WEBP = containers.riff_write("WEBP", [P(0, -1, 0, "chunk", "VP8L", 0, b"\x2f" + struct.pack("<I", 9 | (7 << 14)))])
AVI = containers.riff_write("AVI ", [P(0, -1, 0, "list", "hdrl", 0, b""), P(1, 0, 1, "chunk", "avih", 0, struct.pack("<14I", 40000, 0, 0, 0, 12, 0, 0, 0, 320, 240, 0, 0, 0, 0)), P(2, -1, 0, "list", "movi", 0, b""), P(3, 2, 1, "chunk", "00dc", 0, b"x" * 64), P(4, -1, 0, "chunk", "idx1", 0, b"y" * 16)])
JXL = bytes.fromhex("ff0acb060013880200f000b5")
TIFF = tiff.write([E("IFD0", 256, 4, [7]), E("IFD0", 257, 4, [9]), E("IFD0", 271, 2, b"Old make\0")])
BMFF = struct.pack(">I4s", 16, b"ftyp") + b"isom\0\0\0\0" + struct.pack(">I4s", 12, b"mdat") + b"1234"
FILES = {"jpeg": JPEG, "png": PNG, "gif": GIF, "webp": WEBP, "avi": AVI, "jxl": JXL, "tiff": TIFF, "bmff": BMFF}
VALUES = {
    "exif": tiff.write([E("IFD0", 271, 2, b"Canon\0"), E("IFD0", 270, 2, b"a long description\0")]),
    "xmp": xmp.write({"xmp:Rating": "3"}).encode(),
    "icc": icc.matrix_profile(np.eye(3), 2.2),
    "irb": carriers.resources_write([(1005, "", b"1234")]),
    "iptc": carriers.iptc_write([(2, 25, b"kw")]),
    "comment": b"hello",
    "jumbf": notes.jumbf_json("a", "{}"),
}


@pytest.mark.parametrize("kind", FILES)
@pytest.mark.parametrize("carrier", VALUES)
def test_setters_keep_everything_else(kind, carrier):
    data, value = FILES[kind], VALUES[carrier]
    try:
        with_it = files.put(data, carrier, value)
    except files.NoHome:
        return
    if (kind, carrier) == ("tiff", "exif"):
        assert [e.values for e in tiff.read(with_it)[0] if e.tag == 271] == [b"Canon\0"]
    else:
        assert files.get(with_it, carrier) == value
    assert files.size(with_it) == files.size(data) and files.trailing(with_it) == files.trailing(data)
    assert containers.detect(with_it) == kind
    for other in set(VALUES) - {carrier, "irb", "iptc"}:
        if (kind, other) != ("tiff", "exif"):
            assert files.get(with_it, other) == files.get(data, other)
    again = files.put(with_it, carrier, value + b"longer" if carrier == "comment" else value)
    without = files.put(again, carrier, None)
    if kind in ("jpeg", "png"):
        assert without == data
    if kind != "tiff":
        assert not files.get(without, carrier)


def test_packets_and_profiles_that_fit_no_segment():
    packet = xmp.write({"dc:description": {"x-default": "z" * 150_000}}).encode()
    data = files.put(JPEG, "xmp", packet)
    assert files.get(data, "xmp") == packet and len([p for p in containers.jpeg_parts(data) if p.kind == "xmp-extended"]) == 3
    profile = random.Random(1).randbytes(200_000)
    both = files.put(data, "icc", profile)
    assert files.get(both, "icc") == profile and files.get(both, "xmp") == packet
    broken = both.replace(profile[:1000], bytes(1000))
    assert files.get(broken, "icc") != profile
    with pytest.raises(containers.Malformed):
        files.put(JPEG, "exif", bytes(70_000))


def test_media_never_move():
    at = AVI.find(b"movi")
    data = AVI
    for fields in ({"INAM": "a"}, {"INAM": "a much longer title than before"}, {"ISFT": "x"}, {}):
        data = files.avi_set_info(data, fields)
        assert files.avi_info(data) == fields and data.find(b"movi") == at and struct.unpack_from("<I", data, 4)[0] == len(data) - 8
    place = BMFF.find(b"1234")
    data = BMFF
    for value in (b"one", b"a longer packet than before", b"x", None):
        data = files.put(data, "xmp", value)
        assert files.get(data, "xmp") == value and data.find(b"1234") == place


@settings(deadline=None, max_examples=100)
@given(st.sampled_from("<>"), st.dictionaries(st.tuples(st.sampled_from(["IFD0", "ExifIFD", "GPS", "Interop"]), st.integers(1, 50)), st.one_of(st.none(), st.binary(min_size=1, max_size=9)), max_size=8))
def test_amended_blocks_hold_what_was_set(order, changes):
    base = [E("IFD0", 60, 2, b"stays here\0"), E("ExifIFD", 61, 3, [5]), E("IFD1", 62, 4, [7]), E("IFD0", 1, 2, b"may go away\0")]
    out = tiff.amend(tiff.write(base, order), {k: None if v is None else (7, v) for k, v in changes.items()})
    want = {(e.ifd, e.tag): e.values for e in base} | {k: v for k, v in changes.items() if v is not None}
    want = {k: v for k, v in want.items() if not (k in changes and changes[k] is None)}
    found, warnings = tiff.read(out)
    assert {(e.ifd, e.tag): e.values for e in found if e.tag not in tiff.SUB_IFDS} == want and not warnings
    if changes.get(("IFD0", 1), b"") is None:
        assert b"may go away" not in out


def test_blocks_read_by_place_equal_blocks_read_whole():
    data = tiff.write([E("IFD0", 271, 2, b"maker\0"), E("ExifIFD", 33434, 5, [(1, 125)]), E("GPS", 1, 2, b"N\0"), E("IFD1", 256, 4, [5])], ">")
    reads = []
    found, warnings = tiff.scan(lambda a, n: reads.append(n) or data[a : a + n], len(data))
    assert found == tiff.read(data)[0] and not warnings
    assert tiff.scan(lambda a, n: data[a : a + n], len(data), 4)[1]


@settings(deadline=None, max_examples=60)
@given(st.sampled_from(list(FILES)), st.data())
def test_broken_files_raise_only_what_readers_expect(kind, data):
    raw = bytearray(FILES[kind])
    for _ in range(data.draw(st.integers(1, 4))):
        raw[data.draw(st.integers(0, len(raw) - 1))] = data.draw(st.integers(0, 255))
    raw = bytes(raw[: data.draw(st.integers(1, len(raw)))])
    for run in (lambda: files.size(raw), lambda: [files.get(raw, c) for c in files.CARRIERS], lambda: meta.scrub(raw), lambda: meta.problems(raw), lambda: files.trailing(raw)):
        try:
            run()
        except media.ERRORS:
            pass


def test_info_is_written_to_all_carriers_and_scrubbed_from_all():
    fields = {"title": "Ein Titel", "author": "A. Writer", "keywords": ["a", "b"], "caption": "cap", "date": "2024-05-06", "urgency": "3", "copyrightstatus": "Copyrighted Work", "ownerurl": "http://x", "jobname": "job", "city": "Bern"}
    data = meta.apply_info(JPEG, fields)
    assert meta.info(data) == fields
    mended, count = meta.conform(data)
    assert count and {p[2] for p in meta.problems(mended)} == {meta.INVENTED}
    bare, removed = meta.scrub(mended)
    assert all(x.encode() not in bare for x in ("Writer", "Bern", "Titel", "http://x")) and set(removed) == {"exif", "xmp", "irb", "format"}
    assert meta.info(bare) == {"urgency": "3", "jobname": "job"} or set(meta.info(bare)) <= {"urgency", "jobname"}
    assert meta.scrub(bare)[1] == {}
    with pytest.raises(ValueError):
        meta.apply_info(JPEG, {"date": "yesterday"})
    with pytest.raises(ValueError):
        meta.apply_info(JPEG, {"colour": "red"})


@settings(deadline=None, max_examples=60)
@given(st.integers(1, 300), st.integers(1, 6), st.floats(0, 1), st.integers(1, 4), st.randoms())
def test_fax_round_trips(columns, rows, share, mode, rng):
    bits = np.array([[rng.random() < share for _ in range(columns)] for _ in range(rows)], np.uint8)
    data = np.packbits(bits, axis=1).tobytes()
    assert fax.decode(fax.encode(data, columns, mode), columns, mode, rows if mode == 1 else None) == data


def test_fax_codes_are_prefix_free_and_small():
    for table in fax.CODES:
        assert len(table) == 104 and not any(a != b and b.startswith(a) for a in table.values() for b in table.values())
    page = bytes(216 * 1000)
    assert len(fax.encode(page, 1728)) < len(page) / 50


@pytest.mark.parametrize("compression", [1, 5, 8, 32773, 32946])
@pytest.mark.parametrize("predictor", [False, True])
def test_tiff_rasters(compression, predictor):
    image = np.random.default_rng(0).integers(0, 256, (37, 29, 3)).astype(np.uint8)
    for order in "<>":
        assert (raster.tiff_rgb(raster.tiff_encode(image, compression, 8, order, predictor)) == image).all()
        assert (raster.tiff_rgb(raster.tiff_encode(image[..., 0], compression, 8, order, predictor))[..., 1] == image[..., 0]).all()


def test_other_rasters():
    rng = np.random.default_rng(0)
    image = rng.integers(0, 256, (37, 29, 3)).astype(np.uint8)
    few = (image // 100 * 100).astype(np.uint8)
    ink = (image[..., 0] > 128) * np.uint8(255)
    for compression in (2, 3, 4):
        assert (raster.tiff_rgb(raster.tiff_encode(ink, compression, 8))[..., 0] == ink).all()
    assert (raster.png_rgb(raster.png_encode(image)) == image).all()
    first, second = raster.gif_images(raster.gif_encode([few, few[::-1]]))
    assert (first == few).all() and (second == few[::-1]).all()
    index, palette = raster.quantise(image, 16)
    assert len(palette) == 16 and np.abs(palette[index].astype(int) - image).mean() < 35
    caption = rng.random((128, 460)) < 0.3
    assert (raster.caption_read(raster.caption_write(caption)) == caption).all()
    numbers = rng.standard_normal((4, 5, 2)).astype(">f4").tobytes()
    assert raster.float_unpredict(raster.float_predict(numbers, 4, 10, 4, 2), 4, 10, 4, 2) == numbers
    with pytest.raises(containers.Malformed):
        raster.tiff_rgb(raster.tiff_encode(image), max_pixels=10)


@pytest.mark.parametrize("lace", [0, 1])
def test_png_filters_and_interlace(lace):
    image = np.random.default_rng(1).integers(0, 256, (37, 29, 3)).astype(np.uint8)

    def filtered(part):
        rows, above = [], np.zeros(part.shape[1] * 3, int)
        for y in range(len(part)):
            line = part[y].reshape(-1).astype(int)
            left, corner = np.concatenate([np.zeros(3, int), line[:-3]]), np.concatenate([np.zeros(3, int), above[:-3]])
            p = left + above - corner
            a, b, c = abs(p - left), abs(p - above), abs(p - corner)
            guess = [0 * line, left, above, (left + above) // 2, np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))][y % 5]
            rows.append(bytes([y % 5]) + ((line - guess) % 256).astype(np.uint8).tobytes())
            above = line
        return b"".join(rows)

    passes = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1)) if lace else ((0, 0, 1, 1),)
    body = zlib.compress(b"".join(filtered(image[a::c, b::d]) for a, b, c, d in passes))
    data = containers.png_write([P(0, -1, 0, "", "IHDR", 0, struct.pack(">IIBBBBB", 29, 37, 8, 2, 0, 0, lace)), P(0, -1, 0, "", "IDAT", 0, body), P(0, -1, 0, "", "IEND", 0, b"")])
    assert (raster.png_rgb(data) == image).all()


def test_profiles():
    srgb = [[0.4361, 0.3851, 0.1431], [0.2225, 0.7169, 0.0606], [0.0139, 0.0971, 0.7141]]
    wide = [[0.6097, 0.2053, 0.1492], [0.3111, 0.6257, 0.0632], [0.0195, 0.0609, 0.7446]]
    a, b = icc.matrix_profile(srgb, 2.2), icc.matrix_profile(wide, 2.2)
    assert icc.Transform(a, a).identity and not icc.Transform(a, b).identity
    pixels = np.random.default_rng(0).integers(40, 256, (500, 3)).astype(np.uint8)
    assert np.abs(icc.Transform(b, a)(icc.Transform(a, b)(pixels)).astype(int) - pixels).max() <= 4
    assert not icc.supported(a, b"x" * 200) and icc.invert(np.ones((3, 3))) is None
    assert icc.curve(b"curv" + bytes(4) + struct.pack(">I", 9)) is None


def test_texts():
    assert text.coded_read(text.coded_write("日本", "JIS")) == "日本" and text.coded_read(text.coded_write("ü")) == "ü"
    assert text.mluc_text(text.mluc_read(text.mluc_write({"de": "a", "en-GB": "b"}))) == "b"
    assert text.cut_utf8("aü", 2) == b"a" and text.iptc_date("5 May 2024") == "20240505" and text.iptc_time("23:05") == "230500+0000"
    with pytest.raises(ValueError):
        text.iptc_date("no date")
    rng = random.Random(1)
    for _ in range(300):
        value = struct.unpack("<f", rng.randbytes(4))[0]
        if value == value and abs(value) != float("inf"):
            assert np.float32(float(text.float_text(value))) == np.float32(value)


def test_saving_replaces_whole_files(tmp_path):
    path = tmp_path / "a.jpg"
    path.write_bytes(JPEG)

    def fails():
        yield b"half"
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        ranges.save_bytes(str(path), fails())
    assert path.read_bytes() == JPEG and [p.name for p in tmp_path.iterdir()] == ["a.jpg"]
    ranges.streamed(str(path), str(path), {"comment": b"new"})
    assert files.get(path.read_bytes(), "comment") == b"new" and files.trailing(path.read_bytes()) == b"TRAIL"


def test_failing_kernels_give_rows_with_errors(spark):
    rows = spark.createDataFrame([("a", bytearray(b"\xff\xff")), ("b", None)], "path string, content binary")
    from tessera.kernels.codecs import Lzw

    out = {r.path: r for r in media.convert(rows, "content", Lzw.decode, "x", error="why").collect()}
    assert out["a"].x is None and "not known" in out["a"].why and out["b"].why is None
