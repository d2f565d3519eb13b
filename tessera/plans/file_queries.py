"""Registered queries over whole files: changes, projections, conformance and private data.

The SQL beside a query builds the expected bytes or values from the tables alone, in hexadecimal where bytes are compared.
"""

from __future__ import annotations

import hashlib
import struct

from pyspark.sql import functions as F

from tessera.dims import tags as dims
from tessera.kernels import carriers, containers, files, meta, notes, text, tiff, xmp
from tessera.operators import edits
from tessera.plans.queries import dealt, packed, query, t
from tessera.sources import media as M
from tessera.sources import sinks

P, E = containers.Part, tiff.Entry

# --- bytes in SQL


def lit(raw: bytes) -> str:
    return f"'{raw.hex().upper()}'"


def le(value: str, size: int) -> str:
    return "(" + " || ".join(f"printf('%02X', CAST(({value}) >> {8 * i} & 255 AS INTEGER))" for i in range(size)) + ")"


def be(value: str, size: int) -> str:
    return "(" + " || ".join(f"printf('%02X', CAST(({value}) >> {8 * i} & 255 AS INTEGER))" for i in reversed(range(size))) + ")"


def crc(hexed: str) -> str:
    """CRC-32 of bytes given in hexadecimal, by its definition."""
    step = "lambda c, z: xor(c >> 1, 3988292384 * (c & 1))"
    data = f"list_transform(range(0, length({hexed}) // 2), lambda i: CAST('0x' || substr({hexed}, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {data}), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]), {step})), 4294967295)"


def long_key(rows, name: str, *columns):
    return rows.select(F.col("path").cast("long").alias(name), *columns)


def digest(rows, name: str):
    return long_key(rows, name, F.md5("content").alias("file_md5"), F.octet_length("content").cast("long").alias("bytes"))


def md5_of(hexed: str) -> str:
    return f"md5(unhex({hexed})) AS file_md5, length({hexed}) // 2 AS bytes"


# --- small files

JFIF = b"JFIF\0\1\2\1\0\x48\0\x48\0\0"
SOF = b"\x08\0\x05\0\x06\x03"
SCAN = b"\xff\xda\0\2\1\2\xff\0\3\xff\xd9"


def jpeg(*segments: tuple[int, bytes], tail: bytes = b"") -> bytes:
    return b"\xff\xd8" + b"".join(bytes([0xFF, m]) + struct.pack(">H", len(x) + 2) + x for m, x in ((0xE0, JFIF), *segments, (0xC0, SOF))) + SCAN + tail


def jpeg_sql(*segments: tuple[str, str], tail: str = "''") -> str:
    """The same in SQL; a segment is a marker and its payload in hexadecimal."""
    body = " || ".join(f"'FF{m}' || {be(f'length({x}) // 2 + 2', 2)} || {x}" for m, x in (("E0", lit(JFIF)), *segments, ("C0", lit(SOF))))
    return f"('FFD8' || {body} || {lit(SCAN)} || {tail})"


def png(*chunks: tuple[str, bytes]) -> bytes:
    return containers.png_write([P(0, -1, 0, "", k, 0, x) for k, x in (("IHDR", struct.pack(">IIBBBBB", 4, 3, 8, 2, 0, 0, 0)), *chunks, ("IDAT", b"pixels"), ("IEND", b""))])


def png_sql(*chunks: tuple[str, str]) -> str:
    rows = (("IHDR", lit(struct.pack(">IIBBBBB", 4, 3, 8, 2, 0, 0, 0))), *chunks, ("IDAT", lit(b"pixels")), ("IEND", "''"))
    body = " || ".join(f"{be(f'length({x}) // 2', 4)} || {lit(k.encode())} || {x} || {be(crc(f'({lit(k.encode())} || {x})'), 4)}" for k, x in rows)
    return f"({lit(containers.PNG_MARK)} || {body})"


GIF_HEAD = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0, 0, 0)
GIF_FRAME = b"\x2c" + struct.pack("<HHHHB", 0, 0, 2, 2, 0) + b"\x02\x02\x44\x01\0"


def framed_sql(hexed: str) -> str:
    """Bytes, at most 510 of them, in sub-blocks of 255."""
    n = f"length({hexed}) // 2"
    return f"(CASE WHEN {n} = 0 THEN '00' WHEN {n} < 256 THEN printf('%02X', CAST({n} AS INTEGER)) || {hexed} || '00' ELSE 'FF' || substr({hexed}, 1, 510) || printf('%02X', CAST({n} - 255 AS INTEGER)) || substr({hexed}, 511) || '00' END)"


def riff_sql(form: str, *chunks: tuple[str, str]) -> str:
    pad = lambda x: f"CASE WHEN length({x}) % 4 = 2 THEN '00' ELSE '' END"
    body = " || ".join(f"{lit(k.encode())} || {le(f'length({x}) // 2', 4)} || {x} || {pad(x)}" for k, x in chunks)
    inner = f"({lit(form.encode())} || {body})"
    return f"({lit(b'RIFF')} || {le(f'length({inner}) // 2', 4)} || {inner})"


def box_sql(kind: str, hexed: str) -> str:
    return f"({be(f'length({hexed}) // 2 + 8', 4)} || {lit(kind.encode())} || {hexed})"


# --- writers of carriers


@query("upd_13_jpeg_comment", f"SELECT p_partkey, {md5_of(jpeg_sql(('FE', 'hex(p_name)')))} FROM part")
def upd_13(spark, d):
    """The comment is replaced and what trails is taken off."""
    base = packed(t(spark, d, "part"), "p_partkey", ["p_brand"], lambda b: jpeg((0xFE, b.encode()), tail=b"trailing"))
    rows = base.join(t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), F.col("p_name").cast("binary").alias("v")), "path")
    return digest(M.convert(edits.with_carrier(rows, "comment", "v"), "content", files.without_trailing, "content"), "p_partkey")


_ICC = "repeat(hex(p_name), 9000)"


@query("snk_05_jpeg_splitting", f"""
    WITH x AS (SELECT p_partkey, {_ICC} AS v FROM part WHERE p_partkey % 50 = 0), n AS (SELECT *, (length(v) // 2 + 65518) // 65519 AS k FROM x)
    SELECT p_partkey, i + 1 AS seq, md5(unhex({lit(files.ICC_HEAD)} || printf('%02X%02X', CAST(i + 1 AS INTEGER), CAST(k AS INTEGER)) || substr(v, CAST(i * 131038 + 1 AS BIGINT), 131038))) AS payload_md5 FROM n, range(0, 9) AS r(i) WHERE i < k""")
def snk_05(spark, d):
    """A profile over several segments, each with its number and their count; every fiftieth part has one of so many bytes."""
    rows = t(spark, d, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").cast("string").alias("path"), F.lit(jpeg()).alias("content"), F.repeat("p_name", 9000).cast("binary").alias("v"))
    parts = M.parts(edits.with_carrier(rows, "icc", "v")).where("kind = 'icc'")
    return long_key(parts, "p_partkey", F.col("seq").cast("long").alias("seq"), F.md5("payload").alias("payload_md5"))


@query("snk_12_exif_segment", f"SELECT o_custkey, {md5_of(jpeg_sql(('E1', '(' + lit(files.EXIF_HEAD) + ' || ' + lit(b'II*' + bytes(1) + struct.pack('<IHHHII', 8, 1, 256, 4, 1, 0)[:-4]) + ' || ' + le('o_custkey', 4) + chr(32) + '|| ' + lit(bytes(4)) + ')')))} FROM (SELECT DISTINCT o_custkey FROM orders)")
def snk_12(spark, d):
    """A TIFF block of one entry in its segment, byte by byte."""
    keys = t(spark, d, "orders").select("o_custkey").distinct()
    rows = packed(keys, "o_custkey", ["o_custkey"], lambda k: tiff.write([E("IFD0", 256, 4, [k])]))
    return digest(edits.with_carrier(rows.select("path", F.lit(jpeg()).alias("content"), F.col("content").alias("v")), "exif", "v"), "o_custkey")


@query("snk_04_jpeg_compose", f"SELECT p_partkey, {md5_of(jpeg_sql(('E1', '(' + lit(files.XMP_HEAD) + ' || hex(p_name))'), ('FE', 'hex(p_brand)')))} FROM part")
def snk_04(spark, d):
    """Parts of which one is dropped, put together again."""
    made = packed(t(spark, d, "part"), "p_partkey", ["p_name", "p_brand"], lambda n, b: jpeg((0xE1, files.XMP_HEAD + n.encode()), (0xE2, b"gone"), (0xFE, b.encode())))
    return digest(sinks.compose(M.parts(made).where("type <> 'E2'"), "jpeg"), "p_partkey")


@query("snk_06_png_compose", f"SELECT s_suppkey, {md5_of(png_sql(('tEXt', '(' + lit(b'Title' + bytes(1)) + ' || hex(s_name))')))} FROM supplier")
def snk_06(spark, d):
    """Chunks with their checksums, by the definition of CRC-32 in SQL."""
    made = packed(t(spark, d, "supplier"), "s_suppkey", ["s_name"], lambda n: png(("tEXt", b"Title\0" + n.encode()), ("tEXt", b"Gone\0x")))
    return digest(sinks.compose(M.parts(made).where("NOT (type = 'tEXt' AND startswith(payload, cast('Gone' AS binary)))"), "png"), "s_suppkey")


@query("snk_07_riff_compose", f"SELECT c_custkey, {md5_of(riff_sql('AVI ', ('LIST', '(' + lit(b'INFOINAM') + ' || ' + le('length(c_name) + 1', 4) + " || hex(c_name) || '00' || CASE WHEN length(c_name) % 2 = 0 THEN '00' ELSE '' END)"), ('idx1', lit(bytes(16)))))} FROM customer")
def snk_07(spark, d):
    made = packed(t(spark, d, "customer"), "c_custkey", ["c_name"], lambda n: containers.riff_write("AVI ", [P(0, -1, 0, "list", "INFO", 0, b""), P(1, 0, 1, "chunk", "INAM", 0, n.encode() + b"\0"), P(2, -1, 0, "chunk", "JUNK", 0, b"gone"), P(3, -1, 0, "chunk", "idx1", 0, bytes(16))]))
    return digest(sinks.compose(M.parts(made).where("type <> 'JUNK'"), "avi"), "c_custkey")


@query("snk_09_box_compose", f"SELECT p_partkey, {md5_of('(' + box_sql('ftyp', lit(b'isom' + bytes(4))) + ' || ' + box_sql('moov', box_sql('udta', box_sql('name', 'hex(p_name)'))) + ')')} FROM part")
def snk_09(spark, d):
    made = packed(t(spark, d, "part"), "p_partkey", ["p_name"], lambda n: containers.box_write([P(0, -1, 0, "box", "ftyp", 0, b"isom" + bytes(4)), P(1, -1, 0, "container", "moov", 0, b""), P(2, 1, 1, "container", "udta", 0, b""), P(3, 2, 2, "box", "name", 0, n.encode()), P(4, 1, 1, "box", "gone", 0, b"x")]))
    return digest(sinks.compose(M.parts(made).where("type <> 'gone'"), "bmff"), "p_partkey")


_GIF_SQL = f"({lit(GIF_HEAD)} || '21FF0B' || {lit(files.GIF_LOOP)} || '0301' || {le('p_partkey % 900', 2)} || '00' || '21FE' || {framed_sql('hex(p_name)')} || {lit(GIF_FRAME)} || '3B')"


@query("snk_08_gif_compose", f"SELECT p_partkey, {md5_of(_GIF_SQL)} FROM part")
def snk_08(spark, d):
    """Blocks with their framing: a frame is taken out, everything else keeps its bytes."""

    def make(k, n):
        return GIF_HEAD + files.gif_extension("loop", b"\1" + struct.pack("<H", k % 900)) + files.gif_extension("comment", n.encode()) + GIF_FRAME + GIF_FRAME[:-2] + b"\x02\0" + b"\x3b"

    def without_last(content):
        head, rows, tail = files.gif_blocks(content)
        return files.gif_join(head, rows[:-1], tail)

    return digest(M.convert(packed(t(spark, d, "part"), "p_partkey", ["p_partkey", "p_name"], make), "content", without_last, "content"), "p_partkey")


@query("upd_09_gif_edits", f"SELECT p_partkey, {md5_of('(' + lit(GIF_HEAD) + ' || ' + repr('21FF0B') + ' || ' + lit(files.GIF_XMP) + ' || hex(p_name) || ' + lit(files.GIF_TRAILER) + ' || ' + repr('21FE') + ' || ' + framed_sql('hex(p_brand)') + ' || ' + lit(GIF_FRAME) + ' || ' + repr('3B') + ')')} FROM part")
def upd_09(spark, d):
    """A comment replaced, a packet and a profile added, the profile removed again; version 87a becomes 89a."""
    base = GIF_HEAD.replace(b"89a", b"87a") + b"\x21\xfe\x03old\0" + GIF_FRAME + b"\x3b"
    rows = t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), F.lit(base).alias("content"), F.col("p_brand").cast("binary").alias("c"), F.col("p_name").cast("binary").alias("x"))
    own = rows.select("path", "c", "x")
    one = edits.with_carrier(rows, "comment", "c").drop("error").join(own, "path")
    two = edits.with_carrier(one, "xmp", "x").drop("error").join(own, "path")
    three = edits.with_carrier(edits.with_carrier(two, "icc", "c"), "icc", None)
    # the packet is put before the first frame, the comment keeps its place
    return digest(M.convert(three, "content", _packet_first, "content"), "p_partkey")


def _packet_first(content: bytes) -> bytes:
    head, rows, tail = files.gif_blocks(content)
    return files.gif_join(head, sorted(rows, key=lambda r: r[0] != files.GIF_XMP.decode()), tail)


@query("upd_04_webp_flags", f"SELECT p_partkey, {md5_of(riff_sql('WEBP', ('VP8X', '(' + repr('0C000000') + ' || ' + le('p_partkey % 16000', 3) + ' || ' + le('p_size', 3) + ')'), ('VP8L', '(' + repr('2F') + ' || ' + le('p_partkey % 16000 + (p_size << 14)', 4) + ')'), ('EXIF', 'hex(p_name)'), ('XMP ', 'hex(p_brand)')))} FROM part")
def upd_04(spark, d):
    """A simple file becomes an extended one with its size, and flags follow the chunks that are put and removed."""
    make = lambda k, s: containers.riff_write("WEBP", [P(0, -1, 0, "chunk", "VP8L", 0, b"\x2f" + struct.pack("<I", k % 16000 + (s << 14)))])
    base = packed(t(spark, d, "part"), "p_partkey", ["p_partkey", "p_size"], make)
    own = t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), F.col("p_name").cast("binary").alias("n"), F.col("p_brand").cast("binary").alias("b"))
    rows = base.join(own, "path")
    for carrier, column in (("exif", "n"), ("icc", "n"), ("xmp", "b"), ("icc", None)):
        rows = edits.with_carrier(rows, carrier, column).drop("error").join(own, "path")
    return digest(rows, "p_partkey")


_FTYP = box_sql("ftyp", lit(b"isom" + bytes(4)))
_MEDIA = struct.pack(">I4s", 16, b"ftyp") + b"isom" + bytes(4)


@query("upd_05_bmff_boxes", f"SELECT p_partkey, {md5_of('(' + _FTYP + ' || ' + box_sql('free', lit(bytes(16 + 5))) + ' || ' + box_sql('mdat', 'hex(p_brand)') + ' || ' + box_sql('uuid', '(' + lit(files.XMP_UUID) + ' || hex(p_name) || ' + lit(b'-longer') + ')') + ')')} FROM part")
def upd_05(spark, d):
    """A packet that outgrows its box goes to the end, its old box becomes free space, and the media stay where they were."""
    base = packed(t(spark, d, "part"), "p_partkey", ["p_brand"], lambda b: _MEDIA + struct.pack(">I4s", 29, b"uuid") + files.XMP_UUID + b"small" + struct.pack(">I4s", len(b) + 8, b"mdat") + b.encode())
    own = t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), F.concat("p_name", F.lit("-longer")).cast("binary").alias("v"))
    return digest(edits.with_carrier(base.join(own, "path"), "xmp", "v"), "p_partkey")


def _item_file(payload: bytes, kind: bytes = b"Exif", room: int = 0) -> bytes:
    """A HEIF file of one item that lies in mdat, with the offset and length in four bytes each."""
    box = lambda k, x: struct.pack(">I4s", len(x) + 8, k) + x
    infe = box(b"infe", b"\2\0\0\0" + struct.pack(">HH", 1, 0) + kind + b"name\0")
    build = lambda place: _MEDIA + box(b"meta", bytes(4) + box(b"hdlr", bytes(25)) + box(b"iinf", bytes(4) + struct.pack(">H", 1) + infe) + box(b"iloc", bytes(4) + b"\x44\x00" + struct.pack(">HHHH", 1, 1, 0, 1) + struct.pack(">II", place, len(payload))))
    return build(len(build(0)) + 8) + box(b"mdat", payload + bytes(room))


@query("prj_20_bmff_items", "SELECT p_partkey, 'isom' AS brand, 1 AS item_id, 'Exif' AS item_type, 'name' AS item_name, md5(p_name) AS data_md5 FROM part")
def prj_20(spark, d):
    """JON-01 over real boxes: item infos and locations by id, and the bytes of the item."""

    def run(content):
        item = files.bmff_items(content)[0]
        return files.bmff_brands(content)[0], item["id"], item["type"], item["name"], files.bmff_item_data(content, item)

    made = packed(t(spark, d, "part"), "p_partkey", ["p_name"], lambda n: _item_file(n.encode()))
    rows = M.mapped(made, ["content"], run, "brand string, item_id int, item_type string, item_name string, data binary")
    return long_key(rows, "p_partkey", "brand", "item_id", "item_type", "item_name", F.md5("data").alias("data_md5"))


@query("upd_05_item_data", "SELECT p_partkey, md5(p_name || p_name) AS data_md5, length(p_name) * 3 + 146 AS bytes, true AS zeroed FROM part")
def upd_05_items(spark, d):
    """Longer bytes for an item: a box at the end holds them, the location points there, the old place holds zeros."""

    def run(content, name):
        out = files.bmff_set_item(content, 1, name.encode() * 2)
        item = files.bmff_items(out)[0]
        at = content.find(name.encode())
        return files.bmff_item_data(out, item), len(out), out[at : at + len(name)] == bytes(len(name))

    made = packed(t(spark, d, "part"), "p_partkey", ["p_name"], lambda n: _item_file(n.encode(), b"mime"))
    rows = made.join(t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), "p_name"), "path")
    return long_key(M.mapped(rows, ["content", "p_name"], run, "data binary, bytes long, zeroed boolean"), "p_partkey", F.md5("data").alias("data_md5"), "bytes", "zeroed")


@query("upd_05_add_item", "SELECT p_partkey, md5(p_name) AS old_md5, md5(p_brand) AS new_md5, 'mime,Exif' AS types FROM part")
def upd_05_added(spark, d):
    """One more item: the meta box before the media grows, and the old item is still found."""

    def run(content, brand):
        out = files.put(content, "exif", brand.encode())
        items = files.bmff_items(out)
        return files.bmff_item_data(out, items[0]), files.get(out, "exif"), ",".join(i["type"] for i in items)

    made = packed(t(spark, d, "part"), "p_partkey", ["p_name"], lambda n: _item_file(n.encode(), b"mime"))
    rows = made.join(t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), "p_brand"), "path")
    out = M.mapped(rows, ["content", "p_brand"], run, "old binary, new binary, types string")
    return long_key(out, "p_partkey", F.md5("old").alias("old_md5"), F.md5("new").alias("new_md5"), "types")


_JXL = bytes.fromhex("ff0acb060013880200f000b5")


@query("upd_07_jxl_boxes", f"SELECT p_partkey, {md5_of('(' + lit(files.JXL_MARK) + ' || ' + box_sql('ftyp', lit(b'jxl ' + bytes(4) + b'jxl ')) + ' || ' + box_sql('xml ', 'hex(p_name)') + ' || ' + box_sql('Exif', '(' + repr('00000000') + ' || hex(p_brand))') + ' || ' + box_sql('jxlc', lit(_JXL)) + ')')}, 64 AS width, 48 AS height FROM part")
def upd_07(spark, d):
    """A bare codestream gets boxes; metadata come before the codestream, which keeps its bytes and size."""
    own = t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), F.col("p_name").cast("binary").alias("n"), F.col("p_brand").cast("binary").alias("b"))
    one = edits.with_carrier(own.withColumn("content", F.lit(_JXL)), "xmp", "n").drop("error").join(own, "path")
    two = edits.with_carrier(one, "exif", "b").drop("error")
    sized = M.mapped(two, ["content"], lambda x: files.size(x), "width int, height int", ["path", "content"])
    return long_key(sized, "p_partkey", F.md5("content").alias("file_md5"), F.octet_length("content").cast("long").alias("bytes"), "width", "height")


@query("agg_04_jxl_codestream", "SELECT p_partkey, md5(p_name || p_brand || p_type) AS code_md5 FROM part")
def agg_04(spark, d):
    """Pieces by their numbers, whose top bit marks the last one."""

    def make(n, b, y):
        rows = [(2, y, 0x80000000), (0, n, 0), (1, b, 0)]
        return files.JXL_MARK + b"".join(struct.pack(">I4sI", len(x) + 12, b"jxlp", i | top) + x.encode() for i, x, top in rows)

    made = packed(t(spark, d, "part"), "p_partkey", ["p_name", "p_brand", "p_type"], make)
    return long_key(M.convert(made, "content", files.jxl_codestream, "code"), "p_partkey", F.md5("code").alias("code_md5"))


_AVI = [P(0, -1, 0, "list", "hdrl", 0, b""), P(1, 0, 1, "chunk", "avih", 0, struct.pack("<14I", 40000, 0, 0, 0, 12, 0, 0, 0, 320, 240, 0, 0, 0, 0)), P(2, -1, 0, "chunk", "JUNK", 0, bytes(60)), P(3, -1, 0, "list", "movi", 0, b""), P(4, 3, 1, "chunk", "00dc", 0, b"x" * 64), P(5, -1, 0, "chunk", "idx1", 0, b"y" * 16)]


@query("upd_06_avi_info", "SELECT c_custkey, c_name AS title, CASE WHEN length(c_name) % 2 = 0 THEN length(c_name) + 1 ELSE length(c_name) END > 0 AS kept, 156 AS movi_at FROM customer")
def upd_06(spark, d):
    """INFO goes into padding or behind the index: the media's place, which the index counts from, does not change."""

    def run(content, name):
        out = files.avi_set_info(files.avi_set_info(content, {"INAM": "first", "ISFT": "tool"}), {"INAM": name})
        return files.avi_info(out)["INAM"], len(files.avi_info(out)) == 1, out.find(b"movi") - 8

    made = packed(t(spark, d, "customer"), "c_custkey", ["c_custkey"], lambda k: containers.riff_write("AVI ", _AVI))
    rows = made.join(t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("path"), "c_name"), "path")
    return long_key(M.mapped(rows, ["content", "c_name"], run, "title string, kept boolean, movi_at long"), "c_custkey", "title", "kept", "movi_at")


@query("upd_03_png_carriers", f"SELECT s_suppkey, {md5_of(png_sql(('eXIf', 'hex(s_name)'), ('iTXt', '(' + lit(files.XMP_KEYWORD + bytes(5)) + ' || hex(s_name))')))} FROM supplier")
def upd_03(spark, d):
    """EXIF and a packet before the pixels; a profile set and removed leaves nothing."""
    rows = t(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), F.lit(png()).alias("content"), F.col("s_name").cast("binary").alias("v"))
    own = rows.select("path", "v")
    for carrier, column in (("exif", "v"), ("icc", "v"), ("xmp", "v"), ("icc", None)):
        rows = edits.with_carrier(rows, carrier, column).drop("error").join(own, "path")
    return digest(rows, "s_suppkey")


_HOMES = {"jpeg": "exif xmp icc irb iptc comment jumbf", "png": "exif xmp icc irb iptc comment", "gif": "xmp icc comment", "webp": "exif xmp icc", "avi": "xmp", "jxl": "exif xmp jumbf", "bmff": "xmp"}


@query("upd_02_homes", "SELECT * FROM " + dims.values_sql([(k, c, c in own.split()) for k, own in _HOMES.items() for c in files.CARRIERS], "kind, carrier, home"))
def upd_02(spark, d):
    """Which container takes which carrier: the value comes back, or the setter says that it has no home."""
    bare = {"jpeg": jpeg(), "png": png(), "gif": GIF_HEAD + GIF_FRAME + b"\x3b", "webp": containers.riff_write("WEBP", [P(0, -1, 0, "chunk", "VP8L", 0, b"\x2f\0\0\0\0")]), "avi": containers.riff_write("AVI ", _AVI), "jxl": _JXL, "bmff": _MEDIA}
    values = {"icc": bytes(40), "irb": carriers.resources_write([(1005, "", b"12")]), "iptc": carriers.iptc_write([(2, 25, b"k")]), "jumbf": notes.jumbf_json("a", "{}")}
    rows = [(k, c, bytearray(x), bytearray(values.get(c, b"value"))) for k, x in bare.items() for c in files.CARRIERS]

    def run(content, carrier, value):
        try:
            return (files.get(files.put(content, carrier, value), carrier) == value,)
        except files.NoHome:
            return (False,)

    made = spark.createDataFrame(rows, "kind string, carrier string, content binary, value binary")
    return M.mapped(made, ["content", "carrier", "value"], run, "home boolean", ["kind", "carrier"]).drop("error")


@query("upd_01_exif_set", "SELECT p_partkey, p_name AS make, CAST(p_size AS BIGINT) AS orientation, p_retailprice AS f_number, NULL AS model, true AS known, false AS unknown FROM part")
def upd_01(spark, d):
    """Texts, whole numbers and others by name, one removed, and a name that there is not."""
    base = jpeg((0xE1, files.EXIF_HEAD + tiff.write([E("IFD0", 272, 2, b"old model\0")])))
    rows = t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), F.lit(base).alias("content"), F.struct(F.col("p_name").alias("make"), F.col("p_size").alias("Orientation"), F.col("p_retailprice").alias("FNumber"), F.lit(None).cast("string").alias("Model"), F.lit("x").alias("NoSuchName")).alias("f"))
    made = edits.with_exif(rows, "f")
    value = lambda n: lambda x: meta.exif_value(files.get(x, "exif"), n)
    back = M.mapped(made, ["content"], lambda x: (value("Make")(x), value("Orientation")(x), float(value("FNumber")(x)), value("Model")(x)), "make string, orientation long, f_number double, model string", ["path", "known"])
    return long_key(back, "p_partkey", "make", "orientation", "f_number", F.col("model").cast("int").alias("model"), F.col("known")["FNumber"].alias("known"), F.col("known")["NoSuchName"].alias("unknown"))


@query("upd_08_tiff_merge", "SELECT p_partkey, CAST(p_size AS BIGINT) AS width, p_name AS make, NULL AS artist, md5(p_brand) AS packet_md5, true AS pixels_stay FROM part")
def upd_08(spark, d):
    """A TIFF file takes another EXIF block: its image tags and pixels stay, its other tags go, a packet is put beside."""

    def run(content, name, brand):
        other = tiff.write([E("IFD0", 271, 2, name.encode() + b"\0"), E("IFD0", 256, 4, [99999])])
        out = files.put(files.put(content, "exif", other), "xmp", brand.encode())
        by = {e.tag: e.values for e in tiff.read(out)[0]}
        return by[256][0], by[271].rstrip(b"\0").decode(), by.get(315), files.get(out, "xmp"), out[by[273][0] : by[273][0] + 6] == b"PIXELS"

    def make(size):
        entries = lambda at: [E("IFD0", 256, 4, [size]), E("IFD0", 273, 4, [at]), E("IFD0", 279, 4, [6]), E("IFD0", 315, 2, b"an old artist\0")]
        at = len(tiff.write(entries(0)))
        return tiff.write(entries(at)) + b"PIXELS"

    made = packed(t(spark, d, "part"), "p_partkey", ["p_size"], make)
    rows = made.join(t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), "p_name", "p_brand"), "path")
    out = M.mapped(rows, ["content", "p_name", "p_brand"], run, "width long, make string, artist binary, packet binary, pixels_stay boolean")
    return long_key(out, "p_partkey", "width", "make", F.col("artist").cast("string").cast("int").alias("artist"), F.md5("packet").alias("packet_md5"), "pixels_stay")


_NUMBER = crc("hex(left(s_name, 10) || '20240102')")


@query("upd_10_iptc_set", f"SELECT s_suppkey, left(s_name, 32) AS author, 'a|b' AS keywords, printf('%08d', CAST({_NUMBER} % 100000000 AS BIGINT)) AS envelope, '1#030,1#040,1#070,2#025,2#025,2#080,3#000' AS places FROM supplier")
def upd_10(spark, d):
    """Datasets by names and other names; the envelope's number follows its parts; new ones come before later records."""

    def run(name):
        sets = [(3, 0, b"\0\4")]
        for field, value in (("ServiceIdentifier", "old"), ("DateSent", "20240101"), ("Author", [name, "second", "third"]), ("Keywords", ["a", "b"]), ("ServiceIdentifier", name), ("2#070", "x"), ("DateSent", "2024-01-02"), ("ProgramVersion", None)):
            sets = meta.iptc_set(sets, field, value)
        sets = sorted((s for s in sets if s[:2] != (2, 80) or s[2] == name.encode()[:32]), key=lambda s: s[:2])
        by = {}
        for r, n, v in sets:
            by.setdefault((r, n), []).append(v.decode("latin-1"))
        return by[2, 80][0], "|".join(by[2, 25]), by[1, 40][0], ",".join(f"{r}#{n:03d}" for r, n, _ in sets)

    rows = t(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), "s_name")
    out = M.mapped(rows, ["s_name"], run, "author string, keywords string, envelope string, places string")
    return long_key(out, "s_suppkey", "author", "keywords", "envelope", "places")


@query("mth_14_envelope_number", f"SELECT s_suppkey, printf('%08d', CAST({crc(chr(104) + 'ex(s_name || CAST(20200000 + s_suppkey AS VARCHAR))')} % 100000000 AS BIGINT)) AS number FROM supplier")
def mth_14(spark, d):
    """crc32 of the service and the date, modulo 10**8, in eight digits."""
    value = F.crc32(F.concat("s_name", (F.col("s_suppkey") + 20200000).cast("string")).cast("binary")) % 100000000
    return t(spark, d, "supplier").select("s_suppkey", F.lpad(value.cast("string"), 8, "0").alias("number"))


@query("bin_04_crc32", f"SELECT p_partkey, CAST({crc('hex(p_name)')} AS BIGINT) AS crc, md5(p_name) AS digest FROM part")
def bin_04(spark, d):
    return t(spark, d, "part").select("p_partkey", F.crc32(F.col("p_name").cast("binary")).alias("crc"), F.md5(F.col("p_name").cast("binary")).alias("digest"))


@query("upd_11_upserts", "SELECT p_partkey, p_name AS replaced, p_brand AS added, '1005,1035' AS ids, p_type AS profile_text, 'desc,cprt' AS signatures FROM part")
def upd_11(spark, d):
    """Resources and profile tags set by their ids: replaced in place, added at the end, removed."""

    def run(name, brand, kind):
        rows = {1005: b"old", 1034: b"gone"}
        rows |= {1005: name.encode(), 1035: brand.encode()}
        del rows[1034]
        block = carriers.resources_write([(i, "", x) for i, x in rows.items()])
        back = {i: x.decode() for _, i, _, x in carriers.resources(block)}
        header = bytes(36) + b"acsp" + bytes(88)
        profile = carriers.icc_write(header, [("desc", b"text\0\0\0\0" + kind.encode() + b"\0"), ("cprt", b"text\0\0\0\0c\0")])
        own = {s: x for _, s, _, x in carriers.icc_tags(profile)}
        return back[1005], back[1035], ",".join(map(str, back)), own["desc"][8:-1].decode(), ",".join(own)

    rows = t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), "p_name", "p_brand", "p_type")
    return long_key(M.mapped(rows, ["p_name", "p_brand", "p_type"], run, "replaced string, added string, ids string, profile_text string, signatures string"), "p_partkey", "replaced", "added", "ids", "profile_text", "signatures")


# --- the merged view

_VIEW = ["title", "author", "caption", "keywords", "city", "date", "urgency", "copyrightstatus", "ownerurl", "jobname"]


def _viewed(spark, d):
    k = F.col("p_partkey")
    rows = t(spark, d, "part").select(
        k.cast("string").alias("path"),
        F.lit(jpeg((0xFE, b"kept"))).alias("content"),
        F.col("p_name").alias("title"),
        F.when(k % 2 == 0, F.col("p_brand")).alias("author"),
        F.concat("p_type", F.lit(" & <more>")).alias("caption"),
        F.array("p_brand", "p_type").alias("keywords"),
        F.concat(F.lit("Zürich "), F.col("p_size").cast("string")).alias("city"),
        F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (k % 1000).cast("int")), "yyyy-MM-dd").alias("date"),
        (k % 8 + 1).cast("string").alias("urgency"),
        F.get(F.array(F.lit("Copyrighted Work"), F.lit("Public Domain"), F.lit(None)), (k % 3).cast("int")).alias("copyrightstatus"),
        F.concat(F.lit("http://x/"), k.cast("string")).alias("ownerurl"),
        F.col("p_brand").alias("jobname"),
    )
    return edits.with_info(rows, _VIEW)


_VIEW_SQL = "p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS author, p_type || ' & <more>' AS caption, p_brand || '|' || p_type AS keywords, 'Zürich ' || p_size AS city, strftime(DATE '2020-01-01' + CAST(p_partkey % 1000 AS INTEGER), '%Y-%m-%d') AS date, CAST(p_partkey % 8 + 1 AS VARCHAR) AS urgency, ['Copyrighted Work', 'Public Domain', NULL][1 + p_partkey % 3] AS copyrightstatus, 'http://x/' || p_partkey AS ownerurl, p_brand AS jobname"


@query("prj_17_file_info", f"SELECT p_partkey, {_VIEW_SQL} FROM part")
def prj_17(spark, d):
    """What was written to four carriers, merged again."""
    return long_key(edits.info(_viewed(spark, d)), "p_partkey", *(F.array_join(c, "|").alias(c) if c == "keywords" else c for c in _VIEW))


@query("upd_12_info_fanout", "SELECT p_partkey, p_type || ' & <more>' AS exif_caption, p_type || ' & <more>' AS xmp_caption, left(p_type || ' & <more>', 2000) AS iptc_caption, 'Zürich ' || p_size AS iptc_city, ['1', '0', NULL][1 + p_partkey % 3] AS flag, 'kept' AS comment FROM part")
def upd_12(spark, d):
    """Each carrier by itself: the text stands in EXIF, XMP and IPTC, the flag in the resources, the comment stays."""

    def run(content):
        sets = {(r, n): v for r, n, v in meta.iptc_values(files.get(content, "iptc"))}
        flag = next((str(x[0]) for _, i, _, x in carriers.resources(files.get(content, "irb")) if i == 1034), None)
        return meta.exif_value(files.get(content, "exif"), "ImageDescription"), xmp.text_of(xmp.read(files.get(content, "xmp").decode())["dc:description"]), sets[2, 120], sets[2, 90], flag, files.get(content, "comment").decode()

    return long_key(M.mapped(_viewed(spark, d), ["content"], run, "exif_caption string, xmp_caption string, iptc_caption string, iptc_city string, flag string, comment string"), "p_partkey", "exif_caption", "xmp_caption", "iptc_caption", "iptc_city", "flag", "comment")


@query("agg_07_file_info", "SELECT p_partkey, 'xmp title' AS title, p_name AS caption, 'x|' || p_brand || '|i' AS keywords, CASE WHEN p_partkey % 2 = 0 THEN 'exif author' ELSE p_brand END AS author FROM part")
def agg_07(spark, d):
    """Precedence XMP, IPTC, resources, EXIF: the first text counts, lists are joined without repeats."""

    def make(k, name, brand):
        packet = xmp.write({"dc:title": {"x-default": "xmp title"}, "dc:description": {"x-default": " "}, "dc:subject": ["x", brand]}).encode()
        sets = [(2, 5, b"iptc title"), (2, 25, brand.encode()), (2, 25, b"i"), (2, 120, name.encode())] + ([(2, 80, brand.encode())] if k % 2 else [])
        data = files.put(jpeg(), "exif", meta.exif_set(None, {"Artist": "exif author", "ImageDescription": "exif caption"})[0])
        return files.put(files.put(data, "xmp", packet.replace(b"> <", b"><")), "iptc", carriers.iptc_write(sets))

    made = packed(t(spark, d, "part"), "p_partkey", ["p_partkey", "p_name", "p_brand"], make)
    return long_key(edits.info(made), "p_partkey", "title", "caption", F.array_join("keywords", "|").alias("keywords"), "author")


# --- private data


def _private_jpeg(k, name):
    e = tiff.write([E("IFD0", 271, 2, b"make\0"), E("IFD0", 315, 2, name.encode() + b"\0"), E("IFD0", 306, 2, b"2024:01:01 00:00:00\0"), E("IFD0", 305, 2, b"soft\0"), E("ExifIFD", 37500, 7, b"a note of the maker"), E("ExifIFD", 42033, 2, b"serial 1\0"), E("GPS", 1, 2, b"N\0"), E("Interop", 1, 2, b"R98\0"), E("IFD1", 259, 3, [6])])
    packet = xmp.write({"photoshop:City": name, "dc:creator": [name], "dc:title": {"x-default": name}, "tiff:Make": "m", "xmpMM:DocumentID": "d", "xmp:CreateDate": "2024", "xmp:CreatorTool": "s", "xmp:BaseURL": "stays"}).encode()
    sets = carriers.iptc_write([(2, 0, b"\0\4"), (2, 90, name.encode()), (2, 80, name.encode()), (2, 105, name.encode()), (2, 55, b"20240101"), (2, 65, b"soft"), (2, 185, b"id")])
    block = carriers.resources_write([(1028, "", sets), (1034, "", b"\1"), (1036, "", bytes(40)), (1005, "", b"stays")])
    data = jpeg((0xFE, name.encode()), tail=b"trailing")
    for carrier, value in (("exif", e), ("xmp", packet), ("irb", block)):
        data = files.put(data, carrier, value)
    return data


_SCRUBS = {"Location": (1, 1, 1, 1), "Author": (1, 1, 2, 1), "Description": (0, 1, 1, 2), "CameraModel": (1, 1, 0, 1), "SerialNumber": (1, 1, 1, 1), "Timestamp": (1, 1, 1, 1), "Software": (1, 1, 1, 1), "MakerNote": (1, 0, 0, 1), "Thumbnail": (1, 0, 1, 1), "Interoperability": (1, 0, 0, 1)}


@query("prv_02_carrier_scrubs", "SELECT s_suppkey, d.* FROM supplier, " + dims.values_sql([(f, *n) for f, n in _SCRUBS.items()], "flag, exif, xmp, irb, format") + " WHERE true")
def prv_02(spark, d):
    """One flag at a time, each over every carrier: how much went from each."""
    made = packed(t(spark, d, "supplier"), "s_suppkey", ["s_suppkey", "s_name"], _private_jpeg)
    rows = made.withColumn("flag", F.explode(F.array(*map(F.lit, _SCRUBS))))
    out = M.mapped(rows, ["content", "flag"], lambda x, f: (meta.scrub(x, dims.PRIVACY[f])[1],), "n map<string,int>", ["path", "flag"])
    count = lambda c: F.coalesce(F.col("n")[c], F.lit(0)).alias(c)
    return long_key(out, "s_suppkey", "flag", *map(count, ("exif", "xmp", "irb", "format")))


@query("prv_01_scrubbed_files", "SELECT s_suppkey, false AS name_left, 'IFD0:34665' AS tags, 'xmp:BaseURL' AS properties, '2#000' AS datasets, '1028,1005' AS resources, 0 AS trailing FROM supplier")
def prv_01(spark, d):
    """All flags: the files that come back hold none of what they held of a person, and the rest of them stays."""

    def run(content, name):
        out, _ = meta.scrub(content)
        tags = [f"{e.ifd}:{e.tag}" for e in tiff.read(files.get(out, "exif"))[0]]
        sets = [f"{r}#{n:03d}" for r, n, _ in meta.iptc_rows(files.get(out, "iptc"))]
        return name.encode() in out, ",".join(tags), ",".join(xmp.read(files.get(out, "xmp").decode())), ",".join(sets), ",".join(str(i) for _, i, _, _ in carriers.resources(files.get(out, "irb"))), len(files.trailing(out))

    made = packed(t(spark, d, "supplier"), "s_suppkey", ["s_suppkey", "s_name"], _private_jpeg)
    rows = made.join(t(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), "s_name"), "path")
    out = M.mapped(rows, ["content", "s_name"], run, "name_left boolean, tags string, properties string, datasets string, resources string, trailing int")
    return long_key(out, "s_suppkey", "name_left", "tags", "properties", "datasets", "resources", "trailing")


_FORMATS = {"png": (1, 2, 4, 1, 1), "gif": (1, 1, 2, 1, 1), "avi": (2, 1, 1, 2, 1)}


@query("prv_03_format_scrubs", "SELECT s_suppkey, kind, flag, CASE WHEN kind = 'png' THEN CASE flag WHEN 'Author' THEN 1 WHEN 'Software' THEN 2 WHEN 'Timestamp' THEN 0 ELSE 4 END WHEN kind = 'gif' THEN CASE flag WHEN 'Description' THEN 3 ELSE 1 END ELSE CASE flag WHEN 'Timestamp' THEN 2 ELSE 1 END END AS removed FROM supplier, (VALUES ('png'), ('gif'), ('avi')) AS k(kind), (VALUES ('Author'), ('Description'), ('Software'), ('Timestamp')) AS f(flag)")
def prv_03(spark, d):
    """Text chunks by keyword (each is a description too), comments and trailing bytes, INFO fields and the digitizing date."""
    text_chunk = lambda k: ("tEXt", k.encode() + b"\0value")

    def make(kind, name):
        if kind == "png":
            return png(text_chunk("Author"), text_chunk("Software"), text_chunk("Source"), text_chunk(name[:20]), ("iTXt", files.XMP_KEYWORD + b"\0\0\0\0\0<x/>"))
        if kind == "gif":
            return GIF_HEAD + files.gif_extension("comment", name.encode()) * 2 + GIF_FRAME + b"\x3btail"
        return files.avi_set_info(containers.riff_write("AVI ", [*_AVI, P(9, -1, 0, "chunk", "IDIT", 0, b"2024")]), {"IART": name, "INAM": "n", "ISFT": "s", "ICRD": "2024", "IXXX": "stays"})

    rows = t(spark, d, "supplier").select("s_suppkey", "s_name", F.explode(F.array(*map(F.lit, _FORMATS))).alias("kind")).withColumn("flag", F.explode(F.array(*map(F.lit, ("Author", "Description", "Software", "Timestamp")))))
    out = M.mapped(rows, ["kind", "s_name", "flag"], lambda k, n, f: (meta.scrub(make(k, n), dims.PRIVACY[f])[1].get("format", 0),), "removed int", ["s_suppkey", "kind", "flag"])
    return out.drop("error")


# --- conformance


def _odd_jpeg(k, name):
    entries = [E("IFD0", 271, 2, b"m\0"), E("ExifIFD", 40961, 3, [1])] + ([E("IFD0", 531, 3, [1])] if k % 2 else [])
    sets = [(2, 25, name.encode())] + ([(2, 0, b"\0\4")] if k % 3 else []) + ([(3, 0, b"\0\4")] if k % 5 == 0 else [])
    packet = xmp.write({"dc:creator": name if k % 2 else [name], "xmp:Rating": "3"}).encode()
    return files.put(files.put(files.put(jpeg(), "exif", tiff.write(entries)), "xmp", packet), "iptc", carriers.iptc_write(sets))


_EXIF_DUE = ["ExifIFD:ExifVersion", "ExifIFD:ComponentsConfiguration", "ExifIFD:PixelXDimension", "ExifIFD:PixelYDimension"]
_PROBLEMS = f"""
    SELECT p_partkey, 'EXIF' AS carrier, 'IFD0:YCbCrPositioning' AS field, 2 AS category, 'required and missing' AS message FROM part WHERE p_partkey % 2 = 0
    UNION ALL SELECT p_partkey, 'EXIF', unnest({_EXIF_DUE}), 2, 'required and missing' FROM part
    UNION ALL SELECT p_partkey, 'XMP', 'dc:creator', 1, 'expected an rdf:Seq array' FROM part WHERE p_partkey % 2 = 1
    UNION ALL SELECT p_partkey, 'IPTC', unnest(['1#000', '1#020', '1#022']), 2, 'required and missing' FROM part
    UNION ALL SELECT p_partkey, 'IPTC', unnest(['1#030', '1#070', '1#040']), 4, 'required and missing' FROM part
    UNION ALL SELECT p_partkey, 'IPTC', '2#000', 2, 'required and missing' FROM part WHERE p_partkey % 3 = 0
    UNION ALL SELECT p_partkey, 'IPTC', '3#000', 8, 'a record version with no dataset in its record' FROM part WHERE p_partkey % 5 = 0"""


def _odd_files(spark, d):
    return packed(t(spark, d, "part"), "p_partkey", ["p_partkey", "p_name"], _odd_jpeg)


@query("cns_01_problems", _PROBLEMS)
def cns_01(spark, d):
    """Departures of EXIF, XMP and IPTC in one list, as CNS-03 to CNS-05 find them."""
    return long_key(edits.problems(_odd_files(spark, d)), "p_partkey", "carrier", "field", "category", "message")


@query("cns_02_conform", f"WITH p AS ({_PROBLEMS}) SELECT p_partkey, CAST(count(*) FILTER (WHERE category <> 4) AS INTEGER) AS mended, 3 AS left_over, 6 AS width, max(p_name) AS author FROM p JOIN part USING (p_partkey) GROUP BY p_partkey")
def cns_02(spark, d):
    """Safe repairs are made in the file; what would have to be invented is left; the pixels' size comes from the image."""
    made = edits.conformed(_odd_files(spark, d))

    def run(content):
        return len(meta.problems(content)), meta.exif_value(files.get(content, "exif"), "PixelXDimension"), xmp.list_of(xmp.read(files.get(content, "xmp").decode())["dc:creator"])[0]

    return long_key(M.mapped(made, ["content"], run, "left_over int, width int, author string", ["path", "mended"]), "p_partkey", "mended", "left_over", "width", "author")


@query("cns_04_iptc_rules", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 3 END AS invented, 3 AS required FROM part")
def cns_04(spark, d):
    """Invented values are filled in only when asked for, from what there is."""

    def run(k, name):
        sets = [(1, 30, name[:10].encode()), (1, 70, b"20240101"), (1, 40, meta.envelope_number(name[:10], "20240101").encode())] if k % 4 == 0 else []
        data = files.put(jpeg(), "iptc", carriers.iptc_write([*sets, (2, 0, b"\0\4"), (2, 25, b"k")]))
        return meta.conform(data, meta.INVENTED)[1], meta.conform(data, meta.REQUIRED)[1]

    rows = t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), "p_partkey", "p_name")
    return long_key(M.mapped(rows, ["p_partkey", "p_name"], run, "invented int, required int"), "p_partkey", "invented", "required")


@query("cns_03_exif_required", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'IFD0:YResolution' ELSE 'IFD0:IPTC-NAA,IFD0:YResolution' END AS fields, CASE WHEN p_partkey % 2 = 0 THEN '0232' ELSE '0300' END AS version FROM part")
def cns_03(spark, d):
    """TIFF files want resolutions, IPTC as LONGs, and a version that follows from the types in use."""

    def run(k):
        entries = [E("IFD0", 256, 4, [1]), E("IFD0", 273, 4, [8]), E("IFD0", 282, 5, [(72, 1)]), E("ExifIFD", 40960, 7, b"0100"), E("ExifIFD", 40961, 3, [1])] + ([E("IFD0", 33723, 7, b"iptc!"), E("IFD0", 315, 129, "ä".encode())] if k % 2 else [])
        found = [p[1] for p in meta.problems(tiff.write(entries)) if p[0] == "EXIF" and "ExifVersion" not in p[1]]
        out, _ = meta.conform(tiff.write(entries))
        return ",".join(sorted(found)), meta.exif_value(out, "ExifVersion").decode()

    rows = t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), "p_partkey")
    return long_key(M.mapped(rows, ["p_partkey"], run, "fields string, version string"), "p_partkey", "fields", "version")


@query("cns_06_resources", "SELECT p_partkey, 3 AS mended, md5(p_name) AS other_md5 FROM part")
def cns_06(spark, d):
    """The datasets inside Photoshop resources are mended there; other resources keep their bytes."""

    def run(name):
        block = carriers.resources_write([(1005, "", name.encode()), (1028, "", carriers.iptc_write([(2, 0, b"\0\4"), (2, 25, b"k")]))])
        out, n = meta.conform(files.put(jpeg(), "irb", block))
        return n, next(x for _, i, _, x in carriers.resources(files.get(out, "irb")) if i == 1005)

    rows = t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), "p_name")
    return long_key(M.mapped(rows, ["p_name"], run, "mended int, other binary"), "p_partkey", "mended", F.md5("other").alias("other_md5"))


# --- projections and filters


@query("prj_01_file_facts", "SELECT p_partkey, kind AS format, CASE kind WHEN 'jpeg' THEN 6 WHEN 'png' THEN 4 WHEN 'gif' THEN 2 ELSE CAST(1 + p_partkey % 16000 AS BIGINT) END AS width, CASE kind WHEN 'jpeg' THEN 'comment' WHEN 'gif' THEN 'comment' WHEN 'png' THEN 'exif' ELSE '' END AS carriers, CASE kind WHEN 'jpeg' THEN strlen(p_name) WHEN 'gif' THEN 4 ELSE 0 END AS trailing FROM part, (VALUES ('jpeg'), ('png'), ('gif'), ('webp')) AS k(kind)")
def prj_01(spark, d):
    """PRJ-01, PRJ-02, PRJ-19 and FLT-01: format, size, carriers and trailing bytes of four containers."""

    def make(k, name, kind):
        if kind == "jpeg":
            return jpeg((0xFE, b"c"), tail=name.encode())
        if kind == "png":
            return png(("eXIf", b"MM\0*\0\0\0\x08\0\0\0\0\0\0"))
        if kind == "gif":
            return GIF_HEAD + files.gif_extension("comment", name.encode()) + GIF_FRAME + b"\x3btail"
        return containers.riff_write("WEBP", [P(0, -1, 0, "chunk", "VP8L", 0, b"\x2f" + struct.pack("<I", k % 16000))])

    rows = t(spark, d, "part").select("p_partkey", "p_name", F.explode(F.array(*map(F.lit, ("jpeg", "png", "gif", "webp")))).alias("kind"))
    made = M.mapped(rows, ["p_partkey", "p_name", "kind"], lambda *x: (make(*x),), "content binary", ["p_partkey"])
    found = edits.facts(made.select(F.col("p_partkey").cast("string").alias("path"), "content"))
    return long_key(found, "p_partkey", "format", "width", F.array_join("carriers", ",").alias("carriers"), F.col("trailing"))


@query("prj_18_thumbnails", "SELECT p_partkey, md5(p_name) AS thumb_md5 FROM part")
def prj_18(spark, d):
    """The thumbnail of EXIF's second directory, else of the resources, else of JFIF."""

    def make(k, name):
        thumb = name.encode()
        if k % 3 == 0:
            at = len(tiff.write([E("IFD0", 271, 2, b"m\0"), E("IFD1", 513, 4, [0]), E("IFD1", 514, 4, [0])]))
            return files.put(jpeg(), "exif", tiff.write([E("IFD0", 271, 2, b"m\0"), E("IFD1", 513, 4, [at]), E("IFD1", 514, 4, [len(thumb)])]) + thumb)
        if k % 3 == 1:
            return files.put(jpeg(), "irb", carriers.resources_write([(1036, "", bytes(28) + thumb)]))
        return b"\xff\xd8\xff\xe0" + struct.pack(">H", 2 + 14 + 3 * ((len(thumb) + 2) // 3)) + JFIF[:12] + bytes([(len(thumb) + 2) // 3, 1]) + thumb + bytes(-len(thumb) % 3) + SCAN

    made = packed(t(spark, d, "part"), "p_partkey", ["p_partkey", "p_name"], make)
    rows = M.convert(made, "content", lambda x: files.thumbnail(x).rstrip(b"\0"), "thumb")
    return long_key(rows, "p_partkey", F.md5("thumb").alias("thumb_md5"))


@query("prj_19_ends", "SELECT p_partkey, p_name AS comment, CAST(p_partkey % 900 AS INTEGER) AS loops, md5(p_brand) AS tail_md5 FROM part")
def prj_19(spark, d):
    """A comment over segments, a loop count, and what follows the end of an image whose pixels hold stuffed bytes."""

    def run(k, name, brand):
        data = jpeg((0xFE, name.encode()[:3]), (0xFE, name.encode()[3:]), tail=brand.encode())
        gif = GIF_HEAD + files.gif_extension("loop", b"\1" + struct.pack("<H", k % 900)) + GIF_FRAME + b"\x3b"
        return files.get(data, "comment").decode(), files.gif_loop_count(gif), files.trailing(data)

    rows = t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), "p_partkey", "p_name", "p_brand")
    return long_key(M.mapped(rows, ["p_partkey", "p_name", "p_brand"], run, "comment string, loops int, tail binary"), "p_partkey", "comment", "loops", F.md5("tail").alias("tail_md5"))


_ORIENTED = [m for _, _, m in dims.EXIF_MEANINGS[:8]]


@query("prj_04_exif_texts", f"SELECT p_partkey, p_name AS make, coalesce({_ORIENTED}[1 + p_partkey % 10], 'Unknown (' || (1 + p_partkey % 10) || ')') AS orientation, '1/' || (p_size + 1) AS exposure, CASE WHEN p_size = 1 THEN '1/7' ELSE regexp_replace(regexp_replace(printf('%.4f', p_size / 7), '0+$', ''), '\\.$', '') END AS f_number, (p_partkey % 90) || '° ' || (p_size % 60) || ''' 30\"' AS latitude, 'Y Cb Cr -' AS components, p_brand AS comment, CAST(p_size AS VARCHAR) || ', 8' AS unnamed FROM part")
def prj_04(spark, d):
    """Text, meanings, quotients, coordinates, component letters, coded text and tags without a name."""

    def make(k, name, brand, size):
        return tiff.write([E("IFD0", 271, 2, name.encode() + b" \0"), E("IFD0", 274, 3, [1 + k % 10]), E("ExifIFD", 33434, 5, [(1, size + 1)]), E("ExifIFD", 33437, 5, [(size, 7)]), E("GPS", 2, 5, [(k % 90, 1), (size % 60, 1), (3000, 100)]), E("ExifIFD", 37121, 7, b"\1\2\3\0"), E("ExifIFD", 37510, 7, text.coded_write(brand, "UNICODE")), E("IFD0", 51234, 3, [size, 8])])

    made = edits.exif_texts(packed(t(spark, d, "part"), "p_partkey", ["p_partkey", "p_name", "p_brand", "p_size"], make))
    names = {"make": "Make", "orientation": "Orientation", "exposure": "ExposureTime", "f_number": "FNumber", "latitude": "GPSLatitude", "components": "ComponentsConfiguration", "comment": "UserComment", "unnamed": "Tag 0xC822"}
    return long_key(made, "p_partkey", *(F.col("texts")[n].alias(c) for c, n in names.items()))


@query("agg_15_tag_pivot", "SELECT p_partkey, 'Make=' || p_name || ';Tag 0x' || printf('%04X', CAST(50000 + p_partkey % 700 AS INTEGER)) || '=' || p_size AS pairs FROM part WHERE 50000 + p_partkey % 700 <> 50341 UNION ALL SELECT p_partkey, 'Make=' || p_name FROM part WHERE 50000 + p_partkey % 700 = 50341")
def agg_15(spark, d):
    """Names to texts of the tags that a block holds."""
    made = packed(t(spark, d, "part"), "p_partkey", ["p_partkey", "p_name", "p_size"], lambda k, n, s: tiff.write([E("IFD0", 271, 2, n.encode() + b"\0"), E("IFD0", 50000 + k % 700, 4, [s])]))
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("texts")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return long_key(edits.exif_texts(made), "p_partkey", pairs.alias("pairs"))


@query("prj_11_xmp_shortcuts", "SELECT p_partkey, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN p_type || ' fr' ELSE p_type END AS description_fr, p_brand || '|second' AS creators, 'k1|k2' AS keywords, NULL AS rights FROM part")
def prj_11(spark, d):
    """Title, description in a language, creators, keywords and rights of a packet."""

    def make(k, name, brand, kind):
        return xmp.write({"dc:title": {"x-default": name, "de": "anders"}, "dc:description": {"x-default": kind} | ({"fr-CA": kind + " fr"} if k % 2 == 0 else {}), "dc:creator": [brand, "second"], "dc:subject": ["k1", "k2"]}).encode()

    def run(packet):
        p = xmp.read(packet.decode())
        own = xmp.shortcuts(p)
        return own["title"], xmp.text_of(p["dc:description"], "fr"), "|".join(own["creators"]), "|".join(own["keywords"]), own["rights"]

    made = packed(t(spark, d, "part"), "p_partkey", ["p_partkey", "p_name", "p_brand", "p_type"], make)
    rows = M.mapped(made, ["content"], run, "title string, description_fr string, creators string, keywords string, rights string")
    return long_key(rows, "p_partkey", "title", "description_fr", "creators", "keywords", F.col("rights").cast("int").alias("rights"))


@query("nst_03_qualifiers", "SELECT p_partkey, p_name AS value, 'en' AS lang, p_brand AS role FROM part")
def nst_03(spark, d):
    """What stands beside rdf:value."""

    def make(name, brand):
        inner = f'<xmp:Label xml:lang="en"><rdf:Description><rdf:value>{name}</rdf:value><xmp:Nickname>{brand}</xmp:Nickname></rdf:Description></xmp:Label>'
        return f'<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="{xmp.RDF}"><rdf:Description rdf:about="" xmlns:xmp="{xmp.NAMESPACES["xmp"]}">{inner}</rdf:Description></rdf:RDF></x:xmpmeta>'.encode()

    def run(packet):
        told = packet.decode()
        own = xmp.qualifiers(told, "xmp:Label")
        return xmp.read(told)["xmp:Label"], own["xml:lang"], own["xmp:Nickname"]

    made = packed(t(spark, d, "part"), "p_partkey", ["p_name", "p_brand"], make)
    return long_key(M.mapped(made, ["content"], run, "value string, lang string, role string"), "p_partkey", "value", "lang", "role")


@query("agg_13_names", "SELECT DISTINCT unnest(['dc', 'xmp', 'photoshop']) AS prefix, unnest(['title', 'Rating', 'C' || p_size]) AS name FROM part")
def agg_13(spark, d):
    """Distinct namespaces and names of the properties that packets hold."""
    made = packed(t(spark, d, "part"), "p_partkey", ["p_size", "p_name"], lambda s, n: xmp.write({"dc:title": {"x-default": n}, "xmp:Rating": "1", f"photoshop:C{s}": n}).encode())
    rows = M._rows(made, "path string, name string, error string", lambda c: ((k,) for k in xmp.read(c.decode())))
    return rows.select(F.substring_index("name", ":", 1).alias("prefix"), F.substring_index("name", ":", -1).alias("name")).distinct()


@query("nst_05_written_values", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'True' ELSE 'False' END AS marked, 'Bag' AS subject_form, 'Seq' AS history_form, p_name AS field FROM part")
def nst_05(spark, d):
    """Booleans, lists in their declared forms and structures, written and read; namespaces by their prefixes (NST-04)."""

    def run(k, name):
        p = xmp.read(xmp.write({"xmpRights:Marked": k % 2 == 0, "dc:subject": [name], "xmpMM:History": [{"stEvt:action": name}], "Iptc4xmpCore:CreatorContactInfo": {"Iptc4xmpCore:CiAdrCity": name}}))
        return p["xmpRights:Marked"], p["dc:subject"]["form"], p["xmpMM:History"]["form"], p["Iptc4xmpCore:CreatorContactInfo"]["fields"]["Iptc4xmpCore:CiAdrCity"]

    rows = t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), "p_partkey", "p_name")
    return long_key(M.mapped(rows, ["p_partkey", "p_name"], run, "marked string, subject_form string, history_form string, field string"), "p_partkey", "marked", "subject_form", "history_form", "field")


@query("prj_12_resource_values", "SELECT p_partkey, p_size + 0.5 AS dpi, p_partkey % 2 = 1 AS copyrighted, 'http://' || p_brand AS url, CAST(p_partkey AS BIGINT) AS angle FROM part")
def prj_12(spark, d):
    """Resolutions as fixed-point numbers, flags, texts and integers, by built-in functions over exploded resources."""

    def make(k, size, brand):
        return carriers.resources_write([(1005, "", struct.pack(">IHHIHH", size * 65536 + 32768, 1, 1, 72 << 16, 1, 1)), (1034, "", bytes([k % 2])), (1035, "", b"http://" + brand.encode()), (1037, "", struct.pack(">I", k))])

    rows = M.resources(packed(t(spark, d, "part"), "p_partkey", ["p_partkey", "p_size", "p_brand"], make))
    number = lambda size: F.conv(F.hex(F.substring("data", 1, size)), 16, 10).cast("long")
    of = lambda i, v: F.max(F.when(F.col("id") == i, v))
    out = rows.groupBy("path").agg((of(1005, number(4)) / 65536).alias("dpi"), (of(1034, number(1)) == 1).alias("copyrighted"), of(1035, F.decode("data", "UTF-8")).alias("url"), of(1037, number(4)).alias("angle"))
    return long_key(out, "p_partkey", "dpi", "copyrighted", "url", "angle")


@query("agg_05_split_resources", "SELECT p_partkey, '1005,1035' AS ids, md5(repeat(p_name, 20000)) AS long_md5 FROM part WHERE p_partkey % 20 = 0")
def agg_05(spark, d):
    """Resources that run over several segments, joined in file order before they are read; each twentieth part has such long ones."""
    rows = t(spark, d, "part").where("p_partkey % 20 = 0")
    made = packed(rows, "p_partkey", ["p_name"], lambda n: files.put(jpeg(), "irb", carriers.resources_write([(1005, "", n.encode() * 20000), (1035, "", b"u")])))
    pieces = M.parts(made).where("kind = 'irb'").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", F.substring("payload", 15, 1 << 30).alias("x")))).alias("x"))
    whole = pieces.select("path", F.aggregate("x", F.lit(b""), lambda a, p: F.concat(a, p["x"])).alias("content"))
    found = M.resources(whole).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "id"))), lambda x: x["id"].cast("string")), ",").alias("ids"), F.max(F.when(F.col("id") == 1005, F.md5("data"))).alias("long_md5"))
    return long_key(found, "p_partkey", "ids", "long_md5")


@query("agg_02_extended_packets", "SELECT p_partkey, md5(repeat(p_name, 20000)) AS packet_md5, (length(p_name) * 20000 + 65457) // 65458 AS pieces FROM part WHERE p_partkey % 20 = 0")
def agg_02(spark, d):
    """A packet that does not fit: pieces by the digest that the short packet names, ordered by place, checked by length and digest."""
    rows = t(spark, d, "part").where("p_partkey % 20 = 0")
    made = packed(rows, "p_partkey", ["p_name"], lambda n: files.put(jpeg((0xE1, files.EXTENDED_HEAD + b"0" * 32 + bytes(8) + b"stray")), "xmp", n.encode() * 20000))
    pieces = M.parts(made, payload=False).where("kind = 'xmp-extended'").groupBy("path").agg(F.count("*").alias("pieces"))
    return long_key(edits.carrier(made, "xmp").join(pieces, "path"), "p_partkey", F.md5("value").alias("packet_md5"), "pieces")


@query("agg_03_box_fragments", "SELECT p_partkey, 'label' AS label, md5(repeat(p_name, 20000)) AS content_md5 FROM part")
def agg_03(spark, d):
    """A JUMBF box over several segments by its instance and their numbers; each repeats the box's header.  Every part's file, 0.2 MB
    or so, is made and read in one step, as all of them would be 20,000 times the names to move."""

    def run(name):
        made = files.put(jpeg(), "jumbf", notes.jumbf_xml("label", (name or "") * 20000))
        first = notes.jumbf_read(files.get(made, "jumbf"))[0]
        return first["label"], hashlib.md5(first["content"]).hexdigest() if name is not None else None

    return M.mapped(dealt(t(spark, d, "part")), ["p_name"], run, "label string, content_md5 string", ["p_partkey"]).drop("error")


@query("prj_21_jumbf", "SELECT p_partkey, unnest([0, 1, 2]) AS seq, unnest(['j', 'x', 'e']) AS label, unnest(['json', 'xml ', 'Exif']) AS type, md5(unnest(['{\"n\":\"' || p_name || '\"}', '<n/>', p_brand])) AS content_md5, unnest(['6A736F6E', '786D6C20', '45786966']) || '00110010800000AA00389B71' AS uuid FROM part")
def prj_21(spark, d):
    """NST-06: boxes of JSON, XML and EXIF built, and their labels, types and contents read."""
    made = packed(t(spark, d, "part"), "p_partkey", ["p_name", "p_brand"], lambda n, b: notes.jumbf_json("j", '{"n":"' + n + '"}') + notes.jumbf_xml("x", "<n/>") + notes.jumbf_exif("e", b.encode()))
    rows = M._rows(made, "path string, seq int, label string, type string, content binary, uuid string, error string", lambda c: ((i, b["label"], b["type"], b["content"], b["uuid"].upper()) for i, b in enumerate(notes.jumbf_read(c))))
    return long_key(rows, "p_partkey", "seq", "label", "type", F.md5("content").alias("content_md5"), "uuid")


@query("src_35_jumbf_description", "SELECT p_partkey, p_name AS label, p_partkey AS id, upper(sha256(p_brand)) AS signature FROM part")
def src_35(spark, d):
    made = packed(t(spark, d, "part"), "p_partkey", ["p_partkey", "p_name", "p_brand"], lambda k, n, b: notes.jumbf_description(b"json", n, k, hashlib.sha256(b.encode()).digest()))

    def run(x):
        own = carriers.jumbf_description(x)
        return own["label"], own["id"], own["signature"].upper()

    return long_key(M.mapped(made, ["content"], run, "label string, id long, signature string"), "p_partkey", "label", "id", "signature")


@query("prj_14_user_data", "SELECT p_partkey, p_name AS atom, p_brand AS tag, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_name END AS value FROM part")
def prj_14(spark, d):
    """QuickTime atoms and iTunes tags, and the one value of both: the tag counts before the atom."""
    mark = "\xa9nam".encode("latin-1")

    def make(k, name, brand):
        box = lambda x, y: struct.pack(">I4s", len(y) + 8, x) + y
        own = box(mark if k % 2 == 0 else b"\xa9xyz", box(b"data", struct.pack(">II", 1, 0) + brand.encode()))
        return _MEDIA + box(b"moov", box(b"udta", box(mark, struct.pack(">HH", len(name), 0) + name.encode()) + box(b"meta", bytes(4) + box(b"ilst", own))))

    def run(content):
        atoms, tags = files.bmff_user_data(content)
        return atoms["\xa9nam"], next(iter(tags.values())), tags.get("\xa9nam", atoms.get("\xa9nam"))

    made = packed(t(spark, d, "part"), "p_partkey", ["p_partkey", "p_name", "p_brand"], make)
    return long_key(M.mapped(made, ["content"], run, "atom string, tag string, value string"), "p_partkey", "atom", "tag", "value")


@query("prj_16_wave", "SELECT p_partkey, 11025 * (1 + p_partkey % 4) AS rate, 1 + p_partkey % 2 AS channels, CAST(p_size AS DOUBLE) / (2 * (1 + p_partkey % 2) * 11025 * (1 + p_partkey % 4)) AS seconds, p_name AS comment, printf('%02d:%02d:%02d.25', CAST(p_partkey // 3600 % 24 AS INTEGER), CAST(p_partkey // 60 % 60 AS INTEGER), CAST(p_partkey % 60 AS INTEGER)) AS recorded FROM part")
def prj_16(spark, d):
    """SRC-39, DAT-07: a WAVE file's format, length, and the attributes of its Exif list, with the time of recording."""
    make = lambda k, s, n: notes.wave_write(bytes(s), 1 + k % 2, 11025 * (1 + k % 4), 16, {"ever": "0220", "ecmt": n, "etim": text.recording_time(k + 0.25)})

    def run(content):
        w = notes.wave(content)
        return w["rate"], w["channels"], w["seconds"], w["attributes"]["ecmt"], w["attributes"]["etim"]

    made = packed(t(spark, d, "part"), "p_partkey", ["p_partkey", "p_size", "p_name"], make)
    return long_key(M.mapped(made, ["content"], run, "rate int, channels int, seconds double, comment string, recorded string"), "p_partkey", "rate", "channels", "seconds", "comment", "recorded")


@query("snk_17_small_carriers", f"SELECT p_partkey, md5(unhex({riff_sql('WAVE', ('fmt ', '(' + lit(struct.pack('<HHIIHH', 1, 1, 8000, 16000, 2, 16)) + ')'), ('data', 'hex(p_name)'))})) AS wave_md5, md5(unhex({lit(b'json' + notes.JUMBF_REST)} || '07' || hex(p_brand) || '00' || {be('p_partkey', 4)})) AS jumbf_md5 FROM part")
def snk_17(spark, d):
    """WAVE files and JUMBF descriptions as bytes."""
    rows = t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), "p_partkey", "p_name", "p_brand")
    made = M.mapped(rows, ["p_partkey", "p_name", "p_brand"], lambda k, n, b: (notes.wave_write(n.encode(), 1, 8000, 16), notes.jumbf_description(b"json", b, k)), "w binary, j binary")
    return long_key(made, "p_partkey", F.md5("w").alias("wave_md5"), F.md5("j").alias("jumbf_md5"))


# --- maker notes


def _ifd(rows, base: int, order: str) -> bytes:
    """A directory whose values follow it and are counted from base."""
    out, heap, start = struct.pack(order + "H", len(rows)), b"", base + 2 + 12 * len(rows) + 4
    for tag, kind, value in rows:
        count, body = tiff._packed(kind, value, order)
        raw = struct.pack(order + "I", start + len(heap)) if len(body) > 4 else body.ljust(4, b"\0")
        heap += body if len(body) > 4 else b""
        out += struct.pack(order + "HHI", tag, kind, count) + raw
    return out + bytes(4) + heap


def _noted(make: bytes, build, order: str = "<") -> bytes:
    """An EXIF block with a note of 200 bytes, which build() makes for the place it lies at."""
    base = tiff.write([E("IFD0", 271, 2, make + b"\0"), E("ExifIFD", 37500, 7, bytes(200))], order)
    at = next(e.offset for e in tiff.read(base)[0] if e.tag == 37500)
    return base[:at] + build(at).ljust(200, b"\0") + base[at + 200 :]


_MAKES = [("Canon", "Canon"), ("NIKON CORPORATION", "Nikon Type 3"), ("NIKON", "Fujifilm"), ("RICOH", "Ricoh Text"), ("SONY", "Sony"), ("Panasonic", "Panasonic"), ("OLYMPUS", "Olympus"), ("KYOCERA", "Kyocera"), ("CASIO", "Casio Type 1")]


def _maker_file(k: int, name: str) -> bytes:
    make, variant = _MAKES[k % len(_MAKES)]
    value = name.encode()[:30] + b"\0"
    rows = [(7, 2, value), (99, 3, [k % 60000])]
    build = {
        "Canon": lambda at: _ifd(rows, at, "<"),
        "Nikon Type 3": lambda at: b"Nikon\0\2\x10\0\0" + tiff.write([E("IFD0", 7, 2, value), E("IFD0", 99, 3, [k % 60000])], ">"),
        "Fujifilm": lambda at: b"FUJIFILM" + struct.pack("<I", 12) + _ifd(rows, 12, "<"),
        "Ricoh Text": lambda at: b"Rv" + value,
        "Sony": lambda at: b"SONY DSC \0\0\0" + _ifd(rows, at + 12, "<"),
        "Panasonic": lambda at: b"Panasonic\0\0\0" + _ifd(rows, at + 12, "<"),
        "Olympus": lambda at: b"OLYMP\0\1\0" + _ifd(rows, at + 8, "<"),
        "Kyocera": lambda at: b"KYOCERA \0\0\0".ljust(22, b"\0") + _ifd(rows, 22, "<"),
        "Casio Type 1": lambda at: _ifd(rows, at, ">"),
    }[variant]
    return _noted(make.encode(), build)


@query("src_42_maker_notes", f"SELECT p_partkey, {[v for _, v in _MAKES]}[1 + p_partkey % 9] AS variant, CASE WHEN p_partkey % 9 = 3 THEN 'Rv' || left(p_name, 30) ELSE left(p_name, 30) END AS value, CASE WHEN p_partkey % 9 <> 3 THEN CAST(p_partkey % 60000 AS VARCHAR) END AS number, CASE p_partkey % 9 WHEN 0 THEN 'Firmware Version' WHEN 8 THEN 'White Balance' WHEN 3 THEN NULL ELSE 'Tag 0x0007' END AS name FROM part")
def src_42(spark, d):
    """SRC-25, JON-11, PRJ-13: the variant by make and first bytes, and the note's directory wherever it lies."""

    def run(block):
        n = notes.note_of(block)
        if n.text is not None:
            return n.variant, n.text, None, None
        names = list(n.values())
        return n.variant, n.values()[names[0]], n.values()["Tag 0x0063"], names[0]

    made = packed(t(spark, d, "part"), "p_partkey", ["p_partkey", "p_name"], _maker_file)
    return long_key(M.mapped(made, ["content"], run, "variant string, value string, number string, name string"), "p_partkey", "variant", "value", "number", "name")


@query("prj_13_custom_functions", "SELECT p_partkey, CAST(p_size AS INTEGER) AS first, CAST(p_partkey % 200 AS INTEGER) AS second, md5(unhex('FFD8' || hex(p_brand))) AS thumb_md5 FROM part")
def prj_13(spark, d):
    """Settings whose high byte is a function and whose low byte its value, and a picture whose first byte is struck out."""

    def run(k, size, brand):
        canon = notes.note_of(_noted(b"Canon", lambda at: _ifd([(15, 3, [6, 1 << 8 | size, 2 << 8 | k % 200])], at, "<")))
        other = notes.note_of(_noted(b"OLYMPUS", lambda at: b"OLYMP\0\1\0" + _ifd([(136, 7, b"\0\xd8" + brand.encode())], at + 8, "<")))
        return canon.custom_functions()[1], canon.custom_functions()[2], other.thumbnail()

    rows = t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), "p_partkey", "p_size", "p_brand")
    return long_key(M.mapped(rows, ["p_partkey", "p_size", "p_brand"], run, "first int, second int, thumb binary"), "p_partkey", "first", "second", F.md5("thumb").alias("thumb_md5"))


# --- filters


def _gifs(spark, d):
    return packed(t(spark, d, "part"), "p_partkey", ["p_partkey", "p_name"], lambda k, n: GIF_HEAD + files.gif_extension("comment", n.encode()) * (1 + k % 3) + GIF_FRAME * (1 + k % 4) + b"\x3b")


@query("flt_03_typed_lists", "SELECT p_partkey, CAST(1 + p_partkey % 4 AS INTEGER) AS frames, CAST(1 + p_partkey % 3 AS INTEGER) AS comments FROM part")
def flt_03(spark, d):
    """Frames only, and extensions of one label."""
    parts = M.parts(_gifs(spark, d), payload=False)
    out = parts.groupBy("path").agg(F.count_if(F.col("kind") == "frame").cast("int").alias("frames"), F.count_if((F.col("kind") == "extension") & (F.col("type") == "FE")).cast("int").alias("comments"))
    return long_key(out, "p_partkey", "frames", "comments")


@query("flt_01_carriers_present", "SELECT p_partkey, p_partkey % 2 = 0 AS has_exif, p_partkey % 3 = 0 AS has_xmp, p_partkey % 5 = 0 AS has_icc, true AS has_comment FROM part")
def flt_01(spark, d):
    def make(k, name):
        data = jpeg((0xFE, name.encode()))
        for n, carrier, value in ((2, "exif", tiff.write([E("IFD0", 271, 2, b"m\0")])), (3, "xmp", b"<x/>"), (5, "icc", bytes(10))):
            data = files.put(data, carrier, value) if k % n == 0 else data
        return data

    parts = M.parts(packed(t(spark, d, "part"), "p_partkey", ["p_partkey", "p_name"], make), payload=False)
    has = lambda k: F.max(F.col("kind") == k).alias(f"has_{k}")
    return long_key(parts.groupBy("path").agg(*map(has, ("exif", "xmp", "icc", "comment"))), "p_partkey", "has_exif", "has_xmp", "has_icc", "has_comment")


@query("flt_02_membership", "SELECT p_partkey, p_partkey % 2 = 0 AS has_make, p_partkey % 3 = 0 AS has_keywords FROM part")
def flt_02(spark, d):
    """Whether a directory holds a tag and a record set a dataset: aggregates over the exploded rows."""
    tagged = M.tags(packed(t(spark, d, "part"), "p_partkey", ["p_partkey"], lambda k: tiff.write([E("IFD0", 271 if k % 2 == 0 else 272, 2, b"m\0")])))
    sets = M.datasets(packed(t(spark, d, "part"), "p_partkey", ["p_partkey"], lambda k: carriers.iptc_write([(2, 25 if k % 3 == 0 else 20, b"k")])))
    one = tagged.groupBy("path").agg(F.max((F.col("ifd") == "IFD0") & (F.col("tag") == 271)).alias("has_make"))
    two = sets.groupBy("path").agg(F.max((F.col("record") == 2) & (F.col("dataset") == 25)).alias("has_keywords"))
    return long_key(one.join(two, "path"), "p_partkey", "has_make", "has_keywords")


@query("flt_04_remove_chunks", f"SELECT s_suppkey, {md5_of(png_sql(('tIME', lit(b'1234567'))))}, CAST(1 + s_suppkey % 3 AS INTEGER) AS removed FROM supplier")
def flt_04(spark, d):
    """Text chunks taken out of files: the file without them, and how many they were."""
    made = packed(t(spark, d, "supplier"), "s_suppkey", ["s_suppkey", "s_name"], lambda k, n: png(*[("tEXt", b"Title\0" + n.encode())] * (1 + k % 3), ("tIME", b"1234567")))
    parts = M.parts(made)
    gone = parts.where("type = 'tEXt'").groupBy("path").agg(F.count("*").cast("int").alias("removed"))
    rest = sinks.compose(parts.where("type <> 'tEXt'"), "png").join(gone, "path")
    return long_key(rest, "s_suppkey", F.md5("content").alias("file_md5"), F.octet_length("content").cast("long").alias("bytes"), "removed")


@query("flt_06_structure", "SELECT p_partkey, p_partkey % 4 >= 1 AS animated, p_partkey % 2 = 1 AS big_endian FROM part")
def flt_06(spark, d):
    """Animated where there is more than one frame; big-endian by the first bytes of a block."""
    frames = M.parts(_gifs(spark, d), payload=False).groupBy("path").agg((F.count_if(F.col("kind") == "frame") > 1).alias("animated"))
    blocks = packed(t(spark, d, "part"), "p_partkey", ["p_partkey"], lambda k: tiff.write([E("IFD0", 256, 4, [k])], "<>"[k % 2]))
    order = blocks.select("path", (F.substring("content", 1, 2) == F.lit(b"MM")).alias("big_endian"))
    return long_key(frames.join(order, "path"), "p_partkey", "animated", "big_endian")


@query("flt_08_ceilings", "SELECT * FROM (VALUES ('256M', 268435456), ('1G', 1073741824), ('64k', 65536), ('1234', 1234), ('25%', 33554432), ('100%', 134217728)) AS v(budget, bytes)")
def flt_08(spark, d):
    """A budget as bytes, with a unit, or as a share of a limit of 128 MiB."""
    rows = spark.createDataFrame([(x,) for x in ("256M", "1G", "64k", "1234", "25%", "100%")], "budget string")
    number = F.regexp_extract("budget", "^([0-9]+)", 1).cast("long")
    unit = F.upper(F.regexp_extract("budget", "([A-Za-z%]?)$", 1))
    scale = F.when(unit == "K", 1 << 10).when(unit == "M", 1 << 20).when(unit == "G", 1 << 30).otherwise(1)
    return rows.select("budget", F.when(unit == "%", number * (128 << 20) / 100).otherwise(number * scale).cast("long").alias("bytes"))
