"""More registered queries: projections, filters, composers, XMP, colour and binary scalars."""

from __future__ import annotations

import struct

from pyspark.sql import functions as F

from tessera.dims import tags as dims
from tessera.functions import columns as C
from tessera.kernels import carriers, containers, tiff, xmp
from tessera.plans.queries import _COLOURS, _boxes, _jpeg, _order_files, _png, packed, query, t
from tessera.sources import media as M

# --- projections and filters over tags


@query("prj_03_tags_by_name", "SELECT o_orderkey, o_orderstatus AS \"Make\", o_orderpriority AS \"ImageDescription\", CAST(o_orderkey % 60000 AS VARCHAR) AS \"ISOSpeedRatings\" FROM orders WHERE o_orderkey % 60000 > 100")
def prj_03(spark, d):
    """Names from the dimension, a row a file, filtered by a tag's value (AGG-15)."""
    tags = M.tags(_order_files(spark, d)).withColumn("grp", F.expr("CASE ifd WHEN 'ExifIFD' THEN 'EXIF' WHEN 'GPS' THEN 'GPS' WHEN 'Interop' THEN 'Interoperability' ELSE 'TIFF' END"))
    named = tags.where("ifd <> 'IFD1'").join(F.broadcast(dims.exif_tags(spark)), ["grp", "tag"])
    text = F.coalesce(C.until_nul(F.decode("bytes", "UTF-8")), F.get("ints", F.lit(0)).cast("string"))
    wide = named.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("tag_name", text.alias("text")))).alias("m"))
    pick = lambda n: F.element_at("m", n).alias(n)
    return wide.where(F.element_at("m", "ISOSpeedRatings").cast("int") > 100).select(F.col("path").cast("long").alias("o_orderkey"), pick("Make"), pick("ImageDescription"), pick("ISOSpeedRatings"))


@query("prj_05_value_shape", "SELECT o_orderkey, CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS DOUBLE) / 100 AS resolution, CASE WHEN o_orderkey % 2 = 0 THEN 'scalar' ELSE 'array' END AS shape FROM orders")
def prj_05(spark, d):
    """Rationals as doubles, and one value or several told apart."""
    e = tiff.Entry
    files = packed(t(spark, d, "orders"), "o_orderkey", ["o_orderkey", "o_totalprice"], lambda k, p: tiff.write([e("IFD0", 282, 5, [(round(p * 100), 100)]), e("IFD0", 258, 3, [8] * (1 + k % 2))]))
    tags = M.tags(files)
    ratio = F.get("nums", F.lit(0))
    return tags.groupBy("path").agg(F.max(F.try_divide(ratio["num"].cast("double"), ratio["den"].cast("double"))).alias("resolution"), F.max(F.when(F.col("tag") == 258, F.when(F.col("count") == 1, "scalar").otherwise("array"))).alias("shape")).select(F.col("path").cast("long").alias("o_orderkey"), "resolution", "shape")


@query("prj_06_first_part", "SELECT doc_id, md5(left(text, 0) || CAST('Source' AS VARCHAR) || chr(0) || lang) AS first_md5 FROM documents")
def prj_06(spark, d):
    parts = M.parts(packed(t(spark, d, "documents"), "doc_id", ["text", "doc_id", "lang"], _png))
    return parts.groupBy("path").agg(F.md5(M.first_part("tEXt")).alias("first_md5")).select(F.col("path").cast("long").alias("doc_id"), "first_md5")


@query("flt_05_flags", "SELECT o_orderkey, o_orderkey % 1024 AS flags FROM orders WHERE (o_orderkey % 1024 & 34) <> 0")
def flt_05(spark, d):
    return t(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 1024).alias("flags")).where(F.col("flags").bitwiseAND(34) != 0)


@query("agg_08_part_counts", "SELECT p_partkey, 5 AS parts, strlen(p_name) + 8 + p_partkey % 50 AS bytes FROM part")
def agg_08(spark, d):
    parts = M.parts(packed(t(spark, d, "part"), "p_partkey", ["p_partkey", "p_name"], _boxes), payload=False)
    return parts.groupBy("path").agg(F.count("*").cast("int").alias("parts"), F.sum("size").alias("bytes")).select(F.col("path").cast("long").alias("p_partkey"), "parts", "bytes")


# --- XMP


def _packet(key, status, priority, price):
    return xmp.write({"dc:title": {"x-default": priority, "fr": f"{priority} & <{key}>"}, "dc:subject": [status, priority], "xmpMM:History": [{"stEvt:action": f"step{i}-{key}"} for i in range(1 + key % 3)], "xmp:Rating": str(key % 6), **({"dc:creator": "alone"} if key % 4 == 0 else {"dc:creator": ["one"]})}).encode()


def _packets(spark, d):
    return packed(t(spark, d, "orders"), "o_orderkey", ["o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice"], _packet)


@query("nst_01_xmp_path", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 >= 1 THEN 'step1-' || o_orderkey END AS second_action, CAST(o_orderkey % 6 AS VARCHAR) AS rating FROM orders")
def nst_01(spark, d):
    """A path with a place and a field, and a plain property."""
    rows = M.convert(_packets(spark, d), "content", lambda x: xmp.at(xmp.read(x.decode()), "xmpMM:History[2]/stEvt:action"), "second_action", "string")
    return M.convert(rows, "content", lambda x: xmp.at(xmp.read(x.decode()), "xmp:Rating"), "rating", "string").select(F.col("path").cast("long").alias("o_orderkey"), "second_action", "rating")


@query("prj_10_xmp_properties", "SELECT o_orderkey, unnest(['title:0', 'title:1', 'subject:0', 'subject:1', 'rating:0']) AS place, unnest([o_orderpriority, o_orderpriority || ' & <' || o_orderkey || '>', o_orderstatus, o_orderpriority, CAST(o_orderkey % 6 AS VARCHAR)]) AS value FROM orders")
def prj_10(spark, d):
    """Properties as rows of names, places and texts."""

    def rows(content):
        found = xmp.read(content.decode())
        for name, key in (("title", "dc:title"), ("subject", "dc:subject"), ("rating", "xmp:Rating")):
            value = found[key]
            for i, item in enumerate(value["items"] if isinstance(value, dict) else [value]):
                yield f"{name}:{i}", item["value"] if isinstance(item, dict) else item

    return M._rows(_packets(spark, d), "path string, place string, value string, error string", rows).select(F.col("path").cast("long").alias("o_orderkey"), "place", "value")


@query("cns_05_xmp_forms", "SELECT o_orderkey, 'dc:creator' AS name, 'Simple' AS has, 'Seq' AS wanted FROM orders WHERE o_orderkey % 4 = 0")
def cns_05(spark, d):
    problems = M._rows(_packets(spark, d), "path string, name string, has string, wanted string, error string", lambda c: xmp.departures(xmp.read(c.decode())))
    return problems.select(F.col("path").cast("long").alias("o_orderkey"), "name", "has", "wanted")


# --- other sources


@query("src_18_webp_size", "SELECT p_partkey, 1 + p_partkey % 5000 AS width, 1 + p_size AS height FROM part")
def src_18(spark, d):
    make = lambda k, s: containers.riff_write("WEBP", [containers.Part(0, -1, 0, "chunk", "VP8X", 0, bytes(4) + (k % 5000).to_bytes(3, "little") + s.to_bytes(3, "little"))])
    files = packed(t(spark, d, "part"), "p_partkey", ["p_partkey", "p_size"], make)
    chunk = M.parts(files).where("type = 'VP8X'")
    side = lambda at: (1 + F.conv(F.concat(*[F.hex(F.substring("payload", at + i, 1)) for i in (2, 1, 0)]), 16, 10).cast("long"))
    return chunk.select(F.col("path").cast("long").alias("p_partkey"), side(5).alias("width"), side(8).alias("height"))


@query("src_19_gif_blocks", "SELECT p_partkey, unnest([0, 1, 2]) AS seq, unnest(['screen', 'extension', 'frame']) AS kind, unnest(['', p_name, '']) AS note FROM part")
def src_19(spark, d):
    def make(k, name):
        return b"GIF89a" + struct.pack("<HHBBB", k % 99, 5, 0, 0, 0) + b"\x21\xfe" + containers.framed(name.encode()) + b"\x2c" + bytes(9) + b"\2" + containers.framed(bytes(k % 600)) + b"\x3b"

    parts = M.parts(packed(t(spark, d, "part"), "p_partkey", ["p_partkey", "p_name"], make))
    return parts.select(F.col("path").cast("long").alias("p_partkey"), "seq", "kind", F.when(F.col("type") == "FE", F.decode("payload", "UTF-8")).otherwise("").alias("note"))


@query("src_36_jfif", "SELECT doc_id, '1.02' AS version, doc_id % 300 AS x_density FROM documents")
def src_36(spark, d):
    parts = M.parts(packed(t(spark, d, "documents"), "doc_id", ["text", "doc_id"], _jpeg)).where("kind = 'jfif'")
    rows = M.convert(parts, "payload", lambda x: "{version} {x_density}".format(**carriers.jfif(x)), "j", "string")
    return rows.select(F.col("path").cast("long").alias("doc_id"), F.split("j", " ")[0].alias("version"), F.split("j", " ")[1].cast("long").alias("x_density"))


@query("src_38_picture_info", "SELECT c_custkey, c_name AS name, c_mktsegment AS segment FROM customer")
def src_38(spark, d):
    lines = F.concat(F.lit("[info]\r\nName=old\r\nName="), "c_name", F.lit("\rSeg="), "c_mktsegment")
    pairs = F.filter(F.split(lines, "\r\n|\r|\n"), lambda x: F.contains(x, F.lit("=")) & ~F.startswith(x, F.lit("[")))
    last = lambda k: F.substring_index(F.element_at(F.filter(pairs, lambda x: F.startswith(x, F.lit(k + "="))), -1), "=", -1)
    return t(spark, d, "customer").select("c_custkey", last("Name").alias("name"), last("Seg").alias("segment"))


@query("prj_08_icc_header", "SELECT p_partkey, 'mntr' AS device_class, 'RGB' AS space, p_size % 4 AS intent, p_partkey AS flags FROM part")
def prj_08(spark, d):
    """Fixed places of the header, read by built-in functions."""
    make = lambda k, s: bytes(12) + b"mntrRGB XYZ " + bytes(12) + b"acsp" + bytes(4) + struct.pack(">I", k) + bytes(16) + struct.pack(">I", s % 4) + bytes(64)
    files = packed(t(spark, d, "part"), "p_partkey", ["p_partkey", "p_size"], make)
    text = lambda at: F.trim(F.decode(F.substring("content", at, 4), "UTF-8"))
    number = lambda at: F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("long")
    return files.where(C.starts(F.col("content"), b"acsp", 36)).select(F.col("path").cast("long").alias("p_partkey"), text(13).alias("device_class"), text(17).alias("space"), number(65).alias("intent"), number(45).alias("flags"))


# --- scalars


@query("str_09_raw_profile", "SELECT doc_id, md5(text) AS text_md5 FROM documents")
def str_09(spark, d):
    """Hex in lines of 72 characters under a header, read back."""
    body = F.regexp_replace(F.lower(F.hex(F.col("text").cast("binary"))), "(.{72})", "$1\n")
    rows = t(spark, d, "documents").select("doc_id", F.concat(F.lit("\niptc\n"), F.octet_length("text").cast("string"), F.lit("\n"), body).alias("raw"))
    hexed = F.regexp_replace(F.regexp_replace("raw", "^\\niptc\\n[0-9]+\\n", ""), "[^0-9A-Fa-f]", "")
    return rows.select("doc_id", F.md5(F.unhex(hexed)).alias("text_md5"))


@query("jon_14_palette_lookup", "SELECT p_partkey, " + ", ".join(f"coalesce([{', '.join(str(c[i]) for c in _COLOURS)}][1 + p_partkey % 11], {_COLOURS[0][i]}) AS {n}" for i, n in enumerate(("red", "green", "blue"))) + " FROM part")
def jon_14(spark, d):
    """Colours of indexes; an index outside the palette has the first colour."""
    colours = F.array(*[F.struct(*(F.lit(v).alias(n) for n, v in zip(("red", "green", "blue"), c, strict=True))) for c in _COLOURS])
    return t(spark, d, "part").select("p_partkey", F.coalesce(F.get(colours, (F.col("p_partkey") % 11).cast("int")), F.get(colours, F.lit(0))).alias("c")).select("p_partkey", "c.*")


@query("nst_10_bit_fields", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, (l_partkey >> 8) & 255 AS id, l_partkey & 255 AS value FROM lineitem")
def nst_10(spark, d):
    k = F.col("l_partkey")
    return t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.shiftright(k, 8).bitwiseAND(255).alias("id"), k.bitwiseAND(255).alias("value"))


@query("mth_17_aspect", "SELECT p_partkey, p_partkey * [1, 12, 4, 3, 16, 5, 2][1 + p_partkey % 7] // [1, 10, 3, 2, 9, 4, 1][1 + p_partkey % 7] AS width FROM part")
def mth_17(spark, d):
    k = F.col("p_partkey")
    pick = lambda j: F.get(F.array(*[F.lit(r[j]) for r in containers.JXL_RATIOS]), (k % 7).cast("int"))
    return t(spark, d, "part").select("p_partkey", F.floor(k * pick(0) / pick(1)).alias("width"))
