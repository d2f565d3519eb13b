"""Registered queries: each makes a carrier or records of rows, runs an operator over them, and has plain SQL beside it."""

from __future__ import annotations

import struct
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.dims import tags as dims
from tessera.functions import columns as C
from tessera.kernels import carriers, codecs, containers, files, tiff
from tessera.operators import records as R
from tessera.sources import media as M

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        assert name not in QUERIES, f"two queries are called {name}"
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt to the session's number of tasks: a small table is one task, whose rows may become large files."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def packed(rows: DataFrame, key: str, columns: list[str], build) -> DataFrame:
    """(path, content): build(*columns) of each row as a file's bytes; null texts count as empty."""
    blank = [isinstance(rows.schema[c].dataType, StringType) for c in columns]

    def files_of(batches):
        for batch in batches:
            for path, *values in M.values_of(batch.set_column(0, "__key", batch.column(0).cast(pa.string())), ["__key", *columns]):
                yield path, build(*("" if text and v is None else v for v, text in zip(values, blank, strict=True)))

    def run(batches):
        return M.bounded(files_of(batches), pa.schema([("path", pa.string()), ("content", pa.binary())]))

    return rows.select(F.col(key).alias("__key"), *columns).mapInArrow(run, "path string, content binary")


# --- sources -------------------------------------------------------------------------------------

_MARKS = ["FFD8FFE0", "89504E470D0A1A0A", "474946383961", "52494646000000005745425056503820", "524946460000000041564920", "FF0A00", "0000000C4A584C200D0A870A", "0000001866747970", "49492A00", "4D4D002A", "7B7D"]
_NAMES = ["jpeg", "png", "gif", "webp", "avi", "jxl", "jxl", "bmff", "tiff", "tiff", None]


@query("src_03_detect", "SELECT doc_id, [" + ", ".join(f"'{n}'" if n else "NULL" for n in _NAMES) + "][1 + doc_id % 11] AS format, doc_id % 11 = 0 AS is_jpeg, doc_id % 11 = 1 AS is_png, doc_id % 11 = 2 AS is_gif, doc_id % 11 IN (3, 4) AS is_riff, doc_id % 11 = 7 AS is_bmff, doc_id % 11 IN (8, 9) AS is_tiff FROM documents")
def src_03(spark, d):
    docs = t(spark, d, "documents").withColumn("content", F.concat(F.unhex(F.element_at(F.array(*map(F.lit, _MARKS)), (F.col("doc_id") % 11 + 1).cast("int"))), F.col("text").cast("binary")))
    c = F.col("content")
    tests = {"is_jpeg": b"\xff\xd8", "is_png": containers.PNG_MARK, "is_gif": b"GIF8", "is_riff": b"RIFF"}
    return docs.select("doc_id", C.detect(c).alias("format"), *[C.starts(c, m).alias(n) for n, m in tests.items()], C.starts(c, b"ftyp", 4).alias("is_bmff"), (C.starts(c, b"II*\0") | C.starts(c, b"MM\0*")).alias("is_tiff"))


def _order_block(key, price, status, priority, day):
    e = tiff.Entry
    return tiff.write([e("IFD0", 256, 4, [key]), e("IFD0", 282, 5, [(round(price * 100), 100)]), e("IFD0", 271, 2, status.encode() + b"\0"), e("IFD0", 270, 2, priority.encode() + b"\0"), e("ExifIFD", 34855, 3, [key % 60000]), e("GPS", 29, 2, day.encode() + b"\0"), e("IFD1", 12, 12, [price])], "<>"[key % 2])


def _order_files(spark, d):
    rows = t(spark, d, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy:MM:dd"))
    return packed(rows, "o_orderkey", ["o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority", "day"], _order_block)


@query("src_23_tiff_tags", """
    SELECT o_orderkey, o_orderkey AS width, CAST(round(o_totalprice * 100) AS BIGINT) AS res_num, o_orderstatus AS make, o_orderpriority AS description, o_orderkey % 60000 AS iso, strftime(o_orderdate, '%Y:%m:%d') AS gps_day, o_totalprice AS price FROM orders""")
def src_23(spark, d):
    """Blocks of both byte orders, sub-directories and a second directory, scanned and turned to a row a file."""
    tags = M.tags(_order_files(spark, d))
    one = lambda ifd, tag, value: F.max(F.when((F.col("ifd") == ifd) & (F.col("tag") == tag), value))
    text = C.until_nul(F.decode("bytes", "UTF-8"))
    first = F.get("ints", F.lit(0))
    out = tags.groupBy("path").agg(one("IFD0", 256, first).alias("width"), one("IFD0", 282, F.get("nums", F.lit(0))["num"]).alias("res_num"), one("IFD0", 271, text).alias("make"), one("IFD0", 270, text).alias("description"), one("ExifIFD", 34855, first).alias("iso"), one("GPS", 29, text).alias("gps_day"), one("IFD1", 12, F.get("floats", F.lit(0))).alias("price"))
    return out.select(F.col("path").cast("long").alias("o_orderkey"), "width", "res_num", "make", "description", "iso", "gps_day", "price")


def _jpeg(text, key):
    p = containers.Part
    rows = [("E0", b"JFIF\0\1\2\1" + struct.pack(">HHBB", key % 300, 72, 0, 0)), ("E1", b"Exif\0\0" + tiff.write([tiff.Entry("IFD0", 256, 4, [key])])), *(("FE", x) for x in files.cut(text.encode(), 65533) or [b""]), ("C0", b"\x08" + struct.pack(">HHB", 1 + key % 500, 1 + key % 700, 3))]
    return containers.jpeg_write([p(i, -1, 0, "", k, 0, b) for i, (k, b) in enumerate(rows)] + [p(9, -1, 0, "scan", "DA", 0, b"\xff\xda\0\2\1\2\xff\xd9")])


@query("src_11_jpeg_segments", """
    WITH d AS (SELECT doc_id, strlen(coalesce(text, '')) AS n, greatest(1, (strlen(coalesce(text, '')) + 65532) // 65533) AS k FROM documents),
    s AS (SELECT doc_id, n, k, unnest(range(0, k + 4)) AS seq FROM d)
    SELECT doc_id, seq, CASE WHEN seq = 0 THEN 'jfif' WHEN seq = 1 THEN 'exif' WHEN seq < 2 + k THEN 'comment' WHEN seq = 2 + k THEN 'segment' ELSE 'scan' END AS kind,
           CASE WHEN seq = 0 THEN 14 WHEN seq = 1 THEN 32 WHEN seq < 2 + k THEN least(65533, n - (seq - 2) * 65533) WHEN seq = 2 + k THEN 6 ELSE 8 END AS size FROM s""")
def src_11(spark, d):
    files = packed(t(spark, d, "documents"), "doc_id", ["text", "doc_id"], _jpeg)
    return M.parts(files).select(F.col("path").cast("long").alias("doc_id"), "seq", "kind", "size")


@query("src_12_jpeg_size", "SELECT doc_id, 1 + doc_id % 700 AS width, 1 + doc_id % 500 AS height FROM documents")
def src_12(spark, d):
    files = packed(t(spark, d, "documents"), "doc_id", ["text", "doc_id"], _jpeg)
    sized = M.convert(files, "content", lambda x: None if (size := containers.jpeg_size(x)) is None else f"{size[0]}x{size[1]}", "size", "string")
    return sized.select(F.col("path").cast("long").alias("doc_id"), F.split("size", "x")[0].cast("long").alias("width"), F.split("size", "x")[1].cast("long").alias("height"))


def _png(text, key, lang):
    import zlib

    p = containers.Part
    body = text.encode()
    rows = [("IHDR", struct.pack(">IIBBBBB", key + 1, 7, 8, 2, 0, 0, 0)), ("tEXt", b"Source\0" + lang.encode()), ("zTXt", b"Packed\0\0" + zlib.compress(lang.encode() * 3)), ("iTXt", b"Text\0\1\0" + lang.encode() + b"\0\0" + zlib.compress(body)), ("IEND", b"")]
    return containers.png_write([p(i, -1, 0, "chunk", k, 0, b) for i, (k, b) in enumerate(rows)])


@query("src_13_png_text", "SELECT doc_id, unnest(['Source', 'Packed', 'Text']) AS keyword, md5(unnest([lang, lang || lang || lang, text])) AS text_md5 FROM documents")
def src_13(spark, d):
    """PNG chunks with their CRCs, and tEXt, zTXt and iTXt decoded."""

    def texts(content):
        for part in containers.png_parts(content):
            if (found := containers.png_text(part)) is not None:
                yield part.seq, *found

    files = packed(t(spark, d, "documents"), "doc_id", ["text", "doc_id", "lang"], _png)
    rows = M._rows(files, "path string, seq int, keyword string, text string, error string", texts)
    return rows.select(F.col("path").cast("long").alias("doc_id"), "keyword", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def _riff(key, name, balance):
    p = containers.Part
    rows = [p(0, -1, 0, "list", "hdrl", 0, b""), p(1, 0, 1, "chunk", "avih", 0, struct.pack("<14I", 40000, 0, 0, 0, key, 0, 0, 0, 320, 240, 0, 0, 0, 0)), p(2, -1, 0, "list", "INFO", 0, b""), p(3, 2, 1, "chunk", "INAM", 0, name.encode() + b"\0"), p(4, 2, 1, "chunk", "ICMT", 0, str(round(balance)).encode() + b"\0")]
    return containers.riff_write("AVI ", rows)


@query("src_14_riff_info", "SELECT c_custkey, c_name AS title, CAST(CAST(round_even(c_acctbal, 0) AS BIGINT) AS VARCHAR) AS comment, c_custkey AS frames FROM customer")
def src_14(spark, d):
    """AVI: nested lists, the main header, and the INFO tags as one row a file."""
    rows = M.parts(packed(t(spark, d, "customer"), "c_custkey", ["c_custkey", "c_name", "c_acctbal"], _riff))
    text = C.until_nul(F.decode("payload", "UTF-8"))
    frames = F.conv(F.concat(*[F.hex(F.substring("payload", 20 - i, 1)) for i in range(4)]), 16, 10)
    return rows.groupBy("path").agg(F.max(F.when(F.col("type") == "INAM", text)).alias("title"), F.max(F.when(F.col("type") == "ICMT", text)).alias("comment"), F.max(F.when(F.col("type") == "avih", frames)).cast("long").alias("frames")).select(F.col("path").cast("long").alias("c_custkey"), "title", "comment", "frames")


def _boxes(key, name):
    p = containers.Part
    return containers.box_write([p(0, -1, 0, "box", "ftyp", 0, b"isom\0\0\0\0"), p(1, -1, 0, "container", "moov", 0, b""), p(2, 1, 1, "container", "udta", 0, b""), p(3, 2, 2, "box", "name", 0, name.encode()), p(4, -1, 0, "box", "mdat", 0, bytes(key % 50))])


@query("src_20_box_tree", "SELECT p_partkey, unnest([0, 1, 2, 3, 4]) AS seq, unnest([-1, -1, 1, 2, -1]) AS parent, unnest([0, 0, 1, 2, 0]) AS depth, unnest(['ftyp', 'moov', 'udta', 'name', 'mdat']) AS type, unnest([8, 0, 0, strlen(p_name), p_partkey % 50]) AS size FROM part")
def src_20(spark, d):
    rows = M.parts(packed(t(spark, d, "part"), "p_partkey", ["p_partkey", "p_name"], _boxes))
    return rows.select(F.col("path").cast("long").alias("p_partkey"), "seq", "parent", "depth", "type", "size")


@query("src_31_iptc_gather", """
    SELECT o_custkey, string_agg(o_orderpriority, '|' ORDER BY o_orderkey) AS keywords, arg_min(o_orderstatus, o_orderkey) AS category, 2 * count(*) AS datasets FROM orders GROUP BY o_custkey""")
def src_31(spark, d):
    """AGG-06: repeatable datasets become lists in order, of others the first stays."""
    orders = t(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority", "o_orderstatus"))).alias("o"))
    blocks = packed(orders, "o_custkey", ["o"], lambda o: carriers.iptc_write([x for r in o for x in ((2, 25, r["o_orderpriority"].encode()), (2, 15, r["o_orderstatus"].encode()))]))
    sets = M.datasets(blocks).withColumn("text", F.decode("value", "UTF-8")).join(F.broadcast(dims.iptc_sets(spark)), ["record", "dataset"])
    got = R.gathered(sets, ["path", "set_name"], "seq", "text", F.col("repeats"))
    n = sets.groupBy("path").agg(F.count("*").cast("long").alias("datasets"))
    out = got.groupBy("path").agg(F.max(F.when(F.col("set_name") == "Keywords", F.col("text"))).alias("keywords"), F.max(F.when(F.col("set_name") == "Category", F.col("text"))).alias("category")).join(n, "path")
    return out.select(F.col("path").cast("long").alias("o_custkey"), "keywords", "category", "datasets")


@query("src_32_resources", "SELECT p_partkey, unnest([0, 1]) AS seq, unnest([1028, 2000 + p_partkey % 900]) AS id, unnest(['', p_brand]) AS name, md5(unnest([p_name, p_type])) AS data_md5, unnest(['IPTC-NAA', 'PathInformation']) AS label FROM part")
def src_32(spark, d):
    """Photoshop resources with JON-05: names of ids, path ids being a range."""
    blocks = packed(t(spark, d, "part"), "p_partkey", ["p_partkey", "p_name", "p_type", "p_brand"], lambda k, n, y, b: b"junk" + carriers.resources_write([(1028, "", n.encode()), (2000 + k % 900, b, y.encode())]))
    rows = R.in_range(M.resources(blocks), dims.resource_ranges(spark), "id")
    return rows.select(F.col("path").cast("long").alias("p_partkey"), "seq", "id", "name", F.md5("data").alias("data_md5"), "label")


@query("src_34_icc_tags", "SELECT p_partkey, unnest([0, 1, 2]) AS seq, unnest(['desc', 'cprt', 'wtpt']) AS signature, md5(unnest([p_name, p_name, p_brand])) AS data_md5 FROM part")
def src_34(spark, d):
    """SNK-16: equal bodies are stored once and read twice."""
    header = bytes(36) + b"acsp" + bytes(88)
    files = packed(t(spark, d, "part"), "p_partkey", ["p_name", "p_brand"], lambda n, b: carriers.icc_write(header, [("desc", n.encode()), ("cprt", n.encode()), ("wtpt", b.encode())]))
    return M.profile_tags(files).select(F.col("path").cast("long").alias("p_partkey"), "seq", "signature", F.md5("data").alias("data_md5"))


# --- joins ---------------------------------------------------------------------------------------

_ITEMS = "SELECT o_orderkey AS path, k AS item_id, o_orderkey * 10 + k AS seq, o_orderstatus || k AS kind FROM orders, (VALUES (1), (2), (3)) AS v(k)"


@query("jon_01_item_locations", f"""
    WITH items AS ({_ITEMS}), e AS (SELECT l_orderkey AS path, l_linenumber AS item_id, l_partkey AS start, CAST(l_quantity AS BIGINT) AS size,
        row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) AS rn FROM lineitem)
    SELECT i.path, i.item_id, i.kind, e.start, e.size FROM items i LEFT JOIN e ON i.path = e.path AND i.item_id = e.item_id AND e.rn = 1""")
def jon_01(spark, d):
    items = t(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("item_id"), "o_orderstatus")
    items = items.select("path", "item_id", (F.col("path") * 10 + F.col("item_id")).alias("seq"), F.concat("o_orderstatus", "item_id").alias("kind"))
    extents = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("item_id"), F.struct("l_partkey", "l_suppkey", "l_quantity").alias("seq"), F.col("l_partkey").alias("start"), F.col("l_quantity").cast("long").alias("size"))
    return R.item_locations(items, extents, ["path", "item_id"])


@query("jon_02_tag_lookup", f"SELECT o_orderkey, 274 AS tag, o_orderkey % 11 AS value, coalesce(meaning, 'Unknown (' || o_orderkey % 11 || ')') AS text FROM orders LEFT JOIN {dims.values_sql(dims.EXIF_MEANINGS, 'tag, value, meaning')} ON d.tag = 274 AND d.value = o_orderkey % 11")
def jon_02(spark, d):
    values = t(spark, d, "orders").select("o_orderkey", F.lit(274).alias("tag"), (F.col("o_orderkey") % 11).alias("value"))
    return R.meanings(values, dims.exif_meanings(spark), ["tag", "value"], "value").select("o_orderkey", "tag", "value", "text")


@query("jon_03_name_lookup", f"SELECT o_orderkey, grp, tag FROM orders LEFT JOIN {dims.values_sql([(i, g, x, n) for i, (g, x, n) in enumerate(dims.EXIF_TAGS)], 'i, grp, tag, tag_name')} ON d.i = o_orderkey % 190")
def jon_03(spark, d):
    """Names in any case; ids over the table's end have no name and find nothing."""
    names = F.array(*[F.lit(n.upper()) for _, _, n in dims.EXIF_TAGS])
    rows = t(spark, d, "orders").select("o_orderkey", F.get(names, (F.col("o_orderkey") % 190).cast("int")).alias("name"))
    return R.by_name(rows, dims.exif_tags(spark)).select("o_orderkey", "grp", "tag")


@query("jon_04_iptc_ids", f"SELECT p_partkey, printf('%d#%03d', record, dataset) AS iptc_id, set_name FROM part JOIN {dims.values_sql([(i, *r) for i, r in enumerate(dims.IPTC_SETS)], 'i, record, dataset, set_name, repeats')} ON d.i = p_partkey % {len(dims.IPTC_SETS)}")
def jon_04(spark, d):
    packed_ids = F.array(*[F.lit(r * 256 + s) for r, s, _, _ in dims.IPTC_SETS])
    rows = t(spark, d, "part").withColumn("id", F.get(packed_ids, (F.col("p_partkey") % len(dims.IPTC_SETS)).cast("int")))
    rows = rows.select("p_partkey", F.shiftright("id", 8).alias("record"), F.col("id").bitwiseAND(255).alias("dataset"))
    return rows.join(F.broadcast(dims.iptc_sets(spark)), ["record", "dataset"]).select("p_partkey", F.format_string("%d#%03d", "record", "dataset").alias("iptc_id"), "set_name")


_SPANS = "SELECT o_custkey AS path, o_orderkey AS id, o_orderkey % 5000 AS s, o_orderkey % 5000 + CAST(floor(o_totalprice / 5000) AS BIGINT) AS e FROM orders"


def _spans(spark, d):
    key = F.col("o_orderkey")
    return t(spark, d, "orders").select(F.col("o_custkey").alias("path"), key.alias("id"), (key % 5000).alias("s"), (key % 5000 + F.floor(F.col("o_totalprice") / 5000)).alias("e"))


@query("jon_06_extent_overlap", f"WITH x AS ({_SPANS}) SELECT path, id, s, e FROM x a WHERE EXISTS (SELECT 1 FROM x b WHERE a.path = b.path AND a.id <> b.id AND a.s < b.e AND b.s < a.e AND a.s < a.e AND b.s < b.e)")
def jon_06(spark, d):
    return R.overlapped(_spans(spark, d), "path", "id", "s", "e")


@query("jon_07_extent_home", f"""
    WITH x AS ({_SPANS}), b AS (SELECT path, min(s) AS lo, max(e) + 1 AS hi FROM x GROUP BY path), box AS (SELECT path, 1 AS seq, lo AS bs, (lo + hi) // 2 + 1 AS be FROM b UNION ALL SELECT path, 2, (lo + hi) // 2, hi FROM b)
    SELECT x.path, x.id, x.s, x.e, min(seq) AS home FROM x LEFT JOIN box ON x.path = box.path AND bs <= s AND e <= be GROUP BY ALL""")
def jon_07(spark, d):
    spans = _spans(spark, d)
    b = spans.groupBy("path").agg(F.min("s").alias("lo"), (F.max("e") + 1).alias("hi")).withColumn("mid", F.floor((F.col("lo") + F.col("hi")) / 2))
    boxes = b.select("path", F.explode(F.array(F.struct(F.lit(1).alias("seq"), F.col("lo").alias("box_start"), (F.col("mid") + 1).alias("box_end")), F.struct(F.lit(2).alias("seq"), F.col("mid").alias("box_start"), F.col("hi").alias("box_end")))).alias("b")).select("path", "b.*")
    return R.homes(spans, boxes, "path", "id", "s", "e")


@query("jon_09_required_missing", "SELECT o_orderkey, f AS field FROM orders, (VALUES (1), (2), (3), (4), (5), (6), (7)) AS v(f) WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = f)")
def jon_09(spark, d):
    required = spark.createDataFrame([(i,) for i in range(1, 8)], "field int")
    present = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("field"))
    return R.missing(t(spark, d, "orders"), required, present, "o_orderkey", "field")


_TAGGED = f"(SELECT o_orderkey, grp, tag FROM orders JOIN {dims.values_sql([(i, g, x) for i, (g, x, _) in enumerate(dims.EXIF_TAGS)], 'i, grp, tag')} ON d.i = o_orderkey % {len(dims.EXIF_TAGS)})"


def _tagged(spark, d):
    rows = F.array(*[F.struct(F.lit(g).alias("grp"), F.lit(x).alias("tag")) for g, x, _ in dims.EXIF_TAGS])
    return t(spark, d, "orders").select("o_orderkey", F.get(rows, (F.col("o_orderkey") % len(dims.EXIF_TAGS)).cast("int")).alias("x")).select("o_orderkey", "x.*")


_PRIVATE = dims.values_sql([(g, x, dims.PRIVACY[f]) for g, x, f in dims.PRIVATE_TAGS], "grp, tag, flag")
_MASK = dims.PRIVACY["CameraModel"] | dims.PRIVACY["Timestamp"]


@query("jon_10_privacy_scrub", f"SELECT o_orderkey, x.grp, x.tag FROM {_TAGGED} x WHERE NOT EXISTS (SELECT 1 FROM {_PRIVATE} WHERE d.grp = x.grp AND d.tag = x.tag AND (d.flag & {_MASK}) <> 0)")
def jon_10(spark, d):
    return R.scrub(_tagged(spark, d), dims.private_tags(spark), ["grp", "tag"], _MASK)[0]


_COLOURS = [(0, 0, 0), (255, 255, 255), (255, 0, 0), (0, 255, 0), (0, 0, 255), (128, 128, 128), (255, 255, 0), (0, 128, 128)]


@query("jon_12_nearest_palette", f"""
    SELECT p_partkey, (SELECT arg_min(i, ((p_partkey % 256 - r) ** 2 + (p_size * 5 - g) ** 2 + (p_partkey * 7 % 256 - b) ** 2) * 100 + i) FROM {dims.values_sql([(i, *c) for i, c in enumerate(_COLOURS)], 'i, r, g, b')}) AS idx FROM part""")
def jon_12(spark, d):
    rows = t(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 256).alias("r"), (F.col("p_size") * 5).alias("g"), (F.col("p_partkey") * 7 % 256).alias("b"))
    return rows.select("p_partkey", R.nearest_colour(rows, _COLOURS, "r", "g", "b").alias("idx"))


# --- merges --------------------------------------------------------------------------------------


@query("agg_01_chunk_reassembly", "SELECT doc_id, md5(coalesce(text, '')) AS text_md5, length(coalesce(text, '')) AS n FROM documents")
def agg_01(spark, d):
    """Texts in pieces of 100 characters, every third one twice with a bad first copy, put together again; no text is one empty piece."""
    docs = t(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    pieces = docs.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), F.lit(100)), lambda i: F.substring(F.col("text"), i, F.lit(100)))).alias("seq", "data"))
    twice = pieces.withColumn("pos", F.lit(1)).unionByName(pieces.where("seq % 3 = 0").select("doc_id", "seq", F.lit("?").alias("data"), F.lit(0).alias("pos")))
    out = R.joined_in_order(twice, ["doc_id"], "seq", "data")
    return out.select("doc_id", F.md5(F.col("data").cast("binary")).alias("text_md5"), F.length("data").cast("long").alias("n"))


@query("agg_10_palette", "SELECT l_partkey % 997 AS colour, row_number() OVER (ORDER BY min(l_orderkey * 10 + l_linenumber), l_partkey % 997) - 1 AS idx FROM lineitem GROUP BY l_partkey % 997 ORDER BY idx LIMIT 256")
def agg_10(spark, d):
    rows = t(spark, d, "lineitem").select((F.col("l_partkey") % 997).alias("colour"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return R.palette(rows, "colour", "pos")


@query("agg_11_merged_gaps", """
    WITH x AS (SELECT user_id % 50 AS path, event_id AS s, event_id + 50 AS e, event_type = 'click' OR event_id % 3 = 0 AS free FROM (SELECT *, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS rn FROM events)),
    y AS (SELECT path, 50 * (row_number() OVER (PARTITION BY path ORDER BY s) - 1) AS s, free FROM x), z AS (SELECT *, s + 50 AS e, lag(free) OVER (PARTITION BY path ORDER BY s) AS before FROM y),
    i AS (SELECT *, sum(CASE WHEN free AND coalesce(before, false) THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY s) AS k FROM z)
    SELECT path, min(s) AS s, max(e) AS e, bool_or(free) AS free, count(*) AS spans FROM i GROUP BY path, k""")
def agg_11(spark, d):
    from pyspark.sql import Window

    place = 50 * (F.row_number().over(Window.partitionBy("path").orderBy("event_id")) - 1)
    rows = t(spark, d, "events").select((F.col("user_id") % 50).alias("path"), "event_id", ((F.col("event_type") == "click") | (F.col("event_id") % 3 == 0)).alias("f")).withColumn("s", place.cast("long")).withColumn("e", F.col("s") + 50)
    return R.merged_gaps(rows, "path", "s", "e", F.col("f")).select("path", "s", "e", "free", "spans")


# --- sequences -----------------------------------------------------------------------------------

_SORT = "l_linenumber, l_partkey, l_suppkey, l_quantity"


@query("win_01_predictor_encode", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (CAST(l_quantity AS BIGINT) - lag(CAST(l_quantity AS BIGINT), 1, 0) OVER (PARTITION BY l_orderkey ORDER BY {_SORT})) & 255 AS delta FROM lineitem")
def win_01(spark, d):
    rows = t(spark, d, "lineitem").withColumn("v", F.col("l_quantity").cast("long"))
    return R.predictor_encode(rows, ["l_orderkey"], _SORT.split(", "), "v").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "delta")


@query("win_02_predictor_decode", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS value FROM lineitem")
def win_02(spark, d):
    rows = R.predictor_encode(t(spark, d, "lineitem").withColumn("v", F.col("l_quantity").cast("long")), ["l_orderkey"], _SORT.split(", "), "v", 2)
    return R.predictor_decode(rows, ["l_orderkey"], _SORT.split(", "), 2).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "value")


@query("win_04_control_carry", """
    WITH x AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM events)
    SELECT user_id, event_id, c AS carried FROM (SELECT *, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id, g ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM x) WHERE event_type = 'purchase'""")
def win_04(spark, d):
    rows = R.carried(t(spark, d, "events"), "user_id", "event_id", F.when(F.col("event_type") == "click", F.col("value")), F.col("event_type") == "purchase")
    return rows.where("event_type = 'purchase'").select("user_id", "event_id", "carried")


@query("win_05_interlace", "SELECT l_suppkey % 40 + 9 AS h, y, row_number() OVER (PARTITION BY l_suppkey ORDER BY CASE WHEN y % 8 = 0 THEN 1 WHEN y % 8 = 4 THEN 2 WHEN y % 4 = 2 THEN 3 ELSE 4 END, y) - 1 AS place, l_suppkey FROM (SELECT s_suppkey AS l_suppkey FROM supplier), range(60) AS r(y) WHERE y < l_suppkey % 40 + 9")
def win_05(spark, d):
    rows = t(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_suppkey") % 40 + 9).alias("h"))
    rows = rows.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("h") - 1)))
    return rows.select("h", "y", R.interlaced(F.col("h"), F.col("y")).alias("place"), "l_suppkey")


@query("win_08_sequence_numbers", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS number FROM events")
def win_08(spark, d):
    from pyspark.sql import Window

    return t(spark, d, "events").select("user_id", "event_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long").alias("number"))


@query("srt_04_first_match", "SELECT o_custkey, arg_min(o_totalprice, o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS first_f FROM orders GROUP BY o_custkey")
def srt_04(spark, d):
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_totalprice", F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("first_f"))


@query("srt_06_language_choice", "SELECT doc_id, CASE WHEN lang = 'fr' THEN 'x-fr' WHEN lang = 'de' THEN 'x-de-AT' ELSE 'x-default' END || doc_id AS text FROM documents")
def srt_06(spark, d):
    text = lambda tag: F.concat(F.lit(f"x-{tag}" if tag != "x-default" else tag), F.col("doc_id").cast("string"))
    entry = lambda tag: F.struct(F.lit(tag).alias("lang"), text(tag).alias("text"))
    return t(spark, d, "documents").select("doc_id", R.language_choice(F.col("lang"), F.array(*map(entry, ("it", "de-AT", "fr-CA", "fr", "x-default")))).alias("text"))


# --- scalars -------------------------------------------------------------------------------------


@query("mth_01_rational_text", r"""
    WITH x AS (SELECT *, CASE WHEN l_linenumber = 3 THEN 1 ELSE CAST(round(l_extendedprice * 100) AS BIGINT) END AS n, CASE WHEN l_linenumber = 5 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS q FROM lineitem)
    SELECT l_orderkey, l_partkey, l_suppkey, n, q, CASE WHEN q = 0 OR (n = 1 AND q > 1) THEN n || '/' || q ELSE regexp_replace(regexp_replace(printf('%.4f', round(n / q, 4)), '0+$', ''), '\.$', '') END AS text FROM x""")
def mth_01(spark, d):
    rows = t(spark, d, "lineitem").withColumn("n", F.when(F.col("l_linenumber") == 3, 1).otherwise(F.round(F.col("l_extendedprice") * 100).cast("long"))).withColumn("q", F.when(F.col("l_linenumber") == 5, 0).otherwise(F.col("l_quantity").cast("long")))
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "n", "q", C.rational_text(F.col("n"), F.col("q")).alias("text"))


@query("mth_02_gps_degrees", "SELECT event_id, (CASE WHEN event_id % 2 = 0 THEN -1 ELSE 1 END) * (event_id % 90 + (event_id % 60) / 60 + (event_id % 5) / 3600) AS degrees FROM events")
def mth_02(spark, d):
    k = F.col("event_id")
    return t(spark, d, "events").select("event_id", C.dms_to_degrees(k % 90, k % 60, k % 5, F.when(k % 2 == 0, " s").otherwise("N")).alias("degrees"))


@query("mth_03_gps_parts", "WITH x AS (SELECT event_id, abs(value) AS v FROM events), y AS (SELECT event_id, v, floor(v) AS d, floor((v - floor(v)) * 60) AS m FROM x) SELECT event_id, CAST(d AS BIGINT) AS degrees, CAST(m AS BIGINT) AS minutes, CAST(round((v - d - m / 60) * 3600 * 10000) AS BIGINT) AS seconds_e4 FROM y")
def mth_03(spark, d):
    return t(spark, d, "events").select("event_id", C.degrees_to_dms(F.col("value")).alias("p")).select("event_id", "p.*")


@query("mth_05_altitude", "SELECT event_id, CASE WHEN event_id % 3 = 1 THEN -value ELSE value END AS altitude FROM events")
def mth_05(spark, d):
    return t(spark, d, "events").select("event_id", C.altitude(F.col("value"), F.col("event_id") % 3).alias("altitude"))


@query("mth_06_fixed_point", "SELECT o_orderkey, (CASE WHEN x >= 2147483648 THEN x - 4294967296 ELSE x END) / 65536 AS v FROM (SELECT o_orderkey, (o_orderkey * 2654435761) % 4294967296 AS x FROM orders)")
def mth_06(spark, d):
    return t(spark, d, "orders").select("o_orderkey", C.s15_fixed_16(F.col("o_orderkey") * 2654435761 % 4294967296).alias("v"))


@query("mth_10_ycbcr", "SELECT p_partkey, CAST(least(255, greatest(0, floor(y + 1.402::DOUBLE * (r - 128) + 0.5))) AS INTEGER) AS r, CAST(least(255, greatest(0, floor(y - 0.344136::DOUBLE * (b - 128) - 0.714136::DOUBLE * (r - 128) + 0.5))) AS INTEGER) AS g, CAST(least(255, greatest(0, floor(y + 1.772::DOUBLE * (b - 128) + 0.5))) AS INTEGER) AS b FROM (SELECT p_partkey, p_partkey % 256 AS y, p_partkey * 3 % 256 AS b, p_partkey * 5 % 256 AS r FROM part)")
def mth_10(spark, d):
    k = F.col("p_partkey")
    return t(spark, d, "part").select("p_partkey", C.ycbcr_to_rgb(k % 256, k * 3 % 256, k * 5 % 256).alias("c")).select("p_partkey", "c.*")


@query("mth_12_cmyk", "SELECT p_partkey, CASE WHEN k = 255 THEN 0 ELSE CAST(floor((255 - r - k) * 255.0::DOUBLE / (255 - k) + 0.5) AS INTEGER) END AS c, CASE WHEN k = 255 THEN 0 ELSE CAST(floor((255 - g - k) * 255.0::DOUBLE / (255 - k) + 0.5) AS INTEGER) END AS m, CASE WHEN k = 255 THEN 0 ELSE CAST(floor((255 - b - k) * 255.0::DOUBLE / (255 - k) + 0.5) AS INTEGER) END AS y, CAST(k AS INTEGER) AS k FROM (SELECT *, 255 - greatest(r, g, b) AS k FROM (SELECT p_partkey, p_partkey % 256 AS r, p_partkey * 3 % 256 AS g, p_partkey * 5 % 256 AS b FROM part))")
def mth_12(spark, d):
    k = F.col("p_partkey")
    return t(spark, d, "part").select("p_partkey", C.rgb_to_cmyk(k % 256, k * 3 % 256, k * 5 % 256).alias("x")).select("p_partkey", "x.*")


@query("mth_15_density", "SELECT p_partkey, CAST(CASE p_partkey % 3 WHEN 0 THEN floor(p_size / 2.54::DOUBLE + 0.5) WHEN 1 THEN floor(p_size * 2.54::DOUBLE + 0.5) ELSE p_size END AS BIGINT) AS density FROM part")
def mth_15(spark, d):
    k = F.col("p_partkey") % 3
    return t(spark, d, "part").select("p_partkey", C.density(F.col("p_size"), F.when(k == 1, 2).otherwise(1), F.when(k == 0, 2).otherwise(1)).alias("density"))


@query("mth_16_code_bits", "SELECT p_partkey, greatest(2, CAST(ceil(log2(p_partkey % 256 + 1)) AS INTEGER)) AS bits FROM part")
def mth_16(spark, d):
    return t(spark, d, "part").select("p_partkey", C.code_bits(F.col("p_partkey") % 256 + 1).alias("bits"))


@query("dat_01_iptc_dates", "SELECT event_id, strftime(ts, '%Y%m%d') AS date, strftime(ts, '%H%M%S') || '+0000' AS time FROM events")
def dat_01(spark, d):
    return t(spark, d, "events").select("event_id", C.iptc_date(F.col("ts")).alias("date"), C.iptc_time(F.col("ts")).alias("time"))


@query("dat_03_gps_instant", "SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS instant FROM events")
def dat_03(spark, d):
    at = C.gps_instant(F.date_format("ts", "yyyy:MM:dd"), F.hour("ts"), F.minute("ts"), F.second("ts") + F.lit(0.75))
    return t(spark, d, "events").select("event_id", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("instant"))


@query("dat_06_frame_delay", "SELECT event_id, (event_id % 70) / CASE WHEN event_id % 8 = 0 THEN 100 ELSE event_id % 8 END AS seconds FROM events")
def dat_06(spark, d):
    return t(spark, d, "events").select("event_id", C.frame_delay(F.col("event_id") % 70, F.col("event_id") % 8).alias("seconds"))


@query("str_01_ascii_text", "SELECT p_partkey, trim(p_name) AS text FROM part")
def str_01(spark, d):
    return t(spark, d, "part").select("p_partkey", C.ascii_text(F.concat(F.lit("  "), "p_name", F.lit(" \0\0"))).alias("text"))


@query("str_03_kept_characters", r"SELECT doc_id, md5(regexp_replace(text, '[^\pL\pN ]', '', 'g')) AS text_md5 FROM documents")
def str_03(spark, d):
    return t(spark, d, "documents").select("doc_id", F.md5(C.kept_characters(F.col("text"), r"\p{L}\p{N} ").cast("binary")).alias("text_md5"))


@query("str_05_utf16", "SELECT doc_id, md5(text) AS text_md5 FROM documents")
def str_05(spark, d):
    return t(spark, d, "documents").select("doc_id", F.md5(F.decode(F.encode("text", "UTF-16BE"), "UTF-16BE").cast("binary")).alias("text_md5"))


@query("str_07_signature", "SELECT p_partkey, left(rpad(p_brand, 4, ' '), 4) AS sign FROM part")
def str_07(spark, d):
    return t(spark, d, "part").select("p_partkey", C.signature(F.col("p_brand")).alias("sign"))


@query("bin_05_sub_blocks", "SELECT doc_id, CAST(ceil(strlen(text) / 255) AS INTEGER) AS blocks, md5(text) AS text_md5 FROM documents")
def bin_05(spark, d):
    blocks = C.framed_blocks(F.col("text").cast("binary"))
    return t(spark, d, "documents").select("doc_id", F.size(blocks).alias("blocks"), F.md5(F.aggregate(blocks, F.lit("").cast("binary"), lambda a, x: F.concat(a, x))).alias("text_md5"))


# --- codecs --------------------------------------------------------------------------------------

_SAME = "SELECT doc_id, md5(text) AS text_md5 FROM documents"


def _round_trip(name, encode, decode):
    @query(name, _SAME)
    def run(spark, d):
        rows = t(spark, d, "documents").withColumn("raw", F.col("text").cast("binary"))
        coded = M.convert(rows, "raw", encode, "coded")
        return M.convert(coded, "coded", decode, "plain").select("doc_id", F.md5("plain").alias("text_md5"))


_round_trip("cod_01_tiff_lzw", lambda x: codecs.Lzw.encode(x), lambda x: codecs.Lzw.decode(x))
_round_trip("cod_02_gif_lzw", lambda x: codecs.Lzw.encode(x, 8, False), lambda x: codecs.Lzw.decode(x, 8, False))
_round_trip("cod_03_packbits", lambda x: codecs.PackBits.encode(x), lambda x: codecs.PackBits.decode(x))
