"""Registered queries of scalars over bytes, dates, colours and curves, and of the merges that are left."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.plans.queries import query, t
from tessera.sources import media as M


def big(content, at: int, size: int):
    """An unsigned big-endian number at a place that counts from 0."""
    return F.conv(F.hex(F.substring(content, at + 1, size)), 16, 10).cast("long")


def little(content, at: int, size: int):
    return F.conv(F.concat(*[F.hex(F.substring(content, at + 1 + i, 1)) for i in reversed(range(size))]), 16, 10).cast("long")


def bytes_of(number, size: int):
    """A number as size big-endian bytes."""
    return F.unhex(F.lpad(F.hex(number), 2 * size, "0"))


@query("bin_02_integers", "SELECT o_orderkey, o_orderkey * 7919 % 4294967296 AS be32, o_orderkey % 65536 AS be16, (o_orderkey % 256) * 256 + (o_orderkey // 256) % 256 AS le16 FROM orders")
def bin_02(spark, d):
    key = F.col("o_orderkey")
    raw = F.concat(bytes_of(key * 7919 % 4294967296, 4), bytes_of(key % 65536, 2))
    rows = t(spark, d, "orders").select("o_orderkey", raw.alias("raw"))
    return rows.select("o_orderkey", big("raw", 0, 4).alias("be32"), big("raw", 4, 2).alias("be16"), little("raw", 4, 2).alias("le16"))


@query("bin_03_bit_reversal", "SELECT p_partkey, list_sum(list_transform(range(0, 8), lambda i: ((p_partkey % 256) >> i & 1) << (7 - i))) AS reversed, (p_partkey % 256) >> 4 AS high, (p_partkey % 256) & 15 AS low FROM part")
def bin_03(spark, d):
    v = F.col("p_partkey") % 256
    bits = sum((F.shiftleft(F.shiftright(v, i).bitwiseAND(1), 7 - i) for i in range(8)), F.lit(0))
    return t(spark, d, "part").select("p_partkey", bits.cast("decimal(38,0)").alias("reversed"), F.shiftright(v, 4).alias("high"), v.bitwiseAND(15).alias("low"))


@query("bin_06_patch", "SELECT doc_id, md5(left(lang || '----', 4) || 'PATCH' || substr(lang || '----------', 10)) AS patched_md5 FROM documents")
def bin_06(spark, d):
    raw = F.concat("lang", F.lit("----------")).cast("binary")
    return t(spark, d, "documents").select("doc_id", F.md5(F.overlay(raw, F.lit("PATCH").cast("binary"), 5)).alias("patched_md5"))


@query("bin_07_deflate", "SELECT doc_id, md5(text) AS text_md5 FROM documents")
def bin_07(spark, d):
    """Deflate, and inflate under a ceiling."""
    from tessera.kernels.containers import inflate

    rows = t(spark, d, "documents").withColumn("raw", F.col("text").cast("binary"))
    coded = M.convert(rows, "raw", zlib.compress, "coded")
    return M.convert(coded, "coded", lambda x: inflate(x, 16 << 20), "plain").select("doc_id", F.md5("plain").alias("text_md5"))


@query("str_06_unicode_string", "SELECT p_partkey, p_name AS text, length(p_name) AS units FROM part")
def str_06(spark, d):
    raw = F.concat(bytes_of(F.length("p_name"), 4), F.encode("p_name", "UTF-16BE"), F.lit("tail").cast("binary"))
    rows = t(spark, d, "part").select("p_partkey", raw.alias("raw"))
    n = big("raw", 0, 4)
    return rows.select("p_partkey", F.decode(F.substring(F.col("raw"), F.lit(5), (2 * n).cast("int")), "UTF-16BE").alias("text"), n.alias("units"))


@query("str_08_until_nul", "SELECT p_partkey, p_brand AS text FROM part")
def str_08(spark, d):
    return t(spark, d, "part").select("p_partkey", C.until_nul(F.concat("p_brand", F.lit("\0"), "p_name")).alias("text"))


@query("dat_04_iso_dates", "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS instant FROM events")
def dat_04(spark, d):
    """ISO dates; what is none becomes null."""
    text = F.when(F.col("event_id") % 7 == 0, F.lit("not a date")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return t(spark, d, "events").select("event_id", F.date_format(F.try_to_timestamp(text), "yyyy-MM-dd'T'HH:mm:ss").alias("instant"))


@query("dat_05_profile_date", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created FROM events")
def dat_05(spark, d):
    """Six 16-bit numbers of a header as an instant."""
    parts = [bytes_of(f("ts").cast("long"), 2) for f in (F.year, F.month, F.dayofmonth, F.hour, F.minute, F.second)]
    rows = t(spark, d, "events").select("event_id", F.concat(*parts).alias("raw"))
    at = F.make_timestamp(*[big("raw", 2 * i, 2).cast("int") for i in range(6)])
    return rows.select("event_id", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("created"))


@query("dat_08_info_dates", "SELECT event_id, strftime(ts, '%Y%m%d') AS iptc, strftime(ts, '%Y-%m-%d') AS iso FROM events")
def dat_08(spark, d):
    iptc = F.regexp_replace(F.date_format("ts", "yyyy-MM-dd"), "^(\\d{4})-(\\d{2})-(\\d{2})$", "$1$2$3")
    return t(spark, d, "events").select("event_id", iptc.alias("iptc"), F.regexp_replace(iptc, "^(\\d{4})(\\d{2})(\\d{2})$", "$1-$2-$3").alias("iso"))


@query("mth_13_half_floats", "SELECT p_partkey, CASE WHEN e = 0 THEN m * pow(2.0::DOUBLE, -24) WHEN e = 31 THEN NULL ELSE (1024 + m) * pow(2.0::DOUBLE, e - 25) END * CASE WHEN h >= 32768 THEN -1 ELSE 1 END AS v FROM (SELECT p_partkey, h, h // 1024 % 32 AS e, h % 1024 AS m FROM (SELECT p_partkey, p_partkey * 31337 % 65536 AS h FROM part))")
def mth_13(spark, d):
    """Half floats with subnormals; infinities and NaNs are null."""
    h = F.col("p_partkey") * 31337 % 65536
    e, m = F.floor(h / 1024) % 32, h % 1024
    size = F.when(e == 0, m * 2.0**-24).when(e == 31, None).otherwise((1024 + m) * F.pow(F.lit(2.0), e - 25))
    return t(spark, d, "part").select("p_partkey", (size * F.when(h >= 32768, -1).otherwise(1)).alias("v"))


@query("win_07_inverse_table", "SELECT p_partkey, (SELECT arg_min(i, abs(i * i - (p_partkey % 961)) * 100 + i) FROM range(32) AS r(i)) AS nearest FROM part")
def win_07(spark, d):
    """The sample of a rising table that is nearest, the lower of equals; the table is a literal."""
    table = F.array(*[F.lit(i * i) for i in range(32)])
    near = F.array_min(F.transform(table, lambda v, i: F.struct(F.abs(v - F.col("p_partkey") % 961).alias("d"), i.cast("long").alias("i"))))
    return t(spark, d, "part").select("p_partkey", near["i"].alias("nearest"))
