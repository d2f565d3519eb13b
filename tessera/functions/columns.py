"""Scalar operators as column expressions; all run inside Spark's generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.kernels.containers import SIGNATURES


def starts(content: Column, mark: bytes, at: int = 0) -> Column:
    return F.substring(content, at + 1, len(mark)) == F.unhex(F.lit(mark.hex()))


def detect(content: Column) -> Column:
    """The format of a file's first bytes; null if none is known.  The first signature that fits decides."""
    out = F.lit(None).cast("string")
    for name, at, mark in reversed(SIGNATURES):
        fits = starts(content, mark, at) & starts(content, b"RIFF") if at == 8 else starts(content, mark, at)
        out = F.when(fits, name).otherwise(out)
    return out


def rational_text(num: Column, den: Column) -> Column:
    """num/den to four decimals without zeros at the end; 1/N stays, and so does what is divided by zero."""
    exact = F.format_string("%.4f", num.cast("double") / den.cast("double"))
    plain = F.regexp_replace(F.regexp_replace(exact, "0+$", ""), "\\.$", "")
    return F.when((den == 0) | ((num == 1) & (den > 1)), F.concat_ws("/", num.cast("string"), den.cast("string"))).otherwise(plain)


def dms_to_degrees(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    part = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    size = part(degrees) + part(minutes) / 60 + part(seconds) / 3600
    return F.when(F.upper(F.trim(ref)).isin("S", "W"), -size).otherwise(size)


def degrees_to_dms(value: Column) -> Column:
    """(degrees, minutes, seconds * 10000) of a signed angle; its sign goes to the reference letter."""
    size = F.abs(value)
    degrees = F.floor(size)
    minutes = F.floor((size - degrees) * 60)
    return F.struct(degrees.alias("degrees"), minutes.alias("minutes"), F.round((size - degrees - minutes / 60) * 3600 * 10000).cast("long").alias("seconds_e4"))


def altitude(value: Column, below: Column) -> Column:
    return F.when(below == 1, -value).otherwise(value)


def s15_fixed_16(raw: Column) -> Column:
    """A signed 32-bit fixed-point number from its unsigned bits."""
    return (F.when(raw >= 1 << 31, raw - (1 << 32)).otherwise(raw) / 65536.0).cast("double")


def _byte(x: Column) -> Column:
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor(x + 0.5))).cast("int")


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column) -> Column:
    return F.struct(_byte(y + 1.402 * (cr - 128)).alias("r"), _byte(y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128)).alias("g"), _byte(y + 1.772 * (cb - 128)).alias("b"))


def rgb_to_cmyk(r: Column, g: Column, b: Column) -> Column:
    """Plain subtraction with the black part taken out; each of 0 to 255."""
    k = 255 - F.greatest(r, g, b)
    part = lambda x: F.when(k == 255, 0).otherwise(F.floor((255 - x - k) * 255.0 / F.greatest(255 - k, F.lit(1)) + 0.5)).cast("int")
    return F.struct(part(r).alias("c"), part(g).alias("m"), part(b).alias("y"), k.cast("int").alias("k"))


def density(value: Column, unit: Column, to: Column) -> Column:
    """Between dots an inch (unit 1) and a centimetre (2)."""
    return F.when((unit == 1) & (to == 2), F.floor(value / 2.54 + 0.5)).when((unit == 2) & (to == 1), F.floor(value * 2.54 + 0.5)).otherwise(value).cast("long")


def code_bits(colours: Column) -> Column:
    """Bits of a GIF code for so many colours, two at least."""
    return F.greatest(F.lit(2), F.ceil(F.log2(F.greatest(colours, F.lit(1)).cast("double")))).cast("int")


def frame_delay(num: Column, den: Column) -> Column:
    """Seconds of an animation frame; a denominator of zero is a hundred."""
    return num / F.when(den == 0, 100).otherwise(den)


def ascii_text(text: Column) -> Column:
    """Text of a field: up to trailing NULs, then trimmed."""
    return F.trim(F.regexp_replace(text, "\\x00+$", ""))


def kept_characters(text: Column, classes: str = r"\p{L}\p{N}\p{M}\p{S}\p{P}\r\n ") -> Column:
    """Only characters of the classes stay."""
    return F.regexp_replace(text, f"[^{classes}]", "")


def signature(text: Column) -> Column:
    return F.substring(F.rpad(text, 4, " "), 1, 4)


def until_nul(text: Column) -> Column:
    return F.substring_index(text, "\0", 1)


def iptc_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd")


def iptc_time(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "HHmmss"), F.lit("+0000"))


def gps_instant(date: Column, hour: Column, minute: Column, second: Column) -> Column:
    """A UTC instant of a date stamp with colons and three numbers; seconds lose their fraction."""
    return F.try_to_timestamp(F.format_string("%s %02d:%02d:%02d", date, hour.cast("long"), minute.cast("long"), F.floor(second).cast("long")), F.lit("yyyy:MM:dd HH:mm:ss"))


def framed_blocks(data: Column, size: int = 255) -> Column:
    """data as an array of blocks of size bytes at most."""
    starts_at = F.when(F.length(data) > 0, F.sequence(F.lit(1), F.length(data), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts_at, lambda i: F.substring(data, i, F.lit(size)))
