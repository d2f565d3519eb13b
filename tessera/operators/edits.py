"""Reads and changes of whole files as DataFrame steps: narrow, a file needs no other one, and a file that fails is a row with an
error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.kernels import files, meta, xmp
from tessera.sources import media


def carrier(rows: DataFrame, name: str) -> DataFrame:
    """(path, value, error): a carrier's bytes of rows(path, content)."""
    return media.mapped(rows, ["content"], lambda x: (files.get(x, name),), "value binary")


def with_carrier(rows: DataFrame, name: str, value: str | None) -> DataFrame:
    """(path, content, error): files with a carrier set to a column's bytes; null, or no column, removes it."""
    columns = ["content"] + ([value] if value else [])
    return media.mapped(rows, columns, lambda x, v=None: (files.put(x, name, v),), "content binary")


def with_exif(rows: DataFrame, values: str) -> DataFrame:
    """(path, content, known, error): files with EXIF fields set by name from a column of structs of texts and numbers; a null
    field is removed, known tells which names there are."""

    def run(content, fields):
        block, known = meta.exif_set(files.get(content, "exif"), fields)
        return (block if content[:4] in (b"II*\0", b"MM\0*") else files.put(content, "exif", block)), known

    return media.mapped(rows, ["content", values], run, "content binary, known map<string,boolean>")


def exif_texts(rows: DataFrame) -> DataFrame:
    """(path, texts, error): EXIF fields by name as people read them."""

    def run(content):
        block = files.get(content, "exif")
        return (meta.exif_texts(block) if block else {},)

    return media.mapped(rows, ["content"], run, "texts map<string,string>")


def with_datasets(rows: DataFrame, values: str) -> DataFrame:
    """(path, content, error): files with IPTC datasets set from a column map<string, array<string>>; an empty list removes."""

    def run(content, fields):
        sets = meta.iptc_rows(files.get(content, "iptc"))
        for name, own in fields:
            sets = meta.iptc_set(sets, name, own or None)
        return (files.put(content, "iptc", meta.carriers.iptc_write(sets)),)

    return media.mapped(rows, ["content", values], run, "content binary")


def with_properties(rows: DataFrame, values: str) -> DataFrame:
    """(path, content, error): files with XMP properties set from a column of structs; null fields are removed."""

    def run(content, fields):
        packet = files.get(content, "xmp")
        return (files.put(content, "xmp", xmp.edit(packet.decode("utf-8", "replace") if packet else None, fields).encode()),)

    return media.mapped(rows, ["content", values], run, "content binary")


def scrubbed(rows: DataFrame, types: int = -1) -> DataFrame:
    """(path, content, removed, error): files without what the privacy flags name, and how much went by carrier."""
    return media.mapped(rows, ["content"], lambda x: meta.scrub(x, types), "content binary, removed map<string,int>")


def problems(rows: DataFrame, types: int = -1) -> DataFrame:
    """(path, carrier, field, category, message): a row for each departure; files without any have none."""
    made = media.mapped(rows, ["content"], lambda x: ([dict(zip(("carrier", "field", "category", "message"), p, strict=True)) for p in meta.problems(x, types)],), "p array<struct<carrier:string,field:string,category:int,message:string>>")
    return made.select("path", F.explode("p").alias("p")).select("path", "p.*")


def conformed(rows: DataFrame, types: int = meta.SAFE) -> DataFrame:
    """(path, content, mended, error)."""
    return media.mapped(rows, ["content"], lambda x: meta.conform(x, types), "content binary, mended int")


def info(rows: DataFrame) -> DataFrame:
    """(path, the 22 fields, error): texts, and two lists of texts."""
    kinds = ", ".join(f"{f} {'array<string>' if f in meta.INFO_LISTS else 'string'}" for f in meta.INFO_FIELDS)

    def run(content):
        own = meta.info(content)
        return tuple(own.get(f) for f in meta.INFO_FIELDS)

    return media.mapped(rows, ["content"], run, kinds)


def with_info(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(path, content, error): files with the named columns written to all carriers as fields of the merged view."""
    return media.mapped(rows, ["content", *fields], lambda x, *v: (meta.apply_info(x, dict(zip(fields, v, strict=True))),), "content binary")


def facts(rows: DataFrame) -> DataFrame:
    """(path, format, width, height, carriers, thumbnail bytes, trailing bytes, error) of files."""

    def run(content):
        wide = files.size(content) or (None, None)
        have = [c for c in files.CARRIERS if files.get(content, c) is not None]
        thumb = files.thumbnail(content)
        return files.containers.detect(content), *wide, have, len(thumb) if thumb else 0, len(files.trailing(content))

    return media.mapped(rows, ["content"], run, "format string, width long, height long, carriers array<string>, thumbnail long, trailing long")
