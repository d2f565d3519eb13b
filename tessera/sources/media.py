"""Media files as DataFrames: whole files, their parts and their tags.

A row is a file; parsing it needs nothing else, so it is a narrow step over Arrow batches.  A file that cannot be parsed
gives one row with an error instead of ending the job.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.kernels import carriers, containers, tiff

PART = "path string, seq int, parent int, depth int, kind string, type string, offset long, size long, payload binary, error string"
TAG = "path string, ifd string, tag int, type int, count long, ints array<long>, nums array<struct<num:long,den:long>>, floats array<double>, bytes binary, offset long, error string"
DATASET = "path string, seq int, record int, dataset int, value binary, error string"
RESOURCE = "path string, seq int, id int, name string, data binary, error string"
PROFILE_TAG = "path string, seq int, signature string, type string, data binary, error string"


#: What bytes that are not what they should be may raise in a kernel.
ERRORS = (containers.Malformed, ValueError, IndexError, KeyError, OverflowError, TypeError, struct.error, zlib.error)
#: Kernels by name for parts() and others to run instead of the known ones.
PARSERS: dict[str, Callable] = {}


def register_parser(kind: str, detect: Callable[[bytes], bool], parse: Callable[[bytes], Iterator]) -> None:
    """One more kind of container: files that detect() tells are read by parse(), before all known kinds."""
    PARSERS[kind] = (detect, parse)


def read_media(spark: SparkSession, glob: str, max_bytes: int | None = None) -> DataFrame:
    """(path, length, content); the ceiling is pushed to the scan, so larger files are not read."""
    files = spark.read.format("binaryFile").load(glob).select("path", "length", "content")
    return files.where(F.col("length") <= max_bytes) if max_bytes is not None else files


#: About so many bytes of results are one batch; a longer row is a batch of its own.
HELD, MOST_ROWS = 8 << 20, 4096


def values_of(batch: pa.RecordBatch, columns: list[str]) -> Iterator[tuple]:
    """Rows of some columns as Python's values, one at a time."""
    return zip(*((x.as_py() for x in batch.column(c)) for c in columns), strict=True) if columns else iter([()] * batch.num_rows)


def weight(value) -> int:
    """About the bytes that a value takes."""
    if isinstance(value, bytes | str):
        return len(value)
    if isinstance(value, dict):
        return weight(list(value.items()))
    return 8 + sum(map(weight, value)) if isinstance(value, list | tuple) else 8


def bounded(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches that are cut by bytes: what the rows of a batch make may be a thousand times as long as what they are made of."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row)
        if size >= HELD or len(held) >= MOST_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _rows(files: DataFrame, schema: str, kernel, **literals) -> DataFrame:
    """kernel(content) gives the columns between path and error for each row of a file."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    nothing = [None] * (len(arrow) - 2)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for path, content in values_of(batch, ["path", "content"]):
                try:
                    own = [(path, *row, None) for row in kernel(content, **literals)] if content is not None else []
                except ERRORS as e:
                    own = [(path, *nothing, f"{type(e).__name__}: {e}")]
                yield from own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return bounded(rows(batches), arrow)

    return files.select("path", "content").mapInArrow(run, schema)


def mapped(rows: DataFrame, columns: list[str], kernel: Callable, schema: str, keep: list[str] | None = None) -> DataFrame:
    """rows(keep) with one more row of kernel(*columns) each: a tuple of the schema's columns; a kernel that fails gives nulls and
    an error.  Batches are cut so that a task holds some rows' bytes at a time."""
    keep = ["path"] if keep is None else keep
    own = StructType.fromDDL(schema)
    out = StructType([*(rows.schema[c] for c in keep), *own.fields]).add("error", "string")
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for made in bounded(results(batch), pa.schema(list(arrow)[len(keep) :])):
                part = batch.slice(done, made.num_rows)
                done += made.num_rows
                yield pa.RecordBatch.from_arrays([*(part.column(f"k{i}").cast(arrow.field(i).type) for i in range(len(keep))), *made.columns], schema=arrow)

    def results(batch: pa.RecordBatch) -> Iterator[tuple]:
        for values in values_of(batch, [f"c{i}" for i in range(len(columns))]):
            try:
                yield *kernel(*values), None
            except ERRORS as e:
                yield *[None] * len(own), f"{type(e).__name__}: {e}"

    return rows.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), *(F.col(c).alias(f"c{i}") for i, c in enumerate(columns))).mapInArrow(run, out)


def parts(files: DataFrame, payload: bool = True) -> DataFrame:
    """Ordered parts of JPEG, PNG, GIF, RIFF, ISO base media and JPEG XL files; without payloads only places and sizes leave
    the workers."""
    more = dict(PARSERS)

    def rows(content: bytes):
        own = next((parse for test, parse in more.values() if test(content)), containers.parts)
        for p in own(content):
            yield p.seq, p.parent, p.depth, p.kind, p.type, p.offset, len(p.payload), p.payload if payload else None

    return _rows(files, PART, rows)


def _tags(content: bytes):
    block = content[6:] if content.startswith(b"Exif\0\0") else content
    entries, warnings = tiff.read(block)
    if not entries and warnings:
        raise ValueError(warnings[0])
    for e in entries:
        values = e.values
        ints = nums = numbers = raw = None
        if isinstance(values, bytes):
            raw = values
        elif e.type in (5, 10):
            nums = [{"num": a, "den": b} for a, b in values]
        elif e.type in (11, 12):
            numbers = values
        else:
            ints = values
        yield e.ifd, e.tag, e.type, len(values), ints, nums, numbers, raw, e.offset


def tags(files: DataFrame) -> DataFrame:
    """Entries of all directories of TIFF files and EXIF blocks."""
    return _rows(files, TAG, _tags)


def datasets(blocks: DataFrame) -> DataFrame:
    return _rows(blocks, DATASET, carriers.iptc_datasets)


def resources(blocks: DataFrame) -> DataFrame:
    return _rows(blocks, RESOURCE, carriers.resources)


def profile_tags(profiles: DataFrame) -> DataFrame:
    return _rows(profiles, PROFILE_TAG, carriers.icc_tags)


def first_part(kind: str, value: str = "payload", order: str = "seq") -> Column:
    """An aggregate: of a file's parts of a type the first one's value."""
    return F.min_by(value, F.when(F.col("type") == kind, F.col(order)))


def convert(rows: DataFrame, column: str, kernel, name: str, kind: str = "binary", error: str | None = None) -> DataFrame:
    """rows with name = kernel(column), batch by batch; nulls stay nulls, and what a kernel cannot read becomes null.  A column
    named by error says why."""
    arrow = {"binary": pa.binary(), "string": pa.string(), "long": pa.int64()}[kind]

    @F.arrow_udf(f"value {kind}, error string")
    def own(values: pa.Array) -> pa.Array:
        found, errors = [], []
        for v in values.to_pylist():
            try:
                found.append(None if v is None else kernel(v))
                errors.append(None)
            except ERRORS as e:
                found.append(None)
                errors.append(f"{type(e).__name__}: {e}")
        return pa.StructArray.from_arrays([pa.array(found, arrow), pa.array(errors, pa.string())], names=["value", "error"])

    made = f"__{name}_made"
    out = rows.withColumn(made, own(F.col(column))).withColumn(name, F.col(made)["value"])
    return (out.withColumn(error, F.col(made)["error"]) if error else out).drop(made)
