"""Composed files out of DataFrames."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.kernels import containers
from tessera.kernels.containers import Part

WRITERS = {"jpeg": containers.jpeg_write, "png": containers.png_write, "bmff": containers.box_write, "webp": lambda p: containers.riff_write("WEBP", p), "avi": lambda p: containers.riff_write("AVI ", p)}


def compose(parts: DataFrame, container: str) -> DataFrame:
    """(path, content): a file's parts, in order of seq, as a file of the container; checksums and sizes are made anew."""
    write = WRITERS[container]
    fields = ("seq", "parent", "depth", "kind", "type", "payload")
    files = parts.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("parts"))

    def run(batches):
        for batch in batches:
            out = [write([Part(p["seq"], p["parent"], p["depth"], p["kind"], p["type"], 0, p["payload"] or b"") for p in own]) for own in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(out, pa.binary())], names=["path", "content"])

    return files.mapInArrow(run, "path string, content binary")


def write_files(files: DataFrame, path: str) -> None:
    """Files as rows (path, content) of Parquet in any store that Spark writes to."""
    files.select("path", "content").write.mode("overwrite").parquet(path)
