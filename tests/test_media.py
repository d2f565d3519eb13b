"""Files on disk, streams of them, broken ones, and streamed codecs."""

import glob
import os
import tempfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.kernels import codecs, containers, tiff
from tessera.kernels.containers import Part
from tessera.plans import pixel_queries  # noqa: F401  registers
from tessera.plans.queries import QUERIES, packed
from tessera.sources import media, ranges, sinks
from tessera.streaming import media as streams


@pytest.fixture
def folder(tmp_path):
    png = containers.png_write([Part(0, -1, 0, "", "IHDR", 0, bytes(13)), Part(1, -1, 0, "", "tEXt", 0, b"k\0v"), Part(2, -1, 0, "", "IEND", 0, b"")])
    (tmp_path / "a.png").write_bytes(png)
    (tmp_path / "b.tif").write_bytes(tiff.write([tiff.Entry("IFD0", 271, 2, b"m\0")]))
    (tmp_path / "c.bin").write_bytes(b"neither")
    (tmp_path / "d.png").write_bytes(png[:20])
    (tmp_path / "large.png").write_bytes(png + bytes(5000))
    return tmp_path


def test_files_and_errors(spark, folder):
    files = media.read_media(spark, f"{folder}/*", max_bytes=4000)
    assert "LessThan" in files._jdf.queryExecution().toString() or files.count() == 4
    rows = {r.path[-5:]: r for r in media.parts(files).groupBy("path").agg(F.count("type").alias("n"), F.max("error").alias("e")).collect()}
    assert rows["a.png"].n == 3 and rows["a.png"].e is None
    assert rows["b.tif"].e and rows["c.bin"].e and rows["d.png"].n == 0
    tags = media.tags(files.where("path like '%b.tif'")).collect()
    assert [(t.tag, bytes(t.bytes)) for t in tags] == [(271, b"m\0")]


def test_compose_gives_the_file_back(spark, folder):
    files = media.read_media(spark, f"{folder}/a.png")
    again = sinks.compose(media.parts(files), "png").collect()[0]
    assert bytes(again.content) == (folder / "a.png").read_bytes()


def test_stream_of_files(spark, folder):
    stream = media.parts(streams.read_media_stream(spark, str(folder), "?.png"))
    query = stream.writeStream.format("memory").queryName("parts_seen").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.sql("SELECT count(type) AS n FROM parts_seen").first().n == 3


def test_codec_state_is_kept_between_batches(spark, tmp_path):
    plain = {i: bytes([i]) * 300 + bytes(range(200)) for i in range(4)}
    rows = []
    for i, data in plain.items():
        coded = codecs.PackBits.encode(data)
        cuts = [coded[j : j + 7] for j in range(0, len(coded), 7)]
        rows += [(i, k, bytearray(c), k == len(cuts) - 1) for k, c in enumerate(cuts)]
    half = sorted(rows, key=lambda r: r[1])
    schema = "stream_id int, seq long, data binary, last boolean"
    for name, part in (("1", half[: len(half) // 2]), ("2", half[len(half) // 2 :])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = streams.unpack_stream(stream).writeStream.format("memory").queryName("unpacked").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {}
    for r in spark.sql("SELECT * FROM unpacked").orderBy("stream_id", "seq").collect():
        got[r.stream_id] = got.get(r.stream_id, b"") + bytes(r.data)
    assert got == plain


class Steps:
    """Takes the place of a DataFrame: keeps the function of mapInArrow."""

    def __init__(self, schema):
        self.schema = schema

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def test_made_files_are_cut_by_bytes(spark):
    """A batch of 300 rows whose files have a megabyte each does not become 300 megabytes at once."""
    made = []

    def build(k):
        made.append(k)
        return bytes(1 << 20)

    run = packed(Steps(spark.createDataFrame([], "k long").schema), "k", ["k"], build)
    batch = pa.RecordBatch.from_arrays([pa.array(range(300))] * 2, names=["__key", "k"])
    batches = run(iter([batch]))
    first = next(batches)
    assert len(made) == first.num_rows <= 16
    assert [p for b in (first, *batches) for p in b.column("path").to_pylist()] == [str(k) for k in range(300)]


def test_results_are_cut_by_bytes(spark):
    """What mapped() makes of 200 rows of a batch is not held at once either, and the rows kept beside it stay with theirs."""
    made = []

    def kernel(k):
        made.append(k)
        if k == 7:
            raise ValueError("seven")
        return str(k), bytes(1 << 20)

    run = media.mapped(Steps(spark.createDataFrame([], "k long").schema), ["k"], kernel, "label string, content binary", ["k"])
    batch = pa.RecordBatch.from_arrays([pa.array(range(200))] * 2, names=["k0", "c0"])
    batches = run(iter([batch]))
    first = next(batches)
    assert len(made) == first.num_rows <= 16
    rows = [(r["k"], r["label"], r["error"]) for b in (first, *batches) for r in b.select(["k", "label", "error"]).to_pylist()]
    assert rows == [(k, None, "ValueError: seven") if k == 7 else (k, str(k), None) for k in range(200)]


def test_saved_files_go_when_they_are_read(spark, tmp_path):
    """One task, 20 files: the folder never holds more than the file that is being saved, and nothing in the end."""
    head = tiff.write([tiff.Entry("IFD0", 271, 2, b"m\0")])
    rows = packed(spark.range(20).coalesce(1), "id", [], lambda: head)
    folder = str(tmp_path)

    def pieces(content):
        yield content
        if len(os.listdir(folder)) > 1:
            raise AssertionError("files of other rows are there")
        yield bytes(1 << 20)

    found = ranges.scan_saved(rows, folder, pieces).collect()
    assert sorted(int(r.path) for r in found) == list(range(20))
    assert all((r.tag, r.text, r.error) == (271, "m", None) and r.read_bytes < 65536 for r in found)
    assert os.listdir(folder) == []


def test_lazy_tiff_leaves_no_files(spark):
    base = (spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.gettempdir()).removeprefix("file:")
    before = set(glob.glob(f"{base}/tessera-files-tiff-*"))
    rows = QUERIES["src_24_lazy_tiff"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.strip_unread for r in rows)
    made = set(glob.glob(f"{base}/tessera-files-tiff-*")) - before
    assert made and not any(os.listdir(x) for x in made)
