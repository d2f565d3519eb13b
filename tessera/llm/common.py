"""What the text operators share: scratch tables, byte views of Arrow text, Rice coding, components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session has them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  On one machine, where it may be unset, a temporary one."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if context.applicationId not in _LOCAL:
            keep = tempfile.TemporaryDirectory(prefix="tessera-")
            atexit.register(keep.cleanup)
            _LOCAL[context.applicationId] = keep.name
        base = f"file://{_LOCAL[context.applicationId]}"
    return f"{base}/tessera-{context.applicationId}"


_WRITTEN: list[list[str]] = []  # the folders of each open scope()
_TABLES: dict[str, str] = {}  # the catalog's names of folders that have one


def new_folder(spark: SparkSession, name: str, outer: bool = False) -> str:
    """A new path in the shared folder; it goes with the innermost scope() (outer: the one around it), else with the session."""
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    if len(_WRITTEN) > outer:
        _WRITTEN[-1 - outer].append(path)
    return path


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders that nothing reads any more."""
    for path in paths:
        if path in _TABLES:
            spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop(path)}")
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scope(spark: SparkSession):
    """What is written inside goes at the end, so a result must have been written to the outer scope by then."""
    _WRITTEN.append([])
    try:
        yield
    finally:
        discard(spark, _WRITTEN.pop())
        spark.sparkContext._jvm.System.gc()  # shuffle files go when the driver's garbage does


def materialise(df: DataFrame, name: str, outer: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it again: its rows are fixed and its lineage is cut."""
    spark = df.sparkSession
    path = new_folder(spark, name, outer)
    df.write.option("compression", "zstd").parquet(path)
    spark.sparkContext._jvm.System.gc()  # the shuffle files of what has been written go when the driver's garbage does
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df written once, with rid, a number for each row, and part, the task that wrote it.

    Numbers taken twice over a plan that deals its rows anew would name other rows; written ones stay.  The table is in buckets
    of part, so where() below meets its rows by number without moving them.  df must not have columns of these names."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    table_name = _TABLES[path] = f"tessera_{uuid.uuid4().hex}"
    rows = df.withColumn("rid", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id())
    buckets = min(width(spark), 100_000)
    rows.write.option("compression", "zstd").option("path", path).format("parquet").bucketBy(buckets, "part").saveAsTable(table_name)
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")  # a join by (part, rid) may use buckets of part
    return spark.table(table_name)


def by_number(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """numbered() rows joined with ids(rid, ..), which are sent to the buckets; the rows stay where they are."""
    there = ids.withColumn("part", F.shiftright("rid", 33).cast("int"))
    return rows.join(there.hint("shuffle_hash"), ["part", "rid"], how)


def wrapped(docs: DataFrame) -> DataFrame:
    """All columns of docs as one struct, `row`: no name can clash with those that an operator adds."""
    return docs.select(F.struct("*").alias("row"))


def crc_of_id(column: str = "doc_id") -> Column:
    """Unsigned crc32 of an id's decimal text; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


_HELD: dict[object, object] = {}


def held(key, make):
    """What a worker process keeps between tasks: one thing at a time, as workers serve one operator after another."""
    if key not in _HELD:
        let_go()
        _HELD[key] = make()
    return _HELD[key]


def let_go() -> None:
    """Frees what another operator has left in this worker process."""
    if _HELD:
        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries keep what is free
            ctypes.CDLL("libc.so.6").malloc_trim(0)


# --- byte views ------------------------------------------------------------------------------


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that their texts hold about limit bytes (one longer text stays whole); null texts read as empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(text)
        column = batch.column(at)
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
        batch = batch.set_column(at, text, column)
        ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < batch.num_rows:
            base = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(first, last - first)
            first = last


def view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text array without nulls, and len + 1 offsets into them that begin at 0."""
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if not len(texts) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An Arrow text array over bytes that are not copied; rows are offsets[i]:offsets[i + 1]."""
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


#: The white space of ASCII: \t \n \v \f \r and space.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def lower_ascii(texts: pa.Array) -> pa.Array:
    return pc.ascii_lower(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes start .. start + length of each pair, one after another."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


# --- Golomb-Rice coding ----------------------------------------------------------------------


def rice_encode(values: np.ndarray, low: int, span: int) -> tuple[int, bytes]:
    """Sorted uint64 values of [low, low + span] as Rice-coded gaps: the parameter, and unary quotients then k-bit rests."""
    gaps = np.diff(values, prepend=np.uint64(low))
    mean = span / max(1, len(values))
    k = min(63, max(0, int(np.log2(max(1.0, mean * 0.69)))))
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    ones = np.cumsum(quotients + 1) - 1
    unary = np.zeros(int(ones[-1]) + 1 if len(ones) else 0, bool)
    unary[ones] = True
    shifts = np.arange(k - 1, -1, -1, dtype=np.uint64)
    rests = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel()
    return k, np.packbits(unary).tobytes() + np.packbits(rests).tobytes()


def rice_decode(blob: bytes, k: int, count: int, low: int) -> np.ndarray:
    if not count:
        return np.zeros(0, np.uint64)
    rest_bytes = (count * k + 7) // 8
    raw = np.frombuffer(blob, np.uint8)
    ones = np.flatnonzero(np.unpackbits(raw[: len(raw) - rest_bytes]))[:count]
    quotients = np.diff(ones, prepend=-1).astype(np.uint64) - np.uint64(1)
    rests = np.zeros(count, np.uint64)
    if k:
        bits = np.unpackbits(raw[len(raw) - rest_bytes :])[: count * k].reshape(count, k)
        for j in range(k):
            rests = (rests << np.uint64(1)) | bits[:, j].astype(np.uint64)
    return np.cumsum((quotients << np.uint64(k)) | rests, dtype=np.uint64) + np.uint64(low)


# --- connected components --------------------------------------------------------------------


AT_ONCE = 1 << 19


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's edges as stars around the smallest id of each local component."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := up.setdefault(x, x)) != x:
            up[x] = x = up[p]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if (ra := root(a)) != (rb := root(b)):
                up[max(ra, rb)] = min(ra, rb)
    pairs = [(x, root(x)) for x in list(up) if root(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id of edges(a, b), both long; component is the smallest id reachable.

    Partition-local union-find first leaves fewer edges than ids.  While more than AT_ONCE edges are left, large-star and
    small-star steps (each a group minimum and a join, written out) go on until the stars stay as they are; so many or
    fewer are joined by one task, whose memory that number bounds."""
    stars = materialise(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").mapInArrow(_forest, "u long, v long"), "forest")
    before, small_enough = None, stars.count() <= AT_ONCE
    if small_enough:
        stars = materialise(stars.coalesce(1).mapInArrow(_forest, "u long, v long"), "stars")
    while not small_enough:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("u", "v", "m")
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        stars = materialise(small, "stars")
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = stars.select(F.col("v").alias("id")).distinct()
    return stars.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
