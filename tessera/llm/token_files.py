"""Token files under one canonical, length-limited Huffman code.

The ids are counted over the whole corpus, package-merge gives code lengths of at most `limit` bits, and canonical codes
follow from the lengths alone.  A file is a folder of Parquet rows, each an independent block: ids and lengths of its
documents, the bit offset of every segment of SEGMENT tokens (a checkpoint; each document begins one), and the bits.
Blocks are in ascending doc_id order within and across the numbered ranges.  A reader needs the code lengths and any block.

Decoding looks `limit` bits up in one table and steps through all segments of a block side by side.

Defined cases: null text is an empty document (the end id alone); null ids come first; rows of one id are all kept, by
their text's hash; an empty table writes no block; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise, new_folder, ragged, scope, slices, width
from tessera.llm.pieces import encoder, open_tokenizer, tokenizer_path

TOKENIZER = "word_bpe_49k.json"
SEGMENT = 256
BLOCK_TOKENS = 1 << 20
BLOCK = "range int, seq int, n_docs int, n_tokens long, doc_ids binary, null_ids int, lengths binary, checkpoints binary, bits binary"


# --- the code --------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of an optimal prefix code of at most limit bits (package-merge); 0 where the count is 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) == 1:
        lengths[used] = 1
    if len(used) < 2:
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols do not fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights, n = counts[order].astype(np.float64), len(used)
    kept, layer = [], weights
    for _ in range(limit - 1):
        half = len(layer) // 2
        packages = layer[: 2 * half].reshape(half, 2).sum(1)
        merged = np.concatenate([weights, packages])
        by = np.argsort(merged, kind="stable")
        kept.append(by < n)  # whether each item of the merged layer is a leaf
        layer = merged[by]
    take, depth = 2 * n - 2, np.zeros(n, np.int64)
    for leaf in reversed(kept):
        leaves = int(leaf[:take].sum())
        depth[:leaves] += 1
        take = 2 * (take - leaves)
    depth[:take] += 1
    lengths[order] = depth
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by (length, id): each is the one before plus one, shifted to its own length."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes = np.zeros(len(lengths), np.uint64)
    if len(order):
        long = lengths[order].astype(np.int64)
        top = int(long.max())
        steps = (1 << (top - long)).astype(np.uint64)  # in units of the longest code
        codes[order] = (np.cumsum(steps) - steps) >> (top - long).astype(np.uint64)
    return codes


def pack_bits(ids: np.ndarray, at: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The documents' codes (ids[at[i]:at[i + 1]]), each from a whole byte; byte offsets of documents; bit offsets of tokens."""
    size = lengths[ids].astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(size)])
    doc_bytes = (np.diff(ends[at]) + 7) // 8
    begin = np.concatenate([[0], np.cumsum(doc_bytes)])
    position = ends[:-1] + np.repeat(8 * begin[:-1] - ends[at[:-1]], np.diff(at))
    words = np.zeros(int(begin[-1]) // 4 + 3, np.uint32)
    if len(ids):
        value = codes[ids] << (64 - (position & 31) - size).astype(np.uint64)
        word = position >> 5
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[first]] |= np.bitwise_or.reduceat((value >> np.uint64(32)).astype(np.uint32), first)
        words[word[first] + 1] |= np.bitwise_or.reduceat(value.astype(np.uint32), first)
    return words.astype(">u4").tobytes()[: int(begin[-1])], begin, position


def lookup(lengths: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Bits to look up, and for each value of them the id and its code's length."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    bits = int(lengths.max(initial=1)) if len(lengths) else 1
    spans = 1 << (bits - lengths[order].astype(np.int64))
    ids, sizes = np.zeros(1 << bits, np.uint32), np.ones(1 << bits, np.uint8)
    total = int(spans.sum())
    ids[:total], sizes[:total] = np.repeat(order, spans), np.repeat(lengths[order], spans)
    return bits, ids, sizes


def unpack_bits(raw: bytes, checkpoints: np.ndarray, counts: np.ndarray, code) -> np.ndarray:
    """The ids of segments that begin at bit offsets, counts tokens each, one after another."""
    bits, ids, sizes = code
    data = np.frombuffer(raw + bytes(8), np.uint8).astype(np.uint32)
    windows = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]  # 32 bits from each byte; codes have 24 at most
    out = np.zeros(int(counts.sum()), np.uint32)
    order = np.argsort(-counts, kind="stable")
    position, left = checkpoints[order].astype(np.int64), counts[order]
    place = (np.cumsum(counts) - counts)[order]
    shift = np.uint32(32 - bits)
    alive = np.searchsorted(-left, -np.arange(1, (int(left[0]) if len(left) else 0) + 1), side="right")
    for step, n in enumerate(alive):
        p = position[:n]
        key = (windows[p >> 3] << (p & 7).astype(np.uint32)) >> shift
        out[place[:n] + step] = ids[key]
        position[:n] = p + sizes[key]
    return out


# --- Spark -----------------------------------------------------------------------------------


def _tokenise(path: str, end_id: int, size: int):
    kind = "<u2" if size <= 1 << 16 else "<u4"

    def run(batches):
        encode, counts = encoder(path), np.zeros(size, np.int64)
        for batch in slices(batches, "text", 6 << 20):
            ids, at = encode(batch.column("text"))
            at = at + np.arange(len(at))  # room for the end ids
            inside = np.ones(int(at[-1]), bool)
            inside[at[1:] - 1] = False
            own = np.full(len(inside), end_id, kind)
            own[inside] = ids
            counts += np.bincount(own, minlength=size)
            raw = own.tobytes()
            del ids, own, inside
            step = np.dtype(kind).itemsize
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(at)), pa.array([raw[a * step : b * step] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())],
                names=["doc_id", "n", "ids"],
            )
            pa.default_memory_pool().release_unused()
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(-counts[some]), pa.nulls(len(some), pa.binary())], names=["doc_id", "n", "ids"])

    return run


def _every(n: np.ndarray) -> np.ndarray:
    """Positions, in documents of n tokens in a row, of every SEGMENT-th token of each."""
    per = -(-n // SEGMENT)
    return ragged(np.zeros(len(n), np.int64), per) * SEGMENT + np.repeat(np.cumsum(n) - n, per)


def _encode(code, kind: str, edges: np.ndarray):
    """Documents as bits, with the number of the range between sorted edges that their id is in; null ids are in the first."""

    def run(batches):
        lengths = code.value
        codes = canonical(lengths)
        for batch in slices(batches, "ids", 2 << 20):
            n = batch.column("n").to_numpy()
            ids = np.frombuffer(b"".join(batch.column("ids").to_pylist()), kind)
            at = np.concatenate([[0], np.cumsum(n)])
            raw, begin, position = pack_bits(ids, at, codes, lengths)
            per = -(-n // SEGMENT)
            marks = position[_every(n)] - np.repeat(8 * begin[:-1], per)
            cut = [0, *np.cumsum(per).tolist()]
            marks = marks.astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.searchsorted(edges, batch.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy()), pa.int32()),
                    batch.column("doc_id"),
                    batch.column("n"),
                    pa.array([marks[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                    pa.array([raw[a:b] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)], pa.binary()),
                ],
                names=["range", "doc_id", "n", "marks", "bits"],
            )

    return run


def _blocks(block_tokens: int):
    """Documents in order become blocks."""

    def run(batches):
        seq, held, tokens, of = {}, [], 0, None

        def block():
            ids, n, marks, bits = (pa.concat_arrays([h.column(c) for h in held]) if len(held) > 1 else held[0].column(c) for c in ("doc_id", "n", "marks", "bits"))
            n = n.to_numpy()
            parts = bits.to_pylist()
            begin = 8 * np.concatenate([[0], np.cumsum([len(p) for p in parts])])[:-1]
            raw = b"".join(parts)
            marks = np.frombuffer(b"".join(marks.to_pylist()), "<u4") + np.repeat(begin, -(-n // SEGMENT))
            seq[of] = seq.get(of, -1) + 1
            return pa.RecordBatch.from_pydict(
                {"range": [of], "seq": [seq[of]], "n_docs": [len(n)], "n_tokens": [int(n.sum())], "doc_ids": [ids.fill_null(0).to_numpy().astype("<i8").tobytes()], "null_ids": [ids.null_count], "lengths": [n.astype("<u4").tobytes()], "checkpoints": [marks.astype("<u4").tobytes()], "bits": [raw]},
                pa.schema([("range", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.binary()), ("null_ids", pa.int32()), ("lengths", pa.binary()), ("checkpoints", pa.binary()), ("bits", pa.binary())]),
            )

        for batch in batches:
            ranges = batch.column("range").to_numpy()
            n = batch.column("n").to_numpy()
            a = 0
            while a < batch.num_rows:
                if held and ranges[a] != of:
                    yield block()
                    held, tokens = [], 0
                of = int(ranges[a])
                same = int(np.searchsorted(ranges, of, side="right"))
                b = min(same, a + int(np.searchsorted(np.cumsum(n[a:same]), block_tokens - tokens)) + 1)
                held.append(batch.slice(a, b - a))
                tokens += int(n[a:b].sum())
                if tokens >= block_tokens:
                    yield block()
                    held, tokens = [], 0
                a = b
        if held:
            yield block()

    return run


def _read(code, digest: bool = False):
    def run(batches):
        table = lookup(code.value)
        for batch in batches:
            for row in batch.to_pylist():
                n = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
                per = -(-n // SEGMENT)
                counts = np.full(int(per.sum()), SEGMENT, np.int64)
                last = np.cumsum(per) - 1
                counts[last[n > 0]] = (n - (per - 1) * SEGMENT)[n > 0]
                ids = unpack_bits(row["bits"], np.frombuffer(row["checkpoints"], "<u4").astype(np.int64), counts, table).astype("<u4")
                at = np.concatenate([[0], np.cumsum(n)])
                doc_ids = np.frombuffer(row["doc_ids"], "<i8")
                mask = np.arange(len(n)) < row["null_ids"]
                spans = zip(at[:-1].tolist(), at[1:].tolist(), strict=True)
                own = pa.array([zlib.crc32(ids[a:b]) for a, b in spans], pa.int64()) if digest else pa.array([ids[a:b].tobytes() for a, b in spans], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=mask), pa.array(at[:-1] + row["base"]), pa.array(n), own], names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    return run


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end_id: int = 1, block_tokens: int = BLOCK_TOKENS) -> None:
    """Encodes docs and writes path/code (id, length) and path/blocks in ascending id order."""
    spark = docs.sparkSession
    file = tokenizer_path(tokenizer)
    size = max(open_tokenizer(file).get_vocab_size(), end_id + 1)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tokens = materialise(rows.mapInArrow(_tokenise(file, end_id, size), "doc_id long, n long, ids binary"), "tokens")
    counts = np.zeros(size, np.int64)
    for row in tokens.where("n < 0").groupBy("doc_id").agg(F.sum("n").alias("n")).collect():  # at most a row for each id of the vocabulary
        counts[row.doc_id] = -row.n
    used = int((counts > 0).sum())
    lengths = code_lengths(counts, min(24, max(16, used.bit_length() + 1)))
    code = spark.sparkContext.broadcast(lengths)  # a byte for each id of the vocabulary
    spark.createDataFrame(pa.table({"id": np.flatnonzero(lengths), "length": lengths[lengths > 0].astype(np.int32)}).to_pandas() if used else [], "id long, length int").coalesce(1).write.parquet(f"{path}/code")
    texts = tokens.where("n >= 0")
    parts = width(spark)
    edges = texts.stat.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    edges = np.unique(np.array(edges, np.int64))  # an id for each partition
    coded = texts.mapInArrow(_encode(code, "<u2" if size <= 1 << 16 else "<u4", edges), "range int, doc_id long, n long, marks binary, bits binary")
    ordered = coded.repartitionById(len(edges) + 1, "range").sortWithinPartitions("range", F.col("doc_id").asc_nulls_first(), F.xxhash64("bits"))
    ordered.select("range", "doc_id", "n", "marks", "bits").mapInArrow(_blocks(block_tokens), BLOCK).write.option("compression", "none").parquet(f"{path}/blocks")


def read_tokens(spark, path: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the files at path; ids as little-endian unsigned 32-bit integers, or their crc32."""
    table = spark.read.schema("id long, length int").parquet(f"{path}/code").collect()  # at most a row for each id of the vocabulary
    lengths = np.zeros(max((r.id for r in table), default=0) + 1, np.uint8)
    for r in table:
        lengths[r.id] = r.length
    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    heads = blocks.groupBy("range").agg(F.sum("n_tokens").alias("n"))
    before = heads.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each range
    within = blocks.select("range", "seq", "n_tokens").withColumn("inside", F.coalesce(F.sum("n_tokens").over(Window.partitionBy("range").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    base = within.join(before, "range").select("range", "seq", (F.col("before") + F.col("inside")).alias("base"))
    return blocks.join(base, ["range", "seq"]).mapInArrow(_read(spark.sparkContext.broadcast(lengths), digest), f"doc_id long, start long, n_tokens long, {'ids_crc32 long' if digest else 'ids binary'}")


def token_digest(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from files that write_tokens() makes of docs."""
    spark = docs.sparkSession
    with scope(spark):
        path = new_folder(spark, "token-files")
        write_tokens(docs, path, **options)
        return materialise(read_tokens(spark, path, digest=True), "digests", outer=True)
