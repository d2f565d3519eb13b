"""Exact dedup by Golomb-coded fingerprint exchange.

1. The rows are written once with their numbers.  Each task hashes its texts (A-Z lower-cased) to 64 bits and keeps them as
   sorted lists of at most LIST rows; of each list the distinct fingerprints go, Rice-coded, to the owners of their ranges.
2. Owners decode and merge the lists and return, for each list, a bitmap of its fingerprints that stand in other lists too.
3. Rows whose fingerprint has its bit, or stands twice in its list, are suspects.  Only their texts are fetched, by number,
   and grouped byte by byte: partial sums by task first, so that a group of a third of all rows is a row a task, then a join
   of ids that Spark can split.

Defined cases: null text counts as empty; null ids sort below all others; of rows that tie in text and id the one with the
largest number stays; an empty table gives no rows; other columns are not read.  Texts of any length are hashed whole.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import by_number, let_go, lower_ascii, materialise, numbered, rice_decode, rice_encode, slices, width, wrapped

LIST = 1 << 17
WHOLE = 1 << 64
LISTS = pa.schema([("prints", pa.binary()), ("ids", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64())), ("shas", pa.binary())])
CODES = pa.schema([("owner", pa.int32()), ("list", pa.int64()), ("k", pa.int32()), ("n", pa.int32()), ("codes", pa.binary())])


def _plain(column: pa.Array) -> list[bytes]:
    return pc.cast(lower_ascii(column), pa.binary()).to_pylist()


def _edges(owners: int) -> np.ndarray:
    return np.array([i * WHOLE // owners for i in range(owners)], np.uint64)


def _listing(print_bits: int, size: int):
    """A task's rows as lists in the order of their fingerprints."""
    unused = np.uint64(64 - print_bits)

    def run(batches):
        let_go()
        held, count = [], 0

        def one() -> pa.RecordBatch:
            prints, shas = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            ids, rows = (pa.concat_arrays([h[k] for h in held]) for k in (2, 3))
            order = np.argsort(prints, kind="stable")
            at = pa.array(order)
            return pa.RecordBatch.from_pydict({"prints": [prints[order].tobytes()], "ids": [ids.take(at)], "rows": [rows.take(at)], "shas": [shas[order].tobytes()]}, LISTS)

        for batch in slices(batches, "text"):
            texts = _plain(batch.column("text"))
            prints = np.fromiter(map(xxhash.xxh3_64_intdigest, texts), np.uint64, len(texts)) >> unused << unused
            shas = np.frombuffer(b"".join(hashlib.sha256(t).digest() for t in texts), "V32")
            for a in range(0, len(texts), size):
                held.append((prints[a : a + size], shas[a : a + size], batch.column("doc_id").slice(a, size), batch.column("rid").slice(a, size)))
                count += len(held[-1][0])
                if count >= size:
                    yield one()
                    held, count = [], 0
        if held:
            yield one()

    return run


def _send(owners: int):
    """Each list's distinct fingerprints, cut by owner."""

    def run(batches):
        edges = _edges(owners)
        for batch in batches:
            for number, raw in zip(batch.column("rid").to_pylist(), batch.column("prints").to_pylist(), strict=True):
                prints = np.unique(np.frombuffer(raw, np.uint64))
                cut = np.append(np.searchsorted(prints, edges), len(prints))
                columns = defaultdict(list)
                for i in np.flatnonzero(np.diff(cut)).tolist():
                    own = prints[cut[i] : cut[i + 1]]
                    k, blob = rice_encode(own, int(edges[i]), WHOLE // owners)
                    for name, value in zip(CODES.names, (i, number, k, len(own), blob), strict=True):
                        columns[name].append(value)
                yield pa.RecordBatch.from_pydict(dict(columns), CODES)

    return run


def _own(owners: int):
    """For each list whose fingerprints another list has too: their bits, in the list's order."""

    def run(batches):
        edges = _edges(owners)
        lists = defaultdict(list)
        for batch in batches:
            for row in batch.to_pylist():
                lists[row["owner"]].append((row["list"], rice_decode(row["codes"], row["k"], row["n"], int(edges[row["owner"]]))))
        while lists:
            owner, parts = lists.popitem()
            prints = np.concatenate([p for _, p in parts])
            order = np.argsort(prints, kind="stable")
            same = prints[order][1:] == prints[order][:-1]
            twice = np.zeros(len(prints), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            cut = np.concatenate([[0], np.cumsum([len(p) for _, p in parts])]).tolist()
            found = [(number, twice[a:b]) for (number, _), a, b in zip(parts, cut[:-1], cut[1:], strict=True) if twice[a:b].any()]
            yield pa.RecordBatch.from_pydict(
                {"rid": [number for number, _ in found], "owner": [owner] * len(found), "n": [len(bits) for _, bits in found], "bits": [np.packbits(bits).tobytes() for _, bits in found]},
                pa.schema([("rid", pa.int64()), ("owner", pa.int32()), ("n", pa.int32()), ("bits", pa.binary())]),
            )

    return run


def _suspects(owners: int):
    """The rows of lists, and whether their fingerprints have a set bit or stand twice in the list."""

    def run(batches):
        edges = _edges(owners)
        for batch in batches:
            for row, ids, numbers in zip(batch.select(["prints", "shas", "back"]).to_pylist(), batch.column("ids"), batch.column("rows"), strict=True):
                every = np.frombuffer(row["prints"], np.uint64)
                prints, place, count = np.unique(every, return_inverse=True, return_counts=True)
                twice = count > 1
                cut = np.append(np.searchsorted(prints, edges), len(prints))
                for back in row["back"] or ():
                    at = int(cut[back["owner"]])
                    twice[at : at + back["n"]] |= np.unpackbits(np.frombuffer(back["bits"], np.uint8), count=back["n"]).astype(bool)
                shas = row["shas"]
                yield pa.RecordBatch.from_arrays(
                    [numbers.values, ids.values, pa.array([shas[i : i + 32] for i in range(0, len(shas), 32)], pa.binary()), pa.array(twice[place])],
                    names=["rid", "doc_id", "sha", "suspect"],
                )

    return run


def _decide(base: DataFrame, id_col: str, text_col: str, print_bits: int, list_rows: int) -> DataFrame:
    """(rid, doc_id, sha, n, keep_rid, keep) of every row of a numbered table."""
    owners = width(base.sparkSession)
    rows = base.select("rid", F.col("row")[id_col].cast("long").alias("doc_id"), F.col("row")[text_col].cast("string").alias("text"))
    lists = numbered(rows.mapInArrow(_listing(print_bits, list_rows), "prints binary, ids array<long>, rows array<long>, shas binary"), "lists")
    sent = lists.select("rid", "prints").mapInArrow(_send(owners), "owner int, list long, k int, n int, codes binary")
    back = sent.repartitionById(owners, "owner").mapInArrow(_own(owners), "rid long, owner int, n int, bits binary")
    back = back.groupBy("rid").agg(F.collect_list(F.struct("owner", "n", "bits")).alias("back"))  # an owner's bits once; LIST bits in all
    seen = by_number(lists, back, "left").select("prints", "ids", "rows", "shas", "back")
    seen = materialise(seen.mapInArrow(_suspects(owners), "rid long, doc_id long, sha binary, suspect boolean"), "fingerprints")
    suspects = seen.where("suspect").select("rid", "doc_id", "sha")
    texts = by_number(base.select("part", "rid", F.coalesce(F.col("row")[text_col].cast("string"), F.lit("")).alias("text")), suspects, "inner")
    plain = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = (
        texts.groupBy("sha", plain.alias("plain"))
        .agg(F.count("*").alias("n"), F.max(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("o"), "rid", "doc_id")).alias("top"))
        .select("sha", "n", F.col("top.rid").alias("keep_rid"), F.col("top.doc_id").alias("keep"))
    )
    alone = seen.where("not suspect").select("rid", "doc_id", "sha", F.lit(1).cast("long").alias("n"), F.col("rid").alias("keep_rid"), F.col("doc_id").alias("keep"))
    return alone.unionByName(suspects.join(groups, "sha").select(alone.columns))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", print_bits: int = 64, list_rows: int = LIST) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row for each row of docs.  Fewer print_bits make more suspects."""
    base = numbered(wrapped(docs.select(id_col, text_col)), "rows")
    return _decide(base, id_col, text_col, print_bits, list_rows).select(
        "doc_id", F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), (F.col("rid") == F.col("keep_rid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_dedup() does not keep; all columns stay as they are."""
    base = numbered(wrapped(docs), "rows")
    gone = _decide(base, "doc_id", "text", 64, LIST).where("rid <> keep_rid").select("rid")
    return by_number(base, gone, "left_anti").select("row.*")
