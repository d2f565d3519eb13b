"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

Which bins there are depends on the lengths alone, so the driver plans over the histogram of lengths (at most `capacity`
counts at any scale): fill a bin greedily with the largest length that fits, then replace its smallest member by the two
unpacked lengths that fill the widened gap best.  A bin is used as often as the counts allow, so the plan is a bounded table
of runs.  Every piece gets its place from its rank among the pieces of its length: a rank within its task plus a prefix sum
over tasks.  No group of equal lengths meets in one task.

Defined cases: null text is an empty document of one end id; ids may repeat or be null, each row is a document of its own;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise, slices
from tessera.llm.pieces import encoder, tokenizer_path

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k.json"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins for counts[length] pieces: (how many bins, [(length, copies), ...]), each length once in a bin."""
    left = np.asarray(counts, np.int64).copy()
    plan = []
    lengths = np.arange(capacity + 1)
    while left.any():
        below = np.maximum.accumulate(np.where(left > 0, lengths, 0))  # the largest length at hand up to each
        gap, used, x = capacity, {}, int(below[capacity])
        while x:
            used[x] = min(int(left[x]), gap // x)
            gap -= used[x] * x
            x = int(below[min(gap, x - 1)])
        if gap and sum(used.values()) > 1:
            small = min(used)
            free = left.copy()
            for x, k in used.items():
                free[x] -= k
            room = gap + small
            have = np.flatnonzero(free[: room + 1] > 0)
            have = have[have > 0]
            if len(have):
                reach = np.maximum.accumulate(np.where(free > 0, lengths, 0))
                mate = reach[np.minimum(room - have, have)]
                alone = (mate == have) & (free[have] < 2)
                mate = np.where(alone, reach[np.maximum(have - 1, 0)], mate)
                both = np.where(mate > 0, have + mate, 0)
                best = int(both.argmax())
                if both[best] > small:
                    used[small] -= 1
                    for x in (int(have[best]), int(mate[best])):
                        used[x] = used.get(x, 0) + 1
        used = {x: k for x, k in used.items() if k}
        times = min(int(left[x]) // k for x, k in used.items())
        for x, k in used.items():
            left[x] -= k * times
        plan.append((times, sorted(used.items(), reverse=True)))
    return plan


def _runs(plan, counts: np.ndarray) -> dict[str, np.ndarray]:
    """The plan as runs of ranks: the pieces of a length from one global position on go to bins in turn."""
    base = np.concatenate([[0], np.cumsum(counts)])[:-1]
    taken = np.zeros(len(counts), np.int64)
    rows, first = [], 0
    for times, members in plan:
        offset = 0
        for x, k in members:
            rows.append((base[x] + taken[x], times, first, offset, x))
            taken[x] += times * k
            offset += k * x
        first += times
    rows.sort()
    return dict(zip(("at", "times", "bin", "offset", "length"), np.array(rows, np.int64).reshape(-1, 5).T, strict=True)) | {"base": base}


def _tokenise(path: str, capacity: int, end_id: int):
    def run(batches):
        encode, seen, part = encoder(path), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in slices(batches, "text"):
            ids, at = encode(batch.column("text"))
            docs = batch.column("doc_id").to_numpy(zero_copy_only=False) if not batch.column("doc_id").null_count else None
            columns = {n: [] for n in ("row", "piece", "start", "length", "ids_crc32")}
            for i in range(batch.num_rows):
                own = np.append(ids[at[i] : at[i + 1]], np.uint32(end_id)).astype("<u4")
                n = len(own)
                begin, size, j = 0, (n % capacity or capacity) if n > capacity else n, 0
                while begin < n:
                    for name, value in zip(columns, (i, j, begin, size, zlib.crc32(own[begin : begin + size])), strict=True):
                        columns[name].append(value)
                    begin, size, j = begin + size, capacity, j + 1
            length = np.array(columns["length"], np.int64)
            order = np.argsort(length, kind="stable")
            run_start = np.flatnonzero(np.diff(length[order], prepend=-1))
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(length)) - np.repeat(run_start, np.diff(np.append(run_start, len(length))))
            nth += seen[length]
            seen += np.bincount(length, minlength=capacity + 1)
            row = np.array(columns["row"])
            doc_id = pa.array(docs[row], pa.int64()) if docs is not None else batch.column("doc_id").take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [doc_id, pa.array(columns["piece"], pa.int32()), pa.array(columns["start"], pa.int64()), pa.array(length), pa.array(columns["ids_crc32"], pa.int64()), pa.array(np.full(len(row), part, np.int32)), pa.array(nth)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
            )

    return run


def _place(runs: dict[str, np.ndarray]):
    def run(batches):
        for batch in batches:
            length, rank = (batch.column(n).to_numpy() for n in ("length", "rank"))
            at = runs["base"][length] + rank
            r = np.searchsorted(runs["at"], at, side="right") - 1
            step = at - runs["at"][r]
            copy, turn = np.divmod(step, runs["times"][r])
            keep = [batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(runs["bin"][r] + turn), pa.array(runs["offset"][r] + copy * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece of each document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = materialise(rows.mapInArrow(_tokenise(tokenizer_path(tokenizer), capacity, end_id), PIECES), "pieces")
    shares = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for row in shares.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most capacity rows
        counts[row.length] = row.n
    runs = _runs(best_two_fit(counts, capacity), counts)
    before = shares.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "length", "before")
    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("nth") + F.col("before"))
    return ranked.mapInArrow(_place(runs), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
