"""Embedding near-dedup by collision-counting projections.

Vectors are projected on many random directions.  Lists of single sorted projections over all vectors would meet in pairs
quadratic in their number, so the lists are cut first: in each of `tables` groups of `bits` projections, vectors on the same
side of the centre in all of them form a tile, such that any pair meets in some tile with the recall asked for.  In a tile,
COUNTED further projections are sorted; every vector's window, centred on it, is an interval of each sorted list, and for
each pair the lists are counted in which one lies in the other's window.  Pairs that reach the calibrated count, and no
others, are verified by cosine in double precision.  A pair counts in its first common tile only, so tiles report sums of
links and a spanning forest, never pairs.

Calibration: for a sample of at most SAMPLE vectors (the smallest hashes), partners at exactly the threshold are made by
rotation; `tables` is the least number that brings RECALL of these pairs together, and the count is the largest that the
binomial law lets all but LOST of them reach.  `bits` grows with the logarithm of the number of vectors, so tiles stay small.
Vectors for which MOST_TABLES do not reach the recall raise an error.

Equal vectors are one class with a weight.  A tile of more than CHUNK classes is cut into pairs of chunks.

Defined cases: vectors that are null, empty, zero, or hold nulls or non-finite components link with nothing; only vectors of
one length are compared; rows with null ids link with nothing and are kept; rows that repeat an id are rows of their own
that share it as a node; a pair of a cosine of just the threshold links; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import components, materialise, width

COSINE, RECALL, LOST = 0.95, 0.975, 0.002
SAMPLE, COUNTED, CHUNK, SEED, MOST_TABLES = 2048, 16, 2048, 20260101, 512


def directions(dim: int, count: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((count, dim)).T


def unit(values: pa.Array) -> np.ndarray:
    """Rows of one length as unit vectors of doubles."""
    flat = np.asarray(values.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(values), -1)
    flat = flat / np.abs(flat).max(1, keepdims=True)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def table_keys(x: np.ndarray, centre: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """One long for each vector and table: the sides it is on."""
    a = directions(x.shape[1], COUNTED + bits * tables)[:, COUNTED:]
    sides = ((x - centre) @ a > 0).reshape(len(x), tables, bits)
    return (sides.astype(np.int64) << np.arange(bits)).sum(2)


def window_count(cosine: float) -> tuple[float, int]:
    """The half width of windows (two standard deviations of a pair at the threshold) and the count to reach."""
    half = 2 * math.sqrt(2 - 2 * cosine)
    inside = math.erf(2 / math.sqrt(2))
    tail, count = 0.0, 0
    while tail + math.comb(COUNTED, count) * inside**count * (1 - inside) ** (COUNTED - count) <= LOST:
        tail += math.comb(COUNTED, count) * inside**count * (1 - inside) ** (COUNTED - count)
        count += 1
    return half, count


def calibrate(sample: np.ndarray, centre: np.ndarray, bits: int, cosine: float) -> int:
    """Tables that bring together RECALL of the pairs of sample vectors and partners at the threshold."""
    rng = np.random.default_rng(SEED)
    away = rng.standard_normal(sample.shape)
    away -= (away * sample).sum(1, keepdims=True) * sample
    norms = np.linalg.norm(away, axis=1, keepdims=True)
    partner = cosine * sample + math.sqrt(1 - cosine**2) * np.divide(away, norms, out=np.zeros_like(away), where=norms > 0)
    tries = 64
    together = (table_keys(sample, centre, bits, tries) == table_keys(partner, centre, bits, tries)).mean(1)
    together = np.maximum(together, 0.25 / tries)
    for tables in range(1, MOST_TABLES + 1):
        if (1 - (1 - together) ** tables).mean() >= RECALL:
            return tables
    raise ValueError(f"{MOST_TABLES} tables of {bits} projections do not bring {RECALL} of the pairs together")


class Windows:
    """Sorted one-dimensional projections of a tile, and each vector's window of half width around it as an interval of ranks."""

    def __init__(self, seen: np.ndarray, half: float) -> None:
        order = np.argsort(seen, axis=0, kind="stable")
        ranks = np.empty_like(order)
        np.put_along_axis(ranks, order, np.arange(len(seen))[:, None], 0)
        kind = np.int16 if len(seen) < 1 << 15 else np.int32
        self.ranks = np.ascontiguousarray(ranks.T.astype(kind))
        lists = np.take_along_axis(seen, order, 0)
        ends = lambda side, where: np.stack([np.searchsorted(lists[:, j], seen[:, j] + side * half, where) for j in range(seen.shape[1])]).astype(np.int32)
        self.low, self.high = ends(-1, "left"), ends(1, "right")

    def collisions(self, a: int, b: int) -> np.ndarray:
        """For vectors a .. b and those from a on: in how many lists the second lies in the first's window."""
        near = np.zeros((b - a, self.ranks.shape[1] - a), np.uint8)
        for ranks, low, high in zip(self.ranks, self.low, self.high, strict=True):
            own = ranks[None, a:]
            near += (own >= low[a:b, None]) & (own < high[a:b, None])
        return near


def _plan(centres, bits: int, tables: dict[int, int]):
    def run(batches):
        for batch in batches:
            lengths = np.array([len(v) for v in batch.column("v")])
            for dim in np.unique(lengths):
                part = batch.filter(pa.array(lengths == dim))
                keys = table_keys(unit(part.column("v")), centres[int(dim)], bits, tables[int(dim)])
                t = tables[int(dim)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(part.column("cid").to_numpy(), t)), pa.array(np.full(len(keys) * t, dim, np.int32)), pa.array(np.tile(np.arange(t, dtype=np.int32), len(keys))), pa.array(keys.ravel())],
                    names=["cid", "dim", "t", "key"],
                )

    return run


def _tiles(centres, bits: int, tables: dict[int, int], cosine: float):
    half, need = window_count(cosine)

    def links(rows: pa.Table):
        """Sums of links by class and a forest of one tile."""
        cid, rep, w, side = (rows.column(c).to_numpy() for c in ("cid", "rep", "w", "i"))
        dim, t, p, q = (rows.column(c)[0].as_py() for c in ("dim", "t", "p", "q"))
        x = unit(rows.column("v").combine_chunks())
        keys = table_keys(x, centres[dim], bits, tables[dim])[:, :t]
        windows = Windows(x @ directions(dim, COUNTED), half)
        total, up = np.zeros(len(x), np.int64), np.arange(len(x))

        def root(a):
            while up[a] != a:
                up[a] = a = up[up[a]]
            return a

        for a in range(0, len(x), 128):
            b = min(len(x), a + 128)
            link = (windows.collisions(a, b) >= need) & (np.arange(a, b)[:, None] < np.arange(a, len(x))[None, :])
            if p != q:
                link &= side[a:b, None] != side[None, a:]
            if not link.any():
                continue
            if link.mean() > 0.05:
                link &= x[a:b] @ x[a:].T >= cosine
            else:
                i, j = np.nonzero(link)
                link[i, j] = np.einsum("ij,ij->i", x[a + i], x[a + j]) >= cosine
            for k in range(t):
                link &= keys[a:b, k, None] != keys[None, a:, k]
            total[a:b] += link @ w[a:]
            total[a:] += w[a:b] @ link
            for i, j in zip(*np.nonzero(link & (np.cumsum(link, 1) == 1)), strict=True):  # a first link of each row ...
                ri, rj = root(a + i), root(a + j)
                up[max(ri, rj)] = min(ri, rj)
            roots = np.array([root(i) for i in range(a, len(x))])
            i, j = np.nonzero(link & (roots[: b - a, None] != roots[None, :]))  # ... then those that still join something
            for i, j in zip(i.tolist(), j.tolist(), strict=True):
                ri, rj = root(a + i), root(a + j)
                up[max(ri, rj)] = min(ri, rj)
        some = np.flatnonzero(total)
        ends = np.array([root(i) for i in some], np.int64)
        forest = some[ends != some]
        return [(np.zeros(len(some), np.int32), cid[some], total[some]), (np.ones(len(forest), np.int32), rep[forest], rep[ends[ends != some]])]

    def run(batches):
        held = None

        def out(tables_of_rows):
            found = [f for rows in tables_of_rows for f in links(rows)]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in range(3)], names=["kind", "a", "b"])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            new = np.ones(rows.num_rows, bool)
            new[1:] = False
            for c in ("dim", "t", "key", "p", "q"):
                x = rows.column(c).to_numpy()
                new[1:] |= x[1:] != x[:-1]
            cut = np.flatnonzero(new)
            if len(cut) > 1:
                yield out(rows.slice(a, b - a) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
            held = rows.slice(int(cut[-1])) if len(cut) else None
        if held is not None and held.num_rows:
            yield out([held])

    return run


def _sums(batches):
    for batch in batches:
        lengths = np.array([len(v) for v in batch.column("v")])
        for dim in np.unique(lengths):
            x = unit(batch.column("v").filter(pa.array(lengths == dim)))
            yield pa.RecordBatch.from_pydict({"dim": np.full(dim, dim, np.int32), "at": np.arange(dim, dtype=np.int32), "s": x.sum(0), "n": np.full(dim, len(x), np.int64)})


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row."""
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    good = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    classes = rows.where("good").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w"))
    classes = materialise(classes.withColumn("cid", F.monotonically_increasing_id()), "vectors")
    n = classes.count()
    bits = min(48, max(2, math.ceil(math.log2(max(n, 1) / 32))))
    centres, tables = {}, {}
    for r in classes.select("v").mapInArrow(_sums, "dim int, at int, s double, n long").groupBy("dim", "at").agg((F.sum("s") / F.sum("n")).alias("m")).collect():  # a row for each component
        centres.setdefault(r.dim, {})[r["at"]] = r.m
    centres = {d: np.array([m[k] for k in range(d)]) for d, m in centres.items()}
    sample = classes.orderBy(F.xxhash64("cid")).select("v").limit(SAMPLE).collect()
    for d in centres:
        own = [r.v for r in sample if len(r.v) == d]
        tables[d] = calibrate(unit(pa.array(own, pa.list_(pa.float64()))), centres[d], bits, cosine) if own else 12
    keys = materialise(classes.select("cid", "v").mapInArrow(_plan(centres, bits, tables), "cid long, dim int, t int, key long"), "keys")
    sizes = keys.groupBy("dim", "t", "key").agg(F.count("*").alias("c")).where("c > 1").select("dim", "t", "key", F.ceil(F.col("c") / CHUNK).cast("int").alias("k"))
    placed = keys.join(sizes, ["dim", "t", "key"]).withColumn("i", F.pmod(F.hash("cid"), F.col("k")))
    tile = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.struct(F.least("i", j).alias("p"), F.greatest("i", j).alias("q")))
    placed = placed.select("cid", "dim", "t", "key", "i", F.explode(tile).alias("e")).select("cid", "dim", "t", "key", "i", "e.p", "e.q").join(classes, "cid")
    by = ["dim", "t", "key", "p", "q"]
    found = placed.repartition(width(rows.sparkSession), *by).sortWithinPartitions(*by).mapInArrow(_tiles(centres, bits, tables, cosine), "kind int, a long, b long")
    found = materialise(found, "vector-links")
    links = found.where("kind = 0").groupBy("a").agg(F.sum("b").alias("links"))
    joined = components(found.where("kind = 1").select("a", "b"))
    own = classes.join(links, classes["cid"] == links["a"], "left").join(joined, classes["rep"] == joined["id"], "left")
    own = own.select("v", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = rows.where("good").join(own, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = linked.unionByName(alone)
    return both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
