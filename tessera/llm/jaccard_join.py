"""Exact n-gram Jaccard self-join of documents, and its components.

Texts of one shingle set are one class, joined by a 128-bit print of the set.  Under any one order of all shingles, two sets
of Jaccard similarity t share one of their first n - ceil(t n) + 1 shingles, so classes meet in tiles of such a shingle.
The order puts the most frequent shingles last (each task counts those that repeat, the FREQUENT most frequent of all by
powers of two are known to every task), the rest go by hash.

Links are found in two rounds.  Stars: in each (shingle, size band) tile all classes are paired with the tile's smallest one
and the one of the band below.  Verified pairs give components, and a shingle whose classes are all in one component is done:
this keeps a group of a third of all rows linear.  Rest: in the tiles left over, of a band and the next one, cut into chunks,
classes of different components whose sizes allow the link are compared by hashed parity bitmaps; set bits of the XOR bound the symmetric
difference from below, hence the overlap from above.  What passes is verified on the sorted arrays.  Each pair of different
sets that link is thus in one component, and none is assumed.

Scale: the classes of a shingle that stands in 2**(HOT - 1) documents or more are dealt over as many lists and join salts as
its count asks for.  Texts of candidates are fetched by number, so documents are never moved whole.

Defined cases: null or blank text has an empty set and links with nothing; a null id is returned with a null component and
links with nothing; rows that repeat an id are returned as they are, their classes share that id as a node; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import by_number, components, let_go, materialise, mix, numbered, scope, slices, view, width, wrapped
from tessera.llm.shingles import shingle_hashes, shingle_sets

WORDS, PERCENT = 5, 75
FREQUENT, OFTEN, COUNT_AT_ONCE = 1 << 20, 3, 1 << 22  # frequent shingles that tasks know; what counts as repeated, in how many
HOT = 13  # from this level (2**12 documents) a shingle's classes are salted
BUCKET = 1 << 22  # shingles of a bucket of lists
SIGN_BITS, LONG_BITS = 1024, 1 << 17
CHUNK = 2000
SLICE = 2 << 20
_A, _B = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    return np.where(n > 0, n - (-(-n * percent // 100)) + 1, 0)


def band(n: Column, percent: int) -> Column:
    """Sizes of one band or of neighbouring ones may link, others may not."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")


def bitmap(hashes: np.ndarray) -> bytes:
    """Parities of a set's hashes by their bits from the seventh: at least SIGN_BITS, twice the set's size, LONG_BITS at most."""
    bits = min(LONG_BITS, max(SIGN_BITS, 1 << int(2 * len(hashes) - 1).bit_length()))
    places = ((hashes >> np.uint64(7)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(places, minlength=bits) & 1, bitorder="little").tobytes()


def fold(sign: bytes, size: int) -> np.ndarray:
    """A bitmap as one of size bytes, as if made with fewer bits."""
    words = np.frombuffer(sign, np.uint64)
    return words if len(sign) == size else np.bitwise_xor.reduce(words.reshape(-1, size // 8), 0)


def _often(words: int):
    """(shingle, n) of shingles that occur OFTEN times in some COUNT_AT_ONCE shingles of a task."""

    def run(batches):
        let_go()
        held, size = [], 0

        def often():
            shingles, counts = np.unique(np.concatenate(held), return_counts=True)
            some = counts >= OFTEN
            return pa.RecordBatch.from_arrays([pa.array(shingles[some].view(np.int64)), pa.array(counts[some], pa.int64())], names=["shingle", "n"])

        for batch in slices(batches, "text", SLICE):
            held.append(shingle_hashes(batch.column("text"), words)[0])
            size += len(held[-1])
            if size >= COUNT_AT_ONCE:
                yield often()
                held, size = [], 0
        if held:
            yield often()

    return run


class Levels:
    """The bits of the counts of frequent shingles, 0 for others."""

    def __init__(self, shingles: np.ndarray, levels: np.ndarray) -> None:
        order = np.argsort(shingles)
        self.shingles, self.levels, self.hot = shingles[order], levels[order], HOT

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.uint8)
        if len(self.shingles):
            if not hasattr(self, "some"):
                self.some = np.zeros(1 << 23, bool)  # most shingles are told by their first bits
                self.some[(self.shingles >> np.uint64(41)).astype(np.int64)] = True
            maybe = np.flatnonzero(self.some[(hashes >> np.uint64(41)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.shingles, hashes[maybe]), len(self.shingles) - 1)
            out[maybe] = np.where(self.shingles[place] == hashes[maybe], self.levels[place], 0)
        return out

    def salts(self, hashes: np.ndarray) -> np.ndarray:
        """Over how many lists the classes of shingles are dealt, so that each holds about 2**(HOT - 1) at most."""
        return 1 << np.maximum(self(hashes).astype(np.int64) - self.hot + 1, 0)

    def __getstate__(self):
        return {"shingles": self.shingles, "levels": self.levels, "hot": self.hot}


def frequent(texts: DataFrame, words: int) -> Levels:
    """The most frequent shingles of all texts: of the highest powers of two, as many as FREQUENT allows (9 bytes each)."""
    counts = materialise(texts.mapInArrow(_often(words), "shingle long, n long").groupBy("shingle").agg(F.floor(F.log2(F.sum("n"))).cast("int").alias("level")), "frequent")
    least, total = 64, 0
    for row in counts.groupBy("level").count().orderBy(F.desc("level")).collect():  # at most a row for each bit of a count
        total += row["count"]
        if total > FREQUENT:
            break
        least = row.level
    known = counts.where(F.col("level") >= least).toArrow()
    return Levels(known.column("shingle").to_numpy().view(np.uint64), (known.column("level").to_numpy() + 1).astype(np.uint8))


def _signs(words: int, percent: int, levels):
    def run(batches):
        for batch in slices(batches, "text", SLICE):
            hashes, at = shingle_sets(batch.column("text"), words)
            level_of = levels.value(hashes)
            sizes = np.diff(at)
            prints = []
            for salt in (_A, _B):
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ salt), dtype=np.uint64)])
                prints.append((sums[at[1:]] - sums[at[:-1]]).view(np.int64))
            ids = np.array([np.iinfo(np.int64).max if i is None else i for i in batch.column("doc_id").to_pylist()], np.int64)
            by = np.lexsort((ids, prints[1], prints[0]))
            lead = np.ones(len(by), bool)
            lead[1:] = (prints[0][by][1:] != prints[0][by][:-1]) | (prints[1][by][1:] != prints[1][by][:-1])
            carries = np.zeros(len(by), bool)
            carries[by[lead]] = True
            carries &= sizes > 0
            p = prefix_size(sizes, percent)
            tokens, signs = [], []
            for i in range(len(sizes)):
                if not carries[i]:
                    tokens.append(None)
                    signs.append(None)
                    continue
                own = hashes[at[i] : at[i + 1]]
                level = level_of[at[i] : at[i + 1]]
                order = np.argsort(level, kind="stable")[: p[i]] if level.any() else slice(0, p[i])
                tokens.append(own[order].tobytes())
                signs.append(bitmap(own))
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("doc_id"), pa.array(sizes), pa.array(prints[0]), pa.array(prints[1]), pa.array(tokens, pa.binary()), pa.array(signs, pa.binary())],
                names=["rid", "doc_id", "n", "fa", "fb", "tokens", "sign"],
            )

    return run


def _send(buckets: int, levels):
    """(shingle, class, size) of a task in as many lists as there are buckets; frequent shingles are salted by class."""

    def run(batches):
        held, size = [], 0

        def lists():
            token, rep, n = (np.concatenate(x) for x in zip(*held, strict=True))
            salt = mix(rep.view(np.uint64)) % levels.value.salts(token).astype(np.uint64)
            bucket = (mix(token + salt * _A) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(cut))
            parts = [order[cut[i] : cut[i + 1]] for i in some]
            return pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), *(pa.array([x[p].tobytes() for p in parts], pa.binary()) for x in (token, rep, n))],
                names=["bucket", "token", "rep", "n"],
            )

        for batch in slices(batches, "tokens"):
            raw, at = view(batch.column("tokens"))
            sizes = np.diff(at) // 8
            token = np.frombuffer(raw.tobytes(), np.uint64)
            held.append((token, np.repeat(batch.column("rep").to_numpy(), sizes), np.repeat(batch.column("n").to_numpy().astype(np.int32), sizes)))
            size += len(token)
            if size >= 1 << 19:
                yield lists()
                held, size = [], 0
        if held:
            yield lists()

    return run


def _live(levels):
    """The classes of each shingle that stands in two at least, once for all shingles of the same classes (w counts them).

    A frequent shingle's classes are in several lists; each list becomes a row that only its shingle names."""

    def run(batches):
        lists: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                lists.setdefault(row["bucket"], []).append([np.frombuffer(row[c], k) for c, k in (("token", np.uint64), ("rep", np.int64), ("n", np.int32))])
        rows: list[list] = []
        while lists:
            bucket, parts = lists.popitem()
            token, rep, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((rep, token))
            token, rep, n = token[order], rep[order], n[order]
            first = np.flatnonzero(np.diff(token, prepend=~token[:1]))
            size = np.diff(np.append(first, len(token)))
            salts = levels.value.salts(token[first])
            hot = salts > 1
            keep = (size > 1) | hot
            name = [np.add.reduceat(mix(rep.view(np.uint64) ^ x), first) for x in (_A, _B)] if len(first) else [first, first]
            sa, sb = np.where(hot, token[first], name[0])[keep].view(np.int64), np.where(hot, np.uint64(bucket), name[1])[keep].view(np.int64)
            first, size, salts = first[keep], size[keep], salts[keep]
            by = np.lexsort((sb, sa))
            new = np.ones(len(by), bool)
            new[1:] = (sa[by][1:] != sa[by][:-1]) | (sb[by][1:] != sb[by][:-1])
            times = np.diff(np.append(np.flatnonzero(new), len(by)))
            for i, w in zip(by[new].tolist(), times.tolist(), strict=True):
                x, y = first[i], first[i] + size[i]
                rows.append([sa[i], sb[i], salts[i], w, rep[x:y].tobytes(), n[x:y].tobytes()])
                if len(rows) >= 20_000:
                    yield _table(rows)
                    rows = []
        if rows:
            yield _table(rows)

    return run


def _table(rows: list[list]) -> pa.RecordBatch:
    kinds = {"sa": pa.int64(), "sb": pa.int64(), "salts": pa.int64(), "w": pa.int64(), "reps": pa.binary(), "ns": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


def _unpack(batches):
    for batch in batches:
        reps, ns = (b"".join(batch.column(c).to_pylist()) for c in ("reps", "ns"))
        size = np.array([len(x) // 8 for x in batch.column("reps").to_pylist()], np.int64)
        salts = batch.column("salts").to_numpy()
        sid = np.where(salts > 1, batch.column("sa").to_numpy(), mix(batch.column("sa").to_numpy().view(np.uint64) ^ mix(batch.column("sb").to_numpy().view(np.uint64))).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(sid, size)), pa.array(np.frombuffer(reps, np.int64)), pa.array(np.frombuffer(ns, np.int32)), pa.array(np.repeat(batch.column("w").to_numpy(), size)), pa.array(np.repeat(salts, size))],
            names=["sid", "rep", "n", "w", "salts"],
        )


def _sets(words: int):
    def run(batches):
        for batch in slices(batches, "text", SLICE):
            hashes, at = shingle_sets(batch.column("text"), words)
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array([hashes[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())], names=["rep", "hashes"])

    return run


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common values of two ascending arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0


def _verify(percent: int):
    def run(batches):
        for batch in slices(batches, "ha"):
            keep = []
            for x, y in zip(batch.column("ha").to_pylist(), batch.column("hb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = overlap(x, y)
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _compare(percent: int):
    """Pairs of a tile, of different components, whose sizes and bitmaps allow a link.

    Rows come by tile and size.  All tiles at hand are compared at once: each row with the next one, the one after that, .."""

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        rep, n, comp, side, up, sign = (rows.column(c).combine_chunks() for c in ("rep", "n", "comp", "side", "up", "sign"))
        rep, n, comp, side, up = (x.to_numpy() for x in (rep, n, comp, side, up))
        whole = sign.to_pylist()
        sign = np.stack([fold(x, SIGN_BITS // 8) for x in whole])
        tile = np.cumsum(_changes(rows))
        found, step, i = [], 1, np.arange(len(rep))
        while True:
            i = i[: np.searchsorted(i, len(rep) - step)]
            i = i[(tile[i] == tile[i + step]) & (n[i] * 100 >= n[i + step] * percent)]
            if not len(i):
                break
            a = i[(comp[i] != comp[i + step]) & ((side[i] != side[i + step]) | (side[i] == 2)) & (up[i] + up[i + step] < 2)]
            if len(a):
                apart = np.bitwise_count(sign[a] ^ sign[a + step]).sum(1, dtype=np.int64)
                a = a[may_link(apart, n[a] + n[a + step], percent)]
                a = a[[may_link(_apart(whole[x], whole[x + step]), n[x] + n[x + step], percent) for x in a.tolist()]] if len(a) else a
                found.append(np.stack([rep[a], rep[a + step]]))
            step += 1
        both = np.unique(np.sort(np.concatenate(found, 1), 0), axis=1) if found else np.zeros((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            last = int(np.flatnonzero(_changes(rows))[-1]) if rows.num_rows else 0
            if last:
                yield pairs(rows.slice(0, last))
            held = rows.slice(last)
        if held is not None and held.num_rows:
            yield pairs(held)

    return run


def _changes(rows: pa.Table) -> np.ndarray:
    """True where a row is of another tile than the one before, and for the first."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for c in ("sid", "tile", "p", "q"):
        x = rows.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return new


def may_link(apart: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of so many shingles together, of which at least apart are not common, may have the similarity."""
    return apart * (100 + percent) <= sizes * (100 - percent)


def _apart(x: bytes, y: bytes) -> int:
    """At least so many shingles are in one of two sets only."""
    size = min(len(x), len(y))
    return int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum(dtype=np.int64))


def _bounded(percent: int):
    def run(batches):
        for batch in batches:
            sizes = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            apart = np.zeros(batch.num_rows, np.int64)
            for i, (x, y) in enumerate(zip(batch.column("sign_a").to_pylist(), batch.column("sign_b").to_pylist(), strict=True)):
                apart[i] = _apart(x, y)
            yield batch.select(["a", "b"]).filter(pa.array(may_link(apart, sizes, percent)))

    return run


def _possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs that their bitmaps allow to link."""
    sides = [classes.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("sign").alias(f"sign_{c}")) for c in ("a", "b")]
    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "n_a", "n_b", "sign_a", "sign_b").mapInArrow(_bounded(percent), "a long, b long")


def _verified(pairs: DataFrame, classes: DataFrame, base: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that link, after exact intersection.  The texts of theirs alone are fetched, by number."""
    reps = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct().join(classes.select("rep", "rid"), "rep")
    sets = by_number(base.select("part", "rid", "text"), reps, "inner").select("rep", "text").mapInArrow(_sets(words), "rep long, hashes binary")
    left = pairs.join(sets.select(F.col("rep").alias("a"), F.col("hashes").alias("ha")), "a")
    both = left.join(sets.select(F.col("rep").alias("b"), F.col("hashes").alias("hb")), "b").select("a", "b", "ha", "hb")
    return materialise(both.mapInArrow(_verify(percent), "a long, b long"), "links")


def _salted(rows: DataFrame, *keys: str) -> DataFrame:
    """One row for each salt of a frequent shingle, dealt by keys and salt, to meet rows that have one of them."""
    each = rows.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    return each.repartition(*keys, "salt")  # else the join would keep to the keys that the rows were summed by


def _components(base: DataFrame, words: int, percent: int) -> DataFrame:
    """(rid, doc_id, n_shingles, component_id) of base(part, rid, doc_id, text), written to the outer scope."""
    spark = base.sparkSession
    levels = spark.sparkContext.broadcast(frequent(base.select("text"), words))
    signed = materialise(base.select("rid", "doc_id", "text").mapInArrow(_signs(words, percent, levels), "rid long, doc_id long, n long, fa long, fb long, tokens binary, sign binary"), "signs")
    carried = signed.where("tokens is not null and doc_id is not null")
    classes = carried.groupBy("fa", "fb").agg(F.min_by(F.struct("doc_id", "rid", "n", "tokens", "sign"), "doc_id").alias("c"))
    classes = materialise(classes.select("fa", "fb", F.col("c.doc_id").alias("rep"), "c.rid", "c.n", "c.tokens", "c.sign"), "classes")
    prefixes = classes.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0
    buckets = max(width(spark), prefixes // (8 * BUCKET))
    lists = classes.select("rep", "n", "tokens").mapInArrow(_send(buckets, levels), "bucket int, token binary, rep binary, n binary")
    sets = lists.repartitionById(buckets, "bucket").mapInArrow(_live(levels), "sa long, sb long, salts long, w long, reps binary, ns binary")
    sets = sets.groupBy("sa", "sb", "salts").agg(F.sum("w").alias("w"), F.first("reps").alias("reps"), F.first("ns").alias("ns"))
    live = sets.mapInArrow(_unpack, "sid long, rep long, n int, w long, salts long")
    live = materialise(live.withColumn("band", band(F.col("n"), percent)).withColumn("salt", F.pmod(F.xxhash64("rep"), "salts")), "live")
    # stars around the class of a tile that shares most of its shingles
    shared = live.groupBy("rep").agg((F.sum("w") / F.first("n")).alias("shared"))
    rated = live.join(shared, "rep")
    leaders = rated.groupBy("sid", "band").agg(F.min(F.struct(-F.col("shared"), "n", "rep")).alias("top"), F.first("salts").alias("salts"))
    leaders = _salted(leaders.select("sid", "band", F.col("top.rep").alias("lead"), F.col("top.n").alias("lead_n"), "salts"), "sid", "band")
    near = [live.join(leaders.withColumn("band", F.col("band") + shift), ["sid", "band", "salt"]) for shift in (0, 1)]
    stars = near[0].unionByName(near[1]).where(f"rep <> lead and 100 * least(n, lead_n) >= {percent} * greatest(n, lead_n)")
    stars = stars.select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b")).distinct()
    stars = materialise(_possible(stars, classes, percent), "stars-to-try")
    links = _verified(stars, classes, base, words, percent)
    found = components(links)
    # what the stars leave: tiles of a band (up 0) and the next one (up 1) whose classes are not all in one component
    placed = live.join(found, live["rep"] == found["id"], "left").select("sid", "rep", "n", "band", "salt", "salts", F.coalesce("component", "rep").alias("comp"))
    both = F.explode(F.array(F.struct(F.col("band").alias("tile"), F.lit(0).alias("up")), F.struct((F.col("band") - 1).alias("tile"), F.lit(1).alias("up")))).alias("t")
    placed = placed.select("sid", "rep", "n", "comp", "salt", "salts", both).select("sid", "rep", "n", "comp", "salt", "salts", "t.*")
    open_tiles = placed.groupBy("sid", "tile").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("c"), F.min("up").alias("up"), F.first("salts").alias("salts"))
    open_tiles = _salted(open_tiles.where("x <> y and up = 0").select("sid", "tile", F.ceil(F.col("c") / CHUNK).cast("int").alias("k"), "salts"), "sid", "tile")
    rest = placed.drop("salts").join(open_tiles, ["sid", "tile", "salt"]).withColumn("i", F.pmod(F.hash("rep"), F.col("k")))
    chunk = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.struct(F.least("i", j).alias("p"), F.greatest("i", j).alias("q"), F.when(j == F.col("i"), 2).otherwise((F.col("i") > j).cast("int")).alias("side")))
    rest = rest.select("sid", "tile", "up", "rep", F.col("n").cast("long").alias("n"), "comp", F.explode(chunk).alias("t")).select("sid", "tile", "up", "rep", "n", "comp", "t.*")
    rest = rest.join(classes.select("rep", "sign"), "rep").repartition(buckets, "sid", "tile", "p", "q").sortWithinPartitions("sid", "tile", "p", "q", "n")
    more = rest.mapInArrow(_compare(percent), "a long, b long").distinct().join(stars, ["a", "b"], "left_anti")
    more = materialise(more, "rest-to-try")
    if not more.isEmpty():
        found = components(links.unionByName(_verified(more, classes, base, words, percent)))
    own = classes.select("fa", "fb", "rep").join(found, classes["rep"] == found["id"], "left").select("fa", "fb", F.coalesce("component", "rep").alias("component_id"))
    rows = signed.select("rid", "doc_id", "n", "fa", "fb").join(own, ["fa", "fb"], "left")
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id"))
    return materialise(rows.select("rid", "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")), "components", outer=True)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of docs."""
    with scope(docs.sparkSession):
        base = numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "rows")
        return _components(base, words, percent).drop("rid")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without those that are in a component with a smaller id; all columns stay as they are.

    Rows with null ids stay; of rows that repeat the smallest id of a component all stay."""
    base = numbered(wrapped(docs), "rows")
    with scope(docs.sparkSession):
        rows = base.select("part", "rid", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").cast("string").alias("text"))
        gone = _components(rows, WORDS, PERCENT).where("doc_id <> component_id").select("rid")
    return by_number(base, gone, "left_anti").select("row.*")
