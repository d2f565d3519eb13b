"""Joins, merges and sequences over exploded records; every one keeps its rows distributed by file.

Last-wins and first-wins lookups are max_by and min_by, so that they are summed before rows move.  Range joins go by buckets of
the range's extent instead of all pairs of a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# --- joins


def item_locations(items: DataFrame, extents: DataFrame, key: list[str]) -> DataFrame:
    """items(key, seq, kind) LEFT JOIN extents(key, seq, start, size): last item of a key, first extent of a key."""
    last = items.groupBy(*key).agg(F.max_by("kind", "seq").alias("kind"))
    first = extents.groupBy(*key).agg(F.min_by(F.struct("start", "size"), "seq").alias("e")).select(*key, F.col("e.start").alias("start"), F.col("e.size").alias("size"))
    return last.join(first, key, "left")


def meanings(values: DataFrame, dim: DataFrame, on: list[str], value: str) -> DataFrame:
    """values with text: the meaning of the dim (few rows, broadcast), else Unknown (v)."""
    return values.join(F.broadcast(dim), on, "left").withColumn("text", F.coalesce("meaning", F.concat(F.lit("Unknown ("), F.col(value).cast("string"), F.lit(")"))))


def by_name(names: DataFrame, dim: DataFrame) -> DataFrame:
    """names(name) to (grp, tag) without regard of case; of several groups the one of the least rank."""
    first = dim.groupBy(F.lower("tag_name").alias("low")).agg(F.min_by(F.struct("grp", "tag"), "rank").alias("d"))
    return names.join(F.broadcast(first), F.lower(names["name"]) == F.col("low"), "left").drop("low").select("*", F.col("d.grp").alias("grp"), F.col("d.tag").alias("tag")).drop("d")


def in_range(values: DataFrame, ranges: DataFrame, value: str) -> DataFrame:
    """values LEFT JOIN ranges(lo, hi, label), a table of constants."""
    return values.join(F.broadcast(ranges), F.col(value).between(F.col("lo"), F.col("hi")), "left")


def overlapped(spans: DataFrame, file: str, key: str, start: str, end: str) -> DataFrame:
    """The spans of which another one of the file has bytes too: in order of their starts, the furthest end before a span is
    behind its start, or the next one starts before its end.  Empty spans overlap nothing."""
    order = Window.partitionBy(file).orderBy(start, end, key)
    own = spans.where(F.col(start) < F.col(end))
    reach, follow = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lead(start).over(order)
    met = own.withColumn("__reach", reach).withColumn("__next", follow)
    return met.where((F.col("__reach") > F.col(start)) | (F.col("__next") < F.col(end))).drop("__reach", "__next")


def homes(spans: DataFrame, boxes: DataFrame, file: str, key: str, start: str, end: str) -> DataFrame:
    """spans with the first box (seq, box_start, box_end) of the file that holds all of each; null if none does.  A file has few
    boxes (those that hold media), so they are one row of the file that its spans meet."""
    held = boxes.groupBy(file).agg(F.array_sort(F.collect_list(F.struct("seq", "box_start", "box_end"))).alias("__boxes"))
    inside = F.filter("__boxes", lambda b: (b["box_start"] <= F.col(start)) & (F.col(end) <= b["box_end"]))
    return spans.join(held, file, "left").withColumn("home", F.get(inside, F.lit(0))["seq"]).drop("__boxes")


def missing(subjects: DataFrame, required: DataFrame, present: DataFrame, subject: str, field: str) -> DataFrame:
    """(subject, field) of required constants that present does not have: an anti join on hashed keys."""
    wanted = subjects.select(subject).distinct().withColumn(field, F.explode(F.array(*[F.lit(r[field]) for r in required.select(field).collect()])))  # constants
    return wanted.join(present.select(subject, field), [subject, field], "left_anti")


def scrub(tags: DataFrame, dim: DataFrame, on: list[str], mask: int) -> tuple[DataFrame, DataFrame]:
    """(survivors, removed) of tags whose dim flag is in the mask."""
    chosen = F.broadcast(dim.where(F.col("flag").bitwiseAND(mask) != 0).select(*on).distinct())
    return tags.join(chosen, on, "left_anti"), tags.join(chosen, on, "left_semi")


def first_rule(rows: DataFrame, rules: DataFrame, fits: Column, key: str) -> DataFrame:
    """Each row with the fitting rule of the least rank; rules are constants, a row meets each of them once."""
    met = rows.join(F.broadcast(rules), fits)
    return rows.join(met.groupBy(key).agg(F.min_by("rule", "rank").alias("rule")), key, "left")


def nearest_colour(rows: DataFrame, palette: list[tuple[int, int, int]], r: str, g: str, b: str) -> Column:
    """Index of the palette's colour with the least squared distance, the lowest of equals; the palette is a literal of 256 at most."""
    options = F.array(*[F.struct((F.pow(F.col(r) - x, 2) + F.pow(F.col(g) - y, 2) + F.pow(F.col(b) - z, 2)).alias("d"), F.lit(i).alias("i")) for i, (x, y, z) in enumerate(palette)])
    return F.array_min(options)["i"]


# --- merges


def joined_in_order(chunks: DataFrame, key: list[str], seq: str, data: str, last_wins: bool = True) -> DataFrame:
    """(key, data): chunks in order of seq in a row; of a seq that comes twice the one of the largest pos stays."""
    once = chunks.groupBy(*key, seq).agg((F.max_by if last_wins else F.min_by)(data, "pos").alias(data))
    ordered = once.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(seq, data))).alias("c"))
    return ordered.select(*key, F.array_join(F.transform("c", lambda x: x[data]), "").alias(data))


def first_filled(*columns: Column) -> Column:
    """The first value that has more than blanks, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def ordered_union(*lists: Column) -> Column:
    """Distinct values of all lists in order of their first place."""
    return F.array_distinct(F.filter(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists]), lambda v: v.isNotNull() & (v != "")))


def upsert(left: DataFrame, right: DataFrame, key: list[str], value: str, overwrite: bool = True) -> DataFrame:
    a, b = left.select(*key, F.col(value).alias("a")), right.select(*key, F.col(value).alias("b"))
    return a.join(b, key, "full").select(*key, F.coalesce(*(["b", "a"] if overwrite else ["a", "b"])).alias(value))


def gathered(sets: DataFrame, key: list[str], seq: str, value: str, repeats: Column) -> DataFrame:
    """Values of a repeatable dataset as a list in order, of others the first; at = the place of the first."""
    return sets.groupBy(*key).agg(F.min(seq).alias("at"), F.when(F.first(repeats), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seq, value))), lambda x: x[value]), "|")).otherwise(F.min_by(value, seq)).alias("text"))


def palette(pixels: DataFrame, colour: str, pos: str, cap: int = 256) -> DataFrame:
    """(colour, idx) of the first cap colours by first place: one row a colour, then the cap smallest places."""
    first = pixels.groupBy(colour).agg(F.min(pos).alias("at")).orderBy("at", colour).limit(cap)
    return first.select(colour, (F.row_number().over(Window.orderBy("at", colour)) - 1).cast("long").alias("idx"))  # cap rows at most


def merged_gaps(spans: DataFrame, file: str, start: str, end: str, free: Column) -> DataFrame:
    """Neighbouring free spans of a file as one."""
    order = Window.partitionBy(file).orderBy(start)
    island = F.sum(F.when(free & F.coalesce(F.lag("free").over(order), F.lit(False)) & (F.lag(end).over(order) == F.col(start)), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = spans.withColumn("free", free)
    return rows.withColumn("island", island).groupBy(file, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.max("free").alias("free"), F.count("*").alias("spans")).drop("island")


# --- sequences


def predictor_encode(values: DataFrame, row: list[str], order: list[str], value: str, samples: int = 1) -> DataFrame:
    w = Window.partitionBy(*row).orderBy(*order)
    return values.withColumn("delta", (F.col(value) - F.lag(value, samples, 0).over(w)).bitwiseAND(255))


def predictor_decode(deltas: DataFrame, row: list[str], order: list[str], samples: int = 1) -> DataFrame:
    w = Window.partitionBy(*row).orderBy(*order)
    placed = deltas.withColumn("channel", F.pmod(F.row_number().over(w) - 1, F.lit(samples)))
    total = F.sum("delta").over(Window.partitionBy(*row, "channel").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("value", total.bitwiseAND(255)).drop("channel")


def carried(rows: DataFrame, file: str, order: str, value: Column, reset: Column) -> DataFrame:
    """Each frame with the last control before it that no other frame has used."""
    w = Window.partitionBy(file).orderBy(order)
    group = F.coalesce(F.sum(reset.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("g", group).withColumn("carried", F.last(value, ignorenulls=True).over(Window.partitionBy(file, "g").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))).drop("g")


def interlaced(height: Column, y: Column) -> Column:
    """The place of row y of a four-pass image in the file."""
    up = lambda n, d: F.floor((n + d - 1) / d)
    one, two, three = up(height, 8), up(F.greatest(height - 4, F.lit(0)), 8), up(F.greatest(height - 2, F.lit(0)), 4)
    return F.when(y % 8 == 0, F.floor(y / 8)).when(y % 8 == 4, one + F.floor(y / 8)).when(y % 4 == 2, one + two + F.floor(y / 4)).otherwise(one + two + three + F.floor(y / 2)).cast("long")


def sessions(rows: DataFrame, file: str, order: str, begins: Column) -> DataFrame:
    """Rows numbered by the frame that the last beginning started."""
    return rows.withColumn("frame", F.sum(begins.cast("long")).over(Window.partitionBy(file).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def language_choice(wanted: Column, texts: Column) -> Column:
    """From texts array<struct<lang, text>>: the language itself, its primary part, x-default, then the first."""
    rank = F.transform(texts, lambda x, i: F.struct(F.when(F.lower(x["lang"]) == F.lower(wanted), 0).when(F.lower(F.substring_index(x["lang"], "-", 1)) == F.lower(F.substring_index(wanted, "-", 1)), 1).when(x["lang"] == "x-default", 2).otherwise(3).alias("p"), i.alias("i"), x["text"].alias("text")))
    return F.array_min(rank)["text"]
