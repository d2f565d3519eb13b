"""Line dedup by a log-template tree of fixed depth, in DataFrame functions only.

A line's way through the tree is its number of tokens, then its first DEPTH tokens; a token with a digit is a variable field
<*>.  A leaf holds groups of like lines.  Each place's tokens are counted over the leaf's lines, and a token's level is the
power of two of its count in units of min_docs.  For each level of a line's tokens, the line's template keeps the tokens of
that level or more and generalises the rest to <*>; it must keep SHARE of the places behind the leading ones, so that the
leaf alone is no likeness.  A template's constant tokens all have its own count or more, so one of these templates keeps
just them, however many other lines share the leaf.

A masked line is dropped when it recurs in min_docs documents, or when a template of its recurs: lines with that template
come from min_docs documents, each counted once.

Scale: rows are written once with numbers, and results meet them by number without moving texts.  Leaves, tokens and templates
are counted by hash with partial sums.  Documents are told apart only for templates all whose lines are rare, so a line or
leaf of a third of all rows is summed before it is moved.

Defined cases: lines end at \\n, tokens are what single spaces separate; empty lines always stay; null text is an empty one (one
empty line); ids may be null or repeat, each row counts as a document; lines that repeat inside a document are all dropped or
all stay; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import by_number, materialise, numbered

DEPTH, MIN_DOCS, SHARE, SALTS = 3, 5, 0.6, 16


def _masked(line: Column) -> Column:
    hidden = F.array_join(F.transform(F.split(line, " "), lambda t: F.when(t.rlike("[0-9]"), "<*>").otherwise(t)), " ")
    return F.when(line.rlike("[0-9]"), hidden).otherwise(line)


def _size(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _leaf(masked: Column, depth: int) -> Column:
    return F.xxhash64(_size(masked), F.substring_index(masked, " ", depth))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped): each document without the lines whose template recurs."""
    docs = numbered(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), "rows")
    places = docs.select("rid", F.posexplode(_lines(F.col("text"))).alias("pos", "line")).where("line <> ''").withColumn("masked", _masked(F.col("line")))
    places = materialise(places.select("rid", "pos", _leaf(F.col("masked"), depth).alias("leaf"), F.xxhash64("masked", F.lit(1)).alias("mark")), "lines")
    # lines of leaves that recur, a document once
    leaves = places.select("rid", "leaf").distinct().groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    own = docs.select("rid", F.explode(F.array_distinct(F.transform(_lines(F.col("text")), _masked))).alias("masked")).where("masked <> ''")
    own = own.withColumn("leaf", _leaf(F.col("masked"), depth)).withColumn("salt", F.pmod(F.xxhash64("masked", "rid"), F.lit(SALTS)))
    leaves = leaves.select("leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")).repartition("leaf", "salt")  # a leaf's lines in several tasks
    own = own.join(leaves, ["leaf", "salt"], "left_semi")
    lines = materialise(own.groupBy("leaf", "masked").agg(F.count("*").alias("docs")).withColumn("mark", F.xxhash64("masked", F.lit(1))), "masked-lines")
    # levels of the tokens behind the leading ones
    words = F.posexplode(F.slice(F.split("masked", " "), depth + 1, 1 << 30)).alias("at", "token")
    tokens = lines.where(_size(F.col("masked")) > depth).select("leaf", "mark", "docs", (_size(F.col("masked")) - depth).alias("n"), words).where("token <> '<*>'")
    counts = tokens.groupBy("leaf", "at", "token").agg(F.sum("docs").alias("c")).where(F.col("c") >= min_docs)
    counts = counts.select("leaf", "at", "token", F.length(F.bin(F.expr(f"c div {min_docs}"))).alias("level"))
    rated = tokens.join(counts, ["leaf", "at", "token"]).groupBy("leaf", "mark").agg(F.first("docs").alias("docs"), F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "token", "level"))).alias("tokens"))
    # a template for each level that keeps enough of them
    rated = rated.where(F.size("tokens") >= share * F.col("n")).withColumn("least", F.explode(F.array_distinct("tokens.level")))
    rated = rated.withColumn("kept", F.filter("tokens", lambda t: t["level"] >= F.col("least"))).where(F.size("kept") >= share * F.col("n"))
    template = F.xxhash64("leaf", F.transform("kept", lambda t: F.struct(t["at"], t["token"])))
    fits = materialise(rated.select("leaf", "mark", "docs", template.alias("template")), "templates")
    sums = fits.groupBy("template").agg(F.max("docs").alias("most"), F.sum("docs").alias("all"))
    rare = sums.where((F.col("most") < min_docs) & (F.col("all") >= min_docs)).select("template")  # whose documents must be told apart
    rare = fits.join(rare, "template").select("leaf", "mark", "template").join(places.select("rid", "leaf", "mark"), ["leaf", "mark"]).select("template", "rid").distinct()
    recurring = sums.where(F.col("most") >= min_docs).select("template").unionByName(rare.groupBy("template").count().where(F.col("count") >= min_docs).select("template"))
    dropped = lines.where(F.col("docs") >= min_docs).select("leaf", "mark").unionByName(fits.join(recurring, "template", "left_semi").select("leaf", "mark")).distinct()
    gone = places.join(dropped, ["leaf", "mark"], "left_semi").groupBy("rid").agg(F.collect_list("pos").alias("gone"))  # places of one document
    lines = _lines(F.col("text"))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone"), lambda i: F.get(lines, i))
    return by_number(docs, gone, "left").select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(left, "\n")).alias("text"),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


ORACLE = f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
    m AS (SELECT doc_id, pos, line, array_to_string(list_transform(string_split(line, ' '), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END), ' ') AS masked,
                 len(string_split(line, ' ')) AS n FROM l),
    p AS (SELECT *, concat(n, ' ', array_to_string(string_split(masked, ' ')[1:{DEPTH}], ' ')) AS leaf FROM m WHERE line <> ''),
    u AS (SELECT DISTINCT doc_id, leaf, masked, n FROM p),
    lines AS (SELECT leaf, masked, n - {DEPTH} AS n, count(*) AS docs FROM u GROUP BY leaf, masked, n),
    t AS (SELECT leaf, masked, n, docs, unnest(string_split(masked, ' ')[{DEPTH + 1}:]) AS token, generate_subscripts(string_split(masked, ' ')[{DEPTH + 1}:], 1) AS place
          FROM lines WHERE n > 0 AND leaf IN (SELECT leaf FROM u GROUP BY leaf HAVING count(DISTINCT doc_id) >= {MIN_DOCS})),
    c AS (SELECT leaf, place, token, length(bin(CAST(sum(docs) // {MIN_DOCS} AS BIGINT))) AS level FROM t WHERE token <> '<*>' GROUP BY leaf, place, token HAVING sum(docs) >= {MIN_DOCS}),
    r AS (SELECT t.leaf, t.masked, t.n, t.place, t.token, c.level FROM t JOIN c ON t.leaf = c.leaf AND t.place = c.place AND t.token = c.token),
    v AS (SELECT DISTINCT leaf, masked, level AS least FROM r),
    fits AS (SELECT r.leaf, r.masked, v.least, string_agg(concat(r.place, ' ', r.token), ' ' ORDER BY r.place) AS template
             FROM r JOIN v ON r.leaf = v.leaf AND r.masked = v.masked AND r.level >= v.least GROUP BY r.leaf, r.masked, r.n, v.least HAVING count(*) >= {SHARE} * r.n),
    recurring AS (SELECT f.leaf, f.template FROM fits f JOIN u ON u.leaf = f.leaf AND u.masked = f.masked GROUP BY f.leaf, f.template HAVING count(DISTINCT u.doc_id) >= {MIN_DOCS}),
    gone AS (SELECT leaf, masked FROM lines WHERE docs >= {MIN_DOCS}
             UNION SELECT f.leaf, f.masked FROM fits f JOIN recurring USING (leaf, template)),
    mark AS (SELECT m.doc_id, m.pos, m.line, g.leaf IS NOT NULL AS dropped
             FROM m LEFT JOIN p USING (doc_id, pos) LEFT JOIN gone g ON g.leaf = p.leaf AND g.masked = p.masked)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS text_sha256
    FROM mark GROUP BY doc_id"""
