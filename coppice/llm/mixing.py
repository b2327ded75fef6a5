"""Mixing sources to target weights, with DataFrame functions only.

Each document gets a hash-random key. Within a source, documents are range-sorted by key: the key space is cut into
ranges of RANGE documents or so, prefix sums run within ranges and over the totals of ranges, and the two add up to the
document's place in its source. A source's target is cut at the exact word: whole epochs first, then the documents
whose words end before the rest of the budget, and the words of the one that crosses it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save

#: Documents meant for one key range, and the most ranges of a source.
RANGE, MOST_RANGES = 128, 65_536
#: A source is used at most so many times over.
EPOCHS = 3
WORDS = r"[^\x20\x09-\x0D]++"
#: Keys are whole numbers below this: fifteen hexadecimal digits.
KEYS = 1 << 60


def word_count(text):
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, size, n) -> with target: 100% of all sizes shared by weight, never above EPOCHS times the source's size.

    Sources are few, one row each, so that windows over all of them are small. The excess of full sources is reshared:
    a level t gives each source min(EPOCHS * size, weight * t); sources fill up in the order of EPOCHS * size / weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    all_rows = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    out = sizes.withColumn("w", pick.cast("double")).withColumn("cap", (F.col("size") * EPOCHS).cast("double"))
    left = F.sum("size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    share = F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    out = out.withColumn("level", left / share)
    # The level of the first source that does not fill up holds for all after it.
    out = out.withColumn("t", F.first(F.when(F.col("cap") >= F.col("w") * F.col("level"), F.col("level")), ignorenulls=True).over(all_rows))
    return out.withColumn("target", F.least("cap", F.col("w") * F.coalesce("t", F.lit(float("inf"))))).select("source", "size", "n", "target")


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """rows with `again`: 0 for the first row of its key, then 1, 2 and so on. Rows are counted within the parts that
    they are saved in, then parts before each other, so that no task gets all rows of a key."""
    part = F.shiftright("row", 33)
    parts = rows.groupBy(key, part.alias("part")).agg(F.count("*").alias("n"))
    more = parts.groupBy(key).agg(F.sum("n").alias("all")).filter("all > 1")
    parts = parts.join(more, key).withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = rows.withColumn("part", part).join(parts, [key, "part"])
    again = F.col("before") + F.row_number().over(Window.partitionBy(key, "part").orderBy("row")) - 1
    return rows.join(own.select("row", again.alias("again")), "row", "left").withColumn("again", F.coalesce("again", F.lit(0)))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), seed: str = "mix", draw_col: str | None = None) -> DataFrame:
    """One row per input row: id, size (words), source_size, target, taken (words the mix takes, repeats counted).

    draw_col: what a row's place is drawn by; the id unless given, or the text of a row without one. Rows that are drawn
    alike get places of their own, in any order. Null and wordless texts have size 0 and take nothing. Null sources are
    one source, the last. A source of size 0 has target 0. An empty table gives no rows.
    """
    text = F.col(text_col).cast("string")
    draw = F.concat_ws(":", F.lit(seed), F.coalesce(F.col(draw_col or id_col).cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))

    def place(draw):
        return F.conv(F.substring(F.md5(draw.cast("binary")), 1, 15), 16, 10).cast("long")

    rows = docs.select(F.col(id_col).alias("id"), word_count(text).alias("size"), F.col(source_col).alias("source"), place(draw).alias("key"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = save(rows, "mix-rows")
    # A row that is drawn like others gets a key of its own for each of them but the first.
    if not rows.groupBy("key").count().filter("count > 1").isEmpty():
        later = place(F.concat_ws(":", F.col("key").cast("string"), F.col("again").cast("string")))
        rows = save(numbered(rows, "key").withColumn("key", F.when(F.col("again") > 0, later).otherwise(F.col("key"))).drop("again"), "mix-places")
    rows = rows.drop("row")
    shares = targets(rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")), weights)
    shares = shares.withColumn("ranges", F.least(F.ceil(F.col("n") / RANGE), F.lit(MOST_RANGES)).cast("long"))
    shares = save(shares.withColumnRenamed("size", "source_size"), "mix-sources")

    # Sources are few; the join broadcasts them only while their size is below Spark's checked threshold.
    width = F.ceil(F.lit(KEYS) / F.col("ranges")).cast("long")
    named = rows.join(shares, rows.source.eqNullSafe(shares.source)).select(rows["*"], "source_size", "target", (F.col("key") / width).cast("long").alias("range"))
    in_range = Window.partitionBy("source", "range").orderBy("key", "id", "size")
    placed = named.withColumn("upto", F.sum("size").over(in_range.rowsBetween(Window.unboundedPreceding, 0)))
    totals = named.groupBy("source", "range").agg(F.sum("size").alias("total"))
    ranges = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("source", "range", F.coalesce(F.sum("total").over(ranges), F.lit(0)).alias("start"))
    starts = starts.withColumnsRenamed({"source": "s", "range": "r"})
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    end = F.col("start") + F.col("upto")
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    last = F.greatest(F.lit(0), F.least("size", rest - (end - F.col("size"))))
    return placed.select(F.col("id").alias(id_col), "size", "source_size", "target", (epochs * F.col("size") + last).cast("long").alias("taken"))


def apply_mix(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mix itself: each document once for every whole time it is taken, then its first words where a cut falls in it.

    Ids must be unique. A document of no words stays out; an empty mix gives no rows.
    """
    taken = mixed.filter("taken > 0").select(F.col(id_col).alias("_mixed"), F.col("size").alias("_size"), F.col("taken").alias("_taken"))
    out = docs.join(taken, docs[id_col] == taken["_mixed"])
    times = F.explode(F.sequence(F.lit(1), F.ceil(F.col("_taken") / F.col("_size")).cast("int"))).alias("_time")
    out = out.select(*docs.columns, "_size", "_taken", times)
    words = F.least("_size", F.col("_taken") - (F.col("_time") - 1) * F.col("_size"))
    pattern = F.concat(F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), words.cast("string"), F.lit("}+"))
    cut = F.when(words < F.col("_size"), F.regexp_substr(F.col(text_col), pattern)).otherwise(F.col(text_col))
    return out.withColumn(text_col, cut).select(docs.columns)


#: The query over documents in DuckDB's SQL. Few sources fill up, so resharing them takes a few rounds of recursion.
ORACLE = r"""
WITH RECURSIVE drawn AS (SELECT row_number() OVER () AS rn, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
  ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 15))::BIGINT AS first FROM documents),
again AS (SELECT *, row_number() OVER (PARTITION BY first ORDER BY rn) - 1 AS again FROM drawn),
rows AS (SELECT rn, doc_id, source, size, CASE WHEN again = 0 THEN first ELSE ('0x' || substr(md5(first || ':' || again), 1, 15))::BIGINT END AS key FROM again),
src AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM rows GROUP BY source),
fill(round, source, source_size, w, target, full_up) AS (
  SELECT 0, source, source_size, w, 0.0::DOUBLE, false FROM src UNION ALL
  SELECT round + 1, source, source_size, w,
    CASE WHEN full_up THEN 3.0 * source_size ELSE least(3.0 * source_size, w * lev) END::DOUBLE, full_up OR 3.0 * source_size < w * lev
  FROM (SELECT *, (sum(source_size) OVER () - sum(CASE WHEN full_up THEN 3.0 * source_size ELSE 0 END) OVER ())::DOUBLE / nullif(sum(CASE WHEN full_up THEN 0 ELSE w END) OVER (), 0) AS lev FROM fill)
  WHERE round < 30),
t AS (SELECT source, source_size, target, round(target)::BIGINT AS budget FROM fill WHERE round = 30),
placed AS (SELECT r.*, t.source_size, t.target, t.budget, sum(size) OVER (PARTITION BY r.source ORDER BY key, doc_id, size, rn) AS upto
  FROM rows r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM placed)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - epochs * source_size - (upto - size))))::BIGINT AS taken FROM e
"""
