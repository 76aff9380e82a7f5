"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: No document is taken more often than this.
MOST_EPOCHS = 3
#: Weights of the sources, by code point and repeating; no source comes last.
WEIGHTS = (1, 2, 3)
#: Rows that meet in one range of keys of one source, on average, when it holds all rows.
ROWS_PER_RANGE = 4000
SEED = "mix-1"

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def head(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    gaps = F.transform(F.split(text, WORD, -1), lambda x: F.length(x))
    found = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda x: F.length(x))
    upto = F.slice(F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda a, b: a + b), 1, n.cast("int"))
    return F.substring(text, F.lit(1), F.aggregate(upto, F.lit(0), lambda acc, x: acc + x))


def targets(sized: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, size) -> (source, source_size, target).

    Sharing by weight, with what is above ``most`` times a source's size shared again until none is above, ends at one
    level: every source gets min(most * size, level * weight). With the first k sources
    by most * size / weight capped, what is left over the weights left rises with k up to the right k and falls after
    it, so the level is the largest of them. One row per source is gathered.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Spark compares strings by UTF-8 bytes, which is code point order.
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    chosen = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.select("source", "source_size", chosen.cast("long").alias("weight"))
    order = Window.orderBy((F.col("source_size") * most / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    rest = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    per = (
        per.withColumn("total", F.sum("source_size").over(rest))
        .withColumn("all_weight", F.sum("weight").over(rest))
        .withColumn("capped", F.coalesce(F.sum(F.col("source_size") * most).over(upto), F.lit(0)))
        .withColumn("gone", F.coalesce(F.sum("weight").over(upto), F.lit(0)))
        .withColumn("level", (F.col("total") - F.col("capped")) / (F.col("all_weight") - F.col("gone")))
    )
    level = F.max("level").over(rest)
    target = F.least((F.col("source_size") * most).cast("double"), level * F.col("weight"))
    return per.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, scratch: common.Scratch | None = None, weights: tuple = WEIGHTS, most: int = MOST_EPOCHS, seed: str = SEED, carry: bool = True) -> DataFrame:
    """docs (doc_id, text, source, ...) -> the same rows and columns plus size, source_size, target, taken.

    Each source's rows stand in the order of a hash of their id and text; whole epochs are taken while the target covers
    them, then a head of the order up to the target, the last document in part. Sizes and keys are written once, and all
    counts come from there. A key's leading bits name its range, so the ranges are known without sampling and a retry
    deals the same rows; a running sum over the ranges' totals and one within each range give the prefix sums, and no
    task sees more than one range. Rows that share an id are told apart by their texts, those that share both are
    interchangeable. Null and empty texts have size 0 and are never taken. Columns of docs that are called like the added
    ones are replaced. Without ``carry`` only doc_id and source are kept, and texts are read once. An empty table gives
    an empty one.
    """
    scratch = scratch or common.Scratch(docs.sparkSession, "mix")
    added = ("size", "source_size", "target", "taken")
    kept = [c for c in docs.columns if c not in added] if carry else ["doc_id", "source"]
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5("text"), F.lit(""))))
    measured = lambda *names: docs.select(*names, words(F.col("text")).alias("size"), key.alias("_key"))
    small = scratch.save(measured("doc_id", "source"))
    ranges = max(1, -(-small.count() // ROWS_PER_RANGE))
    place = F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * ranges / F.lit(1 << 32)).cast("long")
    per_range = small.groupBy("source", place.alias("_range")).agg(F.sum("size").alias("_sum"))
    ahead = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_range.select("source", "_range", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_start"))
    per_source = targets(small.select("source", "size"), weights, most)
    starts = starts.join(per_source.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    starts = starts.select(F.col("source").alias("_s"), F.col("_range").alias("_r"), "_start", "source_size", "target")
    rows = (measured(*kept) if carry else small).withColumn("_range", place)
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    within = Window.partitionBy("source", "_range").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_start") + F.coalesce(F.sum("size").over(within), F.lit(0))
    budget = F.floor(F.round("target", 6)).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left - before))
    return rows.withColumn("taken", (epochs * F.col("size") + part).cast("long")).select(*kept, *added)


def op9_mix(spark, sf_dir: str) -> DataFrame:
    out = mix(common.table(spark, sf_dir, "documents").select("doc_id", "text", "source"), carry=False)
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def oracle(weights: tuple = WEIGHTS, most: int = MOST_EPOCHS, seed: str = SEED) -> str:
    return rf"""
WITH sized AS (
  SELECT doc_id, source, md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')) AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([{", ".join(map(str, weights))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} + 1] AS BIGINT) AS weight
  FROM sized GROUP BY source),
run AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight,
    coalesce(sum(source_size * {most}) OVER w, 0) AS capped, coalesce(sum(weight) OVER w, 0) AS gone
  FROM per WINDOW w AS (ORDER BY source_size * {most} / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lev AS (SELECT *, CAST(total - capped AS DOUBLE) / CAST(all_weight - gone AS DOUBLE) AS level FROM run),
tar AS (
  SELECT source, source_size, round(least(CAST(source_size * {most} AS DOUBLE),
    (SELECT max(level) FROM lev) * weight), 6) AS target FROM lev),
cum AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN tar t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
    + greatest(0, least(size, budget - (budget // source_size) * source_size - before)) END AS BIGINT) AS taken
FROM cum"""
