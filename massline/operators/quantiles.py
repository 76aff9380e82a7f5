"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that the values of all groups are cut into.
RANGES = 256


def quantiles(rows: DataFrame, by: str, value: str, shares: dict[str, float], ranges: int = RANGES) -> DataFrame:
    """(by, value) -> by and a column for each share: the value at 1 + (n - 1) share, between neighbours in proportion.

    Values are cut into ranges by quantiles of a sample, counts of the ranges give each range its first rank, and only the
    ranges that hold a wanted rank are ranked, each by itself. No task holds a group. The sample is taken by a hash of the
    value: the plan reads the ranges more than once, and each time they must be the same ones.
    """
    x = rows.select(by, F.col(value).cast("double").alias("_x")).where("_x is not null")
    equal = x.groupBy(by, "_x").agg(F.count("*").alias("_c"))
    known = equal.join(equal.groupBy(by).agg(F.sum("_c").alias("_n"), F.count("*").alias("_d")), by)
    every = F.greatest(F.lit(1), F.floor(F.col("_d") / (10 * ranges)))
    sample = known.where(F.pmod(F.xxhash64("_x"), every) == 0).groupBy(by).agg(F.sort_array(F.collect_list("_x")).alias("_s"))
    cuts = sample.select(by, F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), lambda i: F.element_at("_s", F.greatest(F.lit(1), F.ceil(F.size("_s") * i / ranges).cast("int")))).alias("_cuts"))
    # Cuts ascend, so that those below a value are as many as its range's number.
    placed = known.join(cuts, by, "left").withColumn("_part", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_x"))), F.lit(0)))
    per = placed.groupBy(by, "_n", "_part").agg(F.sum("_c").alias("_k"))
    per = per.withColumn("_first", F.coalesce(F.sum("_k").over(Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    want = F.array(*[F.struct(F.lit(name).alias("_name"), (1 + (F.col("_n") - 1) * share).alias("_at")) for name, share in shares.items()])
    asked = per.select(by, "_part", "_first", "_k", F.explode(want).alias("_w")).select(by, "_part", "_first", "_w._name", "_w._at", "_k")
    # A rank between two values needs both, which may lie in different ranges.
    asked = asked.where((F.ceil("_at") > F.col("_first")) & (F.floor("_at") <= F.col("_first") + F.col("_k")))
    inside = placed.join(per.select(by, "_part", "_first"), [by, "_part"]).join(asked.select(by, "_part").distinct(), [by, "_part"], "left_semi")
    upto = F.col("_first") + F.sum("_c").over(Window.partitionBy(by, "_part").orderBy("_x"))
    ranked = inside.select(by, "_part", "_x", upto.alias("_hi"), (upto - F.col("_c") + 1).alias("_lo"))
    hit = ranked.join(asked.select(by, "_part", "_name", "_at"), [by, "_part"]).where((F.col("_lo") <= F.ceil("_at")) & (F.col("_hi") >= F.floor("_at")))
    low = F.max(F.when((F.col("_lo") <= F.floor("_at")) & (F.col("_hi") >= F.floor("_at")), F.col("_x")))
    high = F.max(F.when((F.col("_lo") <= F.ceil("_at")) & (F.col("_hi") >= F.ceil("_at")), F.col("_x")))
    out = hit.groupBy(by, "_name", "_at").agg(low.alias("_a"), high.alias("_b"))
    value_at = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_at") - F.floor("_at"))
    return out.groupBy(by).agg(*[F.max(F.when(F.col("_name") == name, value_at)).alias(name) for name in shares])
