"""Alignment of time points with the edges of intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest(points: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, t) points and edges -> (key, t, lo, hi): the last edge at or before and the first at or after each point.

    Both sides are laid out together in order of time and the edges carried forward and, in the reverse order, backward:
    one exchange and a sort each way, where a range join would pair every point with every edge.
    """
    both = points.select(key, "t", F.lit(None).cast("double").alias("x")).unionByName(edges.select(key, "t", F.col("t").alias("x")))
    # Peers of one time count on both sides, so that an edge at the point itself is found.
    upto = lambda order: Window.partitionBy(key).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("lo", F.max("x").over(upto(F.col("t")))).withColumn("hi", F.min("x").over(upto(F.col("t").desc())))
    return out.where("x is null").select(key, "t", "lo", "hi")


def locate(points: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Adds place (exact, inside, outside) and ms, the signed distance to the nearest edge; a tie goes to the earlier one."""
    n = nearest(points, edges, key)
    place = F.when(F.col("lo") == F.col("t"), "exact").when(F.col("lo").isNull() | F.col("hi").isNull(), "outside").otherwise("inside")
    left, right = F.col("t") - F.col("lo"), F.col("t") - F.col("hi")
    ms = F.when(F.col("lo").isNull(), right).when(F.col("hi").isNull() | (left <= -right), left).otherwise(right)
    return n.select(key, "t", place.alias("place"), ms.alias("ms"))


def locate_in_tier(points: DataFrame, tier: DataFrame, key: str) -> DataFrame:
    """(key, t) points against (key, xmin, xmax, pause) intervals -> key, t, place, ms.

    place is exact on an edge, else outside of the tier's extent, in_pause or in_word strictly inside an interval, or
    in_gap between two. The interval is the last that begins at or before the point, carried along in order of time.
    """
    edges = tier.select(key, F.explode(F.array("xmin", "xmax")).alias("t")).distinct()
    near = nearest(points, edges, key)
    both = near.select(key, "t", "lo", "hi", F.lit(None).cast("struct<xmax:double,pause:boolean>").alias("iv"), F.lit(1).alias("point"))
    starts = tier.select(key, F.col("xmin").alias("t"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.struct("xmax", "pause").alias("iv"), F.lit(0).alias("point"))
    w = Window.partitionBy(key).orderBy("t", "point").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = both.unionByName(starts).withColumn("iv", F.last("iv", ignorenulls=True).over(w)).where("point = 1")
    inside = F.coalesce(F.col("t") < F.col("iv.xmax"), F.lit(False))
    place = (
        F.when(F.col("lo") == F.col("t"), "exact").when(F.col("lo").isNull() | F.col("hi").isNull(), "outside")
        .when(inside & F.col("iv.pause"), "in_pause").when(inside, "in_word").otherwise("in_gap")
    )
    left, right = F.col("t") - F.col("lo"), F.col("t") - F.col("hi")
    ms = F.when(F.col("lo").isNull(), right).when(F.col("hi").isNull() | (left <= -right), left).otherwise(right)
    return x.select(key, "t", place.alias("place"), ms.alias("ms"))


def directional(points: DataFrame, edges: DataFrame, key: str, tolerance: float, name: str) -> DataFrame:
    """Counts by key of the points that are edges, within a tolerance of one, or alone: columns name_exact, name_within, name_only."""
    n = nearest(points, edges, key)
    far = F.least(F.col("t") - F.col("lo"), F.col("hi") - F.col("t"))
    exact, close = F.coalesce(F.col("lo") == F.col("t"), F.lit(False)), F.coalesce(far <= tolerance, F.lit(False))
    return n.groupBy(key).agg(F.count_if(exact).alias(f"{name}_exact"), F.count_if(~exact & close).alias(f"{name}_within"), F.count_if(~exact & ~close).alias(f"{name}_only"))
