"""Queries on events: time tiers, alignment, nearest edges, coverage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import align as A
from ..operators import quantiles as Q
from .registry import query, read

MS = "CAST(epoch_us(ts) AS DOUBLE) / 1000"
# A tier of intervals: a user's views, each lasting until the next; the points are their clicks.
TIER = f"""e AS (SELECT user_id, event_type, {MS} AS t FROM events),
tier AS (SELECT user_id, t AS xmin, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS xmax FROM (SELECT DISTINCT user_id, t FROM e WHERE event_type = 'view')),
edge AS (SELECT user_id, xmin AS x FROM tier), clicks AS (SELECT DISTINCT user_id, t FROM e WHERE event_type = 'click')"""
LOC = f"""{TIER}, near AS (SELECT c.user_id, c.t, b.x AS lo, a.x AS hi FROM clicks c ASOF LEFT JOIN edge b ON b.user_id = c.user_id AND b.x <= c.t ASOF LEFT JOIN (SELECT user_id, x FROM edge) a ON a.user_id = c.user_id AND a.x >= c.t),
loc AS (SELECT user_id, t, CASE WHEN lo = t THEN 'exact' WHEN lo IS NULL OR hi IS NULL THEN 'outside' ELSE 'inside' END AS place,
  CASE WHEN lo IS NULL THEN t - hi WHEN hi IS NULL OR t - lo <= hi - t THEN t - lo ELSE t - hi END AS ms FROM near)"""


def _points(spark, d, kind):
    t = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").cast("double") / 1000
    return read(spark, d, "events").where(F.col("event_type") == kind).select("user_id", t.alias("t")).distinct()


def _located(spark, d):
    return A.locate(_points(spark, d, "click"), _points(spark, d, "view"), "user_id")


@query(f"WITH {LOC} SELECT user_id, round(t, 3) AS t, place, round(ms, 3) AS offset_ms FROM loc")
def locate_boundaries(spark, d):
    return _located(spark, d).select("user_id", F.round("t", 3).alias("t"), "place", F.round("ms", 3).alias("offset_ms"))


BIN = "CASE " + " ".join(f"WHEN abs(ms) / 1000 <= {e} THEN '({lo},{e:g}]'" for lo, e in zip(["0", *[f"{x:g}" for x in T.EDGES]], T.EDGES)) + f" ELSE '({T.EDGES[-1]:g},inf)' END"


@query(f"WITH {LOC} SELECT place, {BIN} AS bin, count(*) AS n FROM loc WHERE ms IS NOT NULL GROUP BY 1, 2")
def offset_bins(spark, d):
    # Events lie further apart than annotations: seconds stand in for milliseconds.
    x = _located(spark, d).where("ms is not null")
    return x.groupBy("place", T.bin_of(F.abs("ms") / 1000).alias("bin")).agg(F.count("*").alias("n"))


@query(f"""WITH {LOC} SELECT place, count(*) AS n, round(quantile_cont(ms, 0.25), 3) AS q1, round(quantile_cont(ms, 0.5), 3) AS median, round(quantile_cont(ms, 0.75), 3) AS q3, count(*) FILTER (ms < 0) AS earlier, count(*) FILTER (ms > 0) AS later FROM loc GROUP BY place""")
def alignment_summary(spark, d):
    # Equal values are counted first, so that what a place's ranks are found on is a value and its count, not a row; and the
    # ranks come from running sums over ranges of values, which any number of tasks share.
    x = _located(spark, d)
    at = Q.quantiles(x.where("ms is not null"), "place", "ms", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    g = x.groupBy("place").agg(F.count("*").alias("n"), F.count_if(F.col("ms") < 0).alias("earlier"), F.count_if(F.col("ms") > 0).alias("later"))
    return g.join(at, "place", "left").select("place", "n", *[F.round(k, 3).alias(k) for k in ("q1", "median", "q3")], "earlier", "later")


TOL = 60_000


@query(f"WITH {LOC} SELECT user_id, count(*) FILTER (place = 'exact') AS a_exact, count(*) FILTER (place <> 'exact' AND abs(ms) <= {TOL}) AS a_within, count(*) FILTER (place <> 'exact' AND coalesce(abs(ms) > {TOL}, true)) AS a_only FROM loc GROUP BY user_id")
def directional_compare(spark, d):
    x = _located(spark, d)
    near = F.coalesce(F.abs("ms") <= TOL, F.lit(False))
    return x.groupBy("user_id").agg(F.count_if(F.col("place") == "exact").alias("a_exact"), F.count_if((F.col("place") != "exact") & near).alias("a_within"), F.count_if((F.col("place") != "exact") & ~near).alias("a_only"))


@query(f"WITH e AS (SELECT user_id, {MS} AS t, lead({MS}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) SELECT user_id, count(*) AS n, count(*) FILTER (nxt - t > 3600000) AS gaps, round(max(nxt - t), 3) AS widest_ms FROM e GROUP BY user_id")
def gaps_contiguity(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").cast("double") / 1000
    x = read(spark, d, "events").select("user_id", (F.lead(t).over(w) - t).alias("gap"))
    return x.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("gap") > 3600000).alias("gaps"), F.round(F.max("gap"), 3).alias("widest_ms"))


@query("SELECT CASE WHEN regexp_matches(event_type, '^[a-e]') THEN event_type ELSE '<other>' END AS label, count(*) AS n FROM events GROUP BY 1")
def label_counts_safe(spark, d):
    return read(spark, d, "events").groupBy(F.when(F.col("event_type").rlike("^[a-e]"), F.col("event_type")).otherwise("<other>").alias("label")).agg(F.count("*").alias("n"))


@query("""WITH u AS (SELECT DISTINCT user_id FROM events), k AS (SELECT DISTINCT event_type FROM events), c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, event_type, coalesce(n, 0) AS n, n IS NOT NULL AS present FROM u CROSS JOIN k LEFT JOIN c USING (user_id, event_type)""")
def coverage_densified(spark, d):
    c = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    # Every user meets every code, which is the result itself; neither side is broadcast by hint, as both may grow.
    full = c.select("user_id").distinct().crossJoin(c.select("event_type").distinct())
    return full.join(c, ["user_id", "event_type"], "left").select("user_id", "event_type", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("present"))


@query("SELECT event_type, date_trunc('day', ts)::DATE::VARCHAR AS day, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_days(spark, d):
    g = read(spark, d, "events").groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"))
    return g.select("event_type", F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n", "users", "total")


@query("""WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
y AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM x), z AS (SELECT user_id, s, count(*) AS n FROM y GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM z GROUP BY user_id""")
def session_windows(spark, d):
    s = read(spark, d, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))
