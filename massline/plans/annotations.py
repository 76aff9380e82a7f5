"""Queries on annotation tiers: places, comparisons, token classes, codes, inventories of files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import align as A
from ..operators import quantiles as Q
from .registry import query, read

MS = "CAST(epoch_us(ts) AS DOUBLE) / 1000"
#: Longest interval of a tier made of events, and tolerance of a comparison; events lie further apart than annotations.
LONGEST, TOL = 86_400_000, 3_600_000
# A tier: a user's views as intervals up to the next view or LONGEST, pauses where the value is small; points are clicks.
TIER = f"""vt AS (SELECT user_id, {MS} AS xmin, min(value) AS v FROM events WHERE event_type = 'view' GROUP BY ALL),
iv AS (SELECT user_id, xmin, least(coalesce(lead(xmin) OVER w, xmin + {LONGEST}), xmin + {LONGEST}) AS xmax, v < 20 AS pause FROM vt WINDOW w AS (PARTITION BY user_id ORDER BY xmin)),
edge AS (SELECT DISTINCT user_id, x FROM (SELECT user_id, xmin AS x FROM iv UNION ALL SELECT user_id, xmax FROM iv)),
clicks AS (SELECT DISTINCT user_id, {MS} AS t FROM events WHERE event_type = 'click'), views AS (SELECT user_id, xmin AS t FROM vt)"""
LOC = f"""{TIER}, near AS (SELECT c.user_id, c.t, b.x AS lo, a.x AS hi, i.xmax, i.pause FROM clicks c ASOF LEFT JOIN edge b ON b.user_id = c.user_id AND b.x <= c.t
  ASOF LEFT JOIN (SELECT user_id, x FROM edge) a ON a.user_id = c.user_id AND a.x >= c.t ASOF LEFT JOIN iv i ON i.user_id = c.user_id AND i.xmin <= c.t),
loc AS (SELECT user_id, t, CASE WHEN lo = t THEN 'exact' WHEN lo IS NULL OR hi IS NULL THEN 'outside' WHEN t < xmax AND pause THEN 'in_pause' WHEN t < xmax THEN 'in_word' ELSE 'in_gap' END AS place,
  CASE WHEN lo IS NULL THEN t - hi WHEN hi IS NULL OR t - lo <= hi - t THEN t - lo ELSE t - hi END AS ms FROM near)"""
PLACES = ("exact", "in_word", "in_pause", "in_gap", "outside")


def _t():
    return F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").cast("double") / 1000


def _points(spark, d, kind):
    return read(spark, d, "events").where(F.col("event_type") == kind).select("user_id", _t().alias("t")).distinct()


def _tier(spark, d):
    v = read(spark, d, "events").where("event_type = 'view'").groupBy("user_id", _t().alias("xmin")).agg(F.min("value").alias("v"))
    end = F.col("xmin") + F.lit(float(LONGEST))
    after = F.lead("xmin").over(Window.partitionBy("user_id").orderBy("xmin"))
    return v.select("user_id", "xmin", F.least(F.coalesce(after, end), end).alias("xmax"), (F.col("v") < 20).alias("pause"))


def _located(spark, d):
    return A.locate_in_tier(_points(spark, d, "click"), _tier(spark, d), "user_id")


def _r(name, digits=3):
    return T.rounded(name, digits).alias(name)


@query(f"WITH {LOC} SELECT user_id, round(t, 3) AS t, place, round(ms, 3) AS offset_ms FROM loc")
def locate_in_tier(spark, d):
    return _located(spark, d).select("user_id", _r("t"), "place", T.rounded("ms", 3).alias("offset_ms"))


@query(f"""WITH {LOC}, g AS (SELECT coalesce(CAST(user_id AS VARCHAR), 'ALL') AS speaker, {", ".join(f"count(*) FILTER (place = '{p}') AS {p}" for p in PLACES)}, count(*) AS boundaries,
  list(ms) FILTER (place <> 'exact' AND ms IS NOT NULL) AS s, count(*) FILTER (ms < 0) AS earlier, count(*) FILTER (ms > 0) AS later FROM loc GROUP BY GROUPING SETS ((user_id), ()))
SELECT speaker, boundaries, {", ".join(PLACES)}, round(exact / boundaries, 4) AS exact_share, earlier, later,
  {", ".join(f"CASE WHEN len(s) >= 2 THEN round(list_aggregate(s, 'quantile_cont', {q}), 1) END AS {n}" for n, q in (("signed_min", 0.0), ("signed_q1", 0.25), ("signed_median", 0.5), ("signed_q3", 0.75), ("signed_max", 1.0)))} FROM g""")
def alignment_record(spark, d):
    """A row per speaker and one for all: places, share of exact ones, quartiles of the signed offsets of the others."""
    x = _located(spark, d).withColumn("off", F.when(F.col("place") != "exact", F.col("ms")))
    g = x.groupingSets([["user_id"], []], "user_id").agg(
        F.count("*").alias("boundaries"), *[F.count_if(F.col("place") == p).alias(p) for p in PLACES], F.count_if(F.col("ms") < 0).alias("earlier"), F.count_if(F.col("ms") > 0).alias("later"), F.count("off").alias("k"),
    )
    g = g.withColumn("speaker", F.coalesce(F.col("user_id").cast("string"), F.lit("ALL")))
    shares = {"signed_min": 0.0, "signed_q1": 0.25, "signed_median": 0.5, "signed_q3": 0.75, "signed_max": 1.0}
    signed = x.where("off is not null").select(F.explode(F.array(F.col("user_id").cast("string"), F.lit("ALL"))).alias("speaker"), "off")
    at = Q.quantiles(signed, "speaker", "off", shares)
    out = g.join(at, "speaker", "left")
    return out.select("speaker", "boundaries", *PLACES, T.rounded(F.col("exact") / F.col("boundaries"), 4).alias("exact_share"), "earlier", "later", *[F.when(F.col("k") >= 2, T.rounded(s, 1)).alias(s) for s in shares])


@query(f"""WITH {LOC}, b AS (SELECT unnest(['(0,0.001]', '(0.001,1]', '(1,5]', '(5,10]', '(10,20]', '(20,50]', '(50,100]', '(100,500]', '(500,inf)']) AS bin),
n AS (SELECT CASE {" ".join(f"WHEN abs(ms) / 60000 <= {e} THEN '({lo},{e:g}]'" for lo, e in zip(["0", *[f"{x:g}" for x in T.EDGES]], T.EDGES))} ELSE '(500,inf)' END AS bin, count(*) AS k FROM loc WHERE place <> 'exact' AND ms IS NOT NULL GROUP BY 1)
SELECT bin, coalesce(k, 0) AS n FROM b LEFT JOIN n USING (bin)""")
def offset_bins_filled(spark, d):
    """All bins in order, empty ones too; minutes stand in for milliseconds."""
    x = _located(spark, d).where("place <> 'exact' and ms is not null").groupBy(T.bin_of(F.abs("ms") / 60000).alias("bin")).agg(F.count("*").alias("n"))
    edges = ["0", *[f"{e:g}" for e in T.EDGES]]
    bins = [f"({a},{b}]" for a, b in zip(edges, edges[1:])] + [f"({edges[-1]},inf)"]
    full = spark.createDataFrame([(b,) for b in bins], "bin string")
    return full.join(x, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def _way(a, b, name):
    return f"""{name}n AS (SELECT x.user_id, x.t, l.t AS lo, h.t AS hi FROM {a} x ASOF LEFT JOIN {b} l ON l.user_id = x.user_id AND l.t <= x.t ASOF LEFT JOIN (SELECT user_id, t FROM {b}) h ON h.user_id = x.user_id AND h.t >= x.t),
{name}c AS (SELECT user_id, count(*) FILTER (coalesce(lo = t, false)) AS {name}_exact, count(*) FILTER (NOT coalesce(lo = t, false) AND coalesce(least(coalesce(t - lo, 1e300), coalesce(hi - t, 1e300)) <= {TOL}, false)) AS {name}_within,
  count(*) FILTER (NOT coalesce(lo = t, false) AND NOT coalesce(least(coalesce(t - lo, 1e300), coalesce(hi - t, 1e300)) <= {TOL}, false)) AS {name}_only FROM {name}n GROUP BY user_id)"""


def _compared(a, b):
    both = A.directional(a, b, "user_id", TOL, "a").join(A.directional(b, a, "user_id", TOL, "b"), "user_id", "full")
    sizes = a.groupBy("user_id").agg(F.count("*").alias("boundaries_a")).join(b.groupBy("user_id").agg(F.count("*").alias("boundaries_b")), "user_id", "full")
    names = ["boundaries_a", "boundaries_b", *[f"{s}_{k}" for s in "ab" for k in ("exact", "within", "only")]]
    return sizes.join(both, "user_id", "full").select("user_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


RECORD = "user_id, coalesce(na, 0) AS boundaries_a, coalesce(nb, 0) AS boundaries_b, " + ", ".join(f"coalesce({s}_{k}, 0) AS {s}_{k}" for s in "ab" for k in ("exact", "within", "only"))


def _record_sql(a, b):
    return f"""{_way(a, b, "a")}, {_way(b, a, "b")},
sa AS (SELECT user_id, count(*) AS na FROM {a} GROUP BY 1), sb AS (SELECT user_id, count(*) AS nb FROM {b} GROUP BY 1)
SELECT {RECORD} FROM sa FULL JOIN sb USING (user_id) LEFT JOIN ac USING (user_id) LEFT JOIN bc USING (user_id)"""


@query(f"WITH {TIER}, {_record_sql('clicks', 'views')}")
def compare_both_ways(spark, d):
    """Two boundary sets of a speaker against each other, in both directions."""
    return _compared(_points(spark, d, "click"), _points(spark, d, "view"))


@query(f"""WITH {TIER}, win AS (SELECT user_id, min({MS}) AS lo, max({MS}) AS hi FROM events WHERE event_type = 'purchase' GROUP BY 1),
ca AS (SELECT user_id, t FROM clicks JOIN win USING (user_id) WHERE t BETWEEN lo AND hi), cb AS (SELECT user_id, t FROM views JOIN win USING (user_id) WHERE t BETWEEN lo AND hi), {_record_sql('ca', 'cb')}""")
def compare_in_window(spark, d):
    """As above, with both sets held to a third tier's labelled extent."""
    win = _points(spark, d, "purchase").groupBy("user_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    held = lambda kind: _points(spark, d, kind).join(win, "user_id").where("t between lo and hi").select("user_id", "t")
    return _compared(held("click"), held("view"))


@query("""WITH s AS (SELECT user_id, event_type, count(*) AS n, md5(string_agg(concat_ws(':', strftime(ts, '%Y-%m-%d'), CAST(floor(value / 400) AS BIGINT)), '|' ORDER BY ts, event_id)) AS sig FROM events GROUP BY ALL)
SELECT a.user_id, a.event_type AS tier, count(b.event_type) AS copies, min(b.event_type) AS first_copy FROM s a LEFT JOIN s b ON a.sig = b.sig AND a.n = b.n AND (a.user_id <> b.user_id OR a.event_type <> b.event_type) GROUP BY ALL""")
def tier_copies(spark, d):
    """Tiers whose items, in order, are those of another tier: by a signature of the whole list."""
    item = F.concat_ws(":", F.date_format("ts", "yyyy-MM-dd"), F.floor(F.col("value") / 400).cast("string"))
    s = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", item.alias("x")))).alias("xs"))
    s = s.select("user_id", F.col("event_type").alias("tier"), F.size("xs").alias("n"), F.md5(F.array_join(F.transform("xs", lambda x: x["x"]), "|")).alias("sig"))
    # Equal lists meet by aggregation: each learns how many others there are and the least other name, not every pair.
    g = s.groupBy("sig", "n").agg(F.count("*").alias("k"), F.min(F.struct("tier", "user_id")).alias("one"), F.array_sort(F.collect_set("tier")).alias("names"), F.min("tier").alias("least"), F.count_if(F.lit(True)).alias("all"))
    same = s.groupBy("sig", "n", "tier").agg(F.count("*").alias("of_tier"))
    x = s.join(g.select("sig", "n", "k", "names"), ["sig", "n"]).join(same, ["sig", "n", "tier"])
    others = F.when(F.col("of_tier") > 1, F.col("names")).otherwise(F.array_remove("names", F.col("tier")))
    return x.select("user_id", "tier", (F.col("k") - 1).alias("copies"), F.array_min(others).alias("first_copy"))


# The letters of a plain token.
PLAIN_LETTERS = "a-zàâäçéèêëîïôöùûüÿœæ"
PLAIN = f"^[{PLAIN_LETTERS}]+(?:['-][{PLAIN_LETTERS}]+)*'?$"
CLASSES = ("plain", "pause #", "empty label", "no letters", "contains =", "contains digit", "ends in -", "starts with -", "contains _", "contains upper-case", "other character")
# Driver texts have no "#" between their tokens; a lone bar stands in for it.
CLASS_SQL = f"""CASE WHEN regexp_matches(w, '{PLAIN.replace("'", "''")}') THEN 'plain' WHEN w = '|' THEN 'pause #' WHEN trim(w) = '' THEN 'empty label' WHEN NOT regexp_matches(w, '\\p{{L}}') THEN 'no letters' WHEN contains(w, '=') THEN 'contains ='
WHEN regexp_matches(w, '\\p{{Nd}}') THEN 'contains digit' WHEN ends_with(w, '-') THEN 'ends in -' WHEN starts_with(w, '-') THEN 'starts with -' WHEN contains(w, '_') THEN 'contains _' WHEN w <> lower(w) THEN 'contains upper-case' ELSE 'other character' END"""
WORDS = f"x AS (SELECT lang, unnest(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS w FROM documents), c AS (SELECT lang, w, {CLASS_SQL} AS token_class FROM x)"


def token_class(w, pause="#"):
    """The first class that fits; ten ordered tests after the plain form."""
    has = lambda s: w.contains(s)
    return (
        F.when(w.rlike(PLAIN), "plain").when(w == pause, "pause #").when(F.trim(w) == "", "empty label").when(~w.rlike(r"\p{L}"), "no letters").when(has("="), "contains =")
        .when(w.rlike(r"\p{Nd}"), "contains digit").when(w.endswith("-"), "ends in -").when(w.startswith("-"), "starts with -").when(has("_"), "contains _").when(w != F.lower(w), "contains upper-case").otherwise("other character")
    )


def _classed(spark, d):
    w = read(spark, d, "documents").select("lang", F.explode(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("w"))
    # Forms are counted before they are classed: a class is worked out once for each form.
    return w.groupBy("lang", "w").agg(F.count("*").alias("n")).withColumn("token_class", token_class(F.col("w"), "|"))


@query(f"""WITH {WORDS}, k AS (SELECT unnest([{", ".join(f"'{c}'" for c in CLASSES)}]) AS token_class), l AS (SELECT DISTINCT lang FROM documents), n AS (SELECT coalesce(lang, 'ALL') AS speaker, token_class, count(*) AS n FROM c GROUP BY GROUPING SETS ((lang, token_class), (token_class)))
SELECT s.speaker, k.token_class, coalesce(n, 0) AS tokens FROM (SELECT lang AS speaker FROM l UNION ALL SELECT 'ALL') s CROSS JOIN k LEFT JOIN n ON n.speaker = s.speaker AND n.token_class = k.token_class""")
def token_classes(spark, d):
    c = _classed(spark, d).groupingSets([["lang", "token_class"], ["token_class"]], "lang", "token_class").agg(F.sum("n").alias("n")).withColumn("speaker", F.coalesce("lang", F.lit("ALL")))
    names = read(spark, d, "documents").select(F.col("lang").alias("speaker")).distinct().unionAll(spark.createDataFrame([("ALL",)], "speaker string"))
    full = names.select("speaker", F.explode(F.array(*[F.lit(x) for x in CLASSES])).alias("token_class"))
    return full.join(c.select("speaker", "token_class", "n"), ["speaker", "token_class"], "left").select("speaker", "token_class", F.coalesce("n", F.lit(0)).alias("tokens"))


@query(f"WITH {WORDS} SELECT token_class, count(DISTINCT w) AS types_all, count(*) AS tokens_all FROM c WHERE token_class <> 'plain' GROUP BY 1")
def token_class_types(spark, d):
    c = _classed(spark, d).where("token_class <> 'plain'").groupBy("token_class", "w").agg(F.sum("n").alias("n"))
    return c.groupBy("token_class").agg(F.count("*").alias("types_all"), F.sum("n").alias("tokens_all"))


@query(f"WITH {WORDS} SELECT coalesce(lang, 'ALL') AS speaker, count(*) AS intervals, count(*) FILTER (token_class NOT IN ('pause #', 'empty label')) AS non_pause, count(*) FILTER (ends_with(w, '-')) AS ends_in_hyphen, count(DISTINCT CASE WHEN token_class <> 'plain' AND w <> '|' THEN w END) AS nonplain_types, count(*) FILTER (token_class <> 'plain' AND w <> '|') AS nonplain_tokens FROM c GROUP BY GROUPING SETS ((lang), ())")
def token_tier_counts(spark, d):
    c = _classed(spark, d)
    odd = (F.col("token_class") != "plain") & (F.col("w") != "|")
    every = c.unionByName(c.groupBy("w", "token_class").agg(F.sum("n").alias("n")).withColumn("lang", F.lit("ALL")))
    g = every.groupBy(F.col("lang").alias("speaker")).agg(
        F.sum("n").alias("intervals"), F.sum(F.when(F.col("token_class").isin("pause #", "empty label"), 0).otherwise(F.col("n"))).alias("non_pause"), F.sum(F.when(F.col("w").endswith("-"), F.col("n")).otherwise(0)).alias("ends_in_hyphen"),
        F.count_if(odd).alias("nonplain_types"), F.sum(F.when(odd, F.col("n")).otherwise(0)).alias("nonplain_tokens"),
    )
    return g


@query(f"""WITH {TIER}, s AS (SELECT user_id, xmax - xmin AS len, pause, lead(xmin) OVER (PARTITION BY user_id ORDER BY xmin) AS nxt, xmax FROM iv),
g AS (SELECT coalesce(CAST(user_id AS VARCHAR), 'ALL') AS speaker, count(*) AS intervals, count(*) FILTER (pause) AS pauses, list(len / 1000) FILTER (pause) AS p, bool_and(nxt IS NULL OR nxt = xmax) AS contiguous FROM s GROUP BY GROUPING SETS ((user_id), ()))
SELECT speaker, intervals, pauses, {", ".join(f"round(list_aggregate(p, 'quantile_cont', {q}), 3) AS {n}" for n, q in (("pause_min_s", 0.0), ("pause_q1_s", 0.25), ("pause_median_s", 0.5), ("pause_q3_s", 0.75), ("pause_max_s", 1.0)))}, contiguous FROM g""")
def tier_stats(spark, d):
    """Intervals, pauses with quartiles of their length, and whether each interval ends where the next begins; ALL at last."""
    t = _tier(spark, d).withColumn("nxt", F.lead("xmin").over(Window.partitionBy("user_id").orderBy("xmin")))
    t = t.withColumn("len", F.when(F.col("pause"), (F.col("xmax") - F.col("xmin")) / 1000)).select(F.explode(F.array(F.col("user_id").cast("string"), F.lit("ALL"))).alias("speaker"), "len", "pause", (F.col("nxt").isNull() | (F.col("nxt") == F.col("xmax"))).alias("ok"))
    g = t.groupBy("speaker").agg(F.count("*").alias("intervals"), F.count_if("pause").alias("pauses"), F.every("ok").alias("contiguous"))
    shares = {"pause_min_s": 0.0, "pause_q1_s": 0.25, "pause_median_s": 0.5, "pause_q3_s": 0.75, "pause_max_s": 1.0}
    return g.join(Q.quantiles(t, "speaker", "len", shares), "speaker", "left").select("speaker", "intervals", "pauses", *[_r(s) for s in shares], "contiguous")


@query(f"""WITH {TIER}, s AS (SELECT user_id, row_number() OVER w AS interval_index, xmin, xmax, pause, lead(xmin) OVER w AS nxt FROM iv WINDOW w AS (PARTITION BY user_id ORDER BY xmin))
SELECT user_id, interval_index, round(xmax / 1000, 6) AS gap_start_s, round(nxt - xmax, 3) AS gap_ms, pause AS preceding_is_pause, round(xmax - xmin, 3) AS preceding_duration_ms FROM s WHERE nxt <> xmax""")
def tier_gaps(spark, d):
    w = Window.partitionBy("user_id").orderBy("xmin")
    t = _tier(spark, d).withColumns({"interval_index": F.row_number().over(w).cast("long"), "nxt": F.lead("xmin").over(w)}).where(F.col("nxt") != F.col("xmax"))
    return t.select("user_id", "interval_index", F.round(F.col("xmax") / 1000, 6).alias("gap_start_s"), F.round(F.col("nxt") - F.col("xmax"), 3).alias("gap_ms"), F.col("pause").alias("preceding_is_pause"), F.round(F.col("xmax") - F.col("xmin"), 3).alias("preceding_duration_ms"))


LABEL = "CASE WHEN event_id % 3 = 0 THEN event_type ELSE concat('  ', event_type, ' ', lpad(CAST(event_id % 100 AS VARCHAR), CASE WHEN event_id % 3 = 1 THEN 2 ELSE 3 END, '0'), ' ') END"


@query(f"SELECT CASE WHEN regexp_matches(trim(l), '(^|.) [0-9][0-9]$') THEN regexp_replace(trim(l), ' [0-9][0-9]$', '') ELSE trim(l) END AS category, count(*) AS n FROM (SELECT {LABEL} AS l FROM events) GROUP BY 1")
def label_categories(spark, d):
    """Labels without a trailing two-digit code."""
    code = F.lpad((F.col("event_id") % 100).cast("string"), F.when(F.col("event_id") % 3 == 1, 2).otherwise(3), F.lit("0"))
    label = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.concat(F.lit("  "), "event_type", F.lit(" "), code, F.lit(" ")))
    return read(spark, d, "events").groupBy(F.regexp_replace(F.trim(label), " [0-9]{2}$", "").alias("category")).agg(F.count("*").alias("n"))


# Names of phrase tiers, and of tiers that only look like them as AP is a speaker too.
LEVEL, NOT_LEVEL = r"^(?i)(ip|ap)($|[^A-Za-z0-9_]|[-_])", r"^(?i)AP[-_](token|ipu|story|narr\w*)$"
NAMES = ("ip", "IP-MB", "ap 2", "AP_token", "ap-narr3", "ipu", "Ap_x", "token", "AP-storyline", "ip_", "ap")
NAME_SQL = "[" + ", ".join(f"'{n}'" for n in NAMES) + f"][event_id % {len(NAMES)} + 1]"
LEVEL_SQL = "CASE WHEN regexp_matches(name, '^(ip|ap)($|[^A-Za-z0-9_]|[-_])', 'i') AND NOT regexp_matches(name, '^AP[-_](token|ipu|story|narr\\w*)$', 'i') THEN upper(substr(name, 1, 2)) END"


def level(name):
    """IP or AP of a tier's name, or null."""
    return F.when(name.rlike(LEVEL) & ~name.rlike(NOT_LEVEL), F.upper(F.substring(name, 1, 2)))


def _named(spark, d):
    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.col("event_id") % len(NAMES) + 1).cast("int"))
    return read(spark, d, "events").withColumn("name", name).withColumn("level", level(F.col("name")))


@query(f"SELECT name AS tier, {LEVEL_SQL} AS level, count(*) AS n FROM (SELECT {NAME_SQL} AS name FROM events) GROUP BY 1, 2")
def tier_levels(spark, d):
    return _named(spark, d).groupBy(F.col("name").alias("tier"), "level").agg(F.count("*").alias("n"))


@query(f"""WITH e AS (SELECT user_id, event_type, {NAME_SQL} AS name FROM events), l AS (SELECT user_id, event_type, name, {LEVEL_SQL} AS level FROM e)
SELECT user_id, level, count(DISTINCT name) AS tiers, count(*) AS labels, count(DISTINCT event_type) AS kinds, CASE WHEN count(DISTINCT name) > 1 THEN 'more than one tier for a level' ELSE 'ok' END AS status FROM l WHERE level IS NOT NULL GROUP BY 1, 2""")
def label_distributions(spark, d):
    """Labels of each level of a file, and whether it has the one tier that a level may have."""
    x = _named(spark, d).where("level is not null").groupBy("user_id", "level", "name", "event_type").agg(F.count("*").alias("n"))
    g = x.groupBy("user_id", "level").agg(F.countDistinct("name").alias("tiers"), F.sum("n").alias("labels"), F.countDistinct("event_type").alias("kinds"))
    return g.withColumn("status", F.when(F.col("tiers") > 1, "more than one tier for a level").otherwise("ok"))


PATH_SQL = "p AS (SELECT page_id, html, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages), f AS (SELECT page_id, html, path, regexp_replace(path, '/[^/]*$', '') AS dir FROM p)"
DIR_SQL = "CASE WHEN regexp_matches(dir, 'example\\.org(/|$)') THEN dir WHEN contains(dir, '/') THEN concat(split_part(dir, '/', 1), '/*') ELSE dir END"


def _files(spark, d):
    path = F.regexp_replace("url", "^[a-z]+://", "")
    return read(spark, d, "pages").select("page_id", "html", path.alias("path"), F.regexp_replace(path, "/[^/]*$", "").alias("dir"))


def table_dir(directory, area):
    """A directory of a listed area as it is, any other as its top level and a star."""
    return F.when(directory.rlike(area), directory).when(directory.contains("/"), F.concat(F.split_part(directory, F.lit("/"), F.lit(1)), F.lit("/*"))).otherwise(directory)


@query(f"WITH {PATH_SQL} SELECT {DIR_SQL} AS directory, count(*) AS files FROM f GROUP BY 1")
def files_by_directory(spark, d):
    return _files(spark, d).groupBy(table_dir(F.col("dir"), r"example\.org(/|$)").alias("directory")).agg(F.count("*").alias("files"))


@query(f"WITH {PATH_SQL} SELECT coalesce(x.directory, 'TOTAL') AS directory, x.encoding, count(*) AS files FROM (SELECT {DIR_SQL} AS directory, CASE WHEN strlen(html) = length(html) THEN 'ascii' ELSE 'utf-8' END AS encoding FROM f) x GROUP BY GROUPING SETS ((x.directory, x.encoding), (x.encoding))")
def encodings_by_directory(spark, d):
    x = _files(spark, d).select(table_dir(F.col("dir"), r"example\.org(/|$)").alias("directory"), T.encoding(F.col("html").cast("binary")).alias("encoding"))
    return x.groupingSets([["directory", "encoding"], ["encoding"]], "directory", "encoding").agg(F.count("*").alias("files")).select(F.coalesce("directory", F.lit("TOTAL")).alias("directory"), "encoding", "files")


# The speakers' codes.
SPEAKERS = "AB AC AG AP BX CM EB IM LJ LL MB MG ML NH SR YM".split()


def speakers_in_name(name):
    """Codes in a name that no letter runs on from: none before in upper case, none at all after."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(name, F.lit("(?<![A-Z])(" + "|".join(SPEAKERS) + ")(?![A-Za-z])"), F.lit(1))))


CODE_NAME = "concat([" + ", ".join(f"'{s}'" for s in SPEAKERS) + "][page_id % 16 + 1], CASE page_id % 5 WHEN 0 THEN 'x' WHEN 1 THEN '_all' WHEN 2 THEN '-0' ELSE '' END, CASE WHEN page_id % 7 = 0 THEN '_MBLJ' ELSE '.' END)"


@query(f"""WITH {PATH_SQL}, n AS (SELECT regexp_extract(dir, '[a-z]+$') AS directory, {CODE_NAME} AS name FROM f), s AS (SELECT unnest([{", ".join(f"'{s}'" for s in SPEAKERS)}]) AS speaker),
h AS (SELECT DISTINCT directory, speaker FROM n, s WHERE regexp_matches(name, concat('(^|[^A-Z])', speaker, '($|[^A-Za-z])')))
SELECT x.directory, s.speaker, h.speaker IS NOT NULL AS present FROM (SELECT DISTINCT directory FROM n) x CROSS JOIN s LEFT JOIN h ON h.directory = x.directory AND h.speaker = s.speaker""")
def speaker_coverage(spark, d):
    """Every directory with every speaker, and whether a file's name there has the speaker's code."""
    k = F.col("page_id") % 5
    tail = F.when(k == 0, "x").when(k == 1, "_all").when(k == 2, "-0").otherwise("")
    name = F.concat(F.element_at(F.array(*[F.lit(s) for s in SPEAKERS]), (F.col("page_id") % 16 + 1).cast("int")), tail, F.when(F.col("page_id") % 7 == 0, "_MBLJ").otherwise("."))
    n = _files(spark, d).select(F.regexp_extract("dir", "[a-z]+$", 0).alias("directory"), speakers_in_name(name).alias("found"))
    n = n.select("directory", F.explode(F.array(*[F.lit(s) for s in SPEAKERS])).alias("speaker"), "found").withColumn("hit", F.array_contains("found", F.col("speaker")))
    return n.groupBy("directory", "speaker").agg(F.some("hit").alias("present"))
