"""Queries on documents: masses, boundaries, metrics, audits, runs, comparisons."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import segments as S
from ..functions import text as T
from ..operators import documents as D
from ..operators import tokeniser as K
from .registry import query, read

# The same tables, built as long relations with window functions rather than arrays.
BASE = r"""
docw AS (SELECT doc_id, lang, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents),
tok AS (SELECT doc_id, lang, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos, len(w) AS n FROM docw),
doc AS (SELECT doc_id, lang, len(w) AS n FROM docw),
ref AS (SELECT doc_id, pos AS b FROM tok WHERE word LIKE '%.' AND pos < n),
seg AS (SELECT doc_id, b, b - coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY b), 0) AS mass, row_number() OVER (PARTITION BY doc_id ORDER BY b) AS seg
        FROM (SELECT doc_id, b FROM ref UNION ALL SELECT doc_id, n FROM doc WHERE n > 0))"""


def hyp_sql(name: str = "hyp", samples: str = "0") -> str:
    return f"""
{name}_s AS (SELECT unnest([{samples}]) AS sample),
{name}_d AS (SELECT doc_id, sample, b, substr(md5(concat_ws('|', doc_id, b, sample)), 1, 1) AS d FROM ref, {name}_s),
{name} AS (SELECT DISTINCT doc_id, sample, b FROM (
    SELECT doc_id, sample, CASE WHEN d <= '9' THEN b WHEN d IN ('a', 'b') THEN b + 1 WHEN d IN ('c', 'd') THEN b - 1 END AS b FROM {name}_d
    UNION ALL SELECT doc_id, sample, pos FROM tok, {name}_s WHERE word LIKE '%,' AND substr(md5(concat_ws('|', doc_id, 'c', pos, sample)), 1, 1) < '4') JOIN doc USING (doc_id)
  WHERE b BETWEEN 1 AND n - 1)"""


PRF = """
joined AS (SELECT coalesce(r.doc_id, h.doc_id) AS doc_id, coalesce(r.sample, h.sample) AS sample, r.b AS rb, h.b AS hb
  FROM (SELECT ref.*, sample FROM ref, hyp_s) r FULL JOIN hyp h ON r.doc_id = h.doc_id AND r.b = h.b AND r.sample = h.sample),
cnt AS (SELECT doc_id, lang, n, sample, count(rb) AS n_ref, count(hb) AS n_hyp, count(CASE WHEN rb IS NOT NULL AND hb IS NOT NULL THEN 1 END) AS tp
  FROM (SELECT * FROM doc, hyp_s) LEFT JOIN joined USING (doc_id, sample) GROUP BY ALL),
prf AS (SELECT *, CASE WHEN n_hyp = 0 THEN (n_ref = 0)::DOUBLE ELSE tp / n_hyp END AS p, CASE WHEN n_ref = 0 THEN (n_hyp = 0)::DOUBLE ELSE tp / n_ref END AS r FROM cnt),
f AS (SELECT *, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f1 FROM prf)"""

# Prefix sums joined with themselves k further on.
WD = """
cum AS (SELECT d.doc_id, d.n, p.pos,
    coalesce(sum((r.b IS NOT NULL)::INT) OVER w, 0) AS rc, coalesce(sum((h.b IS NOT NULL)::INT) OVER w, 0) AS hc
  FROM doc d, LATERAL (SELECT unnest(range(0, d.n + 1)) AS pos) p
  LEFT JOIN ref r ON r.doc_id = d.doc_id AND r.b = p.pos LEFT JOIN hyp h ON h.doc_id = d.doc_id AND h.b = p.pos
  WINDOW w AS (PARTITION BY d.doc_id ORDER BY p.pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
kk AS (SELECT doc_id, n, greatest(CAST(round_even(n / (count(b) + 1) / 2, 0) AS BIGINT), 2) AS k FROM doc LEFT JOIN ref USING (doc_id) GROUP BY doc_id, n),
wd AS (SELECT kk.doc_id, avg(CASE WHEN y.rc - x.rc <> y.hc - x.hc THEN 1.0 ELSE 0.0 END) AS wd FROM kk
  JOIN cum x ON x.doc_id = kk.doc_id AND x.pos < kk.n - kk.k JOIN cum y ON y.doc_id = kk.doc_id AND y.pos = x.pos + kk.k GROUP BY kk.doc_id)"""

BS = """
odd AS (SELECT doc_id, coalesce(rb, hb) AS b, (rb IS NULL)::INT AS side FROM joined WHERE (rb IS NULL) <> (hb IS NULL)),
isl AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY b) AS g FROM (SELECT *,
  CASE WHEN lag(b) OVER w = b - 1 AND lag(side) OVER w <> side THEN 0 ELSE 1 END AS fresh FROM odd WINDOW w AS (PARTITION BY doc_id ORDER BY b))),
prs AS (SELECT doc_id, sum(c // 2) AS pairs, sum(c) AS c FROM (SELECT doc_id, g, count(*) AS c FROM isl GROUP BY doc_id, g) GROUP BY doc_id),
bs AS (SELECT cnt.doc_id, CASE WHEN n <= 1 OR coalesce(c, 0) - coalesce(pairs, 0) + tp = 0 THEN 1.0
  ELSE (coalesce(c, 0) - coalesce(pairs, 0) + tp - (coalesce(c, 0) - 2 * coalesce(pairs, 0)) - 0.5 * coalesce(pairs, 0))::DOUBLE / (coalesce(c, 0) - coalesce(pairs, 0) + tp) END AS bs
  FROM cnt LEFT JOIN prs USING (doc_id))"""

HYP = hyp_sql()
FIVE = hyp_sql(samples="0, 1, 2, 3, 4")


def docs(spark, d):
    return D.segmented(read(spark, d, "documents"))


def pert(spark, d, sample=0):
    return D.perturbed(docs(spark, d), sample)


def r6(*names):
    return [T.rounded(n, 6).alias(n) for n in names]


def lng(*names):
    return [F.col(n).cast("long").alias(n) for n in names]


@query(f"WITH {BASE} SELECT doc_id, seg, CAST(mass AS BIGINT) AS mass FROM seg")
def masses_from_flags(spark, d):
    flags = F.transform("w", lambda x, i: F.when(i == 0, True).otherwise(F.element_at("w", F.greatest(i, F.lit(1))).endswith(".")))
    m = docs(spark, d).select("doc_id", F.posexplode(S.flags_to_masses(flags)).alias("seg", "mass"))
    return m.select("doc_id", (F.col("seg") + 1).cast("long").alias("seg"), F.col("mass").cast("long").alias("mass"))


@query(f"WITH {BASE} SELECT doc_id, CAST(b AS BIGINT) AS b FROM ref")
def boundaries_from_masses(spark, d):
    m = docs(spark, d).select("doc_id", S.boundaries_to_masses("ref", "n").alias("m"))
    return m.select("doc_id", F.explode(S.masses_to_boundaries("m").cast("array<bigint>")).alias("b"))


@query(f"WITH {BASE} SELECT doc_id, string_agg(CAST(mass AS VARCHAR), ',' ORDER BY seg) AS masses FROM seg GROUP BY doc_id")
def masses_from_boundaries(spark, d):
    return docs(spark, d).where("n > 0").select("doc_id", F.array_join(S.boundaries_to_masses("ref", "n").cast("array<string>"), ",").alias("masses"))


@query(f"WITH {BASE} SELECT doc_id, CAST(b - mass + 1 AS BIGINT) AS start_i FROM seg")
def start_indices(spark, d):
    m = docs(spark, d).select("doc_id", S.masses_to_starts(S.boundaries_to_masses("ref", "n")).alias("s"))
    return m.select("doc_id", F.explode(F.col("s").cast("array<bigint>")).alias("start_i"))


@query(f"""WITH {BASE}, x AS (SELECT doc_id, n, CASE WHEN substr(md5(concat_ws('|', doc_id, 'm')), 1, 1) < '4' THEN n + 1 ELSE n END AS hyp_n FROM doc)
SELECT doc_id, CAST(n AS BIGINT) AS ref_tokens, CAST(hyp_n AS BIGINT) AS hyp_tokens, CASE WHEN n = hyp_n THEN 'ok' ELSE concat('ref=', n, ' hyp=', hyp_n, ' diff=', hyp_n - n) END AS status FROM x""")
def comparable_check(spark, d):
    hyp = F.col("n") + (D.digit(F.col("doc_id"), F.lit("m")) < "4").cast("int")
    x = docs(spark, d).select("doc_id", "n", hyp.alias("h"))
    why = F.concat(F.lit("ref="), F.col("n"), F.lit(" hyp="), F.col("h"), F.lit(" diff="), F.col("h") - F.col("n"))
    return x.select("doc_id", F.col("n").cast("long").alias("ref_tokens"), F.col("h").cast("long").alias("hyp_tokens"), F.when(F.col("n") == F.col("h"), "ok").otherwise(why).alias("status"))


@query(f"WITH {BASE}, {HYP}, {PRF} SELECT doc_id, tp, n_ref, n_hyp, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1 FROM f")
def boundary_prf_doc(spark, d):
    return D.scores(pert(spark, d)).select("doc_id", *lng("tp", "n_ref", "n_hyp"), *r6("precision", "recall", "f1"))


@query(f"WITH {BASE}, {HYP}, {WD} SELECT doc_id, round(wd, 6) AS window_diff FROM doc LEFT JOIN wd USING (doc_id)")
def window_diff_doc(spark, d):
    return D.scores(pert(spark, d)).select("doc_id", *r6("window_diff"))


@query(f"WITH {BASE}, {HYP}, {PRF}, {BS} SELECT doc_id, round(bs, 6) AS boundary_similarity FROM bs")
def boundary_similarity_doc(spark, d):
    return D.scores(pert(spark, d)).select("doc_id", *r6("boundary_similarity"))


MICRO = """count(*) AS n_docs, round(coalesce(sum(tp + 1) / sum(n_hyp + 1), 0), 6) AS micro_precision, round(coalesce(sum(tp + 1) / sum(n_ref + 1), 0), 6) AS micro_recall,
round(2 * sum(tp + 1) / (sum(n_hyp + 1) + sum(n_ref + 1)), 6) AS micro_f1"""


@query(f"WITH {BASE}, {HYP}, {PRF} SELECT {MICRO} FROM cnt")
def micro_prf_corpus(spark, d):
    return D.micro(D.scores(pert(spark, d))).select("n_docs", *r6("micro_precision", "micro_recall", "micro_f1"))


@query(f"""WITH {BASE}, {HYP}, {PRF}, {WD}, {BS} SELECT coalesce(lang, 'ALL') AS genre, count(*) AS n_docs, round(avg(f1), 6) AS mean_f1, round(avg(wd), 6) AS mean_window_diff,
round(avg(bs), 6) AS mean_boundary_similarity, round(sum(tp + 1) / sum(n_hyp + 1), 6) AS micro_precision, round(sum(tp + 1) / sum(n_ref + 1), 6) AS micro_recall
FROM f LEFT JOIN wd USING (doc_id) JOIN bs USING (doc_id) GROUP BY GROUPING SETS ((lang), ())""")
def genre_macro_micro(spark, d):
    s = D.scores(pert(spark, d))
    out = s.groupingSets([["lang"], []], "lang").agg(
        F.count("*").alias("n_docs"), F.avg("f1").alias("mean_f1"), F.avg("window_diff").alias("mean_window_diff"), F.avg("boundary_similarity").alias("mean_boundary_similarity"),
        (F.sum(F.col("tp") + 1) / F.sum(F.col("n_hyp") + 1)).alias("micro_precision"), (F.sum(F.col("tp") + 1) / F.sum(F.col("n_ref") + 1)).alias("micro_recall"),
    )
    return out.select(F.coalesce("lang", F.lit("ALL")).alias("genre"), "n_docs", *r6("mean_f1", "mean_window_diff", "mean_boundary_similarity", "micro_precision", "micro_recall"))


MASK_SQL = f"WITH {BASE}, m AS (SELECT doc_id, n AS n_tokens, coalesce(len(list_filter(w, lambda x: regexp_matches(x, '{T.MARKS}'))) / nullif(n, 0), 0.0) AS masked_fraction FROM docw JOIN doc USING (doc_id))"


@query(f"{MASK_SQL} SELECT doc_id, n_tokens, round(masked_fraction, 6) AS masked_fraction FROM m")
def masked_fraction_audit(spark, d):
    return D.masked(read(spark, d, "documents"), lambda x: x.rlike(T.MARKS)).select("doc_id", "n_tokens", *r6("masked_fraction"))


@query(f"{MASK_SQL} SELECT doc_id, round(masked_fraction, 6) AS masked_fraction, 'masked' AS reason FROM m WHERE masked_fraction > 0.5")
def masked_excluded(spark, d):
    m = D.masked(read(spark, d, "documents"), lambda x: x.rlike(T.MARKS)).where("masked_fraction > 0.5")
    return m.select("doc_id", *r6("masked_fraction"), F.lit("masked").alias("reason"))


RAW_SQL = f"""WITH {BASE}, x AS (SELECT doc_id, n, substr(md5(concat_ws('|', doc_id, 'raw')), 1, 1) AS d, coalesce(string_agg(CAST(b + 1 AS VARCHAR), ', ' ORDER BY b), '') AS body FROM doc LEFT JOIN ref USING (doc_id) GROUP BY doc_id, n),
raw AS (SELECT doc_id, n, d, CASE WHEN d = '0' THEN 'no answer' WHEN d = '1' THEN '[1, 2' || ' ]]' WHEN d = '2' THEN '[1, true]' WHEN d = '3' THEN '[1, 2.5]' WHEN d = '4' THEN 'Answer: ["1"]' ELSE 'Here: [' || body || '] done' END AS raw, body FROM x)"""


def _raw(spark, d):
    x = docs(spark, d).withColumn("d", D.digit(F.col("doc_id"), F.lit("raw")))
    body = F.array_join(F.transform("ref", lambda b: (b + 1).cast("string")), ", ")
    raw = F.when(F.col("d") == "0", "no answer").when(F.col("d") == "1", "[1, 2 ]]").when(F.col("d") == "2", "[1, true]").when(F.col("d") == "3", "[1, 2.5]").when(F.col("d") == "4", 'Answer: ["1"]')
    x = x.select("doc_id", "n", raw.otherwise(F.concat(F.lit("Here: ["), body, F.lit("] done"))).alias("raw"))
    return x.select("doc_id", "n", T.parse_starts(F.col("raw")).alias("x")).select("doc_id", "n", "x.*")


@query(f"{RAW_SQL} SELECT doc_id, CAST(CASE WHEN d = '4' THEN 1 WHEN body = '' THEN 0 ELSE len(string_split(body, ',')) END AS BIGINT) AS n_starts, CASE WHEN d = '4' THEN '1' ELSE replace(body, ' ', '') END AS starts FROM raw WHERE d >= '4'")
def parse_responses(spark, d):
    return _raw(spark, d).where("reason is null").select("doc_id", F.size("starts").cast("long").alias("n_starts"), F.array_join(F.col("starts").cast("array<string>"), ",").alias("starts"))


@query(f"{RAW_SQL} SELECT CASE d WHEN '0' THEN 'no array' WHEN '1' THEN 'malformed' ELSE 'not an integer' END AS reason, count(*) AS n FROM raw WHERE d < '4' GROUP BY 1")
def parse_failures(spark, d):
    return _raw(spark, d).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def five(spark, d):
    """Five draws of each document, scored: one scan and one split into words, then a row per draw."""
    return D.scores(D.perturbed(docs(spark, d).withColumn("sample", F.explode(F.array(*[F.lit(i) for i in range(5)]))), F.col("sample")))


@query(f"WITH {BASE}, {FIVE}, {PRF} SELECT doc_id, count(*) AS n_samples, round(avg(p), 6) AS precision_mean, round(min(p), 6) AS precision_min, round(max(p), 6) AS precision_max, round(avg(f1), 6) AS f1_mean, round(min(f1), 6) AS f1_min, round(max(f1), 6) AS f1_max FROM f GROUP BY doc_id")
def sample_mean_range(spark, d):
    agg = [g(m).alias(f"{m}_{k}") for m in ("precision", "f1") for k, g in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    out = five(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_samples"), *agg)
    return out.select("doc_id", "n_samples", *r6(*[f"{m}_{k}" for m in ("precision", "f1") for k in ("mean", "min", "max")]))


@query(f"WITH {BASE} SELECT doc_id, CAST(count(*) - coalesce(max(CASE WHEN mass <> 1 THEN seg END), 0) AS BIGINT) AS trailing_run FROM seg GROUP BY doc_id")
def trailing_run(spark, d):
    m = docs(spark, d).where("n > 0").select("doc_id", S.boundaries_to_masses("ref", "n").alias("m"))
    last = F.coalesce(F.array_max(S.positions("m", lambda x: x != 1)), F.lit(0))
    return m.select("doc_id", (F.size("m") - last).cast("long").alias("trailing_run"))


RUNS = """isl_r AS (SELECT doc_id, b, b - row_number() OVER (PARTITION BY doc_id ORDER BY b) AS g FROM hyp),
rr AS (SELECT doc_id, count(*) AS len, min(b) AS s, max(b) AS e FROM isl_r GROUP BY doc_id, g),
best AS (SELECT * FROM rr QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY len DESC, s) = 1)"""


@query(f"WITH {BASE}, {HYP}, {RUNS} SELECT doc_id, coalesce(len, 0) AS run_length, CAST(s AS BIGINT) AS span_start, CAST(e AS BIGINT) AS span_end FROM doc LEFT JOIN best USING (doc_id)")
def max_run_span(spark, d):
    x = pert(spark, d).select("doc_id", S.longest_run("hyp").alias("x"))
    return x.select("doc_id", *[F.col(f"x.{a}").cast("long").alias(b) for a, b in (("len", "run_length"), ("start", "span_start"), ("end", "span_end"))])


@query(f"""WITH {BASE}, {HYP}, near AS (SELECT h.doc_id, h.b, r.b AS rb FROM hyp h JOIN ref r USING (doc_id) QUALIFY row_number() OVER (PARTITION BY h.doc_id, h.b ORDER BY abs(h.b - r.b), r.b DESC) = 1),
off AS (SELECT CASE WHEN abs(b - rb) > 3 THEN 'beyond' ELSE CAST(b - rb AS VARCHAR) END AS bucket, count(*) AS n FROM near GROUP BY 1)
SELECT x.bucket AS offset_bucket, coalesce(n, 0) AS n FROM (SELECT unnest(['-3', '-2', '-1', '0', '1', '2', '3', 'beyond']) AS bucket) x LEFT JOIN off USING (bucket)""")
def nearest_offset_hist(spark, d):
    b = D.offsets(pert(spark, d).where(F.size("ref") > 0)).select(F.col("offset").alias("o"))
    n = b.groupBy(F.when(F.abs("o") > 3, "beyond").otherwise(F.col("o").cast("string")).alias("offset_bucket")).agg(F.count("*").alias("n"))
    all_ = spark.createDataFrame([(x,) for x in ("-3", "-2", "-1", "0", "1", "2", "3", "beyond")], "offset_bucket string")
    return all_.join(F.broadcast(n), "offset_bucket", "left").select("offset_bucket", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH {BASE}, c AS (SELECT CASE WHEN pos = 1 THEN 'first' WHEN prev LIKE '%.' THEN 'after_stop' WHEN prev LIKE '%,' THEN 'after_comma' ELSE 'inside' END AS category, regexp_matches(word, '^\\p{{Lu}}') AS cap
  FROM (SELECT *, lag(word) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM tok))
SELECT category, count(*) AS n_words, count(*) FILTER (cap) AS n_capitalised, round(count(*) FILTER (cap) / count(*), 6) AS share_capitalised FROM c GROUP BY category""")
def capitalisation_categories(spark, d):
    shifted = F.slice(F.concat(F.array(F.lit(None).cast("string")), "w"), F.lit(1), F.size("w"))
    t = docs(spark, d).select(F.explode(F.arrays_zip(F.col("w").alias("word"), shifted.alias("prev"))).alias("x")).select("x.word", "x.prev")
    cat = F.when(F.col("prev").isNull(), "first").when(F.col("prev").endswith("."), "after_stop").when(F.col("prev").endswith(","), "after_comma").otherwise("inside")
    g = t.groupBy(cat.alias("category")).agg(F.count("*").alias("n_words"), F.count_if(F.col("word").rlike(r"^\p{Lu}")).alias("n_capitalised"))
    return g.withColumn("share_capitalised", F.round(F.col("n_capitalised") / F.col("n_words"), 6))


@query(f"""WITH {BASE}, p AS (SELECT s.doc_id, t.pos - (s.b - s.mass) AS i, s.mass AS m, t.word FROM seg s JOIN tok t ON t.doc_id = s.doc_id AND t.pos > s.b - s.mass AND t.pos <= s.b),
c AS (SELECT CASE WHEN m = 1 THEN 'initial_and_final' WHEN i = 1 THEN 'initial' WHEN i = m THEN 'final' ELSE 'internal' END AS category, count(*) AS n_all_words, count(*) FILTER (word LIKE '%,') AS n_marked FROM p GROUP BY 1)
SELECT category, n_marked, round(n_marked / sum(n_marked) OVER (), 6) AS share_of_marked, n_all_words, round(n_marked / n_all_words, 6) AS rate FROM c""")
def truncation_position(spark, d):
    s = docs(spark, d).select("w", F.explode(F.arrays_zip(F.concat(F.array(F.lit(0)), "ref").alias("a"), F.concat("ref", F.array("n")).alias("b"))).alias("x"))
    s = s.select(F.slice("w", F.col("x.a") + 1, F.col("x.b") - F.col("x.a")).alias("seg")).select(F.size("seg").alias("m"), F.posexplode("seg").alias("i", "word"))
    g = s.groupBy(T.position_class(F.col("i"), F.col("m")).alias("category")).agg(F.count("*").alias("n_all_words"), F.count_if(F.col("word").endswith(",")).alias("n_marked"))
    total = F.sum("n_marked").over(Window.partitionBy(F.lit(1)))
    return g.select("category", "n_marked", F.round(F.col("n_marked") / total, 6).alias("share_of_marked"), "n_all_words", F.round(F.col("n_marked") / F.col("n_all_words"), 6).alias("rate"))


# Position (n + 1) p between order statistics, held inside the first and last.
EXCL = "(1 - (least(greatest((n + 1) * {p}, 1), n - 1e-9) - floor(least(greatest((n + 1) * {p}, 1), n - 1e-9)))) * v[CAST(floor(least(greatest((n + 1) * {p}, 1), n - 1e-9)) AS INT)] + (least(greatest((n + 1) * {p}, 1), n - 1e-9) - floor(least(greatest((n + 1) * {p}, 1), n - 1e-9))) * v[CAST(floor(least(greatest((n + 1) * {p}, 1), n - 1e-9)) AS INT) + 1]"


@query(f"WITH {BASE}, v AS (SELECT lang, list(n ORDER BY n) AS v, count(*) AS n FROM doc GROUP BY lang) SELECT lang, CAST(v[1] AS BIGINT) AS min_words, round({EXCL.format(p=0.25)}, 6) AS q1, round({EXCL.format(p=0.5)}, 6) AS median, round({EXCL.format(p=0.75)}, 6) AS q3, CAST(v[-1] AS BIGINT) AS max_words FROM v")
def quartiles_exclusive(spark, d):
    # Ranks by counting equal values first, so that what a task holds is a value and its count, not a row.
    c = docs(spark, d).groupBy("lang", F.col("n").cast("long").alias("x")).agg(F.count("*").alias("c"))
    w = Window.partitionBy("lang").orderBy("x")
    c = c.withColumn("hi", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy("lang")))
    aggs = [F.min("x").alias("min_words"), F.max("x").alias("max_words")]
    for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        at = F.least(F.greatest((F.col("n") + 1) * p, F.lit(1.0)), F.col("n") - 1e-9)
        low = F.floor(at)
        aggs += [F.max(at - low).alias(f"f_{name}"), F.min(F.when(F.col("hi") >= low, F.col("x"))).alias(f"a_{name}"), F.min(F.when(F.col("hi") >= low + 1, F.col("x"))).alias(f"b_{name}")]
    g = c.groupBy("lang").agg(*aggs)
    return g.select("lang", "min_words", *[F.round((1 - F.col(f"f_{q}")) * F.col(f"a_{q}") + F.col(f"f_{q}") * F.col(f"b_{q}"), 6).alias(q) for q in ("q1", "median", "q3")], "max_words")


@query(f"WITH {BASE} SELECT lang, CAST(min(n) AS BIGINT) AS min_words, round(quantile_cont(n, 0.25), 6) AS q1, round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.75), 6) AS q3, CAST(max(n) AS BIGINT) AS max_words FROM doc GROUP BY lang")
def quartiles_inclusive(spark, d):
    g = docs(spark, d).groupBy("lang").agg(F.min("n").cast("long").alias("min_words"), F.percentile("n", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.max("n").cast("long").alias("max_words"))
    return g.select("lang", "min_words", *[F.round(F.col("q")[i], 6).alias(k) for i, k in enumerate(("q1", "median", "q3"))], "max_words")


@query(f"""WITH {BASE}, t AS (SELECT unnest([5, 15, 25, 35, 45, 55, 65, 75, 85, 95]) AS decile), q AS (SELECT decile, (SELECT quantile_cont(n, decile / 100) FROM doc) AS target FROM t)
SELECT decile::BIGINT AS decile, round(target, 6) AS target_words, doc_id, CAST(n AS BIGINT) AS words FROM q, doc QUALIFY row_number() OVER (PARTITION BY decile ORDER BY abs(n - target), doc_id) = 1""".replace("quantile_cont(n, decile / 100)", "quantile_cont(n, [0.05, 0.15, 0.25, 0.35, 0.45, 0.55, 0.65, 0.75, 0.85, 0.95])[(decile + 5) // 10]"))
def decile_selection(spark, d):
    base = docs(spark, d).select("doc_id", F.col("n").cast("long").alias("words"))
    marks = [5, 15, 25, 35, 45, 55, 65, 75, 85, 95]
    q = base.agg(F.percentile("words", F.array(*[F.lit(m / 100) for m in marks])).alias("q")).select(F.posexplode("q").alias("i", "target"))
    # Ten candidates in one pass: the least (distance, id) of each target, by partial aggregation.
    best = base.crossJoin(F.broadcast(q)).groupBy("i", "target").agg(F.min(F.struct(F.abs(F.col("words") - F.col("target")).alias("far"), "doc_id", "words")).alias("x"))
    return best.select((F.col("i") * 10 + 5).cast("long").alias("decile"), F.round("target", 6).alias("target_words"), "x.doc_id", "x.words")


@query(f"WITH {BASE}, {hyp_sql(samples='0, 1')}, {PRF} SELECT a.doc_id, a.lang AS genre, round(a.f1, 6) AS first_f1, round(b.f1, 6) AS second_f1, round(b.f1 - a.f1, 6) AS delta_f1, CAST(l.quality AS BIGINT) AS quality FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.sample = 0 AND b.sample = 1 JOIN labels l ON l.doc_id = a.doc_id")
def run_compare_inner(spark, d):
    base = docs(spark, d).join(read(spark, d, "labels"), "doc_id")
    both = D.scores(D.perturbed(D.scores(D.perturbed(base, 0)).withColumn("a", F.col("f1")), 1))
    return both.select("doc_id", F.col("lang").alias("genre"), F.round("a", 6).alias("first_f1"), F.round("f1", 6).alias("second_f1"), F.round(F.col("f1") - F.col("a"), 6).alias("delta_f1"), F.col("quality").cast("long").alias("quality"))


@query(f"WITH {BASE}, {HYP}, {PRF} SELECT coalesce(lang, 'TOTAL') AS genre, CAST(sum(n_ref + 1) AS BIGINT) AS ref_segs, CAST(sum(n_hyp + 1) AS BIGINT) AS hyp_segs, round(sum(n_hyp + 1) / sum(n_ref + 1), 6) AS ratio FROM cnt GROUP BY ROLLUP (lang)")
def segment_ratio_total(spark, d):
    g = pert(spark, d).rollup("lang").agg(F.sum(F.size("ref") + 1).alias("ref_segs"), F.sum(F.size("hyp") + 1).alias("hyp_segs"))
    return g.select(F.coalesce("lang", F.lit("TOTAL")).alias("genre"), "ref_segs", "hyp_segs", F.round(F.col("hyp_segs") / F.col("ref_segs"), 6).alias("ratio"))


@query(f"WITH {BASE} SELECT doc_id, count(*) AS kept_segments, CAST(sum(mass) AS BIGINT) AS kept_tokens FROM seg WHERE b - mass < 45 GROUP BY doc_id")
def truncate_to_segments(spark, d):
    return D.truncated(docs(spark, d).where("n > 0"), 45)


@query("""WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents)
SELECT ch AS mark, count(*) AS n, count(DISTINCT doc_id) AS documents FROM c WHERE regexp_matches(ch, '^[^\\p{L}\\p{N}\\s]$') GROUP BY ch""")
def marker_inventory(spark, d):
    t = read(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[^\p{L}\p{N}\s]"), F.lit(0))).alias("mark"))
    per = t.groupBy("mark", "doc_id").agg(F.count("*").alias("c"))
    return per.groupBy("mark").agg(F.sum("c").alias("n"), F.count("*").alias("documents"))


@query(rf"""WITH {BASE}, i AS (SELECT doc_id, len(list_filter(string_split_regex(regexp_replace(text, '[^\p{{L}}''\-\s]', ' ', 'g'), '\s+'), lambda x: x <> '')) AS k FROM documents)
SELECT CAST(n - k AS BIGINT) AS diff, count(*) AS n_docs FROM doc JOIN i USING (doc_id) GROUP BY 1""")
def independent_recount(spark, d):
    t = read(spark, d, "documents").select((F.size(S.words("text")) - F.size(T.letters_runs(F.col("text")))).cast("long").alias("diff"))
    return t.groupBy("diff").agg(F.count("*").alias("n_docs"))


@query()
def tokeniser_invariants(spark, d):
    """The tokeniser's words against the raw chunks: letters of a word that no one chunk holds, and of a chunk that no word holds."""
    lines = read(spark, d, "conversations").select("conv_id", F.explode(F.split("text", "\n")).alias("line"))
    x = lines.select("line", K.items(F.col("line")).alias("x")).where("x.error is null")
    bare = lambda c: F.filter(F.transform(c, lambda w: F.regexp_replace(w, r"[^\p{L}]+", "")), lambda w: w != "")
    words = bare(F.transform(K.words_only(F.col("x.items")), lambda i: i["text"]))
    x = x.select(words.alias("words"), bare(S.words("line")).alias("chunks"), F.filter(F.transform(S.words("line"), lambda c: F.regexp_replace(c, r"[^\p{Ll}]+", "")), lambda c: c != "").alias("lower"))
    # Most words are a chunk: only the others are looked for inside of one.
    fused = F.filter(F.array_except("words", "chunks"), lambda w: ~F.exists("chunks", lambda c: c.contains(w)))
    lost = F.filter(F.array_except("lower", "words"), lambda c: ~F.exists("words", lambda w: w.contains(c)))
    n = x.agg(F.sum(F.size(fused)).alias("no_fusion"), F.sum(F.size(lost)).alias("no_lost_words"), F.count("*").alias("units"))
    return n


@query(rf"""WITH {BASE}, l AS (SELECT doc_id, unnest(list_filter(string_split_regex(regexp_replace(text, '[^\p{{L}}''\-\s]', ' ', 'g'), '\s+'), lambda x: x <> '')) AS r FROM documents),
x AS (SELECT DISTINCT doc_id, r FROM l), y AS (SELECT DISTINCT doc_id, unnest(list_filter(string_split_regex(regexp_replace(word, '[^\p{{L}}''\-\s]', ' ', 'g'), '\s+'), lambda x: x <> '')) AS r FROM tok)
SELECT 'no_fusion' AS invariant, (SELECT count(*) FROM (SELECT * FROM x EXCEPT SELECT * FROM y)) AS violations UNION ALL SELECT 'no_lost_words', (SELECT count(*) FROM (SELECT * FROM y EXCEPT SELECT * FROM x))""")
def invariants(spark, d):
    t = read(spark, d, "documents")
    whole = T.letters_runs(F.col("text"))
    parts = F.flatten(F.transform(S.words("text"), T.letters_runs))
    n = t.select(F.size(F.array_except(whole, parts)).alias("a"), F.size(F.array_except(parts, whole)).alias("b")).agg(F.sum("a").alias("no_fusion"), F.sum("b").alias("no_lost_words"))
    return n.unpivot([], ["no_fusion", "no_lost_words"], "invariant", "violations")


# Letters in lower case are doubled, so that one can bound the run before it and the one after it; what they bound goes.
CAPS = r"list_transform(regexp_extract_all(regexp_replace(text, '([a-z])', '\\1\\1', 'g'), '[a-z]?[A-Z]+[a-z]?'), lambda m: regexp_replace(regexp_replace(regexp_replace(m, '^[a-z][A-Z]', ''), '[A-Z][a-z]$', ''), '[a-z]', '', 'g'))".replace("\\\\", "\\")


@query(f"SELECT value, count(*) AS n FROM (SELECT unnest({CAPS}) AS value FROM documents) WHERE value <> '' GROUP BY 1")
def allcaps_tally(spark, d):
    t = read(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("(?<![a-z])[A-Z]+(?![a-z])"), F.lit(0))).alias("value"))
    return t.groupBy("value").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT doc_id, text, md5(text) AS h FROM documents WHERE text IS NOT NULL), f AS (SELECT h, min(doc_id) AS first_id, count(*) AS copies FROM s GROUP BY h)
SELECT s.doc_id, CASE WHEN f.copies > 1 AND f.first_id <> s.doc_id THEN f.first_id END AS copy_of, f.copies FROM s JOIN f USING (h)""")
def identical_signatures(spark, d):
    s = read(spark, d, "documents").where("text is not null").select("doc_id", F.md5("text").alias("h"))
    f = s.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    return s.join(f, "h").select("doc_id", F.when((F.col("copies") > 1) & (F.col("first_id") != F.col("doc_id")), F.col("first_id")).alias("copy_of"), "copies")


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '(?i)[a-z0-9._-]+@[a-z0-9.-]+', '<mail>', 'g'), '\+?[0-9]+ ?\([0-9]{3}\) [0-9]{3}-[0-9]{4}', '<phone>', 'g'), '[0-9]{6,}', '<digits>', 'g')) AS redacted FROM documents""")
def redact(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(T.redact(F.col("text"))).alias("redacted"))


@query("SELECT CASE WHEN strlen(text) = length(text) THEN 'ascii' ELSE 'utf-8' END AS encoding, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")
def encoding_classify(spark, d):
    return read(spark, d, "documents").where("text is not null").groupBy(T.encoding(F.col("text").cast("binary")).alias("encoding")).agg(F.count("*").alias("n"))


@query(f"WITH {BASE} SELECT doc_id, CAST(round_even(length(text) / 4, 0) AS BIGINT) AS est_tokens, md5(string_agg(concat(pos, chr(9), word), chr(10) ORDER BY pos)) AS prompt FROM documents JOIN tok USING (doc_id) GROUP BY doc_id, text")
def prompt_sizes(spark, d):
    t = read(spark, d, "documents").select("doc_id", "text", S.words("text").alias("w")).where(F.size("w") > 0)
    lines = F.array_join(F.transform("w", lambda x, i: F.concat((i + 1).cast("string"), F.lit("\t"), x)), "\n")
    return t.select("doc_id", T.tokens_estimate(F.col("text")).alias("est_tokens"), F.md5(lines).alias("prompt"))
