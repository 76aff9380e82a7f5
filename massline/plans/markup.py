"""Queries on marks, prompts and answers: rendering with cues, windows' answers, categories of chunks, listings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import prompts as P
from ..functions import segments as S
from ..functions import text as T
from ..operators import documents as D
from ..operators import markers as M
from ..operators import tokeniser as K
from ..operators import transcripts as R
from . import documents as DQ
from . import transcripts as TQ
from .registry import query, read

lng, r6 = TQ.lng, TQ.r6

# Units are the lines of a turn; the last word's stop is the unit's boundary.
UNITS = r"""ln AS (SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM conversations),
un AS (SELECT conv_id, turn, k, role, list_filter(string_split_regex(line, '\s+'), lambda x: x <> '') AS w FROM ln),
u AS (SELECT *, lag(role) OVER o AS before, lag(w[-1]) OVER o AS stop, lag(turn) OVER o AS pt FROM un WHERE len(w) > 0 WINDOW o AS (PARTITION BY conv_id ORDER BY turn, k))"""


def _units(spark, d):
    """conv_id, turn, k, role, w of each line with words."""
    c = read(spark, d, "conversations").select("conv_id", "turn", "role", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    return c.select("conv_id", "turn", (F.col("k") + 1).alias("k"), "role", "line", S.words("line").alias("w"))


@query(f"""WITH {UNITS}, x AS (SELECT role, before, stop, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM u),
c AS (SELECT CASE WHEN i > 1 THEN 'f' WHEN before IS NULL OR before <> role THEN 'e' WHEN ends_with(stop, '.') THEN 'a' WHEN ends_with(stop, ',') THEN 'b' WHEN ends_with(stop, '?') THEN 'c' WHEN ends_with(stop, '--') THEN 'd' ELSE 'g' END AS category,
  regexp_matches(word, '^\\p{{Lu}}') AS cap FROM x WHERE word <> 'I')
SELECT category, count(*) AS n_words, count(*) FILTER (cap) AS n_capitalised, round(count(*) FILTER (cap) / count(*), 6) AS share_capitalised FROM c GROUP BY 1""")
def capitalisation_seven(spark, d):
    """Capital letters by what stands before: the last unit's stop, a turn's begin, the unit's inside, or nothing marked."""
    o = Window.partitionBy("conv_id").orderBy("turn", "k")
    u = _units(spark, d).where(F.size("w") > 0).withColumns({"before": F.lag("role").over(o), "stop": F.lag(F.element_at("w", -1)).over(o)})
    x = u.select("role", "before", "stop", F.posexplode("w").alias("i", "word")).where("word <> 'I'")
    ends = lambda s: F.col("stop").endswith(s)
    cat = F.when(F.col("i") > 0, "f").when(F.col("before").isNull() | (F.col("before") != F.col("role")), "e").when(ends("."), "a").when(ends(","), "b").when(ends("?"), "c").when(ends("--"), "d").otherwise("g")
    g = x.groupBy(cat.alias("category")).agg(F.count("*").alias("n_words"), F.count_if(F.col("word").rlike(r"^\p{Lu}")).alias("n_capitalised"))
    return g.withColumn("share_capitalised", F.round(F.col("n_capitalised") / F.col("n_words"), 6))


REG = TQ.REG.format(c=R.CORE)


@query(f"WITH {TQ.BASE}, {REG}, x AS (SELECT conv_id, n, win, win * {R.CORE} + 1 AS s, least((win + 1) * {R.CORE}, n) AS e FROM reg), y AS (SELECT *, lag(e) OVER (PARTITION BY conv_id ORDER BY s) AS pe FROM x) SELECT conv_id, count(*) AS regions, count(*) FILTER (s <> coalesce(pe, 0) + 1) AS faults, max(e) = max(n) AS reaches_end FROM y GROUP BY 1")
def regions_tile(spark, d):
    """Whether each conversation's score regions cover its words once: begins, gaps and overlaps, ends."""
    c = TQ.conv(spark, d)
    x = R.regions(c).join(c.select("conv_id", "n"), "conv_id")
    x = x.withColumn("fault", F.col("score_start") != F.coalesce(F.lag("score_end").over(Window.partitionBy("conv_id").orderBy("score_start")), F.lit(0)) + 1)
    return x.groupBy("conv_id").agg(F.count("*").alias("regions"), F.count_if("fault").alias("faults"), (F.max("score_end") == F.max("n")).alias("reaches_end"))


@query(f"WITH {TQ.BASE}, {REG}, x AS (SELECT conv_id, win, n, win * {R.CORE} + 1 AS s, least((win + 1) * {R.CORE}, n) AS e FROM reg), y AS (SELECT r.conv_id, r.b, count(x.win) AS owners FROM r LEFT JOIN x ON x.conv_id = r.conv_id AND r.b + 1 BETWEEN x.s AND x.e GROUP BY ALL) SELECT conv_id, count(*) AS boundaries, count(*) FILTER (owners <> 1) AS faults FROM y GROUP BY 1")
def boundaries_in_one_region(spark, d):
    """Whether each boundary lies between words, and the word after it in exactly one region."""
    c = TQ.conv(spark, d)
    b = c.select("conv_id", "n", F.explode("ref").alias("b"))
    # A region that holds word b + 1 can only be the one of its number, so ranges meet by an equality.
    x = R.regions(c).select("conv_id", "win", "score_start", "score_end")
    j = b.withColumn("win", R.owner(F.col("b"))).join(x, ["conv_id", "win"], "left")
    ok = F.coalesce((F.col("b") + 1).between(F.col("score_start"), F.col("score_end")) & (F.col("b") >= 1) & (F.col("b") < F.col("n")), F.lit(False))
    return j.groupBy("conv_id").agg(F.count("*").alias("boundaries"), F.count_if(~ok).alias("faults"))


CUED = "concat(CASE WHEN cue THEN '.. ' ELSE '' END, pos, ':', lower(word))"


def _cued(t):
    return F.concat(F.when(F.col("cue"), P.SYMBOLS["pause_short"] + " ").otherwise(""), F.col("pos").cast("string"), F.lit(":"), F.lower("word"))


@query(f"WITH {TQ.BASE} SELECT conv_id, CAST(turn_id AS BIGINT) AS turn_id, concat(any_value(role), ': ', string_agg({CUED}, ' ' ORDER BY pos)) AS line FROM tok GROUP BY conv_id, turn_id")
def render_turn_lines_cues(spark, d):
    """Turns with their cues between the words; a comma or line break, which stands in for a pause, shows as one."""
    t = TQ.toks(spark, d)
    g = t.groupBy("conv_id", "turn_id").agg(F.first("role").alias("role"), F.array_sort(F.collect_list(F.struct("pos", _cued(t).alias("p")))).alias("x"))
    return g.select("conv_id", *lng("turn_id"), F.concat("role", F.lit(": "), F.array_join(F.transform("x", lambda p: p["p"]), " ")).alias("line"))


@query(f"""WITH {TQ.BASE}, c AS (SELECT unnest(['A', 'B']) AS condition), l AS (SELECT conv_id, condition, turn_id, concat(any_value(role), ': ', string_agg(CASE WHEN condition = 'B' THEN {CUED} ELSE concat(pos, ':', lower(word)) END, ' ' ORDER BY pos)) AS line FROM tok, c GROUP BY ALL),
p AS (SELECT conv_id, condition, concat('{P.sql(P.TASK)}', chr(10), CASE WHEN condition = 'B' THEN concat('{P.sql(P.GLOSSARY)}', chr(10)) ELSE '' END, string_agg(line, chr(10) ORDER BY turn_id)) AS prompt FROM l GROUP BY conv_id, condition)
SELECT conv_id, condition, CAST(round_even(length(prompt) / 4, 0) AS BIGINT) AS est_tokens, md5(prompt) AS prompt FROM p""")
def prompts_by_condition(spark, d):
    """The whole prompt of each conversation under both conditions, B with the glossary of its symbols."""
    t = TQ.toks(spark, d)
    plain = F.concat(F.col("pos").cast("string"), F.lit(":"), F.lower("word"))
    each = t.groupBy("conv_id", "turn_id").agg(F.first("role").alias("role"), F.array_sort(F.collect_list(F.struct("pos", plain.alias("A"), _cued(t).alias("B")))).alias("x"))
    line = lambda c: F.concat("role", F.lit(": "), F.array_join(F.transform("x", lambda p: p[c]), " "))
    doc = each.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn_id", line("A").alias("A"), line("B").alias("B")))).alias("x"))
    text = lambda c: F.array_join(F.transform("x", lambda p: p[c]), "\n")
    both = doc.select("conv_id", F.explode(F.array(*[F.struct(F.lit(c).alias("condition"), P.prompt(text(c), c).alias("prompt")) for c in "AB"])).alias("x"))
    return both.select("conv_id", "x.condition", T.tokens_estimate(F.col("x.prompt")).alias("est_tokens"), F.md5("x.prompt").alias("prompt"))


# An answer per window: the cue rule's starts there, now and then with a position that the window doesn't show.
ANSWERS = f"""{REG.format(c=R.CORE)}, x AS (SELECT conv_id, win, n, greatest(win * {R.CORE} + 1 - {R.MARGIN}, 1) AS lo, least(least((win + 1) * {R.CORE}, n) + {R.MARGIN}, n) AS hi, substr(md5(concat_ws('|', conv_id, win)), 1, 1) < '4' AS odd FROM reg),
a AS (SELECT x.conv_id, x.win, x.lo, x.hi, h.b + 1 AS i FROM x JOIN (SELECT * FROM h UNION SELECT * FROM t) h ON h.conv_id = x.conv_id AND h.b + 1 BETWEEN x.lo AND x.hi UNION ALL SELECT conv_id, win, lo, hi, hi + 7 FROM x WHERE odd),
k AS (SELECT a.*, t.b IS NOT NULL AS turn_initial FROM a LEFT JOIN t ON t.conv_id = a.conv_id AND t.b = a.i - 1)"""


@query(f"""WITH {TQ.BASE}, {ANSWERS} SELECT x.conv_id, x.win, CASE WHEN count(i) FILTER (NOT turn_initial AND i NOT BETWEEN x.lo AND x.hi) > 0 THEN 'fail' ELSE 'ok' END AS status,
CASE WHEN count(i) FILTER (NOT turn_initial AND i NOT BETWEEN x.lo AND x.hi) > 0 THEN concat('positions outside window [', x.lo, ',', x.hi, ']') END AS reason,
count(i) FILTER (NOT turn_initial AND i BETWEEN x.lo AND x.hi) AS kept, count(i) FILTER (turn_initial) AS dropped_turn_initial FROM x LEFT JOIN k ON k.conv_id = x.conv_id AND k.win = x.win GROUP BY x.conv_id, x.win, x.lo, x.hi""")
def window_answers(spark, d):
    """Answers per window, parsed and held to what the window shows; starts of turns are no find."""
    c = TQ.conv(spark, d)
    w = R.regions(c).join(c.select("conv_id", "hyp", "turns"), "conv_id")
    # Positions are dealt to the windows that show them by number, so no window scans a conversation's whole array.
    odd = F.substring(F.md5(F.concat_ws("|", F.col("conv_id").cast("string"), F.col("win").cast("string"))), 1, 1) < "4"
    shown = c.select("conv_id", "n", F.explode(F.array_union("hyp", "turns")).alias("b")).withColumn("i", F.col("b") + 1)
    own = F.floor((F.col("i") - 1) / R.CORE).cast("int")
    local = F.col("i") - own * R.CORE
    wins = F.filter(F.array(F.when(local <= R.MARGIN, own - 1), own, F.when(local > R.CORE - R.MARGIN, own + 1)), lambda x: x.isNotNull() & (x >= 0) & (x * R.CORE < F.col("n")))
    given = shown.select("conv_id", F.explode(wins).alias("win"), "i").groupBy("conv_id", "win").agg(F.array_sort(F.collect_list("i")).alias("starts"))
    turns = c.select("conv_id", F.explode("turns").alias("b")).select("conv_id", F.explode(F.array(*[R.owner(F.col("b")) + k for k in (-1, 0, 1)])).alias("win"), (F.col("b") + 1).alias("i")).groupBy("conv_id", "win").agg(F.collect_list("i").alias("initial"))
    none = F.expr("cast(array() as array<int>)")
    x = w.select("conv_id", "win", "window_start", "window_end", odd.alias("odd")).join(given, ["conv_id", "win"], "left").join(turns, ["conv_id", "win"], "left")
    starts = F.concat(F.coalesce("starts", none), F.when(F.col("odd"), F.array(F.col("window_end") + 7)).otherwise(none))
    raw = F.concat(F.lit("["), F.array_join(starts.cast("array<string>"), ", "), F.lit("]"))
    x = x.select("conv_id", "win", P.window_answer(raw, F.col("window_start"), F.col("window_end"), F.coalesce("initial", none)).alias("a"))
    return x.select("conv_id", *lng("win"), "a.status", "a.reason", F.size("a.kept").cast("long").alias("kept"), F.size("a.dropped").cast("long").alias("dropped_turn_initial"))


EXAMPLES, TARGET = 3, 45
FEW = f"""n3 AS (SELECT doc_id, n FROM doc WHERE n >= {TARGET} ORDER BY doc_id LIMIT {EXAMPLES}), ends AS (SELECT s.doc_id, s.b, s.mass FROM seg s JOIN n3 USING (doc_id) WHERE s.b - s.mass < {TARGET}),
ex AS (SELECT e.doc_id, max(e.b) AS upto, string_agg(CAST(e.b - e.mass + 1 AS VARCHAR), ', ' ORDER BY e.b) AS starts FROM ends e GROUP BY 1),
et AS (SELECT row_number() OVER (ORDER BY ex.doc_id) AS no, any_value(starts) AS starts, string_agg(concat(t.pos, chr(9), t.word), chr(10) ORDER BY t.pos) AS lines FROM ex JOIN tok t ON t.doc_id = ex.doc_id AND t.pos <= ex.upto GROUP BY ex.doc_id),
head AS (SELECT coalesce(string_agg(concat('Example ', no, ':', chr(10), lines, chr(10), chr(10), 'Starts: [', starts, ']', chr(10), chr(10)), '' ORDER BY no), '') AS h FROM et)"""


@query(f"WITH {DQ.BASE}, {FEW}, p AS (SELECT doc_id, concat('{P.sql(P.FEW_HEAD)}', (SELECT h FROM head), '{P.sql(P.FEW_TAIL)}', string_agg(concat(pos, chr(9), word), chr(10) ORDER BY pos), chr(10)) AS prompt FROM tok GROUP BY doc_id) SELECT doc_id, CAST(round_even(length(prompt) / 4, 0) AS BIGINT) AS est_tokens, md5(prompt) AS prompt FROM p")
def fewshot_prompts(spark, d):
    """Every document's prompt with worked examples: the first documents that are long enough, cut at whole segments."""
    base = DQ.docs(spark, d).where("n > 0")
    # A fixed number of examples: three short rows, in the driver's hands as they are part of every prompt.
    chosen = base.where(F.col("n") >= TARGET).orderBy("doc_id").limit(EXAMPLES)
    head = P.examples(D.cut_to_segments(chosen, TARGET).orderBy("doc_id").collect())
    return base.select("doc_id", P.few_shot(head, F.col("w")).alias("prompt")).select("doc_id", T.tokens_estimate(F.col("prompt")).alias("est_tokens"), F.md5("prompt").alias("prompt"))


@query(f"""WITH {TQ.BASE}, {TQ.LEGIT.format(src='r')}, top AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY len DESC, win, s) <= 3)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY len DESC, win, s) AS rank, win, len AS run_length, CAST(s AS BIGINT) AS span_start FROM top""")
def longest_runs_top(spark, d):
    """The three longest runs of boundaries in each conversation: examples to look at."""
    w = R.scoped(TQ.conv(spark, d)).where("scope = 'within_turn'").select("conv_id", F.explode("ref").alias("b")).withColumn("win", R.owner(F.col("b")))
    w = w.withColumn("g", F.col("b") - F.row_number().over(Window.partitionBy("conv_id", "win").orderBy("b")))
    runs = w.groupBy("conv_id", "win", "g").agg(F.count("*").alias("run_length"), F.min("b").cast("long").alias("span_start"))
    o = Window.partitionBy("conv_id").orderBy(F.desc("run_length"), "win", "span_start")
    return runs.withColumn("rank", F.row_number().over(o).cast("long")).where("rank <= 3").select("conv_id", "rank", *lng("win"), "run_length", "span_start")


@query(f"WITH {DQ.BASE} SELECT word, count(*) AS n FROM tok GROUP BY word ORDER BY n DESC, word LIMIT 25")
def most_common_words(spark, d):
    return read(spark, d, "documents").select(F.explode(S.words("text")).alias("word")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(25)


@query(f"WITH {DQ.BASE} SELECT CASE WHEN mass > 10 THEN '11+' ELSE CAST(mass AS VARCHAR) END AS bin, count(*) AS n, CAST(sum(mass) AS BIGINT) AS words FROM seg GROUP BY 1")
def mass_histogram(spark, d):
    """Segment lengths with the tail in one bin."""
    m = DQ.docs(spark, d).where("n > 0").select(F.explode(S.boundaries_to_masses("ref", "n")).alias("m"))
    return m.groupBy(F.when(F.col("m") > 10, "11+").otherwise(F.col("m").cast("string")).alias("bin")).agg(F.count("*").alias("n"), F.sum("m").alias("words"))


@query("WITH c AS (SELECT unnest(string_split(text, '')) AS ch FROM documents) SELECT CAST(unicode(ch) AS BIGINT) AS code_point, count(*) AS n FROM c WHERE regexp_matches(ch, '^[^A-Za-z\\s]$') GROUP BY 1")
def char_histogram(spark, d):
    """How often each character beyond ASCII letters and white space stands in the texts."""
    c = read(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^A-Za-z\s]"), F.lit(0))).alias("ch")).groupBy("ch").agg(F.count("*").alias("n"))
    return c.select(F.ascii("ch").cast("long").alias("code_point"), "n")


@query(rf"WITH x AS (SELECT len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS a, len(list_filter(string_split_regex(regexp_replace(regexp_replace(text, '\[[0-9]+', '', 'g'), '[#$%&*|!]+', ' ', 'g'), '\s+'), lambda x: x <> '')) AS b FROM documents WHERE text IS NOT NULL) SELECT CAST(b - a AS BIGINT) AS change, count(*) AS documents FROM x GROUP BY 1")
def field_counts_changed(spark, d):
    """Fields of a text before and after marks are taken out: by how many their number changes."""
    bare = F.regexp_replace(F.regexp_replace("text", r"\[[0-9]+", ""), r"[#$%&*|!]+", " ")
    x = read(spark, d, "documents").where("text is not null").select((F.size(S.words(bare)) - F.size(S.words("text"))).cast("long").alias("change"))
    return x.groupBy("change").agg(F.count("*").alias("documents"))


@query(f"WITH {UNITS}, x AS (SELECT role, len(w) > 0 AS has FROM un) SELECT coalesce(role, 'ALL') AS role, count(*) AS raw_lines, count(*) FILTER (has) AS units, count(*) FILTER (NOT has) AS zero_word, count(*) = count(*) FILTER (has) + count(*) FILTER (NOT has) AS reconciles FROM x GROUP BY GROUPING SETS ((role), ())")
def unit_reconciliation(spark, d):
    """Raw lines, units and what was left out, and whether they add up; ALL at last."""
    has = F.size("w") > 0
    g = _units(spark, d).groupingSets([["role"], []], "role").agg(F.count("*").alias("raw_lines"), F.count_if(has).alias("units"), F.count_if(~has).alias("zero_word"))
    return g.select(F.coalesce("role", F.lit("ALL")).alias("role"), "raw_lines", "units", "zero_word", (F.col("raw_lines") == F.col("units") + F.col("zero_word")).alias("reconciles"))


@query("WITH c AS (SELECT lang, unnest(string_split(text, '')) AS mark FROM documents), n AS (SELECT lang, mark, count(*) AS n FROM c WHERE mark IN ('.', ',', '!', '#', '$', '%', '&', '*', '|') GROUP BY ALL) SELECT lang, string_agg(concat(mark, '=', n), ' ' ORDER BY mark) AS marks FROM n GROUP BY lang")
def summed_maps(spark, d):
    """Each document's counts of marks, summed over the documents of a language."""
    marks = [".", ",", "!", "#", "$", "%", "&", "*", "|"]
    per = read(spark, d, "documents").select("lang", *[(F.length("text") - F.length(F.replace("text", F.lit(m), F.lit("")))).alias(f"m{i}") for i, m in enumerate(marks)])
    g = per.groupBy("lang").agg(*[F.sum(f"m{i}").alias(f"m{i}") for i in range(len(marks))])
    order = sorted(range(len(marks)), key=lambda i: marks[i])
    parts = F.array(*[F.when(F.col(f"m{i}") > 0, F.concat(F.lit(marks[i] + "="), F.col(f"m{i}").cast("string"))) for i in order])
    return g.select("lang", F.array_join(F.filter(parts, lambda x: x.isNotNull()), " ").alias("marks")).where("marks <> ''")


@query(f"WITH {DQ.BASE} SELECT regexp_matches(word, '^[^\\p{{L}}\\p{{N}}]') AS opens_with_mark, regexp_matches(word, '[^\\p{{L}}\\p{{N}}]$') AS ends_with_mark, count(*) AS n, count(DISTINCT word) AS forms FROM tok GROUP BY 1, 2")
def prefix_suffix_flags(spark, d):
    w = read(spark, d, "documents").select(F.explode(S.words("text")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return w.groupBy(F.col("word").rlike(r"^[^\p{L}\p{N}]").alias("opens_with_mark"), F.col("word").rlike(r"[^\p{L}\p{N}]$").alias("ends_with_mark")).agg(F.sum("n").alias("n"), F.count("*").alias("forms"))


@query("SELECT doc_id, lang FROM documents WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1")
def keep_first(spark, d):
    """The first document of each text."""
    x = read(spark, d, "documents").where("text is not null").groupBy(F.md5("text").alias("h")).agg(F.min(F.struct("doc_id", "lang")).alias("x"))
    return x.select("x.doc_id", "x.lang")


ZERO = r"CASE WHEN s = '' THEN 'raw_empty' WHEN regexp_matches(s, '^[\s@]+$') THEN 'laughter_only' WHEN regexp_matches(s, '^(\s*\(Hx?\)\s*)+$') THEN 'breath_only' WHEN regexp_matches(s, '^(\s*\.{2,3}(\([0-9]+(\.[0-9]+)?\))?\s*)+$') THEN 'pause_only' WHEN regexp_matches(s, '^(\s*\([A-Z][A-Z0-9_., ]*\)\s*)+$') THEN 'vocal_noise_only' WHEN regexp_matches(s, '^(\s*\(\([^()]*\)\)\s*)+$') THEN 'comment_only' WHEN contains(s, '[') OR contains(s, ']') THEN 'nonwords_in_overlap_brackets' ELSE 'other' END"
# Lines without words are rare in the driver's texts; a line's letters give way to marks by a hash digit.
ZERO_LINE = "CASE substr(md5(concat_ws('|', conv_id, turn, k)), 1, 1) WHEN '0' THEN '' WHEN '1' THEN ' @@ @' WHEN '2' THEN '(H) (Hx)' WHEN '3' THEN '... ..' WHEN '4' THEN '...(1.2)' WHEN '5' THEN '(COUGH)' WHEN '6' THEN '((DOOR SLAMS))' WHEN '7' THEN '[2(H' WHEN '8' THEN '(H' WHEN '9' THEN '  ' ELSE regexp_replace(line, '\\p{L}+', '', 'g') END"


def zero_word_category(text):
    """What a unit without words is made of: the first kind that it consists of."""
    s = F.trim(text)
    kinds = {"laughter_only": r"^[\s@]+$", "breath_only": r"^(\s*\(Hx?\)\s*)+$", "pause_only": r"^(\s*\.{2,3}(\([0-9]+(\.[0-9]+)?\))?\s*)+$", "vocal_noise_only": r"^(\s*\([A-Z][A-Z0-9_., ]*\)\s*)+$", "comment_only": r"^(\s*\(\([^()]*\)\)\s*)+$"}
    out = F.when(s == "", "raw_empty")
    for name, pattern in kinds.items():
        out = out.when(s.rlike(pattern), name)
    return out.when(s.contains("[") | s.contains("]"), "nonwords_in_overlap_brackets").otherwise("other")


@query(f"WITH {UNITS}, z AS (SELECT trim({ZERO_LINE}) AS s FROM ln) SELECT {ZERO} AS category, count(*) AS n FROM z GROUP BY 1")
def zero_word_categories(spark, d):
    u = _units(spark, d)
    h = F.substring(F.md5(F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.col("k").cast("string"))), 1, 1)
    given = ("", " @@ @", "(H) (Hx)", "... ..", "...(1.2)", "(COUGH)", "((DOOR SLAMS))", "[2(H", "(H", "  ")
    line = F.regexp_replace("line", r"\p{L}+", "")
    for i in reversed(range(len(given))):
        line = F.when(h == str(i), given[i]).otherwise(line)
    return u.groupBy(zero_word_category(line).alias("category")).agg(F.count("*").alias("n"))


GAPS = {"boundary_inside_chunk": r"[.,?]|-{2,}", "displaced_truncation_flush": r"[=%]-($|[^-])", "underscore_truncation_ends_word": r"_($|[^_])"}
GAP_SQL = "CASE " + " ".join(f"WHEN regexp_matches(g, '{p}') THEN '{k}'" for k, p in GAPS.items()) + " ELSE 'other' END"


def gap_category(gap):
    out = None
    for name, pattern in GAPS.items():
        out = F.when(gap.rlike(pattern), name) if out is None else out.when(gap.rlike(pattern), name)
    return out.otherwise("other")


def split_category(gaps):
    """One name for the gaps inside a chunk: theirs if they agree, several documented ones together, or other."""
    kinds = F.array_sort(F.array_distinct(F.transform(gaps, gap_category)))
    return F.when(F.size(kinds) == 1, kinds[0]).when(~F.array_contains(kinds, "other"), F.concat(F.lit("multiple: "), F.array_join(kinds, " + "))).otherwise("other")


@query(rf"""WITH {DQ.BASE}, w AS (SELECT word, count(*) AS n FROM tok GROUP BY 1), x AS (SELECT word, n, list_distinct(list_transform(regexp_extract_all(regexp_replace(regexp_replace(word, '^[^\p{{L}}]+', ''), '[^\p{{L}}]+$', ''), '[^\p{{L}}]+'), lambda g: {GAP_SQL})) AS kinds FROM w)
SELECT CASE WHEN len(kinds) = 1 THEN kinds[1] WHEN NOT list_contains(kinds, 'other') THEN concat('multiple: ', list_aggregate(list_sort(kinds), 'string_agg', ' + ')) ELSE 'other' END AS category, count(*) AS chunks, CAST(sum(n) AS BIGINT) AS n FROM x WHERE len(kinds) > 0 GROUP BY 1""")
def chunk_split_categories(spark, d):
    """Chunks whose letters stand in several runs, by what parts them."""
    w = read(spark, d, "documents").select(F.explode(S.words("text")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    inner = F.regexp_replace(F.regexp_replace("word", r"^[^\p{L}]+", ""), r"[^\p{L}]+$", "")
    x = w.withColumn("gaps", F.regexp_extract_all(inner, F.lit(r"[^\p{L}]+"), F.lit(0))).where(F.size("gaps") > 0)
    return x.groupBy(split_category(F.col("gaps")).alias("category")).agg(F.count("*").alias("chunks"), F.sum("n").alias("n"))


# Kinds of chunks by the first mark that explains them, in order.
CHUNKS = (
    ("hyphen_only_chunk", r"^-+$"), ("doubled_cue_fusion", r"\p{L}.*[=^`!;%\\]{2,}.*\p{L}"), ("parenthetical_marker", r"[()]"), ("overlap_bracket", r"[\[\]]"), ("angle_tag", r"[<>]"),
    ("underscore_truncation_or_gloss", r"_"), ("disguise_prefix", r"[~#*]"), ("lost_initial_letter", r"0(\.000000([eE]\+00)?)?[a-z-]"), ("plus_fusion", r"[+]"), ("at_sign_fusion", r"@"),
)


def chunk_category(chunk):
    out = None
    for name, pattern in CHUNKS:
        out = F.when(chunk.rlike(pattern), name) if out is None else out.when(chunk.rlike(pattern), name)
    return out.otherwise("other")


CHUNK_SQL = "CASE " + " ".join(f"WHEN regexp_matches(word, '{p}') THEN '{k}'" for k, p in CHUNKS) + " ELSE 'other' END"


@query(f"WITH {DQ.BASE} SELECT {CHUNK_SQL} AS category, count(*) AS n, count(DISTINCT word) AS forms FROM tok WHERE regexp_matches(word, '[^\\p{{L}}]') GROUP BY 1")
def chunk_categories(spark, d):
    w = read(spark, d, "documents").select(F.explode(S.words("text")).alias("word")).where(F.col("word").rlike(r"[^\p{L}]")).groupBy("word").agg(F.count("*").alias("n"))
    return w.groupBy(chunk_category(F.col("word")).alias("category")).agg(F.sum("n").alias("n"), F.count("*").alias("forms"))


# What explains a difference of word counts, the first that fits.
CROSS = (
    ("hyphen_only_run", r"(^|[^\p{L}'\-])-+($|[^\p{L}'\-])"), ("cue_fusion", r"[A-Za-z'][=^`!;%\\][A-Za-z']"), ("parenthetical_marker", r"[()]"), ("underscore_truncation_or_gloss", r"_"), ("phonetic_gloss", r"/[^/]*/"),
    ("lost_initial_letter", r"0(\.000000([eE]\+00)?)?[a-z-]"), ("numbered_overlap_bracket", r"\[[0-9]+|[0-9]+\]"), ("overlap_bracket", r"[\[\]]"), ("angle_tag", r"[<>]"), ("disguise_prefix", r"[~#*]"), ("plus_fusion", r"[+]"), ("at_sign_fusion", r"@"),
)
CROSS_SQL = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}') THEN '{k}'" for k, p in CROSS) + " ELSE 'other' END"


@query(rf"""WITH x AS (SELECT text, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) - len(list_filter(string_split_regex(regexp_replace(text, '[^\p{{L}}''\-\s]', ' ', 'g'), '\s+'), lambda x: x <> '')) AS diff FROM documents WHERE text IS NOT NULL)
SELECT {CROSS_SQL} AS category, count(*) AS texts, CAST(sum(diff) AS BIGINT) AS diff FROM x WHERE diff <> 0 GROUP BY 1""")
def crosscheck_categories(spark, d):
    """Texts whose words and whose letter runs differ in number, by the mark that explains it."""
    x = read(spark, d, "documents").where("text is not null").select("text", (F.size(S.words("text")) - F.size(T.letters_runs(F.col("text")))).alias("diff")).where("diff <> 0")
    cat = None
    for name, pattern in CROSS:
        cat = F.when(F.col("text").rlike(pattern), name) if cat is None else cat.when(F.col("text").rlike(pattern), name)
    return x.groupBy(cat.otherwise("other").alias("category")).agg(F.count("*").alias("texts"), F.sum("diff").alias("diff"))


@query()
def word_internal_marks(spark, d):
    """Plain marks by place: inside a word, at its end, alone. Commas, which the driver's texts have, turn into lengthenings."""
    text = F.regexp_replace("line", ",", "=")
    x = _units(spark, d).select(F.explode(K.places(text)).alias("x"))
    g = x.groupBy("x.mark").agg(*[F.count_if(F.col("x.place") == p).alias(p) for p in ("word_internal", "word_final", "standalone")])
    return g.withColumn("vanish_share", F.round(F.col("word_internal") / (F.col("word_internal") + F.col("word_final") + F.col("standalone")), 6))


@query()
def marker_scan(spark, d):
    """Marks of all lines by class, tier and place among the words."""
    x = _units(spark, d).select("conv_id", F.explode(M.marks(F.col("line"))).alias("x"))
    return x.groupBy("x.cls", "x.tier").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("files"), *[F.count_if(F.col("x.place") == p).alias(p) for p in ("before_first_word", "between_words", "after_last_word", "iu_has_no_words")])
