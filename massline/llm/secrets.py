"""Secret scans with built-in functions alone: fixed patterns, and a battery of randomness tests for the rest."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.segments import running
from ..functions.text import let
from . import common

# The base patterns and their least lengths. An [A-Z0-9] or [0-9a-f] run is maximal, so that asking for
# the length in the pattern finds what dropping short matches leaves.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: What the randomness tests look at.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Share of false finds among the random finds of a table, and how finely p-values are told apart: steps per factor e.
FDR, STEPS = 0.01, 20
#: Order of the kinds at one start.
KINDS = ("assign", "access", "hex", "random")

#: Encodings, tried in this order: name, what a token of it matches, alphabet size, the squared deviation from uniform
#: letter use that running text shows per character (sum of p squared, times the size, less 1), and the chance that two
#: neighbouring characters of a random token differ in class (lower, upper, digit, other).
ENCODINGS = (
    ("decimal", "^[0-9]+$", 10, 0.3, 0.0),
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", 16, 0.9, 0.469),
    ("base32", "^[A-Z2-7]+$", 32, 1.1, 0.305),
    ("lower", "^[a-z]+$", 26, 0.7, 0.0),
    ("upper", "^[A-Z]+$", 26, 0.7, 0.0),
    ("letters", "^[A-Za-z]+$", 52, 2.4, 0.5),
    ("base64", "^[A-Za-z0-9+/_-]+$", 64, 3.2, 0.643),
)
#: Chance of a change of class between neighbours in names, paths and prose, and correlation of neighbouring codes there.
NATURAL_CHANGE, NATURAL_SERIAL = 0.1, 0.35


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches, in code points.

    What split() leaves between the matches and the matches themselves alternate, so their lengths add up to offsets.
    """

    def placed(x: Column) -> Column:
        lengths = F.transform(x["found"], lambda m: F.length(m))
        steps = F.zip_with(F.slice(x["gaps"], 1, F.size(x["found"])), lengths, lambda g, n: F.length(g) + n)
        at = F.zip_with(running(steps), lengths, lambda e, n: F.struct((e - n).cast("int").alias("start"), e.cast("int").alias("end")))
        value = x["found"] if group == 0 else x["value"]
        return F.zip_with(at, value, lambda p, v: F.struct(p["start"].alias("start"), p["end"].alias("end"), v.alias("value")))

    every = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
    return let(every, placed)


def _none() -> Column:
    return F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution, by the usual cubic logistic fit."""
    return 1 / (1 + F.exp(F.least(F.lit(700.0), F.lit(1.5976) * z + F.lit(0.07056) * z * z * z)))


def _encoding(value: Column, pick: int) -> Column:
    out = F.when(value.rlike(ENCODINGS[0][1]), F.lit(float(ENCODINGS[0][pick])))
    for e in ENCODINGS[1:]:
        out = out.when(value.rlike(e[1]), F.lit(float(e[pick])))
    return out.otherwise(F.lit(float(ENCODINGS[-1][pick])))


def _counted(v: Column) -> Column:
    """struct of a token's length n, sum of its squared character counts, changes of class r, and serial correlation."""
    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("last", "kind", "s", "ss", "sp", "r", "first")], F.lit(0).alias("n"))

    def step(acc: Column, c: Column) -> Column:
        kind = F.when(c.between(97, 122), 1.0).when(c.between(65, 90), 2.0).when(c.between(48, 57), 3.0).otherwise(4.0)
        begins = acc["n"] == 0
        return F.struct(
            c.alias("last"), kind.alias("kind"), (acc["s"] + c).alias("s"), (acc["ss"] + c * c).alias("ss"), (acc["sp"] + acc["last"] * c).alias("sp"),
            (acc["r"] + F.when(~begins & (kind != acc["kind"]), 1.0).otherwise(0.0)).alias("r"), F.when(begins, c).otherwise(acc["first"]).alias("first"), (acc["n"] + 1).alias("n"),
        )

    # Equal characters side by side: a run of k adds k squared, 2j - 1 for its j-th.
    runs = F.struct(F.lit(0.0).alias("last"), F.lit(0.0).alias("k"), F.lit(0.0).alias("sq"))

    def again(acc: Column, c: Column) -> Column:
        k = F.when(c == acc["last"], acc["k"] + 1).otherwise(1.0)
        return F.struct(c.alias("last"), k.alias("k"), (acc["sq"] + 2 * k - 1).alias("sq"))

    def of(codes: Column) -> Column:
        sums = F.aggregate(codes, zero, step)
        squares = F.aggregate(F.array_sort(codes), runs, again)["sq"]
        return let(sums, lambda t: F.struct(t["n"].cast("double").alias("n"), t["r"].alias("r"), squares.alias("sq"), _serial(t).alias("rho")))

    return let(F.transform(F.split(v, ""), lambda c: F.ascii(c).cast("double")), of)


def _serial(t: Column) -> Column:
    n = t["n"].cast("double")
    mean = t["s"] / n
    var = t["ss"] - n * mean * mean
    cov = t["sp"] - mean * (2 * t["s"] - t["last"] - t["first"]) + (n - 1) * mean * mean
    return F.when(var > 1e-6, cov / var).otherwise(F.lit(1.0))


def battery(found: Column) -> Column:
    """Candidates -> array<struct<start, end, p, ok, n>>.

    p is the chance that running text of the inferred encoding looks so random, by alphabet use (chi-squared, against
    the non-central one of text), by changes of class (runs) and by the correlation of neighbours (serial), combined as
    normal deviates. Encodings of one class have no runs to speak of and go by their alphabet alone. ok says that no
    test rejects a random origin: alphabet use not too uneven, runs as many as expected, neighbours uncorrelated.
    """
    bare = F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.regexp_replace(x["value"], "=+$", "").alias("v")))
    bare = F.filter(bare, lambda x: F.length(x["v"]) >= 16)

    def judge(x: Column, t: Column) -> Column:
        n, a, phi, q = t["c"]["n"], t["a"], t["phi"], t["q"]
        chi = a / n * t["c"]["sq"] - n
        sd = F.sqrt(2 * (a - 1))
        z_chi = ((a - 1) + (n - 1) * phi - chi) / F.sqrt(2 * (a - 1) + 4 * n * phi)
        z_runs = (t["c"]["r"] - (n - 1) * NATURAL_CHANGE) / F.sqrt((n - 1) * NATURAL_CHANGE * (1 - NATURAL_CHANGE))
        z_serial = (NATURAL_SERIAL - F.abs(t["c"]["rho"])) * F.sqrt(n)
        z = F.when(q > 0, (z_chi + z_runs + z_serial) / F.sqrt(F.lit(3.0))).otherwise(z_chi)
        runs_off = F.when(q > 0, F.abs(t["c"]["r"] - (n - 1) * q) / F.sqrt((n - 1) * q * (1 - q) + F.lit(1e-9))).otherwise(F.lit(0.0))
        ok = (chi <= (a - 1) + 4 * sd) & (runs_off <= 4) & (F.abs(t["c"]["rho"]) * F.sqrt(n) <= 3.3)
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), _tail(z).alias("p"), ok.alias("ok"), n.alias("n"))

    def one(x: Column) -> Column:
        known = F.struct(_counted(x["v"]).alias("c"), _encoding(x["v"], 2).alias("a"), _encoding(x["v"], 3).alias("phi"), _encoding(x["v"], 4).alias("q"))
        return let(known, lambda t: judge(x, t))

    return F.transform(bare, one)


def _candidates(text: Column) -> Column:
    return F.when(text.rlike(CANDIDATE), matches(text, CANDIDATE)).otherwise(_none())


def threshold(docs: DataFrame, rate: float = FDR) -> float:
    """Step-up control of the false-discovery rate over all candidates of a table: the largest p by length to accept.

    A candidate's p is weighted by its length over the mean length, so what counts is p / n. These are counted in steps
    of a fixed width on a logarithmic scale, some thousand at most; the result is the upper edge of the last step at
    which edge * mean length <= rate * share of candidates up to there, or 0 without any.
    """
    judged = docs.select(_candidates(F.coalesce(F.col("text"), F.lit(""))).alias("c")).where(F.size("c") > 0).select(F.explode(battery(F.col("c"))).alias("x"))
    step = F.ceil(F.log(F.col("x.p") / F.col("x.n")) * STEPS).cast("int")
    counts = sorted(judged.groupBy(step.alias("step")).agg(F.count("*").alias("k"), F.sum("x.n").alias("n")).collect())
    m, mean, upto, best = sum(r["k"] for r in counts), 0.0, 0, 0.0
    if m:
        mean = sum(r["n"] for r in counts) / m
    for r in counts:
        upto += r["k"]
        edge = math.exp(r["step"] / STEPS)
        if edge * mean <= rate * upto / m:
            best = edge
    return best


def counts_below(points: Column, queries: Column, or_equal: bool) -> Column:
    """For each of the ascending queries, how many points are below it (or equal): one sort of both, and a running sum."""
    mine, theirs = (0, 1) if not or_equal else (1, 0)
    event = lambda xs, order, add: F.transform(xs, lambda p: F.struct(p.alias("at"), F.lit(order).alias("o"), F.lit(add).alias("add")))
    merged = F.array_sort(F.concat(event(points, theirs, 1), event(queries, mine, 0)))

    def walk(e: Column) -> Column:
        upto = F.zip_with(e, running(F.transform(e, lambda x: x["add"])), lambda x, c: F.struct(x["add"].alias("add"), c.alias("c")))
        return F.transform(F.filter(upto, lambda x: x["add"] == 0), lambda x: x["c"])

    return let(merged, walk)


def apart(spans: Column, base: Column) -> Column:
    """Those of the ascending, disjoint spans that no base span overlaps.

    As many base spans overlap one as begin before its end, less those that have ended by its start.
    """

    def free(x: Column) -> Column:
        begun = counts_below(F.transform(x["b"], lambda b: b["start"]), F.transform(x["s"], lambda s: s["end"]), False)
        ended = counts_below(F.transform(x["b"], lambda b: b["end"]), F.transform(x["s"], lambda s: s["start"]), True)
        both = F.zip_with(x["s"], F.zip_with(begun, ended, lambda p, q: p == q), lambda s, ok: F.struct(s.alias("s"), ok.alias("ok")))
        return F.transform(F.filter(both, lambda y: y["ok"]), lambda y: y["s"])

    return let(F.struct(spans.alias("s"), base.alias("b")), lambda x: F.when((F.size(x["s"]) > 0) & (F.size(x["b"]) > 0), free(x)).otherwise(x["s"]))


def scan(docs: DataFrame, limit: float | None = None) -> DataFrame:
    """docs (doc_id, text, ...) -> the same plus spans: array<struct<start, kind_no, end, kind>>, by start, then kind.

    Offsets are code points, end exclusive; a null text counts as empty and has no span. limit is the threshold of random
    spans, which the table itself gives if it is left out, at the price of reading it twice. A random span that overlaps
    one of the fixed kinds isn't added, as that one stays anyway. Everything is a row-local expression in time that
    grows with the text, but for sorting its matches: no shuffle, no Python. Columns of docs called spans, _base or _random are replaced.
    """
    limit = threshold(docs) if limit is None else limit
    docs = docs.drop("spans", "_base", "_random")
    text = F.coalesce(F.col("text"), F.lit(""))
    low = F.lower(text)
    named = low.contains("password") | low.contains("passwd") | low.contains("secret") | low.contains("token") | low.contains("apikey") | low.contains("api_key")
    assign = F.filter(matches(text, ASSIGN, 2), lambda x: F.length(x["value"]) >= ASSIGN_LEAST)
    named_as = lambda col, i: F.transform(col, lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("kind_no"), x["end"].alias("end"), F.lit(KINDS[i]).alias("kind")))
    base = F.concat(
        named_as(F.when(named, assign).otherwise(_none()), 0), named_as(F.when(text.contains("AKIA"), matches(text, ACCESS)).otherwise(_none()), 1),
        named_as(F.when(text.rlike(HEX), matches(text, HEX)).otherwise(_none()), 2),
    )
    found = F.filter(battery(_candidates(text)), lambda x: x["ok"] & (x["p"] / x["n"] <= F.lit(limit)))
    # Two steps keep the expressions shallow enough for the analyser.
    out = docs.select(*docs.columns, base.alias("_base"), named_as(found, 3).alias("_random"))
    spans = let(F.struct(F.col("_base").alias("b"), F.col("_random").alias("r")), lambda x: F.array_sort(F.concat(x["b"], apart(x["r"], x["b"]))))
    return out.select(*docs.columns, spans.alias("spans"))


def redact(scanned: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """Every span of the text, overlapping ones as one, replaced by a mark; texts without a span stay as they are."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, x: F.struct(
        F.greatest(acc["at"], x["end"]).alias("at"),
        F.when(x["start"] >= acc["at"], F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"),
    )
    clean = F.aggregate("spans", zero, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return scanned.withColumn("text", F.when(F.size("spans") > 0, clean).otherwise(F.col("text")))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    out = scan(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("spans")
    n = lambda i: F.size(F.filter(spans, lambda x: x["kind_no"] == i)).cast("long")
    return out.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(written(F.filter(spans, lambda x: x["kind_no"] < 3)), 256).alias("base_sha256"), written(spans).alias("spans"))
