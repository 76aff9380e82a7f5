"""Documents as token arrays with a reference and a hypothesis segmentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import segments as S
from ..functions.text import let


def digit(*parts: Column) -> Column:
    """First hex digit of a hash of the parts: the same draw on any engine and in any order."""
    return F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 1)


def segmented(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, lang, w, n, ref: a segment ends at a word that ends in a full stop."""
    base = docs.select("doc_id", "lang", S.words("text").alias("w")).withColumn("n", F.size("w"))
    return base.withColumn("ref", F.array_remove(S.positions("w", lambda x: x.endswith(".")), F.col("n")))


def perturbed(docs: DataFrame, sample: int | Column = 0) -> DataFrame:
    """Adds hyp: each reference boundary kept, moved by one or dropped by a hash digit, and some commas added."""
    tag = sample if isinstance(sample, Column) else F.lit(sample)
    moved = F.transform("ref", lambda b: _shift(digit(F.col("doc_id"), b, tag), b))
    commas = F.filter(S.positions("w", lambda x: x.endswith(",")), lambda b: digit(F.col("doc_id"), F.lit("c"), b, tag) < "4")
    # n is bound once: a column inside a lambda is worked out again for each item if the planner merges projections.
    hyp = let(F.col("n"), lambda n: F.filter(F.concat(moved, commas), lambda b: b.isNotNull() & (b >= 1) & (b < n)))
    return docs.withColumn("hyp", F.array_sort(F.array_distinct(hyp)))


def _shift(d: Column, b: Column) -> Column:
    return F.when(d <= "9", b).when(d.isin("a", "b"), b + 1).when(d.isin("c", "d"), b - 1)


def scores(docs: DataFrame) -> DataFrame:
    """Adds tp, n_ref, n_hyp, precision, recall, f1, window_diff, boundary_similarity."""
    out = docs.withColumns({"tp": S.hits("ref", "hyp"), "n_ref": F.size("ref"), "n_hyp": F.size("hyp"), "precision": S.precision("ref", "hyp"), "recall": S.recall("ref", "hyp")})
    return out.withColumns({"f1": S.f1("precision", "recall"), "window_diff": S.window_diff("ref", "hyp", "n"), "boundary_similarity": S.boundary_similarity("ref", "hyp", "n")})


def micro(scored: DataFrame, *by: str) -> DataFrame:
    """Pooled precision, recall and F1; each document's first token counts as found. No document gives zeros."""
    tp, ref, hyp = F.sum(F.col("tp") + 1), F.sum(F.col("n_ref") + 1), F.sum(F.col("n_hyp") + 1)
    p, r = F.coalesce(tp / hyp, F.lit(0.0)), F.coalesce(tp / ref, F.lit(0.0))
    return scored.groupBy(*by).agg(F.count("*").alias("n_docs"), p.alias("micro_precision"), r.alias("micro_recall")).withColumn("micro_f1", S.f1("micro_precision", "micro_recall"))


def masked(docs: DataFrame, test) -> DataFrame:
    """doc_id, n_tokens, masked_fraction: the share of tokens for which test holds, 0 without tokens."""
    w = S.words("text")
    return docs.select("doc_id", F.size(w).cast("long").alias("n_tokens"), F.coalesce(F.try_divide(F.size(F.filter(w, test)), F.size(w)), F.lit(0.0)).alias("masked_fraction"))


def truncated(docs: DataFrame, target: int) -> DataFrame:
    """doc_id, kept_segments, kept_tokens: whole segments while the tokens before one are fewer than the target."""
    ends = F.concat("ref", F.array("n"))
    first = F.filter(ends, lambda e: e >= target)
    last = F.when(F.size(first) > 0, F.array_min(first)).otherwise(F.col("n"))
    kept = let(last, lambda upto: F.filter(ends, lambda e: e <= upto))
    return docs.select("doc_id", F.size(kept).cast("long").alias("kept_segments"), last.cast("long").alias("kept_tokens"))


def offsets(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, ref, hyp) -> key, b, offset: each hypothesis boundary less the nearest reference one; the later one at a tie.

    Both sides are laid out in order, and the last reference boundary is carried along from either end.
    """
    side = lambda c, ref: F.transform(c, lambda b: F.struct(b.alias("b"), F.lit(ref).alias("is_ref")))
    long = docs.select(key, F.explode(F.concat(side("ref", True), side("hyp", False))).alias("x")).select(key, "x.b", F.when(F.col("x.is_ref"), F.col("x.b")).alias("r"))
    seen = lambda order: F.last("r", ignorenulls=True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = F.col("r").asc_nulls_last()
    long = long.withColumn("lo", seen([F.col("b"), last])).withColumn("hi", seen([F.col("b").desc(), last])).where("r is null")
    left, right = F.col("b") - F.col("lo"), F.col("b") - F.col("hi")
    return long.select(key, "b", F.when(F.col("lo").isNull() | (-right <= left), right).otherwise(left).alias("offset"))


def cut_to_segments(docs: DataFrame, target: int) -> DataFrame:
    """doc_id, w, starts: the words of the first whole segments that reach the target, and where those begin."""
    ends = F.concat("ref", F.array("n"))
    first = F.filter(ends, lambda e: e >= target)
    last = F.when(F.size(first) > 0, F.array_min(first)).otherwise(F.col("n"))
    inner = let(last, lambda upto: F.filter("ref", lambda b: b < upto))
    return docs.select("doc_id", F.slice("w", F.lit(1), last).alias("w"), F.concat(F.array(F.lit(1)), F.transform(inner, lambda b: b + 1)).alias("starts"))
