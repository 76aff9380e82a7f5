"""Transcripts as one long token table: turns, cues, segments, windows, baselines.

Everything is partitioned by conversation, so one exchange serves all windows and the aggregation that follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import segments as S

LINE = "¶"
CORE, MARGIN = 600, 100
DRAWS, SEED = 100, 20260918


def tokens(conversations: DataFrame) -> DataFrame:
    """conv_id, pos, n, word, role, turn_id, turn_pos, turn_n, cue, ref, turn_end.

    cue: a comma on the word before, or a line break between. Turns without words vanish; neighbours of one role are
    one turn. ref marks the last word of a segment, unless it is the last of the conversation; turn_end likewise.
    """
    items = F.filter(F.split(F.regexp_replace("text", "\n", f" {LINE} "), r"\s+"), lambda x: x != "")
    rows = conversations.select("conv_id", "turn", "role", items.alias("items")).where(F.exists("items", lambda x: x != LINE))
    by_turn = Window.partitionBy("conv_id").orderBy("turn")
    rows = rows.withColumn("changed", F.coalesce(F.lag("role").over(by_turn) != F.col("role"), F.lit(True)).cast("int"))
    rows = rows.withColumn("turn_id", F.sum("changed").over(by_turn).cast("int"))
    # Each word takes the item before it along, never the turn's whole array.
    shifted = F.slice(F.concat(F.array(F.lit("")), "items"), F.lit(1), F.size("items"))
    pairs = F.zip_with("items", shifted, lambda x, y: F.struct(x.alias("word"), (y == LINE).alias("line")))
    long = rows.select("conv_id", "turn", "turn_id", "role", F.posexplode(pairs).alias("i", "x")).select("conv_id", "turn", "turn_id", "role", "i", "x.word", "x.line").where(F.col("word") != LINE)
    w = Window.partitionBy("conv_id").orderBy("turn", "i")
    whole = Window.partitionBy("conv_id")
    in_turn = Window.partitionBy("conv_id", "turn_id").orderBy("turn", "i")
    long = long.withColumns({"pos": F.row_number().over(w), "n": F.count("*").over(whole).cast("int"), "turn_pos": F.row_number().over(in_turn), "turn_n": F.count("*").over(Window.partitionBy("conv_id", "turn_id")).cast("int"), "before": F.lag("word").over(w), "unit_end": ~F.lead("turn").over(w).eqNullSafe(F.col("turn"))})
    inner = F.col("pos") < F.col("n")
    cue = (F.col("turn_pos") > 1) & (F.col("line") | F.coalesce(F.col("before").endswith(","), F.lit(False)))
    return long.select(
        "conv_id", "pos", "n", "word", "role", "turn_id", "turn_pos", "turn_n", cue.alias("cue"),
        ((F.col("word").endswith(".") | F.col("unit_end")) & inner).alias("ref"), ((F.col("turn_pos") == F.col("turn_n")) & inner).alias("turn_end"),
    )


def _those(test: Column, value: Column | None = None) -> Column:
    return F.array_sort(F.collect_list(F.when(test, F.col("pos") if value is None else value)))


def arrays(toks: DataFrame) -> DataFrame:
    """One row per conversation: n, ref, turns and cue boundaries. The cue rule puts a boundary before a word with a cue."""
    return toks.groupBy("conv_id").agg(F.max("n").alias("n"), _those(F.col("ref")).alias("ref"), _those(F.col("turn_end")).alias("turns"), _those(F.col("cue"), F.col("pos") - 1).alias("hyp"))


def scoped(conv: DataFrame) -> DataFrame:
    """Both scopes of each conversation: turn boundaries added to both sides, or taken from both."""
    both = [
        F.struct(F.lit("all_boundaries").alias("scope"), F.array_sort(F.array_union("ref", "turns")).alias("r"), F.array_sort(F.array_union("hyp", "turns")).alias("h")),
        F.struct(F.lit("within_turn").alias("scope"), F.array_except("ref", "turns").alias("r"), F.array_except("hyp", "turns").alias("h")),
    ]
    keep = [c for c in conv.columns if c not in ("ref", "hyp", "turns")]
    return conv.select(*keep, F.explode(F.array(*both)).alias("x")).select(*keep, "x.scope", F.col("x.r").alias("ref"), F.col("x.h").alias("hyp"))


def scores(scoped_: DataFrame) -> DataFrame:
    r, h = F.size("ref"), F.size("hyp")
    out = scoped_.withColumns({"n_ref": r.cast("long"), "n_hyp": h.cast("long"), "precision": S.precision("ref", "hyp"), "recall": S.recall("ref", "hyp")})
    ratio = F.when((r == 0) & (h == 0), F.lit(1.0)).when(r > 0, h / r)
    return out.withColumns({"f1": S.f1("precision", "recall"), "window_diff": S.window_diff("ref", "hyp", "n"), "boundary_similarity": S.boundary_similarity("ref", "hyp", "n"), "ratio": ratio})


def regions(conv: DataFrame, core: int = CORE, margin: int = MARGIN) -> DataFrame:
    """(conv_id, n) -> its windows: score_start to score_end tile it, window_start to window_end add margins."""
    at = F.when(F.col("n") > 0, F.sequence(F.lit(1), F.greatest("n", F.lit(1)), F.lit(core)))
    rows = conv.select("conv_id", "n", F.posexplode(at).alias("win", "score_start")).withColumn("score_end", F.least(F.col("score_start") + core - 1, "n"))
    return rows.select("conv_id", "win", "score_start", "score_end", F.greatest(F.col("score_start") - margin, F.lit(1)).alias("window_start"), F.least(F.col("score_end") + margin, "n").alias("window_end"))


def owner(b: Column, core: int = CORE) -> Column:
    """Window that holds word b + 1."""
    return F.floor(b / core).cast("int")


def structure(units: DataFrame, doc: str = "doc_id", order: str = "unit", keep_cues: bool = False) -> DataFrame:
    """Tokenised units (doc, order, speaker, items) -> one row per unit with words: n_words, turn, start_i, ends_turn.

    Units without words are left out before turns are made, so they neither break a turn nor start one. Their cues go
    with them, or, with ``keep_cues``, to the next unit that has words.
    """
    n = F.size(F.filter("items", lambda x: x["item"] == "word"))
    w = Window.partitionBy(doc).orderBy(order)
    rows = units.withColumn("n_words", n)
    if keep_cues:
        # Cues of the empty units since the last one with words: a group is closed by each unit with words.
        rows = rows.withColumn("grp", F.sum((F.col("n_words") > 0).cast("int")).over(w) - (F.col("n_words") > 0).cast("int"))
        lost = rows.where("n_words = 0").groupBy(doc, "grp").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, "items"))), lambda x: F.filter(x["items"], lambda i: i["item"] == "cue"))).alias("lost"))
        rows = rows.where("n_words > 0").join(lost, [doc, "grp"], "left").withColumn("items", F.concat(F.coalesce("lost", F.slice("items", 1, 0)), "items")).drop("lost", "grp")
    rows = rows.where("n_words > 0").withColumn("changed", F.coalesce(F.lag("speaker").over(w) != F.col("speaker"), F.lit(True)))
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select(
        doc, order, "speaker", "items", "n_words", F.sum(F.col("changed").cast("int")).over(upto).alias("turn"), (F.sum("n_words").over(upto) - F.col("n_words") + 1).alias("start_i"),
        F.coalesce(F.lead("changed").over(w), F.lit(False)).alias("ends_turn"),
    )
