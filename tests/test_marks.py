"""Marks, prompts, answers, quantiles and very long turns on small tables."""

import random
import statistics

import pytest
from massline.functions import prompts as P
from massline.operators import align as A
from massline.operators import markers, quantiles, tokeniser
from massline.operators import transcripts as R
from pyspark.sql import functions as F


@pytest.mark.parametrize("text,places", [("ho=me", [("=", "word_internal")]), ("so= then", [("=", "word_final")]), ("! Ron", [("!", "standalone")]), ("!Ron", [("!", "standalone")]), ("wh%at so% %", [("%", "word_internal"), ("%", "word_final"), ("%", "standalone")]), ("(H=) no", []), (None, [])])
def test_mark_places(spark, text, places):
    assert tokeniser.mark_places(text) == places
    assert [tuple(x) for x in spark.createDataFrame([(text,)], "t string").select(tokeniser.places(F.col("t"))).first()[0]] == places


@pytest.mark.parametrize("text,found", [
    ("(H) so .. we (Hx)", [("BREATH_IN", "2", "before_first_word"), ("PAUSE_SHORT", "2", "between_words"), ("BREATH_OUT", "2", "after_last_word")]),
    ("((DOOR)) (COUGH)", [("RESEARCH_COMMENT", "1", "iu_has_no_words"), ("VOCAL_NOISE_CAPS", "1", "iu_has_no_words")]),
    ("[2well2] don't-- XX ...(1.5)", [("OVERLAP_NUM_OPEN", "1", "before_first_word"), ("OVERLAP_NUM_CLOSE", "1", "between_words"), ("IU_TRUNCATION", "2", "between_words"), ("PAUSE_TIMED", "2", "after_last_word")]),
    ("y- kids' <@ a @> &", [("ANGLE_OPEN", "1", "between_words"), ("ANGLE_CLOSE", "1", "after_last_word"), ("OTHER", "?", "after_last_word")]), ("", []), (None, []),
])
def test_marker_scan(text, found):
    assert [(m["cls"], m["tier"], m["place"]) for m in markers.scan(text)] == found


def test_prompts(spark):
    items = spark.createDataFrame([("so= ho=me (H) yes.",)], "t string").select(tokeniser.items(F.col("t"))["items"].alias("i"))
    a, b = items.select(P.rendered(F.col("i"), F.lit(7), False), P.rendered(F.col("i"), F.lit(7), True)).first()
    assert (a, b) == ("7:so 8:home 9:yes", "7:so = 8:ho=me (H) 9:yes")
    assert set(P.MEANINGS) <= set(P.SYMBOLS.values()) and all(s in P.GLOSSARY for s in P.MEANINGS)
    df = spark.createDataFrame([("pause_long",), ("pause_timed",)], "k string")
    assert df.where("k = 'pause_long'").select(P.cue_symbol(F.col("k"))).first()[0] == "..."
    with pytest.raises(Exception, match="no symbol for cues of kind pause_timed"):
        df.select(P.cue_symbol(F.col("k"))).collect()
    assert P.GLOSSARY in spark.range(1).select(P.prompt(F.lit("x"), "B")).first()[0] and P.GLOSSARY not in spark.range(1).select(P.prompt(F.lit("x"), "A")).first()[0]


def test_window_answers(spark):
    rows = [("[3, 5, 9]", "ok", [5, 9], [3]), ("[3, 40]", "fail", [], [3]), ("none", "fail", [], []), ("[]", "ok", [], []), ("[1.5]", "fail", [], [])]
    df = spark.createDataFrame([(r[0],) for r in rows], "raw string")
    got = df.select("raw", P.window_answer(F.col("raw"), F.lit(2), F.lit(20), F.array(F.lit(3))).alias("a")).collect()
    assert [(r.raw, r.a.status, r.a.kept, r.a.dropped) for r in got] == rows
    assert [bool(r.a.reason) for r in got] == [r[1] == "fail" for r in rows]


def test_quantiles(spark):
    rng = random.Random(4)
    data = [(k, float(rng.choice([rng.randrange(5), rng.gauss(0, 10)]))) for k, n in (("a", 900), ("b", 2), ("c", 1), ("d", 57)) for _ in range(n)] + [("b", None)]
    got = quantiles.quantiles(spark.createDataFrame(data, "k string, x double"), "k", "x", {"lo": 0.0, "q1": 0.25, "md": 0.5, "q3": 0.75, "hi": 1.0}, ranges=16).collect()
    assert len(got) == 4
    for r in got:
        v = sorted(x for k, x in data if k == r.k and x is not None)
        q = statistics.quantiles(v, n=4, method="inclusive") if len(v) > 1 else v * 3
        assert [r.lo, r.q1, r.md, r.q3, r.hi] == pytest.approx([v[0], *q, v[-1]])


def test_places_in_a_tier(spark):
    tier = spark.createDataFrame([("s", 0.0, 10.0, False), ("s", 10.0, 20.0, True), ("s", 30.0, 40.0, False)], "k string, xmin double, xmax double, pause boolean")
    points = spark.createDataFrame([("s", t) for t in (0.0, 4.0, 13.0, 20.0, 25.0, 31.0, 41.0, -2.0)] + [("none", 1.0)], "k string, t double")
    got = {(r.k, r.t): (r.place, r.ms) for r in A.locate_in_tier(points, tier, "k").collect()}
    assert got == {("s", 0.0): ("exact", 0.0), ("s", 4.0): ("in_word", 4.0), ("s", 13.0): ("in_pause", 3.0), ("s", 20.0): ("exact", 0.0), ("s", 25.0): ("in_gap", 5.0), ("s", 31.0): ("in_word", 1.0), ("s", 41.0): ("outside", 1.0), ("s", -2.0): ("outside", -2.0), ("none", 1.0): ("outside", None)}


def test_a_turn_of_many_words(spark):
    """No row carries its turn's words, so that one long turn fits beside the others."""
    words = " ".join(f"w{i}." if i % 9 == 0 else f"w{i}" for i in range(200_000))
    c = spark.createDataFrame([(1, 0, "a", words), (1, 1, "b", "yes, well\nno")], "conv_id long, turn long, role string, text string")
    t = R.tokens(c)
    assert t.count() == 200_003 and t.where("ref").count() == 22_223 + 1
    assert [(r.word, r.cue) for r in t.where("role = 'b'").orderBy("pos").collect()] == [("yes,", False), ("well", True), ("no", True)]
