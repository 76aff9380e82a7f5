"""Golden cases of the unit tokeniser: words, cues, boundaries, errors."""

import pytest
from massline.operators import tokeniser as K
from pyspark.sql import functions as F

# raw, words, cues or None, boundaries or None
CASES = [
    ("<@<HI well yeah @> HI>", "well yeah", None, None),
    ("[2 right 2]", "right", None, None),
    ("...(1.2)", "", "pause_timed", None),
    ("(H) next to (TSK)", "next to", "breath_in", None),
    ("s=o", "so", "", None),
    ("b==itch", "bitch", "", None),
    ("s=%o", "so", "", None),
    ("fa=]st?", "fast", "", "qmark"),
    ("[2u=2]m,", "um", "", "comma"),
    ("word=[", "word", "lengthening", None),
    ("twenty-two", "twenty-two", None, None),
    ("y-", "y-", None, None),
    ("yeah@", "yeah", None, None),
    ("and you're--", "and you're", None, "iu_truncation"),
    ("I want---", "I want", None, "iu_truncation"),
    ("(H=) word", "word", "breath_in lengthening", None),
    ("(@Hx) word", "word", "breath_out", None),
    ("~Mae was here", "Mae was here", None, None),
    ("*#Vodnoy,", "Vodnoy", None, "comma"),
    ("<<SNAP just SNAP>> like that", "just like that", None, None),
    ("good_/god/ was said", "good was said", None, None),
    ("[third]-graders are here", "third-graders are here", None, None),
    ("eighty .. -three", "eighty -three", "pause_short", None),
    ("Fitz- uh -gerald,", "Fitz- uh -gerald", None, "comma"),
    ("hello - there", "hello there", None, "isolated_hyphen"),
    ("some t_ thing", "some t- thing", None, None),
    ("%_you know,", "you know", "glottal underscore_truncation", "comma"),
    ("0.000000e+00verything was great", "verything was great", None, None),
    ("[Look okay)].", "Look okay", None, "period"),
    ("[<X You knowX>].", "You know", None, "period"),
    ("(%Hx) word", "word", "glottal breath_out", None),
    ("li[2ke2] it", "like it", None, None),
    ("b=-", "b-", "", None),
    ("", "", "", ""),
]


@pytest.mark.parametrize("raw,words,cues,boundaries", CASES)
def test_golden(raw, words, cues, boundaries):
    items = K.tokenise(raw)
    assert [x["text"] for x in items if x["item"] == "word"] == words.split()
    assert [x["idx"] for x in items if x["item"] == "word"] == list(range(len(words.split())))
    for want, kind in ((cues, "cue"), (boundaries, "boundary")):
        if want is not None:
            assert [x["kind"] for x in items if x["item"] == kind] == want.split()


@pytest.mark.parametrize("raw", ["(@H) word", "[Look fine)].", "what§", "-start", "_x", "so!-"])
def test_errors(raw):
    with pytest.raises(K.TokeniseError):
        K.tokenise(raw)


def test_frame(spark):
    df = spark.createDataFrame([(1, "s=o (H) [yes]."), (2, "what§"), (3, None)], "id int, text string")
    good, bad = K.units(df)
    got = {r.id: (r.a, r.b) for r in good.select("id", K.rendered(F.col("items"), False).alias("a"), K.rendered(F.col("items"), True).alias("b")).collect()}
    assert got == {1: ("so yes", "s=o (H) yes"), 3: ("", "")}
    assert [(r.id, r.error) for r in bad.collect()] == [(2, "U+00A7 at 4")]
    assert len(K.RULES) == 62


def test_structure(spark):
    from massline.operators import transcripts as R

    rows = [(1, 1, "A", "one two"), (1, 2, "A", "three"), (1, 3, "B", "(H)"), (1, 4, "B", "four five six"), (1, 5, "A", "(H)"), (1, 6, "B", ".. .."), (1, 7, "A", "seven")]
    df = spark.createDataFrame(rows, "doc_id int, unit int, speaker string, text string")
    units, _ = K.units(df)
    got = R.structure(units).orderBy("unit").collect()
    assert [(r.unit, r.n_words, r.turn, r.start_i, r.ends_turn) for r in got] == [(1, 2, 1, 1, False), (2, 1, 1, 3, True), (4, 3, 2, 4, True), (7, 1, 3, 7, False)]
    kept = R.structure(units, keep_cues=True).orderBy("unit").collect()
    assert [[i.kind for i in r["items"] if i.item == "cue"] for r in kept] == [[], [], ["breath_in"], ["breath_in", "pause_short", "pause_short"]]
