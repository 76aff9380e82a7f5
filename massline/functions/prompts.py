"""Prompts of a segmentation task, with the symbols of cues and their glossary, and answers held to a window."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, parse_starts

# The symbol of each kind of cue, whatever its own spelling was.
SYMBOLS = {
    "pause_short": "..", "pause_long": "...", "breath_in": "(H)", "breath_out": "(Hx)", "lengthening": "=", "glottal": "%", "booster_bang": "!", "displaced_truncation": "-",
    "underscore_truncation": "_", "latching": "(0)", "accent_caret": "^", "accent_backtick": "`", "booster_semi": ";", "pitch_backslash": "\\",
}
# What the symbols that occur stand for.
MEANINGS = {
    "...": "a long pause", "..": "a short pause", "(H)": "an in-breath", "(Hx)": "an out-breath", "=": "lengthening of the preceding sound", "%": "a glottal stop",
    "!": 'emphatic stress ("booster")', "-": "a truncation mark with no word attached", "_": "a truncation mark with no word attached (alternate written form)",
}

TASK = "The transcript below has one line for each turn, with every word behind its number. Give the numbers of the words that begin an intonation unit as a JSON array and nothing else."
GLOSSARY = "Symbols between and inside the words tell how they were spoken. They are no words and have no number:\n" + "\n".join(f"  {s:<5s} {m}" for s, m in MEANINGS.items())
FEW_HEAD = "Give the numbers of the tokens that begin an elementary discourse unit as a JSON array and nothing else. Each token stands on a line behind its number.\n\n"
FEW_TAIL = "Now the document:\n\n"


def sql(text: str) -> str:
    """A text inside a quoted SQL string."""
    return text.replace("'", "''")


def cue_symbol(kind: Column) -> Column:
    """The symbol of a kind of cue; a kind without one is an error when it is read, never a guess."""
    known = F.create_map(*[F.lit(x) for pair in SYMBOLS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, kind), F.raise_error(F.concat(F.lit("no symbol for cues of kind "), kind)))


def rendered(items: Column, first: Column, cues: bool) -> Column:
    """Tokenised items as "number:word" from a first number on, with raw forms and the cues' symbols between if asked for."""
    shown = F.filter(items, lambda x: x["item"].isin("word", "cue") if cues else x["item"] == "word")
    number = lambda i: F.size(F.filter(F.slice(shown, F.lit(1), i + 1), lambda y: y["item"] == "word"))
    word = lambda x: F.lower(x["raw"] if cues else x["text"])
    at = (lambda x, i: first + x["idx"]) if not cues else (lambda x, i: first + number(i) - 1)
    return F.array_join(F.transform(shown, lambda x, i: F.when(x["item"] == "word", F.concat(at(x, i).cast("string"), F.lit(":"), word(x))).otherwise(cue_symbol(x["kind"]))), " ")


def prompt(window: Column, condition: str) -> Column:
    return F.concat(F.lit(TASK + "\n"), F.lit(GLOSSARY + "\n" if condition == "B" else ""), window)


def numbered(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda x, i: F.concat((i + 1).cast("string"), F.lit("\t"), x)), "\n")


def examples(rows: list) -> str:
    """Worked examples, from rows with words and starts."""
    shown = ("\n".join(f"{i}\t{w}" for i, w in enumerate(r["w"], 1)) + f"\n\nStarts: {list(r['starts'])}\n\n" for r in rows)
    return "".join(f"Example {n}:\n{x}" for n, x in enumerate(shown, 1))


def few_shot(head: str, words: Column) -> Column:
    return F.concat(F.lit(FEW_HEAD + head + FEW_TAIL), numbered(words), F.lit("\n"))


def window_answer(raw: Column, lo: Column, hi: Column, turn_initial: Column) -> Column:
    """struct<status, reason, kept, dropped> of a window's raw answer: starts of turns go, a position outside fails it."""
    none = F.expr("cast(array() as array<int>)")

    def judged(x: Column) -> Column:
        starts = F.coalesce(x["starts"], none)
        dropped, kept = F.array_intersect(starts, turn_initial), F.array_except(starts, turn_initial)
        beyond = F.size(F.filter(kept, lambda i: ~i.between(lo, hi)))
        why = F.coalesce(x["reason"], F.when(beyond > 0, F.concat(F.lit("positions outside window ["), lo.cast("string"), F.lit(","), hi.cast("string"), F.lit("]"))))
        inside = F.filter(kept, lambda i: i.between(lo, hi))
        return let(why, lambda w: F.struct(F.when(w.isNull(), "ok").otherwise("fail").alias("status"), w.alias("reason"), inside.alias("kept"), dropped.alias("dropped")))

    return let(parse_starts(raw), judged)
