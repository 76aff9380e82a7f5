"""Marks of a transcript by class and place: a scan of its own, that knows nothing of the tokeniser's rules."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Class, tier and pattern of each mark; at each place the first that fits wins. Words have no tier.
MARKS = (
    ("RESEARCH_COMMENT", "1", r"\(\([^()]*\)*"),
    ("BREATH_IN", "2", r"\(H\)"),
    ("BREATH_OUT", "2", r"\(Hx\)"),
    ("LATCHING", "2", r"\(0\)"),
    ("VOCAL_NOISE_CAPS", "1", r"\([A-Z][A-Z0-9_., ]*\)"),
    ("DOUBLE_ANGLE_OPEN", "?", r"<<[A-Za-z]+"),
    ("DOUBLE_ANGLE_CLOSE", "?", r"[A-Za-z]+>>"),
    ("ANGLE_OPEN", "1", r"<[A-Za-z0-9@]+"),
    ("ANGLE_CLOSE", "1", r"[A-Za-z0-9@]+>"),
    ("OVERLAP_NUM_OPEN", "1", r"\[\d+"),
    ("OVERLAP_NUM_CLOSE", "1", r"\d+\]"),
    ("OVERLAP_OPEN", "1", r"\["),
    ("OVERLAP_CLOSE", "1", r"\]"),
    ("AT_SIGN", "1", r"@+"),
    ("PAUSE_TIMED", "2", r"\.\.\.\(\d+(?:\.\d+)?\)"),
    ("PAUSE_LONG", "2", r"\.\.\."),
    ("PAUSE_SHORT", "2", r"\.\."),
    ("IU_TRUNCATION", "2", r"--"),
    ("LENGTHENING", "2", r"="),
    ("ACCENT_CARET", "2", r"\^"),
    ("ACCENT_BACKTICK", "2", r"`"),
    ("BOOSTER_BANG", "2", r"!"),
    ("BOOSTER_SEMI", "2", r";"),
    ("GLOTTAL", "2", r"%"),
    ("PITCH_BACKSLASH", "2", r"\\"),
    ("PITCH_SLASH", "2", r"/"),
    ("PITCH_UNDERSCORE", "2", r"_"),
    ("PERIOD", "none (continuity)", r"\."),
    ("COMMA", "none (continuity)", r","),
    ("QMARK", "none (continuity)", r"\?"),
    ("INDECIPHERABLE_X", None, r"\bX+\b"),
    ("WORD", None, r"[^\W\d_]+(?:['-][^\W\d_]+)*(?:-(?!-)|')?"),
    ("OTHER", "?", r"\S"),
)
_SCAN = re.compile("|".join(f"({pattern})" for _, _, pattern in MARKS))


def scan(text: str | None) -> list[dict]:
    """Each mark of a text with its class, tier and place among the words: before, between or after them, or without any."""
    found = [(MARKS[m.lastindex - 1], m) for m in _SCAN.finditer(text or "")]
    words = [m.span() for (_, tier, _), m in found if tier is None]

    def place(m: re.Match) -> str:
        if not words:
            return "iu_has_no_words"
        return "before_first_word" if m.end() <= words[0][0] else "after_last_word" if m.start() >= words[-1][1] else "between_words"

    return [{"cls": cls, "tier": tier, "place": place(m), "raw": m[0]} for (cls, tier, _), m in found if tier is not None]


def _scanned(texts: pa.Array) -> pa.Array:
    return pa.array([scan(t) for t in texts.to_pylist()], pa.list_(pa.struct([(n, pa.string()) for n in ("cls", "tier", "place", "raw")])))


def marks(text: Column) -> Column:
    """array<struct<cls, tier, place, raw>> of each text's marks."""
    return F.arrow_udf(_scanned, "array<struct<cls:string,tier:string,place:string,raw:string>>")(text)
