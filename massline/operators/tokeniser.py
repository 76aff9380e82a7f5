"""Words, cues and boundaries of a transcribed unit, by a table of 62 ordered patterns.

The text is first cut into marks by the table; marks without white space between them make a chain. A word never leaves
its chain, so each chain is read on its own: from the right once, to know what each mark can still reach, and then from
the left, building words.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Codes of tagged stretches, longest first.
CODES = "NONSENSE DRINKING HUMMING SMOKING ACCENT SHOUT FOOD SING READ YELL SIGH SLUR VOX MRC PAR YWN CRK CRY ACC WH HI BR FF PP WI L2 SM X P Q F L A W @ %".split()
_CODE = "|".join(map(re.escape, CODES))
_GUARD = rf"(?!(?:{_CODE})>)"

# Kind, name and pattern; at each place the first that fits wins. (?P<letter> marks what a compound reuses.
RULES = (
    ("cue", "pause_timed", r"\.\.\.\(\d+(?:\.\d+)?\)"),
    ("cue", "pause_long", r"\.\.\."),
    ("cue", "pause_short", r"\.\."),
    ("cue", "breath_in", r"\([hH]\)"),
    ("cue", "breath_out", r"\([hH][xX]\)"),
    ("cue", "latching", r"\(0\)"),
    ("compound", "glottal_breath", r"\(%(?P<letter>Hx?)\)"),
    ("compound", "breath_bracket_lengthening", r"\((?P<letter>Hx?)\[=\]\)"),
    ("compound", "breath_paren_lengthening", r"\((?P<letter>[hH][xX]?)=\)"),
    ("compound", "sbc015_breath_bracket_lengthening_named_exception", r"(?<=\[2)\(H\]=(?=2\])"),
    ("drop", "vocal_noise_caps", r"\([A-Za-z][A-Za-z0-9_.,\[\]= ]*\)"),
    ("drop", "sbc002_tsk_named_exception", r"\(TSK(?=\s\(H\)3\])"),
    ("drop", "sbc019_sniff_open_named_exception", r"\(SNIFF(?=\s\.\.\s\(Hx\)\s\(Hx\)=\))"),
    ("drop", "sbc019_sniff_close_named_exception", r"(?<=SNIFF\s\.\.\s\(Hx\)\s\(Hx\)=)\)"),
    ("drop", "sbc023_sniff_bracket_digit_named_exception", r"(?<=\[2)\(SNIFF(?=2\])"),
    ("drop", "empty_parens", r"\(\)"),
    ("drop", "yawn_named_exception", r"\(YAWN0"),
    ("drop", "research_comment", r"\(\([^()]*\)\)"),
    ("drop", "research_comment_named_exception", r"\(\(DOG_BARKING_BEGINS\)(?!\))"),
    ("drop", "stray_close_paren_named_exception", r"(?<=okay)\)(?=\])"),
    ("drop", "overlap_num_open", r"\[\d+"),
    ("drop", "overlap_num_close", r"\d+\]"),
    ("drop", "overlap_open", r"\["),
    ("drop", "overlap_close", r"\]"),
    ("drop", "double_angle_wrap", r"<<[A-Za-z][A-Za-z_\-]*>>"),
    ("drop", "double_angle_open", r"<<[A-Za-z][A-Za-z_\-]*"),
    ("drop", "double_angle_close", r"[A-Za-z][A-Za-z_\-]*>>"),
    ("drop", "at_sm_open_named_exception", r"<@SM(?=\s)"),
    ("drop", "at_sm_close_named_exception", r"(?<=\s)SM@(?=>)"),
    ("drop", "angle_wrap_code", rf"<(?:{_CODE})>"),
    ("drop", "angle_open_code", rf"<(?:{_CODE})"),
    ("drop", "angle_open_spaced_code", rf"<\s+(?:{_CODE})"),
    ("drop", "angle_close_code", rf"(?:{_CODE})>"),
    ("drop", "voxx_named_exception", r"VOX(?=X>)"),
    ("drop", "angle_stray_open", r"<"),
    ("drop", "angle_stray_close", r">"),
    ("compound", "sbc056_laughter_breath_named_exception", r"\(@Hx\)"),
    ("drop", "at_sign", r"@+"),
    ("drop", "plus_event_timing", r"\+"),
    ("drop", "jason_hash_digit_named_exception", r"#(?=5Jason)"),
    ("drop", "stacked_disguise_prefix_named_exception", r"\*(?=#[^\W\d_])"),
    ("drop", "star_trailing_named_exception", r"\*(?!\S)"),
    ("drop", "disguise_prefix", r"[~#*](?=[^\W\d_])"),
    ("drop", "lost_initial_letter", r"0(?:\.000000(?:[eE]\+00)?)?(?=[a-z-])"),
    ("drop", "overlap_leftover_digit", r"\d+"),
    ("boundary", "iu_truncation", r"-{2,}"),
    ("hyphen", "displaced_truncation", r"-(?!-)"),
    ("cue", "lengthening", r"="),
    ("cue", "accent_caret", r"\^"),
    ("cue", "accent_backtick", r"`"),
    ("cue", "booster_bang", r"!"),
    ("cue", "booster_semi", r";"),
    ("cue", "glottal", r"%"),
    ("cue", "pitch_backslash", r"\\"),
    ("drop", "word_gloss_suffix", r"_\(?/[^/]*/\)?"),
    ("boundary", "underscore_iu_truncation", r"_{2,}"),
    ("underscore", "underscore_truncation", r"_(?!_)"),
    ("drop", "bare_phonetic_gloss", r"/[^/]*/"),
    ("boundary", "period", r"\."),
    ("boundary", "comma", r","),
    ("boundary", "qmark", r"\?"),
    ("frag", "word", rf"'?(?:{_GUARD}[^\W\d_])+(?:['_-](?:{_GUARD}[^\W\d_])+)*(?:-(?!-)|')?"),
)

# The cues that a compound stands for, in order; None takes the breath's direction from the letter.
COMPOUNDS = {
    "glottal_breath": (("glottal", "%"), (None, "({})")),
    "breath_bracket_lengthening": ((None, "({}["), ("lengthening", "=])")),
    "breath_paren_lengthening": ((None, "({}"), ("lengthening", "=)")),
    "sbc015_breath_bracket_lengthening_named_exception": (("breath_in", "(H]"), ("lengthening", "=")),
    "sbc056_laughter_breath_named_exception": (("breath_out", "(Hx)"),),
}

_MASTER = re.compile("|".join(f"(?P<r{i}>{p.replace('?P<letter>', f'?P<x{i}>')})" for i, (_, _, p) in enumerate(RULES)))
ITEM = "struct<item:string,kind:string,text:string,raw:string,idx:int,n_fragments:int>"


class TokeniseError(ValueError):
    """A symbol that no pattern takes, or a hyphen or underscore where none may stand."""

    def __init__(self, text: str, at: int):
        super().__init__(f"U+{ord(text[at]):04X} at {at}")


@dataclass
class Mark:
    kind: str
    name: str
    raw: str
    at: int
    letter: str | None
    #: Whether only dropped marks part it from a word fragment, and only cues and dropped marks from a fragment or hyphen.
    meets_word: bool = False
    meets_joint: bool = False


@dataclass
class _Builder:
    items: list[dict] = field(default_factory=list)
    text: list[str] | None = None
    raw: list[str] = field(default_factory=list)
    words: int = 0

    def put(self, item: str, kind: str | None, raw: str) -> None:
        self.close()
        self.items.append({"item": item, "kind": kind, "text": None, "raw": raw, "idx": None, "n_fragments": None})

    def grow(self, piece: str, raw: str | None = None) -> None:
        if self.text is None:
            self.text = []
        self.text.append(piece)
        self.raw.append(piece if raw is None else raw)

    def close(self) -> None:
        if self.text is not None:
            self.items.append({"item": "word", "kind": None, "text": "".join(self.text), "raw": "".join(self.raw), "idx": self.words, "n_fragments": len(self.text)})
            self.words += 1
        self.text, self.raw = None, []


def chains(text: str) -> list[list[Mark]]:
    """Marks of a text, grouped by what stands without white space between, with what each one meets to its right."""
    out: list[list[Mark]] = []
    end = 0
    for m in _MASTER.finditer(text):
        gap = text[end : m.start()]
        if gap.strip():
            raise TokeniseError(text, end + len(gap) - len(gap.lstrip()))
        i = int(m.lastgroup[1:])
        mark = Mark(RULES[i][0], RULES[i][1], m[0], m.start(), m[f"x{i}"] if "?P<letter>" in RULES[i][2] else None)
        if gap or not out:
            out.append([])
        out[-1].append(mark)
        end = m.end()
    rest = text[end:]
    if rest.strip():
        raise TokeniseError(text, end + len(rest) - len(rest.lstrip()))
    for chain in out:
        for mark, after in zip(chain[-2::-1], chain[:0:-1]):
            mark.meets_word = after.kind == "frag" or after.kind == "drop" and after.meets_word
            mark.meets_joint = after.kind in ("frag", "hyphen") or after.kind in ("cue", "drop") and after.meets_joint
    return out


def tokenise(text: str, seen: Callable[[str, str], object] | None = None) -> list[dict]:
    """Items of a unit in order: words with their normal and raw forms, cues, boundaries. seen is told each cue's place."""
    b = _Builder()
    for chain in chains(text):
        before: Mark | None = None
        for mark in chain:
            open_ = b.text is not None
            if mark.kind == "frag":
                b.grow(mark.raw)
            elif mark.kind == "cue":
                if seen:
                    seen(mark.name, "word_internal" if open_ and mark.meets_joint else "word_final" if before else "standalone")
                if open_ and mark.meets_joint:
                    b.raw.append(mark.raw)
                else:
                    b.put("cue", mark.name, mark.raw)
            elif mark.kind == "boundary":
                b.put("boundary", mark.name, mark.raw)
            elif mark.kind == "compound":
                way = "breath_out" if (mark.letter or "").lower() == "hx" else "breath_in"
                for kind, raw in COMPOUNDS[mark.name]:
                    b.put("cue", kind or way, raw.format(mark.letter))
            elif mark.kind == "underscore":
                if before is None:
                    raise TokeniseError(text, mark.at)
                if open_:
                    b.grow("-")
                    b.close()
                else:
                    b.put("cue", mark.name, mark.raw)
            elif mark.kind == "hyphen":
                _hyphen(b, text, mark, before)
            before = mark
        b.close()
    return b.items


def _hyphen(b: _Builder, text: str, mark: Mark, before: Mark | None) -> None:
    """A single hyphen belongs to the word before it, starts the one after it, or stands alone.

    After a lengthening or glottal mark it ends the word that is open, or is a cue of its own. Dropped marks around it
    don't count. At the very start of a text, and right after anything else, it is an error.
    """
    open_ = b.text is not None
    if before is None:
        if mark.at == 0:
            raise TokeniseError(text, 0)
    elif before.name in ("lengthening", "glottal"):
        if not open_:
            b.put("cue", "displaced_truncation", "-")
            return
        b.grow("-")
        b.close()
        return
    elif before.kind != "drop":
        raise TokeniseError(text, mark.at)
    if open_ or mark.meets_word:
        b.grow("-")
        if not mark.meets_word:
            b.close()
    else:
        b.put("boundary", "isolated_hyphen", "-")


def attempt(text: str | None) -> dict:
    try:
        return {"items": tokenise(text or ""), "error": None}
    except TokeniseError as e:
        return {"items": None, "error": str(e)}


#: Letters of texts that are tokenised and handed on at a time: items as Python objects take a hundred times their room.
SLICE = 1 << 17


def _slices(batches: Iterator[pa.Array]) -> Iterator[list[str | None]]:
    """Texts of batches of any size, about SLICE letters at a time; a longer text comes alone."""
    for texts in batches:
        held: list[str | None] = []
        size = 0
        for t in texts:
            text = t.as_py()
            if held and size + len(text or "") > SLICE:
                yield held
                held, size = [], 0
            held.append(text)
            # A row without text counts too, so that no number of them makes a slice too long.
            size += 64 + len(text or "")
        yield held


def _attempts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """A slice at a time; a text that repeats in it is tokenised once."""
    kinds = {"string": pa.string(), "int": pa.int32()}
    item = pa.struct([(name, kinds[kind]) for name, kind in (x.split(":") for x in ITEM.removeprefix("struct<").removesuffix(">").split(","))])
    for rows in _slices(batches):
        found = {t: attempt(t) for t in dict.fromkeys(rows)}
        yield pa.array([found[t] for t in rows], pa.struct([("items", pa.list_(item)), ("error", pa.string())]))


def items(text: Column) -> Column:
    """struct<items, error> of each text, through one Arrow-batched function."""
    return F.arrow_udf(_attempts, f"struct<items:array<{ITEM}>,error:string>")(text)


# Plain marks of cues by the name of their rule.
PLAIN_MARKS = {"lengthening": "=", "glottal": "%", "booster_bang": "!"}


def mark_places(text: str | None) -> list[tuple[str, str]]:
    """(mark, place) of each plain mark: inside a word, at the end of what it is glued to, or standing alone."""
    out: list[tuple[str, str]] = []
    try:
        tokenise(text or "", lambda name, place: out.append((PLAIN_MARKS[name], place)) if name in PLAIN_MARKS else None)
    except TokeniseError:
        return []
    return out


def _places(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in _slices(batches):
        rows = [[{"mark": m, "place": p} for m, p in mark_places(t)] for t in texts]
        yield pa.array(rows, pa.list_(pa.struct([("mark", pa.string()), ("place", pa.string())])))


def places(text: Column) -> Column:
    """array<struct<mark, place>> of each text's plain marks; none for a text that can't be tokenised."""
    return F.arrow_udf(_places, "array<struct<mark:string,place:string>>")(text)


def words_only(items_: Column) -> Column:
    return F.filter(items_, lambda x: x["item"] == "word")


def rendered(items_: Column, with_cues: bool) -> Column:
    """Words in their normal form, or in their raw form with the cues between; boundaries never show."""
    shown = F.filter(items_, lambda x: x["item"].isin("word", "cue")) if with_cues else words_only(items_)
    return F.array_join(F.transform(shown, lambda x: x["raw"] if with_cues else x["text"]), " ")


def units(df: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(tokenised units with items, refused ones with error)."""
    done = df.withColumn("x", items(F.col(text)))
    return done.where("x.error is null").select(*df.columns, "x.items"), done.where("x.error is not null").select(*df.columns, "x.error")
