"""Text tests, codes and parsers as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A masked token of a shared corpus is underscores alone; driver tables stand in with runs of marks.
MASKED = r"^_+$"
MARKS = r"[#$%&*|]"
# Right-closed edges of offsets in ms.
EDGES = (0.001, 1, 5, 10, 20, 50, 100, 500)


def genre(doc_id: Column) -> Column:
    return F.split_part(doc_id, F.lit("_"), F.lit(2))


def tokens_estimate(text: Column) -> Column:
    return F.bround(F.length(text) / 4, 0).cast("long")


def rounded(x: Column | str, digits: int) -> Column:
    """As SQL engines round doubles: the product with a power of ten, half away from zero.

    Spark's own round goes by the shortest decimal form, and so takes some halves up whose product lies below.
    """
    power = 10.0**digits
    half = lambda v: F.round(v * power, 0) / power
    return let(F.col(x) if isinstance(x, str) else x, lambda v: F.when(v < 0, -half(-v)).otherwise(half(v)))


def bin_of(ms: Column) -> Column:
    """Label of the right-closed bin of an offset's size in ms."""
    out, low = None, "0"
    for e in EDGES:
        test, label = ms <= F.lit(float(e)), F.lit(f"({low},{e:g}]")
        out = F.when(test, label) if out is None else out.when(test, label)
        low = f"{e:g}"
    return out.otherwise(F.lit(f"({low},inf)"))


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def parse_starts(raw: Column) -> Column:
    """struct<starts array<int>, reason>: the JSON array between the first [ and the last ]; ints or quoted ints only."""

    def judged(body: Column, items: Column) -> Column:
        count = lambda c: F.length(body) - F.length(F.replace(body, F.lit(c), F.lit("")))
        whole = F.forall(items, lambda x: F.coalesce(x.rlike(r"^\s*[+-]?\d+\s*$"), F.lit(False)))
        broken = items.isNull() | (count("[") != count("]"))
        reason = F.when(body == "", F.lit("no array")).when(broken, F.lit("malformed")).when(~whole, F.lit("not an integer"))
        return let(reason, lambda why: F.struct(F.when(why.isNull(), F.transform(items, lambda x: F.trim(x).cast("int"))).alias("starts"), why.alias("reason")))

    return let(F.regexp_extract(raw, r"(?s)\[.*\]", 0), lambda body: let(F.from_json(body, "array<string>"), lambda items: judged(body, items)))


def position_class(idx: Column, n: Column) -> Column:
    """idx from 0."""
    return F.when(n == 1, "initial_and_final").when(idx == 0, "initial").when(idx == n - 1, "final").otherwise("internal")


def redact(text: Column) -> Column:
    """Mail addresses, telephone-like and long digit groups give way to a tag, in this order."""
    out = F.regexp_replace(text, r"(?i)[a-z0-9._-]+@[a-z0-9.-]+", "<mail>")
    out = F.regexp_replace(out, r"\+?[0-9]+ ?\([0-9]{3}\) [0-9]{3}-[0-9]{4}", "<phone>")
    return F.regexp_replace(out, r"[0-9]{6,}", "<digits>")


def letters_runs(text: Column) -> Column:
    """Words recounted without the tokens' rules: letters, apostrophes and hyphens, all else parting them."""
    return F.filter(F.split(F.regexp_replace(text, r"[^\p{L}'\-\s]", " "), r"\s+"), lambda x: x != "")


def encoding(raw: Column) -> Column:
    """Byte-order mark, then zero bytes, then ASCII, then strict UTF-8; null when none of these fits."""
    h = F.hex(raw)
    return (
        F.when(h.startswith("EFBBBF"), "utf-8-sig").when(h.startswith("FFFE") | h.startswith("FEFF"), "utf-16").when(h.rlike("^(..)*00"), None)
        .when(h.rlike("^([0-7].)*$"), "ascii").when(F.is_valid_utf8(raw), "utf-8")
    )
