"""Segment masses, boundaries and their metrics as column functions: each row is computed where it lies, without a shuffle.

Boundaries are sorted int arrays of positions b, the gap after token b, 1 <= b < n; masses are segment lengths.
Invalid input (a mass that isn't positive, a boundary outside, no token) gives null rather than a guess.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

Any = Column | str


def _c(x: Any) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(text: Any) -> Column:
    """Maximal runs without white space."""
    return F.regexp_extract_all(_c(text), F.lit(r"\S+"), F.lit(0))


def positions(items: Any, test) -> Column:
    """1-based positions of the items for which test(item) holds. The array is read once and no lambda looks back at it."""
    return F.filter(F.transform(_c(items), lambda x, i: F.when(test(x), i + 1)), lambda i: i.isNotNull())


def flags_to_masses(flags: Any) -> Column:
    """Start flags -> run lengths; null when the first flag isn't set."""
    f = _c(flags)
    starts = positions(f, lambda x: x)
    return F.when(F.size(f) == 0, F.array().cast("array<int>")).when(F.element_at(f, 1), differences(starts, F.size(f)))


def differences(starts: Any, n: Any) -> Column:
    """1-based starts, the first at 1 -> masses."""
    s = F.concat(_c(starts), F.array(_c(n) + 1))
    return F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda a, b: b - a)


def boundaries_to_masses(b: Any, n: Any) -> Column:
    b, n = _c(b), _c(n)
    ok = (n > 0) & let(n, lambda m: F.forall(b, lambda x: (x >= 1) & (x < m)))
    return F.when(ok, differences(F.concat(F.array(F.lit(1)), F.transform(b, lambda x: x + 1)), n))


#: Items of a block of a running sum, and how often blocks are made of blocks: arrays of STRIDE ** (LEVELS + 1) items, two
#: million, take a step in proportion to STRIDE for each item.
STRIDE, LEVELS = 128, 2


def running(values: Any, levels: int = LEVELS) -> Column:
    """Running sums of an array of whole numbers, as longs.

    An aggregate that grows an array copies it at every step. Here blocks are summed first, the running sums of those
    are found in the same way, and each item adds the items of its own block before it.
    """
    none = F.expr("cast(array() as array<bigint>)")
    add = lambda x, start: F.aggregate(x, start, lambda a, b: a + b)
    zero = F.lit(0).cast("long")

    def within(block, base):
        return F.transform(block, lambda x, i: add(F.slice(block, F.lit(1), i + 1), base))

    def whole(v):
        if not levels:
            return within(v, zero)
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / STRIDE).cast("int")), lambda i: F.slice(v, i * STRIDE + 1, F.lit(STRIDE)))
        return let(blocks, lambda each: let(running(F.transform(each, lambda x: add(x, zero)), levels - 1), lambda upto: F.flatten(F.transform(each, lambda x, i: within(x, F.when(i > 0, F.element_at(upto, F.greatest(i, F.lit(1)))).otherwise(zero))))))

    body = lambda v: F.when(F.size(v) > STRIDE, whole(v)).when(F.size(v) > 0, within(v, zero)).otherwise(none)
    return let(F.transform(_c(values), lambda x: x.cast("long")), body)


def masses_to_boundaries(masses: Any) -> Column:
    """Running sums without the last."""
    m = _c(masses)
    return F.transform(running(F.slice(m, 1, F.greatest(F.size(m) - 1, F.lit(0)))), lambda x: x.cast("int"))


def starts_to_masses(starts: Any, n: Any) -> Column:
    """1-based start indices of any order -> masses, the first token being one; null when one is outside."""
    s, n = _c(starts), _c(n)
    full = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(1)), s)))
    return F.when((n > 0) & let(n, lambda m: F.forall(s, lambda x: (x >= 1) & (x <= m))), differences(full, n))


def masses_to_starts(masses: Any) -> Column:
    return F.when(F.size(_c(masses)) > 0, F.concat(F.array(F.lit(1)), F.transform(masses_to_boundaries(masses), lambda x: x + 1))).otherwise(F.array().cast("array<int>"))


def hits(ref: Any, hyp: Any) -> Column:
    return F.size(F.array_intersect(_c(ref), _c(hyp)))


def precision(ref: Any, hyp: Any) -> Column:
    """Without a hypothesis boundary: 1 if there is none to find either, else 0."""
    r, h = _c(ref), _c(hyp)
    return F.when(F.size(h) == 0, (F.size(r) == 0).cast("double")).otherwise(hits(r, h) / F.size(h))


def recall(ref: Any, hyp: Any) -> Column:
    r, h = _c(ref), _c(hyp)
    return F.when(F.size(r) == 0, (F.size(h) == 0).cast("double")).otherwise(hits(r, h) / F.size(r))


def f1(p: Any, r: Any) -> Column:
    p, r = _c(p), _c(r)
    return F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


def window_size(ref: Any, n: Any) -> Column:
    """Half the mean reference mass, rounded half to even, at least 2."""
    return F.greatest(F.bround(_c(n) / (F.size(_c(ref)) + 1) / 2, 0).cast("int"), F.lit(2))


def window_diff(ref: Any, hyp: Any, n: Any, k: Any | None = None) -> Column:
    """Share of windows of k gaps whose boundary counts differ; null when no window fits.

    A boundary b is in the windows that start at b - k to b - 1, so the difference of counts is a step function of the
    start. Its steps, sorted, are swept once: the cost follows the boundaries and not the tokens or the window.
    """
    given = F.struct(_c(ref).alias("r"), _c(hyp).alias("h"), _c(n).alias("n"))
    return let(given, lambda x: let((window_size(x["r"], x["n"]) if k is None else _c(k)).cast("int"), lambda size: _swept(x["r"], x["h"], x["n"], size)))


def _swept(r: Column, h: Column, n: Column, k: Column) -> Column:
    top = n - k
    cut = lambda x: F.least(F.greatest(x, F.lit(0)), top)
    steps = lambda b, d: F.concat(F.transform(b, lambda x: F.struct(cut(x - k).alias("at"), F.lit(d).alias("d"))), F.transform(b, lambda x: F.struct(cut(x).alias("at"), F.lit(-d).alias("d"))))
    events = F.array_sort(F.concat(steps(r, 1), steps(h, -1)))
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("run"), F.lit(0).alias("bad"))
    step = lambda acc, x: F.struct(x["at"].alias("at"), (acc["run"] + x["d"]).alias("run"), (acc["bad"] + F.when(acc["run"] != 0, x["at"] - acc["at"]).otherwise(F.lit(0))).alias("bad"))
    return F.when(top > 0, F.aggregate(events, zero, step)["bad"] / top)


def boundary_similarity(ref: Any, hyp: Any, n: Any) -> Column:
    """Boundary Similarity with near misses one apart: each costs half, every other mismatch costs one."""
    r, h = _c(ref), _c(hyp)
    side = lambda b, s: F.transform(b, lambda x: F.struct(x.alias("at"), F.lit(s).alias("side")))
    odd = F.array_sort(F.concat(side(F.array_except(r, h), 0), side(F.array_except(h, r), 1)))
    zero = F.struct(F.lit(-9).alias("at"), F.lit(-1).alias("side"), F.lit(0).alias("pairs"))
    # A mismatch pairs with the one just before, if that is free and of the other side; a paired one is remembered as side -1.
    fits = lambda acc, x: (acc["side"] >= 0) & (x["at"] == acc["at"] + 1) & (x["side"] != acc["side"])
    step = lambda acc, x: F.struct(x["at"].alias("at"), F.when(fits(acc, x), F.lit(-1)).otherwise(x["side"]).alias("side"), (acc["pairs"] + fits(acc, x).cast("int")).alias("pairs"))
    pairs = F.aggregate(odd, zero, step)["pairs"]
    extra = F.size(odd) - 2 * pairs
    total = extra + pairs + hits(r, h)
    return F.when((_c(n) <= 1) | (total == 0), F.lit(1.0)).otherwise((total - extra - pairs * F.lit(0.5)) / total)


def longest_run(b: Any) -> Column:
    """struct<len, start, end> of the first longest run of consecutive positions; repeated positions count once."""
    zero = F.struct(F.lit(None).cast("int").alias("prev"), F.lit(None).cast("int").alias("from"), F.lit(0).alias("len"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))

    def step(acc, x):
        begin = F.when(acc["prev"] == x - 1, acc["from"]).otherwise(x)
        best = (x - begin + 1) > acc["len"]
        return F.struct(x.alias("prev"), begin.alias("from"), F.when(best, x - begin + 1).otherwise(acc["len"]).alias("len"), F.when(best, begin).otherwise(acc["start"]).alias("start"), F.when(best, x).otherwise(acc["end"]).alias("end"))

    return F.aggregate(F.array_sort(F.array_distinct(_c(b))), zero, step, lambda a: F.struct(a["len"].alias("len"), a["start"].alias("start"), a["end"].alias("end")))
