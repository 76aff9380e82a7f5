"""Segment functions against hand-derived values and plain definitions."""

import random
from itertools import accumulate

import pytest
from massline.functions import segments as S
from massline.functions import text as T
from massline.operators import documents as D
from pyspark.sql import functions as F

REF = [3, 4, 3, 5, 2, 6, 1, 4, 3, 5]


def bounds(m):
    out, at = [], 0
    for x in m[:-1]:
        at += x
        out.append(at)
    return out


def plain_window_diff(r, h, n):
    k = max(2, round(n / (len(r) + 1) / 2))
    if n - k <= 0:
        return None
    count = lambda b, s: sum(s <= x < s + k for x in b)
    return sum(count(r, s) != count(h, s) for s in range(1, n - k + 1)) / (n - k)


def plain_similarity(r, h, n):
    r, h = set(r), set(h)
    odd, used, pairs = r ^ h, set(), 0
    for i in range(1, n - 1):
        a, b = i, i + 1
        if {a, b} <= odd and not {a, b} & used and len({a, b} & r) == 1 and len({a, b} & h) == 1:
            used |= {a, b}
            pairs += 1
    extra = len(odd) - 2 * pairs
    total = extra + pairs + len(r & h)
    return 1.0 if n <= 1 or not total else (total - extra - pairs / 2) / total


def one(spark, col, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'array<boolean>' if v and isinstance(v[0], bool) else 'array<int>'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(col).first()[0]


@pytest.mark.parametrize("flags,masses", [("TFFTFFFTFF", [3, 4, 3]), ("TFFF", [4]), ("TTTT", [1, 1, 1, 1]), ("T", [1]), ("", []), ("FT", None)])
def test_flags(spark, flags, masses):
    got = spark.createDataFrame([([c == "T" for c in flags],)], "f array<boolean>").select(S.flags_to_masses("f")).first()[0]
    assert got == masses
    if masses:
        assert one(spark, S.masses_to_boundaries("m"), m=masses) == bounds(masses)


def test_boundaries(spark):
    assert one(spark, S.boundaries_to_masses("b", "n"), b=[3, 7], n=10) == [3, 4, 3]
    assert one(spark, S.boundaries_to_masses("b", "n"), b=[], n=5) == [5]
    for b, n in (([0, 3], 10), ([3, 10], 10), ([], 0)):
        assert one(spark, S.boundaries_to_masses("b", "n"), b=b, n=n) is None
    assert one(spark, S.starts_to_masses("s", "n"), s=[4, 8, 4], n=10) == [3, 4, 3]
    assert one(spark, S.starts_to_masses("s", "n"), s=[11], n=10) is None
    assert one(spark, S.masses_to_starts("m"), m=[3, 4, 3]) == [1, 4, 8]


@pytest.mark.parametrize("change,p,r,bs", [(lambda b: b, 1, 1, 1), (lambda b: [4, *b[1:]], 8 / 9, 8 / 9, 8.5 / 9), (lambda b: [x for x in b if x != 7], 1, 8 / 9, 8 / 9), (lambda b: [1, *b], 9 / 10, 1, 9 / 10)])
def test_damage(spark, change, p, r, bs):
    ref = bounds(REF)
    got = spark.createDataFrame([(ref, change(ref), 36)], "r array<int>, h array<int>, n int").select(S.precision("r", "h"), S.recall("r", "h"), S.boundary_similarity("r", "h", "n"), S.window_diff("r", "h", "n")).first()
    assert got[:3] == pytest.approx((p, r, bs)) and got[3] == pytest.approx(plain_window_diff(ref, change(ref), 36))


def test_random_pairs(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(400):
        n = rng.randint(1, 40)
        make = lambda d: [b for b in range(1, n) if rng.random() < d]  # noqa: E731, B023
        rows.append((make(rng.random()), make(rng.random()), n))
    df = spark.createDataFrame(rows, "r array<int>, h array<int>, n int")
    for x in df.select("*", S.window_diff("r", "h", "n").alias("wd"), S.boundary_similarity("r", "h", "n").alias("bs"), S.boundaries_to_masses("r", "n").alias("m")).collect():
        want = plain_window_diff(x.r, x.h, x.n)
        assert (x.wd is None) == (want is None) and (want is None or x.wd == pytest.approx(want))
        assert x.bs == pytest.approx(plain_similarity(x.r, x.h, x.n))
        assert sum(x.m) == x.n and bounds(x.m) == x.r


def test_runs_and_offsets(spark):
    assert tuple(one(spark, S.longest_run("b"), b=[3, 4, 5, 10, 11, 12])) == (3, 3, 5)
    assert tuple(one(spark, S.longest_run("b"), b=[])) == (0, None, None)


def test_offsets(spark):
    rng = random.Random(5)
    data = [(i, sorted(rng.sample(range(1, 60), rng.randint(1, 12))), sorted(rng.sample(range(1, 60), rng.randint(0, 12)))) for i in range(40)] + [(99, [], [4, 7])]
    got = D.offsets(spark.createDataFrame(data, "doc_id int, ref array<int>, hyp array<int>")).collect()
    want = {(i, b): min((abs(b - r), b - r) for r in ref)[1] if ref else None for i, ref, hyp in data for b in hyp}
    assert {(r.doc_id, r.b): r.offset for r in got} == want and want[99, 4] is None


def test_running_sums(spark):
    rng = random.Random(7)
    data = [([rng.randrange(9) for _ in range(n)],) for n in (0, 1, 31, 32, 33, 1024, 1025, 40_000)]
    for v, got in spark.createDataFrame(data, "v array<int>").select("v", S.running("v")).collect():
        assert got == list(accumulate(v))
    m = [rng.randint(1, 5) for _ in range(3000)]
    assert one(spark, S.masses_to_boundaries("m"), m=m) == list(accumulate(m))[:-1]


@pytest.mark.parametrize("raw,starts,reason", [("[1, 2]", [1, 2], None), ("so [3,\n4] then", [3, 4], None), ("[]", [], None), ("none", None, "no array"), ('["7", 8]', [7, 8], None), ("[1.5]", None, "not an integer"), ("[true]", None, "not an integer"), ('["x"]', None, "not an integer"), ("[1, 2", None, "no array"), ("[1, [2]", None, "malformed")])
def test_responses(spark, raw, starts, reason):
    got = spark.createDataFrame([(raw,)], "raw string").select(T.parse_starts(F.col("raw"))).first()[0]
    assert (got.starts, got.reason) == (starts, reason)
