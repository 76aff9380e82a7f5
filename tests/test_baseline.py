"""Boundaries and draws on compact arrays against the token table, plain hashing and the column functions."""

import hashlib
import random

import numpy as np
import pytest
from massline.operators import baseline as B
from massline.operators import transcripts as R
from massline.plans import catalogue
from pyspark.sql import functions as F

CONV = "conv_id long, turn int, role string, text string"


def odd_conversations():
    rng = random.Random(5)
    said = lambda k: "".join(rng.choice(["a", "b,", "c.", "¶", ",", "d.,"]) + rng.choice([" ", "\n", "\t ", " \n\n"]) for _ in range(k))
    rows = [(c, t, rng.choice(["user", "assistant", None]), said(rng.randint(0, 30))) for c in range(40) for t in range(rng.randint(1, 7))]
    rows += [(50, t, "user", None if t == 1 else "\n \n") for t in range(3)] + [(51, 0, "user", "one"), (52, 0, "user", "\none,\n"), (52, 1, "user", "two"), (52, 2, "user", "\nthree é.")]
    rows += [(None, 0, "user", "a b, c."), (None, 1, "user", "d"), (53, None, "user", "a, b"), (53, 2, "user", "c"), (54, 0, "user", said(1500)), (54, 1, "user", said(900))]
    # A turn's number twice: its rows take turns word by word.
    return rows + [(60, 1, "user", "a b, c."), (60, 1, "user", "d"), (60, 2, "user", "e f"), (61, 1, "user", ""), (61, 1, "user", "d e")]


def test_boundaries_are_those_of_the_token_table(spark):
    rows = odd_conversations()
    df = spark.createDataFrame(rows, CONV)
    key = lambda r: (r.conv_id is None, r.conv_id)
    want = sorted(R.arrays(R.tokens(df)).collect(), key=key)
    got = sorted(B.boundaries(df).collect(), key=key)
    of = lambda rs: [(r.conv_id, r.n, r.ref, r.turns, r.hyp) for r in rs]
    assert of(got) == of(want) and len(got) > 40


def test_no_exchange_or_sort_of_tokens(spark, tmp_path):
    """One exchange of rows of letters, no window over words: a task's memory follows its conversations' letters."""
    spark.createDataFrame(odd_conversations(), CONV).write.parquet(f"{tmp_path}/conversations.parquet")
    for name in ("a_vs_b_pivot", "verdict_vs_baseline", "file_max_legit_run", "degeneracy_old_new", "collapse_metrics", "random_baseline_summary_100", "random_baseline_draws_100", "random_baseline_100"):
        plan = catalogue.PLANS[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "Window [" not in plan and "posexplode(" not in plan, name


@pytest.mark.parametrize("prefix", ["20260918|5|", "20260918|-1234567|", "s|é|", "20260918|" + "z" * 60 + "|", ""])
def test_keys_are_the_digests_first_bits(prefix):
    gaps = np.array([1, 9, 10, 99, 100, 599, 1001, 12345, 1234567890])
    for draws in (range(0, 10), range(10, 13), range(100, 103)):
        got = B.keys(prefix, draws, gaps)
        assert [[f"{x:08x}" for x in r] for r in got.tolist()] == [[hashlib.md5(f"{prefix}{d}|{p}".encode()).hexdigest()[:8] for p in gaps] for d in draws]


@pytest.mark.parametrize("bits", [32, 3, 0])
def test_draws_are_the_first_by_their_whole_hash(monkeypatch, bits):
    """Also where the bits compared first leave ties, in small steps and with windows of all sizes."""
    keys = B.keys
    monkeypatch.setattr(B, "keys", lambda *a: keys(*a) >> (32 - bits) if bits else keys(*a) * 0)
    monkeypatch.setattr(B, "STEP", 300)
    monkeypatch.setattr(B, "CELLS", 900)
    rng = np.random.default_rng(2)
    for n, core in ((2, 60), (61, 60), (62, 60), (250, 60), (1100, 60)):
        ref = np.flatnonzero(rng.random(n) < 0.3)
        ref, turns = ref[ref > 0], np.flatnonzero(rng.random(n) < 0.05)
        turns = turns[turns > 0]
        free = [p for p in range(1, n) if p % core and p not in turns]
        got = [set(np.flatnonzero(f).tolist()) for _, flags in B.drawn("7", n, ref, turns, 13, 99, core) for f in flags]
        want = []
        for d in range(13 if free else 0):
            hashed = lambda p: (hashlib.md5(f"99|7|{d}|{p}".encode()).hexdigest(), p)  # noqa: B023, E731
            wins = [[p for p in free if p // core == w] for w in range(n // core + 1)]
            want.append({p for w in wins for p in sorted(w, key=hashed)[: sum(p in ref for p in w)]})
        assert got == want
    assert list(B.drawn("7", 3, np.array([1]), np.array([1, 2]), 13, 99, 60)) == []


def test_all_metrics_in_both_scopes(spark):
    conv = B.boundaries(spark.createDataFrame(odd_conversations(), CONV)).where("conv_id is not null").cache()
    hyp = B.draws_of(conv, 12, R.SEED, 30).groupBy("conv_id", "draw").agg(F.array_sort(F.collect_list(F.col("b").cast("int"))).alias("hyp"))
    every = B.scored(conv, 12, R.SEED, 30, full=True).where("random is not null")
    each = every.select("conv_id", "n", "ref", "turns", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("draw")).join(hyp, ["conv_id", "draw"], "left")
    each = each.withColumn("hyp", F.coalesce("hyp", F.array().cast("array<int>")))
    s = R.scores(R.scoped(each)).groupBy("conv_id", "scope").agg(*[g(m).alias(f"{m}_{k}") for m in B.METRICS for k, g in (("mean", F.avg), ("lo", F.min), ("hi", F.max))])
    want = {(r.conv_id, r.scope): r for r in s.collect()}
    got = {(r.conv_id, k): r.random[k] for r in every.collect() for k in ("within_turn", "all_boundaries")}
    assert set(got) == set(want) and len(got) > 60
    for k, r in got.items():
        for m in B.STATS.removeprefix("struct<").removesuffix(">").replace(":double", "").split(","):
            assert (r[m] is None) == (want[k][m] is None) and (r[m] is None or r[m] == pytest.approx(want[k][m], abs=1e-12)), (k, m)
    assert any(r["window_diff_mean"] is None for r in got.values()) and any(r["boundary_similarity_lo"] < 1 for r in got.values())
    conv.unpersist()
