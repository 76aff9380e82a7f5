"""The queries named _100 against plain Python: all draws of the reference, on a small table."""

import hashlib
import random

import pytest
from massline.operators import transcripts as R
from massline.plans import catalogue

DRAWS = 100  # N_RANDOM_DRAWS of the reference


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    rng = random.Random(3)
    said = lambda: " ".join(rng.choice(["a", "b,", "c.", "d", "e"]) for _ in range(rng.randint(1, 40)))
    rows = [(c, t, "user" if t % 2 else "assistant", said()) for c in range(4) for t in range(4)]
    rows += [(4, t, "user" if t % 2 else "assistant", " ".join(rng.choice(["a", "b,", "c."]) for _ in range(350))) for t in range(2)]
    rows.append((5, 0, "user", "one"))
    at = tmp_path_factory.mktemp("small")
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{at}/conversations.parquet")
    return str(at)


@pytest.fixture(scope="module")
def plain(spark, small):
    """conv_id -> (f1 of the cue rule, sets drawn, f1 of each draw)."""
    by = {}
    for r in R.tokens(spark.read.parquet(f"{small}/conversations.parquet")).collect():
        by.setdefault(r.conv_id, []).append(r)
    out = {}
    for c, toks in by.items():
        ends = {r.pos for r in toks if r.turn_end}
        ref, cue = {r.pos for r in toks if r.ref} - ends, {r.pos - 1 for r in toks if r.cue} - ends
        wins = {}
        for r in toks:
            if r.pos % R.CORE and r.pos < r.n and not r.turn_end:
                wins.setdefault(r.pos // R.CORE, []).append(r.pos)
        drawn = []
        for d in range(DRAWS if wins else 0):
            hashed = lambda p: (hashlib.md5(f"{R.SEED}|{c}|{d}|{p}".encode()).hexdigest(), p)  # noqa: B023, E731
            drawn.append({p for w in wins.values() for p in sorted(w, key=hashed)[: sum(x in ref for x in w)]})

        def f1(hyp):
            p = len(hyp & ref) / len(hyp) if hyp else float(not ref)  # noqa: B023
            q = len(hyp & ref) / len(ref) if ref else float(not hyp)  # noqa: B023
            return 2 * p * q / (p + q) if p + q else 0.0

        out[c] = (f1(cue), drawn, [f1(x) for x in drawn])
    return out


def test_all_draws_are_returned(spark, small, plain):
    got = {(r.conv_id, r.draw, r.b) for r in catalogue.PLANS["random_baseline_draws_100"](spark, small).collect()}
    assert got == {(c, d, b) for c, (_, drawn, _) in plain.items() for d, x in enumerate(drawn) for b in x}


def test_summary_is_over_all_draws(spark, small, plain):
    got = {r.conv_id: r for r in catalogue.PLANS["random_baseline_summary_100"](spark, small).collect()}
    assert set(got) == {c for c, x in plain.items() if x[2]}
    for c, r in got.items():
        f = plain[c][2]
        assert r.draws == DRAWS and (r.f1_mean, r.f1_lo, r.f1_hi) == pytest.approx((sum(f) / DRAWS, min(f), max(f)), abs=1e-6)
    assert any(max(x[2][:20]) < max(x[2]) for x in plain.values() if x[2])  # a fifth of the draws would not do


def test_pivot_and_verdict_are_over_all_draws(spark, small, plain):
    got = {r.conv_id: r for r in catalogue.PLANS["a_vs_b_pivot_100"](spark, small).collect()}
    want = {"n/a": 0, "beats": 0, "loses to": 0}
    assert set(got) == set(plain)
    for c, (a, _, f) in plain.items():
        assert got[c].a_f1 == pytest.approx(a, abs=1e-6)
        if f:
            assert (got[c].b_f1, got[c].b_f1_max) == pytest.approx((sum(f) / DRAWS, max(f)), abs=1e-6)
            assert got[c].a_above_b_max == (a > max(f))
        else:
            assert got[c].b_f1 is None and got[c].a_above_b_max is None
        want["n/a" if not f else "beats" if round(a, 9) > round(sum(f) / DRAWS, 9) else "loses to"] += 1
    assert {r.verdict: r.n for r in catalogue.PLANS["verdict_vs_baseline_100"](spark, small).collect()} == {k: n for k, n in want.items() if n}
