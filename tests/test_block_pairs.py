"""Pairs of users met in blocks, against plain counting."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia import catalog
from evidentia.functions import stats
from evidentia.kernels.chance import poisson_tails
from evidentia.operators import events, pairs

HOUR = 3_600_000_000


@pytest.mark.parametrize("name", ["co_occurrence", "co_movement", "co_moving_users"])
def test_no_pair_is_shuffled(spark, sf, capsys, name):
    """What is written between tasks are users by blocks, never meetings of two users."""
    catalog.QUERIES[name](spark, sf).explain("simple")
    plan = capsys.readouterr().out
    assert "hashpartitioning(who_a" not in plan and "hashpartitioning(who#" not in "".join(x for x in plan.splitlines() if "who_b" in x)
    assert "hashpartitioning(_x" in plan


def test_bins_together(spark):
    rng = random.Random(1)
    seen = {(f"u{rng.randrange(40)}", rng.randrange(30)) for _ in range(500)}
    rows = [(w, b * HOUR + rng.randrange(HOUR)) for w, b in seen for _ in range(2)] + [(None, 5), ("u1", None)]
    got = {(r[0], r[1]): r for r in events.co_occurrence(spark.createDataFrame(rows, "who string, us long"), HOUR, 3).collect()}
    bins = {}
    for w, b in seen:
        bins.setdefault(w, set()).add(b)
    every = [b for _, b in seen]
    span = max(every) - min(every) + 1
    want = {(v, w): len(bins[v] & bins[w]) for v in bins for w in bins if v < w and len(bins[v] & bins[w]) >= 3}
    assert {k: r.together for k, r in got.items()} == want
    for (v, w), r in got.items():
        assert abs(r.lift - r.together * span / len(bins[v]) / len(bins[w])) < 1e-9


def test_tails_of_both_kinds(spark):
    """The chances that tasks compute are those of the column."""
    rows = [(n, m) for n in (0, 1, 2, 5, 9, 40, 400) for m in (0.0, 1e-4, 0.5, 3.0, 41.0, 390.0)]
    got = spark.createDataFrame(rows, "n long, m double").select("n", "m", stats.poisson_tail(F.col("n"), F.col("m")).alias("p")).collect()
    own = poisson_tails(np.array([r.n for r in got]), np.array([r.m for r in got]))
    assert np.allclose([r.p for r in got], own, rtol=1e-9, atol=1e-12)


def test_meetings_in_parts(monkeypatch):
    monkeypatch.setattr(pairs, "AT_ONCE", 5)
    rng = np.random.default_rng(2)
    times, others = rng.integers(0, 100, 50), np.sort(rng.integers(0, 100, 60))
    got = [(i, j) for a, b in pairs._meetings(times, others, -3, 7) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    assert sorted(got) == [(i, j) for i in range(50) for j in range(60) if -3 <= others[j] - times[i] <= 7]


def _metres(a, b):
    p, q = np.radians(a), np.radians(b)
    half = np.sin((q[0] - p[0]) / 2) ** 2 + np.cos(p[0]) * np.cos(q[0]) * np.sin((q[1] - p[1]) / 2) ** 2
    return 2 * 6_371_000.0 * np.arcsin(np.sqrt(half))


def test_close_meetings(spark):
    """Several fixes of one user at one time, ties in time and users of one block and of two."""
    rng = random.Random(3)
    rows = [(rng.randrange(12), rng.randrange(200) * 1_000_000, 50 + rng.randrange(4) / 100, 6 + rng.randrange(4) / 100) for _ in range(300)]
    got = {(r.who_a, r.who_b): (r.met, r.close_share) for r in events.co_movement(spark.createDataFrame(rows, "who long, us long, lat double, lon double"), 6_000_000, 900.0, 50.0, 0.3).collect()}
    best = {}
    for a in rows:
        for b in rows:
            if a[0] < b[0] and abs(a[1] - b[1]) <= 6_000_000:
                key, h = (a[0], a[1], b[0]), (abs(a[1] - b[1]), b[1], _metres(a[2:], b[2:]))
                best[key] = min(best.get(key, h), h)
    sums = {}
    for (a, _, b), (off, _, m) in best.items():
        sums.setdefault((a, b), []).append(m <= 900.0 + 50.0 * off / 1e6)
    assert got == {k: (len(c), sum(c) / len(c)) for k, c in sums.items() if sum(c) / len(c) >= 0.3}


def test_answers(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(15), rng.randrange(2000)) for i in range(300)]
    got = {(r.who_a, r.who_b): r["count"] for r in pairs.answers(spark.createDataFrame(rows, "id long, who long, us long"), 5, 40, 2).collect()}
    found = {(a[0], a[1], b[1]) for a in rows for b in rows if a[1] != b[1] and 5 <= b[2] - a[2] <= 40}
    want = {}
    for _, a, b in found:
        want[a, b] = want.get((a, b), 0) + 1
    assert got == {k: n for k, n in want.items() if n >= 2}
