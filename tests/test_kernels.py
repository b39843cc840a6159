"""Kernels against planted truth."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.functions import stats
from evidentia.kernels import fields, repair, signal


def test_poisson_tail_has_no_switch(spark):
    def want(c, m):
        term = lambda i: math.exp(i * math.log(m) - m - math.lgamma(i + 1))
        return 1 - math.fsum(map(term, range(c))) if c <= m else math.fsum(map(term, range(c, c + 20_000)))

    rows = [(c, m) for c in (1, 2, 30, 399, 400, 401, 1000, 20_000) for m in (0.5, 0.9 * c, max(c - 3 * c**0.5, 0.1), float(c), 1.1 * c)]
    for r in spark.createDataFrame(rows, "c long, m double").withColumn("p", stats.poisson_tail(F.col("c"), F.col("m"))).collect():
        assert r.p == pytest.approx(want(r.c, r.m), rel=1e-8, abs=1e-9), r
    edge = spark.createDataFrame([(0, 3.0), (5, 0.0)], "c long, m double")
    assert [r[0] for r in edge.select(stats.poisson_tail(F.col("c"), F.col("m"))).collect()] == [1.0, 0.0]


def test_tails():
    assert stats.gamma_p(1, 2) == pytest.approx(1 - math.exp(-2), rel=1e-12)
    assert stats.gamma_p(3, 12) == pytest.approx(1 - math.exp(-12) * (1 + 12 + 72), rel=1e-12)
    assert stats.beta_i(2, 3, 0.4) == pytest.approx(0.5248, rel=1e-9)
    assert stats.chi2_quantile(0.95, 4) == pytest.approx(9.487729, rel=1e-6)
    low, high = stats.clopper_pearson(8, 10)
    assert low == pytest.approx(0.4439, abs=1e-4) and high == pytest.approx(0.9748, abs=1e-4)
    assert stats.clopper_pearson(0, 5)[0] == 0 and stats.clopper_pearson(5, 5)[1] == 1
    assert stats.pfa_of_alpha(stats.cfar_alpha(1e-3, 32), 32) == pytest.approx(1e-3)
    assert stats.floor_alpha(1e-3) == pytest.approx(math.log(1000), rel=1e-6)
    assert stats.sidak(0.01, 10) == pytest.approx(1 - 0.99**10)


def test_false_alarm_rate_is_the_stated():
    rng = np.random.default_rng(1)
    noise = rng.exponential(size=400_000)
    means = np.convolve(noise, np.ones(32) / 32, "valid")[:-1]
    rate = (noise[32:] > stats.cfar_alpha(1e-3, 32) * means).mean()
    assert 0.8e-3 < rate < 1.25e-3


def tone(fs, hz, n, seed=0, noise=0.01):
    rng = np.random.default_rng(seed)
    return np.exp(2j * np.pi * hz / fs * np.arange(n)) + noise * (rng.standard_normal(n) + 1j * rng.standard_normal(n))


def test_smoothing_carries_uncertainty():
    rng = np.random.default_rng(2)
    t = np.concatenate([np.arange(0, 50.0), np.arange(80.0, 130)])
    truth = 3 * t
    q = repair.best_noise(t, truth + rng.standard_normal(len(t)), np.ones(len(t)))
    at = np.arange(0, 130.0)
    x, s, _ = repair.kalman_smooth(t, truth + rng.standard_normal(len(t)), np.ones(len(t)), q, at)
    assert np.abs(x - 3 * at).max() < 6 and s[65] > 1.5 * s[20]


def test_words():
    assert repair.normalised("It’s A–Test, ok?") == "it's a test ok"
    assert repair.align_words("the cat sat".split(), "the bat sat down".split()) == (1, 0, 1, 2)
    assert repair.align_words([], ["a"]) == (0, 0, 1, 0) and repair.align_words(["a"], []) == (0, 1, 0, 0)


def test_assignment_is_the_best():
    from itertools import permutations

    rng = np.random.default_rng(7)
    for n, m in ((3, 3), (4, 5), (5, 2), (1, 4)):
        c = rng.random((n, m))
        got = repair.assign(c)
        k = min(n, m)
        best = min(
            sum(
                c[i, j] for i, j in zip(range(n), p, strict=False)
            ) if n <= m else sum(c[i, j] for j, i in enumerate(p)) for p in permutations(range(max(n, m)), k)
        )
        assert len(got) == k and sum(c[i, j] for i, j in got) == pytest.approx(best)
    assert repair.assign(np.array([[np.inf, 1.0], [np.inf, np.inf]])) == [(0, 1)]


def test_interleaved_pulses():
    rng = np.random.default_rng(3)
    a, b = np.arange(0, 2, 0.031), np.arange(0.007, 2, 0.0471)
    keep = np.ones(len(a), bool)
    keep[[10, 30]] = False
    toa = np.sort(np.concatenate([a[keep], b]) + 1e-5 * rng.standard_normal(keep.sum() + len(b)))
    found = sorted(p for p, _ in repair.deinterleave(toa, tolerance=0.005))
    assert found[:2] == pytest.approx([0.031, 0.0471], rel=1e-3)
    assert repair.missing_pulses(a[keep], 0.031) == pytest.approx(a[~keep])


def test_spectra():
    fs = 48_000.0
    x = tone(fs, 6_000, 16_384)
    p = signal.spectrogram(x, 256, 128).mean(axis=0)
    assert np.argmax(p) == 128 + 32 and p.max() == pytest.approx(1, rel=0.05)
    low, high = signal.occupied_band(x, fs)
    assert low - 200 <= 6_000 <= high + 200 and high - low < 600
    f, d = signal.psd(x, fs)
    assert d.sum() * (f[1] - f[0]) == pytest.approx(np.mean(np.abs(x) ** 2), rel=0.05)


def test_gap_filling():
    x = np.sin(0.2 * np.arange(2000)) + 0.5 * np.cos(0.53 * np.arange(2000)) + 1e-3 * np.random.default_rng(0).standard_normal(2000)
    broken = x.copy()
    broken[1000:1030] = 0
    error = lambda y: np.sqrt(np.mean((y[1000:1030] - x[1000:1030]) ** 2))
    assert error(repair.fill_both_ways(broken, 1000, 1030)) < 0.1 < error(repair.fill_linear(broken, 1000, 1030))


def test_fields():
    rng = np.random.default_rng(4)
    xy = rng.random((60, 2)) * 1000
    z = np.sin(xy[:, 0] / 200) + np.cos(xy[:, 1] / 300)
    est, s = fields.krige(xy, z, xy[:3], 0.0, 1.0, 600.0)
    assert est == pytest.approx(z[:3], abs=1e-6) and s.max() < 1e-3
    lags = np.array([50.0, 150, 300, 500, 800])
    n, sill, reach = fields.fit_variogram(lags, fields.model(lags, 0.1, 2.0, 400.0), np.full(5, 100.0))
    assert (n, sill) == pytest.approx((0.1, 2.0), abs=0.1) and reach == pytest.approx(400, rel=0.1)
