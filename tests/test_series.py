"""Sampled series against the whole series in NumPy, and cyclic search against planted signals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.operators import cyclic, series


def frame(spark, captures):
    """Samples of several complex series."""
    rows = [(k, i, float(z.real), float(z.imag)) for k, x in captures.items() for i, z in enumerate(x)]
    return spark.createDataFrame(rows, "capture string, at long, x double, y double")


def blocks(spark, captures, size):
    return series.blocks_of(frame(spark, captures), "capture", "at", size, F.col("x"), F.col("y"))


def noise(n, seed):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=n) + 1j * rng.normal(size=n)) / np.sqrt(2)


def back(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["capture"], {})[r["at"]] = r["re"] + 1j * r["im"]
    return {k: np.array([v[i] for i in range(len(v))]) for k, v in out.items()}


@pytest.mark.parametrize(("size", "to"), [(40, 2.0), (64, 2.0), (501, 2.0), (48, 4.0), (40, 3.0)])
def test_resampling_does_not_depend_on_blocks(spark, size, to):
    captures = {"a": noise(500, 1), "b": noise(64, 2), "c": noise(1, 3)}
    got = back(series.resample(blocks(spark, captures, size), "capture", size, 3.0, to, 16))
    up, down = series.ratio_of(3.0, to)
    taps, reach = series.sinc_taps(up, down, 16)
    for k, x in captures.items():
        wide = np.concatenate([np.zeros(reach), x, np.zeros(reach)])
        want = [wide[m * down // up : m * down // up + 2 * reach + 1] @ taps[m * down % up] for m in range(-(-len(x) * up // down))]
        assert np.allclose(got[k], want, atol=1e-12)
    tone = np.exp(2j * np.pi * 0.05 * np.arange(600))
    found = back(series.resample(blocks(spark, {"t": tone}, size), "capture", size, 3.0, to, 16))["t"]
    middle = np.arange(60, len(found) - 60)
    assert np.abs(found[middle] - np.exp(2j * np.pi * 0.05 * middle * 3.0 / to)).max() < 0.01


def test_short_blocks_are_refused_and_nothing_gives_nothing(spark):
    with pytest.raises(ValueError):
        series.resample(blocks(spark, {"a": noise(9, 1)}, 4), "capture", 4, 3.0, 2.0)
    empty = blocks(spark, {"a": noise(9, 1)}, 64).limit(0)
    assert series.resample(empty, "capture", 64, 3.0, 2.0).count() == 0
    assert cyclic.search(empty, "capture", 64, [cyclic.Level()]).count() == 0
    assert series.solve(series.gram(empty.withColumns({"to_re": F.col("re"), "to_im": F.col("im")}), "capture", 64, 3), "capture", 7).count() == 0
    assert series.find_marker(series.marker_scores(empty, "capture", 64, np.ones(3)), "capture").count() == 0


@pytest.mark.parametrize("size", [32, 100, 1000])
def test_markers_and_labels(spark, size):
    rng = np.random.default_rng(5)
    marker = np.exp(2j * np.pi * rng.random(31))
    x = {k: 0.3 * noise(900, i) for i, k in enumerate("abc")}
    for k, at, end in (("a", 90, 691), ("b", 31, 631)):
        x[k][at : at + 31] += marker
        x[k][end : end + 31] += marker
    scores = series.marker_scores(blocks(spark, x, size), "capture", size, marker)
    if size < 1000:
        begins = series.find_marker(scores.filter("at < 400"), "capture")
        ends = series.find_marker(scores.filter("at >= 400"), "capture")
        got = {r["capture"]: r for r in begins.collect()}
        assert got["a"]["at"] == 90 and got["b"]["at"] == 31 and got["a"]["score"] > 0.7 > got["c"]["score"]
        labels = spark.createDataFrame([(k, 200.0, 50.0) for k in "abc"], "capture string, start_s double, duration_s double")
        rows = {r["capture"]: r for r in series.align_labels(labels, "capture", begins, ends, 600.0, 0.6).collect()}
        assert set(rows) == {"a", "b"} and rows["b"]["sample_start"] == 231 and abs(rows["b"]["drift_ppm"]) < 1e-9
        assert rows["a"]["sample_start"] == round(90 + 200 * 601 / 600) and abs(rows["a"]["drift_ppm"] - 1e6 / 600) < 1e-6
    best = series.find_marker(scores, "capture").collect()
    for r in best:
        whole = [abs(np.vdot(marker, x[r["capture"]][i : i + 31])) ** 2 / (np.sum(np.abs(x[r["capture"]][i : i + 31]) ** 2) * 31) for i in range(870)]
        assert r["at"] == int(np.argmax(np.round(whole, 9))) and abs(r["score"] - max(whole)) < 1e-6


@pytest.mark.parametrize(("taps", "shifts", "size"), [(3, (0.0,), 50), (4, (0.0,), 64), (3, (0.0, 0.25), 37)])
def test_widely_linear_filters(spark, taps, shifts, size):
    x = {"a": noise(400, 1), "b": noise(150, 2)}
    design = {k: series._design(np.concatenate([np.zeros(taps - 1 - taps // 2), v, np.zeros(taps // 2)]), 0, taps, len(v), shifts) for k, v in x.items()}
    width = series.columns_of(taps, shifts)
    true = noise(width, 9)
    y = {k: m @ true for k, m in design.items()}
    to = blocks(spark, y, size).select("capture", "block", F.col("re").alias("to_re"), F.col("im").alias("to_im"))
    pairs = blocks(spark, x, size).join(to, ["capture", "block"])
    equations = series.gram(pairs, "capture", size, taps, shifts)
    for r in equations.filter("capture = 'a'").collect():
        m = np.concatenate([design["a"], y["a"][:, None]], axis=1)
        assert abs(np.vdot(m[:, r["i"]], m[:, r["j"]]) - (r["re"] + 1j * r["im"])) < 1e-6
    weights = series.solve(equations, "capture", width, 1e-12)
    for k in x:
        got = {r["i"]: r["re"] + 1j * r["im"] for r in weights.filter(F.col("capture") == k).collect()}
        assert max(abs(got[i] - true[i]) for i in range(width)) < 1e-3
    again = back(series.filtered(blocks(spark, x, size), "capture", size, weights, taps, shifts))
    assert all(np.abs(again[k] - y[k]).max() < 1e-3 for k in x)


def test_lag_sums_do_not_depend_on_partitions(spark):
    b = blocks(spark, {"a": noise(1000, 1), "b": noise(300, 2)}, 128)
    levels = [cyclic.Level(1, (0.0, 0.25)), cyclic.Level(4, (0.1,))]
    one, many = (
        {tuple(r)[:6]: (r["stat"], r["segments"]) for r in cyclic.lag_sums(b.repartition(n), "capture", 128, levels).collect()} for n in (1, 5)
    )
    assert one.keys() == many.keys() and all(abs(one[k][0] - many[k][0]) < 1e-9 and one[k][1] == many[k][1] for k in one)
    assert {v[1] for k, v in one.items() if k[0] == "a"} == {7}


def test_statistic_under_noise_is_gamma(spark):
    """With K segments the mean and the variance of the statistic, in units of its scale, are K."""
    segments, size = 5, 4096
    sums = cyclic.lag_sums(blocks(spark, {"n": noise(segments * size, 3)}, size), "capture", size, [cyclic.Level()], (2,), ()).collect()
    row = np.array([r["stat"] for r in sorted(sums, key=lambda r: r["bin"])])[cyclic.NEAR_ZERO :]
    units = row / cyclic.local_floor(row) * cyclic.gamma_quantile(0.5, segments)
    assert abs(units.mean() - segments) < 0.3 and abs(units.var() - segments) < 1.0


def test_a_carrier_under_the_noise_is_found(spark):
    """A BPSK carrier 10 dB under the noise: its conjugate line at twice the carrier, and its rate; noise alone gives nothing."""
    rng = np.random.default_rng(7)
    size, segments, carrier = 4096, 12, 0.0712
    n = size * segments
    symbols = np.repeat(rng.choice([-1.0, 1.0], n // 16 + 1), 16)[:n]
    signal = np.sqrt(0.1) * symbols * np.exp(2j * np.pi * carrier * np.arange(n))
    b = blocks(spark, {"s": noise(n, 8) + signal, "n": noise(n, 9)}, size)
    levels = [cyclic.Level(1, (0.0,)), cyclic.Level(2, (0.0, 0.25))]
    found = cyclic.search(b, "capture", size, levels, 1e-3).collect()
    assert {r["capture"] for r in found} == {"s"}
    conj = max((r for r in found if r["conjugate"]), key=lambda r: r["statistic"])
    assert abs(conj["alpha"] - 2 * carrier) < 1 / size and conj["statistic"] > conj["threshold"] and conj["p_family"] < 1e-3
    assert conj["levels"] >= 1 and conj["segments"] == segments


def test_silence_has_no_features(spark):
    assert cyclic.search(blocks(spark, {"z": np.zeros(512, complex)}, 128), "capture", 128, [cyclic.Level()], 0.5).count() == 0


def test_strips_show_the_cycle_frequency(spark):
    """Amplitude steps at a fixed rate give the strongest cell off zero at that rate; sums don't depend on partitions."""
    rng = np.random.default_rng(4)
    size, n = 256, 256 * 40
    x = np.repeat(rng.normal(size=n // 8), 8) * np.tile([1.0, 1, 1, 1, 0, 0, 0, 0], n // 8) + 0.05 * noise(n, 2)
    b = blocks(spark, {"s": x}, size)
    rows = cyclic.spectral_correlation(b, "capture", size, 16).collect()
    assert len(rows) == 16 * size and {r["segments"] for r in rows} == {40}
    off = [r for r in rows if abs(r["alpha"]) > 0.03 and abs(r["alpha"]) < 0.9]
    best = max(off, key=lambda r: r["power"])
    assert min(abs(abs(best["alpha"]) - k / 8) for k in range(1, 8)) < 2 / size
    again = {(r["strip"], r["fine"]): r["power"] for r in cyclic.spectral_correlation(b.repartition(7), "capture", size, 16).collect()}
    assert all(abs(again[r["strip"], r["fine"]] - r["power"]) < 1e-6 * max(1, r["power"]) for r in rows)
