"""Measures of series, filters, points and wording against NumPy and plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.kernels import fields, repair
from evidentia.operators import measures, series, spatial, wording
from tests.test_series import blocks, frame, noise


def samples(spark, captures):
    return frame(spark, captures).select("capture", "at", F.col("x").alias("re"), F.col("y").alias("im"))


def test_imbalance_is_measured_and_taken_away(spark):
    z = noise(20_000, 1)
    bad = z.real + 1j * 1.3 * (z.imag * math.cos(0.2) + z.real * math.sin(0.2)) + (0.4 - 0.1j)
    x = samples(spark, {"a": bad, "flat": np.ones(5)})
    m = {r["capture"]: r for r in measures.impairments(x, "capture").collect()}
    assert m["flat"]["gain"] is None and m["flat"]["circularity"] is None
    a = m["a"]
    assert abs(a["gain"] - 1.3) < 0.03 and abs(a["phase"] - 0.2) < 0.03 and abs(a["dc_re"] - 0.4) < 0.03 and a["circularity"] > 0.2
    again = measures.impairments(measures.corrected(x, "capture", measures.impairments(x, "capture")), "capture").filter("capture = 'a'").first()
    assert abs(again["gain"] - 1) < 1e-6 and abs(again["phase"]) < 1e-6 and again["circularity"] < 1e-6 and abs(again["dc_re"]) < 1e-9


def test_cumulants_tell_modulations(spark):
    rng = np.random.default_rng(3)
    got = {r["capture"]: r for r in measures.cumulants(samples(spark, {"bpsk": rng.choice([-1.0, 1], 8000) + 0j, "qpsk": rng.choice([1, -1, 1j, -1j], 8000), "noise": noise(8000, 4)}), "capture").collect()}
    assert abs(got["bpsk"]["c42"] + 2) < 0.05 and abs(got["qpsk"]["c42"] + 1) < 0.05 and abs(got["noise"]["c42"]) < 0.1
    assert got["bpsk"]["c20"] > 0.99 and got["qpsk"]["c20"] < 0.05 and abs(got["qpsk"]["c40"] - 1) < 0.05


def test_correlations_and_their_length(spark):
    x = np.convolve(noise(3000, 5), np.ones(8) / 8, "valid")
    r = measures.autocorrelation(samples(spark, {"a": x}), "capture", list(range(12)))
    got = {q["lag"]: q["re"] + 1j * q["im"] for q in r.collect()}
    y = x - x.mean()
    for lag, v in got.items():
        assert abs(v - np.vdot(y[: len(y) - lag], y[lag:]) / np.vdot(y, y)) < 1e-9
    assert measures.correlation_length(r, "capture").first()["length"] in (5, 6)


def test_spectra_lines_and_bands(spark):
    n, size = 64 * 64, 64
    tone = np.exp(2j * np.pi * 10 / 64 * np.arange(n)) + 0.05 * noise(n, 2)
    pulses = np.tile([1.0, 1, 1, 1, 0, 0, 0, 0], n // 8) * noise(n, 3)
    b = blocks(spark, {"tone": tone, "pulses": pulses}, size)
    x = measures.spectra(b, "capture", size)
    line = {r["capture"]: r["bin"] for r in measures.strongest_line(x, "capture", 0, 63).collect()}
    assert line["tone"] == 10
    square = {r["capture"]: r["bin"] for r in measures.strongest_line(measures.spectra(b, "capture", size, "square"), "capture", 0, 63).collect()}
    assert square["tone"] == 20
    rate = {r["capture"]: r["bin"] for r in measures.strongest_line(measures.spectra(b, "capture", size, "power"), "capture", 4, 32).collect()}
    assert rate["pulses"] == 8
    band = {r["capture"]: (r["low"], r["high"]) for r in measures.occupied_band(x, "capture", size, 0.9).collect()}
    assert 8 <= band["tone"][0] <= 10 <= band["tone"][1] <= 12


@pytest.mark.parametrize("size", [7, 64])
def test_filters_do_not_depend_on_blocks(spark, size):
    x = np.random.default_rng(1).normal(size=150)
    b = blocks(spark, {"a": x + 0j, "b": x[:3] + 0j}, size)
    got = {(r["capture"], r["at"]): r["value"] for r in measures.median_filtered(b, "capture", 3).collect()}
    taps = measures.smoothing_taps(3)
    smooth = {(r["capture"], r["at"]): r["value"] for r in measures.weighted(b, "capture", taps).collect()}
    for k, v in (("a", x), ("b", x[:3])):
        wide = np.pad(v, 3)
        for i in range(len(v)):
            assert abs(got[k, i] - np.median(v[max(0, i - 3) : i + 4])) < 1e-12 and abs(smooth[k, i] - np.dot(wide[i : i + 7], taps)) < 1e-9
    line = np.arange(20.0) ** 2
    same = {r["at"]: r["value"] for r in measures.weighted(blocks(spark, {"q": line + 0j}, size), "capture", taps).collect()}
    assert all(abs(same[i] - line[i]) < 1e-8 for i in range(3, 17))


def test_code_words_whatever_the_phase(spark):
    rng = random.Random(2)
    book = {"a": [1, 1, -1, 1], "b": [1, -1, 1, 1], "c": [1, 1, 1, -1]}
    sent = [rng.choice("abc") for _ in range(60)]
    x = np.concatenate([np.array(book[w]) * np.exp(1j * rng.random() * 6) for w in sent]) + 0.1 * noise(240, 3)
    table = spark.createDataFrame([(w, i, float(v), 0.0) for w, vs in book.items() for i, v in enumerate(vs)], "word string, place int, re double, im double")
    got = {r["symbol"]: r for r in measures.likeliest_words(samples(spark, {"s": x}), "capture", table, 4).collect()}
    assert [got[i]["word"] for i in range(60)] == sent and all(0.8 < r["share"] <= 1 for r in got.values())


@pytest.mark.parametrize("size", [60, 100, 500])
def test_gaps_are_filled_whatever_the_blocks(spark, size):
    x = np.sin(0.2 * np.arange(460)) + 0.5 * np.cos(0.53 * np.arange(460))
    broken = x.copy()
    for a, b in ((0, 3), (97, 103), (110, 111), (250, 258), (300, 330), (455, 460)):
        broken[a:b] = np.nan
    b = series.blocks_of(frame(spark, {"a": broken + 0j}).select("capture", "at", "x"), "capture", "at", size, F.col("x"))
    got = {r["at"]: (r["value"], r["inferred"]) for r in series.filled(b, "capture", size, 8, 8, 48).collect()}
    assert len(got) == 460
    for a, e in ((97, 103), (110, 111), (250, 258)):
        ends = {97: (49, 110), 110: (103, 159), 250: (202, 300)}[a]
        want = repair.fill_both_ways(broken[ends[0] : ends[1]], a - ends[0], e - ends[0], 8, 48)[a - ends[0] : e - ends[0]]
        assert [got[i][0] for i in range(a, e)] == pytest.approx(want, abs=1e-9) and all(got[i][1] for i in range(a, e))
    assert max(abs(got[i][0] - x[i]) for i in range(250, 258)) < 0.05
    assert all(math.isnan(got[i][0]) for i in (0, 1, 310, 457)) and got[5] == (x[5], False)


def test_points_in_rings(spark):
    rng = random.Random(5)
    corners = [("r", i, 3 * math.cos(a), 3 * math.sin(a)) for i, a in enumerate(np.linspace(0, 2 * math.pi, 7)[:-1])] + [("s", i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)])]
    points = [(i, rng.uniform(-4, 5), rng.uniform(-4, 5)) for i in range(400)]
    got = {tuple(r) for r in measures.in_rings(spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(corners, "ring string, nth int, x double, y double"), 0.7).collect()}

    def inside(x, y, ring):
        c = [(a, b) for r, _, a, b in corners if r == ring]
        return sum((p[1] > y) != (q[1] > y) and x < p[0] + (y - p[1]) / (q[1] - p[1]) * (q[0] - p[0]) for p, q in zip(c, c[1:] + c[:1], strict=True)) % 2 == 1

    assert got == {(i, ring) for i, x, y in points for ring in "rs" if inside(x, y, ring)}
    square = spark.createDataFrame([("q", 0, 50.0, 6.0), ("q", 1, 50.01, 6.0), ("q", 2, 50.01, 6.01), ("q", 3, 50.0, 6.01)], "ring string, nth int, lat double, lon double")
    assert measures.ring_areas(square).first()["m2"] == pytest.approx(1112 * 1112 * math.cos(math.radians(50.005)), rel=0.01)


def test_hills_cost_more_than_plains(spark):
    rows = [(k, d * 1000.0, h if d == 5 else 0.0, 10_000.0, 30.0, 30.0) for k, h in (("plain", 0.0), ("hill", 120.0)) for d in range(11)]
    got = {r["link"]: r["loss_db"] for r in measures.bullington_losses(spark.createDataFrame(rows, "link string, d double, h double, span double, tx double, rx double"), "link", 446e6).collect()}
    assert got["hill"] > got["plain"] + 10 and got["plain"] < 10


def test_two_classes_and_chances(spark):
    rng = np.random.default_rng(8)
    v = spark.createDataFrame([("a", float(x)) for x in np.concatenate([rng.normal(0, 1, 300), rng.normal(9, 1, 300)])] + [("b", 1.0), ("b", 1.0), ("c", None)], "k string, v double")
    got = measures.two_class_threshold(v, "k", "v").collect()
    assert len(got) == 1 and 2 < got[0]["threshold"] < 6.5
    x = rng.normal(size=5000).round(2)
    y = (rng.random(5000) < 1 / (1 + np.exp(-(1.5 * x - 0.5)))).astype(int)
    a, b = measures.platt(spark.createDataFrame([*zip(x.tolist(), y.tolist(), strict=True), (None, 1)], "s double, y int"), "s", "y")
    assert a == pytest.approx(1.5, abs=0.15) and b == pytest.approx(-0.5, abs=0.15)
    assert measures.platt(spark.createDataFrame([], "s double, y int"), "s", "y") == (0.0, 0.0)


def test_variogram_curves(spark):
    lags = np.array([50.0, 150, 300, 500, 800])
    rows = [(k, int(100 + i), float(m), float(s)) for k, sill in (("a", 2.0), ("b", 5.0)) for i, (m, s) in enumerate(zip(lags, fields.model(lags, 0.1, sill, 400.0), strict=True))]
    got = {r["k"]: r for r in spatial.fitted_variogram(spark.createDataFrame(rows, "k string, pairs long, metres double, semivariance double"), "k").collect()}
    assert got["a"]["sill"] == pytest.approx(2.0, abs=0.1) and got["b"]["sill"] == pytest.approx(5.0, abs=0.2) and got["a"]["reach"] == pytest.approx(400, rel=0.1)


def test_wording(spark):
    docs = spark.createDataFrame([(1, "We saw NASA in Paris. Then Paris saw NASA go."), (2, None), (3, ""), (4, "one")], "id long, text string")
    model = wording.casing(docs, "text")
    said = spark.createDataFrame([(7, "the nasa rocket hit paris. we saw it"), (8, None)], "id long, text string")
    assert {r["id"]: r["text"] for r in wording.cased(said, "id", "text", model).collect()} == {7: "The NASA rocket hit Paris. We saw it"}
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(wording.closed_up(F.lit(" Hello , world ( ok ) ! "))) == "Hello, world (ok)!"
    assert one(wording.last_object(F.lit('x {"a": 1} then {"b": 2} {bad'))) == '{"b": 2}' and one(wording.last_object(F.lit("none"))) is None
    pairs = spark.createDataFrame([(1, "Colour and shape", "color"), (2, "shape", "Form"), (3, None, None)], "id long, a string, b string")
    terms = spark.createDataFrame([("colour", "color"), ("shape", "form")], "term string, wanted string")
    assert {tuple(r) for r in wording.missing_terms(pairs, "id", "a", "b", terms).collect()} == {(1, "shape", "form")}
    rng = random.Random(3)
    names = ["".join(rng.choice("abc") for _ in range(rng.randrange(0, 6))) for _ in range(60)]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row, last = [i + 1, *[0] * len(b)], row
            for j, y in enumerate(b):
                row[j + 1] = min(row[j] + 1, last[j + 1] + 1, last[j] + (x != y))
        return row[-1]

    left, right = spark.createDataFrame([(i, n) for i, n in enumerate(names[:30])], "id long, name string"), spark.createDataFrame([(n,) for n in names[30:]], "known string")
    for most in (1, 2):
        got = {(r["id"], r["known"], r["edits"]) for r in wording.near_names(left, right, most).collect()}
        assert got == {(i, k, edits(n, k)) for i, n in enumerate(names[:30]) for k in set(names[30:]) if edits(n, k) <= most}
