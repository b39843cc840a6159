"""Steps whose time or memory grew faster than their tables: the same results as plain computations, and bounds of what a task holds."""

import random

import numpy as np
import pyarrow as pa
import pytest

from evidentia.operators import cyclic, matching, roads


@pytest.mark.parametrize("meetings", [1000, 0])
def test_nearest_emitters_by_plain_search(spark, monkeypatch, meetings):
    """Missing features, several rows of one, values that are no numbers, equal emitters, parts of both sides."""
    for name, value in (("MEETINGS", meetings), ("PROBES", 60), ("EMITTERS", 40), ("PAIRS", 64), ("LEAF", 2)):
        monkeypatch.setattr(matching, name, value)
    rng = random.Random(4)
    names = ["a", "b", "c"]
    lib, probes = [], []
    for e in range(90):
        for f in names:
            if rng.random() < 0.8:
                lib.append((e, f, 5, round(rng.gauss(0, 1), 1) if e % 3 else 1.0, 0.5 + (f == "b")))
    for i in range(70):
        for f in names + ["d"]:
            for _ in range(rng.choice([0, 1, 1, 2])):
                probes.append((i, f, rng.choice([rng.gauss(0, 3), rng.gauss(0, 3), 0.5, None, float("nan")])))
    got = matching.library_match(
        spark.createDataFrame(probes, "id long, feature string, value double"),
        spark.createDataFrame(lib, "emitter long, feature string, n long, mean double, var double"), {1: 0.5}
    ).collect()
    want = {}
    for i in range(70):
        for e in range(90):
            d = [(v - m) ** 2 / var for j, f, v in probes if j == i and v is not None and v == v for k, g, _, m, var in lib if k == e and g == f]
            if d:
                want[i] = min(want.get(i, (np.inf,)), (round(float(np.sqrt(np.mean(d))), 9), e, len(d)))
    assert {r["id"]: (round(r["distance"], 9), r["nearest"], r["used"]) for r in got} == want
    pooled = {"a": 0.5, "b": 1.5, "c": 0.5}
    left = pa.table(dict(zip(("id", "feature", "value"), map(list, zip(*[p for p in probes if p[2] is not None], strict=True)), strict=True)))
    right = pa.table({"remitter": [r[0] for r in lib], "rfeature": [r[1] for r in lib], "rmean": [r[3] for r in lib], "rpooled": [pooled[r[1]] for r in lib]})
    for r in matching._nearest_emitters(left, right).to_pylist():
        assert (round(r["distance"], 9), r["emitter"], r["used"]) == want.pop(r["id"])
    assert not want


def test_probes_meet_few_emitters(monkeypatch):
    """A search through the tree works out far fewer distances than probes times emitters."""
    worked, cost = [0], matching._cost
    monkeypatch.setattr(matching, "_cost", lambda n, m, p: worked.__setitem__(0, worked[0] + np.broadcast(m, p).size // 4) or cost(n, m, p))
    rng = np.random.default_rng(5)
    points, probes = rng.normal(0, 0.04, (20_000, 4)), rng.normal(0, 1, (300, 4))
    best, which = matching._nearest_points(np.ones((300, 4)), probes, points)
    plain = ((probes[:, None] - points) ** 2).sum(axis=2)
    assert (which == plain.argmin(axis=1)).all() and np.allclose(best, plain.min(axis=1)) and worked[0] < 300 * 20_000 / 10


def _noise(spark, captures, segments, size):
    rng = np.random.default_rng(6)
    rows = [(c, b, b * size, *rng.normal(0, 1, (2, size)).tolist()) for b in range(segments) for c in range(captures)]
    return spark.createDataFrame(rows, "capture long, block long, start long, re array<double>, im array<double>").repartition(3)


def test_segments_of_a_capture_are_added_up_in_one_task(spark, monkeypatch):
    """A task tells one sum of a capture's segments in a row, not one for each, whatever order they come in; long captures are dealt to many."""
    b = _noise(spark, 30, 8, 32)
    side = cyclic._side_by_side(b, "capture", 32)
    seen = side.rdd.glom().map(lambda rows: [r.capture for r in rows]).collect()
    assert sum(len(set(p)) for p in seen) == 30 and all(p == sorted(p) for p in seen) and len(seen) == 4
    monkeypatch.setattr(cyclic, "TOGETHER", 2)
    parts = cyclic._side_by_side(_noise(spark, 1, 40, 32), "capture", 32).rdd.glom().map(len).collect()
    assert sum(parts) == 40 and max(parts) < 40


def test_strips_and_sums_in_small_portions(spark, monkeypatch):
    """The same results when a task works on one segment at a time."""
    b = _noise(spark, 4, 5, 32)
    level = [cyclic.Level(), cyclic.Level(2, (0.1,))]
    found = lambda: [
        {tuple(r[c] for c in ("capture", "strip", "fine")): (r["power"], r["segments"]) for r in cyclic.spectral_correlation(b, "capture", 32, 4).collect()},
        {tuple(r)[:4] + (round(r["alpha"], 9),): (r["statistic"], r["segments"]) for r in cyclic.features(cyclic.lag_sums(b, "capture", 32, level), "capture", 32, level, 0.9).collect()}
    ]
    whole = found()
    assert len(whole[0]) == 4 * 4 * 32 and whole[1]
    monkeypatch.setattr(cyclic, "AT_ONCE", 1)
    for a, c in zip(whole, found(), strict=True):
        assert a.keys() == c.keys() and all(np.allclose(a[k], c[k]) for k in a)


def test_edges_go_to_more_tasks_the_more_they_are(spark, monkeypatch):
    monkeypatch.setattr(roads, "ROWS", 10)
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(100)] + [(1, 0, 3.0)], "a long, b long, length double")
    ways = roads.both_ways(edges)
    assert ways.rdd.getNumPartitions() == 21 and ways.count() == 200 and ways.filter("a = 1 AND b = 0").first()["length"] == 1.0
