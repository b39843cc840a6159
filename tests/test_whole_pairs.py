"""Queries of pairs and places that read all of their tables and keep what is written small: against plain work."""

import math
import random

import pytest
from pyspark.sql import functions as F

from evidentia import catalog
from evidentia.operators import events, pairs, roads, spatial

HOUR = 3_600_000_000


def test_customers_are_looked_for_in_the_rings_of_all_suppliers(spark, sf, capsys):
    found = catalog.QUERIES["customers_in_rings"](spark, sf)
    suppliers = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("k"))
    at = lambda k, x, y: (5 + k * 91 % 307 / 100 + x, 50 + k * 37 % 211 / 100 + y)
    customers = [(r[0], *at(r[0], 0.0013, 0.0017)) for r in spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey").collect()]
    want = set()
    for (k,) in suppliers.collect():
        c = [at(k, 0.0, 0.0), at(k, 0.1, 0.3), at(k, 0.4, 0.1)]
        for i, x, y in customers:
            if sum((a[1] > y) != (b[1] > y) and x < a[0] + (y - a[1]) / (b[1] - a[1]) * (b[0] - a[0]) for a, b in zip(c, c[1:] + c[:1], strict=True)) % 2:
                want.add((i, k))
    assert {tuple(r) for r in found.collect()} == want and any(k % 3 for _, k in want)
    # Places are few, and meet many edges: they keep the tasks they are dealt to.
    found.explain("simple")
    assert "REPARTITION_BY_NUM" in capsys.readouterr().out


def _sightings(spark, users, n, seed):
    """Sightings, some without a user or a time."""
    rng = random.Random(seed)
    rows = [(rng.randrange(users), rng.randrange(400) * HOUR // 2) for _ in range(n)] + [(None, 5), (1, None), (2, None), (users, None)]
    return spark.createDataFrame(rows, "who long, us long")


@pytest.mark.parametrize("name", ["user_graph", "alike_schedules", "user_links"])
def test_pairs_are_not_written_between_tasks(spark, sf, capsys, name):
    """Users are, by blocks: not the products of two of them, their edges, or counts to be joined with totals."""
    catalog.QUERIES[name](spark, sf).explain("simple")
    plan = capsys.readouterr().out
    assert "hashpartitioning(_x" in plan and "hashpartitioning(who_a" not in plan and "hashpartitioning(who_b" not in plan


def test_a_graph_by_parts_is_that_of_joined_edges(spark, monkeypatch):
    monkeypatch.setattr(pairs, "LEAST", 3)
    monkeypatch.setattr(pairs, "PART", 4)
    monkeypatch.setattr(pairs, "COLUMNS", 7)
    monkeypatch.setattr(pairs, "AT_ONCE", 9)
    e = _sightings(spark, 30, 300, 1)
    near, alike = events.co_occurrence(e, HOUR, 2), events.alike_schedules(e, 0.2)
    want = {tuple(r)[:3]: r.weight for r in events.social_graph(("together", near, "lift"), ("schedule", alike, "cosine")).collect()}
    got = {tuple(r)[:3]: r.weight for r in events.user_graph(e, HOUR, 2, 0.2).collect()}
    assert got == want and len({k for _, _, k in got}) == 3


def test_schedules_by_plain_products(spark, monkeypatch):
    monkeypatch.setattr(pairs, "PART", 5)
    e = _sightings(spark, 25, 300, 2)
    week = {}
    for r in events.week_counts(e).collect():
        week.setdefault(r.who, {})[r.slot] = r.n
    want = {}
    for a in week:
        for b in week:
            if None not in (a, b) and a < b:
                dot = sum(n * week[b].get(s, 0) for s, n in week[a].items() if s is not None)
                cosine = dot / math.sqrt(sum(n * n for n in week[a].values()) * sum(n * n for n in week[b].values()))
                if dot and cosine >= 0.2:
                    want[a, b] = cosine
    assert {(r.who_a, r.who_b): r.cosine for r in events.alike_schedules(e, 0.2).collect()} == want and len(want) > 10


def test_movement_by_parts(spark, monkeypatch):
    """Several fixes of a user at one time, fixes without a place, turned times, and limits that the chord alone can't tell."""
    rng = random.Random(3)
    place = lambda: (None, None) if rng.random() < 0.1 else (50 + rng.randrange(4) / 100, 6 + rng.randrange(4) / 100)
    rows = [(rng.randrange(14), rng.randrange(150) * 1_000_000, *place()) for _ in range(500)]
    fixes = spark.createDataFrame(rows, "who long, us long, lat double, lon double")
    side = 1111.9492664455872  # a hundredth of a degree
    first, all_ = min(r[1] for r in rows), max(r[1] for r in rows) - min(r[1] for r in rows) + 1

    def metres(a, b):
        if None in (*a, *b):
            return math.nan
        p, q = [math.radians(x) for x in a], [math.radians(x) for x in b]
        half = math.sin((q[0] - p[0]) / 2) ** 2 + math.cos(p[0]) * math.cos(q[0]) * math.sin((q[1] - p[1]) / 2) ** 2
        return 2 * 6_371_000.0 * math.asin(math.sqrt(half))

    want = {}
    for turn in range(3):
        best = {}
        for a in rows:
            for b in rows:
                us = b[1] if not turn else first + (b[1] - first + math.floor(all_ * turn / 3)) % all_
                if a[0] < b[0] and abs(a[1] - us) <= 4_000_000:
                    m = metres(a[2:], b[2:])
                    key, h = (a[0], a[1], b[0]), (abs(a[1] - us), us, math.isnan(m), m)
                    best[key] = min(best.get(key, h), h)
        for (a, _, b), (off, _, none, m) in best.items():
            c = want.setdefault((a, b), [0, 0, 0, 0, 0])
            close = not none and m <= side + off / 1e6 * 50 - 1e-3
            for i, x in ((3, 1), (4, close)) if turn else ((0, 1), (1, not none), (2, close)):
                c[i] += x
    want = {k: tuple(c) for k, c in want.items() if c[2] >= 2 and c[2] >= 0.3 * c[0]}
    for part, at_once in ((512, 1_000_000), (3, 50)):
        monkeypatch.setattr(pairs, "NEAR", part)
        monkeypatch.setattr(pairs, "AT_ONCE", at_once)
        got = pairs.close_meetings(fixes, 4_000_000, side - 1e-3, 50.0, 2, 0.0, 0.3, 2)
        assert {(r.who_a, r.who_b): tuple(r)[2:] for r in got.collect()} == want and len(want) > 10


def test_answers_and_their_chance(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(15), rng.randrange(2000)) for _ in range(300)] + [(3, None)]
    got = {(r.who_a, r.who_b): r for r in events.answered_pairs(spark.createDataFrame(rows, "who long, us long"), 5, 40, 2, 0.5).collect()}
    timed = [r for r in rows if r[1] is not None]
    span = max(t for _, t in timed) - min(t for _, t in timed)
    want = {}
    for a, t in timed:
        for b in {w for w, u in timed if w != a and 5 <= u - t <= 40}:
            want[a, b] = want.get((a, b), 0) + 1
    n = {w: sum(r[0] == w for r in rows) for w in range(15)}
    for (a, b), k in want.items():
        mean = n[a] * (1 - math.exp(-n[b] * 35 / span))
        p = 1 - sum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(k))
        assert ((a, b) in got) == (k >= 2 and p < 0.5)
        if (a, b) in got:
            r = got[a, b]
            assert r["count"] == k and abs(r.expected - mean) < 1e-9 and abs(r.lift - k / mean) < 1e-9 and abs(r.p_value - p) < 1e-9


def test_points_snap_by_cells(spark, monkeypatch, capsys):
    """Many points of one place, crowded cells, segments of no length, equal distances, and nulls; no row of a point and a segment is written."""
    monkeypatch.setattr(roads, "CROWD", 7)
    rng = random.Random(6)
    some = lambda n, k: [rng.randrange(n) / k for _ in range(2)]
    points = [(i, *some(40, 20)) for i in range(300)] + [(i, 0.5, 0.5) for i in range(300, 340)] + [(400, None, 1.0), (401, 1.0, math.nan), (402, 9.0, 9.0)]
    ways = [(i, *(a := some(20, 10)), *rng.choice([a, some(20, 10)])) for i in range(40)] + [(50, 0.5, 0.7, 0.5, 0.7), (49, 0.5, 0.3, 0.5, 0.3), (60, None, 1.0, 1.0, 1.0)]
    found = roads.snap(spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(ways, "edge long, ax double, ay double, bx double, by double"), 0.2)
    want = {}
    for i, x, y in points:
        for e, ax, ay, bx, by in ways:
            if None not in (x, ax) and y == y:
                dx, dy = bx - ax, by - ay
                size = dx * dx + dy * dy
                share = max(0.0, min(1.0, ((x - ax) * dx + (y - ay) * dy) / size)) if size else 0.0
                far = round(math.hypot(x - ax - share * dx, y - ay - share * dy), 9)
                if far <= 0.2 and (far, e) < want.get(i, (9.0, 0))[:2]:
                    want[i] = far, e, share
    assert {r.id: (r.edge, round(r.metres, 9), round(r.share, 9)) for r in found.collect()} == {i: (e, far, round(s, 9)) for i, (far, e, s) in want.items()}
    assert len({e for _, e, _ in want.values()}) > 10 and 400 not in want
    found.explain("simple")
    assert "CoGroup" in capsys.readouterr().out


def test_fingerprints_in_parts(spark, monkeypatch, capsys):
    """Queries and places in many parts give what few give; results stream out of a group, and groups keep their tasks however few rows they have."""
    rng = random.Random(9)
    heard = [(q, rng.randrange(6), -rng.uniform(40, 110)) for q in range(50) for _ in range(3)] + [(70, 99, -50.0), (71, 1, None), (72, None, -50.0)]
    known = [(p, k, -rng.uniform(40, 110)) for p in range(30) for k in range(6) if rng.random() < 0.5] + [(40, None, -60.0)]
    h, k = spark.createDataFrame(heard, "qid long, key int, level double"), spark.createDataFrame(known, "place string, key int, level double")
    few = {tuple(r)[:3]: round(r.loglik, 9) for r in spatial.fingerprint_loglik(h, k).collect()}
    monkeypatch.setattr(spatial, "HELD", 4)
    df = spatial.fingerprint_loglik(h, k)
    assert {tuple(r)[:3]: round(r.loglik, 9) for r in df.collect()} == few and len(few) > 1000
    df.explain("simple")
    plan = capsys.readouterr().out
    assert "CoGroup" not in plan and "REPARTITION_BY_NUM" in plan
    assert spatial.fingerprint_loglik(h.limit(0), k).count() == spatial.fingerprint_loglik(h, k.limit(0)).count() == 0
