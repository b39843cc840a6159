"""Networks, movement, parts of classes, places, example sets, filled masks and the detector's machine against plain Python."""

import heapq
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.operators import events, hunting, infill, matching, registry, roads
from evidentia.streaming import detector
from tests.test_live import drained
from tests.test_series import blocks, noise


def dijkstra(edges, seeds, budget):
    ways = defaultdict(list)
    for a, b, n in edges:
        ways[a].append((b, n))
        ways[b].append((a, n))
    out = {}
    for source, node, cost in seeds:
        queue, far = [(cost, node)], {}
        while queue:
            c, v = heapq.heappop(queue)
            if v in far or c > budget:
                continue
            far[v] = c
            for w, n in ways[v]:
                heapq.heappush(queue, (c + n, w))
        for v, c in far.items():
            out[source, v] = min(c, out.get((source, v), math.inf))
    return out


def test_reach_and_routes_equal_dijkstra(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60), rng.choice([0.5, 1.0, 1.5, 2.0])) for _ in range(110)]
    seeds = [(1, 0, 0.0), (1, 7, 0.5), (2, 33, 0.0), (3, 999, 0.0)]
    e = spark.createDataFrame([*edges, (None, 3, 1.0), (4, 5, None), (6, 8, -1.0)], "a long, b long, length double")
    s = spark.createDataFrame(seeds, "source long, node long, cost double")
    got = {(r["source"], r["node"]): r["cost"] for r in roads.reach(e, s, 4.0).collect()}
    assert got == dijkstra(edges, seeds, 4.0)
    pairs = [(0, v) for v in (0, 5, 12, 40)] + [(33, 2), (0, 777)]
    found = {(r["source"], r["target"]): (r["cost"], r["path"]) for r in roads.routes(e, spark.createDataFrame(pairs, "source long, target long"), 6.0).collect()}
    least = {(min(a, b), max(a, b)): min(n for x, y, n in edges if {x, y} == {a, b}) for a, b, _ in edges}
    for (a, b), (cost, path) in found.items():
        want = dijkstra(edges, [(a, a, 0.0)], 6.0).get((a, b))
        assert cost == want
        if cost is not None:
            steps = [int(v) for v in path]
            assert steps[0] == a and steps[-1] == b and sum(least[min(p), max(p)] for p in zip(steps, steps[1:], strict=False)) == cost
    assert roads.reach(e.limit(0), s, 4.0).count() == len(seeds) and roads.reach(e, s.limit(0), 4.0).count() == 0


def test_stretches_by_stepping_along_edges(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(20), rng.randrange(20), float(rng.randrange(1, 9))) for _ in range(30)]
    e, s = spark.createDataFrame(edges, "a long, b long, length double"), spark.createDataFrame([(1, 0, 0.0)], "source long, node long, cost double")
    far = dijkstra(edges, [(1, 0, 0.0)], 50.0)
    got = defaultdict(list)
    for r in roads.stretches(e, roads.reach(e, s, 50.0), 3.0, 7.5).collect():
        got[r["a"], r["b"]].append((r["from_m"], r["to_m"]))
    least = defaultdict(lambda: math.inf)
    for a, b, n in edges:
        if a != b:
            least[min(a, b), max(a, b)] = min(least[min(a, b), max(a, b)], n)
    for (a, b), n in least.items():
        for k in range(int(n * 8)):
            u = k / 8 + 1 / 16
            d = min(far.get((1, a), math.inf) + u, far.get((1, b), math.inf) + n - u)
            assert any(f <= u <= t for f, t in got[a, b]) == (3.0 <= d <= 7.5)


def test_turned_tracks_are_the_chance(spark):
    """Two that travel together stand out; one that never moves far from the others does not, however often it meets them."""
    rng = random.Random(1)
    rows, minute = [], 60_000_000
    for i in range(200):
        lat, lon = 50 + 0.3 * math.sin(i / 9), 6 + 0.4 * math.cos(i / 7)
        rows += [("a", i * minute * 10, lat, lon), ("b", i * minute * 10 + 5_000_000, lat + 1e-4, lon)]
        rows += [("c", i * minute * 10, 51.0, 7.0), ("d", i * minute * 10 + 1, 51.0, 7.0), ("e", i * minute * 10, 50 + rng.random(), 6 + rng.random())]
    fixes = spark.createDataFrame(rows, "who string, us long, lat double, lon double")
    got = events.co_movement_tested(fixes, 2 * minute, 300.0, 0.0).collect()
    assert [(r["who_a"], r["who_b"]) for r in got] == [("a", "b")]
    assert got[0]["met"] == got[0]["close"] == 200 and got[0]["expected"] < 60 and got[0]["p_value"] < 1e-6
    assert events.co_movement_tested(fixes.limit(0), minute, 300.0, 0.0).count() == 0


def plain_parts(rows, parts, rounds):
    out = {}
    for label in {r[0] for r in rows}:
        own = sorted((i, np.array(v) / np.linalg.norm(v)) for lab, i, v in rows if lab == label and np.linalg.norm(v))
        centres = [own[0][1]]
        while len(centres) < parts:
            far = [(round(min(1 - v @ c for c in centres), 12), -i) for i, v in own]
            best = max(far)
            if best[0] <= 1e-9:
                break
            centres.append(next(v for i, v in own if -i == best[1]))
        for _ in range(rounds):
            near = [min(range(len(centres)), key=lambda c, v=v: (1 - v @ centres[c], c)) for _, v in own]
            sums = [sum((v for (_, v), n in zip(own, near, strict=True) if n == c), np.zeros(len(centres[0]))) for c in range(len(centres))]
            centres = [s / np.linalg.norm(s) if np.linalg.norm(s) else c for s, c in zip(sums, centres, strict=True)]
        out[label] = centres
    return out


def test_parts_equal_plain_k_means(spark):
    rng = np.random.default_rng(3)
    rows = [(i % 3, i, (rng.normal(size=4) + 5 * np.eye(4)[(i // 3) % 4]).tolist()) for i in range(90)]
    rows += [(7, 500, [1.0, 0.0, 0.0, 0.0]), (7, 501, [2.0, 0.0, 0.0, 0.0]), (0, 600, [0.0] * 4)]
    v = spark.createDataFrame([*rows, (None, 700, [1.0, 0.0, 0.0, 0.0])], "label int, id long, v array<double>")
    got = defaultdict(dict)
    for r in matching.sub_prototypes(v, "id", "v", "label", 3, 4).collect():
        got[r["label"]][r["part"]] = np.array(r["centre"])
    want = plain_parts(rows, 3, 4)
    assert set(got) == set(want) and len(got[7]) == 1
    for label, centres in want.items():
        assert len(centres) == len(got[label]) and all(np.abs(got[label][i] - c).max() < 1e-9 for i, c in enumerate(centres))
    assert matching.sub_prototypes(v.limit(0), "id", "v", "label", 2, 2).count() == 0


def test_places_apart_are_counted_in_order(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, rng.uniform(0, 50)]), rng.choice(["p", "q", "r", None]), rng.choice([None, 1.0, 6.0])) for i in range(400)]
    s = spark.createDataFrame(rows, "k string, i long, place double, stop string, span double").repartition(5)
    got = {r["k"]: r["places"] for r in hunting.places_apart(s, "k", ["i"], "place", "stop", "span", 4.0, 5).collect()}
    for key in ("a", "b", None):
        taken = []
        for _, _, at, stop, width in (r for r in rows if r[0] == key):
            if at is not None and len(taken) < 5 and all(abs(at - p) > max(4.0, width or 0) and (stop is None or stop != q) for p, q in taken):
                taken.append((at, stop))
        assert got[key] == len(taken)


def test_example_sets_keep_recordings_apart_and_originals_whole(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("xyz"), f"r{rng.randrange(40)}", rng.random() < 0.2) for i in range(1000)] + [(5000 + i, "w", None, True) for i in range(30)]
    found = [r.asDict() for r in registry.example_sets(spark.createDataFrame(rows, "id long, cls string, recording string, original boolean"), 100).collect()]
    sides = defaultdict(set)
    for r in found:
        sides[r["recording"]].add(r["split"])
    assert all(len(s) == 1 for s in sides.values())
    assert {r["id"] for r in found if r["original"]} == {i for i, _, _, o in rows if o}
    for cls in "xyz":
        train = [r for r in found if r["cls"] == cls and r["split"] == "train"]
        assert len(train) == max(100, sum(r["original"] for r in train))
    again = registry.example_sets(spark.createDataFrame(rows[::-1], "id long, cls string, recording string, original boolean").repartition(7), 100)
    assert Counter(r["id"] for r in found) == Counter(r["id"] for r in again.collect())


def test_masks_are_filled_by_what_stands_around(spark):
    texts = spark.createDataFrame([("the cat sat on the mat".split(),)] * 5 + [("a dog ran".split(),), (["alone"],), ([],), (None,)], "w array<string>")
    pairs = infill.pair_counts(texts, "w")
    assert {tuple(r) for r in pairs.collect()} >= {("the", "cat", 5), ("sat", "on", 5), ("a", "dog", 1)}
    canvas = spark.createDataFrame(
        [(1, i, w) for i, w in enumerate(["the", None, "sat", None, "the", "mat"])] + [(2, 0, None), (2, 1, None), (3, 0, "a"), (3, 1, None), (4, 0, "zebra")],
        "k long, at int, word string"
    )
    got = {(r["k"], r["at"]): (r["word"], r["round"]) for r in infill.fill(canvas, "k", pairs, 2).collect()}
    assert got[1, 1][0] == "cat" and got[1, 3][0] == "on" and got[3, 1][0] == "dog" and got[4, 0] == ("zebra", 0)
    assert got[2, 0][0] is not None and got[1, 0] == ("the", 0)
    empty = {(r["k"], r["at"]): r["word"] for r in infill.fill(canvas, "k", pairs.limit(0), 2).collect()}
    assert empty[2, 0] is None and empty[1, 0] == "the"
    s = {(r["k"], r["at"]): r["surprise"] for r in infill.surprise(spark.createDataFrame([(1, ["the", "cat", "zebra"]), (2, [])], "k long, w array<string>"), "k", "w", pairs).collect()}
    assert s[1, 1] < s[1, 0] and s[1, 1] < s[1, 2] and len(s) == 3


SETUP = detector.Setup(1000.0, 0.0, 64, 2, 1e-8, 1, 6, 10.0)


def bursts(n, spans, seed):
    x = 0.1 * noise(n, seed)
    for a, b, f in spans:
        x[a:b] += 0.35 * np.exp(2j * np.pi * f * np.arange(a, b))
    return x


def told(rows):
    return sorted((r["capture"], *(round(r[c], 6) for c in ("t0", "t1", "f_lo", "f_hi", "snr_db")), r["cells"], r["track"]) for r in rows)


def test_block_size_changes_nothing_and_a_burst_is_one_track(spark):
    spans = [(1500, 2300, 0.2), (3100, 3900, 0.2), (2000, 2900, -0.3)]
    x = {"a": bursts(6000, spans, 1), "b": 0.1 * noise(3000, 2)}
    want = None
    for size in (37, 64, 500, 6000):
        got = told(detector.detect_captures(blocks(spark, x, size), "capture", SETUP).collect())
        want = want or got
        assert got == want
    assert len(want) == 3 and {r[0] for r in want} == {"a"}
    by = {round((r[3] + r[4]) / 2): r for r in want}
    tracks = {r[7] for r in want if r[3] > 0}
    assert len(tracks) == 1 and len({r[7] for r in want}) == 2  # two bursts of one sender, one of another
    for r in want:
        a, b, f = min(spans, key=lambda s: abs(s[0] / 1000 - r[1]) + abs(s[2] * 1000 - (r[3] + r[4]) / 2))
        assert abs(r[1] - a / 1000) <= 0.13 and abs(r[2] - b / 1000) <= 0.13 and r[3] <= f * 1000 <= r[4]
    assert by


def test_a_gap_finishes_boxes_but_keeps_floor_and_tracks(spark):
    """After a gap a burst is found in the first rows, for the floor is known; a new machine would take it for the floor."""
    x = bursts(4000, [(1000, 4000, 0.2)], 3)
    m = detector.Machine(SETUP)
    first = m.feed(0, x[:2000])
    assert not first and m.open
    second = m.feed(10_000, x[2000:])
    assert len(second) == 1 and abs(second[0][1] - 2.0) < 0.13
    third = m.finish()
    assert len(third) == 1 and third[0][0] == 10.0 and third[0][6] == second[0][6] + (0 if third[0][0] - second[0][1] <= 10 else 1)
    fresh = detector.Machine(SETUP)
    assert not fresh.feed(10_000, x[2000:]) and not fresh.finish()


def test_stream_equals_batch(spark, tmp_path):
    x = {"a": bursts(6000, [(1500, 2300, 0.2), (4100, 4900, 0.2)], 1), "b": bursts(3000, [(1000, 1800, -0.2)], 5)}
    b = blocks(spark, x, 500)
    want = told(detector.detect_captures(b, "capture", SETUP).collect())
    timed = b.withColumn("event_time", F.timestamp_seconds(F.lit(86_400) + F.col("start") / 1000))
    last = timed.filter("start = 0").withColumns({"capture": F.lit("z"), "event_time": F.timestamp_seconds(F.lit(2 * 86_400))})
    for k in range(12):
        timed.filter(F.col("block") == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    last.limit(1).coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s")).withWatermark("event_time", "1 second")
    got = told(drained(detector.detect_stream(stream, "capture", SETUP), "machine"))
    assert [r for r in got if r[0] != "z"] == want and len(want) == 3


@pytest.mark.parametrize("rows", [[], [("a", 0)]])
def test_captures_without_bursts(spark, rows):
    b = blocks(spark, {"a": np.zeros(3, complex)}, 8)
    b = b.limit(0) if not rows else b
    assert detector.detect_captures(b, "capture", SETUP).count() == 0
