"""Profiles, classes, hunting and text kernels."""

import pytest
from pyspark.sql import functions as F

from evidentia.functions import profiles
from evidentia.operators import hunting


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_profiles(spark):
    r = one(
        spark, profiles.make_id(F.lit("rtl"), F.lit(2_400_000), F.lit("cu8")).alias("i"), profiles.parse_id(F.lit("rtl_2400000_cu8_hot")).alias("p"),
        profiles.parse_id(F.lit("rtl_x")).alias("n"), profiles.width_class(F.lit(30_000)).alias("w"),
        profiles.canonical_rate(F.lit(2_400_000), 48_000).alias("c")
    )
    assert r.i == "rtl_2400000_cu8" and tuple(r.p) == ("rtl", 2_400_000, "cu8", "hot") and r.n is None and r.w == "narrow" and r.c == 48_000
    with pytest.raises(Exception, match="not a profile"):
        one(spark, profiles.make_id(F.lit("R TL"), F.lit(1), F.lit("cu8")))
    with pytest.raises(Exception, match="profiles differ"):
        profiles.same_profile(spark.createDataFrame([("a", "b")], "x string, y string"), "x", "y").collect()


def test_classes(spark):
    table = profiles.class_table(spark)
    boxes = spark.createDataFrame([(1, 12_000.0), (2, 200_000.0), (3, 9e9)], "id long, width_hz double")
    got = {r.id: r["class"] for r in profiles.nearest_class(boxes, table).collect()}
    assert got[2] == "fm-broadcast" and got[1] in ("dmr", "nfm-voice") and got[3] is None
    assert profiles.cycle_frequencies(table).filter("name = 'dab' AND abs(alpha_hz - 1000) < 1e-6").count() == 1
    tools = spark.createDataFrame([("dmr", "b", 2), ("dmr", "a", 1)], "cls string, tool string, rank int")
    got = {
        r.id: r.tools for r in profiles.tools_for(spark.createDataFrame([(1, "dmr"), (2, None)], "id long, cls string"), tools, ["a", "z"]).collect()
    }
    assert got == {1: ["a", "b", "z"], 2: ["a", "z"]}
    bands = spark.createDataFrame([(1, 430.0, 440.0)], "id long, low double, high double")
    alloc = spark.createDataFrame([("x", 420.0, 432.0), ("y", 440.0, 450.0), ("z", 435.0, 436.0)], "name string, low double, high double")
    assert {(r.name, r.low, r.high) for r in profiles.allocations_in(bands, alloc, 5.0).collect()} == {("x", 430.0, 432.0), ("z", 435.0, 436.0)}


def test_goals(spark):
    goal = hunting.parse_goal("Find new bursty paging between 430-440 MHz narrower than 25 kHz")
    assert goal == hunting.Goal(430e6, 440e6, None, 25e3, "paging", True, True)
    rows = [
        (1, 435e6, 435.01e6, "paging", False, 0.1), (2, 435e6, 435.01e6, None, False, 0.1), (3, 435e6, 435.01e6, "paging", True, 0.1),
        (4, 435e6, 435.01e6, "paging", False, 0.6)
    ]
    got = spark.createDataFrame(
        rows, "id long, f_lo double, f_hi double, family string, known boolean, duty double"
    ).select("id", hunting.matches(goal).alias("m")).collect()
    assert [r.m for r in got] == [True, None, False, None]
    stops, wrong = hunting.parse_stops("144-144.05 MHz step 25 kHz, 433.92 MHz, 433.92 MHz, x, 5-1 MHz step 1 kHz")
    assert stops == pytest.approx([144e6, 144.025e6, 144.05e6, 433.92e6]) and len(wrong) == 2
    stops, wrong = hunting.parse_stops("433.92, 440-445 MHz, 144 - 145 MHz step 500 kHz", width_hz=2e6)
    assert stops == pytest.approx([433.92e6, 440.5e6, 442.5e6, 444.5e6, 144e6, 144.5e6, 145e6]) and not wrong


def test_hunts(spark):
    cells = spark.createDataFrame(
        [(0, 1e6, 0.0, 1, 0, 2e6), (1, 2.1e6, 0.0, 0, 0, 2e6), (2, 9e6, 0.0, 0, 0, 2e6)],
        "cell long, centre_hz double, looked double, looks long, finds long, here_hz double"
    )
    assert hunting.next_cell(cells, 0, 10.0).first().cell == 1
    acts = spark.createDataFrame(
        [("look", 1e6, None), ("dwell", 1e6, 99.0), ("jump", 1e6, 1.0), ("look", 9e9, None), ("stop", None, None)],
        "kind string, centre_hz double, dwell_s double"
    )
    assert [r.v.ok for r in acts.select(hunting.valid_action(1e5, 1e9, 10).alias("v")).collect()] == [True, False, False, False, True]
    bursts = spark.createDataFrame(
        [(1, 0.0, 2.0, 1.0, 2.0), (2, 1.0, 3.0, 1.0, 2.0), (3, 9.0, 9.5, 1.0, 2.0)], "burst long, t0 double, t1 double, f_lo double, f_hi double"
    )
    finds = spark.createDataFrame([(1, 1.5, 1.5), (2, 5.0, 1.5), (3, 9.9, 1.5)], "find long, t double, centre_hz double")
    scored = hunting.score_finds(finds, bursts)
    assert {(r.find, r.burst) for r in scored.collect()} == {(1, 1), (2, None), (3, 3)}
    r = hunting.hunt_summary(scored, bursts).first()
    assert (r.bursts, r.found, r.false_marks) == (3, 2, 1) and r.wait_s == pytest.approx(1.2)
    d = spark.createDataFrame(
        [(1, 0.0, 100.0, 10.0), (2, 0.3, 101.0, 10.0), (3, 2.0, 100.0, 10.0)], "find long, t double, centre_hz double, width_hz double"
    )
    assert sorted(x.find for x in hunting.distinct_finds(d).collect()) == [1, 3]
    lines = spark.createDataFrame([(1, 10.0, 1.0), (2, 10.4, 3.0), (3, 20.0, 1.0)], "id long, hz double, margin double")
    assert {(x.hz, x.members) for x in hunting.merge_lines(lines, 0.5).collect()} == {(10.4, 2), (20.0, 1)}
    assert one(spark, hunting.detection_verdict(F.lit(0.95), F.lit(0.001)).alias("v")).v == "good"
