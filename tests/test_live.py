"""Streams, driven to their end by files."""

import numpy as np
from pyspark.sql import functions as F

from evidentia.streaming import live


#: Streams drop what is not later than the first watermark, which is 1970.
DAY = 86_400_000_000


def drained(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


def stream(spark, rows, schema, path, files=1):
    spark.createDataFrame(rows, schema).repartition(files).write.parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def test_windows_and_sessions(spark, tmp_path):
    rows = [(i % 3, DAY + i * 60_000_000, "k", 1.0) for i in range(60)] + [(9, DAY + 10 * 3_600_000_000, "k", 0.0)]
    s = live.with_time(stream(spark, rows, "who long, us long, kind string, value double", str(tmp_path / "a")))
    got = drained(live.activity(s, "kind", "30 minutes"), "activity", "complete")
    assert sorted(r.n for r in got) == [1, 30, 30]
    s = live.with_time(stream(spark, rows, "who long, us long, kind string, value double", str(tmp_path / "b")))
    assert {r.n for r in drained(live.sessions(s, "who", "10 minutes"), "sessions", "complete")} == {20, 1}
    s = live.with_time(stream(spark, rows + rows, "who long, us long, kind string, value double", str(tmp_path / "c")))
    assert len(drained(live.new_only(s, "us", "who"), "fresh")) == 61


def test_floor_follows_and_signals_do_not_move_it(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [("r", i, rng.gamma(20, 1 / 20, 32).tolist()) for i in range(60)]
    for i in range(40, 60):
        rows[i][2][5] += 100
    got = sorted(
        drained(live.noise_floor(stream(spark, rows, "receiver string, us long, power array<double>", str(tmp_path / "a"))), "floor"),
        key=lambda r: r.us
    )
    assert len(got) == 60 and got[0].above == [0.0] * 32
    last = np.array(got[59].above)
    assert last[5] > 18 and np.abs(np.delete(last, 5)).max() < 4


def test_tracks(spark, tmp_path):
    boxes = [("s", float(t), t + 0.2, 100.0, 112.0, "A") for t in range(100, 120)] + [
        ("s", float(t), t + 0.3, 300.0, 325.0, "B") for t in range(100, 120, 2)
    ] + [("s", 160.0, 160.1, 10.0, 12.0, None)]
    s = stream(
        spark, boxes, "stream string, t0 double, t1 double, f_lo double, f_hi double, cls string", str(tmp_path / "a")
    ).withColumn("event_time", F.timestamp_micros((F.col("t0") * 1_000_000).cast("long"))).withWatermark("event_time", "1 second")
    got = drained(live.tracker(s), "tracks")
    assert {(r.cls, r.bursts) for r in got} >= {("A", 20), ("B", 10)}


def test_assignment_prefers_the_total():
    tracks, _, n, _ = live.track_step([], [(0.0, 1.0, 0.0, 10.0, ""), (0.0, 1.0, 8.0, 18.0, "")], 0)
    _, _, n, owner = live.track_step(tracks, [(1.5, 2.0, 6.0, 16.0, ""), (1.5, 2.0, 1.0, 11.0, "")], n)
    assert owner == [1, 0] and n == 2


def test_triggers_rest(spark, tmp_path):
    rows = [("a", i * 10_000_000, 0.5) for i in range(10)] + [("a", 5, 0.9), ("b", 0, 0.4)]
    got = drained(live.triggers(stream(spark, rows, "region string, us long, score double", str(tmp_path / "a"))), "asks")
    assert sorted((r.region, r.us) for r in got) == [("a", 0), ("a", 30_000_000), ("a", 60_000_000), ("a", 90_000_000), ("b", 0)]


def test_epochs(spark):
    rows = [("r", 0, 1e6, 5e6, 100), ("r", 100, 1e6, 5e6, 100), ("r", 200, 1e6, 6e6, 100), ("r", 500, 1e6, 6e6, 100)]
    got = live.epochs(spark.createDataFrame(rows, "receiver string, start long, rate double, centre_hz double, n long")).orderBy("start").collect()
    assert [r.epoch for r in got] == [0, 0, 1, 2]
