"""The detector from samples to labels, against planted bursts and pure noise."""

import numpy as np

from evidentia.operators import detection, pipeline

RATE, SIZE = 256_000.0, 256


def blocks_of(spark, name, x, block=4096):
    rows = [
        (name, at, x[at : at + block].real.astype(float).tolist(), x[at : at + block].imag.astype(float).tolist()) for at in range(0, len(x), block)
    ]
    return spark.createDataFrame(rows, "capture_id string, start long, re array<float>, im array<float>").repartition(3)


def noise(n, seed):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=n) + 1j * rng.normal(size=n)) / np.sqrt(2)


def test_bursts_are_found_once_and_noise_gives_none(spark):
    n = int(RATE)
    x, t = noise(n, 1), np.arange(n) / RATE
    planted = [(0.10, 0.18, 20_000.0), (0.30, 0.62, -50_000.0), (0.70, 0.74, 90_000.0)]
    for t0, t1, hz in planted:
        x = x + np.where((t >= t0) & (t < t1), 0.5 * np.exp(2j * np.pi * hz * t), 0)
    layout = detection.tile_layout(RATE, SIZE, 0.25, 64)
    assert layout == {"pool": 4, "rows": 64, "step": 32}
    both = blocks_of(spark, "a", x).unionByName(blocks_of(spark, "still", noise(n, 2)))
    got = pipeline.detect(both, RATE, 1e6, layout, SIZE, pfa=1e-6).collect()
    assert {r.capture_id for r in got} == {"a"}
    for t0, t1, hz in planted:
        own = [r for r in got if r.f_lo <= 1e6 + hz <= r.f_hi]
        assert abs(sum(r.t1 - r.t0 for r in own) - (t1 - t0)) < 0.02 and abs(min(r.t0 for r in own) - t0) < 0.01 and all(
            r.snr_db > 5 and r.f_hi - r.f_lo < 6000 for r in own
        )
        spans = sorted((r.t0, r.t1) for r in own)
        assert all(a[1] <= b[0] + 1e-9 for a, b in zip(spans, spans[1:], strict=False))
    assert sum(any(r.f_lo <= 1e6 + hz <= r.f_hi for _, _, hz in planted) for r in got) == len(got)


def test_labels_of_one_source_are_replaced(spark):
    x = noise(65_536, 3) + np.where(np.arange(65_536) // 8192 == 4, 0.7, 0)
    boxes = pipeline.detect(blocks_of(spark, "a", x), RATE, 0.0, detection.tile_layout(RATE, SIZE, 0.25, 64), SIZE, pfa=1e-6)
    old = spark.createDataFrame(
        [("a", 1, 2, 0.0, 1.0, "hand"), ("a", 1, 2, 0.0, 1.0, "finder")],
        "capture_id string, sample_start long, sample_count long, f_lo double, f_hi double, source string"
    )
    got = pipeline.relabelled(old, boxes, RATE, "finder").collect()
    assert [r for r in got if r.source == "hand"] and sum(r.source == "finder" for r in got) == boxes.count() >= 1
    assert all(abs(r.sample_start - 32_768) <= 2048 for r in got if r.source == "finder")


def test_empty_and_short_captures(spark):
    none = spark.createDataFrame([], "capture_id string, start long, re array<float>, im array<float>")
    layout = detection.tile_layout(RATE, SIZE, 0.25, 64)
    assert pipeline.detect(none, RATE, 0.0, layout, SIZE).count() == 0
    assert pipeline.detect(blocks_of(spark, "a", noise(300, 4)), RATE, 0.0, layout, SIZE).count() == 0
