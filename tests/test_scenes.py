"""Groups of cells, and registries."""

import numpy as np
from pyspark.sql import functions as F

from evidentia.kernels import scenes
from evidentia.operators import registry


def test_boxes():
    m = np.zeros((8, 8), bool)
    m[1, 1:4] = m[2, 4] = m[4, 4] = True
    m[7, 0] = True
    assert scenes.mask_components(m) == [(1, 5, 1, 5, 5), (7, 8, 0, 1, 1)]


def test_registries(spark, tmp_path):
    cards = spark.createDataFrame(
        [
            ("m", 1, "finder", "p", ["a"], "h", {"recall": 0.9, "false_rate": 0.0}, False),
            ("m", 2, "finder", "p", ["a"], "h", {"recall": 0.9}, True), ("n", 1, "recognizer", "q", [], "h", {}, False)
        ],
        registry.CARD
    )
    assert registry.usable(cards, "p", "finder").count() == 0 and registry.usable(cards.filter("version = 1"), "p", "finder").count() == 1
    assert {r.w for r in cards.select(registry.refusal("p", "finder", F.lit("h")).alias("w")).collect()} == {None, "retired", "made for q"}
    assert cards.filter("version = 1 AND name = 'm'").select(registry.verdict("finder").alias("v")).first().v == "good"
    ex = spark.createDataFrame(
        [
            (1, "r", 0, 10, "original", "train", False), (2, "r", 5, 15, "original", "train", False), (3, "r", 10, 20, "original", "train", True),
            (4, "s", 0, 9, "original", "test", False)
        ],
        "id long, recording string, start long, stop long, kind string, role string, removed boolean"
    )
    assert [(r.id, r.id_b) for r in registry.overlapping_examples(ex, 8).collect()] == [(1, 2)]
    gone = registry.remove(ex, ex.filter("id = 2"))
    assert registry.overlapping_examples(gone, 8).count() == 0 and not registry.remove(gone, ex, back=True).filter("removed").count()
    assert registry.set_role(ex, "r", "val").filter("role = 'val'").count() == 3
    registry.build(spark, lambda seed, i: {"x": float(i * seed)}, 200, str(tmp_path / "d"), "x double", 3)
    back = spark.read.parquet(str(tmp_path / "d"))
    assert back.count() == 200 and {r.split for r in back.select("split").distinct().collect()} == {"train", "val", "test"}
    assert registry.manifest(spark, str(tmp_path / "d")).filter("length(sha256) = 64").count() > 0
    np.savez(tmp_path / "a.npz", x=np.zeros((3, 4), np.float32), y=np.zeros(2))
    got = {r.name: (r["shape"], r.kind) for r in registry.shards(spark.read.format("binaryFile").load(str(tmp_path / "a.npz"))).collect()}
    assert got == {"x": ([3, 4], "float32"), "y": ([2], "float64")}
    assert registry.recipe([{"b": 1, "a": 2}])[0] == '[{"a":2,"b":1}]'
    assert spark.range(1).select(
        registry.report(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit(None).cast("string"))).alias("m")
    ).first().m == "- **a**: not known\n- **b**: 2"
