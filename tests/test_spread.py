"""Work that is spread over tasks, or no longer grows with how dense values lie."""

import random

from evidentia.functions import profiles
from evidentia.operators import matching


def test_ledgers_by_plain_search(spark, capsys):
    """Dense ledgers: a feature meets one row of each."""
    rng = random.Random(9)
    values = [rng.choice([None, -1.0, *(round(rng.uniform(-3, 3), 2) for _ in range(9))]) for _ in range(300)]
    known = [[round(rng.uniform(-3, 3), 2) for _ in range(n)] for n in (20, 60)]
    frames = [spark.createDataFrame([(v,) for v in k + k + [None]], "value double") for k in known]
    df = matching.ledger_labels(spark.createDataFrame(list(enumerate(values)), "id long, value double"), [("a", frames[0], 0.05), ("b", frames[1], 0.2)])
    df.explain("simple")
    assert "known" not in capsys.readouterr().out
    for r in df.collect():
        near = lambda k, t, v=r.value: v is not None and any(abs(v - x) <= t for x in k)
        assert r.label == ("a" if near(known[0], 0.05) else "b" if near(known[1], 0.2) else "new")


def test_bands_of_one_file_are_many_tasks(spark):
    bands = spark.createDataFrame([(i, i * 1.0, i + 20.0) for i in range(100)], "id long, low double, high double").coalesce(1)
    table = spark.createDataFrame([("x", 5.0, 50.0)], "name string, low double, high double").coalesce(1)
    found = profiles.allocations_in(bands, table, 25.0)
    assert len({r.id for r in found.collect()}) == 50 and found.rdd.getNumPartitions() == 4


def test_blocks_that_all_rows_meet_are_many_tasks(spark, monkeypatch):
    """Few bytes of rows and blocks are not made one task, for every row meets every block."""
    monkeypatch.setattr(matching, "FEW", 1)
    met = matching.with_blocks(spark.range(40), spark.range(90).withColumnRenamed("id", "b"), 3)
    met.write.format("noop").mode("overwrite").save()
    assert met.rdd.getNumPartitions() == 4 and met.selectExpr("sum(size(_block))").first()[0] == 40 * 90
