"""Every query with SQL against DuckDB on the smallest tables."""

import math
import random
import re

import duckdb
import numpy as np
import pytest

from evidentia import catalog
from evidentia.kernels import fields, repair
from evidentia.operators import matching, metrics
from evidentia.plans import table_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return float(v) if not isinstance(v, str | bool) and hasattr(v, "__float__") else v


def alike(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 2e-4 * max(1.0, abs(a)))


def ordered(rows):
    return sorted(rows, key=lambda r: [(v is None, "" if v is None else f"{v:+020.3f}" if isinstance(v, float) else str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_duckdb(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    got = ordered([plain(v) for v in r] for r in df.select(*columns).collect())
    want = ordered([plain(v) for v in r] for r in want)
    assert len(got) == len(want)
    assert all(alike(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() >= 0


def test_word_errors_by_plain_counting(spark, sf):
    """Errors of turns of conversations against an edit distance by hand, and their sum."""
    got = {(r.conv_id, r.turn): r for r in catalog.QUERIES["conversation_word_errors"](spark, sf).collect()}
    texts = {(r.conv_id, r.turn): repair.normalised(r.text).split() for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    assert len(got) == sum((c, t + 1) in texts for c, t in texts)
    for (c, t), r in [*got.items()][:60]:
        a, b = texts[c, t], texts[c, t + 1]
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row = [i + 1, *row[1:]] if not b else [*_next(row, i, x, b)]
        assert r.subs + r.dels + r.ins == row[-1] and r.words == len(a) and r.hits == len(a) - r.subs - r.dels
    total = catalog.QUERIES["corpus_word_error_rate"](spark, sf).first()
    assert total.words == sum(r.words for r in got.values()) and total.subs == sum(r.subs for r in got.values())
    assert abs(total.wer - (total.subs + total.dels + total.ins) / total.words) < 1e-6


def _next(row, i, x, b):
    out = [i + 1]
    for j, y in enumerate(b):
        out.append(min(row[j] + (x != y), row[j + 1] + 1, out[j] + 1))
    return out


def test_unusual_lines_equal_numpy(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").toPandas()
    x = np.column_stack(
        [
            np.log1p(rows.l_extendedprice.astype(float)), np.log1p(rows.l_quantity.astype(float)), rows.l_discount.astype(float),
            rows.l_tax.astype(float)
        ]
    )
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    values, vectors = np.linalg.eigh(np.cov(z.T, bias=True))
    order = np.argsort(-values)
    keep = vectors[:, order[: int(np.searchsorted(np.cumsum(values[order]) / values.sum(), 0.7)) + 1]]
    want = dict(zip((rows.l_orderkey * 10 + rows.l_linenumber).tolist(), np.sqrt(((z - z @ keep @ keep.T) ** 2).mean(axis=1)).tolist(), strict=True))
    got = {r.id: r.error for r in catalog.QUERIES["unusual_lines"](spark, sf).collect()}
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 2e-5 for i in want)


def test_kriged_balances_equal_single_solves(spark, sf):
    p = table_queries._places(spark, sf).collect()
    samples = [r for r in p if r.id % 3]
    got = {r.id: r for r in catalog.QUERIES["kriged_balances"](spark, sf).collect()}
    k = math.pi / 180 * 6_371_000.0
    for r in [r for r in p if r.id % 3 == 0][:20]:
        far = lambda s, r=r: 2 * 6_371_000.0 * math.asin(math.sqrt(math.sin(math.radians(s.lat - r.lat) / 2) ** 2 + math.cos(math.radians(r.lat)) * math.cos(math.radians(s.lat)) * math.sin(math.radians(s.lon - r.lon) / 2) ** 2))
        near = sorted((far(s), s.id, s) for s in samples if far(s) <= 15_000)[:12]
        if not near:
            assert r.id not in got
            continue
        xy = np.array([((s.lon - r.lon) * k * math.cos(math.radians(r.lat)), (s.lat - r.lat) * k) for _, _, s in near])
        z, sigma = fields.krige(xy, np.array([s.value for _, _, s in near]), np.zeros((1, 2)), 1e5, 1e6, 10_000)
        assert abs(got[r.id].estimate - z[0]) < 0.01 and abs(got[r.id].sigma - sigma[0]) < 0.01


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 120
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_pulse_trains_hold_every_event(spark, sf):
    got = catalog.QUERIES["event_pulse_trains"](spark, sf).filter("tier = 'measured'").groupBy("scene").count()
    want = spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_filters_reach_the_scan(spark, sf, capsys):
    catalog.QUERIES["loud_runs"](spark, sf).explain("formatted")
    plan = capsys.readouterr().out
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,value:double>" in plan


#: A total of one row whose condition the optimizer moves into the join; style_divergence compares every two groups, which is its result.
ONE_ROW = ("bearing_cells", "label_operating_point", "price_quantile", "style_divergence", "user_links")


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_joins_are_by_equality(spark, sf, capsys, name):
    """No product of tables, and no loop over pairs but with the one row of a sum over everything (with a condition in ``ONE_ROW``)."""
    catalog.QUERIES[name](spark, sf).explain("simple")
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan
    for line in plan.splitlines():
        if "BroadcastNestedLoopJoin" in line and name not in ONE_ROW:
            assert re.search(r"BroadcastNestedLoopJoin Build\w+, (Inner|Cross)$", line.rstrip()), line


def test_banks_in_many_blocks(spark, sf, monkeypatch):
    """A bank in many blocks, dealt in parts, gives what one block gives."""
    want = sorted(map(tuple, catalog.QUERIES["prototype_classes"](spark, sf).collect()))
    monkeypatch.setattr(matching, "FEW", 1)
    monkeypatch.setattr(matching.with_blocks, "__defaults__", (3,))
    assert sorted(map(tuple, catalog.QUERIES["prototype_classes"](spark, sf).collect())) == want


def test_ranks_by_plain_counting(spark):
    """Kendall's tau from running totals against all pairs."""
    rng = random.Random(3)
    rows = [(rng.randrange(9), rng.choice([None, *range(13)]) if rng.random() < 0.1 else rng.randrange(13)) for _ in range(400)]
    pairs = [(a, b) for a, b in rows if b is not None]
    n, s, ta, tb = len(pairs), 0, 0, 0
    for i, (a, b) in enumerate(pairs):
        for c, d in pairs[:i]:
            s += ((a > c) - (a < c)) * ((b > d) - (b < d))
            ta += a == c
            tb += b == d
    got = metrics.kendall_tau_b(spark.createDataFrame(rows, "a int, b int"), "a", "b").first()
    every = n * (n - 1) / 2
    assert got.n == n and abs(got.tau_b - s / math.sqrt((every - ta) * (every - tb))) < 1e-9
