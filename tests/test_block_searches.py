"""Searches by parts of both sides, against comparing all."""

import math
import random

from evidentia.operators import hunting, spatial

FEATURE = "id long, conj boolean, value double, line double, low double, high double, resolution double, margin double"


def test_confirmations(spark):
    """Equal margins, features without a value, and several chunks in one bucket."""
    rng = random.Random(7)
    make = lambda i: (
        i, rng.random() < 0.4, None if i % 37 == 0 else rng.choice([1.0, 1.4, 2.9, 50.0]), rng.choice([900.0, 900.1, 950.0]), low := rng.randrange(20) * 1.0,
        low + rng.randrange(1, 9), rng.choice([0.1, 0.3]), float(rng.randrange(5))
    )
    first, second = [make(i) for i in range(200)], [make(i) for i in range(500, 1400)]
    frames = [spark.createDataFrame(x, FEATURE) for x in (first, second)]
    got = {r.id: (r.confirmed_by, r.margin) for r in hunting.confirmations(*frames, 2e-4, 0.5).collect()}

    def same(a, b):
        if a[1] != b[1]:
            return False
        if a[1]:
            return abs(a[3] - b[3]) <= 2e-4 * a[3]
        return None not in (a[2], b[2]) and abs(a[2] - b[2]) <= 3 * min(max(a[6], b[6]), 0.5) and a[4] < b[5] and b[4] < a[5]

    for a in first:
        m, o = max(((b[7], -b[0]) for b in second if same(a, b)), default=(None, None))
        assert got[a[0]] == (None if o is None else -o, m)


def test_confirmations_do_not_join(spark, capsys):
    rows = spark.createDataFrame([(1, False, 1.0, 1.0, 0.0, 1.0, 0.1, 1.0)], FEATURE)
    hunting.confirmations(rows, rows, 2e-4, 0.5).explain("simple")
    plan = capsys.readouterr().out
    assert plan.count("CoGroup") == 2 and "value_b" not in plan


def test_fingerprints(spark, capsys):
    rng = random.Random(8)
    heard = [(q, rng.randrange(6), -rng.uniform(40, 110)) for q in range(60) for _ in range(3)] + [(70, 99, -50.0), (71, 1, None)]
    known = [(p, k, -rng.uniform(40, 110)) for p in range(40) for k in range(6) if rng.random() < 0.5]
    h, k = spark.createDataFrame(heard, "qid long, key int, level double"), spark.createDataFrame(known, "place string, key int, level double")
    df = spatial.fingerprint_loglik(h, k)
    df.explain("simple")
    assert "hashpartitioning(qid" not in capsys.readouterr().out
    t = lambda d: -2.5 * math.log1p((d / 6) ** 2 / 4)
    levels = {}
    for p, key, level in known:
        levels.setdefault(str(p), {})[key] = level
    want = {}
    for q in {q for q, _, _ in heard}:
        own = [(key, level) for i, key, level in heard if i == q]
        for p, its in levels.items():
            shared = [(key, level) for key, level in own if key in its]
            if shared:
                want[q, p] = len(shared), sum(t(v - its[key]) if key in its else t(v + 110) for key, v in own if v is not None)
    got = {(r.qid, r.place): (r.shared, r.loglik) for r in df.collect()}
    assert got.keys() == want.keys() and all(got[x][0] == n and abs(got[x][1] - v) < 1e-9 for x, (n, v) in want.items())
