"""First answers by a walk back in time, against comparing all."""

import random

import pytest

from evidentia.operators import events


@pytest.mark.parametrize("same", [False, True])
def test_first_within(spark, same):
    """Many times alike, long runs of one key, spans with borders, and rows without a key or a time."""
    rng = random.Random(5)
    some = lambda n, end: [(i, None if i % 23 == 0 else rng.choice([1, 1, 1, 2, 3]), None if i % 31 == 0 else rng.randrange(-end, end)) for i in range(n)]
    left, right = some(150, 400), some(200, 400)
    a, b = (spark.createDataFrame(x, "id long, who long, us long") for x in (left, right))
    got = {r.id: (r.hit_id, r.hit_key, r.delay_us) for r in events.first_within(a, b, "who", 2, 9, same).collect()}
    assert len(got) == len(left)
    for i, k, t in left:
        ok = [(u, j, h) for j, h, u in right if None not in (k, h, t, u) and (k == h) == same and 2 <= u - t <= 9]
        u, j, h = min(ok, default=(None, None, None))
        assert got[i] == (j, h, None if u is None else u - t)


def test_calls_do_not_meet_all_hits(spark, capsys):
    """No join by time: the work of a call does not grow with the hits in its reach."""
    e = spark.createDataFrame([(i, i % 7, i * 10, "ab"[i % 2]) for i in range(50)], "id long, who long, us long, kind string")
    events.first_within(e.filter("kind = 'a'"), e.filter("kind = 'b'"), "who", 5, 1000).explain("simple")
    events.call_response(e, "kind", 5, 1000).explain("simple")
    plan = capsys.readouterr().out
    assert "bucket" not in plan and "Window" in plan


def test_call_response(spark):
    rng = random.Random(6)
    rows = [(i, rng.randrange(4), rng.randrange(3000), rng.choice("abc")) for i in range(300)]
    got = {(r.a_kind, r.b_kind): (r.answered, r.delay_us) for r in events.call_response(spark.createDataFrame(rows, "id long, who long, us long, kind string"), "kind", 3, 30).collect()}
    want = {}
    for _, w, t, k in rows:
        for other in set("abc") - {k}:
            delays = [u - t for _, v, u, o in rows if o == other and v != w and 3 <= u - t <= 30]
            if delays:
                want.setdefault((k, other), []).append(min(delays))
    assert {k: (n, round(d, 6)) for k, (n, d) in got.items()} == {k: (len(d), round(sum(d) / len(d), 6)) for k, d in want.items()}
