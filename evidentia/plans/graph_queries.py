"""Queries of movement and its chance, networks, parts of classes, sightings, example sets, filled masks, and the detector's machine."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.operators import events, hunting, infill, matching, registry, roads
from evidentia.plans import event_queries as ev
from evidentia.plans import planning_queries as pq
from evidentia.plans import series_queries as sq
from evidentia.plans import table_queries as tq
from evidentia.streaming import detector


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _rounded(df, digits, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


def detected_boxes(spark, sf):
    """Boxes and tracks of all captures; the false alarms are set high, for the captures hold no bursts by design."""
    return detector.detect_captures(sq._blocks(spark, sf), "capture", detector.Setup(16.0, 0.0, 8, 2, 0.05, 1, 2, 4.0))


def co_moving_users(spark, sf):
    """Users whose fixes stay closer than their tracks turned in time."""
    found = events.co_movement_tested(pq._fixes(spark, sf), 600_000_000, 900.0, 1.0, 2, 0.8, 0.5, 4)
    return _rounded(found, 4, "expected", "lift", "p_value")


def user_links(spark, sf):
    """Edges of users by kind, each with its own chance: in the same hours, answers within five minutes, and movement."""
    e = ev._ev(spark, sf)
    near = events.co_occurrence(e, 3_600_000_000, 3, 0.01)
    answers = events.answered_pairs(e, 500_000, 300_000_000, 2, 0.05)
    moving = events.co_movement_tested(pq._fixes(spark, sf), 600_000_000, 900.0, 1.0, 2, 0.8, 0.5, 4)
    found = events.social_links(together=(near, False, "together"), answer=(answers, True, "count"), movement=(moving, False, "close"))
    return _rounded(found, 4, "lift", "p_value", "weight")


def _network(spark, sf):
    """Suppliers and parts, joined by the least quantity of a line."""
    li = _t(spark, sf, "lineitem")
    return li.select((-F.col("l_suppkey") - 1).alias("a"), F.col("l_partkey").alias("b"), F.col("l_quantity").alias("length"))


def _sources(spark, sf):
    return _t(spark, sf, "supplier").filter("s_nationkey IN (3, 8)").select(
        F.col("s_suppkey").alias("source"), (-F.col("s_suppkey") - 1).alias("node"), F.lit(0.0).alias("cost")
    )


def road_reach(spark, sf):
    """What the suppliers of two nations reach within a distance of three, by lines as edges."""
    return roads.reach(_network(spark, sf), _sources(spark, sf), 3.0)


def road_stretches(spark, sf):
    edges = _network(spark, sf)
    return roads.stretches(edges, roads.reach(edges, _sources(spark, sf), 2.0), 1.25, 2.5).select("source", "a", "b", "from_m", "to_m")


def snapped_places(spark, sf):
    """Customers on the nearest of short roads that begin at suppliers."""
    points = tq._places(spark, sf).select("id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    ways = tq._places(spark, sf, "supplier", "s_suppkey", "s_acctbal").select(
        F.col("id").alias("edge"), F.col("lon").alias("ax"), F.col("lat").alias("ay"), (F.col("lon") + 0.2).alias("bx"), (F.col("lat") + 0.1).alias("by")
    )
    return _rounded(roads.snap(points, ways, 0.15), 6, "share", "metres")


def label_parts(spark, sf):
    """Each label of the embeddings in two parts: their sizes and where their centres lie."""
    parts = matching.sub_prototypes(_t(spark, sf, "embeddings"), "vec_id", "embedding", "label", 2, 2)
    return parts.select("label", "part", "n", F.round(parts["centre"][0], 5).alias("c0"), F.round(parts["centre"][63], 5).alias("c63"))


def taught_centres(spark, sf):
    """A bank of two thirds of the embeddings taught with the rest: sums of sums."""
    v = _t(spark, sf, "embeddings").select("label", "vec_id", F.col("embedding").alias("v"))
    first, more = (matching.vector_sums(v.filter(f"vec_id % 3 {op} 0"), ["label"]) for op in ("<>", "="))
    t = matching.taught(first, more, ["label"]).withColumn("centre", matching.unit("total"))
    return t.select("label", "n", F.round(t["centre"][0], 5).alias("c0"), F.round(t["centre"][63], 5).alias("c63"))


def sighted_apart(spark, sf):
    """How many places of each user's events, by value, lie apart and at different kinds of event, four at most."""
    e = ev._ev(spark, sf, "value", "event_type")
    rows = e.select("who", "us", "id", "value", "event_type", (F.col("value") / 10).alias("span"))
    return hunting.places_apart(rows, "who", ["us", "id"], "value", "event_type", "span", 5.0, 4)


def confirmed_lines(spark, sf):
    """Parts of even keys as features of a first look, confirmed by those of odd keys."""
    p = _t(spark, sf, "part")
    features = p.select(
        F.col("p_partkey").alias("id"), (F.col("p_size") % 3 == 0).alias("conj"), F.col("p_retailprice").cast("double").alias("value"),
        (F.col("p_retailprice") * 10).cast("double").alias("line"), (F.col("p_partkey") % 97).cast("double").alias("low"),
        (F.col("p_partkey") % 97 + F.col("p_size")).cast("double").alias("high"), (F.col("p_size") / 100).alias("resolution"),
        F.col("p_size").cast("double").alias("margin")
    )
    return hunting.confirmations(features.filter("id % 2 = 0"), features.filter("id % 2 = 1"), 2e-4, 0.5)


def training_sets(spark, sf):
    """Lines as examples of their flag, recorded by suppliers; those with a discount are copies."""
    li = _t(spark, sf, "lineitem")
    examples = li.select(
        (F.col("l_orderkey") * 1_000_000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("id"), F.concat("l_returnflag", "l_linestatus").alias("cls"),
        F.col("l_suppkey").alias("recording"), (F.col("l_discount") == 0).alias("original")
    )
    found = registry.example_sets(examples, 600, 0.2, 7)
    return found.groupBy("split", "cls", "original").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("id") % 1_000_003).alias("ids"))


def example_windows(spark, sf):
    p = _t(spark, sf, "part").select("p_partkey", (F.col("p_size") * 7).cast("long").alias("samples"))
    return registry.spread_windows(p, "samples", 40, 4)


def _words(df):
    return df.withColumn("words", F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))


def word_surprise(spark, sf):
    """The words of the benchmark that the documents make least likely: sum and greatest surprise of each item."""
    found = infill.surprise_in(_words(_t(spark, sf, "benchmark")), "item_id", "words", _words(_t(spark, sf, "documents")), "words")
    return _rounded(found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.sum("surprise").alias("total"), F.max("surprise").alias("most")), 4, "total", "most")


def filled_masks(spark, sf):
    """Every sixth word of the benchmark masked and filled in two rounds from the documents' pairs of words."""
    pairs = infill.pair_counts(_words(_t(spark, sf, "documents")), "words")
    canvas = _words(_t(spark, sf, "benchmark")).select("item_id", F.posexplode("words").alias("at", "word")).withColumn(
        "word", F.when(F.col("at") % 6 != 3, F.col("word"))
    )
    return _rounded(infill.fill(canvas, "item_id", pairs, 2, 4).filter("round > 0"), 8, "score").withColumnRenamed("at", "pos")


QUERIES = {
    f.__name__: f for f in (
        detected_boxes, co_moving_users, user_links, road_reach, road_stretches, snapped_places, label_parts, taught_centres, sighted_apart, confirmed_lines,
        training_sets, example_windows, word_surprise, filled_masks
    )
}

_TAIL = ev._TAIL
_MOVING = f"""x AS (SELECT user_id AS who, epoch_us(ts) AS us, 50 + (user_id % 5) * 0.01 + value / 100000 AS lat, 6 + (user_id % 3) * 0.01 AS lon FROM events),
    span AS (SELECT min(us) AS f, max(us) - min(us) + 1 AS s FROM x),
    y AS (SELECT turn, who, lat, lon, CASE WHEN turn = 0 THEN us ELSE f + (us - f + floor(s * turn / 5)::BIGINT) % s END AS us FROM x, span, range(0, 5) AS r(turn)),
    p AS (SELECT turn, a.who AS who_a, a.us, b.who AS who_b, abs(a.us - b.us) AS off, b.us AS us_b, {pq._HAV} AS m FROM x AS a JOIN y AS b ON a.who < b.who
        AND abs(a.us - b.us) <= 600000000),
    k AS (SELECT *, row_number() OVER (PARTITION BY turn, who_a, us, who_b ORDER BY off, us_b, m) AS r FROM p),
    c AS (SELECT who_a, who_b, count(*) FILTER (turn = 0) AS met, count(*) FILTER (turn = 0 AND m <= 900.0 + off / 1e6) AS close,
        count(*) FILTER (turn > 0) AS met0, count(*) FILTER (turn > 0 AND m <= 900.0 + off / 1e6) AS close0 FROM k WHERE r = 1 GROUP BY ALL),
    mv AS (SELECT *, met * (close0 + 0.5) / (met0 + 1) AS expected FROM c WHERE close >= 2 AND close >= 0.8 * met),
    moving AS (SELECT who_a, who_b, met, close, expected, close / expected AS lift, {_TAIL.format(k='close', m='expected')} AS p_value FROM mv)"""
_NET = "e AS (SELECT a, b, min(length) AS length FROM (SELECT -l_suppkey - 1 AS a, l_partkey AS b, l_quantity AS length FROM lineitem UNION ALL SELECT l_partkey, -l_suppkey - 1, l_quantity FROM lineitem) GROUP BY a, b)"
_REACHED = """r AS (SELECT s_suppkey AS source, -s_suppkey - 1 AS node, 0.0::DOUBLE AS cost FROM supplier WHERE s_nationkey IN (3, 8)
        UNION SELECT source, b, cost + length FROM r JOIN e ON e.a = r.node WHERE cost + length <= {budget}),
    g AS (SELECT source, node, min(cost) AS cost FROM r GROUP BY source, node)"""
_UNIT = "list_transform({v}, lambda x: x / sqrt(list_sum(list_transform({v}, lambda y: y * y))))"
_VEC = f"v AS MATERIALIZED (SELECT label, vec_id AS id, {_UNIT.format(v='e')} AS v FROM (SELECT label, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings))"
_COS = "list_sum(list_transform(range(1, 65), lambda i: {a}[i] * {b}[i]))"


def _lloyd(before: str, after: str) -> str:
    """One round: each vector to its nearest centre, and the unit-length sums."""
    return f"""a{after} AS MATERIALIZED (SELECT label, id, v, arg_min(part, (far, part)) AS part FROM (SELECT v.label, id, v, part, 1 - {_COS.format(a='v', b='c')} AS far
            FROM v JOIN {before} AS b ON b.label = v.label) GROUP BY label, id, v),
        t{after} AS (SELECT label, part, count(DISTINCT id) AS n, d, sum(v[d]) AS s FROM a{after}, range(1, 65) AS r(d) GROUP BY label, part, d),
        {after} AS MATERIALIZED (SELECT label, part, n, {_UNIT.format(v='s')} AS c FROM (SELECT label, part, any_value(n) AS n, list(s ORDER BY d) AS s FROM t{after} GROUP BY label, part))"""


_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
_PAIRS = f"""d AS MATERIALIZED (SELECT {_WORDS} AS w FROM documents),
    pairs AS MATERIALIZED (SELECT w[i] AS a, w[i + 1] AS b, count(*) AS n FROM (SELECT w, unnest(range(1, len(w))) AS i FROM d) GROUP BY ALL)"""


def _round(r: int, before: str, keep: str) -> str:
    """A round of filling: ``before`` has item, pos, word; masks that stay are those beyond ``keep`` of all."""
    last = keep == "0"
    return f"""o{r} AS MATERIALIZED (SELECT o.item, o.pos, l.word AS l, x.word AS x FROM {before} AS o LEFT JOIN {before} AS l ON l.item = o.item AND l.pos = o.pos - 1
            LEFT JOIN {before} AS x ON x.item = o.item AND x.pos = o.pos + 1 WHERE o.word IS NULL),
        k{r} AS (SELECT item, pos, b AS w FROM o{r} JOIN aft ON a = l UNION SELECT item, pos, a FROM o{r} JOIN bef ON b = x),
        s{r} AS (SELECT k.item, k.pos, k.w, coalesce(f.p, 1e-4) * coalesce(g.p, 1e-4) AS s FROM k{r} AS k JOIN o{r} AS o ON o.item = k.item AND o.pos = k.pos
            LEFT JOIN aft AS f ON f.a = o.l AND f.b = k.w LEFT JOIN bef AS g ON g.b = o.x AND g.a = k.w),
        b{r} AS (SELECT o.item, o.pos, arg_min(w, (-s, w)) AS w, max(s) AS s FROM o{r} AS o LEFT JOIN s{r} AS s ON s.item = o.item AND s.pos = o.pos GROUP BY o.item, o.pos),
        p{r} AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY w IS NULL, s DESC NULLS LAST, pos) AS place, count(*) OVER (PARTITION BY item) AS open FROM b{r}),
        f{r} AS (SELECT p.item, p.pos, {'coalesce(w, (SELECT b FROM pairs GROUP BY b ORDER BY sum(n) DESC, b LIMIT 1))' if last else 'w'} AS w, coalesce(s, 0) AS s
            FROM p{r} AS p JOIN al ON al.item = p.item WHERE place <= open - {keep} {'' if last else 'AND w IS NOT NULL'})"""


ORACLE_SQL = {
    "co_moving_users": f"WITH {_MOVING} SELECT who_a, who_b, met, close, round(expected, 4) AS expected, round(lift, 4) AS lift, round(p_value, 4) AS p_value FROM moving WHERE p_value < 0.5",
    "user_links": f"""
        WITH {ev._EV}, {_MOVING}, act AS (SELECT DISTINCT who, us // 3600000000 AS bin FROM e), own AS (SELECT who, count(*) AS n FROM act GROUP BY 1),
        bins AS (SELECT max(bin) - min(bin) + 1 AS bins FROM act),
        tog AS (SELECT i.who AS who_a, j.who AS who_b, count(*) AS n FROM act AS i JOIN act AS j ON i.bin = j.bin AND i.who < j.who GROUP BY ALL HAVING count(*) >= 3),
        tm AS (SELECT who_a, who_b, tog.n AS n, oa.n * ob.n / bins AS mean FROM tog JOIN own AS oa ON oa.who = who_a JOIN own AS ob ON ob.who = who_b, bins),
        cnt AS (SELECT who, count(*) AS n FROM e GROUP BY 1), sp AS (SELECT max(us) - min(us) AS span FROM e),
        ans AS (SELECT i.who AS who_a, j.who AS who_b, count(DISTINCT i.id) AS n FROM e AS i JOIN e AS j ON i.who <> j.who
            AND j.us BETWEEN i.us + 500000 AND i.us + 300000000 GROUP BY ALL HAVING count(DISTINCT i.id) >= 2),
        am AS (SELECT who_a, who_b, ans.n AS n, ca.n * (1 - exp(-cb.n * 299500000 / span)) AS mean FROM ans JOIN cnt AS ca ON ca.who = who_a JOIN cnt AS cb ON cb.who = who_b, sp),
        links AS (SELECT who_a, who_b, 'together' AS kind, false AS directed, n, n / mean AS lift, {_TAIL.format(k='n', m='mean')} AS p_value, 0.01 AS most FROM tm
            UNION ALL SELECT who_a, who_b, 'answer', true, n, n / mean, {_TAIL.format(k='n', m='mean')}, 0.05 FROM am
            UNION ALL SELECT who_a, who_b, 'movement', false, close, lift, p_value, 0.5 FROM moving)
        SELECT who_a, who_b, kind, directed, n AS count, round(lift, 4) AS lift, round(p_value, 4) AS p_value, round(ln(1 + n) * least(lift, 50), 4) AS weight
        FROM links WHERE p_value < most""",
    "road_reach": f"WITH RECURSIVE {_NET}, {_REACHED.format(budget=3)} SELECT source, node, cost FROM g",
    "road_stretches": f"""
        WITH RECURSIVE {_NET}, {_REACHED.format(budget=2)},
        m AS (SELECT source, a, b, length, x.cost AS da, NULL::DOUBLE AS db FROM e JOIN g AS x ON x.node = a WHERE a < b UNION ALL
            SELECT source, a, b, length, NULL::DOUBLE, x.cost FROM e JOIN g AS x ON x.node = b WHERE a < b),
        n AS (SELECT source, a, b, max(length) AS len, min(da) AS da, min(db) AS db FROM m GROUP BY source, a, b),
        t AS (SELECT *, CASE WHEN db IS NULL THEN len WHEN da IS NULL THEN 0 ELSE greatest(0, least(len, (db + len - da) / 2)) END AS top FROM n),
        p AS (SELECT source, a, b, greatest(0, 1.25 - da) AS f, least(top, 2.5 - da) AS t FROM t WHERE da IS NOT NULL UNION ALL
            SELECT source, a, b, greatest(top, db + len - 2.5), least(len, db + len - 1.25) FROM t WHERE db IS NOT NULL)
        SELECT source, a, b, f::DOUBLE AS from_m, t::DOUBLE AS to_m FROM p WHERE t > f""",
    "snapped_places": """
        WITH p AS (SELECT c_custkey AS id, 5 + (c_custkey * 91 % 307) / 100 AS x, 50 + (c_custkey * 37 % 211) / 100 AS y FROM customer),
        s AS (SELECT s_suppkey AS edge, 5 + (s_suppkey * 91 % 307) / 100 AS ax, 50 + (s_suppkey * 37 % 211) / 100 AS ay FROM supplier),
        u AS (SELECT *, greatest(0, least(1, ((x - ax) * 0.2 + (y - ay) * 0.1) / 0.05)) AS share FROM p, s),
        m AS (SELECT *, sqrt(pow(x - ax - share * 0.2, 2) + pow(y - ay - share * 0.1, 2)) AS metres FROM u),
        r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(metres, 9), edge) AS r FROM m WHERE round(metres, 9) <= 0.15)
        SELECT id, edge, round(share, 6) AS share, round(metres, 6) AS metres FROM r WHERE r = 1""",
    "label_parts": f"""
        WITH {_VEC}, s0 AS (SELECT label, arg_min(v, id) AS c FROM v GROUP BY label),
        f AS (SELECT v.label, id, v, round(1 - {_COS.format(a='v', b='c')}, 12) AS far FROM v JOIN s0 ON s0.label = v.label),
        s1 AS (SELECT label, arg_min(v, (-far, id)) AS c FROM f GROUP BY label HAVING max(far) > 1e-9),
        c0 AS MATERIALIZED (SELECT label, 0 AS part, c FROM s0 UNION ALL SELECT label, 1, c FROM s1), {_lloyd('c0', 'c1')}, {_lloyd('c1', 'c2')}
        SELECT label, part, n, round(c[1], 5) AS c0, round(c[64], 5) AS c63 FROM c2""",
    "taught_centres": f"""
        WITH t AS (SELECT label, d, sum(embedding[d]::DOUBLE) AS s, count(*) AS n FROM embeddings, range(1, 65) AS r(d) GROUP BY label, d),
        c AS (SELECT label, any_value(n) AS n, list(s ORDER BY d) AS s FROM t GROUP BY label)
        SELECT label, n, round(({_UNIT.format(v='s')})[1], 5) AS c0, round(({_UNIT.format(v='s')})[64], 5) AS c63 FROM c""",
    "sighted_apart": """
        WITH RECURSIVE e AS (SELECT user_id AS who, value, event_type AS stop, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS i FROM events),
        f AS (SELECT who, 0::BIGINT AS i, []::DOUBLE[] AS places, []::VARCHAR[] AS stops FROM e WHERE i = 1
            UNION ALL SELECT who, i, CASE WHEN ok THEN list_append(places, value) ELSE places END, CASE WHEN ok THEN list_append(stops, stop) ELSE stops END
            FROM (SELECT f.who, places, stops, e.i, e.value, e.stop, len(f.places) < 4 AND NOT list_contains(f.stops, e.stop)
                AND len(list_filter(f.places, lambda p: abs(e.value - p) <= greatest(5.0, e.value / 10))) = 0 AS ok FROM f JOIN e ON e.who = f.who AND e.i = f.i + 1))
        SELECT who, max(len(places))::INTEGER AS places FROM f GROUP BY who""",
    "confirmed_lines": """
        WITH p AS (SELECT p_partkey AS id, p_size % 3 = 0 AS conj, p_retailprice::DOUBLE AS value, (p_retailprice * 10)::DOUBLE AS line, p_partkey % 97 AS lo,
            p_partkey % 97 + p_size AS hi, p_size / 100 AS res, p_size::DOUBLE AS margin FROM part),
        m AS (SELECT a.id, b.id AS other, b.margin FROM p AS a JOIN p AS b ON a.id % 2 = 0 AND b.id % 2 = 1 AND a.conj = b.conj AND CASE WHEN a.conj
            THEN abs(a.line - b.line) <= 2e-4 * a.line
            ELSE abs(a.value - b.value) <= 3 * least(greatest(a.res, b.res), 0.5) AND a.lo < b.hi AND b.lo < a.hi END),
        r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY margin DESC, other) AS r FROM m)
        SELECT p.id, other AS confirmed_by, r.margin FROM p LEFT JOIN (SELECT * FROM r WHERE r = 1) AS r ON r.id = p.id WHERE p.id % 2 = 0""",
    "training_sets": """
        WITH x AS (SELECT l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS id, l_returnflag || l_linestatus AS cls, l_discount = 0 AS original,
            ('0x' || md5('7:' || l_suppkey)[1:8])::BIGINT / 4294967296.0 < 0.2 AS test FROM lineitem),
        n AS (SELECT cls, count(*) AS n FROM x WHERE NOT test AND original GROUP BY cls),
        c AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY ('0x' || md5('7:' || id)[1:8])::BIGINT, id) AS r FROM x WHERE NOT test AND NOT original),
        k AS (SELECT 'test' AS split, cls, original, id FROM x WHERE test AND original UNION ALL SELECT 'train', cls, original, id FROM x WHERE NOT test AND original
            UNION ALL SELECT 'train', c.cls, original, id FROM c LEFT JOIN n ON n.cls = c.cls WHERE r <= greatest(600 - coalesce(n, 0), 0))
        SELECT split, cls, original, count(*) AS n, sum(id % 1000003)::BIGINT AS ids FROM k GROUP BY ALL""",
    "example_windows": """
        WITH p AS (SELECT p_partkey, (p_size * 7)::BIGINT AS samples, greatest(1, least(4, p_size * 7 // 40)) AS n FROM part),
        w AS (SELECT *, unnest(range(0, n)) AS i FROM p WHERE samples > 0)
        SELECT p_partkey, samples, CASE WHEN n = 1 THEN 0 ELSE round_even((samples - 40) * i / (n - 1), 0)::BIGINT END AS start, samples < 40 AS padded FROM w""",
    "word_surprise": f"""
        WITH {_PAIRS}, s AS (SELECT b, sum(n) AS nb FROM pairs GROUP BY b), t AS (SELECT sum(nb) AS n, count(*) AS v FROM s), q AS (SELECT a, sum(n) AS na FROM pairs GROUP BY a),
        w AS (SELECT item_id, i, w[i] AS word, CASE WHEN i > 1 THEN w[i - 1] END AS a FROM (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT item_id, {_WORDS} AS w FROM benchmark))),
        m AS (SELECT item_id, w.a, coalesce(pairs.n, 0) AS n, coalesce(na, 0) AS na, (coalesce(nb, 0) + 1) / (t.n + t.v + 1) AS p FROM w LEFT JOIN s ON s.b = word
            LEFT JOIN q ON q.a = w.a LEFT JOIN pairs ON pairs.a = w.a AND pairs.b = word, t)
        SELECT item_id, count(*) AS n, round(sum(-ln(CASE WHEN a IS NULL THEN p ELSE (n + 5 * p) / (na + 5) END)), 4) AS total,
            round(max(-ln(CASE WHEN a IS NULL THEN p ELSE (n + 5 * p) / (na + 5) END)), 4) AS most FROM m GROUP BY item_id""",
    "filled_masks": f"""
        WITH {_PAIRS},
        aft AS MATERIALIZED (SELECT a, b, n / t AS p FROM (SELECT *, sum(n) OVER (PARTITION BY a) AS t, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM pairs) WHERE r <= 4),
        bef AS MATERIALIZED (SELECT a, b, n / t AS p FROM (SELECT *, sum(n) OVER (PARTITION BY b) AS t, row_number() OVER (PARTITION BY b ORDER BY n DESC, a) AS r FROM pairs) WHERE r <= 4),
        c0 AS MATERIALIZED (SELECT item_id AS item, i - 1 AS pos, CASE WHEN (i - 1) % 6 <> 3 THEN w[i] END AS word FROM (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i
            FROM (SELECT item_id, {_WORDS} AS w FROM benchmark))),
        al AS (SELECT item, count(*) FILTER (word IS NULL) AS n FROM c0 GROUP BY item), {_round(1, 'c0', 'floor(al.n * cos(pi() / 4))')},
        c1 AS MATERIALIZED (SELECT c.item, c.pos, coalesce(c.word, f.w) AS word FROM c0 AS c LEFT JOIN f1 AS f ON f.item = c.item AND f.pos = c.pos), {_round(2, 'c1', '0')}
        SELECT item AS item_id, pos::INTEGER AS pos, w AS word, 1 AS round, round(s, 8) AS score FROM f1 UNION ALL SELECT item, pos, w, 2, round(s, 8) FROM f2""",
}
