"""Queries over sampled series: the lines of each supplier, in order of their orders, stand for a capture."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from evidentia.operators import cyclic, series

SEGMENT = 64
LEVELS = [cyclic.Level(1, (0.0,)), cyclic.Level(2, (-0.125, 0.125))]
MARKER = [1.0, 1.0, -1.0, 1.0, -1.0]


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _samples(spark, sf, *more):
    """capture, at, x, y: price and quantity about their middles, numbered for each supplier."""
    li = _t(spark, sf, "lineitem")
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return li.select(
        F.col("l_suppkey").alias("capture"), (F.row_number().over(order) - 1).cast("long").alias("at"), (F.col("l_extendedprice") / 1000 - 38).alias("x"),
        (F.col("l_quantity") - 25.5).cast("double").alias("y"), *more
    )


def _blocks(spark, sf, size=SEGMENT):
    return series.blocks_of(_samples(spark, sf), "capture", "at", size, F.col("x"), F.col("y"))


def lag_sums(spark, sf):
    """Summed lag statistics of each capture at the first level, in units of the median of its lag."""
    sums = cyclic.lag_sums(_blocks(spark, sf), "capture", SEGMENT, LEVELS[:1], (1, 2), (0,))
    rows = sums.filter("not conjugate")
    middle = rows.groupBy("capture", "lag").agg(F.median("stat").alias("m"))
    return rows.join(middle, ["capture", "lag"]).select(
        "capture", "lag", "bin", "segments", F.round("stat", 5).alias("stat"), F.round(F.col("stat") / F.col("m"), 4).alias("ratio")
    )


def conjugate_sums(spark, sf):
    sums = cyclic.lag_sums(_blocks(spark, sf), "capture", SEGMENT, LEVELS[:1], (), (0,))
    return sums.select("capture", "bin", "segments", F.round("stat", 5).alias("stat"))


def cyclic_features(spark, sf):
    """Features of all captures at two levels; the false alarms are set high, for the captures hold none by design."""
    return cyclic.search(_blocks(spark, sf), "capture", SEGMENT, LEVELS, 0.5)


def correlation_strips(spark, sf):
    return cyclic.spectral_correlation(_blocks(spark, sf), "capture", SEGMENT, 8)


def resampled_lines(spark, sf):
    return series.resample(_blocks(spark, sf), "capture", SEGMENT, 3.0, 2.0, 4).select(
        "capture", F.col("at").alias("pos"), F.round("re", 5).alias("re"), F.round("im", 5).alias("im")
    )


def marker_places(spark, sf):
    """Where a short pattern of prices fits each capture best."""
    found = series.find_marker(series.marker_scores(_blocks(spark, sf).withColumn("im", F.transform("re", lambda x: F.lit(0.0))), "capture", SEGMENT, np.array(MARKER)), "capture")
    return found.select("capture", F.col("at").alias("pos"), F.round("score", 6).alias("score"))


def aligned_labels(spark, sf):
    """Lines of tax 0.08 as labels of each capture, moved to where its marker was found; the end marker is the best place of the second half."""
    plain = _blocks(spark, sf).withColumn("im", F.transform("re", lambda x: F.lit(0.0)))
    scores = series.marker_scores(plain, "capture", SEGMENT, np.array(MARKER))
    begins = series.find_marker(scores.filter(F.col("at") < 320), "capture")
    ends = series.find_marker(scores.filter(F.col("at") >= 320), "capture")
    li = _t(spark, sf, "lineitem").filter("l_tax = 0.08")
    labels = li.select(
        F.col("l_suppkey").alias("capture"), "l_orderkey", "l_linenumber", (F.col("l_partkey") % 100).cast("double").alias("start_s"),
        F.col("l_quantity").cast("double").alias("duration_s")
    )
    found = series.align_labels(labels, "capture", begins, ends, 300.0, 0.9)
    return found.select("capture", "l_orderkey", "l_linenumber", "sample_start", "sample_count", F.round("drift_ppm", 1).alias("drift_ppm"))


def _pairs(spark, sf):
    """Blocks with a second series: discount and tax."""
    li = _t(spark, sf, "lineitem")
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    to = li.select(
        F.col("l_suppkey").alias("capture"), (F.row_number().over(order) - 1).cast("long").alias("at"), F.col("l_discount"), F.col("l_tax")
    )
    other = series.blocks_of(to, "capture", "at", SEGMENT, F.col("l_discount"), F.col("l_tax"))
    return _blocks(spark, sf).join(other.select("capture", "block", F.col("re").alias("to_re"), F.col("im").alias("to_im")), ["capture", "block"])


def filter_equations(spark, sf):
    """Normal equations of the widely linear filter of three taps from prices and quantities to discounts and taxes."""
    found = series.gram(_pairs(spark, sf), "capture", SEGMENT, 3)
    return found.select("capture", "i", "j", F.round("re", 3).alias("re"), F.round("im", 3).alias("im"))


def filter_taps(spark, sf):
    return series.solve(series.gram(_pairs(spark, sf), "capture", SEGMENT, 3), "capture", series.columns_of(3, (0.0,)))


QUERIES = {
    f.__name__: f for f in (
        lag_sums, conjugate_sums, cyclic_features, correlation_strips, resampled_lines, marker_places, aligned_labels, filter_equations, filter_taps
    )
}

_S = """s AS MATERIALIZED (SELECT l_suppkey AS capture, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS pos,
    l_extendedprice / 1000 - 38 AS x, (l_quantity - 25.5)::DOUBLE AS y, l_discount AS u, l_tax AS v FROM lineitem)"""
_WINDOW = "(0.35875 - 0.48829 * cos(2 * pi() * i / {n}) + 0.14128 * cos(4 * pi() * i / {n}) - 0.01168 * cos(6 * pi() * i / {n}))"
_SEGMENTS = f"""{_S}, whole AS (SELECT capture, pos // {SEGMENT} AS seg, avg(x * x + y * y) AS power FROM s GROUP BY ALL HAVING count(*) = {SEGMENT}),
    w AS (SELECT s.*, seg, power FROM s JOIN whole ON s.capture = whole.capture AND s.pos // {SEGMENT} = seg)"""
_ODD = f"""{_S}, score AS (SELECT a.capture, a.pos, pow(sum(b.x * m.t), 2) / (sum(b.x * b.x) * {sum(v * v for v in MARKER)}) AS score, count(*) AS n
    FROM s AS a JOIN (SELECT * FROM (VALUES {', '.join(f'({k}, {v})' for k, v in enumerate(MARKER))}) AS m(k, t)) AS m ON true
    JOIN s AS b ON b.capture = a.capture AND b.pos = a.pos + m.k GROUP BY a.capture, a.pos)"""
_HALF, _REACH, _BAND = 4, math.ceil(4 / (2 / 3)), 2 / 3

ORACLE_SQL = {
    "lag_sums": f"""
        WITH {_SEGMENTS}, l AS (SELECT * FROM (VALUES (1), (2)) AS l(lag)),
        q AS MATERIALIZED (SELECT a.capture, a.seg, a.power, lag, b.pos % {SEGMENT} AS i, a.x * b.x + a.y * b.y AS pr, a.y * b.x - a.x * b.y AS pi
            FROM w AS a JOIN l ON true JOIN w AS b ON a.capture = b.capture AND a.seg = b.seg AND a.pos = b.pos + lag),
        c AS (SELECT *, pr - avg(pr) OVER g AS cr, pi - avg(pi) OVER g AS ci, {_WINDOW.format(n=f'({SEGMENT} - 1 - lag)')} AS h FROM q
            WINDOW g AS (PARTITION BY capture, seg, lag)),
        f AS (SELECT capture, seg, lag, k AS bin, sum(h * (cr * cos(2 * pi() * k * i / {SEGMENT}) + ci * sin(2 * pi() * k * i / {SEGMENT}))) AS re,
            sum(h * (ci * cos(2 * pi() * k * i / {SEGMENT}) - cr * sin(2 * pi() * k * i / {SEGMENT}))) AS im, sum(h * h) * any_value(power) ** 2 AS scale
            FROM c JOIN range(0, {SEGMENT // 2 + 1}) AS r(k) ON true GROUP BY ALL),
        t AS (SELECT capture, lag, bin, count(*) AS segments, sum((re * re + im * im) / scale) AS stat FROM f GROUP BY ALL)
        SELECT capture, lag, bin::INTEGER AS bin, segments, round(stat, 5) AS stat, round(stat / median(stat) OVER (PARTITION BY capture, lag), 4) AS ratio FROM t""",
    "conjugate_sums": f"""
        WITH {_SEGMENTS},
        c AS (SELECT capture, seg, power, pos % {SEGMENT} AS i, x * x - y * y AS cr, 2 * x * y AS ci, {_WINDOW.format(n=SEGMENT - 1)} AS h
            FROM (SELECT *, pos % {SEGMENT} AS i FROM w)),
        f AS (SELECT capture, seg, k AS bin, sum(h * (cr * cos(2 * pi() * k * i / {SEGMENT}) + ci * sin(2 * pi() * k * i / {SEGMENT}))) AS re,
            sum(h * (ci * cos(2 * pi() * k * i / {SEGMENT}) - cr * sin(2 * pi() * k * i / {SEGMENT}))) AS im, sum(h * h) * any_value(power) ** 2 AS scale
            FROM c JOIN range(0, {SEGMENT}) AS r(k) ON true GROUP BY ALL)
        SELECT capture, bin::INTEGER AS bin, count(*) AS segments, round(sum((re * re + im * im) / scale), 5) AS stat FROM f GROUP BY capture, bin""",
    "resampled_lines": f"""
        WITH {_S}, n AS (SELECT capture, count(*) AS n FROM s GROUP BY capture),
        o AS (SELECT capture, unnest(range(0, (n * 2 + 2) // 3)) AS pos FROM n),
        t AS (SELECT o.capture, o.pos, s.x, s.y, (o.pos * 1.5 - s.pos) * {_BAND} AS d FROM o JOIN s
            ON s.capture = o.capture AND s.pos BETWEEN o.pos * 3 // 2 - {_REACH} AND o.pos * 3 // 2 + {_REACH}),
        k AS (SELECT *, CASE WHEN abs(d) >= {_HALF} THEN 0 WHEN d = 0 THEN 1 ELSE sin(pi() * d) / (pi() * d) * (0.5 + 0.5 * cos(pi() * d / {_HALF})) END * {_BAND} AS h
            FROM t)
        SELECT capture, pos, round(sum(x * h), 5) AS re, round(sum(y * h), 5) AS im FROM k GROUP BY capture, pos""",
    "marker_places": f"""
        WITH {_ODD} SELECT capture, arg_min(pos, (-round(score, 9), pos)) AS pos, round(max(round(score, 9)), 6) AS score FROM score GROUP BY capture""",
    "aligned_labels": f"""
        WITH {_ODD}, best AS (SELECT capture, pos // {SEGMENT} AS b, arg_min(pos, (-round(score, 12), pos)) AS pos, max(score) AS score FROM score GROUP BY ALL),
        a AS (SELECT capture, arg_min(pos, (-round(score, 9), pos)) AS pos FROM best WHERE pos < 320 GROUP BY capture HAVING round(max(score), 9) >= 0.9),
        b AS (SELECT capture, arg_min(pos, (-round(score, 9), pos)) AS pos FROM best WHERE pos >= 320 GROUP BY capture HAVING round(max(score), 9) >= 0.9),
        r AS (SELECT l_suppkey AS capture, l_orderkey, l_linenumber, (l_partkey % 100)::DOUBLE AS t, l_quantity::DOUBLE AS d, a.pos AS a,
            coalesce((b.pos - a.pos) / 300.0, 1.0) AS scale, b.pos AS b
            FROM lineitem JOIN a ON a.capture = l_suppkey LEFT JOIN b ON b.capture = l_suppkey WHERE l_tax = 0.08)
        SELECT capture, l_orderkey, l_linenumber, round(a + t * scale)::BIGINT AS sample_start, round(d * scale)::BIGINT AS sample_count,
            CASE WHEN b IS NOT NULL THEN round((scale - 1) * 1e6, 1) END AS drift_ppm FROM r""",
    "filter_equations": f"""
        WITH {_S}, m AS (SELECT s.capture, s.pos, j, coalesce(d.x, 0) AS re, CASE WHEN j < 3 THEN 1 ELSE -1 END * coalesce(d.y, 0) AS im
            FROM s JOIN range(0, 6) AS r(j) ON true LEFT JOIN s AS d ON d.capture = s.capture AND d.pos = s.pos + 1 - j % 3
            UNION ALL SELECT capture, pos, 6, 1, 0 FROM s UNION ALL SELECT capture, pos, 7, u, v FROM s)
        SELECT a.capture, a.j::INTEGER AS i, b.j::INTEGER AS j, round(sum(a.re * b.re + a.im * b.im), 3) AS re, round(sum(a.re * b.im - a.im * b.re), 3) AS im
        FROM m AS a JOIN m AS b ON a.capture = b.capture AND a.pos = b.pos AND a.j <= b.j AND a.j < 7 GROUP BY a.capture, a.j, b.j""",
}
