"""Event queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.times import micros
from evidentia.operators import detection, events, metrics, records


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _ev(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    return events.as_sightings(_t(spark, sf, "events"), "event_id", "user_id", "ts", *more)


def activity_matrix(spark, sf):
    e = _t(spark, sf, "events")
    return events.activity_matrix(e, "event_type", F.hour("ts"), "user_id", "value", "value", open_at=5)


def first_response(spark, sf):
    e = _ev(spark, sf, "event_type")
    a, b = e.filter("event_type = 'signup'").select("id", "who", "us"), e.filter("event_type = 'purchase'").select("id", "who", "us")
    return events.first_within(a, b, "who", 30_000_000, 3_600_000_000).select("id", "hit_id", "delay_us")


def call_response(spark, sf):
    return events.call_response(_ev(spark, sf, "event_type"), "event_type", 500_000, 300_000_000).select(
        "a_kind", "b_kind", "calls", "answered", F.round("expected", 4).alias("expected"), F.round("p_value", 4).alias("p_value"),
        F.round("delay_us", 0).alias("delay_us")
    )


def nearest_same_user(spark, sf):
    e = _ev(spark, sf, "event_type")
    a, b = e.filter("event_type = 'purchase'").select("id", "who", "us"), e.filter("event_type = 'view'").select("id", "who", "us")
    return events.nearest(a, b, ["who"], 86_400_000_000).select("id", "near_id", "off_us")


def co_occurrence(spark, sf):
    return events.co_occurrence(_ev(spark, sf), 3_600_000_000, 3).select(
        "who_a", "who_b", "together", F.round("lift", 4).alias("lift"), F.round("p_value", 5).alias("p_value")
    )


def alike_schedules(spark, sf):
    return events.alike_schedules(_ev(spark, sf), 0.45).select("who_a", "who_b", (F.floor(F.col("cosine") * 1e6 + 0.5) / 1e6).alias("cosine"))


def week_profiles(spark, sf):
    return events.week_profiles(_ev(spark, sf)).select("who", "slot", "n", F.round("share", 6).alias("share"))


def daily_rhythm(spark, sf):
    return events.rhythm(_ev(spark, sf), 86_400_000_000).select(
        "who", "n", F.round("resultant", 6).alias("resultant"), F.round("p_value", 6).alias("p_value")
    )


def event_gaps(spark, sf):
    return events.gaps(_ev(spark, sf), 3.0).select("id", "who", "wait_us", F.round("median_us", 1).alias("median_us"))


def event_pace(spark, sf):
    return events.pace(_ev(spark, sf)).select("who", "n", F.round("median_us", 1).alias("median_us"), F.round("mad_us", 1).alias("mad_us"), "kind")


def loud_runs(spark, sf):
    return events.islands(_ev(spark, sf, "value"), ["who"], ["us", "id"], F.col("value") > 50).select(
        "who", F.col("first").alias("first_us"), F.col("last").alias("last_us"), "n"
    )


def repeated_types(spark, sf):
    return events.unchanged_runs(
        _ev(spark, sf, "event_type"), ["who"], ["us", "id"], "event_type", 3
    ).select("who", "value", F.col("first").alias("first_us"), "n")


def busy_spans(spark, sf):
    return events.busy_spans(_ev(spark, sf, "value"), (F.col("value") * 60_000_000).cast("long")).select(
        "who", "bursts", "busy_us", F.round("duty", 6).alias("duty"), F.round("period_us", 1).alias("period_us")
    )


def value_drift(spark, sf):
    return events.drift(_ev(spark, sf, "value"), "value").select("who", "n", F.round("slope", 6).alias("slope"))


def user_sessions(spark, sf):
    return events.sessions(_ev(spark, sf), 86_400_000_000).select("who", "session", "begin_us", "end_us", "n")


def lag_histogram(spark, sf):
    return events.lag_histogram(_ev(spark, sf, "event_type"), "event_type", 3, 5)


def pri_spectrum(spark, sf):
    return events.pri_spectrum(
        _ev(spark, sf, "event_type"), "event_type", 2, [600_000_000, 1_200_000_000, 2_400_000_000]
    ).select("event_type", "period_us", "n", F.round("strength", 4).alias("strength"))


def decayed_counts(spark, sf):
    return events.decayed(_ev(spark, sf), 1_706_745_600_000_000, 604_800_000_000).select("who", "n", F.round("weight", 6).alias("weight"))


def unwrapped_clock(spark, sf):
    e = _ev(spark, sf).withColumn("clock", F.pmod(F.col("us"), F.lit(2**32)))
    return events.unwrap_clock(e, ["who"], "us", "clock").select("id", "unwrapped")


def resampled_values(spark, sf):
    return events.resample(
        _ev(spark, sf, "value"), "who", "value", 21_600_000_000, 259_200_000_000
    ).select("who", "us", F.round("value", 6).alias("value"))


def presence_windows(spark, sf):
    return events.presence(_t(spark, sf, "events"), "value", "2 hours", "1 hour").select(
        micros("begin").alias("begin_us"), "n", F.round("motion", 6).alias("motion"), "present"
    )


def hourly_power(spark, sf):
    """Events per hour from the first, for the detection queries."""
    e = _t(spark, sf, "events").select("event_type", F.floor(micros("ts") / 3_600_000_000).alias("hour"), "value")
    return e.groupBy("event_type", "hour").agg(F.sum("value").alias("power"))


def cfar_hits(spark, sf):
    return detection.ca_cfar(hourly_power(spark, sf), ["event_type"], "hour", "power", 0.01).select(
        "event_type", "hour", "cells", F.round("noise", 6).alias("noise"), F.round("threshold", 4).alias("threshold"), "hit"
    )


def noise_floor(spark, sf):
    return detection.quantile_floor(hourly_power(spark, sf), "event_type", "power").select("event_type", "n", F.round("floor", 6).alias("floor"))


def truncated_noise_floor(spark, sf):
    return detection.truncated_floor(
        hourly_power(spark, sf), "event_type", "power", rounds=2
    ).select("event_type", "n", F.round("floor", 6).alias("floor"))


def local_ratio(spark, sf):
    return detection.local_ratio(
        hourly_power(spark, sf), ["event_type"], "hour", "power", 4
    ).select("event_type", "hour", F.round("ratio", 6).alias("ratio"))


def power_peaks(spark, sf):
    return detection.peaks(
        hourly_power(spark, sf), ["event_type"], "hour", "power", 5
    ).select("event_type", "hour", F.round("power", 4).alias("power"))


def hit_runs(spark, sf):
    return detection.bridged_runs(hourly_power(spark, sf), ["event_type"], "hour", F.col("power") > 100, 1, 2)


def opened_floor(spark, sf):
    return detection.opened(hourly_power(spark, sf), ["event_type"], "hour", "power").select(
        "event_type", "hour", F.round("opened", 4).alias("opened")
    )


def pooled_rows(spark, sf):
    return detection.tile_rows(hourly_power(spark, sf), "hour", "power", 24).select(
        "row", F.round("peak", 4).alias("peak"), F.round("mean", 6).alias("mean"), "n"
    )


def newest_event(spark, sf):
    return records.newest(_ev(spark, sf, "event_type"), ["who"], ["us", "id"]).select("who", "id", "event_type", "us")


def table_difference(spark, sf):
    e = _t(spark, sf, "events").select("user_id", "event_type")
    return records.difference(e.filter("value < 40"), e.filter("value >= 40"))


def score_bins(spark, sf):
    e = _t(spark, sf, "events")
    return metrics.score_by_bin(e, F.col("event_type") == "view", "value", 25.0).select("bin", "n", F.round("score", 6).alias("score"))


QUERIES = {f.__name__: f for f in (
    activity_matrix, first_response, call_response, nearest_same_user, co_occurrence, alike_schedules, week_profiles, daily_rhythm, event_gaps, event_pace, loud_runs, repeated_types, busy_spans, value_drift,
    user_sessions, lag_histogram, pri_spectrum, decayed_counts, unwrapped_clock, resampled_values, presence_windows, cfar_hits, noise_floor, truncated_noise_floor, local_ratio, power_peaks, hit_runs, opened_floor, pooled_rows, newest_event, table_difference, score_bins,
)}

_EV = "e AS (SELECT event_id AS id, user_id AS who, epoch_us(ts) AS us, event_type, value, ts FROM events)"
_HOURLY = "h AS (SELECT event_type, epoch_us(ts) // 3600000000 AS hour, sum(value) AS power FROM events GROUP BY ALL)"
#: The tail of a Poisson variable; DuckDB sums the terms of a list.
_TAIL = "CASE WHEN {k} <= 0 THEN 1.0 ELSE greatest(1 - list_sum(list_transform(range(0, {k}::BIGINT), lambda i: exp(-({m}) + i * ln({m}) - lgamma(i + 1)))), 0.0) END"

ORACLE_SQL = {
    "activity_matrix": """
        WITH c AS (SELECT event_type AS row, hour(ts)::INT AS hour, count(*) AS n, count(DISTINCT user_id) AS n_who, median(value) AS median_value,
            max(value) AS max_reach FROM events GROUP BY ALL),
        g AS (SELECT row, hour::INT AS hour FROM (SELECT DISTINCT event_type AS row FROM events), range(24) AS r(hour))
        SELECT row, hour, coalesce(n, 0)::BIGINT AS n, coalesce(n_who, 0)::BIGINT AS n_who, median_value, max_reach, coalesce(n, 0) >= 5 AS open
            FROM g LEFT JOIN c USING (row, hour)""",
    "first_response": f"""
        WITH {_EV}, m AS (SELECT a.id, b.id AS hit_id, b.us - a.us AS delay_us, row_number() OVER (PARTITION BY a.id ORDER BY b.us, b.id) AS r
            FROM e AS a JOIN e AS b ON a.event_type = 'signup' AND b.event_type = 'purchase' AND a.who <> b.who AND b.us BETWEEN a.us + 30000000
                AND a.us + 3600000000)
        SELECT e.id, hit_id, delay_us FROM e LEFT JOIN (SELECT * FROM m WHERE r = 1) AS m ON e.id = m.id WHERE event_type = 'signup'""",
    "call_response": f"""
        WITH {_EV}, n AS (SELECT event_type, count(*) AS n FROM e GROUP BY 1), s AS (SELECT max(us) - min(us) AS span FROM e),
        m AS (SELECT a.id, a.event_type AS a_kind, b.event_type AS b_kind, min(b.us - a.us) AS d FROM e AS a JOIN e AS b ON a.who <> b.who
            AND a.event_type <> b.event_type AND b.us BETWEEN a.us + 500000 AND a.us + 300000000 GROUP BY ALL),
        p AS (SELECT a_kind, b_kind, count(*) AS answered, avg(d) AS d FROM m GROUP BY ALL),
        x AS (SELECT a_kind, b_kind, na.n AS calls, answered, d, na.n * (1 - exp(-nb.n * 299500000 / span)) AS mean FROM p
            JOIN n AS na ON na.event_type = a_kind JOIN n AS nb ON nb.event_type = b_kind, s)
        SELECT a_kind, b_kind, calls, answered, round(mean, 4) AS expected, round({_TAIL.format(k="answered", m="mean")}, 4) AS p_value, round(d,
            0) AS delay_us FROM x""",
    "nearest_same_user": f"""
        WITH {_EV}, m AS (SELECT a.id, b.id AS near_id, abs(b.us - a.us) AS off_us, row_number() OVER (PARTITION BY a.id ORDER BY abs(b.us - a.us),
            b.us, b.id) AS r
            FROM e AS a JOIN e AS b ON a.event_type = 'purchase' AND b.event_type = 'view' AND a.who = b.who AND abs(a.us - b.us) <= 86400000000)
        SELECT e.id, near_id, off_us FROM e LEFT JOIN (SELECT * FROM m WHERE r = 1) AS m ON e.id = m.id WHERE event_type = 'purchase'""",
    "co_occurrence": f"""
        WITH {_EV}, a AS (SELECT DISTINCT who, us // 3600000000 AS bin FROM e), b AS (SELECT who, count(*) AS n FROM a GROUP BY 1),
            s AS (SELECT max(bin) - min(bin) + 1 AS bins FROM a),
        p AS (SELECT x.who AS who_a, y.who AS who_b, count(*) AS together FROM a AS x JOIN a AS y ON x.bin = y.bin AND x.who < y.who GROUP BY ALL
            HAVING count(*) >= 3),
        q AS (SELECT p.*, ba.n * bb.n / bins AS mean FROM p JOIN b AS ba ON ba.who = who_a JOIN b AS bb ON bb.who = who_b, s)
        SELECT who_a, who_b, together, round(together / mean, 4) AS lift, round({_TAIL.format(k="together", m="mean")}, 5) AS p_value FROM q""",
    "week_profiles": f"""
        WITH {_EV}, c AS (SELECT who, ((us // 3600000000) + 72) % 168 AS slot, count(*) AS n FROM e GROUP BY ALL)
        SELECT who, slot, n, round(n / sqrt(sum(n * n) OVER (PARTITION BY who)), 6) AS share FROM c""",
    "alike_schedules": f"""
        WITH {_EV}, c AS (SELECT who, ((us // 3600000000) + 72) % 168 AS slot, count(*) AS n FROM e GROUP BY ALL),
            o AS (SELECT who, sum(n * n)::DOUBLE AS size FROM c GROUP BY 1),
        d AS (SELECT a.who AS who_a, b.who AS who_b, sum(a.n * b.n)::DOUBLE AS dot FROM c AS a JOIN c AS b ON a.slot = b.slot AND a.who < b.who GROUP BY ALL),
        k AS (SELECT who_a, who_b, dot / sqrt(oa.size * ob.size) AS cosine FROM d JOIN o AS oa ON oa.who = who_a JOIN o AS ob ON ob.who = who_b)
        SELECT who_a, who_b, floor(cosine * 1e6 + 0.5) / 1e6 AS cosine FROM k WHERE cosine >= 0.45""",
    "daily_rhythm": f"""
        WITH {_EV}, r AS (SELECT who, count(*) AS n, sqrt(pow(avg(cos(2 * pi() * (us % 86400000000) / 86400000000)),
            2) + pow(avg(sin(2 * pi() * (us % 86400000000) / 86400000000)), 2)) AS r FROM e GROUP BY who), z AS (SELECT *, n * r * r AS z FROM r)
        SELECT who, n, round(r, 6) AS resultant, round(least(greatest(exp(-z) * (1 + (2 * z - z * z) / (4 * n) - (24 * z - 132 * z * z + 76 * pow(z,
            3) - 9 * pow(z, 4)) / (288 * n * n)), 0), 1), 6) AS p_value FROM z""",
    "event_gaps": f"""
        WITH {_EV}, w AS (SELECT id, who, lead(us) OVER (PARTITION BY who ORDER BY us, id) - us AS wait_us FROM e), v AS (SELECT *,
            median(wait_us) OVER (PARTITION BY who) AS m FROM w WHERE wait_us IS NOT NULL)
        SELECT id, who, wait_us, round(m, 1) AS median_us FROM v WHERE wait_us > 3 * m""",
    "event_pace": f"""
        WITH {_EV}, w AS (SELECT who, lead(us) OVER (PARTITION BY who ORDER BY us, id) - us AS w FROM e), v AS (SELECT *,
            median(w) OVER (PARTITION BY who) AS m FROM w WHERE w > 0),
        d AS (SELECT who, count(*) AS n, any_value(m) AS m, 1.4826 * median(abs(w - m)) AS mad FROM v GROUP BY who)
        SELECT who, n, round(m, 1) AS median_us, round(mad, 1) AS mad_us, CASE WHEN n < 3 THEN 'few' WHEN mad / m < 0.02 THEN 'constant'
            WHEN mad / m < 0.2 THEN 'jittered' ELSE 'irregular' END AS kind FROM d""",
    "loud_runs": f"""
        WITH {_EV}, r AS (SELECT *, row_number() OVER (PARTITION BY who ORDER BY us, id) AS i FROM e), f AS (SELECT *,
            i - row_number() OVER (PARTITION BY who ORDER BY us, id) AS g FROM r WHERE value > 50)
        SELECT who, min(us) AS first_us, max(us) AS last_us, count(*) AS n FROM f GROUP BY who, g""",
    "repeated_types": f"""
        WITH {_EV}, r AS (SELECT *, row_number() OVER (PARTITION BY who ORDER BY us, id) - row_number() OVER (PARTITION BY who, event_type
            ORDER BY us, id) AS g FROM e)
        SELECT who, event_type AS value, min(us) AS first_us, count(*) AS n FROM r GROUP BY who, event_type, g HAVING count(*) >= 3""",
    "busy_spans": f"""
        WITH {_EV}, s AS (SELECT who, id, us, us + trunc(value * 60000000)::BIGINT AS z FROM e),
        n AS (SELECT *, max(z) OVER (PARTITION BY who ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
        b AS (SELECT *, sum((reach IS NULL OR us > reach)::INT) OVER (PARTITION BY who ORDER BY us, id) AS b FROM n),
        u AS (SELECT who, b, min(us) AS us, max(z) AS z FROM b GROUP BY ALL), v AS (SELECT *, lead(us) OVER (PARTITION BY who ORDER BY us) - us AS w
            FROM u)
        SELECT who, count(*) AS bursts, sum(z - us)::BIGINT AS busy_us, round(sum(z - us) / (max(z) - min(us)), 6) AS duty, round(median(w),
            1) AS period_us FROM v GROUP BY who""",
    "value_drift": f"WITH {_EV} SELECT who, count(*) AS n, round(regr_slope(value, us / 3.6e9), 6) AS slope FROM e GROUP BY who",
    "user_sessions": f"""
        WITH {_EV}, f AS (SELECT *, coalesce((us - lag(us) OVER (PARTITION BY who ORDER BY us, id) >= 86400000000)::INT, 1) AS f FROM e),
            s AS (SELECT *, sum(f) OVER (PARTITION BY who ORDER BY us, id) AS session FROM f)
        SELECT who, session::BIGINT AS session, min(us) AS begin_us, max(us) AS end_us, count(*) AS n FROM s GROUP BY who, session""",
    "lag_histogram": f"""
        WITH {_EV}, l AS (SELECT event_type, 1 AS lag, lead(us, 1) OVER w - us AS d FROM e WINDOW w AS (PARTITION BY event_type ORDER BY us, id)
            UNION ALL SELECT event_type, 2, lead(us, 2) OVER w - us FROM e WINDOW w AS (PARTITION BY event_type ORDER BY us, id)
            UNION ALL SELECT event_type, 3, lead(us, 3) OVER w - us FROM e WINDOW w AS (PARTITION BY event_type ORDER BY us, id))
        SELECT event_type, lag::INT AS lag, floor(5 * log10(d / 1e6))::INT AS cell, count(*) AS n FROM l WHERE d > 0 GROUP BY ALL""",
    "pri_spectrum": f"""
        WITH {_EV}, l AS (SELECT event_type, us, unnest([lead(us, 1) OVER w - us, lead(us, 2) OVER w - us]) AS d
            FROM e WINDOW w AS (PARTITION BY event_type ORDER BY us, id)),
        t AS (SELECT *, unnest([600000000, 1200000000, 2400000000]) AS period_us FROM l WHERE d > 0)
        SELECT event_type, period_us::BIGINT AS period_us, count(*) AS n, round(sqrt(pow(sum(cos(2 * pi() * us / d)),
            2) + pow(sum(sin(2 * pi() * us / d)), 2)), 4) AS strength FROM t WHERE abs(d - period_us) <= 0.2 * period_us GROUP BY ALL""",
    "decayed_counts": f"WITH {_EV} SELECT who, count(*) AS n, round(sum(pow(0.5, (1706745600000000 - us) / 604800000000)), 6) AS weight FROM e GROUP BY who",
    "unwrapped_clock": f"""
        WITH {_EV}, c AS (SELECT id, who, us, us % 4294967296 AS clock FROM e), f AS (SELECT *, coalesce((clock < lag(clock) OVER (PARTITION BY who
            ORDER BY us) - 2147483648)::INT, 0) AS f FROM c)
        SELECT id, (clock + sum(f) OVER (PARTITION BY who ORDER BY us ROWS UNBOUNDED PRECEDING) * 4294967296)::BIGINT AS unwrapped FROM f""",
    "resampled_values": f"""
        WITH {_EV}, a AS (SELECT who, us, avg(value) AS v FROM e GROUP BY ALL), s AS (SELECT *, lead(us) OVER (PARTITION BY who ORDER BY us) AS u2,
            lead(v) OVER (PARTITION BY who ORDER BY us) AS v2 FROM a),
        g AS (SELECT *, unnest(range(ceil(us / 21600000000)::BIGINT, CASE WHEN u2 IS NULL THEN floor(us / 21600000000)::BIGINT + 1
            ELSE ceil(u2 / 21600000000)::BIGINT END)) * 21600000000 AS t FROM s)
        SELECT who, t AS us, round(CASE WHEN u2 IS NULL OR t = us THEN v WHEN u2 - us <= 259200000000 THEN v + (v2 - v) * (t - us) / (u2 - us) END,
            6) AS value FROM g""",
    "presence_windows": f"""
        WITH {_EV}, w AS (SELECT (us // 3600000000 - unnest([0, 1])) * 3600000000 AS begin_us, value FROM e), m AS (SELECT begin_us, count(*) AS n,
            stddev_pop(value) AS motion FROM w GROUP BY 1), c AS (SELECT 1.5 * quantile_cont(motion, 0.9) AS cut FROM m)
        SELECT begin_us, n, round(motion, 6) AS motion, motion > cut AS present FROM m, c""",
    "cfar_hits": f"""
        WITH {_HOURLY}, s AS (SELECT *, sum(power) OVER (w ROWS BETWEEN 18 PRECEDING AND 3 PRECEDING) AS a,
            sum(power) OVER (w ROWS BETWEEN 3 FOLLOWING AND 18 FOLLOWING) AS b,
            count(power) OVER (w ROWS BETWEEN 18 PRECEDING AND 3 PRECEDING) + count(power) OVER (w ROWS BETWEEN 3 FOLLOWING AND 18 FOLLOWING) AS cells
                FROM h WINDOW w AS (PARTITION BY event_type ORDER BY hour)),
        n AS (SELECT *, CASE WHEN cells > 0 THEN (coalesce(a, 0) + coalesce(b, 0)) / cells END AS noise FROM s), t AS (SELECT *, noise * CASE
            WHEN cells > 0 THEN cells * (pow(0.01, -1.0 / cells) - 1) END AS threshold FROM n)
        SELECT event_type, hour, cells, round(noise, 6) AS noise, round(threshold, 4) AS threshold, coalesce(power > threshold, false) AS hit
            FROM t""",
    "noise_floor": f"WITH {_HOURLY} SELECT event_type, count(*) AS n, round(quantile_cont(power, 0.25) / -ln(0.75), 6) AS floor FROM h GROUP BY 1",
    "truncated_noise_floor": f"""
        WITH {_HOURLY}, q AS (SELECT event_type, quantile_cont(power, 0.25) / -ln(0.75) AS f FROM h GROUP BY 1), u AS (SELECT event_type,
            count(*) AS n, avg(power) AS b, any_value(3 * f) AS c, any_value(f) AS m FROM h JOIN q USING (event_type) WHERE power <= 3 * f
            GROUP BY 1),
        m1 AS (SELECT * REPLACE (CASE WHEN m > 0 THEN b + c / (exp(c / m) - 1) ELSE 0 END AS m) FROM u), m2 AS (SELECT * REPLACE (CASE
            WHEN m > 0 THEN b + c / (exp(c / m) - 1) ELSE 0 END AS m) FROM m1)
        SELECT event_type, n, round(m, 6) AS floor FROM m2""",
    "local_ratio": f"WITH {_HOURLY} SELECT event_type, hour, round(power / median(power) OVER (PARTITION BY event_type ORDER BY hour ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 6) AS ratio FROM h",
    "power_peaks": f"""
        WITH {_HOURLY}, m AS (SELECT *, max(power) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS l, max(power) OVER (w ROWS BETWEEN 1 FOLLOWING
            AND 5 FOLLOWING) AS r FROM h WINDOW w AS (PARTITION BY event_type ORDER BY hour))
        SELECT event_type, hour, round(power, 4) AS power FROM m WHERE coalesce(power > l, true) AND coalesce(power >= r, true)""",
    "hit_runs": f"""
        WITH {_HOURLY}, f AS (SELECT *, CASE WHEN hour - lag(hour) OVER w <= 2 THEN 0 ELSE 1 END AS f FROM h
            WHERE power > 100 WINDOW w AS (PARTITION BY event_type ORDER BY hour)), g AS (SELECT *, sum(f) OVER (PARTITION BY event_type
            ORDER BY hour) AS g FROM f)
        SELECT event_type, min(hour) AS first, max(hour) AS last, count(*) AS hits FROM g GROUP BY event_type, g HAVING count(*) >= 2""",
    "opened_floor": f"""
        WITH {_HOURLY}, m AS (SELECT *, min(power) OVER (PARTITION BY event_type ORDER BY hour ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS l FROM h)
        SELECT event_type, hour, round(max(l) OVER (PARTITION BY event_type ORDER BY hour ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) AS opened
            FROM m""",
    "pooled_rows": f"WITH {_HOURLY} SELECT hour // 24 AS row, round(max(power), 4) AS peak, round(avg(power), 6) AS mean, count(*) AS n FROM h GROUP BY 1",
    "newest_event": f"WITH {_EV} SELECT who, id, event_type, us FROM (SELECT *, row_number() OVER (PARTITION BY who ORDER BY us DESC, id DESC) AS r FROM e) WHERE r = 1",
    "table_difference": """
        WITH a AS (SELECT user_id, event_type FROM events WHERE value < 40), b AS (SELECT user_id, event_type FROM events WHERE value >= 40)
        SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' AS side FROM (SELECT *
            FROM b EXCEPT ALL SELECT * FROM a)""",
    "score_bins": "SELECT floor(value / 25) * 25 AS bin, count(*) AS n, round(avg((event_type = 'view')::INT), 6) AS score FROM events GROUP BY 1",
}
