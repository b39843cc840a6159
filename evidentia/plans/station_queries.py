"""Queries of places heard, recordings, libraries, tiles and their scores."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from evidentia.functions import geo, profiles, stats, text, times
from evidentia.operators import detection, events, hunting, matching, metrics, novelty, records, registry, spatial
from evidentia.operators.tables import written
from evidentia.plans import event_queries as ev
from evidentia.plans import table_queries as tq
from evidentia.sources import captures


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _rounded(df, digits, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


def spots_in_region(spark, sf):
    """Customers whose locator is in two fields, and how many of them lie within 100 km of a place."""
    spots = tq._places(spark, sf).withColumn("grid", geo.locator(F.col("lat"), F.col("lon")))
    here = spots.filter(geo.in_region(F.col("grid"), {"grids": ["jo31", "JO32"]}))
    near = geo.in_region(F.col("grid"), {"lat": 51.5, "lon": 6.5, "km": 100.0})
    return here.select("id", "grid", geo.in_region(F.col("grid"), None).alias("anywhere"), near.alias("near"))


def link_budgets(spark, sf):
    p = _t(spark, sf, "part")
    split = geo.ideal_split_loss_db(F.col("p_size") + 1)
    got = geo.expected_input_dbm(F.lit(10.0), F.col("p_retailprice").cast("double") / 100, split, 0.5)
    return p.select("p_partkey", F.round(split, 5).alias("split_db"), F.round(got, 5).alias("input_dbm"))


def two_ray_losses(spark, sf):
    """Loss from each customer to a mast over flat ground, and the gain of a table antenna that way."""
    p = tq._places(spark, sf)
    metres = geo.haversine_m(F.col("lat"), F.col("lon"), 52.0, 6.0)
    bearing = geo.bearing_deg(F.lit(52.0), F.lit(6.0), F.col("lat"), F.col("lon"))
    loss, gain = geo.two_ray_db(metres, 446e6, 30.0, 2.0), geo.table_gain_dbi(bearing, [0.0, 90.0, 200.0], [6.0, 0.0, -12.0])
    return p.select("id", F.round(loss, 4).alias("loss_db"), F.round(gain, 4).alias("gain_dbi"))


def reach_cells(spark, sf):
    cells = tq._places(spark, sf).withColumnRenamed("id", "cell")
    return _rounded(
        spatial.predicted_reach(cells, 51.0, 6.5, 30.0, F.lit(2.15), 446e6, -90.0, 8.0, 60_000.0), 4, "metres", "bearing", "rx_dbm"
    ).select("cell", "metres", "bearing", "rx_dbm", "covered")


def reach_sectors(spark, sf):
    cells = tq._places(spark, sf).withColumnRenamed("id", "cell")
    reach = spatial.predicted_reach(cells, 51.0, 6.5, 30.0, F.lit(2.15), 446e6, -90.0, 8.0, 60_000.0)
    return _rounded(spatial.reach_by_sector(reach), 3, "farthest_m")


def raster_residuals(spark, sf):
    p = tq._places(spark, sf)
    cell = (F.floor((53.0 - F.col("lat")) / 0.5).alias("row"), F.floor((F.col("lon") - 5.0) / 0.5).alias("col"))
    raster = p.filter("id % 2 = 0").groupBy(*cell).agg(F.avg("value").alias("cell_value"))
    return spatial.residuals(p.filter("id % 2 = 1"), raster, 53.0, 5.0, 0.5).select("id", F.round("residual", 4).alias("residual"))


def run_stamps(spark, sf):
    e = ev._ev(spark, sf)
    return e.select("id", times.run_name(F.col("us"), "Night Watch").alias("run"), times.epoch_of(times.iso(F.col("us"))).alias("second_us"))


def event_latency(spark, sf):
    return _rounded(metrics.latency(_t(spark, sf, "events"), "value", "event_type"), 5, "mean", "p50", "p95", "most")


def box_texts(spark, sf):
    """Boxes of orders as JSON text and back."""
    columns = ["grp", "t0", "t1", "f0", "f1"]
    return matching.boxes_of(matching.box_json(tq._boxes(spark, sf), "id", columns), "grp long, t0 double, t1 double, f0 double, f1 double")


def vector_levels(spark, sf):
    power, clipped = captures.levels(F.col("embedding"), 0.2)
    return _t(spark, sf, "embeddings").select("vec_id", F.round(power, 4).alias("dbfs"), F.round(clipped, 6).alias("clipped"))


def recordable_parts(spark, sf):
    return tq.ledger_labels(spark, sf).select("id", hunting.recordable(F.col("label"), ["new", "background"]).alias("record"))


def _claims(spark, sf):
    b = tq._boxes(spark, sf).join(
        _t(spark, sf, "orders").select(
            F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("cls"), F.col("o_totalprice").cast("double").alias("score")
        ),
        "id"
    )
    guesses, truths = b.filter("id % 2 = 0"), b.filter("id % 2 = 1")
    # Only boxes of one class and group meet.
    pairs = matching.best_overlaps(guesses, truths, 28.0, ["grp", "cls"], 0.2)
    claimed = matching.first_claim(pairs, "id", "id_b", "iou", "score", 0.2).filter("matched").select("id", F.lit(True).alias("hit"))
    return guesses.join(claimed, "id", "left").select(
        "id", "cls", "score", F.coalesce("hit", F.lit(False)).alias("matched")
    ), truths.select("id", "cls")


def box_precision(spark, sf):
    return _rounded(metrics.detection_ap(*_claims(spark, sf)), 6, "ap")


def box_mean_precision(spark, sf):
    return _rounded(metrics.detection_map(metrics.detection_ap(*_claims(spark, sf))), 6, "map")


def language_gap(spark, sf):
    d = tq._scored(spark, sf).join(
        _t(spark, sf, "documents").select("doc_id", "lang"), "doc_id"
    ).withColumn("guess", (F.col("score") > 0.9).cast("int"))
    return _rounded(metrics.domain_gap(d, "lang", "en", "de", "quality", "guess"), 6, "accuracy_a", "accuracy_b", "gap")


def decoder_agreement(spark, sf):
    o = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"))
    return _rounded(records.agreement(tq.confirmed_labels(spark, sf).join(o, "id"), "priority"), 6, "agreement")


def cells_over_floor(spark, sf):
    h = ev.hourly_power(spark, sf)
    floor = detection.quantile_floor(h, "event_type", "power").select("event_type", "floor")
    above = h.join(floor, "event_type").withColumn("above_db", 10 * F.log10(F.col("power") / F.col("floor")))
    return above.select(
        "event_type", "hour", F.round("above_db", 5).alias("above_db"), detection.floor_mask(F.col("above_db"), 0.05, 2, 0.5).alias("over")
    )


_LAYOUT = detection.tile_layout(1 / 3600, 1, 7 * 86_400.0, 7)


def tile_cells(spark, sf):
    """Events per day as rows of tiles of a week that overlap by half, with the second at which each row begins, and back."""
    h = ev.hourly_power(spark, sf)
    start = h.agg(F.min("hour").alias("begin"))
    frames = h.join(F.broadcast(start)).withColumn("frame", F.col("hour") - F.col("begin"))
    rows = detection.tiles(frames, ["event_type"], "frame", "power", _LAYOUT)
    at = detection.row_time(F.col("tile"), F.col("row"), 1 / 3600, 1, _LAYOUT)
    back = detection.time_row(F.col("tile"), at, 1 / 3600, 1, _LAYOUT)
    return rows.select(
        "event_type", "tile", "row", F.round("power", 5).alias("power"), F.round(at, 3).alias("begin_s"), F.round(back, 6).alias("back")
    )


def run_strengths(spark, sf):
    h = ev.hourly_power(spark, sf)
    boxes = ev.hit_runs(spark, sf).withColumn("box", F.col("first"))
    return _rounded(detection.box_snr_db(h, boxes, ["event_type"], "hour", "power"), 5, "snr_db")


def interval_peaks(spark, sf):
    e = ev._ev(spark, sf, "event_type")
    return _rounded(events.difference_peaks(events.lag_histogram(e, "event_type", 3, 5), e, "event_type", 0.2), 5, "bound")


def user_graph(spark, sf):
    found = events.user_graph(ev._ev(spark, sf), 3_600_000_000, 3, 0.45)
    return found.withColumn("weight", F.floor(F.col("weight") * 1e5 + 0.5) / 1e5)


def stale_orders(spark, sf):
    o = _t(spark, sf, "orders")
    trained = o.filter("o_totalprice > 100000").select(F.col("o_orderkey").alias("id"))
    return records.stale_originals(trained, o.select(F.col("o_orderkey").alias("id"), records.role(F.col("o_custkey")).alias("role")))


def line_labels(spark, sf):
    """Labels in an array of each order, one row a label, with those of one source replaced."""
    li = _t(spark, sf, "lineitem")
    packed = li.groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_linestatus").alias("source"), "l_quantity"))).alias("labels")
    )
    old = records.annotations(packed, "l_orderkey", "labels").select(
        "id", "l_linenumber", "source", F.col("l_quantity").cast("double").alias("value")
    )
    new = _t(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.lit(0).cast(old.schema["l_linenumber"].dataType).alias("l_linenumber"), F.lit("O").alias("source"),
        F.col("o_totalprice").cast("double").alias("value")
    )
    return records.replace_source(old, new, "O")


def checked_actions(spark, sf):
    o = _t(spark, sf, "orders")
    kind = F.when(F.pmod("o_custkey", F.lit(5)) == 0, "stop").when(F.pmod("o_custkey", F.lit(5)) == 1, "dwell").when(
        F.pmod("o_custkey", F.lit(5)) == 2, "transmit"
    ).otherwise("look")
    rows = o.select(
        "o_orderkey", kind.alias("kind"), F.col("o_totalprice").cast("double").alias("centre_hz"),
        F.pmod("o_orderkey", F.lit(90)).cast("double").alias("dwell_s")
    )
    return rows.select("o_orderkey", hunting.valid_action(50_000.0, 200_000.0, 60.0).alias("v")).select("o_orderkey", "v.ok", "v.why")


def profile_names(spark, sf):
    """Identities made of a part's type and size, and taken apart again."""
    family = F.regexp_replace(F.lower("p_type"), "[^a-z0-9]+", "-")
    made = _t(spark, sf, "part").select(
        "p_partkey",
        profiles.make_id(family, F.col("p_size") * 1000, F.lit("ci16"), F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]+", "-"))).alias("name")
    )
    return made.select(
        "p_partkey", "name", profiles.parse_id(F.col("name")).alias("x")
    ).select("p_partkey", "name", "x.family", "x.rate", "x.kind", "x.variant")


def _examples(spark, sf):
    o = _t(spark, sf, "orders")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date"))
    return o.select(
        F.col("o_orderkey").alias("id"), F.pmod("o_custkey", F.lit(40)).cast("string").alias("recording"), day.alias("start"), (day + 2).alias("stop"),
        F.when(
            F.pmod("o_orderkey", F.lit(3)) == 0, "copy"
        ).otherwise("original").alias("kind"), (F.pmod("o_orderkey", F.lit(11)) == 0).alias("removed"), records.role(F.col("o_custkey")).alias("role"),
    )


def clashing_examples(spark, sf):
    return registry.overlapping_examples(_examples(spark, sf), 30)


def moved_examples(spark, sf):
    """Examples after one recording's role changed, some were removed, and of these some taken back."""
    x = registry.set_role(_examples(spark, sf), "7", "test")
    gone, back = x.filter("id % 4 = 0").select("id"), x.filter("id % 8 = 0").select("id")
    return registry.remove(registry.remove(x, gone), back, back=True).select("id", "role", "removed")


def usable_models(spark, sf):
    p = _t(spark, sf, "part")
    kind = F.substring("p_type", 1, 3)
    cards = p.select(
        F.concat_ws("/", "p_brand", kind, F.pmod("p_size", F.lit(5))).alias("name"), F.col("p_partkey").alias("version"),
        F.col("p_brand").alias("profile"), kind.alias("kind"), (F.col("p_size") > 25).alias("retired")
    )
    first = cards.agg(F.min("profile"), F.min("kind")).first()
    return registry.usable(cards, first[0], first[1]).select("name", "version")


def next_customer_stops(spark, sf):
    o = _t(spark, sf, "orders")
    state = F.when(
        F.pmod("o_orderkey", F.lit(9)) == 0, "confirm"
    ).when(F.pmod("o_orderkey", F.lit(7)) == 0, "again").when(F.col("o_orderstatus") == "O", "new").otherwise("done")
    stops = o.select(
        F.col("o_custkey").alias("receiver"), F.col("o_orderkey").alias("stop"), F.col("o_totalprice").cast("double").alias("order"),
        state.alias("state")
    )
    return hunting.next_stops(stops, "receiver", 2)


def spoken_numbers(spark, sf):
    o = _t(spark, sf, "orders")
    return o.select(
        "o_orderkey", text.hz_words(F.col("o_totalprice").cast("double") * 1000 + 1).alias("hz"),
        text.seconds_words(F.col("o_totalprice").cast("double") / 50 + 0.001).alias("seconds")
    )


def _sentence_scores(spark, sf):
    return novelty.new_sentences(_t(spark, sf, "documents"), "doc_id", "text", _t(spark, sf, "benchmark"), "text")


def novelty_verdicts(spark, sf):
    """Documents judged by the threshold that nine of ten sentences of all documents stay under, 0.5 at least."""
    scored = written(_sentence_scores(spark, sf), "scores")  # read by the threshold and by the verdicts
    return _rounded(novelty.verdicts(scored, novelty.calibrated(scored)), 6, "share")


_FIELDS = {"licence": r"(?m)^(?:Licensed|Released) under (?:the )?([^\n.]+)", "opening": r"^([A-Za-z]+)"}


def document_canvas(spark, sf):
    return records.canvas(_t(spark, sf, "documents"), "doc_id", "text", _FIELDS).select("id", "field", "value", "ok", "why")


def canvas_gaps(spark, sf):
    return records.complete(document_canvas(spark, sf))


def price_lines(spark, sf):
    return _rounded(
        metrics.linear_fit(_t(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag"), 4, "slope", "intercept", "nmse_db"
    )


def _by_price(spark, sf):
    claims, _ = _claims(spark, sf)
    return metrics.detection_by_level(claims.withColumn("level", F.col("score") / 1000), "level", F.col("matched"), 25.0)


def detection_curve(spark, sf):
    return _rounded(_by_price(spark, sf), 6, "detected")


def detection_level(spark, sf):
    return _rounded(metrics.level_at(_by_price(spark, sf), 0.3), 5, "level")


def false_marks_an_hour(spark, sf):
    claims, _ = _claims(spark, sf)
    return _rounded(metrics.false_alarm_rate(claims, ~F.col("matched"), 86_400.0, "cls"), 5, "an_hour")


def looked_at_users(spark, sf):
    """Cells by user, after the looks of odd events are added to those of even ones."""
    e = _t(spark, sf, "events").select(
        F.col("user_id").alias("cell"), times.micros("ts").alias("t"), (F.col("event_type") == "purchase").cast("long").alias("finds"), "event_id"
    )
    old = e.filter("event_id % 2 = 0").groupBy("cell").agg(
        F.count(F.lit(1)).alias("looks"), F.sum("finds").alias("finds"), F.max("t").alias("looked")
    )
    return hunting.observed(old, e.filter("event_id % 2 = 1"))


QUERIES = {f.__name__: f for f in (
    spots_in_region, link_budgets, two_ray_losses, reach_cells, reach_sectors, raster_residuals, run_stamps, event_latency, box_texts, vector_levels, recordable_parts, box_precision, box_mean_precision, language_gap,
    decoder_agreement, cells_over_floor, tile_cells, run_strengths, interval_peaks, user_graph, stale_orders, line_labels, checked_actions, profile_names, clashing_examples, moved_examples, usable_models, next_customer_stops, spoken_numbers,
    novelty_verdicts, document_canvas, canvas_gaps, price_lines, detection_curve, detection_level, false_marks_an_hour, looked_at_users,
)}

_SQL = tq.ORACLE_SQL
_EV, _HOURLY = ev._EV, ev._HOURLY
_REACH = f"""
    WITH {tq._P}, m AS (SELECT id AS cell, {tq._HAV.format(a="51.0", b="6.5", c="lat", d="lon")} AS metres,
        {tq._BEAR.format(a="51.0", b="6.5", c="lat", d="lon")} AS bearing FROM p),
    r AS (SELECT *, 30 + 2.15 - 20 * log10(4 * pi() * greatest(metres, 1) / (299792458.0 / 446e6)) AS rx_dbm FROM m WHERE metres <= 60000),
        q AS (SELECT *, rx_dbm >= -82 AS covered FROM r)"""
_MASK = 10 * math.log10(stats.floor_alpha(0.05, 2)) + 0.5
_CLAIMS = f"""
    WITH {tq._BOX}, k AS (SELECT b.*, o_orderstatus AS cls, o_totalprice::DOUBLE AS score FROM b JOIN orders ON o_orderkey = id),
    c AS (SELECT x.id, y.id AS id_b, x.score, round({tq._IOU}, 9) AS iou FROM k AS x JOIN k AS y ON x.id % 2 = 0 AND y.id % 2 = 1 AND x.grp = y.grp
        AND x.cls = y.cls AND x.t0 < y.t1 AND y.t0 < x.t1),
    f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY iou DESC, id_b) AS r FROM c WHERE iou >= 0.2), u AS (SELECT id,
        row_number() OVER (PARTITION BY id_b ORDER BY score DESC, id) = 1 AS matched FROM f WHERE r = 1),
    g AS (SELECT k.id, k.cls, k.score, coalesce(matched, false) AS matched FROM k LEFT JOIN u USING (id) WHERE k.id % 2 = 0), a AS (SELECT cls, score,
        sum(matched::INT) AS hit, count(*) AS n FROM g GROUP BY ALL),
    d AS (SELECT *, sum(hit) OVER w / sum(n) OVER w AS prec FROM a WINDOW w AS (PARTITION BY cls ORDER BY score DESC)), e AS (SELECT *,
        max(prec) OVER (PARTITION BY cls ORDER BY score) AS best FROM d),
    s AS (SELECT cls, sum(hit * best) AS area FROM e GROUP BY 1), t AS (SELECT cls, count(*) AS truths FROM k WHERE id % 2 = 1 GROUP BY 1),
        ap AS (SELECT t.cls, truths, coalesce(area, 0) / truths AS ap FROM t LEFT JOIN s USING (cls))"""
_EXAMPLES = """
    WITH x AS (SELECT o_orderkey AS id, (o_custkey % 40)::VARCHAR AS recording, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS start, CASE
        WHEN o_orderkey % 3 = 0 THEN 'copy' ELSE 'original' END AS kind,
        o_orderkey % 11 = 0 AS removed, CASE o_custkey % 5 WHEN 2 THEN 'test' WHEN 4 THEN 'val' ELSE 'train' END AS role FROM orders)"""
_TURN = "(2 * pi() * 446e6 / 299792458.0 * (s2 - s1))"
_SHOW = "regexp_replace(printf('%.3f', {x}), '\\.?0+$', '') || '{u}'"

_SENTENCES = _SQL["novelty_rank"].replace("SELECT t.id, grams,", "SELECT t.id, t.i, grams,").rpartition("SELECT id, round")[0]
_CANVAS = rf"""
    WITH g AS (SELECT doc_id AS id, coalesce(text, '') AS text, 'licence' AS field, nullif(regexp_extract(text,
        '(?m)^(?:Licensed|Released) under (?:the )?([^\n.]+)', 1), '') AS got FROM documents
        UNION ALL SELECT doc_id, coalesce(text, ''), 'opening', nullif(regexp_extract(text, '^([A-Za-z]+)', 1), '') FROM documents),
    w AS (SELECT *, CASE WHEN regexp_matches(got, '(?i)\[(?:redacted|removed|withheld)\]|█{{2,}}|\bX{{4,}}\b') THEN 'redacted'
        WHEN got IS NULL OR trim(got) = '' THEN 'empty'
        WHEN lower(trim(got, ' .' || chr(9))) IN ('-', 'n/a', 'na', 'nil', 'none', 'not stated', 'null', 'unknown', 'not known',
            'not given') THEN 'null wording'
        WHEN NOT contains(' ' || array_to_string({tq._WORDS.format(t="text")}, ' ') || ' ', ' ' || array_to_string({tq._WORDS.format(t="got")},
            ' ') || ' ') OR len({tq._WORDS.format(t="got")}) = 0 THEN 'no support' END AS why FROM g)
    SELECT id, field, CASE WHEN why IS NULL THEN got END AS value, why IS NULL AS ok, why FROM w"""
_CURVE = f"{_CLAIMS}, curve AS (SELECT floor(score / 1000 / 25) * 25 AS bin, count(*) AS n, avg(matched::INT) AS detected FROM g GROUP BY 1)"

ORACLE_SQL = {
    "spots_in_region": f"""
        WITH g AS (SELECT id, grid, upper(grid) AS u FROM ({_SQL['locators']}) WHERE grid LIKE 'JO31%' OR grid LIKE 'JO32%'),
        c AS (SELECT *, (ascii(u[2]) - 65) * 10 + u[4]::INT + (ascii(u[6]) - 65) / 24 + 0.5 / 24 - 90 AS lat,
            (ascii(u[1]) - 65) * 20 + u[3]::INT * 2 + (ascii(u[5]) - 65) / 12 + 1 / 24 - 180 AS lon FROM g)
        SELECT id, grid, true AS anywhere, {tq._HAV.format(a="lat", b="lon", c="51.5", d="6.5")} <= 100000 AS near FROM c""",
    "link_budgets": "SELECT p_partkey, round(10 * log10(p_size + 1), 5) AS split_db, round(10.0 - p_retailprice::DOUBLE / 100 - 10 * log10(p_size + 1) - 0.5, 5) AS input_dbm FROM part",
    "two_ray_losses": f"""
        WITH {tq._P}, m AS (SELECT id, {tq._HAV.format(a="lat", b="lon", c="52.0", d="6.0")} AS d,
            {tq._BEAR.format(a="52.0", b="6.0", c="lat", d="lon")} AS az FROM p),
        r AS (SELECT *, sqrt(d * d + 28.0 * 28) AS s1, sqrt(d * d + 32.0 * 32) AS s2, sin(atan2(32.0, d)) AS s, 15.0 - pow(cos(atan2(32.0, d)),
            2) AS re, -0.005 * 299792458.0 / 446e6 * 60 AS loss FROM m),
        z AS (SELECT *, sqrt(sqrt(re * re + loss * loss)) * cos(atan2(loss, re) / 2) AS zr, sqrt(sqrt(re * re + loss * loss)) * sin(atan2(loss,
            re) / 2) AS zi FROM r),
        q AS (SELECT *, 15 * s - zr AS nr, loss * s - zi AS ni, 15 * s + zr AS dr, loss * s + zi AS di FROM z),
        g AS (SELECT *, (nr * dr + ni * di) / (dr * dr + di * di) AS gr, (ni * dr - nr * di) / (dr * dr + di * di) AS gi FROM q),
        h AS (SELECT *, 1 / s1 + (gr * cos({_TURN}) + gi * sin({_TURN})) / s2 AS x, (gi * cos({_TURN}) - gr * sin({_TURN})) / s2 AS y FROM g)
        SELECT id, round(-20 * log10(299792458.0 / 446e6 / (4 * pi()) * sqrt(x * x + y * y)), 4) AS loss_db,
               round(CASE WHEN az < 90 THEN 6 - 6 * az / 90 WHEN az < 200 THEN -12 * (az - 90) / 110 ELSE -12 + 18 * (az - 200) / 160 END,
                   4) AS gain_dbi FROM h""",
    "reach_cells": f"{_REACH} SELECT cell, round(metres, 4) AS metres, round(bearing, 4) AS bearing, round(rx_dbm, 4) AS rx_dbm, covered FROM q",
    "reach_sectors": f"{_REACH} SELECT (floor(bearing * 12 / 360)::INT % 12)::INT AS sector, count(*) AS cells, sum(covered::INT)::BIGINT AS covered, round(max(CASE WHEN covered THEN metres END), 3) AS farthest_m FROM q GROUP BY 1",
    "raster_residuals": f"""
        WITH {tq._P}, c AS (SELECT *, floor((53.0::DOUBLE - lat) / 0.5::DOUBLE) AS row, floor((lon - 5.0::DOUBLE) / 0.5::DOUBLE) AS col FROM p),
            g AS (SELECT row, col, avg(value) AS v FROM c WHERE id % 2 = 0 GROUP BY ALL)
        SELECT id, round(value - v, 4) AS residual FROM c JOIN g USING (row, col) WHERE id % 2 = 1""",
    "run_stamps": f"WITH {_EV} SELECT id, strftime(ts, '%Y%m%d-%H%M%SZ') || '-night-watch' AS run, us // 1000000 * 1000000 AS second_us FROM e",
    "event_latency": "SELECT event_type, count(value) AS n, round(avg(value), 5) AS mean, round(quantile_cont(value, 0.5), 5) AS p50, round(quantile_cont(value, 0.95), 5) AS p95, round(max(value), 5) AS most FROM events GROUP BY 1",
    "box_texts": f"WITH {tq._BOX} SELECT * FROM b",
    "vector_levels": """
        SELECT vec_id, round(10 * log10(greatest(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding), 1e-20)),
            4) AS dbfs,
               round(len(list_filter(embedding, lambda x: abs(x::DOUBLE) >= 0.2)) / len(embedding), 6) AS clipped FROM embeddings""",
    "recordable_parts": f"SELECT id, label IN ('new', 'background') AS record FROM ({_SQL['ledger_labels']})",
    "box_precision": f"{_CLAIMS} SELECT cls, truths, round(ap, 6) AS ap FROM ap",
    "box_mean_precision": f"{_CLAIMS} SELECT count(DISTINCT cls) AS classes, round(avg(ap), 6) AS map FROM ap",
    "language_gap": f"""
        WITH {tq._SCORED}, r AS (SELECT lang, ((score > 0.9)::INT = quality)::INT AS ok FROM s JOIN documents USING (doc_id))
        SELECT count(*) FILTER (lang = 'en') AS n_a, count(*) FILTER (lang = 'de') AS n_b, round(avg(ok) FILTER (lang = 'en'), 6) AS accuracy_a,
            round(avg(ok) FILTER (lang = 'de'), 6) AS accuracy_b,
               round(avg(ok) FILTER (lang = 'en') - avg(ok) FILTER (lang = 'de'), 6) AS gap FROM r""",
    "decoder_agreement": f"""
        WITH c AS ({_SQL['confirmed_labels']}), s AS (SELECT o_orderpriority AS priority, count(*) AS boxes, count(decoder) AS confirmed,
            count(*) FILTER (decoder IS NOT NULL AND coalesce(disagrees, false)) AS disagreements
            FROM c JOIN orders ON o_orderkey = id GROUP BY 1)
        SELECT *, round(CASE WHEN confirmed > 0 THEN 1 - disagreements / confirmed END, 6) AS agreement FROM s""",
    "cells_over_floor": f"""
        WITH {_HOURLY}, f AS (SELECT event_type, quantile_cont(power, 0.25) / -ln(0.75) AS floor FROM h GROUP BY 1), a AS (SELECT event_type, hour,
            10 * log10(power / floor) AS above FROM h JOIN f USING (event_type))
        SELECT event_type, hour, round(above, 5) AS above_db, above > {_MASK!r} AS over FROM a""",
    "tile_cells": f"""
        WITH {_HOURLY}, r AS (SELECT event_type, (hour - (SELECT min(hour) FROM h)) // {_LAYOUT['pool']} AS k, avg(power) AS power FROM h
            GROUP BY ALL),
        t AS (SELECT *, unnest(range(greatest(ceil((k - {_LAYOUT['rows'] - 1}) / {_LAYOUT['step']})::BIGINT, 0), k // {_LAYOUT['step']} + 1)) AS tile
            FROM r)
        SELECT event_type, tile, k - tile * {_LAYOUT['step']} AS row, round(power, 5) AS power, round(k * {_LAYOUT['pool']} * 3600.0,
            3)::DOUBLE AS begin_s, (k - tile * {_LAYOUT['step']})::DOUBLE AS back FROM t""",
    "run_strengths": f"""
        WITH {_HOURLY}, b AS (SELECT event_type, "first", "last" FROM ({ev.ORACLE_SQL['hit_runs']})), m AS (SELECT h.*, b.first AS box FROM h LEFT
            JOIN b ON b.event_type = h.event_type AND hour BETWEEN b.first AND b.last),
        n AS (SELECT event_type, avg(power) AS noise FROM m WHERE box IS NULL GROUP BY 1)
        SELECT event_type, box, round(10 * log10(avg(power) / any_value(noise)), 5) AS snr_db FROM m JOIN n USING (event_type) WHERE box IS NOT NULL
            GROUP BY ALL""",
    "interval_peaks": f"""
        WITH g AS ({ev.ORACLE_SQL['lag_histogram']}), t AS (SELECT event_type, count(*) AS total FROM events GROUP BY 1), s AS (SELECT event_type,
            min(cell) AS low, max(cell) - min(cell) + 1 AS cells FROM g GROUP BY 1),
        l AS (SELECT g.*, 0.2 * (total - lag) * exp(-(cell - low) / (0.5 * cells)) AS lim FROM g JOIN t USING (event_type) JOIN s USING (event_type))
        SELECT event_type, lag, cell, n, round(lim, 5) AS bound FROM l WHERE n > lim""",
    "user_graph": f"""
        WITH {_EV}, a AS (SELECT DISTINCT who, us // 3600000000 AS bin FROM e), b AS (SELECT who, count(*) AS n FROM a GROUP BY 1),
            s AS (SELECT max(bin) - min(bin) + 1 AS bins FROM a),
        p AS (SELECT x.who AS who_a, y.who AS who_b, count(*) AS together FROM a AS x JOIN a AS y ON x.bin = y.bin AND x.who < y.who GROUP BY ALL
            HAVING count(*) >= 3),
        q AS (SELECT who_a, who_b, 'together' AS kind, together / (ba.n * bb.n / bins) AS w FROM p JOIN b AS ba ON ba.who = who_a
            JOIN b AS bb ON bb.who = who_b, s),
        c AS (SELECT who, ((us // 3600000000) + 72) % 168 AS slot, count(*) AS n FROM e GROUP BY ALL),
            o AS (SELECT who, sum(n * n)::DOUBLE AS size FROM c GROUP BY 1),
        d AS (SELECT x.who AS who_a, y.who AS who_b, sum(x.n * y.n)::DOUBLE AS dot FROM c AS x JOIN c AS y ON x.slot = y.slot AND x.who < y.who GROUP BY ALL),
        k0 AS (SELECT who_a, who_b, 'schedule' AS kind, dot / sqrt(oa.size * ob.size) AS w FROM d JOIN o AS oa ON oa.who = who_a JOIN o AS ob ON ob.who = who_b),
        k AS (SELECT * FROM k0 WHERE w >= 0.45)
        SELECT who_a, who_b, string_agg(kind, '+' ORDER BY kind) AS kinds, floor(sum(w) * 1e5 + 0.5) / 1e5 AS weight FROM (SELECT * FROM q UNION ALL SELECT * FROM k)
            GROUP BY ALL""",
    "stale_orders": "SELECT o_orderkey AS id FROM orders WHERE o_totalprice > 100000 AND o_custkey % 5 IN (2, 4)",
    "line_labels": """
        SELECT l_orderkey AS id, l_linenumber, l_linestatus AS source, l_quantity::DOUBLE AS value FROM lineitem WHERE l_linestatus <> 'O'
        UNION ALL SELECT o_orderkey, 0, 'O', o_totalprice::DOUBLE FROM orders""",
    "checked_actions": """
        WITH a AS (SELECT o_orderkey, CASE o_custkey % 5 WHEN 0 THEN 'stop' WHEN 1 THEN 'dwell' WHEN 2 THEN 'transmit' ELSE 'look' END AS kind,
            o_totalprice::DOUBLE AS hz, (o_orderkey % 90)::DOUBLE AS d FROM orders),
        w AS (SELECT o_orderkey, CASE WHEN kind = 'transmit' THEN 'unknown kind of action' WHEN kind <> 'stop' AND NOT hz BETWEEN 50000
            AND 200000 THEN 'frequency out of range' WHEN kind = 'dwell' AND NOT (d > 0 AND d <= 60) THEN 'dwell out of range' END AS why FROM a)
        SELECT o_orderkey, why IS NULL AS ok, why FROM w""",
    "profile_names": """
        WITH f AS (SELECT p_partkey, regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g') AS family, (p_size * 1000)::BIGINT AS rate,
            lower(regexp_replace(p_brand, '[^A-Za-z0-9]+', '-', 'g')) AS variant FROM part)
        SELECT p_partkey, family || '_' || rate || '_ci16_' || variant AS name, family, rate, 'ci16' AS kind, variant FROM f""",
    "clashing_examples": f"{_EXAMPLES} SELECT a.recording, a.id, b.id AS id_b FROM x AS a JOIN x AS b ON a.recording = b.recording AND a.id < b.id AND a.start < b.start + 2 AND b.start < a.start + 2 WHERE a.kind = 'original' AND b.kind = 'original' AND NOT a.removed AND NOT b.removed",
    "moved_examples": f"{_EXAMPLES} SELECT id, CASE WHEN recording = '7' THEN 'test' ELSE role END AS role, CASE WHEN id % 8 = 0 THEN false WHEN id % 4 = 0 THEN true ELSE removed END AS removed FROM x",
    "usable_models": """
        WITH c AS (SELECT concat_ws('/', p_brand, p_type[1:3], p_size % 5) AS name, p_partkey AS version, p_brand AS profile, p_type[1:3] AS kind,
            p_size > 25 AS retired, row_number() OVER (PARTITION BY p_brand, p_type[1:3], p_size % 5 ORDER BY p_partkey DESC) AS r FROM part)
        SELECT name, version FROM c WHERE r = 1 AND profile = (SELECT min(profile) FROM c) AND kind = (SELECT min(kind) FROM c) AND NOT retired""",
    "next_customer_stops": """
        WITH s AS (SELECT o_custkey AS receiver, o_orderkey AS stop, o_totalprice::DOUBLE AS o, CASE WHEN o_orderkey % 9 = 0 THEN 0
            WHEN o_orderkey % 7 = 0 THEN 1 WHEN o_orderstatus = 'O' THEN 2 END AS r FROM orders),
        k AS (SELECT *, row_number() OVER (PARTITION BY receiver ORDER BY r NULLS LAST, o, stop) AS i,
            count(*) FILTER (r = 0) OVER (PARTITION BY receiver) AS waiting FROM s)
        SELECT receiver, waiting, CASE WHEN waiting <= 2 AND r IS NOT NULL THEN stop END AS stop FROM k WHERE i = 1""",
    "spoken_numbers": f"""
        WITH v AS (SELECT o_orderkey, o_totalprice::DOUBLE * 1000 + 1 AS hz, o_totalprice::DOUBLE / 50 + 0.001 AS s FROM orders)
        SELECT o_orderkey, CASE WHEN hz >= 1e9 THEN {_SHOW.format(x="hz / 1e9", u=" GHz")} WHEN hz >= 1e6 THEN {_SHOW.format(x="hz / 1e6", u=" MHz")}
            WHEN hz >= 1e3 THEN {_SHOW.format(x="hz / 1e3", u=" kHz")} ELSE {_SHOW.format(x="hz", u=" Hz")} END AS hz,
            CASE WHEN s >= 3600 THEN printf('%.1f h', s / 3600) WHEN s >= 60 THEN printf('%.1f min', s / 60) WHEN s >= 1 THEN printf('%.1f s', s)
                ELSE printf('%.1f ms', s * 1000) END AS seconds FROM v""",
    "novelty_verdicts": f"""
        {_SENTENCES}, c AS (SELECT greatest(quantile_cont(score, 0.9), 0.5) AS tau FROM r), d AS (SELECT id, count(*) AS sentences,
            sum((score > tau)::INT)::BIGINT AS novel FROM r, c GROUP BY 1)
        SELECT id, sentences, novel, round(novel / sentences, 6) AS share, CASE WHEN sentences < 3 THEN 'too short'
            WHEN novel / sentences >= 0.5 THEN 'new' WHEN novel > 0 THEN 'partly new' ELSE 'known' END AS verdict FROM d""",
    "document_canvas": _CANVAS,
    "canvas_gaps": f"SELECT id, sum(ok::INT)::BIGINT AS found, coalesce(string_agg(CASE WHEN NOT ok THEN field END, ',' ORDER BY field), '') AS missing FROM ({_CANVAS}) GROUP BY 1",
    "price_lines": """
        WITH f AS (SELECT l_returnflag, l_quantity::DOUBLE AS x, l_extendedprice::DOUBLE AS y FROM lineitem), r AS (SELECT l_returnflag,
            count(*) AS n, regr_slope(y, x) AS s, regr_intercept(y, x) AS i, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy, sum(y * y) AS p FROM f
            GROUP BY 1)
        SELECT l_returnflag, n, round(s, 4) AS slope, round(i, 4) AS intercept, round(10 * log10(greatest(greatest(syy - s * sxy, 0) / p, 1e-20)),
            4) AS nmse_db FROM r""",
    "detection_curve": f"{_CURVE} SELECT bin, n, round(detected, 6) AS detected FROM curve",
    "detection_level": f"""
        {_CURVE}, l AS (SELECT bin, detected, lag(bin) OVER (ORDER BY bin) AS b, lag(detected) OVER (ORDER BY bin) AS d FROM curve)
        SELECT round(min_by(CASE WHEN d < 0.3 THEN b + (bin - b) * (0.3::DOUBLE - d) / (detected - d) ELSE bin END, bin), 5) AS level FROM l
            WHERE detected >= 0.3""",
    "false_marks_an_hour": f"{_CLAIMS} SELECT cls, sum((NOT matched)::INT)::BIGINT AS false_marks, round(sum((NOT matched)::INT) * 3600 / 86400.0::DOUBLE, 5) AS an_hour FROM g GROUP BY 1",
    "looked_at_users": """
        WITH e AS (SELECT user_id AS cell, epoch_us(ts) AS t, (event_type = 'purchase')::INT AS f, event_id % 2 = 0 AS old FROM events)
        SELECT cell, count(*) AS looks, sum(f)::BIGINT AS finds, max(t) AS looked FROM e WHERE cell IN (SELECT cell FROM e WHERE old) GROUP BY 1""",
}
