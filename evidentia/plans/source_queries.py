"""Queries of readers and writers: the tables' rows are written as logs, files and features, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evidentia.functions import text
from evidentia.operators.tables import shared_folder
from evidentia.plans import series_queries as sq
from evidentia.plans import table_queries as tq
from evidentia.sources import captures, logs, rasters


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _rounded(df, digits, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


def parsed_spots(spark, sf):
    """Customers as lines of a spot log: some out of range, with a call that is none, or torn."""
    k = F.col("c_custkey")
    letters = [F.chr(65 + F.pmod(F.floor(k / d), F.lit(26))) for d in (1, 26, 676)]
    call = F.concat(F.lit("K"), F.pmod(k, F.lit(10)).cast("string"), F.concat(*letters))
    line = F.concat_ws(
        " ", F.lit("240101"), F.lpad((F.pmod(k, F.lit(24)) * 100).cast("string"), 4, "0"), F.when(k % 17 == 0, "-99").otherwise((F.pmod(k, F.lit(40)) - 30).cast("string")),
        F.format_string("%.1f", F.pmod(k, F.lit(9)) / 10), F.format_string("%.6f", 7.04 + F.pmod(k, F.lit(100)) / 100_000),
        F.when(k % 19 == 0, "not-a-call").otherwise(call), F.lit("JO31"), F.pmod(k, F.lit(60)).cast("string"), F.lit("0")
    )
    lines = _t(spark, sf, "customer").select(F.when(k % 23 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value"))
    found = logs.spots(lines)
    good = found.filter("skip IS NULL").select("call", "snr", "dt", F.round("mhz", 6).alias("mhz"), "grid", "power", "skip")
    return good.unionByName(logs.skipped(found.filter("skip IS NOT NULL")).select(
        F.lit(None).cast("string").alias("call"), F.col("n").cast("int").alias("snr"), F.lit(None).cast("double").alias("dt"), F.lit(None).cast("double").alias("mhz"),
        F.lit(None).cast("string").alias("grid"), F.lit(None).cast("int").alias("power"), "skip"
    ))


def channel_frames(spark, sf):
    """Lines as frames of each supplier's console log, with headers in two orders, and their summed magnitudes."""
    li = _t(spark, sf, "lineitem")
    q, p = F.col("l_quantity").cast("int"), F.col("l_partkey")
    body = F.concat_ws(" ", q, F.when(F.col("l_linenumber") == 7, 200).otherwise(-q), F.pmod(p, F.lit(100)), F.pmod(p, F.lit(90)))
    odd = F.col("l_suppkey") % 2 == 1
    named = F.when(odd, F.concat(F.lit("m,"), F.col("l_orderkey").cast("string"))).otherwise(F.concat(F.col("l_orderkey").cast("string"), F.lit(",m")))
    frame = F.concat(F.lit("CSI_DATA,"), named, F.lit(",-40,1,4,\"["), body, F.lit("]\""))
    frames = li.select(F.col("l_suppkey").alias("file"), F.col("l_orderkey").alias("n"), frame.alias("value"), "l_linenumber")
    head = F.when(F.col("s_suppkey") % 2 == 1, "type,mac,seq,rssi,rate,len,data").otherwise("type,seq,mac,rssi,rate,len,data")
    heads = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("file"), F.lit(-1).cast("long").alias("n"), head.alias("value"), F.lit(0).alias("l_linenumber"))
    rows = logs.amplitudes(logs.channel_state(frames.unionByName(heads), "n"))
    total = F.aggregate("amp", F.lit(0.0), lambda s, x: s + x)
    return rows.groupBy("file", "skip").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seqs"), F.max("mac").alias("mac"), F.round(F.sum(total), 3).alias("amp"))


def track_fixes(spark, sf):
    """Customers as rows of a track with other names, some off the globe or without a time."""
    p = tq._places(spark, sf)
    rows = p.select(
        F.when(F.col("id") % 11 != 0, F.col("id").cast("string")).alias("epoch"), F.when(F.col("id") % 13 == 0, "95.0").otherwise(F.col("lat").cast("string")).alias("Latitude"),
        F.col("lon").cast("string").alias("lng"), F.when(F.col("id") % 3 == 0, "12.5").otherwise("?").alias("accuracy")
    )
    return _rounded(logs.tracks(rows), 6, "lat", "lon").select("t", "lat", "lon", "alt", "sigma")


def heard_levels(spark, sf):
    """Parts as a drive: what is heard of two senders, where anything is."""
    p = _t(spark, sf, "part")
    rows = p.select(
        F.col("p_partkey").cast("string").alias("t"), F.lit("50").alias("lat"), F.lit("6").alias("lon"), F.when(F.col("p_size") > 25, F.col("p_size").cast("string")).otherwise("").alias("a"),
        F.when(F.col("p_size") % 2 == 0, (-F.col("p_size")).cast("string")).alias("b")
    )
    return logs.drive_log(rows).select("t", "key", "value")


def sounds_read_back(spark, sf):
    """Each supplier's discounts as a WAV file, read back: sums of its samples."""
    x = sq._samples(spark, sf, "l_discount").select("capture", "at", (F.col("l_discount") * 20 - 1).alias("value"))
    files = captures.wav_files(x, "capture", 8000)
    back = captures.wav_table(files).join(files.select("path", F.col("clipped").alias("over")), "path")
    total = F.aggregate("samples", F.lit(0.0), lambda s, v: s + v.cast("double"))
    return back.select(
        F.regexp_extract("path", r"(\d+)\.wav", 1).cast("long").alias("capture"), "rate", F.size("samples").alias("n"), (F.round(total, 3) + 0.0).alias("total"), "clipped", "over"
    )


def rasters_read_back(spark, sf):
    """Customers' balances on a grid as raster files of 64 cells a side, read back."""
    p = tq._places(spark, sf)
    cell = (F.floor((53.0 - F.col("lat")) / 0.02).alias("row"), F.floor((F.col("lon") - 5.0) / 0.02).alias("col"))
    cells = p.groupBy(*cell).agg(F.round(F.avg("value"), 2).alias("cell_value"))
    files = rasters.raster_files(cells, 53.0, 5.0, 0.02, 64)
    back = rasters.rasters(files.select(F.concat_ws("-", "tile_row", "tile_col").alias("path"), "content"))
    row, col = (53.0 - F.col("north")) / 0.02 + F.col("row"), (F.col("west") - 5.0) / 0.02 + F.col("col")
    return back.select(F.round(row).cast("long").alias("row"), F.round(col).cast("long").alias("col"), F.round("cell_value", 1).alias("cell_value"))


def features_read_back(spark, sf):
    """Customers as GeoJSON lines in the shared folder, read back."""
    p = tq._places(spark, sf)
    geometry = F.concat(F.lit('{"type":"Point","coordinates":['), F.col("lon").cast("string"), F.lit(","), F.col("lat").cast("string"), F.lit("]}"))
    path = f"{shared_folder(spark)}/features-{uuid.uuid4().hex}"
    made = logs.feature(geometry, F.create_map(F.lit("id"), F.col("id").cast("string")), F.when(F.col("id") % 2 == 0, "measured").otherwise("inferred"))
    rasters.geojson_lines(p, made, path)
    back = rasters.read_geojson_lines(spark, path)
    at = F.from_json("geometry", "type string, coordinates array<double>")
    return back.select(F.col("properties")["id"].cast("long").alias("id"), F.col("properties")["tier"].alias("tier"), F.round(at["coordinates"][0], 6).alias("lon"), F.round(at["coordinates"][1], 6).alias("lat"))


def logged_files(spark, sf):
    """Orders as entries of a write log, one path a customer, with torn lines; the newest of each path against what is there."""
    o = _t(spark, sf, "orders")
    entry = F.to_json(F.struct(F.col("o_orderkey").alias("seq"), F.col("o_custkey").cast("string").alias("path"), F.col("o_orderstatus").alias("sha256"), F.col("o_orderkey").alias("size")))
    path = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    o.select(F.when(F.col("o_orderkey") % 29 == 0, F.substring(entry, 1, 20)).otherwise(entry).alias("value")).write.text(path)
    entries = logs.write_log(spark, path)
    there = _t(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.lit("O").alias("sha256"), F.lit(None).cast("long").alias("size"))
    state = logs.verify(entries, there.join(entries.select("path", F.col("size").alias("_s")), "path", "left").select("path", "sha256", F.coalesce("_s", F.lit(0)).alias("size")))
    return state.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def stated_quantities(spark, sf):
    """Sentences about parts with sizes in two roundings: what is stated, and whether both may be one claim."""
    p = _t(spark, sf, "part")
    rough, fine = F.round(F.col("p_retailprice") / 10).cast("long").cast("string"), F.format_string("%.1f", F.col("p_retailprice").cast("double") / 10)
    said = F.concat(F.lit("It ran "), rough, F.lit(" km, then "), fine, F.lit(" km in "), F.col("p_size").cast("string"), F.lit(" min and 3x."))
    q = text.quantities(said)
    rows = p.select("p_partkey", q.alias("q"))
    return rows.select(
        "p_partkey", F.size("q").alias("n"), F.get("q", F.lit(0))["value"].alias("rough"), F.get("q", F.lit(1))["half"].alias("half"), F.get("q", F.lit(2))["unit"].alias("unit"),
        text.same_claim(F.get("q", F.lit(0)), F.get("q", F.lit(1))).alias("same"), text.same_claim(F.get("q", F.lit(0)), F.get("q", F.lit(2))).alias("other")
    )


QUERIES = {
    f.__name__: f for f in (
        parsed_spots, channel_frames, track_fixes, heard_levels, sounds_read_back, rasters_read_back, features_read_back, logged_files, stated_quantities
    )
}

_PLACE = "p AS (SELECT c_custkey AS id, 50 + (c_custkey * 37 % 211) / 100 AS lat, 5 + (c_custkey * 91 % 307) / 100 AS lon, c_acctbal::DOUBLE AS value FROM customer)"

ORACLE_SQL = {
    "parsed_spots": """
        WITH k AS (SELECT c_custkey AS k FROM customer), s AS (SELECT k, CASE WHEN k % 23 = 0 THEN 'no date and time' WHEN k % 17 = 0 THEN 'signal ratio out of range'
            WHEN k % 19 = 0 THEN 'not a call sign' END AS skip FROM k)
        SELECT 'K' || k % 10 || chr((65 + k % 26)::INT) || chr((65 + k // 26 % 26)::INT) || chr((65 + k // 676 % 26)::INT) AS call, (k % 40 - 30)::INTEGER AS snr, k % 9 / 10 AS dt,
            round(7.04 + k % 100 / 100000, 6)::DOUBLE AS mhz, 'JO31' AS grid, (k % 60)::INTEGER AS power, NULL AS skip FROM s WHERE skip IS NULL
        UNION ALL SELECT NULL, count(*)::INTEGER, NULL, NULL, NULL, NULL, skip FROM s WHERE skip IS NOT NULL GROUP BY skip""",
    "channel_frames": """
        WITH f AS (SELECT l_suppkey AS file, l_orderkey AS seq, CASE WHEN l_linenumber = 7 THEN 'not a byte' END AS skip, l_quantity::INT AS q,
            CASE WHEN l_linenumber = 7 THEN 200 ELSE -l_quantity::INT END AS r, l_partkey % 100 AS a, l_partkey % 90 AS b FROM lineitem)
        SELECT file, skip, count(*) AS n, sum(seq)::BIGINT AS seqs, 'm' AS mac, round(sum(sqrt(q * q + r * r) + sqrt(a * a + b * b)), 3) AS amp FROM f GROUP BY file, skip""",
    "track_fixes": f"""
        WITH {_PLACE} SELECT id::DOUBLE AS t, round(lat, 6)::DOUBLE AS lat, round(lon, 6)::DOUBLE AS lon, NULL::DOUBLE AS alt, CASE WHEN id % 3 = 0 THEN 12.5 END AS sigma
        FROM p WHERE id % 11 <> 0 AND id % 13 <> 0""",
    "heard_levels": "SELECT p_partkey::DOUBLE AS t, 'a' AS key, p_size::DOUBLE AS value FROM part WHERE p_size > 25 UNION ALL SELECT p_partkey, 'b', -p_size FROM part WHERE p_size % 2 = 0",
    "sounds_read_back": """
        WITH s AS (SELECT l_suppkey AS capture, l_discount * 20 - 1 AS v FROM lineitem)
        SELECT capture, 8000.0::DOUBLE AS rate, count(*)::INTEGER AS n, round(sum(round_even(greatest(-32768, least(32767, round_even(v * 32767, 0))), 0) / 32768), 3) + 0.0 AS total,
            count(*) FILTER (abs(greatest(-32768, least(32767, round_even(v * 32767, 0)))) >= 32767) AS clipped, count(*) FILTER (abs(v) > 1) AS over FROM s GROUP BY capture""",
    "rasters_read_back": f"""
        WITH {_PLACE}, c AS (SELECT floor((53.0 - lat) / 0.02)::BIGINT AS row, floor((lon - 5.0) / 0.02)::BIGINT AS col, value FROM p)
        SELECT row, col, round(round(avg(value), 2)::FLOAT::DOUBLE, 1) AS cell_value FROM c GROUP BY row, col""",
    "features_read_back": f"WITH {_PLACE} SELECT id, CASE WHEN id % 2 = 0 THEN 'measured' ELSE 'inferred' END AS tier, round(lon, 6)::DOUBLE AS lon, round(lat, 6)::DOUBLE AS lat FROM p",
    "logged_files": """
        WITH e AS (SELECT o_custkey AS k, arg_max(o_orderstatus, o_orderkey) AS sha FROM orders WHERE o_orderkey % 29 <> 0 GROUP BY 1),
        s AS (SELECT CASE WHEN c_custkey IS NULL THEN 'missing' WHEN k IS NULL THEN 'unlisted' WHEN sha <> 'O' THEN 'changed' ELSE 'ok' END AS state
            FROM e FULL JOIN customer ON c_custkey = k)
        SELECT state, count(*) AS n FROM s GROUP BY state""",
    "stated_quantities": """
        WITH p AS (SELECT p_partkey, round(p_retailprice / 10)::BIGINT AS r, printf('%.1f', p_retailprice::DOUBLE / 10)::DOUBLE AS f FROM part)
        SELECT p_partkey, 3 AS n, r::DOUBLE AS rough, 0.05::DOUBLE AS half, 'min' AS unit, abs(r - f) < 0.55 AS same, false AS other FROM p""",
}
