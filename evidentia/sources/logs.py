"""Text logs and exports as tables. Lines that don't parse are kept with the reason, never dropped unseen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_CALL = r"^<?(?:[A-Z0-9]{1,4}/)?[A-Z0-9]{0,2}[0-9][A-Z0-9]{0,3}[A-Z](?:/[A-Z0-9]{1,4})?>?$|^<\.\.\.>$"


def spots(lines: DataFrame, column: str = "value") -> DataFrame:
    """Beacon spots of lines in two layouts: date, time, then [sync,] snr, dt, MHz, message (call, grid, power) and drift.

    The longer layout has a sync count before the signal ratio. Returns the fields and ``skip``, a reason or null.
    """
    t = F.split(F.btrim(F.col(column)), r"\s+")
    long = F.try_element_at(t, F.lit(6)).rlike(r"^[0-9]+\.[0-9]{4,}$")
    at = lambda i: F.when(long, F.try_element_at(t, F.lit(i + 1))).otherwise(F.try_element_at(t, F.lit(i)))
    rows = lines.select(
        F.col(column).alias("line"),
        F.try_element_at(t, F.lit(1)).alias("date"),
        F.try_element_at(t, F.lit(2)).alias("time"),
        at(3).try_cast("int").alias("snr"),
        at(4).try_cast("double").alias("dt"),
        F.when(at(5).rlike(r"\.[0-9]{4,}$"), at(5).try_cast("double")).alias("mhz"),
        at(6).alias("call"),
        F.when(at(7).rlike("^[A-R]{2}[0-9]{2}([A-Xa-x]{2})?$"), at(7)).alias("grid"),
        F.when(at(7).rlike("^[0-9]+$"), at(7)).otherwise(at(8)).try_cast("int").alias("power"),
    )
    skip = (
        F.when(F.btrim("line") == "", "empty")
        .when(~F.coalesce(F.col("date").rlike("^[0-9]{6}$") & F.col("time").rlike("^[0-9]{4}$"), F.lit(False)), "no date and time")
        .when(~F.coalesce(F.col("snr").between(-60, 60), F.lit(False)), "signal ratio out of range")
        .when(~F.coalesce(F.abs("dt") <= 10, F.lit(False)), "time offset out of range")
        .when(~F.coalesce(F.col("mhz").between(0.05, 1000), F.lit(False)), "frequency out of range")
        .when(~F.coalesce(F.col("call").rlike(_CALL), F.lit(False)), "not a call sign")
        .when(~F.coalesce(F.col("power").between(0, 60), F.lit(False)), "power out of range")
    )
    return rows.withColumn("skip", skip)


def skipped(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("skip").agg(F.count(F.lit(1)).alias("n"))


def console_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, n, value: the lines of logs; n grows along each file."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n"), "value")


def channel_state(lines: DataFrame, order: str, column: str = "value", by: tuple[str, ...] = ("file",)) -> DataFrame:
    """Frames of console logs: ``CSI_DATA,seq,mac,rssi,...,len,[i q i q ...]``; columns by the last header line before in the same log.

    by: the columns that tell logs apart, as ``console_lines`` has them; those that are missing are left out, and without any all lines are one log.

    Adds ``iq`` (integers), ``skip`` (a reason or null). A header names columns; without one the default holds.
    """
    w = Window.partitionBy(*[c for c in by if c in lines.columns]).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    text = F.col(column)
    head = F.when(text.rlike(r"^type,"), text)
    rows = lines.withColumn("header", F.coalesce(F.last(head, ignorenulls=True).over(w), F.lit("type,seq,mac,rssi,rate,len,data")))
    frames = rows.filter(text.startswith("CSI_DATA"))
    body = F.regexp_extract(text, r"\[([^\]]*)\]", 1)
    fields = F.split(F.regexp_replace(text, r',?"?\[.*$', ""), ",")
    names = F.split("header", ",")
    value = lambda name: F.try_element_at(fields, F.array_position(names, name).cast("int"))
    iq = F.transform(F.split(F.btrim(body), r"[\s,]+"), lambda x: x.try_cast("int"))
    out = frames.withColumns(
        {
            "seq": value("seq").try_cast("long"), "mac": value("mac"), "rssi": value("rssi").try_cast("int"), "len": value("len").try_cast("int"),
            "iq": iq
        }
    )
    skip = (
        F.when(~text.contains("]"), "torn line")
        .when(F.col("len").isNull() | (F.size("iq") != F.col("len")), "length does not fit")
        .when(F.exists("iq", lambda x: x.isNull() | (x < -128) | (x > 127)), "not a byte")
    )
    return out.withColumn("skip", skip).drop("header")


def amplitudes(frames: DataFrame) -> DataFrame:
    """Adds ``amp``: magnitudes of the pairs in ``iq``."""
    n = (F.size("iq") / 2).cast("int")
    return frames.withColumn(
        "amp",
        F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.sqrt((F.get("iq", 2 * i) * F.get("iq", 2 * i) + F.get("iq", 2 * i + 1) * F.get("iq", 2 * i + 1)).cast("double"))
        )
    )


def _first(df: DataFrame, names: list[str], kind: str = "double") -> Column:
    have = [c for c in df.columns if c.strip().lower() in names]
    return F.coalesce(
        *[F.col(f"`{c}`").try_cast(kind) for c in sorted(have, key=lambda c: names.index(c.strip().lower()))]
    ) if have else F.lit(None).cast(kind)


def tracks(rows: DataFrame) -> DataFrame:
    """t, lat, lon, alt, sigma by their usual names; rows without time or place, or off the globe, are left out."""
    out = rows.select(
        _first(rows, ["t", "time", "timestamp", "epoch"]).alias("t"), _first(rows, ["lat", "latitude"]).alias("lat"),
        _first(rows, ["lon", "lng", "longitude"]).alias("lon"), _first(rows, ["alt", "altitude", "ele"]).alias("alt"),
        _first(rows, ["sigma", "accuracy"]).alias("sigma")
    )
    return out.filter(F.col("t").isNotNull() & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))


def drive_log(rows: DataFrame) -> DataFrame:
    """t, lat, lon, key, value: every other numeric column of a drive is a signal heard, an empty cell is none."""
    keys = [c for c in rows.columns if c not in ("t", "lat", "lon")]
    wide = rows.select(
        *[F.col(c).try_cast("double").alias(c) for c in ("t", "lat", "lon")], *[F.col(f"`{c}`").try_cast("double").alias(c) for c in keys]
    )
    return wide.unpivot(["t", "lat", "lon"], keys, "key", "value").filter("value is not null")


def geojson_features(spark: SparkSession, path: str) -> DataFrame:
    """geometry (JSON text) and properties of the features of a collection."""
    text = spark.read.text(path, wholetext=True)
    schema = "struct<features: array<struct<geometry: string, properties: map<string,string>>>>"
    return text.select(F.explode(F.from_json("value", schema)["features"]).alias("f")).select("f.geometry", "f.properties")


def feature(geometry: Column, properties: Column, tier: Column) -> Column:
    """One feature as JSON text; its tier is among its properties and must be one."""
    from evidentia.functions.tiers import TIERS

    ok = F.coalesce(tier.isin(*TIERS), F.lit(False))
    checked = F.when(ok, tier).otherwise(F.raise_error(F.lit("a feature needs a tier")))
    return F.concat(
        F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'),
        F.to_json(F.map_concat(properties, F.create_map(F.lit("tier"), checked))), F.lit("}")
    )


def write_log(spark: SparkSession, path: str) -> DataFrame:
    """Entries of an append-only JSON lines catalogue: the newest of each path; a torn last line is left out."""
    from evidentia.operators.records import newest

    rows = spark.read.schema(
        "seq long, path string, kind string, sha256 string, size long, mtime double, time string, note string"
    ).option("mode", "DROPMALFORMED").json(path)
    return newest(rows.filter("path is not null"), ["path"], ["seq"])


def verify(entries: DataFrame, files: DataFrame) -> DataFrame:
    """path, state of entries (path, sha256, size) against files (path, sha256, size): ok, changed, missing or unlisted."""
    f = files.select("path", F.col("sha256").alias("has_sha"), F.col("size").alias("has_size"))
    both = entries.select("path", "sha256", "size", F.lit(True).alias("listed")).join(f, "path", "full")
    state = F.when(F.col("has_sha").isNull(), "missing").when(F.col("listed").isNull(), "unlisted").when(
        (F.col("size") != F.col("has_size")) | (F.col("sha256") != F.col("has_sha")), "changed"
    ).otherwise("ok")
    return both.select("path", state.alias("state"))


def flat_export(nodes: DataFrame, id_: str, maps: list[str], path: str) -> None:
    """Maps and arrays as child tables, one value a cell, in CSV; ``flat_import`` is the exact inverse."""
    options = {"header": True, "lineSep": "\n", "quoteAll": True, "escape": '"', "emptyValue": ""}
    plain = [c for c in nodes.columns if c not in maps]
    nodes.select(*plain).write.options(**options).csv(f"{path}/main")
    for c in maps:
        nodes.select(id_, F.explode(c).alias("key", "value")).write.options(**options).csv(f"{path}/{c}")


def flat_import(spark: SparkSession, path: str, schema: str, id_: str, maps: list[str]) -> DataFrame:
    out = spark.read.schema(schema).options(header=True, escape='"', multiLine=True).csv(f"{path}/main")
    for c in maps:
        part = spark.read.schema(
            f"{id_} {dict(out.dtypes)[id_]}, key string, value string"
        ).options(header=True, escape='"', multiLine=True).csv(f"{path}/{c}")
        out = out.join(part.groupBy(id_).agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias(c)), id_, "left")
    return out
