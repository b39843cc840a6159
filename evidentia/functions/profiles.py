"""Receiver profiles and signal classes: identities, geometry, rates, and a small table of classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_KINDS = ("cu8", "ci8", "ci16", "ci16q11", "cf32")


def make_id(family: Column, rate: Column, kind: Column, variant: Column | None = None) -> Column:
    """family_rate_kind[_variant]; parts that would make it unreadable end the query."""
    bad = ~family.rlike("^[a-z0-9-]+$") | ~kind.isin(*_KINDS) | (rate <= 0)
    base = F.concat_ws("_", family, rate.cast("long").cast("string"), kind, *([variant] if variant is not None else []))
    return F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.concat(F.lit("not a profile: "), F.coalesce(base, F.lit("null"))))).otherwise(base)


def parse_id(profile: Column) -> Column:
    """{family, rate, kind, variant} of an identity, null if it is none."""
    pattern = rf"^([a-z0-9-]+)_([0-9]+)_({'|'.join(_KINDS)})(?:_([a-z0-9-]+))?$"
    part = lambda i: F.regexp_extract(profile, pattern, i)
    return F.when(
        profile.rlike(pattern),
        F.struct(part(1).alias("family"), part(2).cast("long").alias("rate"), part(3).alias("kind"), F.nullif(part(4), F.lit("")).alias("variant"))
    )


def same_profile(df: DataFrame, a: str, b: str) -> DataFrame:
    """The rows, or an error at the first whose profiles differ: profiles never mix."""
    ok = F.col(a).eqNullSafe(F.col(b))
    return df.withColumn(
        a,
        F.when(ok, F.col(a)).otherwise(
            F.raise_error(F.concat(F.lit("profiles differ: "), F.coalesce(a, F.lit("null")), F.lit(" and "), F.coalesce(b, F.lit("null"))))
        )
    )


def width_class(width_hz: Column) -> Column:
    return F.when(width_hz <= 30_000, "narrow").when(width_hz <= 400_000, "medium").otherwise("wide")


def canonical_rate(rate: Column, least: int) -> Column:
    """The lowest rate, by dividing by a whole number, that is still at least ``least``; null if there is none.

    Divisors come in pairs, so those up to the root give all.
    """
    low = F.filter(F.sequence(F.lit(1).cast("long"), F.floor(F.sqrt(rate.cast("double")))), lambda d: rate % d == 0)
    divisors = F.concat(low, F.transform(low, lambda d: (rate / d).cast("long")))
    return F.when(rate >= least, F.array_min(F.filter(divisors, lambda q: q >= least)))


#: A few signal classes: name, family, least and greatest width in Hz, symbol rates, cyclic prefix lags in microseconds.
CLASSES = (
    ("nfm-voice", "analog", 8_000, 20_000, (), ()), ("dmr", "digital voice", 9_000, 13_000, (4800,), ()), ("pocsag", "paging", 7_000, 12_000, (512, 1200, 2400), ()), (
        "ads-b", "aviation", 1_300_000, 2_600_000, (2_000_000,), ()
    ),
    ("lora-125", "telemetry", 110_000, 140_000, (), ()), (
        "lte-5", "cellular", 4_400_000, 5_000_000, (), (66.67,)
    ), ("dab", "broadcast", 1_500_000, 1_560_000, (), (1000.0,)), ("fm-broadcast", "broadcast", 120_000, 260_000, (), ()),
)


def class_table(spark: SparkSession) -> DataFrame:
    rows = [(n, f, float(a), float(b), [float(x) for x in s], [float(x) for x in c]) for n, f, a, b, s, c in CLASSES]
    return spark.createDataFrame(
        rows, "name string, family string, low_hz double, high_hz double, symbol_rates array<double>, prefix_us array<double>"
    )


def cycle_frequencies(classes: DataFrame) -> DataFrame:
    """name, alpha_hz: cycle frequencies to look for, symbol rates and one over prefix lags."""
    return classes.select("name", F.explode(F.concat("symbol_rates", F.transform("prefix_us", lambda x: 1e6 / x))).alias("alpha_hz"))


def nearest_class(boxes: DataFrame, classes: DataFrame) -> DataFrame:
    """boxes (id, width_hz) with the class whose middle width is nearest by ratio, among those that could have it."""
    from evidentia.operators.matching import with_blocks

    met = with_blocks(boxes.select("id", "width_hz"), classes.select("name", "low_hz", "high_hz"))
    fits = F.filter("_block", lambda c: F.col("width_hz").between(c["low_hz"] / 2, c["high_hz"] * 2))
    near = F.array_min(
        F.transform(
            fits, lambda c: F.struct(F.abs(F.log(F.col("width_hz") / F.sqrt(c["low_hz"] * c["high_hz"]))).alias("off"), c["name"].alias("name"))
        )
    )
    best = met.select("id", near.alias("near")).groupBy("id").agg(F.min("near")["name"].alias("class"))
    return boxes.join(best, "id", "left")


def tools_for(boxes: DataFrame, tools: DataFrame, common: list[str]) -> DataFrame:
    """boxes (id, cls) with an array of tools, those of the class by rank and then the common ones, each once. tools: cls, tool, rank."""
    own = tools.groupBy("cls").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "tool"))), lambda s: s["tool"]).alias("own"))
    return boxes.join(own, "cls", "left").select(
        "id", "cls",
        F.array_distinct(F.concat(F.coalesce("own", F.array().cast("array<string>")), F.array(*[F.lit(c) for c in common]))).alias("tools")
    )


def allocations_in(bands: DataFrame, table: DataFrame, width: float) -> DataFrame:
    """Pairs of bands (id, low, high) and allocations (name, low, high) that overlap."""
    from evidentia.operators.matching import overlaps

    return overlaps(bands, table, "low", "high", width).select(
        "id", F.col("name_b").alias("name"), F.greatest("low", "low_b").alias("low"), F.least("high", "high_b").alias("high")
    )
