"""How a row was made: seven tiers, and a closed map from methods to tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: From the least made up to the most, and what people said of it.
TIERS = ("record", "measured", "cleaned", "inferred", "invented", "proposed", "confirmed")
METHODS = {
    "capture": "record", "import": "record", "measurement": "measured", "aggregate": "measured", "filter": "cleaned", "denoise": "cleaned", "smooth": "cleaned",
    "interpolate": "inferred", "krige": "inferred", "match": "inferred", "generate": "invented", "fill": "invented", "model": "proposed", "suggest": "proposed", "operator": "confirmed", "decode": "confirmed",
}


def tier_for(method: Column) -> Column:
    """The method's tier; an unknown method ends the query."""
    out = F.raise_error(F.concat(F.lit("no tier for method "), F.coalesce(method, F.lit("null"))))
    for name, tier in METHODS.items():
        out = F.when(method == name, tier).otherwise(out)
    return out


def check_tier(df: DataFrame, column: str = "tier") -> DataFrame:
    ok = F.coalesce(F.col(column).isin(*TIERS), F.lit(False))
    return df.withColumn(
        column, F.when(ok, F.col(column)).otherwise(F.raise_error(F.concat(F.lit("not a tier: "), F.coalesce(F.col(column), F.lit("null")))))
    )


def is_record(tier: Column) -> Column:
    return tier.isin("record", "measured")
