"""Detection over power series: noise floors, constant-false-alarm thresholds, runs above them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.stats import cfar_alpha


def quantile_floor(cells: DataFrame, key: str, power: str, q: float = 0.25) -> DataFrame:
    """Mean of exponential noise from a low quantile, which signals hardly move."""
    return cells.groupBy(key).agg(F.count(F.lit(1)).alias("n"), (F.expr(f"percentile({power}, {q})") / (-math.log(1 - q))).alias("floor"))


def truncated_floor(cells: DataFrame, key: str, power: str, q: float = 0.25, cut: float = 3.0, rounds: int = 8) -> DataFrame:
    """Mean of an exponential from the cells under a cut, corrected for what the cut removes.

    Each round solves m = mean under c + c / (exp(c / m) - 1) once more, with c from the quantile floor.
    """
    start = quantile_floor(cells, key, power, q).select(key, "floor", (cut * F.col("floor")).alias("c"))
    under = cells.join(start, key).filter(F.col(power) <= F.col("c")).groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.avg(power).alias("below"), F.first("c").alias("c"), F.first("floor").alias("m")
    )
    for _ in range(rounds):
        under = under.withColumn("m", F.when(F.col("m") > 0, F.col("below") + F.col("c") / (F.exp(F.col("c") / F.col("m")) - 1)).otherwise(0.0))
    return under.select(key, "n", F.col("m").alias("floor"))


def ca_cfar(cells: DataFrame, keys: list[str], order: str, power: str, pfa: float, guard: int = 2, train: int = 16) -> DataFrame:
    """Adds the mean of the training cells outside the guard on both sides, the threshold, and whether a cell exceeds it."""
    w = Window.partitionBy(*keys).orderBy(order)
    before, after = w.rowsBetween(-guard - train, -guard - 1), w.rowsBetween(guard + 1, guard + train)
    total = F.coalesce(F.sum(power).over(before), F.lit(0.0)) + F.coalesce(F.sum(power).over(after), F.lit(0.0))
    n = F.count(power).over(before) + F.count(power).over(after)
    counted = cells.withColumns({"cells": n, "noise": F.when(n > 0, total / n)})
    alpha = F.lit(None).cast("double")
    for k in range(1, 2 * train + 1):
        alpha = F.when(F.col("cells") == k, F.lit(cfar_alpha(pfa, k))).otherwise(alpha)
    limit = counted.withColumn("threshold", F.col("noise") * alpha)
    return limit.withColumn("hit", F.coalesce(F.col(power) > F.col("threshold"), F.lit(False)))


def local_ratio(cells: DataFrame, keys: list[str], order: str, value: str, half: int = 8) -> DataFrame:
    """Adds the value over the median of its neighbourhood."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-half, half)
    near = F.array_sort(F.collect_list(value).over(w))
    n = F.size("_near")
    middle = (F.element_at("_near", F.floor((n + 1) / 2).cast("int")) + F.element_at("_near", F.floor(n / 2).cast("int") + 1)) / 2
    return cells.withColumn("_near", near).withColumn("ratio", F.col(value) / middle).drop("_near")


def opened(cells: DataFrame, keys: list[str], order: str, value: str, half: int = 1) -> DataFrame:
    """Morphological opening along the order: the greatest of the least."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-half, half)
    return cells.withColumn("_least", F.min(value).over(w)).withColumn("opened", F.max("_least").over(w)).drop("_least")


def bridged_runs(cells: DataFrame, keys: list[str], order: str, hit: Column, bridge: int, least: int) -> DataFrame:
    """Runs of hits; gaps of at most ``bridge`` cells are bridged, runs under ``least`` hits dropped."""
    w = Window.partitionBy(*keys).orderBy(order)
    on = cells.filter(hit)
    marked = on.withColumn("_new", F.when(F.col(order) - F.lag(order).over(w) <= bridge + 1, 0).otherwise(1))
    marked = marked.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "run").agg(
        F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("hits")
    ).filter(F.col("hits") >= least).drop("run")


def peaks(cells: DataFrame, keys: list[str], order: str, value: str, apart: int) -> DataFrame:
    """Cells that exceed all others within ``apart``; of equals the first."""
    w = Window.partitionBy(*keys).orderBy(order)
    left, right = F.max(value).over(w.rowsBetween(-apart, -1)), F.max(value).over(w.rowsBetween(1, apart))
    marked = cells.withColumns({"_l": left, "_r": right})
    return marked.filter(
        (F.coalesce(F.col(value) > F.col("_l"), F.lit(True))) & (F.coalesce(F.col(value) >= F.col("_r"), F.lit(True)))
    ).drop("_l", "_r")


def tile_rows(frames: DataFrame, order: str, value: str, factor: int) -> DataFrame:
    """Max- and mean-pooled rows of so many frames."""
    return frames.groupBy(F.floor(F.col(order) / factor).alias("row")).agg(
        F.max(value).alias("peak"), F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n")
    )


def floor_mask(above_db: Column, pfa: float, pool: int = 1, margin_db: float = 1.0) -> Column:
    """Whether a cell, in dB over a known floor, exceeds what noise does with this chance, and a margin."""
    import math

    from evidentia.functions.stats import floor_alpha

    return above_db > 10 * math.log10(floor_alpha(pfa, pool)) + margin_db


def tile_layout(rate: float, hop: int, seconds: float, rows: int, overlap: float = 0.5) -> dict[str, int]:
    """Frames pooled to a row, rows of a tile, and rows by which tiles step: a tile lasts about so many seconds."""
    pool = max(1, round(seconds * rate / hop / rows))
    return {"pool": pool, "rows": rows, "step": max(1, round(rows * (1 - overlap)))}


def tiles(frames: DataFrame, keys: list[str], frame: str, power: str, layout: dict[str, int]) -> DataFrame:
    """keys, tile, row, power: mean power of the rows of all tiles; overlapping tiles share rows.

    Each frame is pooled to its row first, so only rows are repeated for the tiles they lie in.
    """
    rows = frames.groupBy(*keys, F.floor(F.col(frame) / layout["pool"]).alias("at")).agg(F.avg(power).alias("power"))
    last = F.floor(F.col("at") / layout["step"])
    first = F.ceil((F.col("at") - layout["rows"] + 1) / layout["step"])
    spread = rows.withColumn("tile", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    return spread.select(*keys, "tile", (F.col("at") - F.col("tile") * layout["step"]).alias("row"), "power")


def row_time(tile: Column, row: Column, rate: float, hop: int, layout: dict[str, int]) -> Column:
    """Seconds at which a row of a tile begins."""
    return (tile * layout["step"] + row) * layout["pool"] * hop / rate


def time_row(tile: Column, seconds: Column, rate: float, hop: int, layout: dict[str, int]) -> Column:
    """The row of a tile at a time, the inverse of ``row_time``."""
    return seconds * rate / hop / layout["pool"] - tile * layout["step"]


def box_snr_db(cells: DataFrame, boxes: DataFrame, keys: list[str], at: str, power: str) -> DataFrame:
    """boxes (box, keys, first, last) with mean power inside over mean power outside all boxes of the keys, in dB.

    Cells meet boxes by their keys and stretches of 64 cells, and then by range; boxes of one key must not overlap.
    """
    stretch = lambda c: F.floor(F.col(c) / 64)
    spans = boxes.select(*[F.col(k).alias(f"_{k}") for k in keys], "box", "first", "last", F.explode(F.sequence(stretch("first"), stretch("last"))).alias("_s"))
    met = (stretch(at) == F.col("_s")) & F.col(at).between(F.col("first"), F.col("last"))
    for k in keys:
        met = met & (F.col(k) == F.col(f"_{k}"))
    marked = cells.join(spans, met, "left")
    noise = marked.filter("box is null").groupBy(*keys).agg(F.avg(power).alias("noise"))
    inside = marked.filter("box is not null").groupBy(*keys, "box").agg(F.avg(power).alias("signal"))
    return inside.join(noise, keys).select(*keys, "box", (10 * F.log10(F.col("signal") / F.col("noise"))).alias("snr_db"))
