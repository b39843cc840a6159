"""Deciding where to look: goals as predicates, actions as rows, scores of finds."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.operators.running import previous, running

#: What tells whether features confirm each other; features looked at at once; parts in which those of a bucket are dealt.
TESTED, CHUNK, DEALT = ("value", "line", "low", "high", "resolution"), 256, 4

_UNITS = {"hz": 1.0, "khz": 1e3, "mhz": 1e6, "ghz": 1e9}


@dataclass(frozen=True)
class Goal:
    """What to find. None means anything."""

    low_hz: float | None = None
    high_hz: float | None = None
    least_width: float | None = None
    most_width: float | None = None
    family: str | None = None
    new_only: bool = False
    bursty: bool | None = None


def parse_goal(words: str) -> Goal:
    """A goal from a sentence: bands (``430-440 MHz``), widths (``wider than 20 kHz``), families, new, bursty or steady."""
    text = words.lower()
    number = r"([0-9]+(?:\.[0-9]+)?)"
    band = re.search(rf"{number}\s*(?:-|to|and)\s*{number}\s*(g|m|k)?hz", text)
    scale = _UNITS[(band[3] or "") + "hz"] if band else 1.0
    wide, thin = re.search(rf"(?:wider|more) than {number}\s*(g|m|k)?hz", text), re.search(rf"(?:narrower|less) than {number}\s*(g|m|k)?hz", text)
    size = lambda m: float(m[1]) * _UNITS[(m[2] or "") + "hz"] if m else None
    family = next((f for f in ("digital voice", "paging", "aviation", "telemetry", "cellular", "broadcast", "analog") if f in text), None)
    bursty = True if re.search(r"\bburst", text) else False if re.search(r"\b(steady|continuous)\b", text) else None
    return Goal(
        float(band[1]) * scale if band else None, float(band[2]) * scale if band else None, size(wide), size(thin), family,
        bool(re.search(r"\b(new|unknown|unseen)\b", text)), bursty
    )


def matches(goal: Goal) -> Column:
    """Three-valued match of a row (f_lo, f_hi, family, known, duty): null where the row can't tell."""
    centre, width = (F.col("f_lo") + F.col("f_hi")) / 2, F.col("f_hi") - F.col("f_lo")
    parts = [F.lit(True)]
    if goal.low_hz is not None:
        parts.append(centre.between(goal.low_hz, goal.high_hz))
    if goal.least_width is not None:
        parts.append(width > goal.least_width)
    if goal.most_width is not None:
        parts.append(width < goal.most_width)
    if goal.family is not None:
        parts.append(F.col("family") == goal.family)
    if goal.new_only:
        parts.append(~F.col("known"))
    if goal.bursty is not None:
        parts.append(F.when(F.col("duty") < 0.5, F.lit(goal.bursty)).when(F.col("duty") > 0.8, F.lit(not goal.bursty)))
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def parse_stops(text: str, low: float = 1e5, high: float = 6e9, width_hz: float = 2e6) -> tuple[list[float], list[str]]:
    """Frequencies in Hz of a list such as ``144-146 MHz step 12.5 kHz, 433.92``, in the order typed and once each, and what is wrong with it.

    A number without a unit is in MHz. A range without a step is tiled: middles of as many bands of ``width_hz`` as cover it.
    """
    stops, wrong = {}, []
    for part in filter(None, (p.strip().lower() for p in re.split(r"[,;\n]", text))):
        m = re.fullmatch(r"([0-9.]+)\s*(?:-\s*([0-9.]+)\s*)?(hz|khz|mhz|ghz)?(?:\s*step\s*([0-9.]+)\s*(hz|khz|mhz|ghz))?", part)
        if not m or (m[4] and not m[2]):
            wrong.append(f"{part!r} is not a frequency or a range")
            continue
        unit = _UNITS[m[3] or "mhz"]
        a = float(m[1]) * unit
        b = float(m[2]) * unit if m[2] else a
        step = float(m[4]) * _UNITS[m[5]] if m[4] else width_hz
        if not step or b < a or a < low or b > high:
            wrong.append(f"{part!r} is out of bounds")
            continue
        if m[2] and not m[4]:
            tiles = max(1, math.ceil((b - a) / step - 1e-9))
            stops.update(dict.fromkeys((a + b) / 2 + (i - (tiles - 1) / 2) * step for i in range(tiles)))
        else:
            stops.update(dict.fromkeys(a + i * step for i in range(int((b - a) / step + 1e-9) + 1)))
    return list(stops), wrong


def next_cell(cells: DataFrame, move: int, now: float, explore_every: int = 5, horizon: float = 60.0) -> DataFrame:
    """The cell to look at next (cells: cell, centre_hz, looked, looks, finds, here_hz): the nearest one not yet looked at, else
    that of the greatest expected finds; every few moves the one left longest."""
    age = F.least(F.lit(now) - F.col("looked"), F.lit(horizon))
    rate = (F.col("finds") + 0.5) / (F.col("looks") + 1)
    explore = move % explore_every == explore_every - 1
    score = F.when(
        F.col("looks") == 0, F.lit(1e12) - F.abs(F.col("centre_hz") - F.col("here_hz"))
    ).otherwise(F.lit(now) - F.col("looked") if explore else rate * age)
    return cells.agg(F.max(F.struct(score.alias("score"), -F.col("cell"), F.col("cell").alias("cell")))["cell"].alias("cell"))


def valid_action(low_hz: float, high_hz: float, most_dwell: float) -> Column:
    """{ok, why} of an action row (kind, centre_hz, dwell_s)."""
    why = F.when(~F.coalesce(F.col("kind").isin("look", "dwell", "stop"), F.lit(False)), "unknown kind of action").when((F.col("kind") != "stop") & ~F.coalesce(F.col("centre_hz").between(low_hz, high_hz), F.lit(False)), "frequency out of range").when(
        (F.col("kind") == "dwell") & ~F.coalesce((F.col("dwell_s") > 0) & (F.col("dwell_s") <= most_dwell), F.lit(False)), "dwell out of range"
    )
    return F.struct(why.isNull().alias("ok"), why.alias("why"))


def score_finds(finds: DataFrame, bursts: DataFrame, slack_s: float = 0.5) -> DataFrame:
    """Each find (find, t, centre_hz) with the first burst (burst, t0, t1, f_lo, f_hi) that it can be, null for a false mark.

    Times meet through one-second cells.
    """
    b = bursts.withColumn("cell", F.explode(F.sequence(F.floor(F.col("t0") - slack_s), F.floor(F.col("t1") + slack_s))))
    met = finds.withColumn("cell", F.floor("t")).join(b, "cell").filter(
        F.col("t").between(F.col("t0") - slack_s, F.col("t1") + slack_s) & F.col("centre_hz").between(F.col("f_lo"), F.col("f_hi"))
    )
    first = met.groupBy("find").agg(F.min(F.struct("t0", "burst"))["burst"].alias("burst"))
    return finds.join(first, "find", "left").select("find", "t", "burst")


def hunt_summary(scored: DataFrame, bursts: DataFrame) -> DataFrame:
    """One row: bursts, found, share, median time to find, false marks."""
    earliest = scored.filter("burst is not null").groupBy("burst").agg(F.min("t").alias("t"))
    hit = bursts.join(earliest, "burst", "left")
    false = scored.agg(F.sum(F.col("burst").isNull().cast("long")).alias("false_marks"))
    return hit.agg(
        F.count(F.lit(1)).alias("bursts"), F.count("t").alias("found"), (F.count("t") / F.count(F.lit(1))).alias("share"),
        F.median(F.when(F.col("t").isNotNull(), F.greatest(F.col("t") - F.col("t0"), F.lit(0.0)))).alias("wait_s")
    ).join(F.broadcast(false))


def distinct_finds(finds: DataFrame, slack_s: float = 0.5) -> DataFrame:
    """Finds (find, t, centre_hz, width_hz) without those that have an earlier one within the slack and half of their own width.

    Finds meet in cells of time, as wide as the slack, and of frequency, as wide as the widest find; each looks into the cells around its
    own, so no border parts two. Of finds at one time the lesser number is the earlier.
    """
    widest = finds.agg(F.greatest(F.max("width_hz"), F.lit(1e-9)).alias("_w"))
    cell_t, cell_f = (F.coalesce(F.floor(x), F.lit(0)) for x in (F.col("t") / max(slack_s, 1e-9), F.col("centre_hz") / F.col("_w")))
    rows = finds.select("find", "t", "centre_hz", "width_hz").join(F.broadcast(widest)).withColumns({"_t": cell_t, "_f": cell_f})
    around = F.array(*[F.struct((F.col("_t") + i).alias("t"), (F.col("_f") + j).alias("f")) for i in (-1, 0) for j in (-1, 0, 1)])
    late = rows.withColumn("_c", F.explode(around)).select("find", "t", "centre_hz", "width_hz", F.col("_c.t").alias("_t"), F.col("_c.f").alias("_f"))
    early = rows.select(F.col("find").alias("_find"), F.col("t").alias("_at"), F.col("centre_hz").alias("_hz"), "_t", "_f")
    before = (F.col("_at") < F.col("t")) | ((F.col("_at") == F.col("t")) & (F.col("_find") < F.col("find")))
    near = (F.col("t") - F.col("_at") <= slack_s) & (F.abs(F.col("centre_hz") - F.col("_hz")) <= F.col("width_hz") / 2)
    return finds.join(late.join(early, ["_t", "_f"]).filter(before & near).select("find").distinct(), "find", "left_anti")


def merge_lines(lines: DataFrame, tolerance: float) -> DataFrame:
    """Features (id, hz, margin) nearer than the tolerance as one, kept by the greatest margin: chains of neighbours."""
    at = lines.groupBy("hz").agg(F.max(F.struct("margin", (-F.col("id")).alias("o"))).alias("best"), F.count(F.lit(1)).alias("n"))
    chained = previous(at, "hz").withColumn("_new", F.coalesce((F.col("hz") - F.col("previous") > tolerance).cast("int"), F.lit(1)))
    chained = running(chained, "hz", {"line": ("sum", "_new")})
    return chained.groupBy("line").agg(F.max_by("hz", "best").alias("hz"), F.max("best.margin").alias("margin"), F.sum("n").alias("members"))


def places_apart(sightings: DataFrame, key: str, order: list[str], place: str, stop: str, span: str, apart: float, enough: int) -> DataFrame:
    """key, places: how many places, taken in order, lie apart from all taken before: at another stop, farther than ``apart`` and than the span.

    Counting ends at ``enough``, so a key's state is that many places however often it was sighted. A key's sightings are dealt to one
    task, sorted there, and read as they come. Null places are none; a null stop is different from every other.
    """
    kind = sightings.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, taken, begun, arrow = None, [], False, pa.int64()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], arrow), pa.array([len(taken)], pa.int32())], [key, "places"])

        for batch in batches:
            arrow = batch.column(0).type
            for k, at, where, width in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or k != now:
                    if begun:
                        yield told()
                    now, taken, begun = k, [], True
                if at is not None and len(taken) < enough and all(
                    abs(at - p) > max(apart, width or 0.0) and (where is None or where != q) for p, q in taken
                ):
                    taken.append((at, where))
        if begun:
            yield told()

    rows = sightings.repartition(key).sortWithinPartitions(key, *order).select(
        key, F.col(place).cast("double").alias("_p"), F.col(stop).cast("string").alias("_s"), F.col(span).cast("double").alias("_w")
    )
    return rows.mapInArrow(run, f"{key} {kind}, places int")


def _best_confirmed(test) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """id, confirmed_by, margin: of a group, for each feature of the left the first on the right that passes ``test``, by margin and id.

    The right is gone through in that order, ``CHUNK`` at a time, by those of the left that are still without one.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a = {c: left[c].to_numpy() for c in left.column_names}
        b = {c[2:]: right[c].to_numpy() for c in right.column_names}
        order = np.lexsort((b["id"], -b["margin"]))
        b = {c: v[order] for c, v in b.items()}
        best = np.full(len(left), -1)
        for i in range(0, len(left), 8 * CHUNK):
            rows = np.arange(i, min(i + 8 * CHUNK, len(left)))
            for k in range(0, len(order), CHUNK):
                if not len(rows):
                    break
                ok = test({c: v[rows, None] for c, v in a.items() if c in TESTED}, {c: v[None, k : k + CHUNK] for c, v in b.items() if c in TESTED})
                hit = ok.any(axis=1)
                best[rows[hit]] = k + ok[hit].argmax(axis=1)
                rows = rows[~hit]
        found = np.flatnonzero(best >= 0)
        return pa.table({"id": left["id"].take(pa.array(found)), "confirmed_by": b["id"][best[found]], "margin": b["margin"][best[found]].astype(float)})

    return run


def confirmations(first: DataFrame, second: DataFrame, drift: float, widest: float) -> DataFrame:
    """id, confirmed_by, margin: for each feature of a first look that of the second which reproduces it with the greatest margin, or null.

    Features: id, conj, value, line, low, high, resolution, margin. Conjugate ones are the same if their lines differ by ``drift`` of the line at
    most, others if their values differ by three times the coarser resolution (``widest`` at most) and their bands overlap. They meet
    in buckets, dealt in ``DEALT`` parts, in the order of what they look for, so that a feature meets few more than its confirmation; of equal
    margins the lesser id counts.
    """
    one, kinds = F.col("_cell").cast("long"), tuple(df.schema["id"].dataType.simpleString() for df in (first, second))

    def met(a: DataFrame, b: DataFrame, by: Column, width: float, test) -> DataFrame:
        cell = F.floor(by / width)
        names = ["id", *TESTED, "margin"]
        left = a.filter(by.isNotNull()).withColumn("_cell", cell).withColumn("_deal", F.pmod(F.xxhash64("id"), F.lit(DEALT))).select(*names, one.alias("_cell"), "_deal")
        right = b.filter(by.isNotNull()).withColumn("_cell", F.explode(F.array(*[cell + i for i in (-1, 0, 1)]))).withColumn(
            "_deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALT - 1).cast("long")))
        ).select(*[F.col(c).alias(f"r_{c}") for c in names], one.alias("r__cell"), F.col("_deal").alias("r__deal"))
        return left.groupBy("_cell", "_deal").cogroup(right.groupBy("r__cell", "r__deal")).applyInArrow(
            _best_confirmed(test), f"id {kinds[0]}, confirmed_by {kinds[1]}, margin double"
        )

    def alike(a, b):
        reach = 3 * np.fmin(np.fmax(a["resolution"], b["resolution"]), widest)
        return (np.abs(a["value"] - b["value"]) <= reach) & (a["low"] < b["high"]) & (b["low"] < a["high"])

    plain = met(first.filter("NOT conj"), second.filter("NOT conj"), F.col("value"), 3 * widest, alike)
    # Buckets as wide as the drift at a line: lines on a logarithmic scale.
    lines = met(
        first.filter("conj AND line > 0"), second.filter("conj AND line > 0"), F.ln("line"), 1.01 * drift, lambda a, b: np.abs(a["line"] - b["line"]) <= drift * a["line"]
    )
    best = plain.unionByName(lines).groupBy("id").agg(F.max(F.struct("margin", (-F.col("confirmed_by")).alias("o"))).alias("s"))
    return first.select("id").join(best, "id", "left").select("id", (-F.col("s.o")).alias("confirmed_by"), F.col("s.margin").alias("margin"))


def detection_verdict(found: Column, false_rate: Column, least: float = 0.9, most: float = 0.01) -> Column:
    """A plain sentence from two figures."""
    return F.when(
        found.isNull() | false_rate.isNull(), "not measured"
    ).when(false_rate > most, "too many false alarms").when(found < least, "misses too much").otherwise("good")


def recordable(cls: Column, wanted: list[str]) -> Column:
    """Whether a feature's class is on the record list; an unknown class is not."""
    return F.coalesce(cls.isin(*wanted), F.lit(False))


def next_stops(stops: DataFrame, key: str, backlog: int) -> DataFrame:
    """The next stop of each receiver (key, stop, order, state): confirmations first, then stops to look at again, then new ones.

    state: confirm, again, new or done. A receiver with more than ``backlog`` stops to confirm waits: its stop is null.
    """
    rank = F.when(F.col("state") == "confirm", 0).when(F.col("state") == "again", 1).when(F.col("state") == "new", 2)
    open_ = F.when(rank.isNotNull(), F.struct(rank.alias("rank"), "order", "stop"))
    due = stops.groupBy(key).agg(F.min(open_).alias("s"), F.sum((F.col("state") == "confirm").cast("long")).alias("waiting"))
    return due.select(key, "waiting", F.when(F.col("waiting") <= backlog, F.col("s.stop")).alias("stop"))


def observed(cells: DataFrame, looks: DataFrame) -> DataFrame:
    """cells (cell, looks, finds, looked) after more looks (cell, t, finds): counts add up, the last look counts."""
    new = looks.groupBy("cell").agg(F.count(F.lit(1)).alias("_n"), F.sum("finds").alias("_f"), F.max("t").alias("_t"))
    own = cells.join(new, "cell", "left")
    return own.select(
        "cell", (F.col("looks") + F.coalesce("_n", F.lit(0))).alias("looks"), (F.col("finds") + F.coalesce("_f", F.lit(0))).alias("finds"),
        F.greatest("looked", "_t").alias("looked")
    )
