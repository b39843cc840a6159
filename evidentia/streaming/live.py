"""Live operators on Structured Streaming: windows with watermarks, and keyed state for floors, tracks and finds.

State is per key and bounded: a floor is one vector, a track dies after a silence, finds are forgotten with the
watermark. Event times must be timestamps with zone; ``with_time`` makes them of whole microseconds.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evidentia.kernels.repair import assign


def with_time(events: DataFrame, us: str = "us", late: str = "10 minutes") -> DataFrame:
    return events.withColumn("event_time", F.timestamp_micros(us)).withWatermark("event_time", late)


def activity(events: DataFrame, key: str, window: str, slide: str | None = None) -> DataFrame:
    """Counts, distinct-ish and sums by window and key; rows later than the watermark are left out."""
    return events.groupBy(F.window("event_time", window, slide), key).agg(
        F.count(F.lit(1)).alias("n"), F.approx_count_distinct("who").alias("who"), F.sum("value").alias("value")
    ).select(F.col("window.start").alias("begin"), key, "n", "who", "value")


def sessions(events: DataFrame, key: str, gap: str) -> DataFrame:
    """Sessions of a key that end after a silence."""
    return events.groupBy(F.session_window("event_time", gap), key).agg(F.count(F.lit(1)).alias("n")).select(
        key, F.col("session_window.start").alias("begin"), F.col("session_window.end").alias("end"), "n"
    )


def new_only(events: DataFrame, *keys: str) -> DataFrame:
    """Each combination of keys once within the watermark."""
    return events.dropDuplicatesWithinWatermark(list(keys))


def floor_step(
    floor: np.ndarray | None, settle: int, power: np.ndarray, rate: float = 0.1, snap_db: float = 1.0, gate_db: float = 3.0, settle_rows: int = 4
) -> tuple[np.ndarray, np.ndarray, int]:
    """What is over the floor in dB under the floor so far, then the new floor and settle count.

    While settling the floor snaps to what it sees; later bins far above it are left out and steps are clipped.
    """
    if floor is None:
        return np.zeros(len(power)), power.copy(), settle_rows
    above = 10 * np.log10(np.maximum(power, 1e-30) / np.maximum(floor, 1e-30))
    middle = float(np.median(above))
    if abs(middle) > snap_db:
        return above, floor * 10 ** (middle / 10), settle_rows
    if settle:
        return above, (floor + power) / 2, settle - 1
    step = np.where(above > gate_db, 0.0, np.clip(power - floor, -0.5 * floor, 0.5 * floor))
    return above, floor + rate * step, 0


def noise_floor(rows: DataFrame, key: str = "receiver") -> DataFrame:
    """receiver, us, above (dB over the floor as it was before the row) of rows (receiver, us, power array)."""

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        floor, settle = (np.array(state.get[0]), state.get[1]) if state.exists else (None, 0)
        out = []
        for r in pd.concat(list(parts)).sort_values("us").itertuples():
            above, floor, settle = floor_step(floor, settle, np.asarray(r.power, float))
            out.append((k[0], r.us, above.tolist()))
        state.update((floor.tolist(), settle))
        yield pd.DataFrame(out, columns=[key, "us", "above"])

    return rows.groupBy(key).applyInPandasWithState(
        run, f"{key} string, us long, above array<double>", "floor array<double>, settle int", "append", GroupStateTimeout.NoTimeout
    )


def link_cost(track: dict, box: tuple[float, float, float, float, str]) -> float:
    """What it costs to give a box (t0, t1, low, high, cls) to a track; infinite if it can't be its next burst."""
    t0, _, low, high, cls = box
    shared = max(0.0, min(high, track["high"]) - max(low, track["low"]))
    joint = max(high, track["high"]) - min(low, track["low"])
    wait = t0 - track["last"]
    if wait > 10 or wait < -0.5:
        return np.inf
    overlap = shared / joint if joint > 0 else 0.0
    same_width = min(high - low, track["high"] - track["low"]) / max(high - low, track["high"] - track["low"], 1e-9)
    if overlap <= 0 and same_width < 0.8:
        return np.inf
    return (1 - overlap if overlap > 0 else 1.5) + 0.05 * max(wait, 0) + (0.5 if cls and track["cls"] and cls != track["cls"] else 0.0)


def track_step(
    tracks: list[dict], boxes: list[tuple], next_id: int, gate: float = 2.0, silence: float = 10.0
) -> tuple[list[dict], list[dict], int, list[int]]:
    """Give boxes of one moment to tracks at least total cost: live tracks, closed ones, next number, track of each box."""
    closed, live = [], []
    now = max((b[1] for b in boxes), default=0.0)
    for t in tracks:
        (closed if now - t["last"] > silence else live).append(t)
    cost = np.array([[link_cost(t, b) for t in live] for b in boxes]).reshape(len(boxes), len(live))
    cost[cost > gate] = np.inf
    given = dict(assign(cost))
    owner = []
    for i, (t0, t1, low, high, cls) in enumerate(boxes):
        if i in given:
            t = live[given[i]]
            t["hops"] += int(not (low < t["high"] and high > t["low"]))
            t.update(last=max(t["last"], t1), low=low, high=high, bursts=t["bursts"] + 1, busy=t["busy"] + t1 - t0)
        else:
            t = {"id": next_id, "first": t0, "last": t1, "low": low, "high": high, "cls": "", "votes": {}, "bursts": 1, "busy": t1 - t0, "hops": 0}
            next_id += 1
            live.append(t)
        if cls:
            t["votes"][cls] = t["votes"].get(cls, 0) + 1
            t["cls"] = max(sorted(t["votes"]), key=t["votes"].get)
        owner.append(t["id"])
    return live, closed, next_id, owner


def tracker(boxes: DataFrame, key: str = "stream", silence: float = 10.0) -> DataFrame:
    """Tracks of boxes (stream, event_time, t0, t1, f_lo, f_hi, cls), each given out when it has been silent."""
    schema = f"{key} string, track long, first double, last double, f_lo double, f_hi double, cls string, bursts long, busy double, hops long"

    def rows(k, tracks):
        return pd.DataFrame(
            [(k, t["id"], t["first"], t["last"], t["low"], t["high"], t["cls"], t["bursts"], t["busy"], t["hops"]) for t in tracks],
            columns=[key, "track", "first", "last", "f_lo", "f_hi", "cls", "bursts", "busy", "hops"]
        )

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracks, next_id = (json.loads(state.get[0]), state.get[1]) if state.exists else ([], 0)
        if state.hasTimedOut:
            state.remove()
            yield rows(k[0], tracks)
            return
        closed = []
        for _, now in pd.concat(list(parts)).sort_values(["t0", "f_lo"]).groupby("t0", sort=True):
            batch = [(b.t0, b.t1, b.f_lo, b.f_hi, b.cls or "") for b in now.itertuples()]
            tracks, done, next_id, _ = track_step(tracks, batch, next_id, silence=silence)
            closed += done
        state.update((json.dumps(tracks), next_id))
        ends = int(1000 * (max(t["last"] for t in tracks) + silence)) if tracks else 0
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        yield rows(k[0], closed)

    return boxes.groupBy(key).applyInPandasWithState(run, schema, "tracks string, next long", "append", GroupStateTimeout.EventTimeTimeout)


def triggers(scores: DataFrame, key: str = "region", low: float = 0.35, high: float = 0.65, cooldown_us: int = 30_000_000) -> DataFrame:
    """Rows (region, us, score) worth a second look: the score is undecided and the region has rested."""

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for r in pd.concat(list(parts)).sort_values("us").itertuples():
            if low <= r.score <= high and (last is None or r.us - last >= cooldown_us):
                last = r.us
                out.append((k[0], r.us, r.score))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=[key, "us", "score"])

    return scores.groupBy(key).applyInPandasWithState(run, f"{key} string, us long, score double", "last long", "append", GroupStateTimeout.NoTimeout)


def epochs(blocks: DataFrame) -> DataFrame:
    """Adds ``epoch`` to blocks (receiver, start, rate, centre_hz, n): a retune or a jump in time begins a new one. Batch only."""
    from pyspark.sql import Window

    w = Window.partitionBy("receiver").orderBy("start")
    moved = F.abs(F.col("centre_hz") - F.lag("centre_hz").over(w)) > 0.5
    jumped = F.abs(F.col("start") - F.lag("start").over(w) - F.lag("n").over(w)) > 1.5
    return blocks.withColumn("_new", F.coalesce((moved | jumped).cast("int"), F.lit(0))).withColumn(
        "epoch", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("_new")
