"""The detector as one machine for batches and streams: samples in, finished boxes with their tracks out.

A machine holds one capture's state: the samples that don't fill a row yet, the noise floor, the boxes that are open, and the live
tracks. It works row by row, a row being the mean power of ``pool`` transforms, so blocks of any size give the same
boxes. Cells above the floor form runs; a run goes on with the open boxes that it touches, boxes that it joins become one, and a
box is finished when no run has touched it for ``bridge`` rows. Finished boxes go to tracks at least cost.

A gap or a jump in the sample numbers finishes what is open and drops the samples at hand, but keeps the floor and the tracks, for
noise and senders outlast it.

State is bounded by the band and the tracks alive, whatever the capture's length. In a batch a capture's blocks are dealt to
one task, sorted there, and read as they come, never held together; the machine is sequential by nature, so
captures are the unit of parallel work. In a stream the same machine is the keyed state.

Defined cases: an empty capture has no boxes; null samples are zeros; blocks that come late or twice are a jump back; a null capture is one
of its own.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evidentia.functions.stats import floor_alpha
from evidentia.kernels.signal import hann
from evidentia.operators.series import _arrays
from evidentia.streaming.live import floor_step, track_step

BOX = "t0 double, t1 double, f_lo double, f_hi double, snr_db double, cells long, track long"


class Setup(NamedTuple):
    """rate and centre in hertz; size of a transform; transforms a row; false alarms a cell; rows and bins that a box bridges; its least cells.

    silence: seconds after which a track ends; snap: decibels by which the middle of a row must jump for the floor to start anew.
    """

    rate: float
    centre: float = 0.0
    size: int = 256
    pool: int = 4
    pfa: float = 1e-6
    bridge: int = 1
    least: int = 3
    silence: float = 10.0
    snap: float = 3.0


def row_powers(x: np.ndarray, setup: Setup) -> np.ndarray:
    """Rows of mean powers, zero frequency in the middle, of samples that fill them."""
    w = hann(setup.size)
    spectra = np.fft.fftshift(np.fft.fft(x.reshape(-1, setup.size) * w, axis=1), axes=1)
    return (np.abs(spectra) ** 2 / w.sum() ** 2).reshape(-1, setup.pool, setup.size).mean(axis=1)


def runs_in(mask: np.ndarray, bridge: int) -> list[tuple[int, int]]:
    """Runs of cells with at most ``bridge`` others between them, as begin and end."""
    at = np.flatnonzero(mask)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > bridge + 1)
    return list(zip(at[np.append(0, cut + 1)].tolist(), (at[np.append(cut, len(at) - 1)] + 1).tolist(), strict=True))


class Machine:
    def __init__(self, setup: Setup):
        self.setup, self.next, self.tail = setup, None, np.zeros(0, complex)
        self.floor, self.settle, self.open, self.tracks, self.track_id = None, 0, [], [], 0
        self.limit = 10 * math.log10(floor_alpha(setup.pfa, setup.pool))

    def feed(self, start: int, x: np.ndarray) -> list[tuple]:
        """The boxes that these samples finish."""
        out: list[tuple] = []
        if self.next is not None and start != self.next:
            out += self.finish()
            self.tail = x[:0]
        begin = start - len(self.tail)
        x = np.concatenate([self.tail, x])
        span = self.setup.pool * self.setup.size
        rows = len(x) // span
        for i, power in enumerate(row_powers(x[: rows * span], self.setup) if rows else ()):
            out += self._row(begin + i * span, power)
        self.tail, self.next = x[rows * span :], begin + len(x)
        return out

    def _row(self, sample: int, power: np.ndarray) -> list[tuple]:
        s, span = self.setup, self.setup.pool * self.setup.size
        above, floor, settle = floor_step(self.floor, self.settle, power, snap_db=s.snap)
        steady = self.floor is not None and not self.settle and not settle
        for low, high in runs_in(above > self.limit, s.bridge) if steady else ():
            touched = [b for b in self.open if low < b["high"] + s.bridge + 1 and high > b["low"] - s.bridge - 1]
            cells = int((above[low:high] > self.limit).sum())
            box = {
                "from": min([b["from"] for b in touched], default=sample), "to": sample + span, "low": min([low, *(b["low"] for b in touched)]),
                "high": max([high, *(b["high"] for b in touched)]), "cells": cells + sum(b["cells"] for b in touched),
                "signal": float(power[low:high].sum()) + sum(b["signal"] for b in touched),
                "noise": float(self.floor[low:high].sum()) + sum(b["noise"] for b in touched)
            }
            self.open = [b for b in self.open if b not in touched] + [box]
        self.floor, self.settle = floor, settle
        done = [b for b in self.open if sample + span - b["to"] > s.bridge * span]
        self.open = [b for b in self.open if b not in done]
        return self._told(done)

    def _told(self, done: list[dict]) -> list[tuple]:
        s, out = self.setup, []
        boxes = sorted(
            (
                b["from"] / s.rate, b["to"] / s.rate, s.centre + (b["low"] - s.size / 2 - 0.5) * s.rate / s.size,
                s.centre + (b["high"] - s.size / 2 - 0.5) * s.rate / s.size, 10 * math.log10(max(b["signal"], 1e-300) / max(b["noise"], 1e-300)), b["cells"]
            ) for b in done if b["cells"] >= s.least
        )
        if boxes:
            given = [(t0, t1, low, high, "") for t0, t1, low, high, *_ in boxes]
            self.tracks, _, self.track_id, owner = track_step(self.tracks, given, self.track_id, silence=s.silence)
            out = [(*b, t) for b, t in zip(boxes, owner, strict=True)]
        return out

    def finish(self) -> list[tuple]:
        """What is open when the capture ends or breaks off."""
        done, self.open = self.open, []
        return self._told(done)


def detect_captures(blocks: DataFrame, key: str, setup: Setup) -> DataFrame:
    """key and boxes with their tracks of blocks (key, start, re, im)."""
    kind = blocks.schema[key].dataType.simpleString()
    names = [key, *(c.split()[0] for c in BOX.split(", "))]

    def told(arrow: pa.DataType, capture: object, boxes: list[tuple]) -> pa.RecordBatch:
        kinds = [arrow, *[pa.float64()] * 5, pa.int64(), pa.int64()]
        cols = list(zip(*[(capture, *b) for b in boxes], strict=True)) or [()] * 8
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, capture, arrow = None, None, pa.int64()
        for batch in batches:
            arrow = batch.column(0).type
            for name, start, re, im in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), _arrays(batch, "re"), _arrays(batch, "im"), strict=True
            ):
                if machine is None or name != capture:
                    if machine:
                        yield told(arrow, capture, machine.finish())
                    machine, capture = Machine(setup), name
                yield told(arrow, capture, machine.feed(start, re + 1j * im))
        if machine:
            yield told(arrow, capture, machine.finish())

    dealt = blocks.select(key, "start", "re", "im").repartition(key).sortWithinPartitions(key, "start")
    return dealt.mapInArrow(run, f"{key} {kind}, {BOX}")


def detect_stream(blocks: DataFrame, key: str, setup: Setup, wait_ms: int = 60_000) -> DataFrame:
    """The same of a stream of blocks with ``event_time``; a capture that is silent for so long in event time is finished."""
    kind = blocks.schema[key].dataType.simpleString()
    names = [key, *(c.split()[0] for c in BOX.split(", "))]

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = pickle.loads(state.get[0]) if state.exists else Machine(setup)
        out = []
        if state.hasTimedOut:
            out = machine.finish()
            state.remove()
        else:
            rows = pd.concat(list(parts)).sort_values("start")
            for r in rows.itertuples():
                out += machine.feed(int(r.start), np.asarray(r.re, float) + 1j * np.asarray(r.im, float))
            state.update((pickle.dumps(machine),))
            last = int(rows["event_time"].max().timestamp() * 1000)
            state.setTimeoutTimestamp(max(last + wait_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(k[0], *b) for b in out], columns=names)

    return blocks.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {BOX}", "machine binary", "append", GroupStateTimeout.EventTimeTimeout)
