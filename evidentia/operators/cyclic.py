"""Blind search for cyclic features: lines that a modulated signal has in its lag products, far below the noise.

A capture is a table of coherent segments (blocks of one size, see ``series``). Every level cuts the band into channels of its
width; in each channel and segment the products of the series with itself at some lags are windowed and transformed. Their
squared magnitudes, in units of the channel's power, add up over the segments: under noise a bin's sum follows a Gamma
distribution with as many degrees as segments, once its scale, the median around it, is taken away.

The sums are mergeable: a task adds up the segments it has, a shuffle by (capture, level, channel, product, lag, bin) adds up the
tasks' sums, and only then a channel's lags and bins, bounded in number, come together for medians, thresholds and peaks. No
capture is ever in one group. The threshold follows from the false alarms that the whole search may give.

Defined cases: segments shorter than the others are left out, as are captures without a whole one; a silent channel has
no features; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.stats import gamma_p, gamma_quantile
from evidentia.operators.series import _arrays
from evidentia.operators.tables import tasks


class Level(NamedTuple):
    """Channels around these frequencies (shares of the rate), each narrowed by averaging ``decimate`` samples."""

    decimate: int = 1
    offsets: tuple[float, ...] = (0.0,)


PLAIN_LAGS, CONJUGATE_LAGS = (1, 2, 4), (0, 1)
#: The first bins of the plain products, next to the power itself, are not searched.
NEAR_ZERO = 4


def window_of(n: int) -> np.ndarray:
    """Four-term window whose side lobes are 92 dB down."""
    t = 2 * np.pi * np.arange(n) / max(n - 1, 1)
    return 0.35875 - 0.48829 * np.cos(t) + 0.14128 * np.cos(2 * t) - 0.01168 * np.cos(3 * t)


def channel(x: np.ndarray, start: np.ndarray, offset: float, decimate: int) -> np.ndarray:
    """Segments (rows) moved down by ``offset`` cycles a sample and averaged."""
    if offset:
        x = x * np.exp(-2j * np.pi * offset * (start[:, None] + np.arange(x.shape[1])))
    whole = x.shape[1] // decimate
    return x[:, : whole * decimate].reshape(len(x), whole, decimate).mean(axis=2)


def lag_statistic(y: np.ndarray, lag: int, conjugate: bool) -> np.ndarray:
    """Per segment (row) and bin the squared magnitude of the windowed lag product, in units of the segment's power squared."""
    n = y.shape[1]
    power = (np.abs(y) ** 2).mean(axis=1)
    product = y[:, lag:] * (y[:, : n - lag] if conjugate else np.conj(y[:, : n - lag]))
    if not conjugate:
        product = product - product.mean(axis=1, keepdims=True)
    w = window_of(n - lag)
    spectrum = np.abs(np.fft.fft(product * w, n, axis=1)) ** 2
    spectrum = spectrum if conjugate else spectrum[:, : n // 2 + 1]
    scale = (w**2).sum() * power**2
    return np.divide(spectrum, scale[:, None], out=np.zeros_like(spectrum), where=scale[:, None] > 0)


CELL = "level int, channel int, conjugate boolean, lag int"
#: Segments in a row of a capture that come to one task, and numbers that a task works on at once.
TOGETHER, AT_ONCE = 64, 1 << 18


def _side_by_side(blocks: DataFrame, key: str, size: int) -> DataFrame:
    """key, start, re, im of the whole segments: up to ``TOGETHER`` of a capture in one task and in a row, so that it adds them up before it tells.

    A longer capture goes to many tasks. The number of tasks is named, for work is far more than the bytes that come in.
    """
    whole = blocks.filter(F.size("re") == size).select(key, "start", "re", "im")
    return whole.repartition(tasks(blocks), F.col(key), F.floor(F.col("start") / (size * TOGETHER))).sortWithinPartitions(key, "start")


def _runs(keys: pa.Array) -> np.ndarray:
    """Where runs of equal keys begin."""
    codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.flatnonzero(np.diff(codes, prepend=-1))


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def lag_sums(blocks: DataFrame, key: str, size: int, levels: list[Level], plain: tuple[int, ...] = PLAIN_LAGS, conjugate: tuple[int, ...] = CONJUGATE_LAGS) -> DataFrame:
    """key, level, channel, conjugate, lag, bin, stat, segments of all captures' whole segments."""
    kind = blocks.schema[key].dataType.simpleString()
    kinds = [(False, lag) for lag in plain] + [(True, lag) for lag in conjugate]
    most = max(1, AT_ONCE // size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, most) for i in range(0, whole.num_rows, most)):
                x = np.stack(_arrays(batch, "re")) + 1j * np.stack(_arrays(batch, "im"))
                first, start = _runs(batch.column(0)), batch.column(1).to_numpy()
                keys, counts = batch.column(0).take(pa.array(first)), np.diff(np.append(first, len(x)))
                for level, (decimate, offsets) in enumerate(levels):
                    for c, offset in enumerate(offsets):
                        y = channel(x, start, offset, decimate)
                        for conj, lag in kinds:
                            same = [pa.array(np.full(len(first), v), t) for v, t in ((level, pa.int32()), (c, pa.int32()), (conj, pa.bool_()), (lag, pa.int32()))]
                            added = np.add.reduceat(lag_statistic(y, lag, conj), first, axis=0)
                            yield pa.RecordBatch.from_arrays(
                                [keys, *same, _lists(added), pa.array(counts, pa.int64())], [key, "level", "channel", "conjugate", "lag", "stats", "segments"]
                            )

    parts = _side_by_side(blocks, key, size).mapInArrow(run, f"{key} {kind}, {CELL}, stats array<double>, segments long")
    cell = [key, "level", "channel", "conjugate", "lag"]
    rows = parts.select(*cell, "segments", F.posexplode("stats").alias("bin", "stat"))
    return rows.groupBy(*cell, "bin").agg(F.sum("stat").alias("stat"), F.sum("segments").alias("segments"))


def local_floor(rows: np.ndarray) -> np.ndarray:
    """The scale of each bin (last axis): medians of blocks of bins, and the median of the nine blocks around, drawn out between their middles."""
    bins = rows.shape[-1]
    blocks = min(128, max(8, bins // 64))
    width = bins // blocks
    if width < 8:
        return np.broadcast_to(np.maximum(np.median(rows, axis=-1, keepdims=True), 1e-30), rows.shape)
    middle = np.median(rows[..., : blocks * width].reshape(*rows.shape[:-1], blocks, width), axis=-1)
    edges = [(0, 0)] * (middle.ndim - 1) + [(4, 4)]
    around = np.median(np.lib.stride_tricks.sliding_window_view(np.pad(middle, edges, mode="edge"), 9, axis=-1), axis=-1)
    at = np.clip((np.arange(bins) + 0.0) / width - 0.5, 0, blocks - 1)
    left = np.minimum(at.astype(int), blocks - 2)
    return np.maximum(around[..., left] + (around[..., left + 1] - around[..., left]) * (at - left), 1e-30)


def searched(size: int, levels: list[Level], plain: tuple[int, ...] = PLAIN_LAGS, conjugate: tuple[int, ...] = CONJUGATE_LAGS) -> int:
    """How many cells the search looks at."""
    return sum(
        len(o) * (len(plain) * max(size // d // 2 + 1 - NEAR_ZERO, 0) + len(conjugate) * (size // d)) for d, o in levels
    )


def runs_of(over: np.ndarray, guard: int) -> list[np.ndarray]:
    at = np.flatnonzero(over)
    return np.split(at, np.flatnonzero(np.diff(at) > guard) + 1) if len(at) else []


FEATURE = "alpha double, lag int, segments long, statistic double, threshold double, p_family double"


def features(sums: DataFrame, key: str, size: int, levels: list[Level], pfa: float = 1e-3, **lags: tuple[int, ...]) -> DataFrame:
    """key, level, channel, conjugate and alpha (cycles a sample), lag, segments, statistic, threshold, p_family of what stands out.

    pfa: the chance of any false alarm in a capture, split over all cells. statistic: in Gamma units of so many segments.
    """
    trials = searched(size, levels, **lags)
    kind = sums.schema[key].dataType.simpleString()

    names = [key, "level", "channel", "conjugate", *[c.split()[0] for c in FEATURE.split(", ")]]

    def found(head: pa.RecordBatch, rows: np.ndarray, level: int, conj: bool, segments: np.ndarray, lags: np.ndarray, grid: np.ndarray) -> pa.RecordBatch:
        """Features of ``rows`` of one level and product. grid: channel, lag, bin."""
        bins = grid.shape[2]
        middle, limit = (np.array([gamma_quantile(p, int(s)) for s in segments]) for p in (0.5, 1 - pfa / trials))
        units = grid / local_floor(grid) * middle[:, None, None]
        best = units.max(axis=1)
        allowed = np.arange(bins) >= (0 if conj else NEAR_ZERO)
        over = (best > limit[:, None]) & allowed & (grid.max(axis=(1, 2)) > 0)[:, None]
        of, out = [], []
        for g in np.flatnonzero(over.any(axis=1)):
            for own in runs_of(over[g], 4):
                k = int(own[np.argmax(best[g, own])])
                a, b, c = (best[g, i] if 0 <= i < bins else best[g, k] for i in (k - 1, k, k + 1))
                bend = a - 2 * b + c
                at = k + (0.5 * (a - c) / bend if bend < 0 and 0 < k < bins - 1 else 0.0)
                n = size // levels[level].decimate
                alpha = (at - n if conj and at > n / 2 else at) / n / levels[level].decimate
                chance = min(1.0, trials * max(1 - gamma_p(int(segments[g]), float(b)), 0.0))
                of.append(int(rows[g]))
                out.append((alpha, int(lags[int(np.argmax(units[g, :, k]))]), int(segments[g]), float(b), float(limit[g]), chance))
        own = [head.column(i).take(pa.array(of, pa.int64())) for i in range(4)]
        kinds = (pa.float64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([*own, *[pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)]], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            cells = whole.column(5).offsets.to_numpy()
            many = max(1, AT_ONCE * whole.num_rows // max(1, int(cells[-1] - cells[0])))
            for batch in (whole.slice(i, many) for i in range(0, whole.num_rows, many)):
                level, conj, segments = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 3, 4))
                lag, bins, stat = (batch.column(i) for i in (5, 6, 7))
                sizes = np.diff(lag.offsets.to_numpy())
                of = np.repeat(np.arange(batch.num_rows), sizes)
                lag, bins, stat = (c.flatten().to_numpy(zero_copy_only=False) for c in (lag, bins, stat))
                last = np.maximum.reduceat(bins, np.cumsum(sizes) - sizes)
                shapes = np.column_stack([level, conj, last]).astype(int)
                for shape in np.unique(shapes, axis=0):
                    mine = (shapes == shape).all(axis=1)
                    rows, own = np.flatnonzero(mine), mine[of]
                    lags = np.unique(lag[own])
                    grid = np.zeros((len(rows), len(lags), shape[2] + 1))
                    grid[np.searchsorted(rows, of[own]), np.searchsorted(lags, lag[own]), bins[own]] = stat[own]
                    yield found(batch, rows, int(shape[0]), bool(shape[1]), segments[rows], lags, grid)

    cells = F.collect_list(F.struct("lag", "bin", "stat")).alias("_c")
    packed = sums.groupBy(key, "level", "channel", "conjugate").agg(F.max("segments").alias("segments"), cells)
    rows = packed.select(key, "level", "channel", "conjugate", "segments", *[F.col(f"_c.{c}").alias(c) for c in ("lag", "bin", "stat")])
    return rows.mapInArrow(run, f"{key} {kind}, level int, channel int, conjugate boolean, {FEATURE}")


def distinct_features(found: DataFrame, key: str, tolerance: float) -> DataFrame:
    """Features of one capture and product within a chain of the tolerance as one: the most significant, and how many levels saw it."""
    w = Window.partitionBy(key, "conjugate").orderBy("alpha", "level", "channel")
    new = F.coalesce((F.col("alpha") - F.lag("alpha").over(w) > tolerance).cast("int"), F.lit(1))
    lines = found.withColumn("_new", new).withColumn("_line", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max_by(
        F.struct("alpha", "level", "channel", "lag", "segments", "statistic", "threshold", "p_family"),
        F.struct(F.col("statistic") / F.col("threshold"), -F.col("level"), -F.col("channel"))
    )
    return lines.groupBy(key, "conjugate", "_line").agg(best.alias("b"), F.countDistinct("level").alias("levels")).select(key, "conjugate", "b.*", "levels")


def search(blocks: DataFrame, key: str, size: int, levels: list[Level], pfa: float = 1e-3) -> DataFrame:
    """The cyclic features of every capture."""
    return distinct_features(features(lag_sums(blocks, key, size, levels), key, size, levels, pfa), key, 1.5 / size)


def strips_of(x: np.ndarray, bins: int) -> np.ndarray:
    """Of each segment (row) the strips of its spectral correlation: channel by fine cycle frequency, squared magnitudes in units of its power squared.

    Every sample's short transform of ``bins`` channels, times the conjugate of the sample in its middle, is transformed along time.
    """
    n, size = x.shape[1] - bins + 1, x.shape[1]
    frames = np.lib.stride_tricks.sliding_window_view(x, bins, axis=1) * np.hanning(bins + 1)[:bins]
    turned = np.exp(-2j * np.pi * np.arange(bins)[None, :] * np.arange(n)[:, None] / bins)
    product = np.fft.fft(frames, axis=2) * turned * np.conj(x[:, bins // 2 : bins // 2 + n])[:, :, None]
    w = window_of(n)
    strips = np.abs(np.fft.fft(product * w[None, :, None], size, axis=1)) ** 2
    power = (np.abs(x) ** 2).mean(axis=1)[:, None, None] ** 2 * (w**2).sum() * (np.hanning(bins + 1)[:bins] ** 2).sum()
    return np.divide(strips, power, out=np.zeros_like(strips), where=power > 0).transpose(0, 2, 1)


def spectral_correlation(blocks: DataFrame, key: str, size: int, bins: int = 32) -> DataFrame:
    """key, strip, fine, alpha, frequency (cycles a sample), power, segments: strips of the surface, summed over each capture's whole segments.

    A task adds up the segments that it has; the sums of tasks meet by (key, strip, fine).
    """
    kind = blocks.schema[key].dataType.simpleString()
    most = max(1, AT_ONCE // (size * bins))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, most) for i in range(0, whole.num_rows, most)):
                x = np.stack(_arrays(batch, "re")) + 1j * np.stack(_arrays(batch, "im"))
                first = _runs(batch.column(0))
                added = np.add.reduceat(strips_of(x, bins), first, axis=0)
                keys = batch.column(0).take(pa.array(np.repeat(first, bins)))
                counts = np.repeat(np.diff(np.append(first, len(x))), bins)
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(np.tile(np.arange(bins, dtype=np.int32), len(first))), _lists(added.reshape(-1, added.shape[2])), pa.array(counts, pa.int64())],
                    [key, "strip", "powers", "segments"]
                )

    rows = _side_by_side(blocks, key, size).mapInArrow(run, f"{key} {kind}, strip int, powers array<double>, segments long").select(
        key, "strip", "segments", F.posexplode("powers").alias("fine", "power")
    ).groupBy(key, "strip", "fine").agg(F.sum("power").alias("power"), F.sum("segments").alias("segments"))
    signed = lambda c, n: F.when(2 * F.col(c) >= n, F.col(c) - n).otherwise(F.col(c))
    channel_, fine = signed("strip", bins) / bins, signed("fine", size) / size
    return rows.select(key, "strip", "fine", (channel_ + fine).alias("alpha"), ((channel_ - fine) / 2).alias("frequency"), "power", "segments")
