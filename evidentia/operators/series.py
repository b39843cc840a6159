"""Operators over sampled series: blocks with halos, resampling, markers, linear filters.

A series is a table of blocks: its key, a block number, where the block starts, and arrays of its samples. Blocks are cut at
multiples of one size, so a sample's block follows from its number; a capture's last block may be shorter. Where
an operator needs samples beyond a block's border, ``with_halo`` fetches the neighbours' edges by an equality join on the
block number: only edges are copied, and no series is ever in one place. Results don't depend on the block size.

Defined cases: samples beyond a series' ends are zeros; a missing block is one of zeros; an empty table gives no rows; null
samples are zeros.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.kernels.repair import fill_both_ways

EDGES = ("re", "im")


def blocks_of(samples: DataFrame, key: str, at: str, size: int, re: Column, im: Column | None = None) -> DataFrame:
    """key, block, start, re, im of samples numbered by ``at`` from 0, once each."""
    rows = samples.select(
        F.col(key).alias(key), F.col(at).alias("_at"), F.coalesce(re.cast("double"), F.lit(0.0)).alias("re"),
        (F.lit(0.0) if im is None else F.coalesce(im.cast("double"), F.lit(0.0))).alias("im")
    )
    packed = rows.groupBy(key, F.floor(F.col("_at") / size).alias("block")).agg(F.array_sort(F.collect_list(F.struct("_at", "re", "im"))).alias("s"))
    return packed.select(
        key, "block", (F.col("block") * size).alias("start"), F.transform("s", lambda x: x["re"]).alias("re"), F.transform("s", lambda x: x["im"]).alias("im")
    )


def with_halo(blocks: DataFrame, key: str, halo: int, names: tuple[str, ...] = EDGES) -> DataFrame:
    """Adds before_ and after_ of each array: the last and the first ``halo`` samples of the neighbours, at most a block's size."""
    last = blocks.select(
        key, (F.col("block") + 1).alias("block"), *[F.slice(c, F.greatest(F.size(c) - halo + 1, F.lit(1)), halo).alias(f"before_{c}") for c in names]
    )
    first = blocks.select(key, (F.col("block") - 1).alias("block"), *[F.slice(c, 1, halo).alias(f"after_{c}") for c in names])
    none = F.array().cast("array<double>")
    joined = blocks.join(last, [key, "block"], "left").join(first, [key, "block"], "left")
    return joined.withColumns({f"{side}_{c}": F.coalesce(f"{side}_{c}", none) for c in names for side in ("before", "after")})


def _arrays(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    col = batch.column(batch.schema.get_field_index(name))
    ends = col.offsets.to_numpy() - col.offsets[0].as_py()
    values = col.flatten().to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _complex(batch: pa.RecordBatch, prefix: str = "") -> list[np.ndarray]:
    return [a + 1j * b for a, b in zip(_arrays(batch, f"{prefix}re"), _arrays(batch, f"{prefix}im"), strict=True)]


def _haloed(batch: pa.RecordBatch, halo: int, size: int) -> Iterator[np.ndarray]:
    """Each block between its neighbours' edges, with zeros where there are none; ``size``: of a block with one after it."""
    for own, before, after in zip(_complex(batch), _complex(batch, "before_"), _complex(batch, "after_"), strict=True):
        gap = size - len(own) if len(after) else 0
        yield np.concatenate([np.zeros(halo - len(before)), before, own, np.zeros(gap), after, np.zeros(halo - len(after))])


def ratio_of(from_rate: float, to_rate: float, most: int = 10_000) -> tuple[int, int]:
    """The new rate over the old one as a fraction."""
    f = Fraction(to_rate / from_rate).limit_denominator(most)
    return f.numerator, f.denominator


def sinc_taps(up: int, down: int, half: int) -> tuple[np.ndarray, int]:
    """Weights of the samples around each of ``up`` phases, and how far they reach: a sinc of the narrower band under a raised cosine."""
    band = min(1.0, up / down)
    reach = math.ceil(half / band)
    d = (np.arange(up)[:, None] / up - np.arange(-reach, reach + 1)) * band
    return np.where(np.abs(d) < half, np.sinc(d) * (0.5 + 0.5 * np.cos(np.pi * d / half)), 0.0) * band, reach


def resample(blocks: DataFrame, key: str, size: int, from_rate: float, to_rate: float, half: int = 16) -> DataFrame:
    """key, at, re, im: the series at another rate; output ``at`` stands at input sample at * from_rate / to_rate.

    half: zero crossings of the sinc on either side; a block must be as long as the taps reach.
    """
    up, down = ratio_of(from_rate, to_rate)
    taps, reach = sinc_taps(up, down, half)
    if reach > size:
        raise ValueError(f"blocks must hold {reach} samples at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, starts, sizes = batch.column(0), batch.column(1).to_pylist(), [len(x) for x in _arrays(batch, "re")]
            for i, x in enumerate(_haloed(batch, reach, size)):
                at = np.arange(-(-starts[i] * up // down), -(-(starts[i] + sizes[i]) * up // down))
                base = at * down // up - starts[i]
                y = np.empty(len(at), complex)
                for phase in np.unique(at * down % up):
                    own = at * down % up == phase
                    y[own] = np.lib.stride_tricks.sliding_window_view(x, 2 * reach + 1)[base[own]] @ taps[phase]
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(np.full(len(at), i))), pa.array(at), pa.array(y.real), pa.array(y.imag)], [key, "at", "re", "im"]
                )

    haloed = with_halo(blocks, key, reach).select(key, "start", *EDGES, *[f"{s}_{c}" for s in ("before", "after") for c in EDGES])
    return haloed.mapInArrow(run, f"{key} {blocks.schema[key].dataType.simpleString()}, at long, re double, im double")


def resampled_labels(labels: DataFrame, from_rate: float, to_rate: float) -> DataFrame:
    """Labels (sample_start, sample_count) in samples of the new rate."""
    up, down = ratio_of(from_rate, to_rate)
    return labels.withColumns({c: F.round(F.col(c) * up / down).cast("long") for c in ("sample_start", "sample_count")})


def filled(blocks: DataFrame, key: str, size: int, most: int, order: int = 16, context: int = 128) -> DataFrame:
    """key, at, value, inferred: the real series with its missing samples (NaN in ``re``), predicted from both sides of each gap.

    A gap of up to ``most`` samples is filled by two autoregressive predictions, from the ``context`` samples before and after that are not
    missing themselves, fading from one to the other; by a straight line if these are few; longer gaps, and those at an end, stay
    NaN. Every gap is seen with its context in each block that it touches, so blocks don't matter.
    """
    halo = context + most
    if halo > size:
        raise ValueError(f"blocks must hold {halo} samples at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (_arrays(batch, c) for c in ("re", "before_re", "after_re"))
            for i, (start, own, before, after) in enumerate(zip(batch.column(1).to_pylist(), *columns, strict=True)):
                x = np.concatenate([before, own, after])
                missing = np.isnan(x)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], missing, [0]]).astype(int)))
                y, first = x.copy(), len(before)
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    if b > first and a < first + len(own) and b - a <= most and a > 0 and b < len(x):
                        low = max([0, a - context, *(edge[1::2][edge[1::2] <= a - 1].tolist()[-1:])])
                        high = min([len(x), b + context, *(edge[::2][edge[::2] > b].tolist()[:1])])
                        y[a:b] = fill_both_ways(x[low:high], a - low, b - low, order, context)[a - low : b - low]
                at, span = np.arange(start, start + len(own)), slice(first, first + len(own))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.full(len(at), i))), pa.array(at), pa.array(y[span]), pa.array(missing[span])], [key, "at", "value", "inferred"]
                )

    haloed = with_halo(blocks, key, halo, ("re",)).select(key, "start", "re", "before_re", "after_re")
    return haloed.mapInArrow(run, f"{key} {blocks.schema[key].dataType.simpleString()}, at long, value double, inferred boolean")


# Markers


def marker_scores(blocks: DataFrame, key: str, size: int, marker: np.ndarray) -> DataFrame:
    """key, at, score: the best place of each block where the marker may begin. score: correlation, 1 for the marker itself.

    Correlations are by FFT over a block and the halo after it (overlap-save).
    """
    marker, n = np.asarray(marker, complex), len(marker)
    if not 0 < n <= size:
        raise ValueError("the marker must fit in a block")
    energy = float((np.abs(marker) ** 2).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, best = batch.column(1).to_pylist(), []
            for start, x, own in zip(starts, _haloed(batch, n, size), _arrays(batch, "re"), strict=True):
                x = x[n:]
                width = 1 << (len(x) + n - 1).bit_length()
                met = np.fft.ifft(np.fft.fft(x, width) * np.conj(np.fft.fft(marker, width)))[: len(own)]
                power = np.cumsum(np.append(0, np.abs(x) ** 2))
                power = power[n : n + len(own)] - power[: len(own)]
                score = np.abs(met) ** 2 / np.maximum(power * energy, 1e-300)
                score = np.where(power > 1e-12 * max(power.max(initial=0.0), 1e-300), score, 0.0)
                k = int(np.argmax(np.round(score, 12)))
                best.append((start + k, float(score[k])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([b[0] for b in best], pa.int64()), pa.array([b[1] for b in best], pa.float64())], [key, "at", "score"]
            )

    haloed = with_halo(blocks, key, n).select(key, "start", *EDGES, *[f"{s}_{c}" for s in ("before", "after") for c in EDGES])
    return haloed.mapInArrow(run, f"{key} {blocks.schema[key].dataType.simpleString()}, at long, score double")


def find_marker(scores: DataFrame, key: str) -> DataFrame:
    """key, at, score: the best place of each series; of equal scores the first."""
    best = F.max(F.struct(F.round("score", 9).alias("score"), (-F.col("at")).alias("before")))
    return scores.groupBy(key).agg(best.alias("b")).select(key, (-F.col("b.before")).alias("at"), F.col("b.score").alias("score"))


def align_labels(labels: DataFrame, key: str, begins: DataFrame, ends: DataFrame, span: float, least: float = 0.5) -> DataFrame:
    """Labels (key, start_s, duration_s in samples of the sender) as sample_start, sample_count of each series, with its drift.

    begins, ends: where the marker was found at the sender's samples 0 and ``span`` (key, at, score). Without a begin of score
    ``least`` a series has no labels: one in the wrong place is worse than none. Without such an end there is no drift.
    """
    a = begins.filter(F.col("score") >= least).select(key, F.col("at").alias("_a"))
    b = ends.filter(F.col("score") >= least).select(key, F.col("at").alias("_b"))
    scale = F.coalesce((F.col("_b") - F.col("_a")) / F.lit(float(span)), F.lit(1.0))
    rows = labels.join(a, key).join(b, key, "left").withColumn("_scale", scale)
    return rows.withColumns(
        {
            "sample_start": F.round(F.col("_a") + F.col("start_s") * F.col("_scale")).cast("long"),
            "sample_count": F.round(F.col("duration_s") * F.col("_scale")).cast("long"),
            "drift_ppm": F.when(F.col("_b").isNotNull(), (F.col("_scale") - 1) * 1e6)
        }
    ).drop("_a", "_b", "_scale")


# Linear filters


def _design(x: np.ndarray, start: int, taps: int, n: int, shifts: tuple[float, ...]) -> np.ndarray:
    """Rows of n samples: delayed copies of the series, shifted in frequency, then their conjugates, then one. x has ``taps - 1`` samples more."""
    half = taps // 2
    at = np.arange(start - (taps - 1 - half), start + n + half)
    copies = []
    for shift in shifts:
        moved = x * np.exp(2j * np.pi * shift * at) if shift else x
        copies.append(np.lib.stride_tricks.sliding_window_view(moved, taps)[:n, ::-1])
    plain = np.concatenate(copies, axis=1)
    return np.concatenate([plain, np.conj(plain), np.ones((n, 1))], axis=1)


def columns_of(taps: int, shifts: tuple[float, ...]) -> int:
    return 2 * taps * len(shifts) + 1


def gram(blocks: DataFrame, key: str, size: int, taps: int, shifts: tuple[float, ...] = (0.0,)) -> DataFrame:
    """key, i, j, re, im: the normal equations of a widely linear filter from ``re``, ``im`` to ``to_re``, ``to_im``.

    Column ``j`` = ``columns_of(taps, shifts)`` is the right side; of the symmetric rest only i <= j is given. A task sums its blocks of
    a key, sums of tasks are added up by (key, i, j). shifts: in cycles a sample, of the copies that the filter sees (0 alone:
    no cyclic copies).
    """
    half = max(taps // 2, taps - 1 - taps // 2)
    width = columns_of(taps, shifts)
    upper = np.triu_indices(width + 1)
    rows_, cols_ = (u[upper[0] < width] for u in upper)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}

        def told() -> pa.RecordBatch:
            n = len(sums)
            flat = np.concatenate([g[rows_, cols_] for g in sums.values()]) if n else np.zeros(0, complex)
            keys = pa.array(list(sums), kind).take(pa.array(np.repeat(np.arange(n), len(rows_))))
            return pa.RecordBatch.from_arrays(
                [keys, pa.array(np.tile(rows_, n).astype(np.int32)), pa.array(np.tile(cols_, n).astype(np.int32)), pa.array(flat.real), pa.array(flat.imag)],
                [key, "i", "j", "re", "im"]
            )

        kind = pa.int64()
        for batch in batches:
            kind = batch.column(0).type
            starts = batch.column(1).to_pylist()
            for k, start, x, own in zip(batch.column(0).to_pylist(), starts, _haloed(batch, half, size), _complex(batch, "to_"), strict=True):
                x = x[half - (taps - 1 - taps // 2) :]
                m = np.concatenate([_design(x, start, taps, len(own), shifts), own[:, None]], axis=1)
                g = m.conj().T @ m
                sums[k] = sums[k] + g if k in sums else g
            if len(sums) * len(rows_) > 500_000:
                yield told()
                sums.clear()
        yield told()

    haloed = with_halo(blocks, key, half).select(
        key, "start", *EDGES, *[f"{s}_{c}" for s in ("before", "after") for c in EDGES], "to_re", "to_im"
    )
    parts = haloed.mapInArrow(run, f"{key} {blocks.schema[key].dataType.simpleString()}, i int, j int, re double, im double")
    return parts.groupBy(key, "i", "j").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def solve(equations: DataFrame, key: str, width: int, ridge: float = 1e-6) -> DataFrame:
    """key, i, re, im: the weights of each key's least squares; a ridge of this share of the mean diagonal keeps them bounded."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = np.zeros((width, width + 1), complex)
        g[group["i"], group["j"]] = group["re"] + 1j * group["im"]
        square = g[:, :width]
        square = np.triu(square) + np.triu(square, 1).conj().T
        square = square + ridge * np.trace(square).real / width * np.eye(width)
        w = np.linalg.lstsq(square, g[:, width], rcond=None)[0]
        return pd.DataFrame({key: [group[key].iloc[0]] * width, "i": np.arange(width), "re": w.real, "im": w.imag})

    return equations.groupBy(key).applyInPandas(run, f"{key} {equations.schema[key].dataType.simpleString()}, i int, re double, im double")


def filtered(blocks: DataFrame, key: str, size: int, weights: DataFrame, taps: int, shifts: tuple[float, ...] = (0.0,)) -> DataFrame:
    """key, at, re, im: the series through the filter of its key; series without one are left out."""
    half = max(taps // 2, taps - 1 - taps // 2)
    own = weights.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "re", "im"))).alias("w"))
    own = own.select(key, F.col("w.re").alias("w_re"), F.col("w.im").alias("w_im"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, sizes = batch.column(1).to_pylist(), [len(x) for x in _arrays(batch, "re")]
            for i, (x, w) in enumerate(zip(_haloed(batch, half, size), _complex(batch, "w_"), strict=True)):
                y = _design(x[half - (taps - 1 - taps // 2) :], starts[i], taps, sizes[i], shifts) @ w
                at = np.arange(starts[i], starts[i] + sizes[i])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.full(len(at), i))), pa.array(at), pa.array(y.real), pa.array(y.imag)], [key, "at", "re", "im"]
                )

    haloed = with_halo(blocks, key, half).join(own, key).select(
        key, "start", *EDGES, *[f"{s}_{c}" for s in ("before", "after") for c in EDGES], "w_re", "w_im"
    )
    return haloed.mapInArrow(run, f"{key} {blocks.schema[key].dataType.simpleString()}, at long, re double, im double")
