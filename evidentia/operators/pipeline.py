"""The detector over captures: samples to frames, tiles, hits, boxes and labels, as one chain of DataFrames.

Blocks of samples become frames where they lie, so only powers are moved. A tile, with the frames of a bounded span of
time, is one group; tiles overlap, and each keeps what lies in the time it owns, its middle. A burst that crosses such a
border is two boxes that touch there; the tracker joins them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions.stats import floor_alpha, gamma_quantile
from evidentia.kernels.scenes import mask_components
from evidentia.kernels.signal import spectrogram
from evidentia.operators import records

BOX = "capture_id string, tile long, t0 double, t1 double, f_lo double, f_hi double, snr_db double, cells long, own0 double, own1 double"


def frame_powers(blocks: DataFrame, size: int) -> DataFrame:
    """capture_id, frame, power (array, zero frequency in the middle) of blocks (capture_id, start, re, im).

    Frames don't overlap and don't cross blocks: blocks begin at multiples of ``size``, and what doesn't fill a frame is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                re, im = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (2, 3))
                power = spectrogram(re + 1j * im, size, size).astype(np.float32)
                n = len(power)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), pa.array(power.reshape(-1)))
                frame = batch.column(1)[i].as_py() // size + np.arange(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[i].as_py()] * n, pa.string()), pa.array(frame), flat], ["capture_id", "frame", "power"]
                )

    return blocks.select("capture_id", "start", "re", "im").mapInArrow(run, "capture_id string, frame long, power array<float>")


def tile_floor(power: np.ndarray, pooled: int, near: int = 64) -> np.ndarray:
    """Mean noise of each column of a tile: a low quantile of its rows, and the median of that over neighbouring columns."""
    low = np.quantile(power, 0.25, axis=0) * pooled / gamma_quantile(0.25, pooled)
    wide = np.pad(low, near, mode="reflect" if len(low) > near else "edge")
    return np.median(np.lib.stride_tricks.sliding_window_view(wide, 2 * near + 1), axis=1)


def detect(
    blocks: DataFrame, rate: float, centre_hz: float, layout: dict[str, int], size: int = 256, pfa: float = 1e-5, bridge: int = 1,
    least_cells: int = 3
) -> DataFrame:
    """capture_id, t0, t1, f_lo, f_hi, snr_db, cells: what stands out of the floor, each part once, from the tile that owns its time.

    layout: as ``detection.tile_layout`` has it for a hop of ``size``.
    """
    pool, rows, step = layout["pool"], layout["rows"], layout["step"]
    dt, df, alpha = pool * size / rate, rate / size, floor_alpha(pfa, pool)
    at = F.floor(F.col("frame") / pool)
    first = F.greatest(F.ceil((at - rows + 1) / step), F.lit(0))
    spread = frame_powers(blocks, size).withColumn("tile", F.explode(F.sequence(first, F.floor(at / step))))

    def find(group: pa.Table) -> pa.Table:
        tile, capture = group.column("tile")[0].as_py(), group.column("capture_id")[0].as_py()
        powers = np.concatenate([c.values.to_numpy(zero_copy_only=False) for c in group.column("power").chunks]).reshape(-1, size)
        row = group.column("frame").to_numpy() // pool - tile * step
        counts = np.bincount(row, minlength=rows)
        sums = np.zeros((rows, size))
        np.add.at(sums, row, powers)
        whole = counts == pool  # rows that a capture's end cuts are left out
        power = np.where(whole[:, None], sums / np.maximum(counts, 1)[:, None], 0.0)
        out = []
        if whole.sum() >= 4:
            floor = tile_floor(power[whole], pool)
            for r0, r1, c0, c1, cells in mask_components(power > alpha * floor, bridge):
                if cells >= least_cells:
                    snr = 10 * np.log10(power[r0:r1, c0:c1].mean() / floor[c0:c1].mean())
                    own = (rows - step) // 2
                    begin = tile * step * dt
                    out.append(
                        (
                            capture, tile, begin + r0 * dt, begin + r1 * dt, centre_hz + (c0 - size / 2 - 0.5) * df,
                            centre_hz + (c1 - size / 2 - 0.5) * df, snr, cells, begin + own * dt if tile else 0.0, begin + (own + step) * dt
                        )
                    )
        kinds = [pa.string(), pa.int64(), *[pa.float64()] * 5, pa.int64(), pa.float64(), pa.float64()]
        names = [c.split()[0] for c in BOX.split(", ")]
        return pa.table({n: pa.array([r[i] for r in out], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})

    boxes = spread.groupBy("capture_id", "tile").applyInArrow(find, BOX)
    kept = boxes.withColumns({"t0": F.greatest("t0", "own0"), "t1": F.least("t1", "own1")}).filter("t1 > t0")
    return kept.select("capture_id", "t0", "t1", "f_lo", "f_hi", "snr_db", "cells")


def as_labels(boxes: DataFrame, rate: float, source: str) -> DataFrame:
    """capture_id, sample_start, sample_count, f_lo, f_hi, source of boxes."""
    start, stop = F.round(F.col("t0") * rate).cast("long"), F.round(F.col("t1") * rate).cast("long")
    return boxes.select(
        "capture_id", start.alias("sample_start"), (stop - start).alias("sample_count"), "f_lo", "f_hi", F.lit(source).alias("source")
    )


def relabelled(labels: DataFrame, boxes: DataFrame, rate: float, source: str) -> DataFrame:
    """Labels with those of one source replaced by what was found."""
    return records.replace_source(labels, as_labels(boxes, rate, source), source)
