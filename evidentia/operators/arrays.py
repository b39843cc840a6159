"""Kernels over groups and rows by Arrow: tracks, gaps, spectra, word errors, pulse trains.

A group is one recording, track or scene. Rows of long recordings come as blocks, so a task holds one group of
bounded length at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.kernels import fields, repair, signal


def spectra(blocks: DataFrame, rate: float, size: int = 1024) -> DataFrame:
    """capture_id, start, dbfs, low_hz, high_hz of blocks (capture_id, start, re, im)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                x = np.asarray(r.re) + 1j * np.asarray(r.im)
                low, high = signal.occupied_band(x, rate, size=size)
                out.append((r.capture_id, r.start, float(10 * np.log10(np.mean(np.abs(x) ** 2) + 1e-30)), low, high))
            yield pd.DataFrame(out, columns=["capture_id", "start", "dbfs", "low_hz", "high_hz"])

    return blocks.select("capture_id", "start", "re", "im").mapInPandas(
        run, "capture_id string, start long, dbfs double, low_hz double, high_hz double"
    )


def word_errors(pairs: DataFrame, reference: str, hypothesis: str, keys: list[str]) -> DataFrame:
    """keys, subs, dels, ins, hits, words of each pair after normalisation."""
    kinds = dict(pairs.select(*keys).dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [repair.align_words(repair.normalised(x).split(), repair.normalised(y).split()) for x, y in zip(b["_r"], b["_h"], strict=True)]
            out = b[keys].copy()
            for i, name in enumerate(("subs", "dels", "ins", "hits")):
                out[name] = [r[i] for r in rows]
            out["words"] = [r[0] + r[1] + r[3] for r in rows]
            yield out

    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + [f"{n} long" for n in ("subs", "dels", "ins", "hits", "words")])
    return pairs.select(*keys, F.col(reference).alias("_r"), F.col(hypothesis).alias("_h")).mapInPandas(run, schema)


def corpus_errors(errors: DataFrame, *keys: str) -> DataFrame:
    """Summed counts and the word error rate."""
    total = errors.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("subs", "dels", "ins", "hits", "words")])
    return total.withColumn("wer", F.when(F.col("words") > 0, (F.col("subs") + F.col("dels") + F.col("ins")) / F.col("words")))


def smooth_tracks(fixes: DataFrame, gap_s: float) -> DataFrame:
    """track_id, t, lat, lon, sigma_m, tier: smoothed fixes, and filled ones where a wait exceeds the gap.

    fixes: track_id, t, lat, lon, sigma (metres). Process noise is that of greatest likelihood.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t").drop_duplicates("t")
        t = g["t"].to_numpy(float) - g["t"].iloc[0]
        lat0, lon0 = g["lat"].iloc[0], g["lon"].iloc[0]
        k = np.pi / 180 * 6_371_000.0
        north, east = (g["lat"].to_numpy() - lat0) * k, (g["lon"].to_numpy() - lon0) * k * np.cos(np.radians(lat0))
        sigma = g["sigma"].fillna(10.0).to_numpy(float)
        step = np.median(np.diff(t)) if len(t) > 1 else 1.0
        extra = np.concatenate([np.arange(a + step, b - step / 2, step) for a, b in zip(t, t[1:], strict=False) if b - a > gap_s] or [np.zeros(0)])
        at = np.union1d(t, extra)
        q = repair.best_noise(t, north, sigma) if len(t) > 2 else 1.0
        n, sn, _ = repair.kalman_smooth(t, north, sigma, q, at)
        e, se, _ = repair.kalman_smooth(t, east, sigma, q, at)
        tier = np.where(np.isin(at, t), "cleaned", "inferred")
        return pd.DataFrame(
            {
                "track_id": g["track_id"].iloc[0], "t": at + g["t"].iloc[0], "lat": lat0 + n / k, "lon": lon0 + e / (k * np.cos(np.radians(lat0))),
                "sigma_m": np.hypot(sn, se), "tier": tier
            }
        )

    return fixes.groupBy("track_id").applyInPandas(
        run, f"track_id {dict(fixes.dtypes)['track_id']}, t double, lat double, lon double, sigma_m double, tier string"
    )


def pulse_trains(pulses: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """scene, toa_s, train, pri_s, tier: pulses with their train (-1 for none), and inferred ones that a train lacks."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        toa = np.sort(g["toa_s"].to_numpy(float))
        train, out = np.full(len(toa), -1), []
        for i, (pri, own) in enumerate(repair.deinterleave(toa, tolerance=tolerance)):
            train[own] = i
            out += [(t, i, pri, "measured") for t in toa[own]] + [(t, i, pri, "inferred") for t in repair.missing_pulses(toa[own], pri)]
        out += [(t, -1, np.nan, "measured") for t in toa[train < 0]]
        return pd.DataFrame(
            sorted(out), columns=["toa_s", "train", "pri_s", "tier"]
        ).assign(scene=g["scene"].iloc[0])[["scene", "toa_s", "train", "pri_s", "tier"]]

    return pulses.groupBy("scene").applyInPandas(run, f"scene {dict(pulses.dtypes)['scene']}, toa_s double, train long, pri_s double, tier string")


def kriged(near: DataFrame, nugget: float, sill: float, reach: float) -> DataFrame:
    """id, estimate, sigma from each point's neighbours (id, lat, lon, slat, slon, value), as ``spatial.neighbours`` gives them.

    A point's neighbours, as few as its caller asks for, come as one row; points with equally many are solved at once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        metres = np.pi / 180 * 6_371_000.0
        for b in batches:
            sizes = b["samples"].map(len).to_numpy()
            out = np.zeros((len(b), 2))
            for n in np.unique(sizes):
                pick = np.flatnonzero(sizes == n)
                flat = np.array([[(s["slat"], s["slon"], s["value"]) for s in b["samples"].iloc[i]] for i in pick])
                lat, lon = (b[c].to_numpy()[pick][:, None] for c in ("lat", "lon"))
                xy = np.stack([(flat[:, :, 1] - lon) * metres * np.cos(np.radians(lat)), (flat[:, :, 0] - lat) * metres], axis=2)
                out[pick] = np.column_stack(fields.krige_many(xy, flat[:, :, 2], nugget, sill, reach))
            yield pd.DataFrame({"id": b["id"], "estimate": out[:, 0], "sigma": out[:, 1]})

    samples = F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in ("slat", "slon", "value")])).alias("samples")
    packed = near.groupBy("id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).agg(samples)
    return packed.mapInPandas(run, f"id {dict(near.dtypes)['id']}, estimate double, sigma double")


def reconstruction_errors(rows: DataFrame, id_: str, features: list[str], mean: np.ndarray, scale: np.ndarray, parts: np.ndarray) -> DataFrame:
    """id, error: how badly each row is rebuilt from the principal components. Pure column arithmetic."""
    z = [(F.col(c) - float(m)) / float(s) for c, m, s in zip(features, mean, scale, strict=True)]
    scores = [sum((zi * float(p) for zi, p in zip(z, row, strict=True)), F.lit(0.0)) for row in parts]
    back = [sum((sc * float(parts[k][i]) for k, sc in enumerate(scores)), F.lit(0.0)) for i in range(len(z))]
    return rows.select(
        F.col(id_).alias("id"), F.sqrt(sum(((zi - b) ** 2 for zi, b in zip(z, back, strict=True)), F.lit(0.0)) / len(z)).alias("error")
    )


def fit_components(rows: DataFrame, features: list[str], share: float = 0.9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and components from sums over all rows: what comes to the driver is one row of len(features)**2 numbers."""
    n = len(features)
    got = rows.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)],
        *[F.covar_pop(a, b).alias(f"c{i}_{j}") for i, a in enumerate(features) for j, b in enumerate(features) if j <= i]
    ).first()
    mean = np.array([got[f"m{i}"] for i in range(n)], float)
    cov = np.array([[got[f"c{max(i, j)}_{min(i, j)}"] for j in range(n)] for i in range(n)], float)
    scale = np.sqrt(np.where(np.diag(cov) > 0, np.diag(cov), 1.0))
    values, vectors = np.linalg.eigh(cov / np.outer(scale, scale))
    order = np.argsort(-values)
    run = np.cumsum(values[order]) / values.sum()
    return mean, scale, vectors[:, order[: int(np.searchsorted(run, share)) + 1]].T
