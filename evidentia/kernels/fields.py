"""Kernels of fields: variogram fits and kriging."""

from __future__ import annotations

import math

import numpy as np


def model(h: np.ndarray, nugget: float, sill: float, reach: float) -> np.ndarray:
    """Exponential variogram; 95 per cent of the sill at ``reach``."""
    return np.where(h > 0, nugget + sill * (1 - np.exp(-3 * h / reach)), 0.0)


def fit_variogram(lags: np.ndarray, semi: np.ndarray, pairs: np.ndarray) -> tuple[float, float, float]:
    """Nugget, sill and reach by weighted least squares; for each reach of a grid the others are linear and not negative."""
    best = (math.inf, 0.0, 0.0, 1.0)
    for reach in lags.max() * np.geomspace(0.1, 5, 60):
        a = np.column_stack([np.ones(len(lags)), 1 - np.exp(-3 * lags / reach)])
        w = np.sqrt(pairs)
        x = np.linalg.lstsq(a * w[:, None], semi * w, rcond=None)[0]
        if x[0] < 0:
            x = np.array([0.0, (pairs * a[:, 1] * semi).sum() / (pairs * a[:, 1] ** 2).sum()])
        if x[1] < 0:
            x = np.array([(pairs * semi).sum() / pairs.sum(), 0.0])
        err = float((pairs * (a @ x - semi) ** 2).sum())
        if err < best[0]:
            best = (err, float(x[0]), float(x[1]), float(reach))
    return best[1:]


def krige(xy: np.ndarray, z: np.ndarray, at: np.ndarray, nugget: float, sill: float, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Ordinary kriging from a neighbourhood: estimates and deviations."""
    n = len(z)
    d = np.linalg.norm(xy[:, None] - xy[None], axis=2)
    k = np.ones((n + 1, n + 1))
    k[:n, :n], k[n, n] = model(d, nugget, sill, reach), 0
    r = np.ones((n + 1, len(at)))
    r[:n] = model(np.linalg.norm(xy[:, None] - at[None], axis=2), nugget, sill, reach)
    w = np.linalg.lstsq(k, r, rcond=None)[0]
    return w[:n].T @ z, np.sqrt(np.maximum((w * r).sum(axis=0), 0))


def krige_many(xy: np.ndarray, z: np.ndarray, nugget: float, sill: float, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Ordinary kriging at the origin of each of many neighbourhoods of one size: places (many, n, 2), values (many, n)."""
    many, n = z.shape
    k = np.ones((many, n + 1, n + 1))
    k[:, :n, :n], k[:, n, n] = model(np.linalg.norm(xy[:, :, None] - xy[:, None], axis=3), nugget, sill, reach), 0
    r = np.ones((many, n + 1, 1))
    r[:, :n, 0] = model(np.linalg.norm(xy, axis=2), nugget, sill, reach)
    w = np.linalg.pinv(k) @ r
    return (w[:, :n, 0] * z).sum(axis=1), np.sqrt(np.maximum((w * r).sum(axis=(1, 2)), 0))
