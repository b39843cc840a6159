"""Signal kernels on complex NumPy arrays: spectra and the band that holds most of the power."""

from __future__ import annotations

import math

import numpy as np


def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def frames(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Overlapping frames as a view; what doesn't fill a frame is left out."""
    if len(x) < size:
        return np.zeros((0, size), x.dtype)
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop]


def spectrogram(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Power of each frame and bin, zero frequency in the middle; a full-scale tone has power 1."""
    w = hann(size)
    return np.abs(np.fft.fftshift(np.fft.fft(frames(x, size, hop) * w, axis=1), axes=1)) ** 2 / w.sum() ** 2


def psd(x: np.ndarray, fs: float, size: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Welch density with half-overlapped frames: frequencies and power per hertz."""
    size = min(size, len(x))
    w = hann(size)
    p = (np.abs(np.fft.fft(frames(x, size, max(size // 2, 1)) * w, axis=1)) ** 2).mean(axis=0) / (fs * (w**2).sum())
    return np.fft.fftshift(np.fft.fftfreq(size, 1 / fs)), np.fft.fftshift(p)


def occupied_band(x: np.ndarray, fs: float, share: float = 0.99, size: int = 1024) -> tuple[float, float]:
    """Edges of the band that holds the share of power above the median floor."""
    f, p = psd(x, fs, size)
    p = np.maximum(p - np.median(p), 0)
    if p.sum() <= 0:
        return math.nan, math.nan
    run = np.cumsum(p) / p.sum()
    return float(f[np.searchsorted(run, (1 - share) / 2)]), float(f[min(np.searchsorted(run, (1 + share) / 2), len(f) - 1)])
