"""Hashed character n-grams of texts, vectorised."""

from __future__ import annotations

import numpy as np

_MULTIPLIER = np.uint32(0x9E3779B1)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def buckets(points: np.ndarray, n: int, bits: int) -> np.ndarray:
    """A bucket for each n-gram; different lengths get different buckets for the same leading text."""
    count = len(points) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint32)
    h = points[:count] + np.uint32(n * 0x85EB)
    for i in range(1, n):
        h = (h * np.uint32(0x01000193)) ^ points[i : i + count]
    h = h * _MULTIPLIER
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - bits)
