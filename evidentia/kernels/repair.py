"""Repair kernels: gap filling, smoothing of tracks, alignment of words, assignment."""

from __future__ import annotations

import math
import re
import unicodedata

import numpy as np


def burg(x: np.ndarray, order: int) -> np.ndarray:
    """Autoregressive coefficients a with a[0] = 1 by Burg's recursion."""
    f, b = x[1:].copy(), x[:-1].copy()
    a = np.array([1.0], x.dtype)
    for _ in range(order):
        den = np.vdot(f, f).real + np.vdot(b, b).real
        k = -2 * np.vdot(b, f) / den if den > 0 else 0.0
        a = np.concatenate([a, [0]]) + k * np.concatenate([[0], a[::-1].conj()])
        f, b = (f + k * b)[1:], (b + np.conj(k) * f)[:-1]
        if not len(f):
            break
    return a


def extrapolate(x: np.ndarray, a: np.ndarray, n: int) -> np.ndarray:
    out = list(x[-(len(a) - 1) :]) if len(a) > 1 else []
    for _ in range(n):
        out.append(-np.dot(a[1:], np.array(out[-1 : -len(a) : -1])) if len(a) > 1 else 0)
    return np.array(out[len(out) - n :])


def fill_linear(x: np.ndarray, begin: int, end: int) -> np.ndarray:
    out = x.copy()
    left = x[begin - 1] if begin else x[end] if end < len(x) else 0
    right = x[end] if end < len(x) else left
    t = np.arange(1, end - begin + 1) / (end - begin + 1)
    out[begin:end] = left * (1 - t) + right * t
    return out


def fill_both_ways(x: np.ndarray, begin: int, end: int, order: int = 16, context: int = 512) -> np.ndarray:
    """Predict the gap from both sides and fade from one to the other."""
    n, out = end - begin, x.copy()
    before, after = x[max(0, begin - context) : begin], x[end : end + context][::-1]
    if min(len(before), len(after)) <= 2 * order:
        return fill_linear(x, begin, end)
    ahead = extrapolate(before, burg(before, order), n)
    back = extrapolate(after, burg(after, order), n)[::-1]
    t = (np.arange(n) + 1) / (n + 1)
    fade = np.cos(np.pi * t / 2) ** 2
    out[begin:end] = ahead * fade + back * (1 - fade)
    return out


def kalman_smooth(t: np.ndarray, z: np.ndarray, sigma: np.ndarray, q: float, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Constant-velocity filter and smoother of one coordinate: positions and deviations at ``at``, log likelihood.

    Times without a measurement are predicted; accelerations are white with density q.
    """
    at = t if at is None else at
    every = np.union1d(t, at)
    have = {float(a): (b, c) for a, b, c in zip(t, z, sigma, strict=True)}
    x, p = np.array([z[0], 0.0]), np.diag([sigma[0] ** 2 * 4, 1e4])
    states, loglik, before = [], 0.0, every[0]
    for now in every:
        d = now - before
        a = np.array([[1, d], [0, 1]])
        noise = q * np.array([[d**3 / 3, d**2 / 2], [d**2 / 2, d]])
        xp, pp = a @ x, a @ p @ a.T + noise
        x, p = xp, pp
        if float(now) in have:
            m, s = have[float(now)]
            v = pp[0, 0] + s**2
            gain = pp[:, 0] / v
            x, p = xp + gain * (m - xp[0]), pp - np.outer(gain, pp[0])
            loglik -= 0.5 * (math.log(2 * math.pi * v) + (m - xp[0]) ** 2 / v)
        states.append((x, p, xp, pp, a))
        before = now
    out = [None] * len(states)
    xs, ps = states[-1][0], states[-1][1]
    out[-1] = (xs, ps)
    for k in range(len(states) - 2, -1, -1):
        x, p, _, _, _ = states[k]
        _, _, xp, pp, a = states[k + 1]
        g = p @ a.T @ np.linalg.pinv(pp)
        xs, ps = x + g @ (xs - xp), p + g @ (ps - pp) @ g.T
        out[k] = (xs, ps)
    pick = np.searchsorted(every, at)
    return np.array([out[i][0][0] for i in pick]), np.array([math.sqrt(max(out[i][1][0, 0], 0)) for i in pick]), loglik


def best_noise(t: np.ndarray, z: np.ndarray, sigma: np.ndarray) -> float:
    """The process noise of greatest likelihood on a grid of powers of ten."""
    grid = 10.0 ** np.linspace(-4, 3, 15)
    return float(max(grid, key=lambda q: kalman_smooth(t, z, sigma, q)[2]))


def normalised(text: str) -> str:
    text = unicodedata.normalize("NFKC", text or "").casefold().replace("’", "'")
    text = re.sub(r"[-‐-―]", " ", text)
    return " ".join(re.sub(r"(?<!\w)'|'(?!\w)|[^\w\s']", " ", text).split())


def align_words(a: list[str], b: list[str]) -> tuple[int, int, int, int]:
    """Substitutions, deletions, insertions, hits of the shortest edit from a to b; the diagonal wins ties."""
    n, m = len(a), len(b)
    cost = np.zeros((n + 1, m + 1), np.int32)
    cost[:, 0], cost[0] = np.arange(n + 1), np.arange(m + 1)
    for i in range(1, n + 1):
        ai, row, up = a[i - 1], cost[i], cost[i - 1]
        for j in range(1, m + 1):
            row[j] = min(up[j - 1] + (ai != b[j - 1]), up[j] + 1, row[j - 1] + 1)
    i, j, s, d, ins, hit = n, m, 0, 0, 0, 0
    while i or j:
        if i and j and cost[i, j] == cost[i - 1, j - 1] + (a[i - 1] != b[j - 1]):
            s, hit = s + (a[i - 1] != b[j - 1]), hit + (a[i - 1] == b[j - 1])
            i, j = i - 1, j - 1
        elif i and cost[i, j] == cost[i - 1, j] + 1:
            d, i = d + 1, i - 1
        else:
            ins, j = ins + 1, j - 1
    return s, d, ins, hit


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows and columns with the least total cost; infinite costs are never paired. Shortest augmenting paths."""
    n, m = cost.shape
    if not n or not m:
        return []
    if n > m:
        return sorted((i, j) for j, i in assign(cost.T))
    big = (np.abs(cost[np.isfinite(cost)]).sum() + 1) * 4 if np.isfinite(cost).any() else 1.0
    c = np.where(np.isfinite(cost), cost, big)
    u, v, owner, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = owner[j0]
            free = np.flatnonzero(~used[1:]) + 1
            now = c[i0 - 1, free - 1] - u[i0] - v[free]
            better = now < least[free]
            least[free[better]], way[free[better]] = now[better], j0
            j1 = free[np.argmin(least[free])]
            delta = least[j1]
            u[owner[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    return sorted((int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j] and np.isfinite(cost[owner[j] - 1, j - 1]))


def deinterleave(toa: np.ndarray, least: int = 6, tolerance: float = 0.02, lags: int = 8) -> list[tuple[float, np.ndarray]]:
    """Split pulse times into trains of constant interval, longest first: interval and pulse numbers.

    Candidate intervals are the commonest differences over a few lags; the train that takes most pulses is
    removed and the search starts anew. An interval is dropped for the one it is a multiple of.
    """
    left, out = np.arange(len(toa)), []
    while len(left) >= least:
        t = toa[left]
        d = np.concatenate([t[k:] - t[:-k] for k in range(1, min(lags, len(t) - 1) + 1)])
        d = d[d > 0]
        if not len(d):
            break
        cell = np.round(np.log(d) / tolerance).astype(int)
        values, counts = np.unique(cell, return_counts=True)
        best: tuple[float, np.ndarray] | None = None
        for v in values[np.argsort(-counts, kind="stable")][:12]:
            pri = float(np.median(d[cell == v]))
            train = _longest_train(t, pri, tolerance)
            if len(train) >= least and (best is None or len(train) > len(best[1]) * 1.05 or (len(train) >= len(best[1]) and pri < best[0])):
                best = (pri, train)
        if best is None:
            break
        own = left[best[1]]
        out.append((float(np.median(np.diff(toa[own]) / np.maximum(np.round(np.diff(toa[own]) / best[0]), 1))), own))
        left = np.setdiff1d(left, own)
    return out


def _longest_train(t: np.ndarray, pri: float, tolerance: float, misses: int = 2) -> np.ndarray:
    """The longest chain of pulses an interval apart, up to so many missing in a row."""
    length, back = np.ones(len(t), int), np.full(len(t), -1)
    for k in range(1, misses + 2):
        j = np.searchsorted(t, t - k * pri - tolerance * pri)
        for i in np.flatnonzero(j < np.arange(len(t))):
            if abs(t[i] - t[j[i]] - k * pri) <= tolerance * pri and length[j[i]] + 1 > length[i]:
                length[i], back[i] = length[j[i]] + 1, j[i]
    i, out = int(np.argmax(length)), []
    while i >= 0:
        out.append(i)
        i = back[i]
    return np.array(out[::-1])


def missing_pulses(toa: np.ndarray, pri: float) -> np.ndarray:
    """Times at which a train should have had pulses and has none."""
    out = []
    for a, b in zip(toa, toa[1:], strict=False):
        n = round((b - a) / pri)
        out += [a + (b - a) * k / n for k in range(1, n)] if n > 1 else []
    return np.array(out)
