"""A kernel over grids: groups of cells."""

from __future__ import annotations

import numpy as np


def mask_components(mask: np.ndarray, bridge: int = 1) -> list[tuple[int, int, int, int, int]]:
    """Boxes (row0, row1, col0, col1, cells) of groups of cells that touch, diagonally too, after gaps along rows are bridged."""
    wide = mask.copy()
    for _ in range(bridge):
        wide[1:-1] |= wide[:-2] & wide[2:]
    label = np.zeros(mask.shape, int)
    parent = [0]

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for r, c in zip(*np.nonzero(wide), strict=True):
        near = {
            find(label[y, x]) for y, x in (
                (r - 1, c - 1), (r - 1, c), (r - 1, c + 1), (r, c - 1)
            ) if 0 <= y and 0 <= x < mask.shape[1] and label[y, x]
        }
        if not near:
            parent.append(len(parent))
            label[r, c] = len(parent) - 1
        else:
            label[r, c] = root = min(near)
            for n in near:
                parent[n] = root
    out: dict[int, list[int]] = {}
    for r, c in zip(*np.nonzero(wide), strict=True):
        b = out.setdefault(find(label[r, c]), [r, r, c, c, 0])
        b[0], b[1], b[2], b[3], b[4] = min(b[0], r), max(b[1], r), min(b[2], c), max(b[3], c), b[4] + int(mask[r, c])
    return sorted((a, b + 1, c, d + 1, n) for a, b, c, d, n in out.values())
