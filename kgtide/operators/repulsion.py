"""How all nodes of a layout push each other, without comparing all pairs.

The push of a node at z by one at w is 1 / conj(z - w), but for pairs closer than
``NEAR``.  Cells of at least that size are halved from the box around all nodes;
cells that don't touch act on each other by series of ``TERMS`` terms (the fast
multipole method), nodes of touching cells by pairs.  The series are as exact as
sums of doubles are: what they leave out is below 1e-12 of the push.
"""

from __future__ import annotations

from functools import cache
from math import comb

import numpy as np

#: The distance from which on nodes push by the inverse distance; terms of a series;
#: nodes a cell has at least on average; levels of cells at most; pairs worked on at
#: once, which stay in the processor's cache.
NEAR, TERMS, CELL, LEVELS, CHUNK = 0.01, 44, 16, 24, 32_768
QUARTERS = [(x, y) for x in (0, 1) for y in (0, 1)]
APART = [(x, y) for x in range(-3, 4) for y in range(-3, 4) if max(abs(x), abs(y)) > 1]


@cache
def _series() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matrices that move a quarter's series to its cell, a cell's to a quarter, and a
    cell's to another one, by the places in ``QUARTERS`` and ``APART``."""
    t = range(TERMS)
    up, down = np.zeros((2, 4, TERMS, TERMS), complex)
    for q, (x, y) in enumerate(QUARTERS):
        d = complex(x - 0.5, y - 0.5) / 2
        for m in t:
            for k in range(m + 1):
                up[q, k, m] = comb(m, k) * d ** (m - k) / 2**k
                down[q, m, k] = comb(m, k) * d ** (m - k) / 2 ** (k + 1)
    across = np.array([[[(-1) ** k * comb(m + k, k) / complex(-x, -y) ** (m + k + 1) for k in t] for m in t] for x, y in APART])
    return up, down, across


def _levels(ix: np.ndarray, iy: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By level, from the whole box on: cells with nodes by column and row, and the
    place of each among the cells of the level above."""
    out = []
    for level in range(depth, -1, -1):
        codes, back = np.unique(ix << level | iy, return_inverse=True)
        if out:
            out[-1] = (*out[-1][:2], back)
        ix, iy = codes >> level, codes & ((1 << level) - 1)
        out.append((ix, iy, back))
        ix, iy = ix >> 1, iy >> 1
    return out[::-1]


def _found(codes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
    return at, codes[at] == wanted


def pushed(pos: np.ndarray, first: int, last: int, k: float) -> np.ndarray:
    """How all nodes push those from ``first`` up to ``last``."""
    n, low = len(pos), pos.min(0)
    least, size = NEAR * (1 + 1e-9), float((pos.max(0) - low).max()) * (1 + 1e-9)
    depth = max(0, int(np.ceil(np.log2(max(size, least) / least))))
    size, depth = (least * 2**depth, depth) if depth <= LEVELS else (size, LEVELS)
    grid = np.minimum(((pos - low) / size * (1 << depth)).astype(np.int64), (1 << depth) - 1)
    while depth and len(np.unique(grid[:, 0] << depth | grid[:, 1])) * CELL > n:
        grid, depth = grid >> 1, depth - 1
    order = np.argsort(grid[:, 0] << depth | grid[:, 1], kind="stable")
    x, y = pos[order, 0], pos[order, 1]
    levels = _levels(grid[order, 0], grid[order, 1], depth)
    cx, cy, cell = levels[depth][0], levels[depth][1], np.unique(grid[order, 0] << depth | grid[order, 1], return_inverse=True)[1]
    begin = np.searchsorted(cell, np.arange(len(cx) + 1))
    width = size / (1 << depth)
    z = ((x - low[0]) / width - cx[cell] - 0.5) + 1j * ((y - low[1]) / width - cy[cell] - 0.5)
    own = np.flatnonzero((order >= first) & (order < last))
    total = _far(levels, z, begin, cell, own) / width
    out = np.stack([total.real, -total.imag], axis=1)
    _near(out, x, y, cx, cy, begin, own, depth)
    back = np.empty((last - first, 2))
    back[order[own] - first] = out * (k * k)
    return back


def _far(levels: list, z: np.ndarray, begin: np.ndarray, cell: np.ndarray, own: np.ndarray) -> np.ndarray:
    """What cells that don't touch theirs add to own nodes, in cells' widths; ``z`` are
    places from their cells' centres."""
    up, down, across = _series()
    depth = len(levels) - 1
    sums = np.empty((len(begin) - 1, TERMS), complex)
    power = np.ones(len(z), complex)
    for m in range(TERMS):
        sums[:, m] = np.add.reduceat(power, begin[:-1])
        power = power * z
    outer = [sums]
    for level in range(depth, 2, -1):
        ix, iy, parent = levels[level]
        sums = np.zeros((len(levels[level - 1][0]), TERMS), complex)
        for q, (a, b) in enumerate(QUARTERS):
            some = np.flatnonzero((ix & 1 == a) & (iy & 1 == b))
            sums[parent[some]] += outer[-1][some] @ up[q]
        outer.append(sums)
    inner = np.zeros((len(levels[min(depth, 1)][0]), TERMS), complex)
    for level in range(2, depth + 1):
        ix, iy, parent = levels[level]
        sums, above, inner = outer[depth - level], inner, np.zeros((len(ix), TERMS), complex)
        for q, (a, b) in enumerate(QUARTERS):
            some = np.flatnonzero((ix & 1 == a) & (iy & 1 == b))
            inner[some] = above[parent[some]] @ down[q]
        codes, top = ix << level | iy, 1 << level
        for (a, b), matrix in zip(APART, across, strict=True):
            jx, jy = ix + a, iy + b
            some = np.flatnonzero((abs((jx >> 1) - (ix >> 1)) < 2) & (abs((jy >> 1) - (iy >> 1)) < 2) & (jx >= 0) & (jy >= 0) & (jx < top) & (jy < top))
            at, there = _found(codes, jx[some] << level | jy[some])
            if there.any():
                inner[some[there]] += sums[at[there]] @ matrix
    total = np.zeros((2, len(own)))
    if depth >= 2:
        here, (re, im) = cell[own], (z[own].real.copy(), z[own].imag.copy())
        for m in range(TERMS - 1, -1, -1):  # by real numbers, which round alike wherever they stand
            total = np.stack([total[0] * re - total[1] * im, total[0] * im + total[1] * re])
            total += np.stack([inner[here, m].real, inner[here, m].imag])
    return total[0] + 1j * total[1]


def _near(out: np.ndarray, x: np.ndarray, y: np.ndarray, cx: np.ndarray, cy: np.ndarray, begin: np.ndarray, own: np.ndarray, depth: int) -> None:
    """Adds what nodes of touching cells and of the same add to own nodes.  Three cells
    of a column follow each other."""
    codes, top = cx << depth | cy, (1 << depth) - 1
    spans = []
    for a in (-1, 0, 1):
        column = np.clip(cx + a, 0, top) << depth
        lo, hi = (np.searchsorted(codes, column | np.maximum(cy - 1, 0)), np.searchsorted(codes, column | np.minimum(cy + 1, top), "right"))
        inside = (cx + a >= 0) & (cx + a <= top)
        spans.append((begin[lo], np.where(inside, begin[hi], begin[lo])))
    bounds, most = np.searchsorted(own, begin), max(CHUNK, max((sum(hi - lo for lo, hi in spans)), default=0))
    work = np.empty((4, most))
    for c in np.flatnonzero(np.diff(bounds)):
        mine = own[bounds[c] : bounds[c + 1]]
        sx, sy = (np.concatenate([v[lo[c] : hi[c]] for lo, hi in spans]) for v in (x, y))
        rows = max(1, CHUNK // len(sx))
        for at in range(0, len(mine), rows):
            some = mine[at : at + rows]
            u, v, w, z = work[:, : len(some) * len(sx)].reshape(4, len(some), len(sx))
            np.subtract(x[some, None], sx, out=u)
            np.subtract(y[some, None], sy, out=v)
            np.multiply(u, u, out=w)
            np.multiply(v, v, out=z)
            w += z
            np.divide(1, np.maximum(w, NEAR * NEAR, out=w), out=w)
            to = slice(bounds[c] + at, bounds[c] + at + len(some))
            out[to, 0] += np.einsum("ij,ij->i", u, w)
            out[to, 1] += np.einsum("ij,ij->i", v, w)
