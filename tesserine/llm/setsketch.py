"""SetSketch registers: exponentially spaced, truncated minima.

A register is ``floor(1 - log_B(x))``, truncated to 16 bits, of the least ``x`` of an exponential variable over a set's elements. Registers of a union are the larger of two
registers, so sketches merge in any order; two registers are equal with about the Jaccard similarity of the sets.
"""

from __future__ import annotations

import numpy as np

BASE, RATE, TOP = 1.001, 20.0, 65535


def _seeds(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20240229))
    a, b = (rng.integers(0, 1 << 32, 4096, np.uint64).astype(np.uint32) | np.uint32(1) for _ in range(2))
    return a[:count], b[:count]


def minima(elements: np.ndarray, at: np.ndarray, count: int) -> np.ndarray:
    """Least hash of each of ``count`` functions over elements[at[i]:at[i + 1]]: rows x count of 32 bits, all ones for an empty set."""
    a, b = _seeds(count)
    low, high = (elements & np.uint64(0xFFFFFFFF)).astype(np.uint32), (elements >> np.uint64(32)).astype(np.uint32)
    out = np.full((len(at) - 1, count), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(at))
    if not len(full):
        return out
    step = 1 << 15  # parts that stay in a core's cache; a set may go over several
    edges = at[:-1][full]
    for begin in range(0, len(elements), step):
        end = min(begin + step, len(elements))
        i, j = np.searchsorted(edges, begin, "right") - 1, np.searchsorted(edges, end, "left")
        cuts, rows = np.maximum(edges[i:j], begin) - begin, full[i:j]
        lo, hi = low[begin:end], high[begin:end]
        got = np.empty((count, len(cuts)), np.uint32)
        x, y = np.empty_like(lo), np.empty_like(lo)
        for k in range(count):
            np.multiply(lo, a[k], out=x)
            np.multiply(hi, b[k], out=y)
            np.add(x, y, out=x)
            np.minimum.reduceat(x, cuts, out=got[k])
        out[rows] = np.minimum(out[rows], got.T)
    return out


def registers(least: np.ndarray) -> np.ndarray:
    """16-bit registers of the minima."""
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype(np.uint16)


def likely(more: np.ndarray, less: np.ndarray, count: int, n_a: np.ndarray, n_b: np.ndarray, least: float, doubt: float) -> np.ndarray:
    """Whether sets of n_a and n_b elements, with so many registers of a above and below those of b, may have a Jaccard similarity of ``least``: by the joint
    likelihood of both counts, similarity ``least`` or above is at most exp(``doubt``) times less likely than the best."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    most = np.minimum(u / v, v / u)

    def log_likelihood(j):
        p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
        up, down = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        return more * np.log(np.maximum(up, tiny)) + less * np.log(np.maximum(down, tiny)) + (count - more - less) * np.log(np.maximum(1 - up - down, tiny))

    grid = [log_likelihood(np.minimum(j, most)) for j in np.linspace(0.02, 1, 50)]
    above = np.max([g for g, j in zip(grid, np.linspace(0.02, 1, 50), strict=True) if j >= least - 1e-9], axis=0)
    return (most >= least - 1e-9) & (above >= np.max(grid, axis=0) - doubt)
