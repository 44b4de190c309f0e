"""Sketches of sets of 64-bit run hashes, for many sets at once."""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

_ODD = np.uint64(0xD6E8FEB86659FD93)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class OnePermutation:
    """One-permutation min-hash: the least hash of each of ``bins`` equal ranges.

    An empty bin borrows from the first filled one of its own fixed probe order,
    so equal sets have equal sketches and bins agree as often as the sets do.
    """

    def __init__(self, bins: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.bins = bins
        self.probes = np.stack([rng.permutation(bins) for _ in range(bins)])
        self.edges = np.array([-(-(b << 64) // bins) for b in range(bins)], dtype=np.uint64)
        self.upper = np.append(self.edges[1:], np.uint64(0xFFFFFFFFFFFFFFFF))

    def least(self, runs: list[np.ndarray]) -> np.ndarray:
        """Sketches (sets x bins) of non-empty, sorted sets."""
        least = np.empty((len(runs), self.bins), np.uint64)
        empty = np.empty((len(runs), self.bins), bool)
        for i, h in enumerate(runs):
            at = np.searchsorted(h, self.edges)
            v = h[np.minimum(at, len(h) - 1)]
            empty[i] = (at == len(h)) | (v >= self.upper)
            least[i] = v
        full, missing = ~empty, empty.copy()
        for t in range(self.bins):
            if not missing.any():
                break
            src = self.probes[:, t]
            rows, cols = np.nonzero(missing & full[:, src])
            least[rows, cols] = least[rows, src[cols]] + _STEP * (cols.astype(np.uint64) + np.uint64(1))
            missing[rows, cols] = False
        return least

    def bands(self, runs: list[np.ndarray], rows: int) -> np.ndarray:
        """Keys (sets x bins/rows) of successive groups of ``rows`` bins."""
        least = self.least(runs).reshape(len(runs), self.bins // rows, rows)
        key = np.arange(self.bins // rows, dtype=np.uint64)[None, :] * _ODD
        for r in range(rows):
            key = (key ^ least[:, :, r]) * _ODD
            key ^= key >> np.uint64(29)
        return key

    def bits(self, runs: list[np.ndarray]) -> np.ndarray:
        """One bit of each bin, packed (sets x bins/64): a fraction (1 - similarity) / 2 of them differs."""
        least = self.least(runs) * _ODD
        least ^= least >> np.uint64(32)
        return np.packbits((least & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little").view(np.uint64)


def distinct_sorted(h: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    h = np.sort(h)
    return h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) else h


def winnowed(h: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least hash of every ``window`` successive ones (the leftmost of equals).

    Any stretch of ``window`` successive hashes that two texts share yields a
    position selected in both.
    """
    if len(h) <= window:
        return np.array([int(h.argmin())], np.intp) if len(h) else np.empty(0, np.intp)
    view = sliding_window_view(h, window)
    at = view.argmin(axis=1) + np.arange(len(view))
    return at[np.concatenate(([True], at[1:] != at[:-1]))]
