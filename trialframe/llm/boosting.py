"""Small gradient-boosted trees (logistic loss, numpy) over rows of any number.

The rows come as binned blocks, which may lie in the partitions of an RDD. A
level of a tree takes one pass: each block gives the sums of the gradients per
node, feature and bin, in whole steps of 1 / UNIT, so that the sums, and with
them the trees, do not depend on how the rows are dealt; only the added sums
reach the caller.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark import RDD

UNIT = 2.0**24


class Block(NamedTuple):
    """Rows: bins (a column for each feature), label, held for the calibration, how often."""

    bins: np.ndarray
    y: np.ndarray
    held: np.ndarray
    n: np.ndarray


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def over(blocks: RDD) -> Callable:
    """total(f) of the blocks of an RDD: the sum of f over them, 0 if there are none."""
    return lambda f: blocks.treeAggregate(0, lambda t, b: t + f(b), lambda a, b: a + b)


class Boosted:
    """Trees of depth ``depth`` on up to ``bins`` quantile bins, and a Platt
    calibration fitted on rows that the trees have not seen."""

    def __init__(self, trees: int = 40, depth: int = 3, bins: int = 16, rate: float = 0.2, ridge: float = 1.0):
        self.trees, self.depth, self.bins, self.rate, self.ridge = trees, depth, bins, rate, ridge
        self.edges: list[np.ndarray] = []
        # per tree: feature and cut of the inner nodes (in level order), value of the leaves
        self.features = np.zeros((0, 2**depth - 1), dtype=np.int64)
        self.cuts = np.zeros((0, 2**depth - 1), dtype=np.int64)
        self.values = np.zeros((0, 2**depth))
        self.start, self.slope, self.shift = 0.0, 1.0, 0.0

    def probs(self) -> np.ndarray:
        """The quantiles at which a feature is cut into bins."""
        return np.linspace(0, 1, self.bins + 1)[1:-1]

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)]).astype(np.uint8)

    def _down(self, b: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row in each tree, ``levels`` below the root."""
        trees, rows = np.arange(len(self.features)), np.arange(len(b))[:, None]
        at = np.zeros((len(b), len(trees)), dtype=np.int64)
        for _ in range(levels):
            at = 2 * at + 1 + (b[rows, self.features[trees, at]] > self.cuts[trees, at])
        return at

    def _raw(self, b: np.ndarray) -> np.ndarray:
        leaf = self._down(b, self.depth) - (2**self.depth - 1)
        return self.start + self.values[np.arange(len(self.values)), leaf].sum(axis=1)

    def _sums(self, grown: Boosted, level: int, every: bool) -> Callable[[Block], np.ndarray]:
        """Of a block: gradient and curvature per node of a level, feature and bin."""

        def sums(block: Block) -> np.ndarray:
            use = np.ones(len(block.y), bool) if every else ~block.held
            b, y, n = block.bins[use], block.y[use], block.n[use]
            p = _logistic(self._raw(b))
            steps = [np.rint((p - y) * UNIT) * n, np.rint(np.maximum(p * (1 - p), 1e-6) * UNIT) * n]
            node = grown._down(b, level)[:, 0] - (2**level - 1)
            size = 2**level * (self.bins + 1)
            bars = [[np.bincount(node * (self.bins + 1) + b[:, k], weights=w, minlength=size) for k in range(b.shape[1])] for w in steps]
            return np.array(bars).astype(np.int64).reshape(2, b.shape[1], 2**level, self.bins + 1)

        return sums

    def _tree(self, total: Callable, every: bool) -> Boosted:
        """One more tree, alone, a pass for each of its levels."""
        t = Boosted(1, self.depth, self.bins, self.rate, self.ridge)
        t.features, t.cuts = np.zeros((1, 2**self.depth - 1), dtype=np.int64), np.full((1, 2**self.depth - 1), 255)
        t.values = np.zeros((1, 2**self.depth))
        for level in range(self.depth):
            first = 2**level - 1
            all_g, all_h = total(self._sums(t, level, every)) / UNIT
            for i in range(2**level):
                gs, hs = np.cumsum(all_g[:, i], axis=1), np.cumsum(all_h[:, i], axis=1)
                g, h = gs[0, -1], hs[0, -1]
                gain = gs**2 / (hs + self.ridge) + (g - gs) ** 2 / (h - hs + self.ridge) - g**2 / (h + self.ridge)
                best = gain[:, :-1].max(axis=1)
                k = int(best.argmax())
                left = (g, h)
                if best[k] > 1e-6:
                    at = int(gain[k, :-1].argmax())
                    t.features[0, first + i], t.cuts[0, first + i] = k, at
                    left = (gs[k, at], hs[k, at])
                if level == self.depth - 1:
                    t.values[0, 2 * i] = -self.rate * left[0] / (left[1] + self.ridge)
                    t.values[0, 2 * i + 1] = -self.rate * (g - left[0]) / (h - left[1] + self.ridge)
        return t

    def _calibrated(self, total: Callable) -> None:
        """Newton steps of the two calibration parameters on the held rows, halved while they do not improve."""
        now, step, best = np.array([1.0, 0.0]), np.zeros(2), np.inf
        for _ in range(200):

            def sums(block: Block) -> np.ndarray:
                b, v, n = block.bins[block.held], block.y[block.held], block.n[block.held]
                r = self._raw(b)
                z = (now - step)[0] * r + (now - step)[1]
                p = _logistic(z)
                s = p * (1 - p) * n
                loss = np.logaddexp(0, np.where(v > 0, -z, z)) * n
                return np.array([((p - v) * r * n).sum(), ((p - v) * n).sum(), (s * r * r).sum(), (s * r).sum(), s.sum(), loss.sum()])

            a, b, rr, r1, one, loss = total(sums)
            loss += 0.5 * ((now - step)[0] - 1) ** 2 + 0.05 * (now - step)[1] ** 2
            if loss > best and np.abs(step).max() >= 1e-9:
                step = step / 2
                continue
            now, best = now - step, loss
            g = np.array([a + now[0] - 1, b + 0.1 * now[1]])
            step = np.linalg.solve(np.array([[rr + 1, r1], [r1, one + 0.1]]), g)
            if np.abs(step).max() < 1e-9:
                break
        self.slope, self.shift = round(float(now[0]), 8), round(float(now[1]), 8)

    @staticmethod
    def fits_every(held: np.ndarray, y: np.ndarray, n: np.ndarray) -> bool:
        """Whether the rows that are not held lack a label, so that the trees take all rows."""
        return not all(n[~held & (y == label)].sum() for label in (0, 1))

    def fit_blocks(self, edges: list[np.ndarray], total: Callable) -> Boosted:
        """total(f): the sum of f over the blocks of all rows, binned at ``edges``."""
        counts = total(lambda b: np.bincount(2 * b.held + b.y.astype(np.int64), weights=b.n, minlength=4))
        counts = np.zeros(4) + counts
        if not counts[[0, 2]].sum() or not counts[[1, 3]].sum():
            self.start, self.edges = (0.0 if not counts.sum() else (8.0 if counts[[1, 3]].sum() else -8.0)), []
            return self
        every = not counts[0] or not counts[1]
        used = counts[:2] + counts[2:] if every else counts[:2]
        mean = used[1] / used.sum()
        self.edges, self.start = edges, float(np.log((mean + 1e-6) / (1 - mean + 1e-6)))
        for _ in range(self.trees):
            t = self._tree(total, every)
            self.features, self.cuts, self.values = (np.r_[a, b] for a, b in ((self.features, t.features), (self.cuts, t.cuts), (self.values, t.values)))
        if counts[2:].sum() >= 20 and counts[2] and counts[3]:
            self._calibrated(total)
        return self

    def fit(self, x: np.ndarray, y: np.ndarray, held: np.ndarray) -> Boosted:
        """Rows at hand. held: rows kept for the calibration."""
        y, n = np.asarray(y, dtype=float), np.ones(len(y), dtype=np.int64)
        held = np.asarray(held, dtype=bool)
        t = x if self.fits_every(held, y, n) else x[~held]
        if not len(t):
            return self.fit_blocks([], lambda f: 0)
        self.edges = [np.unique(np.quantile(t[:, k], self.probs())) for k in range(x.shape[1])]
        block = Block(self.binned(x), y, held, n)
        return self.fit_blocks(self.edges, lambda f: f(block))

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not self.edges:
            return _logistic(np.full(len(x), self.start))
        return _logistic(self.slope * self._raw(self.binned(x)) + self.shift)
