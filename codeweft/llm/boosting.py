"""Gradient-boosted trees for two classes, in arrays, over rows in memory or in blocks anywhere.

Values are put into at most BINS quantile bins a feature; trees grow level by level on histograms
of gradients and curvatures of the logistic loss over all rows. These are added as whole numbers, so
a sum is the same in any order and any split into blocks. Scoring walks all rows through a tree at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np

BINS, LAMBDA = 64, 1.0
#: A gradient or curvature counts in steps of 1 / UNIT.
UNIT = 1 << 20


class Block:
    """Binned rows with their labels, and the margins that the trees so far give them."""

    def __init__(self, binned: np.ndarray, y: np.ndarray) -> None:
        self.binned, self.y = np.asfortranarray(binned), y
        self.margin, self.grown = np.zeros(len(y)), 0

    def histograms(self, base: float, grown: list[tuple], feature: np.ndarray, cut: np.ndarray, level: int) -> np.ndarray:
        """Sums of gradients and curvatures, [2, node of the level, feature, bin], for a tree grown down to ``level``."""
        rows = np.arange(len(self.y))
        for f, c, leaf in grown[self.grown :]:
            self.margin += leaf[self._walk(rows, f, c, int(np.log2(len(leaf))))]
        self.grown = len(grown)
        prob = 1 / (1 + np.exp(-(self.margin + base)))
        g, h = np.rint((prob - self.y) * UNIT), np.rint(np.maximum(prob * (1 - prob), 1e-6) * UNIT)
        at = self._walk(rows, feature, cut, level) * BINS
        width, m = 2**level, self.binned.shape[1]
        out = np.zeros((2, width, m, BINS))
        for j in range(m):
            key = at + self.binned[:, j]
            for k, v in enumerate((g, h)):
                out[k, :, j] = np.bincount(key, v, width * BINS).reshape(width, BINS)
        return out

    def _walk(self, rows: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
        at = np.zeros(len(rows), dtype=np.int64)  # place within the level
        for level in range(depth):
            node = 2**level - 1 + at
            at = at * 2 + (self.binned[rows, feature[node]] > cut[node])
        return at


def in_memory(blocks: Iterable[Block]) -> Callable[..., np.ndarray]:
    """The sums of :meth:`Block.histograms` over blocks in memory."""
    kept = list(blocks)
    return lambda *tree: sum(b.histograms(*tree) for b in kept)


def bins(x: np.ndarray, limits: list[np.ndarray]) -> np.ndarray:
    """Bin b of a feature holds the values of at most limits[b]."""
    return np.stack([np.searchsorted(limits[j], x[:, j], "left") for j in range(x.shape[1])], axis=1).astype(np.uint8)


class Boosted:
    """Trees as arrays: the feature and limit of every inner node, the value of every leaf, in heap order."""

    def __init__(self, trees: int = 60, depth: int = 4, step: float = 0.2) -> None:
        self.trees, self.depth, self.step = trees, depth, step
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        limits = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        return self.boost(limits, float(y.mean()), in_memory([Block(bins(x, limits), y)]))

    def boost(self, limits: list[np.ndarray], mean: float, sums: Callable[..., np.ndarray]) -> Boosted:
        """Grows the trees from the mean label and from ``sums``, which adds Block.histograms over all rows."""
        p = np.clip(mean, 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        grown: list[tuple] = []
        for _ in range(self.trees):
            feature, cut, leaf = self._grow(limits, lambda *tree: sums(self.base, grown, *tree) / UNIT)
            grown.append((feature, cut, leaf))
            limit = np.array([limits[f][c] if c < BINS else np.inf for f, c in zip(feature, cut)])
            self.nodes.append((feature, limit, leaf))
        return self

    def _grow(self, limits: list[np.ndarray], sums: Callable[..., np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inner = 2**self.depth - 1
        feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, BINS, dtype=np.int64)  # no split: all to the left
        for level in range(self.depth):
            width = 2**level
            left = sums(feature, cut, level).cumsum(axis=3)
            whole = left[:, :, 0, -1]
            best = np.zeros(width)
            at = slice(width - 1, 2 * width - 1)
            for j, limit in enumerate(limits):
                if not len(limit):
                    continue
                (a, b), (sum_g, sum_h) = left[:, :, j, : len(limit)], whole[:, :, None]
                gain = a**2 / (b + LAMBDA) + (sum_g - a) ** 2 / (sum_h - b + LAMBDA) - sum_g**2 / (sum_h + LAMBDA)
                k = gain.argmax(axis=1)
                top = gain[np.arange(width), k]
                better = top > best + 1e-9
                best[better], cut[at][better], feature[at][better] = top[better], k[better], j
        # the leaves are the two sides of the last splits
        node = np.arange(width)
        low = np.where(cut[at] < BINS, left[:, node, feature[at], np.minimum(cut[at], BINS - 1)], whole)
        g, h = np.stack([low, whole - low], axis=2).reshape(2, -1)
        return feature, cut, -g / (h + LAMBDA) * self.step

    def _leaves(self, x: np.ndarray, feature: np.ndarray, limit: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        at = np.zeros(len(x), dtype=np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[rows, feature[at]] > limit[at])
        return leaf[at - (2**self.depth - 1)]

    def margins(self, x: np.ndarray) -> np.ndarray:
        """The log-odds that the trees give each row."""
        out = np.full(len(x), self.base)
        for feature, limit, leaf in self.nodes:
            out += self._leaves(x, feature, limit, leaf)
        return out
