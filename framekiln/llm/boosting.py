"""Small gradient boosted trees, grown from histograms that may be summed over a whole table."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

BINS = 32
# Gradients are summed in whole numbers of this unit, so that a sum does not depend on the order of its parts.
UNIT = 1 << 20


class Trees:
    """Boosted regression trees for the logistic loss, on quantile bins of the features."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 2.0) -> None:
        self.rounds, self.depth, self.rate, self.ridge = trees, depth, rate, ridge
        self.cuts: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(self.cuts)])

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        self.cuts = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) for i in range(x.shape[1])]
        return self.fit_binned(self.binned(x), y, np.ones(len(y), np.int64))

    def fit_binned(self, bins: np.ndarray, y: np.ndarray, times: np.ndarray) -> "Trees":
        """From rows held here, each with its number."""
        raw, done = None, 0

        def histograms(feature: np.ndarray, cut: np.ndarray, level: int) -> np.ndarray:
            nonlocal raw, done
            raw = np.full(len(bins), self.start) if raw is None else raw
            for tree in self.trees[done:]:
                raw += self._leaves(bins, tree)
            done = len(self.trees)
            return self._histogram(bins, y, times, raw, feature, cut, level)

        return self.grow(int(times.sum()), int(times[y > 0].sum()), histograms)

    def grow(self, size: int, ones: int, histograms: Callable[[np.ndarray, np.ndarray, int], np.ndarray]) -> "Trees":
        """From the sums of all rows: ``histograms`` gets the upper levels of the next tree and a level, as ``histogram`` below."""
        rate = (ones + 0.5) / (size + 1)
        self.start = float(np.log(rate / (1 - rate)))
        inner = (1 << self.depth) - 1
        for _ in range(self.rounds):
            feature, cut = np.zeros(inner, np.int64), np.full(inner, BINS, np.int64)  # a cut of BINS sends all rows left
            for level in range(self.depth):
                g, h = histograms(feature, cut, level) / UNIT
                first, count = (1 << level) - 1, 1 << level
                left_g, left_h = g.cumsum(2)[:, :, :-1], h.cumsum(2)[:, :, :-1]
                all_g, all_h = g.sum(2, keepdims=True), h.sum(2, keepdims=True)
                right_g, right_h = all_g - left_g, all_h - left_h
                gain = left_g**2 / (left_h + self.ridge) + right_g**2 / (right_h + self.ridge) - all_g**2 / (all_h + self.ridge)
                flat = gain.reshape(count, -1)
                at = flat.argmax(1)
                better = flat[np.arange(count), at] > 1e-6
                feature[first : first + count][better] = at[better] // BINS
                cut[first : first + count][better] = at[better] % BINS
            own, by = np.arange(count), feature[first:]
            g, h = (np.stack([s[own, by].cumsum(1)[own, cut[first:]], s[own, by].sum(1)], 1) for s in (g, h))
            g[:, 1] -= g[:, 0]
            h[:, 1] -= h[:, 0]
            self.trees.append((feature, cut, (self.rate * g / (h + self.ridge)).ravel()))
        return self

    def histogram(self, bins: np.ndarray, y: np.ndarray, times: np.ndarray, feature: np.ndarray, cut: np.ndarray, level: int) -> np.ndarray:
        """(2, nodes, features, BINS + 1): sums of gradients and of second derivatives of these rows, in units, at a level of the next tree."""
        return self._histogram(bins, y, times, self._raw(bins), feature, cut, level)

    def _histogram(self, bins, y, times, raw, feature, cut, level) -> np.ndarray:
        p = 1 / (1 + np.exp(-raw))
        own = self._node(bins, feature, cut, level)
        count, width = 1 << level, BINS + 1
        out = np.zeros((2, count, bins.shape[1], width), np.int64)
        for sums, value in zip(out, (y - p, p * (1 - p))):
            value = np.rint(value * UNIT) * times
            for i in range(bins.shape[1]):
                sums[:, i] = np.rint(np.bincount(own * width + bins[:, i], value, count * width)).reshape(count, width)
        return out

    def _node(self, bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
        rows, node = np.arange(len(bins)), np.zeros(len(bins), np.int64)
        for _ in range(levels):
            node = 2 * node + 1 + (bins[rows, feature[node]] > cut[node])
        return node - ((1 << levels) - 1)

    def _leaves(self, bins: np.ndarray, tree: tuple) -> np.ndarray:
        feature, cut, leaf = tree
        return leaf[self._node(bins, feature, cut, self.depth)]

    def _raw(self, bins: np.ndarray) -> np.ndarray:
        raw = np.full(len(bins), self.start)
        for tree in self.trees:
            raw += self._leaves(bins, tree)
        return raw

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        return self.predict_binned(self.binned(x)) if len(x) else np.zeros(0)

    def predict_binned(self, bins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self._raw(bins)))
