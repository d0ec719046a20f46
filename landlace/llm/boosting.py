"""Gradient-boosted trees for a logistic loss, small enough to train on the driver and to score in arrays."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Trees of fixed depth over binned features; node k has the children 2k+1 and 2k+2."""

    depth: int = 3
    trees: int = 60
    rate: float = 0.2
    ridge: float = 1.0
    bins: int = 32
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # feature, bin, leaf values

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1) if len(self.edges) else np.zeros((len(x), 0), int)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Boosted:
        weight = np.ones(len(y)) if weight is None else weight
        self.edges = [np.unique(np.quantile(np.unique(c), np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b, features = self.binned(x), x.shape[1]
        mean = np.clip(np.average(y, weights=weight), 1e-4, 1 - 1e-4)
        self.base, self.nodes = float(np.log(mean / (1 - mean))), []
        f = np.full(len(y), self.base)
        inner = (1 << self.depth) - 1
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
            feat, cut, at = np.zeros(inner, int), np.full(inner, self.bins), np.zeros(len(y), int)
            for level in range(self.depth):
                first, n = (1 << level) - 1, 1 << level
                own = at - first
                best = np.zeros(n)
                for j in range(features):
                    key = own * (self.bins + 1) + b[:, j]
                    gs = np.cumsum(np.bincount(key, g, n * (self.bins + 1)).reshape(n, -1), 1)
                    hs = np.cumsum(np.bincount(key, h, n * (self.bins + 1)).reshape(n, -1), 1)
                    gain = gs**2 / (hs + self.ridge) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + self.ridge) - gs[:, -1:] ** 2 / (hs[:, -1:] + self.ridge)
                    top = gain[:, :-1].argmax(1)
                    better = (now := gain[np.arange(n), top]) > best + 1e-9
                    best[better] = now[better]
                    feat[first : first + n][better], cut[first : first + n][better] = j, top[better]
                at = 2 * at + 1 + (b[np.arange(len(y)), feat[at]] > cut[at])
            leaf = at - inner
            value = -self.rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + self.ridge)
            self.nodes.append((feat, cut, value))
            f += value[leaf]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability for each row."""
        f, b = np.full(len(x), self.base), self.binned(x)
        for feat, cut, value in self.nodes:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                at = 2 * at + 1 + (b[np.arange(len(x)), feat[at]] > cut[at])
            f += value[at - len(feat)]
        return 1 / (1 + np.exp(-f))
