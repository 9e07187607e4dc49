"""Two small classifiers fitted on bounded samples of labelled rows: logistic regression and gradient-boosted trees.

They are fitted where a sample of documented size has been gathered and applied to whole batches inside tasks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Logistic:
    """Ridge-penalised logistic regression by Newton steps."""

    weights: np.ndarray | None = None

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> Logistic:
        x = np.column_stack([np.ones(len(x)), np.asarray(x, float)])
        w = np.zeros(x.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (p - y) + ridge * w * (np.arange(len(w)) > 0)
            hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
            step = np.linalg.solve(hess, grad)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of the rows."""
        return np.asarray(x, float) @ self.weights[1:] + self.weights[0]


@dataclass
class BoostedTrees:
    """Gradient boosting of depth-limited regression trees on the logistic loss. Splits are sought at up to 32 quantiles a feature."""

    trees: int = 60
    depth: int = 3
    rate: float = 0.2
    least: int = 5
    start: float = 0.0
    grown: list = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        x, y = np.asarray(x, float), np.asarray(y, float)
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 34)[1:-1])) for c in x.T]
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(mean / (1 - mean)))
        score = np.full(len(y), self.start)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(x, y - p, p * (1 - p), cuts, np.arange(len(y)), self.depth)
            self.grown.append(tree)
            score += self.rate * self._at(tree, x)
        return self

    def _grow(self, x, g, h, cuts, rows, depth):
        value = g[rows].sum() / (h[rows].sum() + 1.0)
        if depth == 0 or len(rows) < 2 * self.least:
            return value
        total, base, best = g[rows].sum(), h[rows].sum(), (1e-6, None, None)
        for f, at in enumerate(cuts):
            if not len(at):
                continue
            bins = np.searchsorted(at, x[rows, f], side="left")
            n = np.bincount(bins, minlength=len(at) + 1).cumsum()[:-1]
            a = np.bincount(bins, g[rows], len(at) + 1).cumsum()[:-1]
            b = np.bincount(bins, h[rows], len(at) + 1).cumsum()[:-1]
            gain = a**2 / (b + 1) + (total - a) ** 2 / (base - b + 1) - total**2 / (base + 1)
            gain[(n < self.least) | (len(rows) - n < self.least)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], f, at[k])
        if best[1] is None:
            return value
        low = x[rows, best[1]] <= best[2]
        return (best[1], best[2], self._grow(x, g, h, cuts, rows[low], depth - 1), self._grow(x, g, h, cuts, rows[~low], depth - 1))

    def _at(self, tree, x):
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        low = x[:, tree[0]] <= tree[1]
        return np.where(low, self._at(tree[2], x), self._at(tree[3], x))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of the rows."""
        x = np.asarray(x, float).reshape(-1, np.shape(x)[-1])
        return self.start + self.rate * sum((self._at(t, x) for t in self.grown), np.zeros(len(x)))
