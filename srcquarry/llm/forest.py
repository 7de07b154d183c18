"""A small random forest of binary decision trees on quantised features, as flat arrays (numpy only)."""

from __future__ import annotations

import numpy as np


class Forest:
    """Gini trees on bootstrap samples with random feature subsets; ``score`` is the mean leaf share of class 1."""

    def __init__(self, trees: int = 60, depth: int = 12, leaf: int = 8, bins: int = 32, seed: int = 7):
        self.trees, self.depth, self.leaf, self.bins, self.seed = trees, depth, leaf, bins, seed

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rng = np.random.default_rng(self.seed)
        n, f = x.shape
        # Quantiles, closer at both ends, where the rare classes are.
        tail = np.array([0.002, 0.005, 0.01, 0.02])
        at = np.unique(np.concatenate([np.linspace(0, 1, self.bins + 1)[1:-1], tail, 1 - tail]))
        cuts = [np.unique(np.quantile(x[:, k], at, method="lower")) for k in range(f)]
        code = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], 1).astype(np.int64)
        self.nodes = []
        take = max(1, int(np.sqrt(f)) + 1)
        total, seen = np.zeros(n), np.zeros(n)
        for _ in range(self.trees):
            rows = rng.integers(0, n, n)
            self.nodes.append(self._tree(code[rows], y[rows].astype(np.float64), cuts, take, rng))
            out = np.ones(n, bool)
            out[rows] = False
            total[out] += self._leaf(self.nodes[-1], x[out])
            seen[out] += 1
        #: Score of each training row by the trees that have not seen it.
        self.out_of_bag = total / np.maximum(1, seen)
        return self

    def _tree(self, code, y, cuts, take, rng):
        feature, limit, left, right, value = [], [], [], [], []

        def add() -> int:
            for a, v in ((feature, -1), (limit, 0.0), (left, 0), (right, 0), (value, 0.0)):
                a.append(v)
            return len(feature) - 1

        stack = [(add(), np.arange(len(y)), 0)]
        while stack:
            at, rows, d = stack.pop()
            t = y[rows]
            value[at] = float(t.mean()) if len(t) else 0.0
            if d >= self.depth or len(rows) < 2 * self.leaf or value[at] in (0.0, 1.0):
                continue
            best = (1e-9, -1, 0)
            base = value[at] * (1 - value[at]) * len(rows)
            for k in rng.permutation(code.shape[1])[:take]:
                if not len(cuts[k]):
                    continue
                m = len(cuts[k]) + 1
                cnt = np.bincount(code[rows, k], minlength=m).cumsum()[:-1]
                pos = np.bincount(code[rows, k], weights=t, minlength=m).cumsum()[:-1]
                rest, rpos = len(rows) - cnt, t.sum() - pos
                ok = (cnt >= self.leaf) & (rest >= self.leaf)
                if not ok.any():
                    continue
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = base - pos * (1 - pos / cnt) - rpos * (1 - rpos / rest)
                gain[~ok] = -1
                b = int(gain.argmax())
                if gain[b] > best[0]:
                    best = (float(gain[b]), int(k), b)
            if best[1] < 0:
                continue
            goes_left = code[rows, best[1]] <= best[2]
            feature[at], limit[at] = best[1], float(cuts[best[1]][best[2]])
            left[at], right[at] = add(), add()
            stack += [(left[at], rows[goes_left], d + 1), (right[at], rows[~goes_left], d + 1)]
        return np.array(feature), np.array(limit), np.array(left), np.array(right), np.array(value)

    def _leaf(self, node, x: np.ndarray) -> np.ndarray:
        feature, limit, left, right, value = node
        at = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                break
            low = x[np.arange(len(x)), np.maximum(f, 0)] <= limit[at]
            at = np.where(inner, np.where(low, left[at], right[at]), at)
        return value[at]

    def score(self, x: np.ndarray) -> np.ndarray:
        return sum((self._leaf(node, x) for node in self.nodes), np.zeros(len(x))) / max(1, len(self.nodes))
