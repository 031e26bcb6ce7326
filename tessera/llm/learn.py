"""Small learners on bounded samples, in NumPy: a factorisation machine, gradient-boosted trees, isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Rows:
    """Sparse rows: the features of row r are ``index[start[r]:start[r + 1]]`` with ``value`` beside them. No row is empty."""

    index: np.ndarray
    value: np.ndarray
    start: np.ndarray

    @staticmethod
    def of(rows: list[tuple[np.ndarray, np.ndarray]]) -> Rows:
        start = np.zeros(len(rows) + 1, np.int64)
        np.cumsum([len(i) for i, _ in rows], out=start[1:])
        if not rows:
            return Rows(np.zeros(0, np.int64), np.zeros(0, np.float32), start)
        return Rows(np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]).astype(np.float32), start)

    def take(self, which: np.ndarray) -> Rows:
        return Rows.of([(self.index[self.start[r] : self.start[r + 1]], self.value[self.start[r] : self.start[r + 1]]) for r in which])

    def __len__(self) -> int:
        return len(self.start) - 1


@dataclass
class FactorisationMachine:
    """score(x) = sigmoid(bias + w.x + pairs), pairs = 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]: every pairwise interaction in
    time linear in the features of a row."""

    bias: float
    w: np.ndarray
    v: np.ndarray

    def parts(self, x: Rows) -> tuple[np.ndarray, np.ndarray]:
        xv = self.v[x.index] * x.value[:, None]
        s = np.add.reduceat(xv, x.start[:-1], axis=0)
        pairs = 0.5 * ((s * s).sum(1) - np.add.reduceat((xv * xv).sum(1), x.start[:-1]))
        return self.bias + np.add.reduceat(self.w[x.index] * x.value, x.start[:-1]) + pairs, s

    def score(self, x: Rows) -> np.ndarray:
        return sigmoid(self.parts(x)[0].astype(np.float64)) if len(x) else np.zeros(0)

    @staticmethod
    def fit(x: Rows, y: np.ndarray, size: int, rank: int = 8, epochs: int = 6, rate: float = 0.1, decay: float = 1e-4, batch: int = 128, seed: int = 1) -> FactorisationMachine:
        """Logistic loss by AdaGrad over seeded mini-batches."""
        rng = np.random.default_rng(seed)
        p = min(max(float(y.mean()) if len(y) else 0.5, 0.01), 0.99)
        m = FactorisationMachine(float(np.log(p / (1 - p))), np.zeros(size, np.float32), (rng.standard_normal((size, rank)) * 0.02).astype(np.float32))
        if not len(y) or y.min() == y.max():
            return FactorisationMachine(m.bias, m.w, m.v * 0)
        gw, gv, gb = np.full(size, 1e-2, np.float32), np.full((size, rank), 1e-2, np.float32), 1e-2
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for k in range(0, len(order), batch):
                rows = x.take(order[k : k + batch])
                z, s = m.parts(rows)
                d = ((sigmoid(z) - y[order[k : k + batch]]) / len(z)).astype(np.float32)
                of = np.repeat(np.arange(len(z)), np.diff(rows.start))
                at, inverse = np.unique(rows.index, return_inverse=True)
                dx = d[of] * rows.value
                g = np.bincount(inverse, dx, len(at)).astype(np.float32) + decay * m.w[at]
                each = dx[:, None] * (s[of] - m.v[rows.index] * rows.value[:, None])
                h = np.stack([np.bincount(inverse, each[:, f], len(at)) for f in range(m.v.shape[1])], 1).astype(np.float32) + decay * m.v[at]
                gw[at] += g * g
                gv[at] += h * h
                gb += float(d.sum()) ** 2
                m.w[at] -= rate * g / np.sqrt(gw[at])
                m.v[at] -= rate * h / np.sqrt(gv[at])
                m.bias -= rate * float(d.sum()) / gb**0.5
        return m


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class BoostedTrees:
    """Trees of equal depth as arrays: node k of a tree has the children 2k + 1 and 2k + 2; a row goes right if its feature exceeds the cut."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and len(x) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += leaf[node - inner]
        return out

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, n_trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, least: int = 8, smooth: float = 1.0) -> BoostedTrees:
        """Second-order boosting of the logistic loss over features binned at their quantiles."""
        p = min(max(float(y.mean()) if len(y) else 0.0, 0.01), 0.99)
        base, inner = float(np.log(p / (1 - p))), 2**depth - 1
        if not len(y) or y.min() == y.max():
            return BoostedTrees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)], 1)
        z, trees = np.full(len(y), base), []
        for _ in range(n_trees):
            q = sigmoid(z)
            g, h = q - y, np.maximum(q * (1 - q), 1e-6)
            feature, cut, leaf = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1)
            node = np.zeros(len(y), np.int64)
            for k in range(inner):
                rows = np.flatnonzero(node == k)
                best = (1e-6, 0, np.inf)
                if len(rows) >= 2 * least:
                    gs, hs = g[rows].sum(), h[rows].sum()
                    for j, c in enumerate(cuts):
                        if len(c):
                            b = binned[rows, j]
                            gl, hl, n = (np.cumsum(np.bincount(b, w, len(c) + 1))[:-1] for w in (g[rows], h[rows], None))
                            gain = gl**2 / (hl + smooth) + (gs - gl) ** 2 / (hs - hl + smooth) - gs**2 / (hs + smooth)
                            gain[(n < least) | (len(rows) - n < least)] = -1
                            at = int(gain.argmax())
                            if gain[at] > best[0]:
                                best = (float(gain[at]), j, float(c[at]))
                feature[k], cut[k] = best[1:]
                node[rows] = 2 * k + 1 + (x[rows, best[1]] > best[2])
            for k in range(inner + 1):
                rows = node == inner + k
                leaf[k] = -rate * g[rows].sum() / (h[rows].sum() + smooth)
            z += leaf[node - inner]
            trees.append((feature, cut, leaf))
        return BoostedTrees(base, *(np.stack(t) for t in zip(*trees, strict=True)))


@dataclass
class Isotonic:
    """A rising function through the pooled blocks of (margin, label), straight between their middles."""

    at: np.ndarray
    to: np.ndarray

    def __call__(self, z: np.ndarray) -> np.ndarray:
        # a hundredth of the plain sigmoid keeps the order within a block
        return 0.99 * np.interp(z, self.at, self.to) + 0.01 * sigmoid(z)

    @staticmethod
    def fit(z: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(z, kind="stable")
        blocks: list[list[float]] = []  # sum of labels, rows, sum of margins
        for zi, yi in zip(z[order], y[order], strict=True):
            blocks.append([float(yi), 1.0, float(zi)])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
        if not blocks:
            return Isotonic(np.zeros(1), np.full(1, 0.5))
        b = np.array(blocks)
        return Isotonic(b[:, 2] / b[:, 1], (b[:, 0] + 0.1) / (b[:, 1] + 0.2))


def calibrated_trees(x: np.ndarray, y: np.ndarray, folds: int = 3) -> tuple[BoostedTrees, Isotonic]:
    """Trees on all rows, calibrated on margins of trees that did not see the row."""
    out = np.zeros(len(y))
    fold = np.arange(len(y)) % folds
    for k in range(folds):
        out[fold == k] = BoostedTrees.fit(x[fold != k], y[fold != k]).margin(x[fold == k])
    return BoostedTrees.fit(x, y), Isotonic.fit(out, y)
