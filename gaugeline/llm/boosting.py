"""Gradient-boosted trees with logistic loss on binned features.

`best_splits` turns gradient histograms into one level of a tree; the histograms may come from
numpy (a bounded sample of feature rows) or from a Spark aggregate (see url_trees).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth. Node k of a level has children 2k and 2k + 1 in the next;
    a row goes right when its bin is above `cut`. `edges` holds each feature's bin borders."""

    edges: list[np.ndarray]
    feature: np.ndarray  # trees x (2^depth - 1)
    cut: np.ndarray
    leaf: np.ndarray  # trees x 2^depth
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = bins_of(x, self.edges)
        rows, out = np.arange(len(x)), np.full(len(x), self.bias)
        depth = int(np.log2(self.leaf.shape[1]))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node, base = np.zeros(len(x), np.int64), 0
            for level in range(depth):
                node = 2 * node + (binned[rows, feature[base + node]] > cut[base + node])
                base += 2**level
            out += leaf[node]
        return out


def bins_of(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)], 1) if len(edges) else np.zeros((len(x), 0), int)


def edges_of(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]


def best_splits(g: np.ndarray, h: np.ndarray, l2: float, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Feature and cut for each node, from histograms (node, feature, bin) of gradients and hessians.

    A node that no cut improves gets a cut beyond the last bin, so that all its rows go left."""
    gl, hl = g.cumsum(2), h.cumsum(2)
    gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
    gr, hr = gt - gl, ht - hl
    gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - gt**2 / (ht + l2)
    gain = np.where((hl >= least) & (hr >= least), gain, 0.0)
    flat = gain.reshape(len(g), -1)
    best = flat.argmax(1)
    feature, cut = np.divmod(best, g.shape[2])
    none = flat[np.arange(len(g)), best] <= 1e-9
    return np.where(none, 0, feature), np.where(none, g.shape[2], cut)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, l2: float = 1.0, least: float = 2.0) -> Trees:
    """Trees on a bounded sample; without both classes they give a constant."""
    edges = edges_of(x, bins)
    binned, n, f = bins_of(x, edges), *x.shape
    p = (y.sum() + 0.5) / (n + 1)
    bias = float(np.log(p / (1 - p)))
    margin, features, cuts, leaves = np.full(n, bias), [], [], []
    for _ in range(trees if n and 0 < y.sum() < n else 0):
        prob = 1 / (1 + np.exp(-margin))
        g, h = prob - y, np.maximum(prob * (1 - prob), 1e-6)
        node, feature, cut = np.zeros(n, np.int64), [], []
        for level in range(depth):
            cells = [(node * bins + binned[:, j]) for j in range(f)]
            hist = lambda w: np.stack([np.bincount(c, w, bins * 2**level).reshape(-1, bins) for c in cells], 1)  # noqa: B023, E731
            at, to = best_splits(hist(g), hist(h), l2, least)
            node = 2 * node + (binned[np.arange(n), at[node]] > to[node])
            feature.append(at)
            cut.append(to)
        leaf = -rate * np.bincount(node, g, 2**depth) / (np.bincount(node, h, 2**depth) + l2)
        margin += leaf[node]
        features.append(np.concatenate(feature))
        cuts.append(np.concatenate(cut))
        leaves.append(leaf)
    shape = (len(leaves), -1)
    return Trees(edges, np.array(features, int).reshape(shape) if leaves else np.zeros((0, 2**depth - 1), int), np.array(cuts, int).reshape(shape) if leaves else np.zeros((0, 2**depth - 1), int), np.array(leaves).reshape(shape) if leaves else np.zeros((0, 2**depth)), bias)


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of y on margin by pooling adjacent violators: (centres, values) to interpolate.

    Rows of equal margins are one point. Each block counts a hundredth of a positive and as much of a
    negative more, so that values stay within (0, 1)."""
    if not len(margin):
        return np.zeros(1), np.full(1, 0.5)
    points, at = np.unique(margin, return_inverse=True)
    blocks: list[list[float]] = []  # positives, rows, sum of margins
    for p, n, m in zip(np.bincount(at, y).tolist(), np.bincount(at).tolist(), points.tolist(), strict=True):
        blocks.append([p, float(n), m * n])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    b = np.array(blocks)
    return b[:, 2] / b[:, 1], np.maximum.accumulate((b[:, 0] + 0.01) / (b[:, 1] + 0.02))
