"""Gradient-boosted trees for yes/no labels, in numpy.

Trees are grown level by level on binned features, with logistic loss.  Features named in
``monotone`` may only push the score one way: weights are held to the bounds of their node before
splits are compared, a split that would break the direction is not taken, and children keep to their
side of the middle between them.  A trained model is a set of flat arrays.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Forest:
    """Node arrays of all trees; leaves point to themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                go = x[rows, self.feature[at]] <= self.threshold[at]
                at = np.where(go, self.left[at], self.right[at])
            out += self.value[at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x)))


@dataclass
class _Nodes:
    feature: list = field(default_factory=list)
    threshold: list = field(default_factory=list)
    left: list = field(default_factory=list)
    right: list = field(default_factory=list)
    value: list = field(default_factory=list)

    def add(self) -> int:
        at = len(self.feature)
        self.feature.append(0)
        self.threshold.append(0.0)
        self.left.append(at)
        self.right.append(at)
        self.value.append(0.0)
        return at


def train(
    x: np.ndarray,
    y: np.ndarray,
    monotone: dict[int, int] | None = None,
    rounds: int = 60,
    depth: int = 3,
    rate: float = 0.2,
    bins: int = 64,
    min_rows: int = 10,
    smooth: float = 1.0,
) -> Forest:
    """Fit a forest; ``monotone`` maps a feature's index to +1 (score may not fall) or -1."""
    monotone = monotone or {}
    if not len(y) or y.min() == y.max():
        base = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        return Forest(*[np.zeros(0, np.int64)] * 4, np.zeros(0), np.zeros(0, np.int64), depth, base)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    code = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    margin, nodes, roots = np.full(len(y), base), _Nodes(), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        root = nodes.add()
        roots.append(root)
        todo = [(root, np.arange(len(y)), depth, -np.inf, np.inf)]
        while todo:
            node, rows, level, low, high = todo.pop()
            g, h = grad[rows].sum(), hess[rows].sum()
            weight = float(np.clip(g / (h + smooth), low, high))
            best = _split(code[rows], grad[rows], hess[rows], edges, monotone, min_rows, smooth, low, high) if level else None
            if best is None:
                nodes.value[node] = rate * weight
                margin[rows] += rate * weight
                continue
            f, cut, mid = best
            go = code[rows, f] <= cut
            kids = nodes.add(), nodes.add()
            nodes.feature[node], nodes.threshold[node] = f, float(edges[f][cut])
            nodes.left[node], nodes.right[node] = kids
            side = monotone.get(f, 0)
            bounds = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}.get(side, ((low, high),) * 2)
            todo += [(kids[0], rows[go], level - 1, *bounds[0]), (kids[1], rows[~go], level - 1, *bounds[1])]
    arrays = [np.array(v) for v in (nodes.feature, nodes.threshold, nodes.left, nodes.right, nodes.value)]
    return Forest(*arrays, np.array(roots), depth, base)


def _split(code, grad, hess, edges, monotone, min_rows, smooth, low, high):
    """(feature, bin, middle weight) of the best allowed split, or None; all weights lie in [low, high]."""
    g, h, n = grad.sum(), hess.sum(), len(code)
    worth = lambda g, h, w: 2 * g * w - (h + smooth) * w * w
    own, best, found = worth(g, h, np.clip(g / (h + smooth), low, high)), 1e-6, None
    for f, edge in enumerate(edges):
        if not len(edge):
            continue
        size = len(edge) + 1
        gl = np.cumsum(np.bincount(code[:, f], grad, size))[:-1]
        hl = np.cumsum(np.bincount(code[:, f], hess, size))[:-1]
        nl = np.cumsum(np.bincount(code[:, f], minlength=size))[:-1]
        wl, wr = (np.clip(a / (b + smooth), low, high) for a, b in ((gl, hl), (g - gl, h - hl)))
        gain = worth(gl, hl, wl) + worth(g - gl, h - hl, wr) - own
        ok = (nl >= min_rows) & (n - nl >= min_rows) & ((wr - wl) * monotone.get(f, 0) >= 0)
        gain = np.where(ok, gain, -np.inf)
        at = int(np.argmax(gain))
        if gain[at] > best:
            best, found = gain[at], (f, at, float(wl[at] + wr[at]) / 2)
    return found
