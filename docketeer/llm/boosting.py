"""Gradient-boosted trees on small integer features: logistic loss, numpy only, deterministic."""

from __future__ import annotations

import numpy as np

#: The furthest that a leaf moves the log-odds.
STEP = 20.0

def _tree(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, least: int) -> tuple | float:
    g, h = grad[rows].sum(), hess[rows].sum()
    # a step too far on a heavy row would have no slope to come back on
    value = max(-STEP, min(STEP, float(g / (h + 1.0))))
    if depth == 0 or len(rows) < 2 * least:
        return value
    best, split = 1e-6, None
    for f in range(x.shape[1]):
        col = x[rows, f]
        values = np.unique(col)
        for cut in values[:-1]:
            left = col <= cut
            n = int(left.sum())
            if n < least or len(rows) - n < least:
                continue
            gl, hl = grad[rows[left]].sum(), hess[rows[left]].sum()
            gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
            if gain > best:
                best, split = gain, (f, int(cut), left)
    if split is None:
        return value
    f, cut, left = split
    return f, cut, _tree(x, grad, hess, rows[left], depth - 1, least), _tree(x, grad, hess, rows[~left], depth - 1, least)


def _walk(tree: tuple | float, row: tuple) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


class Boosted:
    """``score`` gives a probability; ``threshold`` is calibrated on rows held out from the fit."""

    def __init__(self, base: float, trees: list, rate: float, threshold: float):
        self.base, self.trees, self.rate, self.threshold = base, trees, rate, threshold
        self._seen: dict[tuple, float] = {}

    def score(self, row: tuple) -> float:
        p = self._seen.get(row)
        if p is None:
            z = self.base + self.rate * sum(_walk(t, row) for t in self.trees)
            p = self._seen[row] = 1.0 / (1.0 + float(np.exp(-z)))
        return p

    def accepts(self, row: tuple) -> bool:
        return self.score(row) >= self.threshold


def fit(rows: list[tuple], labels: list[int], rounds: int = 25, depth: int = 3, rate: float = 0.4, least: int = 3) -> Boosted:
    """Fit on two of three rows and calibrate the threshold on the third."""
    parts: list[dict[tuple, list[int]]] = [{}, {}]
    for i, (r, y) in enumerate(zip(rows, labels, strict=True)):
        n = parts[i % 3 == 2].setdefault(r, [0, 0])
        n[y] += 1
    return fit_counts(*parts, rounds, depth, rate, least)


def fit_counts(fitted: dict[tuple, list[int]], held: dict[tuple, list[int]], rounds: int = 25, depth: int = 3, rate: float = 0.4, least: int = 3) -> Boosted:
    """Fit on counted rows (row to how often it is labelled 0 and 1) and calibrate the threshold on those held out: the one with the best F1, in the
    middle of the gap it falls in.

    Equal rows are fitted once with their weight, so the cost follows the distinct feature rows. With no rows everything is accepted.
    """
    fitted, held = fitted or held, held or fitted
    if not fitted:
        return Boosted(5.0, [], rate, 0.5)
    keys = list(fitted)
    counts = np.array([fitted[k] for k in keys], float)
    x, weight, share = np.array(keys, int), counts.sum(1), counts[:, 1] / counts.sum(1)
    mean = min(max(counts[:, 1].sum() / counts.sum(), 0.01), 0.99)
    base = float(np.log(mean / (1 - mean)))
    z, trees, every = np.full(len(keys), base), [], np.arange(len(keys))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        tree = _tree(x, weight * (share - p), weight * p * (1 - p), every, depth, least=1 if len(keys) < 200 else least)
        trees.append(tree)
        z += rate * np.array([_walk(tree, k) for k in keys])
    model = Boosted(base, trees, rate, 0.5)
    scored = sorted(((model.score(k), n) for k, n in held.items()), key=lambda s: -s[0])
    positives, hit, wrong, best = sum(n[1] for _, n in scored), 0, 0, (-1.0, 0.5)
    for i, (p, n) in enumerate(scored):
        hit, wrong = hit + n[1], wrong + n[0]
        f1 = 2 * hit / max(1, positives + hit + wrong)
        if f1 > best[0] + 1e-9:
            below = scored[i + 1][0] if i + 1 < len(scored) else 0.0
            best = (f1, (p + below) / 2)
    model.threshold = float(best[1]) if positives else 0.5
    return model
