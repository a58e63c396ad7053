"""Gradient-boosted binary trees on the logistic loss, small enough to train here and to store as JSON."""

from __future__ import annotations

import numpy as np


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.3, least: float = 4.0) -> dict:
    """Trees as nested lists ``[feature, threshold, left, right]`` or leaf values, with the start score."""
    p = np.clip((y * weight).sum() / weight.sum(), 1e-3, 1 - 1e-3)
    start = float(np.log(p / (1 - p)))
    f = np.full(len(y), start)
    cuts = [np.unique(np.quantile(c, np.linspace(0.02, 0.98, 33))) for c in x.T]
    trees = []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int):
        gs, hs = g[rows].sum(), h[rows].sum()
        value = float(rate * gs / (hs + 1.0))
        if left == 0 or hs < 2 * least * 0.05:
            return round(value, 5)
        best, at = 1e-6, None
        for k in range(x.shape[1]):
            col = x[rows, k]
            for c in cuts[k]:
                m = col <= c
                if not m.any() or m.all():
                    continue
                gl, hl = g[rows][m].sum(), h[rows][m].sum()
                gain = gl * gl / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs * gs / (hs + 1)
                if gain > best and weight[rows][m].sum() >= least and weight[rows][~m].sum() >= least:
                    best, at = gain, (k, float(c), m)
        if at is None:
            return round(value, 5)
        k, c, m = at
        return [k, round(c, 6), grow(rows[m], g, h, left - 1), grow(rows[~m], g, h, left - 1)]

    for _ in range(rounds):
        q = 1 / (1 + np.exp(-f))
        g, h = (y - q) * weight, q * (1 - q) * weight
        if np.abs(g).sum() < 1e-3 * weight.sum():
            break
        tree = grow(np.arange(len(y)), g, h, depth)
        trees.append(tree)
        f += np.array([leaf(tree, r) for r in x])
    return {"start": start, "trees": trees}


def leaf(tree, row) -> float:
    while isinstance(tree, list):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def score(model: dict, row) -> float:
    """Log-odds of one row."""
    return model["start"] + sum(leaf(t, row) for t in model["trees"])
