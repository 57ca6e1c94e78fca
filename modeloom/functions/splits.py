"""Assignments of rows to folds, worked out on ids and labels."""

from __future__ import annotations

import numpy as np


def stratified(y: np.ndarray, folds: int, seed: int = 42) -> np.ndarray:
    """Shuffled folds of equal class shares."""
    _, first, encoded = np.unique(y, return_index=True, return_inverse=True)
    encoded = np.argsort(np.argsort(first))[encoded]  # classes by first appearance
    ordered, n = np.sort(encoded), len(first)
    allocation = np.array([np.bincount(ordered[i::folds], minlength=n) for i in range(folds)])
    out, rng = np.empty(len(y), int), np.random.RandomState(seed)
    for c in range(n):
        own = np.repeat(np.arange(folds), allocation[:, c])
        rng.shuffle(own)
        out[encoded == c] = own
    return out


def grouped(groups: np.ndarray, folds: int) -> np.ndarray:
    """Whole groups, the largest first, each to the lightest fold."""
    names, at = np.unique(groups, return_inverse=True)
    sizes, load, fold = np.bincount(at), np.zeros(folds), np.zeros(len(names), int)
    for g in np.argsort(sizes, kind="stable")[::-1]:
        fold[g] = int(np.argmin(load))
        load[fold[g]] += sizes[g]
    return fold[at]


def stratified_grouped(y: np.ndarray, groups: np.ndarray, folds: int) -> np.ndarray:
    """Whole groups, the most uneven first, each to the fold that then has the most even class shares."""
    _, label = np.unique(y, return_inverse=True)
    names, at = np.unique(groups, return_inverse=True)
    table = np.zeros((len(names), label.max() + 1))
    np.add.at(table, (at, label), 1)
    total, held, fold = table.sum(axis=0), np.zeros((folds, table.shape[1])), np.zeros(len(names), int)
    for g in np.argsort(-table.std(axis=1), kind="stable"):
        best = (np.inf, np.inf, -1)
        for i in range(folds):
            trial = held.copy()
            trial[i] += table[g]
            # Spreads count as equal by their difference, not their ratio: in large tables all are small.
            spread = round(float(np.mean(np.std(trial, axis=0) / total)), 9)
            best = min(best, (spread, float(held[i].sum()), i))
        fold[g] = best[2]
        held[best[2]] += table[g]
    return fold[at]
