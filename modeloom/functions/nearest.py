"""Distances between blocks of rows, and the nearest of them found on rough distances and told by exact ones."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np

METRICS = {"cityblock": "cityblock", "manhattan": "cityblock", "l1": "cityblock", "euclidean": "euclidean", "l2": "euclidean", "minkowski": "euclidean", "cosine": "cosine", "chebyshev": "chebyshev"}
#: Rows of a tile: distances of that many tests to that many training rows stay in a core's cache. Products are faster on more.
TESTS, PRODUCT_TESTS, TRAINS = 64, 256, 4096
#: Of 32-bit numbers the rounding, and values beyond which they aren't used. Exact distances have so many decimals.
UNIT, LARGE, DECIMALS = 2.0**-24, 1e15, 12


def distances(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Of all rows of x to all rows of y."""
    kind = METRICS[metric]
    if kind == "cosine":
        return 1 - unit(x) @ unit(y).T
    out = np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):
        d = np.abs(x[:, j, None] - y[None, :, j])
        out = np.maximum(out, d) if kind == "chebyshev" else out + (d if kind == "cityblock" else d * d)
    return np.sqrt(out) if kind == "euclidean" else out


def unit(x: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return x / np.linalg.norm(x, axis=1, keepdims=True)


def paired(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Of each row of x to the same row of y."""
    kind = METRICS[metric]
    if kind == "cosine":
        return 1 - np.einsum("ij,ij->i", unit(x), unit(y))
    with np.errstate(all="ignore"):
        d = np.abs(x - y)
        out = np.zeros(len(x))
        for j in range(x.shape[1]):
            out = np.maximum(out, d[:, j]) if kind == "chebyshev" else out + (d[:, j] if kind == "cityblock" else d[:, j] * d[:, j])
        return np.sqrt(out) if kind == "euclidean" else out


def _places(d: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Where in d, flat, a row's limit isn't passed. Most rows have no such place, which their least value tells."""
    limit = limit.astype(d.dtype)
    rows = np.flatnonzero(d.min(axis=1) <= limit)
    i, j = np.divmod(np.flatnonzero(((d if len(rows) == len(d) else d[rows]) <= limit[rows, None]).ravel()), d.shape[1])
    return rows[i] * d.shape[1] + j


class Nearest:
    """Of each test row the k nearest training rows of other folds met so far, of equal ones those with the least id; by the
    first n features for each n of `counts`, which rises.

    Distances in 32 bits, with a bound of their error, leave few pairs of a tile, whose distances are then taken exactly."""

    def __init__(self, x: np.ndarray, folds: np.ndarray, k: int, metric: str, counts: Sequence[int] | None = None):
        self.x, self.folds, self.k, self.kind = x, folds, k, METRICS[metric]
        self.counts = list(counts or [x.shape[1]])
        shape = (len(self.counts), len(x), k)
        self.d, self.ids, self.labels = np.full(shape, np.inf), np.full(shape, np.iinfo(np.int64).max), np.zeros(shape)
        self.centre = np.zeros(x.shape[1]) if self.kind == "cosine" or not np.isfinite(x).all() else x.mean(axis=0)
        self.rough = self._single(x)
        self.room = np.empty((2, TESTS, TRAINS), np.float32)

    def _single(self, x: np.ndarray) -> np.ndarray | None:
        """Features x rows in 32 bits, none if these can't hold them."""
        with np.errstate(all="ignore"):
            moved = x - self.centre
        return None if not np.isfinite(moved).all() or np.abs(moved).max(initial=0) > LARGE else np.ascontiguousarray(moved.T.astype(np.float32))

    def meet(self, y: np.ndarray, ids: np.ndarray, labels: np.ndarray, folds: np.ndarray) -> None:
        step = PRODUCT_TESTS if self.kind in ("cosine", "euclidean") else TESTS
        for low in range(0, len(y), TRAINS):
            some = slice(low, low + TRAINS)
            own = self._single(y[some])
            sizes = self._sizes(y[some], own)
            # Pairs of several tiles are looked at together; a test is in one tile, so its limit is the same until then.
            waiting: defaultdict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
            for a in range(0, len(self.x), step):
                tile = slice(a, a + step)
                same = None
                for c, d, slack in self._tile(tile, y[some], own, sizes):
                    # Compared are distances, or their squares: `slack` is the error of what is compared.
                    squared = self.kind == "euclidean" and own is not None and self.rough is not None
                    most = self.d[c, tile, -1]
                    limit = self._reach(most, slack, squared)
                    found = _places(d, limit)
                    if len(found) > 8 * self.k * len(d) + 1024 and d.shape[1] > self.k:
                        same = self.folds[tile, None] == folds[None, some] if same is None else same
                        nearest = np.partition(np.where(same, np.float32(np.inf) if d.dtype == np.float32 else np.inf, d), self.k - 1, axis=1)[:, self.k - 1].astype(float)
                        nearest = np.sqrt(np.maximum(nearest + slack, 0)) if squared else nearest + slack
                        limit = np.minimum(limit, self._reach(nearest, slack, squared))
                        found = _places(d, limit)
                    for b in range(0, len(found), 1 << 16):
                        i, j = np.divmod(found[b : b + (1 << 16)], d.shape[1])
                        apart = self.folds[a + i] != folds[low + j]
                        waiting[c].append((a + i[apart], low + j[apart]))
                        if sum(len(x[0]) for x in waiting[c][-64:]) > 1 << 15 or len(waiting[c]) >= 64:
                            self._take(c, waiting.pop(c), y, ids, labels)
            for c in list(waiting):
                self._take(c, waiting.pop(c), y, ids, labels)

    @staticmethod
    def _reach(most: np.ndarray, slack: np.ndarray, squared: bool) -> np.ndarray:
        """What a rough distance is at most if the exact one, with its decimals, is no more than `most`."""
        exact = most + 10.0**-DECIMALS
        return ((exact * exact if squared else exact) + slack) * (1 + 4 * UNIT)

    def _sizes(self, y: np.ndarray, own: np.ndarray | None) -> list[np.ndarray]:
        """What the distances of all tiles to some training rows need of these."""
        if own is None or self.rough is None:
            return []
        if self.kind == "cosine":
            return [np.nan_to_num(unit(y[:, :n])).astype(np.float32) for n in self.counts]
        if self.kind == "euclidean":
            return [(own[:n].astype(float) ** 2).sum(axis=0) for n in self.counts]
        return [self._running(own).max(axis=1, initial=0)]

    def _running(self, own: np.ndarray) -> np.ndarray:
        """Sums, or the greatest, of the absolute values of the first features."""
        return (np.maximum.accumulate if self.kind == "chebyshev" else np.cumsum)(np.abs(own.astype(float)), axis=0)

    def _tile(self, tile: slice, y: np.ndarray, own: np.ndarray | None, sizes: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(place in counts, distances, bound of their error a test) of a tile. The distances may be changed afterwards."""
        if own is None or self.rough is None:
            with np.errstate(all="ignore"):
                for c, n in enumerate(self.counts):
                    d = distances(self.x[tile, :n], y[:, :n], self.kind)
                    yield c, np.where(np.isnan(d), np.inf, d), np.zeros(len(self.x[tile]))
            return
        x = self.rough[:, tile]
        tiny = 1e-30
        if self.kind == "cosine":
            for c, n in enumerate(self.counts):
                a = np.nan_to_num(unit(self.x[tile, :n])).astype(np.float32)
                d = a @ sizes[c].T
                yield c, np.subtract(np.float32(1), d, out=d), np.full(len(a), 2 * UNIT * (n + 8))
            return
        if self.kind == "euclidean":
            for c, n in enumerate(self.counts):
                p, q = (x[:n].astype(float) ** 2).sum(axis=0), sizes[c]
                d = x[:n].T @ own[:n]
                d *= np.float32(-2)
                d += p.astype(np.float32)[:, None]
                d += q.astype(np.float32)[None, :]
                yield c, d, 4 * UNIT * (n + 8) * (p + q.max(initial=0)) + tiny
            return
        total, wide = self.room.reshape(2, -1)[:, : x.shape[1] * own.shape[1]].reshape(2, x.shape[1], own.shape[1])
        total[:] = 0
        p, q = self._running(x), sizes[0]
        c = 0
        for j in range(self.counts[-1]):
            np.subtract(x[j, :, None], own[j, None, :], out=wide)
            np.abs(wide, out=wide)
            np.maximum(total, wide, out=total) if self.kind == "chebyshev" else np.add(total, wide, out=total)
            if j + 1 == self.counts[c]:
                yield c, total, 2 * UNIT * (j + 8) * (p[j] + q[j]) + tiny
                c += 1

    def _take(self, c: int, pairs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        n, (i, j) = self.counts[c], (np.concatenate(x) for x in zip(*pairs, strict=True))
        d = np.round(paired(self.x[i, :n], y[j, :n], self.kind), DECIMALS)
        most, last = self.d[c, i, -1], self.ids[c, i, -1]
        kept = np.isfinite(d) & ((d < most) | (d == most) & (ids[j] < last))
        if not kept.any():
            return
        i, j, d = i[kept], j[kept], d[kept]
        rows, at = np.unique(i, return_inverse=True)
        old = np.repeat(np.arange(len(rows)), self.k)
        at, d = np.concatenate([old, at]), np.concatenate([self.d[c, rows].ravel(), d])
        own, label = np.concatenate([self.ids[c, rows].ravel(), ids[j]]), np.concatenate([self.labels[c, rows].ravel(), labels[j]])
        order = np.lexsort((own, d, at))
        first = np.searchsorted(at[order], np.arange(len(rows)))
        order = order[first[:, None] + np.arange(self.k)]
        self.d[c, rows], self.ids[c, rows], self.labels[c, rows] = d[order], own[order], label[order]


def sums_of_distances(x: np.ndarray, y: np.ndarray, classes: np.ndarray, n: int) -> np.ndarray:
    """rows of x x n: sums of Euclidean distances to the rows of y of each class, a number below n.

    Squares come from products; where these cancel, distances are taken from differences."""
    order = np.argsort(classes, kind="stable")
    y, known = y[order], np.unique(classes)
    first = np.searchsorted(classes[order], known)
    out, q = np.zeros((len(x), n)), (y * y).sum(axis=1)
    for a in range(0, len(x), PRODUCT_TESTS):
        own = x[a : a + PRODUCT_TESTS]
        both = (own * own).sum(axis=1)[:, None] + q
        d = own @ y.T
        d *= -2
        d += both
        both *= 1e-4
        near = np.flatnonzero(~(d >= both))
        d = np.sqrt(np.maximum(d, 0, out=d), out=d)
        for low in range(0, len(near), 1 << 16):
            i, j = np.divmod(near[low : low + (1 << 16)], len(y))
            d[i, j] = paired(own[i], y[j], "euclidean")
        out[a : a + PRODUCT_TESTS, known] = np.add.reduceat(d, first, axis=1) if len(y) else 0
    return out
