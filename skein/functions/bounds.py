"""Bounds that tell which pairs of two blocks may be near, so that only those are measured.

Each kind has low(rows): a matrix for rows of the first block and all of the second; reach(rows, far): what an entry must not exceed for a pair
to be as near as far; sift(rows, p, q, far): which pairs at (p, q) of that matrix may be as near as far, by a closer look; exact(rows, low, p,
q): their distances. Bounds leave room for their own rounding, so no neighbour is lost; distances are those of metrics.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np

from skein.functions.metrics import PAIRED, READY, _centred, _of_ranks, _ranks, distances

PIECE = 16_384  # pairs that are measured at once
TINY = np.float32(1e-37)


class Whole:
    """No bound: all distances."""

    def __init__(self, measure: Callable, a: np.ndarray, b: np.ndarray) -> None:
        self.measure, self.a, self.b = measure, a, b

    def low(self, rows: slice) -> np.ndarray:
        return self.measure(self.a[rows], self.b)

    def reach(self, rows: slice, far: np.ndarray) -> np.ndarray:
        return far

    def sift(self, rows: slice, p: np.ndarray, q: np.ndarray, far: np.ndarray) -> np.ndarray:
        return np.ones(len(p), bool)

    def exact(self, rows: slice, low: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return low[p, q]


class Bound:
    def __init__(self, metric: str, a: np.ndarray, b: np.ndarray) -> None:
        self.paired, self.a, self.b = PAIRED[metric], a, b

    def sift(self, rows: slice, p: np.ndarray, q: np.ndarray, far: np.ndarray) -> np.ndarray:
        return np.ones(len(p), bool)

    def exact(self, rows: slice, low: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        own = self.a[rows]
        return np.concatenate([np.empty(0), *(self.paired(own[p[k : k + PIECE]], self.b[q[k : k + PIECE]]) for k in range(0, len(p), PIECE))])


class Product(Bound):
    """A bound that is one product of matrices made from the rows of each block."""

    def __init__(self, metric: str, a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray, reach: Callable) -> None:
        super().__init__(metric, a, b)
        self.left, self.right, self._reach = left, np.ascontiguousarray(right.T), reach

    def low(self, rows: slice) -> np.ndarray:
        return self.left[rows] @ self.right

    def reach(self, rows: slice, far: np.ndarray) -> np.ndarray:
        return self._reach(rows, far)


def _columns(*parts: np.ndarray) -> np.ndarray:
    return np.concatenate([x if x.ndim == 2 else x[:, None] for x in parts], 1)


def _euclidean(metric: str, a: np.ndarray, b: np.ndarray) -> Product:
    sa, sb = (a * a).sum(1), (b * b).sum(1)
    room = (sa + sb.max(initial=0.0)) * (a.shape[1] + 8) * 1e-15

    def reach(rows: slice, far: np.ndarray) -> np.ndarray:
        return (far * far if metric == "euclidean" else far) * (1 + 1e-12) + room[rows]

    return Product(metric, a, b, _columns(-2 * a, sa, np.ones(len(a))), _columns(b, np.ones(len(b)), sb), reach)


def _symmetric_kl(metric: str, a: np.ndarray, b: np.ndarray) -> Product:
    """sum (a - b) (ln a - ln b), multiplied out."""
    (p, lp), (q, lq) = ((x + 1e-12, np.log(x + 1e-12)) for x in (a, b))
    room = 1e-13 * (a.shape[1] + 8)
    left, right = _columns(-p, -lp, (p * lp).sum(1), np.ones(len(a))), _columns(lq, q, np.ones(len(b)), (q * lq).sum(1))
    return Product(metric, a, b, left, right, lambda rows, far: far * (1 + 1e-12) + room)


class Divergence(Product):
    """Jensen-Shannon: the divergence is ln 2 times the squared Hellinger distance at least, entry by entry; what that lets through is looked at
    in single precision."""

    def __init__(self, metric: str, a: np.ndarray, b: np.ndarray) -> None:
        left, right = _columns(-np.sqrt(a), a.sum(1) / 2, np.ones(len(a))), _columns(np.sqrt(b), np.ones(len(b)), b.sum(1) / 2)
        room = 1e-14 * (a.shape[1] + 8)
        super().__init__(metric, a, b, left, right, lambda rows, far: far * far * (1 + 1e-12) / np.log(2) + room)
        self.single = a.astype(np.float32), b.astype(np.float32)
        self.own = [(x * np.log(np.maximum(x, 1e-300))).sum(1) / 2 for x in (a, b)]

    def sift(self, rows: slice, p: np.ndarray, q: np.ndarray, far: np.ndarray) -> np.ndarray:
        a, b, out = self.single[0][rows], self.single[1], [np.empty(0)]
        for k in range(0, len(p), PIECE):
            middle = np.maximum((a[p[k : k + PIECE]] + b[q[k : k + PIECE]]) / 2, TINY)
            out.append((middle * np.log(middle)).sum(1))
        return ~(self.own[0][rows][p] + self.own[1][q] - np.concatenate(out) > far * far + 1e-5)


class Levels(Bound):
    """Manhattan distances of values rounded down to whole levels that 16 bits hold the sum of: sum |a - b| = 2 sum max(a, b) - sum a - sum b.
    Values beyond the levels' range are moved to its ends, which brings none further apart."""

    def __init__(self, metric: str, a: np.ndarray, b: np.ndarray) -> None:
        super().__init__(metric, a, b)
        top = 65_535 // a.shape[1] - 1
        some = np.concatenate([x.ravel()[:: 1 + x.size // 10_000] for x in (a, b)])
        start, end = np.quantile(some, [0.002, 0.998])
        self.step = (end - start) / top or 1.0
        self.left, right = (np.clip(np.floor((x - start) / self.step), 0, top).astype(np.uint16) for x in (a, b))
        self.right = np.ascontiguousarray(right.T)
        self.sums = [x.sum(1, dtype=np.int32) for x in (self.left, right)]

    def low(self, rows: slice) -> np.ndarray:
        own = self.left[rows]
        out = np.empty((len(own), self.right.shape[1]), np.int32)
        for r in range(0, len(own), 8):  # what a core's cache holds
            part = own[r : r + 8]
            high = np.zeros((len(part), self.right.shape[1]), np.uint16)
            one = np.empty_like(high)
            for k in range(own.shape[1]):
                np.maximum(part[:, k, None], self.right[k], out=one)
                np.add(high, one, out=high)
            here = out[r : r + 8]
            np.multiply(high, 2, out=here, dtype=np.int32, casting="unsafe")
            np.subtract(here, self.sums[1], out=here)
        return out

    def reach(self, rows: slice, far: np.ndarray) -> np.ndarray:
        # two values a level apart may be any nearer, so each counts one level less
        return far * (1 + 1e-9) / self.step + self.a.shape[1] + 1 + self.sums[0][rows]


class Single(Bound):
    """Canberra distances in single precision."""

    def __init__(self, metric: str, a: np.ndarray, b: np.ndarray) -> None:
        super().__init__(metric, a, b)
        self.left, self.right = a.astype(np.float32), np.ascontiguousarray(b.T.astype(np.float32))
        self.sizes = np.abs(self.left), np.abs(self.right) + TINY  # two zeros are not apart

    def low(self, rows: slice) -> np.ndarray:
        own, size = self.left[rows], self.sizes[0][rows]
        out = np.zeros((len(own), self.right.shape[1]), np.float32)
        one, both = np.empty((8, out.shape[1]), np.float32), np.empty((8, out.shape[1]), np.float32)
        for r in range(0, len(own), 8):
            here = out[r : r + 8]
            x, y = one[: len(here)], both[: len(here)]
            for k in range(own.shape[1]):
                np.subtract(own[r : r + 8, k, None], self.right[k], out=x)
                np.abs(x, out=x)
                np.add(size[r : r + 8, k, None], self.sizes[1][k], out=y)
                np.divide(x, y, out=x)
                np.add(here, x, out=here)
        return out

    def reach(self, rows: slice, far: np.ndarray) -> np.ndarray:
        return far + 1e-6 * self.a.shape[1] * (1 + self.a.shape[1] / 16)


class Ranks(Product):
    """Rank correlation: products of centred ranks, which are whole or half numbers, are exact; the bound only leaves out their rounding."""

    def __init__(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = _centred(a), _centred(b)
        (left, na), (right, nb) = ((x / np.where(n == 0, 1, n)[:, None], n) for x, n in ((x, np.sqrt((x * x).sum(1))) for x in (a, b)))
        self.paired, self.a, self.b, self.sizes = None, a, b, (na, nb)
        self.left, self.right, self._reach = -left, np.ascontiguousarray(right.T), lambda rows, far: far - 1 + 1e-9

    def exact(self, rows: slice, low: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        own, na, nb = self.a[rows], self.sizes[0][rows], self.sizes[1]
        dot = np.concatenate([np.empty(0), *(np.einsum("pk,pk->p", own[p[k : k + PIECE]], self.b[q[k : k + PIECE]]) for k in range(0, len(p), PIECE))])
        return np.round(1 - dot / (na[p] * nb[q]), 12)


class Sparse(NamedTuple):
    """Entries of n rows, by row."""

    n: int
    row: np.ndarray
    term: np.ndarray
    value: np.ndarray


class Shared(Whole):
    """All distances of sparse rows, from sums over the terms that both blocks have and sums of each row alone. Terms that many rows have make
    matrices of WIDE terms at a time; the entries of the others meet one by one."""

    WIDE, MANY = 1024, 0.02

    def __init__(self, metric: str, a: Sparse, b: Sparse) -> None:
        self.metric, self.n = metric, (a.n, b.n)
        self.sums = [np.bincount(x.row, x.value**2 if metric in ("cosine", "euclidean") else np.abs(x.value), x.n) for x in (a, b)]
        held = [np.unique(x.term, return_counts=True) for x in (a, b)]
        both, at, to = np.intersect1d(held[0][0], held[1][0], assume_unique=True, return_indices=True)
        often = held[0][1][at] * held[1][1][to] > self.MANY * a.n * b.n
        self.often, seldom = both[often], both[~often]
        worth = (lambda x: np.sqrt(np.abs(x))) if metric == "hellinger" else lambda x: x
        self.dense, self.rare = ([self._of(x, terms, worth) for x in (a, b)] for terms in (self.often, seldom))
        row, term, value = self.rare[1]
        by = np.argsort(term, kind="stable")
        self.rare[1] = row[by], np.searchsorted(term[by], np.arange(len(seldom) + 1)), value[by]

    @staticmethod
    def _of(x: Sparse, terms: np.ndarray, worth: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place among terms, value) of the entries that have one of them."""
        at = np.minimum(np.searchsorted(terms, x.term), max(0, len(terms) - 1))
        on = terms[at] == x.term if len(terms) else np.zeros(len(at), bool)
        return x.row[on], at[on], worth(x.value[on])

    def _matrix(self, side: int, low: int, rows: slice) -> np.ndarray:
        row, term, value = self.dense[side]
        start, end = np.searchsorted(row, [rows.start, rows.stop])
        row, term, value = row[start:end] - rows.start, term[start:end] - low, value[start:end]
        on = (term >= 0) & (term < self.WIDE)
        out = np.zeros((rows.stop - rows.start, min(self.WIDE, len(self.often) - low)))
        np.add.at(out, (row[on], term[on]), value[on])
        return out

    def _gaps(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """sum |x - y| - |x| - |y|."""
        out, b = np.zeros((len(a), len(b))), np.ascontiguousarray(b.T)
        one = np.empty((8, out.shape[1]))
        for r in range(0, len(a), 8):
            here = out[r : r + 8]
            for k in range(a.shape[1]):
                x = np.subtract(a[r : r + 8, k, None], b[k], out=one[: len(here)])
                np.add(here, np.abs(x, out=x), out=here)
        return out - np.abs(a).sum(1)[:, None] - np.abs(b).sum(0)

    def low(self, rows: slice) -> np.ndarray:
        n, out = rows.stop - rows.start, np.zeros((rows.stop - rows.start, self.n[1]))
        for low in range(0, len(self.often), self.WIDE):
            a, b = self._matrix(0, low, rows), self._matrix(1, low, slice(0, self.n[1]))
            out += self._gaps(a, b) if self.metric == "manhattan" else a @ b.T
        row, term, x = self.rare[0]
        start, end = np.searchsorted(row, [rows.start, rows.stop])
        row, term, x = row[start:end] - rows.start, term[start:end], x[start:end]
        other, begin, y = self.rare[1]
        many = begin[term + 1] - begin[term]
        part = np.cumsum(many) // 4_000_000  # entries that meet at once
        for piece in np.unique(part):
            on = np.flatnonzero(part == piece)
            left = np.repeat(on, many[on])
            right = begin[term[left]] + np.arange(len(left)) - np.repeat(np.cumsum(many[on]) - many[on], many[on])
            u, v = x[left], y[right]
            both = np.abs(u - v) - np.abs(u) - np.abs(v) if self.metric == "manhattan" else u * v
            out += np.bincount(row[left] * self.n[1] + other[right], both, n * self.n[1]).reshape(out.shape)
        p, q = self.sums[0][rows][:, None], self.sums[1][None]
        if self.metric == "cosine":
            return 1 - out / (np.sqrt(p) * np.sqrt(q))
        if self.metric == "euclidean":
            return np.sqrt(np.maximum(0.0, p + q - 2 * out))
        return np.sqrt(np.maximum(0.0, 1 - out / np.sqrt(p * q))) if self.metric == "hellinger" else p + q + out


BOUNDS = {"euclidean": _euclidean, "sqeuclidean": _euclidean, "symmetrickl": _symmetric_kl, "jensenshannon": Divergence, "manhattan": Levels, "canberra": Single}


def ready(metric: str, x: np.ndarray) -> np.ndarray:
    """What a block keeps of its rows: worked out once a row, not once a pair of blocks."""
    return _ranks(x) if metric == "spearmanr" else READY[metric](x) if metric in READY else x


def between(metric: str, a: np.ndarray, b: np.ndarray) -> Whole | Bound:
    """For blocks of rows that are ready. Rows that a bound cannot hold are all measured."""
    if metric == "spearmanr":
        level = any((x == x[:, :1]).all(1).any() for x in (a, b))
        return Whole(_of_ranks, a, b) if level else Ranks(a, b)
    sizes = [np.abs(x) for x in (a, b)]
    top = max(x.max(initial=0.0) for x in sizes)
    held = metric in BOUNDS and top < 1e30 and a.size > 0 and b.size > 0
    if metric == "canberra":
        held = held and all((x[x > 0] > 1e-30).all() for x in sizes)
    if metric == "manhattan":
        held = held and a.shape[1] <= 1024
    if held:
        return BOUNDS[metric](metric, a, b)
    whole = PAIRED.get(metric)
    if whole is None:
        return Whole(lambda x, y: distances(metric, x, y), a, b)
    return Whole(lambda x, y: np.stack([whole(r, y) for r in x]) if len(x) else np.empty((0, len(y))), a, b)
