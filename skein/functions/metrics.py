"""Distances between rows of two matrices. Where a denominator is zero, two zero vectors are at 0, others at 1."""

from __future__ import annotations

import numpy as np


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(b == 0, np.where(a == 0, 0.0, 1.0), a / np.where(b == 0, 1, b))


def _cosine(a, b):
    na, nb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
    both = na[:, None] * nb[None]
    return np.where(both == 0, np.where(na[:, None] == nb[None], 0.0, 1.0), 1 - (a @ b.T) / np.where(both == 0, 1, both))


def _centred(x):
    return x - x.mean(1, keepdims=True)


def _ranks(x):
    """Mean ranks."""
    out = np.empty(x.shape)
    for i, r in enumerate(x):
        v, inverse, n = np.unique(r, return_inverse=True, return_counts=True)
        out[i] = (np.cumsum(n) - (n - 1) / 2)[inverse]
    return out


def _of_ranks(a, b):
    """Of whole ranks, so ties are many: digits that only rounding fills are cut off."""
    return np.round(_cosine(_centred(a), _centred(b)), 12)


def _l1(x):
    s = np.abs(x).sum(1, keepdims=True)
    return np.abs(x) / np.where(s == 0, 1, s)


def _each(f):
    """A distance from the differences of all pairs."""
    return lambda a, b: f(a[:, None, :], b[None, :, :])


def _binary(f):
    """A distance from the counts of true-true, true-false, false-true and false-false."""

    def run(a, b):
        a, b = (a != 0).astype(float), (b != 0).astype(float)
        tt, tf, ft = a @ b.T, a @ (1 - b).T, (1 - a) @ b.T
        return f(tt, tf, ft, a.shape[1] - tt - tf - ft, float(a.shape[1]))

    return run


def _entropy(p, q):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * np.log(p / np.where(q > 0, q, 1e-300)), 0).sum(-1)


def _jensen_shannon(a, b):
    m = (a + b) / 2
    return np.sqrt(np.maximum((_entropy(a, m) + _entropy(b, m)) / 2, 0))


def _symmetric_kl(a, b):
    a, b = a + 1e-12, b + 1e-12
    return _entropy(a, b) + _entropy(b, a)


def _hellinger(a, b):
    sa, sb = np.abs(a).sum(1), np.abs(b).sum(1)
    both = np.sqrt(sa[:, None] * sb[None])
    return np.where(both == 0, np.where(sa[:, None] == sb[None], 0.0, 1.0), np.sqrt(np.maximum(0, 1 - np.sqrt(np.abs(a)) @ np.sqrt(np.abs(b)).T / np.where(both == 0, 1, both))))


def _tsss(a, b):
    na, nb = np.linalg.norm(a, axis=1)[:, None], np.linalg.norm(b, axis=1)[None]
    theta = np.arccos(np.clip(1 - _cosine(a, b), -1, 1)) + np.radians(10)
    gap = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1)) + np.abs(na - nb)
    return (na * nb * np.abs(np.sin(theta)) / 2) * (gap**2 * theta / 2)


#: Distances of rows that meet one by one (or broadcast), for those that READY has made of a block's rows.
PAIRED = {
    "euclidean": lambda a, b: np.sqrt(((a - b) ** 2).sum(-1)),
    "sqeuclidean": lambda a, b: ((a - b) ** 2).sum(-1),
    "manhattan": lambda a, b: np.abs(a - b).sum(-1),
    "canberra": lambda a, b: _ratio(np.abs(a - b), np.abs(a) + np.abs(b)).sum(-1),
    "jensenshannon": _jensen_shannon,
    "symmetrickl": _symmetric_kl,
}
READY = {"jensenshannon": _l1, "symmetrickl": _l1}

METRICS = {
    "euclidean": _each(PAIRED["euclidean"]),
    "sqeuclidean": _each(PAIRED["sqeuclidean"]),
    "manhattan": _each(PAIRED["manhattan"]),
    "chebyshev": _each(lambda a, b: np.abs(a - b).max(-1)),
    "canberra": _each(PAIRED["canberra"]),
    "braycurtis": _each(lambda a, b: _ratio(np.abs(a - b).sum(-1), np.abs(a + b).sum(-1))),
    "cosine": _cosine,
    "correlation": lambda a, b: _cosine(_centred(a), _centred(b)),
    "spearmanr": lambda a, b: _of_ranks(_ranks(a), _ranks(b)),
    "hellinger": _hellinger,
    "jensenshannon": lambda a, b: _each(_jensen_shannon)(_l1(a), _l1(b)),
    "symmetrickl": lambda a, b: _each(_symmetric_kl)(_l1(a), _l1(b)),
    "tsss": _tsss,
    "hamming": _binary(lambda tt, tf, ft, ff, n: (tf + ft) / n),
    "matching": _binary(lambda tt, tf, ft, ff, n: (tf + ft) / n),
    "jaccard": _binary(lambda tt, tf, ft, ff, n: _ratio(tf + ft, tt + tf + ft)),
    "dice": _binary(lambda tt, tf, ft, ff, n: _ratio(tf + ft, 2 * tt + tf + ft)),
    "kulsinski": _binary(lambda tt, tf, ft, ff, n: (tf + ft - tt + n) / (tf + ft + n)),
    "rogerstanimoto": _binary(lambda tt, tf, ft, ff, n: 2 * (tf + ft) / (n + tf + ft)),
    "russellrao": _binary(lambda tt, tf, ft, ff, n: (n - tt) / n),
    "sokalmichener": _binary(lambda tt, tf, ft, ff, n: 2 * (tf + ft) / (n + tf + ft)),
    "sokalsneath": _binary(lambda tt, tf, ft, ff, n: _ratio(tf + ft, 0.5 * tt + tf + ft)),
    "yule": _binary(lambda tt, tf, ft, ff, n: np.where((tf == 0) | (ft == 0), 0.0, 2 * tf * ft / np.where(tt * ff + tf * ft == 0, 1, tt * ff + tf * ft))),
}


def distances(name: str, a: np.ndarray, b: np.ndarray, most: int = 4_000_000) -> np.ndarray:
    """(len(a), len(b)), in pieces of at most `most` products."""
    if name not in METRICS:
        raise ValueError(f"unknown distance {name!r}")
    step = max(1, most // max(1, b.size))
    return np.concatenate([METRICS[name](a[k : k + step], b) for k in range(0, len(a), step)]) if len(a) else np.empty((0, len(b)))


def paired(name: str, a: np.ndarray, b: np.ndarray, block: int = 32) -> np.ndarray:
    """Distances of the rows of a and b one by one, from the diagonals of small blocks."""
    return np.concatenate([*(METRICS[name](a[k : k + block], b[k : k + block]).diagonal() for k in range(0, len(a), block)), np.empty(0)])
