"""Exact search measures only the pairs that a bound lets through, and finds the same neighbours."""

import numpy as np
import pytest

from skein.functions import bounds
from skein.functions.metrics import distances
from skein.operators.knn import Nearest

KINDS = ["euclidean", "sqeuclidean", "manhattan", "canberra", "jensenshannon", "symmetrickl", "spearmanr"]


def odd_rows(n=900, dim=24):
    """Signs of both kinds, zeros, rows without values, equal rows, one value far off."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, dim)) * (rng.random((n, dim)) < 0.8)
    x[40:60], x[60:90], x[100, 3] = 0.0, x[7], 5000.0
    return x


@pytest.mark.parametrize("metric", KINDS)
@pytest.mark.parametrize("own", [True, False])
def test_neighbours_are_those_of_all_distances(metric, own):
    x, k = odd_rows(), 9
    if metric == "spearmanr":
        x = np.delete(x, np.arange(40, 60), 0)  # rows without values have no ranks
    ids = np.random.default_rng(6).permutation(len(x)) * 3
    ready = bounds.ready(metric, x)
    found = Nearest(ids, k, own)
    for part in np.array_split(np.arange(len(x)), 3):
        found.meet(bounds.between(metric, ready, ready[part]), ids[part], step=len(part) * 100)
    d = distances(metric, x, x)
    d = np.where(np.eye(len(x), dtype=bool) & own, 0.0, d)
    for r in range(len(x)):
        key = np.where((ids == ids[r]) & own, -1.0, d[r])
        best = np.lexsort((ids, key))[:k]
        assert (found.j[r] == ids[best]).all()
        assert np.allclose(found.found().to_pandas().query("i == @ids[@r]").d, d[r, best], rtol=1e-13, atol=0) if r % 100 == 0 else True


@pytest.mark.parametrize("metric", KINDS)
def test_few_pairs_are_measured(metric, monkeypatch):
    x = np.random.default_rng(1).normal(size=(1500, 32))
    pairs = bounds.between(metric, *[bounds.ready(metric, x)] * 2)
    seen = []
    monkeypatch.setattr(pairs, "exact", lambda rows, low, p, q, f=pairs.exact: seen.append(len(p)) or f(rows, low, p, q), raising=False)
    Nearest(np.arange(1500), 10, True).meet(pairs, np.arange(1500))
    assert not isinstance(pairs, bounds.Whole) and sum(seen) < 0.1 * 1500 * 1500


def test_rows_that_no_bound_holds():
    """Missing values come last, as in SQL; infinite ones are measured like others."""
    x = odd_rows()[::15]
    x[3, 2], x[5, 1] = np.nan, np.inf
    for metric in KINDS:
        with np.errstate(all="ignore"):
            pairs = bounds.between(metric, *[bounds.ready(metric, x)] * 2)
            found = Nearest(np.arange(60), 60, True)
            found.meet(pairs, np.arange(60))
        assert (np.sort(found.j, 1) == np.arange(60)).all()
