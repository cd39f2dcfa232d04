import numpy as np
import pandas as pd
import pytest

from skein.operators import components as C
from skein.operators import init as I


def dense(spark, n, d, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * (rng.random((n, d)) < 0.2) * np.linspace(4, 0.5, d)
    x[:, 0] += 3 * (np.arange(n) % 2)
    i, j = np.nonzero(x)
    return x, spark.createDataFrame(pd.DataFrame({"id": i, "term": [f"t{k}" for k in j], "value": x[i, j]}))


@pytest.mark.parametrize("center", (True, False))
def test_sparse_components_are_the_dense_ones(spark, center):
    x, terms = dense(spark, 200, 30)
    found = C.sparse_pca(terms, 200, 3, center)
    m = x - x.mean(0) if center else x
    value, vector = np.linalg.eigh(m.T @ m / 199)
    assert np.allclose(found.variance, value[::-1][:3], rtol=1e-6)
    got = {r.term: r.loadings for r in found.rotation.collect()}
    v = np.array([got[f"t{k}"] for k in range(30)])
    assert np.allclose(v.T @ v, np.eye(3), atol=1e-8)
    assert np.linalg.svd(v.T @ vector[:, ::-1][:, :3])[1].min() > 1 - 1e-6  # the angle between the subspaces
    y = C.sparse_scores(terms, found, spark.range(201)).orderBy("id").toPandas().y
    assert np.allclose(np.stack(y)[:200], m @ v, atol=1e-8) and len(y) == 201
    again = C.sparse_pca(terms.repartition(7), 200, 3, center)
    assert np.allclose(again.variance, found.variance)


def test_many_terms_and_edges(spark):
    """100,000 terms: nothing is as large as their square, and few rows of them give what their inner products give."""
    rng = np.random.default_rng(1)
    n, d = 60, 100_000
    i, j, v = np.repeat(np.arange(n), 40), rng.integers(0, d, n * 40), rng.normal(size=n * 40)
    v[i < 20] += 2
    j[::3] = rng.integers(0, 50, len(j[::3]))
    t = pd.DataFrame({"id": i, "term": j, "value": v}).drop_duplicates(["id", "term"])
    found = C.sparse_pca(spark.createDataFrame(t), n, 2)
    a = np.zeros((n, d))
    a[t.id, t.term] = t.value
    a -= a.mean(0)
    assert np.allclose(found.variance, np.linalg.eigvalsh(a @ a.T / (n - 1))[::-1][:2], rtol=1e-4) and (found.residual < 1e-3).all()
    one = C.sparse_pca(spark.createDataFrame([(1, "a", 2.0), (2, "a", -2.0)], "id long, term string, value double"), 2, 3)
    assert len(one.variance) == 1 and abs(one.variance[0] - 8) < 1e-9


@pytest.mark.parametrize("side", (1024, 64))
def test_classical_scaling(spark, monkeypatch, side):
    monkeypatch.setattr(C, "SIDE", side)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 5)) * [5, 3, 1, 0.5, 0.2]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    if side == 64:
        d = np.sqrt(d) + np.abs(rng.normal(size=d.shape)) * 0.1 * (1 - np.eye(150))  # of no Euclidean space
        d = np.triu(d) + np.triu(d).T
    i, j = np.nonzero(np.triu(np.ones_like(d), 1))
    pairs = spark.createDataFrame(pd.DataFrame({"i": i, "j": j, "d": d[i, j]}))
    y = np.stack(C.classical_scaling(pairs, 150, 2).orderBy("id").toPandas().y)
    m = -(d**2 - (d**2).mean(0) - (d**2).mean(1)[:, None] + (d**2).mean()) / 2
    value, vector = np.linalg.eigh(m)
    want = vector[:, ::-1][:, :2] * np.sqrt(value[::-1][:2])
    want *= np.sign(want[np.abs(want).argmax(0), [0, 1]])
    assert np.allclose(y, want, atol=1e-4 * np.abs(want).max())
    with pytest.raises(ValueError):
        C.classical_scaling(pairs, 150, 150)


@pytest.fixture(scope="module")
def ring(spark):
    """A ring of 90 vertices with a few chords: its leading eigenvalues lie close together."""
    e = {(i, (i + 1) % 90): 1.0 for i in range(90)} | {(i, (i * 7 + 11) % 90): 0.3 for i in range(0, 90, 9)}
    both = {}
    for (i, j), w in e.items():
        if i != j:
            both[i, j] = both[j, i] = w
    return spark.createDataFrame([(i, j, w) for (i, j), w in both.items()], "i long, j long, w double"), both


def test_krylov_tells_close_values_apart(ring):
    g, both = ring
    m = np.zeros((90, 90))
    for (i, j), w in both.items():
        m[i, j] = w
    d = m.sum(1)
    value, vector = np.linalg.eigh(m / np.sqrt(np.outer(d, d)))
    y, values, rest = I.krylov_coords(g, 90, 3)
    assert np.allclose(values, value[::-1][1:4], atol=1e-9) and (rest <= 1e-6).all()
    v = np.stack(y.orderBy("id").toPandas().y)
    assert np.linalg.svd(v.T @ vector[:, ::-1][:, 1:4])[1].min() > 1 - 1e-6
    with pytest.raises(RuntimeError, match="not settled"):
        I.krylov_coords(g, 90, 3, products=1)
    walk = np.stack(I.krylov_coords(g, 90, 3, walk=True)[0].orderBy("id").toPandas().y)
    assert np.allclose(np.abs(walk), np.abs(v) / np.sqrt(d)[:, None], atol=1e-6)


def test_mid_near_start(spark, ring):
    g, both = ring
    rows = spark.createDataFrame([(i, [float(np.cos(i / 14.32)), float(np.sin(i / 14.32))]) for i in range(90)], "id long, x array<double>")
    for weight in (0.0, 0.9, 1.0):
        mixed = {(r.i, r.j): r.w for r in I.mid_near_graph(g, rows, 90, weight).collect()}
        assert all(abs(mixed[j, i] - w) < 1e-12 for (i, j), w in mixed.items())
        assert (len(mixed) > len(both)) == (weight == 0.9) or weight == 0.0
        if weight == 1.0:
            assert mixed == pytest.approx(both)
    y = I.initial("midspectral", g, rows, 90, 2).toPandas()
    assert len(y) == 90 and np.isfinite(np.stack(y.y)).all()
    with pytest.raises(ValueError, match="features"):
        I.initial("mid", g, None, 90, 2)
    with pytest.raises(ValueError, match="graph_weight"):
        I.mid_near_graph(g, rows, 90, 2.0)


def test_scaled_rows_are_classical_scaling(spark, monkeypatch):
    """Without a table of all distances."""
    from skein.plans import queries as Q

    monkeypatch.setattr(C, "SIDE", 64)
    x = np.random.default_rng(3).normal(size=(150, 5)) * [5, 3, 1, 0.5, 0.2] + 40
    rows = spark.createDataFrame(pd.DataFrame({"id": np.arange(150), "x": x.tolist()}), "id long, x array<double>").repartition(3)
    i, j = np.nonzero(np.triu(np.ones((150, 150)), 1))
    pairs = spark.createDataFrame(pd.DataFrame({"i": i, "j": j, "d": np.sqrt(((x[i] - x[j]) ** 2).sum(1))}))
    a, b = (np.stack(y.orderBy("id").toPandas().y) for y in (C.scaled_rows(rows, 150, 2), C.classical_scaling(pairs, 150, 2)))
    assert np.allclose(a, b, atol=1e-6 * np.abs(b).max())
    with pytest.raises(ValueError):
        C.scaled_rows(rows, 150, 150)
    monkeypatch.setattr(Q, "pairs", None)
    assert Q.classical_mds(spark, "/root/testdata/sf0.001").count() == 500


def test_spectral_rounds_return_each_vertex_once(spark, monkeypatch):
    """Partitions hold the edges of vertices of their own, so that a round sends n rows to the driver, however many partitions there are."""
    from pyspark.sql.classic.dataframe import DataFrame

    rng = np.random.default_rng(8)
    i, j = np.repeat(np.arange(20_000), 6), rng.integers(0, 20_000, 120_000)
    e = pd.DataFrame({"i": np.concatenate([i, j]), "j": np.concatenate([j, i]), "w": 1.0}).query("i != j").drop_duplicates(["i", "j"])
    g, sent = spark.createDataFrame(e).repartition(5), []
    collect = DataFrame.collect

    def counted(self):
        out = collect(self)
        if "s" in self.columns:
            sent.append(sum(len(r["s"]) for r in out))
        return out

    monkeypatch.setattr(DataFrame, "collect", counted)
    y = I.eigen_coords(g, 20_000, 2, rounds=3)
    assert len(sent) == 3 and set(sent) == {20_000 * 7 * 8} and y.count() == 20_000
