"""Graph and layout operators against published small examples, invariants, and the other engine's SQL."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from skein.operators import graph as G
from skein.operators import init as I
from skein.operators import knn as K
from skein.operators import layout as L
from skein.operators import scaling as S
from skein.plans import embed as E
from skein.plans import queries as P

#: Ten rows of the iris table.
IRIS = [(5.1, 3.5, 1.4, 0.2), (4.9, 3.0, 1.4, 0.2), (4.7, 3.2, 1.3, 0.2), (4.6, 3.1, 1.5, 0.2), (5.0, 3.6, 1.4, 0.2), (5.4, 3.9, 1.7, 0.4), (4.6, 3.4, 1.4, 0.3), (5.0, 3.4, 1.5, 0.2), (4.4, 2.9, 1.4, 0.2), (4.9, 3.1, 1.5, 0.1)]
SIGMA = [0.1799, 0.2049, 0.0494, 0.0906, 0.2494, 0.0039, 0.1537, 0.1355, 0.2454, 0.2063]
RHO = [0.1414, 0.1732, 0.2449, 0.2449, 0.1414, 0.6164, 0.2646, 0.1732, 0.3000, 0.1732]


@pytest.fixture(scope="module")
def iris(spark):
    return spark.createDataFrame([(i, list(x)) for i, x in enumerate(IRIS)], "id long, x array<double>").cache()


def test_neighbours_and_calibration(iris):
    t = K.knn(iris, 4)
    d = t.toPandas().sort_values(["i", "rank"]).d.to_numpy().reshape(10, 4)
    assert np.allclose(d[0], [0, 0.1414214, 0.1732051, 0.4690416], atol=1e-6)
    s = G.vertex_stats(G.smooth(t)).toPandas().sort_values("i")
    assert np.allclose(s.sigma, SIGMA, atol=1e-4) and np.allclose(s.rho, RHO, atol=1e-4)
    g = G.fuzzy(G.smooth(t)).toPandas()
    assert len(g) == 42 and ((g.w > 0) & (g.w <= 1)).all() and (g.i != g.j).all()
    m = g.pivot(index="i", columns="j", values="w").fillna(0).to_numpy()
    assert np.allclose(m, m.T)


def test_perplexity_goldens(iris):
    p = G.perplexity(K.knn(iris, 10), 4.0)
    s = p.select("i", "sigma").distinct().toPandas().sort_values("i").sigma
    assert np.allclose(s, [0.3252, 0.2680, 0.1817, 0.1751, 0.3280, 0.4861, 0.2463, 0.2423, 0.3463, 0.2412], atol=1e-3)
    kernel = G.knn_kernel(K.knn(iris, 4)).toPandas()
    assert np.isclose(kernel.w.sum(), 10)


def test_curve():
    assert np.allclose(L.find_ab(1, 0.001), (1.929, 0.792), atol=1e-3) and np.allclose(L.find_ab(1, 0.1), (1.577, 0.895), atol=1e-3)


def test_components(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (3, 4, 1.0)], "i long, j long, w double")
    assert [r.component for r in G.components(e).orderBy("id").collect()] == [0, 0, 0, 1, 1]


def test_pca_and_scaling(iris, spark):
    x = np.array(IRIS)
    got = np.stack(S.apply_pca(iris, S.fit_pca(iris, 2)).orderBy("id").toPandas().x)
    u, d, vt = np.linalg.svd(x - x.mean(0))
    ref = (x - x.mean(0)) @ vt[:2].T
    assert np.allclose(np.abs(got), np.abs(ref), atol=1e-8)
    flat = spark.createDataFrame([(1.0, 5.0, "a"), (3.0, 5.0, "b")], "a double, b double, c string")
    assert S.numeric_columns(flat) == ["a", "b"]
    assert S.apply_scale(flat, S.fit_scale(flat, ["a", "b"], "z")).columns == ["a", "c"]
    with pytest.raises(ValueError, match="no numeric"):
        S.numeric_columns(flat.select("c"))


@pytest.fixture(scope="module")
def mixture(spark):
    rng = np.random.default_rng(42)
    c = rng.normal(size=(4, 8)) * 3
    x = np.concatenate([c[i] + rng.normal(size=(40, 8)) * 0.2 for i in range(4)])
    return spark.createDataFrame(pd.DataFrame(x, columns=[f"f{i}" for i in range(8)]).assign(k=np.arange(160))).cache()


def test_fit_save_load_transform(mixture, spark, tmp_path):
    seen = []
    m = E.fit(mixture, "k", E.Params(n_epochs=6, init="pca", n_neighbors=10), callback=lambda t, n, y: seen.append(t))
    y = np.stack(m.embedding.orderBy("key").toPandas().y)
    assert seen == [1, 2, 3, 4, 5, 6] and np.allclose(y.mean(0), 0, atol=1e-9)
    near = ((y[:, None] - y[None]) ** 2).sum(-1).argsort(1)[:, 1:8]
    assert (near // 40 == np.arange(160)[:, None] // 40).mean() > 0.95
    again = E.fit(mixture.repartition(7), "k", E.Params(n_epochs=6, init="pca", n_neighbors=10))
    assert np.allclose(np.stack(again.embedding.orderBy("key").toPandas().y), y, atol=1e-6)
    m.save(str(tmp_path / "m"))
    with pytest.raises(Exception):
        m.save(str(tmp_path / "m"))
    new = E.transform(E.load(spark, str(tmp_path / "m")), mixture.where("k % 10 = 0"), "k", n_epochs=0)
    assert new.count() == 16
    with pytest.raises(ValueError, match="columns that are not there"):
        E.transform(m, mixture.drop("f0"), "k")
    m.unload()
    with pytest.raises(ValueError, match="unloaded"):
        E.transform(m, mixture, "k")


def test_errors(mixture):
    for args, words in (({"n_neighbors": 1}, "n_neighbors"), ({"set_op_mix_ratio": 2}, "set_op_mix_ratio"), ({"local_connectivity": 0.5}, "local_connectivity"), ({"n_components": 0}, "n_components"), ({"pca": 1}, "pca has to leave")):
        with pytest.raises(ValueError, match=words):
            E.umap(mixture, "k", **args)


def test_size_does_not_change_results(mixture, monkeypatch):
    p = E.Params(n_epochs=4, n_neighbors=10, optimizer="adam")
    small = E.fit(mixture, "k", p)
    new = mixture.where("k % 8 = 0")
    placed = E.transform(small, new, "k", n_epochs=3)
    y, z = (np.stack(d.orderBy("key").toPandas().y) for d in (small.embedding, placed))
    start = {w: I.eigen_coords(small.graph, 160, 2, walk=w, rounds=4).orderBy("id").toPandas().y for w in (False, True)}
    for module in (L, I):
        monkeypatch.setattr(module, "BROADCAST_CELLS", 0)
    for w, s in start.items():
        assert np.allclose(np.stack(I.eigen_coords(small.graph, 160, 2, walk=w, rounds=4).orderBy("id").toPandas().y), np.stack(s), atol=1e-6)
    rows = small.rows.selectExpr("id", "x0 as x")
    start = I.initial("pca", small.graph, rows, 160, 2)
    many = L.optimize(start, edges_of(small, 3), 3).orderBy("id").toPandas().y
    monkeypatch.setattr(L, "BROADCAST_CELLS", 10**7)
    few = L.optimize(start, edges_of(small, 3), 3).orderBy("id").toPandas().y
    assert np.allclose(np.stack(many), np.stack(few), atol=1e-9)
    monkeypatch.setattr(L, "BROADCAST_CELLS", 0)
    assert np.allclose(np.stack(E.transform(small, new, "k", n_epochs=3).orderBy("key").toPandas().y), z, atol=1e-9)


def edges_of(m, epochs):
    return L.number_edges(L.epochs_per_sample(G.prune(m.graph, epochs)))


def test_neighbours_and_graphs_of_new_rows(mixture, spark, tmp_path):
    m = E.fit(mixture, "k", E.Params(n_epochs=2, init="pca", n_neighbors=10))
    new = mixture.where("k % 10 = 0")
    x = m.rows.selectExpr("id", "x0 as x")
    nn = K.knn(x, 10, query=new.selectExpr("cast(k / 10 as long) as id", "array(f0, f1, f2, f3, f4, f5, f6, f7) as x"))
    a, b = (np.stack(E.transform(m, new, "k", n_epochs=0, **args).orderBy("key").toPandas().y) for args in ({}, {"nn": [nn]}))
    assert np.allclose(a, b)
    g = E.transform(m, new, "k", graph=True)
    assert g.columns == ["i", "j", "w"] and g.select("i").distinct().count() == 16 and g.where("w <= 0 or w > 1").count() == 0
    with pytest.raises(ValueError, match="blocks"):
        E.transform(m, new, "k", nn=[nn, nn])
    g = E.graph_of(m.nn, E.Params(n_epochs=2, init="random", n_neighbors=10))
    assert g.graph.count() == m.graph.count()
    laid = E.laid_out(g)
    assert laid.embedding.count() == 160
    laid.save(str(tmp_path / "n"))
    assert E.load(spark, str(tmp_path / "n")).graph.count() == m.graph.count()


def test_zero_distances_of_whole_tables(spark):
    d = spark.createDataFrame([(i, j, float(abs(i // 2 - j // 2))) for i in range(6) for j in range(6) if i != j], "i long, j long, d double")
    assert K.knn_from_distances(d, 2, zeros=True).where("rank = 2 and d = 0").count() == 6
    assert K.knn_from_distances(d, 2).where("rank = 2 and d = 1").count() == 6


@pytest.mark.parametrize("name", sorted(P.SQL))
def test_other_engine_agrees(spark, sf, name):
    con = duckdb.connect()
    for t in ("part", "customer", "supplier", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    a, b = P.QUERIES[name](spark, sf).toPandas(), con.execute(P.SQL[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns) and len(a) == len(b)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
    assert all((a[c] == b[c]).all() for c in cols)


def test_precomputed_neighbours_and_chaining(mixture, spark):
    p = E.Params(n_epochs=4, init="pca", n_neighbors=10)
    m = E.fit(mixture, "k", p)
    g = E.similarity_graph(mixture, "k", p, nn=m.nn)
    coords, epochs, _ = E.optimize_graph_layout(g.graph, 160, p, g.rows.selectExpr("id", "x0 as x"))
    a, b = (np.stack(x.orderBy("id").toPandas().y) for x in (coords, m.embedding))
    assert epochs == 4 and np.allclose(a, b, atol=1e-6)
    with pytest.raises(ValueError, match="ids go from"):
        K.check_knn(m.nn.selectExpr("i", "rank", "j + 1000 as j", "d"), 160)


def test_stream(mixture, spark, tmp_path):
    from skein.streaming.project import project_stream

    m = E.fit(mixture, "k", E.Params(n_epochs=2, init="pca", n_neighbors=10))
    mixture.limit(20).write.parquet(str(tmp_path / "in"))
    seen = []
    q = project_stream(spark.readStream.schema(mixture.schema).parquet(str(tmp_path / "in")), m, "k", lambda df, n: seen.append(df.count()), str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    assert sum(seen) == 20


def test_sources(iris, spark):
    from skein.sources import inputs

    full = K.knn(iris, 10).select("i", "j", "d")
    half = inputs.distance_table(full.where("i < j"), 4).orderBy("i", "rank").collect()
    assert [(r.i, r.j) for r in half] == [(r.i, r.j) for r in inputs.distance_table(full.where("i <> j"), 4).orderBy("i", "rank").collect()]
    named = K.knn(iris, 4).selectExpr("i", "rank", "j as `index`", "d as distance")
    assert inputs.neighbour_table(named, 10).columns == ["i", "rank", "j", "d"]
    with pytest.raises(ValueError, match="symmetric"):
        inputs.graph_table(spark.createDataFrame([(0, 1, 1.0)], "i long, j long, w double"))
    with pytest.raises(ValueError, match="distance"):
        K.knn(iris, 4, "nonsense")
    with pytest.raises(ValueError, match="missing"):
        inputs.feature_table(spark.createDataFrame([(1, 1.0), (2, None)], "k long, a double"), "k")
