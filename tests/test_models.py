"""Models: blocks with settings of their own, ragged lists, exports that are sources again, and placing that company does not change."""

import logging

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skein.operators import graph as G
from skein.operators import knn as K
from skein.plans import embed as E


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(120, 10)) + 4 * (np.arange(120) % 3)[:, None]
    return spark.createDataFrame(pd.DataFrame({"k": np.arange(120), **{f"f{c}": m[:, c] for c in range(10)}})).cache()


@pytest.fixture(scope="module")
def model(rows):
    return E.fit(rows.where("k < 100"), "k", E.Params(n_epochs=6, init="pca", n_neighbors=8))


def y_of(df):
    return np.stack(df.orderBy("key").toPandas().y)


@pytest.mark.parametrize("epochs", (0, 3))
def test_alone_and_in_company(rows, model, epochs):
    new = rows.where("k >= 100")
    all_at_once = {r.key: r.y for r in E.transform(model, new, "k", n_epochs=epochs, frozen=True).collect()}
    for k in (100, 113):
        alone = E.transform(model, new.where(F.col("k") == k), "k", n_epochs=epochs, frozen=True).first()
        assert np.allclose(alone.y, all_at_once[k], atol=1e-9)
    assert len(all_at_once) == 20


def test_mean_distance_is_the_training_rows(rows, model):
    """A row that lies on a training row has no gap, so its bandwidth is bounded by the mean distance of all."""
    assert model.frozen["means"] == [pytest.approx(model.nn.agg(F.avg("d")).first()[0])]


def test_starts(rows, model, caplog, spark):
    new = rows.where("k >= 100")
    start = new.select(F.col("k").alias("key"), F.array(F.lit(3.0), F.col("k") / 100.0).alias("y"))
    placed = E.transform(model, new, "k", n_epochs=0, start=start)
    assert np.allclose(y_of(placed), [[3.0, k / 100] for k in range(100, 120)])
    ids = spark.range(100)
    good = ids.select("id", F.array(F.col("id") * 1.0, F.col("id") * 1.0).alias("y"))
    for bad in (good.where("id > 3"), ids.select("id", F.array(F.lit(1.0)).alias("y")), good.withColumn("y", F.array(F.lit(float("nan")), F.lit(0.0))), good.union(good.where("id = 1"))):
        with pytest.raises(ValueError, match="start"):
            E.fit(rows.where("k < 100"), "k", E.Params(n_epochs=1, n_neighbors=8), nn=model.nn, start=bad)
    with caplog.at_level(logging.WARNING, "skein"):
        E.fit(rows.where("k < 100"), "k", E.Params(n_epochs=1, n_neighbors=8), nn=model.nn, start=good)
    assert "spread" in caplog.text


def test_blocks_have_their_own_settings(rows, spark, tmp_path):
    blocks = [{"metric": "euclidean", "cols": [f"f{c}" for c in range(6)], "pca": 3}, {"metric": "euclidean", "cols": [f"f{c}" for c in range(6, 10)], "pca": 2, "pca_center": False}]
    m = E.fit(rows.where("k < 100"), "k", E.Params(n_epochs=4, init="pca", n_neighbors=8, metric=blocks))
    assert [b["pca"]["rotation"].shape for b in m.blocks] == [(6, 3), (4, 2)]
    x = rows.where("k < 100").toPandas()[[f"f{c}" for c in range(6, 10)]].to_numpy()
    assert np.allclose(np.stack(m.rows.orderBy("id").toPandas().x1), x @ m.blocks[1]["pca"]["rotation"]) and not m.blocks[1]["pca"]["center"].any()
    assert set(m.neighbours_by_block()) == {"euclidean", "euclidean_1"}
    m.save(str(tmp_path / "m"))
    again = E.load(spark, str(tmp_path / "m"))
    new = rows.where("k >= 100")
    assert np.allclose(y_of(E.transform(m, new, "k")), y_of(E.transform(again, new, "k")))
    with pytest.raises(ValueError, match="settings"):
        E.fit(rows, "k", E.Params(metric=[{"metric": "euclidean", "cols": ["f0"], "colour": 1}]))
    # what was saved is a source again: neighbours of every block give the graph, the pruned graph gives the coordinates
    own = again.neighbours_by_block()
    g = E.similarity_graph(rows.where("k < 100"), "k", again.params, nn=[own["euclidean"], own["euclidean_1"]])
    assert g.graph.count() == m.graph.count()
    coords, _, _ = E.optimize_graph_layout(again.pruned, 100, again.params, again.rows.selectExpr("id", "x0 as x"))
    a, b = (np.stack(t.orderBy("id").toPandas().y) for t in (coords, m.embedding))
    assert np.allclose(a, b, atol=1e-6)
    assert again.pruned.count() < again.graph.count() and again.pruned.agg(F.min("w")).first()[0] >= m.graph.agg(F.max("w")).first()[0] / 4


def test_ragged_lists(rows, model):
    full = model.nn.where("i <> j")
    ragged = full.where("rank <= 3 + i % 5")
    table, with_self = E.lists(ragged)
    assert not with_self and E.lists(model.nn)[1]
    w = G.smooth(table, skip_first=False)
    sums = w.groupBy("i").agg(F.sum("w").alias("s"), F.count("*").alias("m")).toPandas()
    assert np.allclose(sums.s, np.log2(sums.m + 1), atol=1e-4)
    assert w.where("d = rho and w <> 1").count() == 0  # the nearest counts
    # lists of one length without their own row calibrate as those with it
    a, b = (E.graph_of(t, E.Params(n_neighbors=8)).graph.orderBy("i", "j").toPandas() for t in (full, model.nn))
    assert a[["i", "j"]].equals(b[["i", "j"]]) and np.allclose(a.w, b.w, atol=1e-4)


def test_fits_over_kept_graphs(rows, spark, tmp_path):
    p = E.Params(n_epochs=2, init="pca", n_neighbors=6, nn_method="hnsw", nn_args={"ef": 60, "M": 8})
    m = E.fit(rows.where("k < 100"), "k", p)
    new = rows.where("k >= 100")
    first = y_of(E.transform(m, new, "k", n_epochs=0))
    assert list(m.indexes) == [0]
    m.save(str(tmp_path / "m"))
    again = E.load(spark, str(tmp_path / "m"))
    assert list(again.indexes) == [0] and np.allclose(y_of(E.transform(again, new, "k", n_epochs=0)), first)
    exact = E.fit(rows.where("k < 100"), "k", E.Params(n_epochs=2, init="pca", n_neighbors=6))
    assert K.overlap(exact.nn, m.nn, 6).first()[0] > 0.99


def test_distances_start_from_scaling(spark):
    x = [(i, float(i % 10), float(i // 10)) for i in range(40)]
    d = [(i, j, ((a - c) ** 2 + (b - e) ** 2) ** 0.5) for i, a, b in x for j, c, e in x if i != j]
    pairs = spark.createDataFrame(d, "i long, j long, d double")
    m = E.fit_distances(pairs, E.Params(n_epochs=0, n_neighbors=5, init="mds"))
    y = np.stack(m.embedding.orderBy("id").toPandas().y)
    assert np.corrcoef(np.sqrt(((y[:, None] - y[None]) ** 2).sum(2)).ravel()[::7], np.array([[((a - c) ** 2 + (b - e) ** 2) ** 0.5 for _, c, e in x] for _, a, b in x]).ravel()[::7])[0, 1] > 0.99
