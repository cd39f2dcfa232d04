"""Approximate neighbour searches: recall, settings, odd rows, and graphs that are kept."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skein.operators import descent, forest, navigable, search
from skein.operators import knn as K
from skein.operators.knn import knn, overlap
from skein.plans import queries as Q


def table(spark, n, dim, seed=0, shift=0.0):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "x": (rng.normal(size=(n, dim)) + shift).tolist()}), "id long, x array<double>").repartition(6).cache()


@pytest.fixture(scope="module")
def cloud(spark):
    return table(spark, 4000, 16)


@pytest.fixture(scope="module")
def asked(cloud):
    return cloud.where("id % 40 = 0").cache()


@pytest.fixture(scope="module")
def exact(cloud, asked):
    return knn(cloud, 10, query=asked).cache()


def test_descent_keeps_its_recall(cloud, exact):
    """Also where the first level's sample is one row in 300, so that planes of later levels part the rows; distances stay few."""
    d = descent.descend(cloud, 10, sample=20, rounds=9)
    assert overlap(exact, d.table, 10).first()[0] > 0.95
    assert sum(d.measured) / 4000 < 5000 and d.rounds < 9 and d.measured[-1] < d.measured[0]
    assert d.table.groupBy("i").count().where("count <> 10").count() == 0 and d.table.where("rank = 1 and i <> j").count() == 0
    few = descent.descend(cloud, 10, rounds=1, trees=2)
    assert few.rounds == 1 and overlap(exact, few.table, 10).first()[0] < overlap(exact, d.table, 10).first()[0]


def test_descent_of_other_metrics(spark):
    x = table(spark, 600, 8, 1, 0.3)
    for metric in ("cosine", "manhattan", "correlation"):
        assert overlap(knn(x, 8, metric), descent.descend(x, 8, metric).table, 8).first()[0] > 0.97


def test_descent_does_not_depend_on_partitions(cloud):
    x = cloud.where("id < 1500")
    one, two = (descent.descend(x.repartition(p), 8).table.orderBy("i", "rank").toPandas() for p in (1, 5))
    assert one[["i", "j"]].equals(two[["i", "j"]])


def test_leaves_outgrow_no_sample(cloud):
    f = forest.grow(cloud, trees=2, leaf=20, sample=100)
    assert f.levels and f.rows.groupBy("tree", "node", "part").count().agg(F.max("count")).first()[0] <= 80
    assert f.rows.groupBy("tree").count().where("count <> 4000").count() == 0


def test_best_first_search(cloud, asked, exact):
    """More rows looked at, more neighbours found; too few are an error; the share of rows that find themselves is told."""
    f = forest.grow(cloud, trees=10, leaf=20, sample=500)
    found = {k: forest.search(f, asked, 10, k).cache() for k in (100, 400, 3000)}
    got = [overlap(exact, K.ranked(t, 10, False), 10).first()[0] for t in found.values()]
    assert got[0] < got[1] < got[2] and got[2] > 0.95
    assert forest.self_hits(found[3000]) == 1.0
    looked = forest.asked_leaves(f, asked, 400).groupBy("i").agg(F.sum("budget").alias("n"))
    # a node that was split further overshoots by a leaf of its own
    assert looked.where("n < 400 or n > 400 + 80 + 20 * 80").count() == 0
    with pytest.raises(ValueError, match="search_k"):
        forest.forest_knn(cloud, 60, trees=1, leaf=8, search_k=1, query=asked)
    assert overlap(exact, search.neighbours(cloud, 10, method="annoy", n_trees=10, search_k=3000).where("i % 40 = 0"), 10).first()[0] > 0.9


def test_equal_rows(spark):
    """A third and more of equal rows: no leaf holds them all, and all get neighbours at no distance."""
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(900)] + [(900 + i, [float(i), 0.0, 1.0]) for i in range(300)]
    x = spark.createDataFrame(rows, "id long, x array<double>").repartition(3)
    f = forest.grow(x, trees=2, leaf=16)
    assert f.rows.groupBy("tree", "node", "part").count().agg(F.max("count")).first()[0] < 200
    for method, args in (("nndescent", {}), ("annoy", {"n_trees": 4})):
        t = search.neighbours(x, 5, method=method, **args)
        assert t.where("i < 900 and d > 0").count() == 0 and t.groupBy("i").count().where("count <> 5").count() == 0


def test_navigable_graph(cloud, asked, exact, spark, tmp_path):
    g = navigable.built(cloud, degree=8, build=100)
    assert g.nodes.where("size(links) > 16").count() == 0
    got = [overlap(exact, navigable.search(g, asked, 10, ef=ef), 10).first()[0] for ef in (10, 100)]
    assert got[0] < got[1] and got[1] > 0.95
    g.save(str(tmp_path / "g"))
    again = navigable.load(spark, str(tmp_path / "g"))
    a, b = (navigable.search(x, asked, 10, ef=40).orderBy("i", "rank").collect() for x in (g, again))
    assert a == b
    # a small part of the rows may be visited: fewer are found
    assert overlap(exact, navigable.search(g, asked, 10, ef=100, fraction=0.005), 10).first()[0] < got[1]
    near = navigable.search(g, asked, 10, ef=100, epsilon=0.0)
    assert near.groupBy("i").count().where("count <> 10").count() == 0
    assert navigable.search(g, asked.where("false"), 10).count() == 0


def test_links_hide_what_lies_behind(spark):
    """On a line, each row keeps only the next one on each side."""
    x = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(60)], "id long, x array<double>")
    g = navigable.built(x, degree=4)
    links = {r.id: list(r.links) for r in g.nodes.collect()}
    assert all(v == [j for j in (i - 1, i + 1) if 0 <= j < 60] for i, v in links.items())


def test_choice_and_settings(spark):
    assert search.chosen(100, "auto", "euclidean", {})[0] == "fnn" and search.chosen(30_000, "auto", "tsss", {})[0] == "nndescent"
    assert search.chosen(9, "hnsw", "cosine", {"M": 4, "ef": 9}) == ("hnsw", {"degree": 4}, {"ef": 9})
    for args in (("hnsw", "manhattan", {}), ("annoy", "euclidean", {"ef": 3}), ("nothing", "euclidean", {})):
        with pytest.raises(ValueError):
            search.chosen(9, *args)
    x = table(spark, 10, 4)
    for method in ("annoy", "nndescent", "hnsw"):
        a, b = (search.neighbours(x, 4, method=m).orderBy("i", "rank").toPandas() for m in (method, "fnn"))
        assert (a.j == b.j).all() and np.allclose(a.d, b.d)
        with pytest.raises(ValueError):
            search.neighbours(x, 11, method=method)


@pytest.mark.parametrize("name, method, asked", [("ann_knn", "nndescent", False), ("annoy_knn", "annoy", False), ("annoy_query", "annoy", True)])
def test_registered_searches_are_whole(spark, sf, monkeypatch, name, method, asked):
    """Their SQL is exact, also where the search itself misses neighbours."""
    poor = {"nndescent": {"rounds": 1, "trees": 1, "leaf_size": 20, "max_candidates": 2}, "annoy": {"n_trees": 2, "search_k": 60}}[method]
    real = search.neighbours
    monkeypatch.setattr(search, "neighbours", lambda df, k, method, query=None, **args: real(df, k, method=method, query=query, **poor))
    x = Q.vectors(spark, sf)
    want = Q.same(knn(x, Q.N, query=x.where("id % 100 = 0") if asked else None)).orderBy("i", "rank").collect()
    assert overlap(knn(x, Q.N), real(x, Q.N, method=method, **poor), Q.N).first()[0] < 0.95
    assert Q.QUERIES[name](spark, sf).orderBy("i", "rank").collect() == want


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_small_forests_are_searched_without_shuffles(cloud, asked, monkeypatch, metric):
    """A row's vector does not travel to each leaf it visits; what is found is the same."""
    f = forest.grow(cloud, metric, trees=4, leaf=20)
    here = forest.search(f, asked, 10, 300)
    assert "CoGroups" not in here._jdf.queryExecution().toString()
    monkeypatch.setattr(forest, "BROADCAST_CELLS", 0)
    apart = forest.search(f, asked, 10, 300)
    assert "CoGroups" in apart._jdf.queryExecution().toString()
    a, b = (K.ranked(t, 10, False).orderBy("i", "rank").toPandas() for t in (here, apart))
    assert len(a) == 1000 and a[["i", "rank", "j"]].equals(b[["i", "rank", "j"]]) and np.allclose(a.d, b.d, atol=1e-12)


def test_bounded_metrics_are_searched_exactly_for_longer():
    assert [search.chosen(n, "auto", m, {})[0] for n, m in ((150_000, "euclidean"), (90_000, "manhattan"), (250_000, "euclidean"), (150_000, "canberra"))] == ["fnn", "fnn", "nndescent", "nndescent"]


def test_rows_are_packed_once(spark):
    """Not once for each block they meet."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    x = table(spark, 9000, 4).select("id", "x").mapInArrow(counted, "id long, x array<double>")
    assert knn(x, 5).count() == 45_000
    assert seen.value <= 2 * 9000  # counted, and packed
