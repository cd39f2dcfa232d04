"""Which neighbour search: exact, trees, descent or a navigable graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import navigable
from skein.operators.descent import descend
from skein.operators.forest import forest_knn
from skein.operators.knn import knn, ranked
from skein.operators.tables import cut

EXACT_ROWS = 20_000
#: Where a product of matrices bounds the distances, exact search takes less time than descent far beyond that.
BOUNDED_ROWS = {"euclidean": 200_000, "sqeuclidean": 200_000, "manhattan": 100_000}
METHODS = ("auto", "fnn", "exact", "annoy", "nndescent", "hnsw")
#: What the searches by other names call their settings.
SETTINGS = {"n_trees": "trees", "leaf_size": "leaf", "n_iters": "rounds", "M": "degree", "ef_construction": "build", "max_search_fraction": "fraction"}
BUILD = {"annoy": ("trees", "leaf", "seed", "sample"), "nndescent": ("trees", "leaf", "rounds", "delta", "max_candidates", "width", "seed", "sample"), "hnsw": ("degree", "build", "seed", "sample")}
QUERY = {"annoy": ("search_k",), "nndescent": ("ef", "epsilon", "fraction"), "hnsw": ("ef", "fraction")}
GRAPH_METRICS = ("euclidean", "cosine", "correlation")


def chosen(n: int, method: str, metric: str, args: dict) -> tuple[str, dict, dict]:
    """(method, settings to build, settings to search): auto is exact up to EXACT_ROWS rows (BOUNDED_ROWS by metric) and descent beyond."""
    if method not in METHODS:
        raise ValueError(f"unknown nn_method {method!r}; known are {METHODS}")
    if method == "hnsw" and metric not in GRAPH_METRICS:
        raise ValueError(f"hnsw knows {GRAPH_METRICS}")
    own = ("fnn" if n <= BOUNDED_ROWS.get(metric, EXACT_ROWS) else "nndescent") if method == "auto" else "fnn" if method == "exact" else method
    args = {SETTINGS.get(x, x): v for x, v in args.items()}
    known = {*BUILD.get(own, ()), *QUERY.get(own, ())}
    if method not in ("auto", "fnn", "exact") and (strange := set(args) - known):
        raise ValueError(f"{method} has no settings {sorted(strange)}")
    pick = lambda names: {x: args[x] for x in names if x in args}
    return own, pick(BUILD.get(own, ())), pick(QUERY.get(own, ()))


def index_of(df: DataFrame, metric: str = "euclidean", method: str = "auto", **args) -> navigable.Graph | None:
    """What searches of new rows among df's share, to be built once; None where they need nothing."""
    own, build, _ = chosen(df.count(), method, metric, args)
    if own not in ("nndescent", "hnsw"):
        return None
    if own == "hnsw":
        return navigable.built(df, metric, **build)
    return navigable.built(df, metric, seed=build.pop("seed", 42), sample=build.pop("sample", 16_384), **{k: v for k, v in build.items() if k != "max_candidates"})


def neighbours(df: DataFrame, k: int, metric: str = "euclidean", method: str = "auto", query: DataFrame | None = None, index: navigable.Graph | None = None, **args) -> DataFrame:
    """(i, rank, j, d) of df's rows, or of query's among df's. index: of df, from index_of, instead of building one."""
    n = df.count()
    own, build, look = chosen(n, method, metric, args)
    if query is None and n < k:
        raise ValueError(f"n_neighbors must be at most the number of rows ({n})")
    if own == "fnn":
        return knn(df, k, metric, query)
    if own == "annoy":
        return forest_knn(df, k, metric, query=query, **build, **look)
    if own == "nndescent" and query is None:
        return descend(df, k, metric, **build).table
    index = index or index_of(df, metric, method, **args)
    look = {"ef": max(100, 2 * k)} | ({"epsilon": 0.1} if own == "nndescent" else {}) | look
    if query is not None:
        return navigable.search(index, query, k, **look)
    found = navigable.search(index, df, k, **look)
    rows = df.select(F.col("id").cast("long").alias("i"))
    return cut(ranked(found.select("i", "j", "d").where("i <> j").union(rows.select("i", F.col("i").alias("j"), F.lit(0.0))), k))
