"""umap, umap2, tumap, lvish and their parts: from a table of rows to a graph, to coordinates, and to a model that places new rows."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import graph as G
from skein.operators import init as I
from skein.operators import layout as L
from skein.operators.knn import check_knn, knn_from_distances, knn_sparse
from skein.operators import navigable
from skein.operators.components import classical_scaling
from skein.operators.scaling import apply_pca, apply_scale, fit_pca, fit_scale, numeric_columns
from skein.operators.search import index_of, neighbours
from skein.operators.tables import check_complete, cut, number
from skein.sources.inputs import graph_table

log = logging.getLogger("skein")


@dataclass
class Params:
    method: str = "umap"
    n_neighbors: int = 15
    n_components: int = 2
    metric: str | dict | list = "euclidean"  # {metric: columns}, or blocks {metric, cols, pca, pca_center}; `categorical` names labels
    n_epochs: int | None = None
    learning_rate: float = 1.0
    scale: str = "none"
    init: str = "spectral"
    init_sdev: float | str | None = None
    spread: float = 1.0
    min_dist: float = 0.01
    set_op_mix_ratio: float = 1.0
    local_connectivity: float = 1.0
    bandwidth: float = 1.0
    repulsion_strength: float = 1.0
    negative_sample_rate: float = 5.0
    a: float | None = None
    b: float | None = None
    nn_method: str = "auto"
    nn_args: dict = field(default_factory=dict)  # settings of the approximate search
    perplexity: float = 50.0
    kernel: str = "gauss"
    pca: int | None = None
    pca_center: bool = True
    target_n_neighbors: int | None = None
    target_metric: str = "euclidean"
    target_weight: float = 0.5
    dens_scale: float | None = None
    binary_edge_weights: bool = False
    optimizer: str = "adam"
    opt_args: dict = field(default_factory=dict)
    seed: int = 42

    def check(self) -> None:
        for ok, message in (
            (self.n_neighbors >= 2, "n_neighbors is at least 2"),
            (self.n_components >= 1 and int(self.n_components) == self.n_components, "n_components must be a positive integer"),
            (0 <= self.set_op_mix_ratio <= 1, "set_op_mix_ratio lies from 0 to 1"),
            (self.local_connectivity >= 1, "local_connectivity is at least 1"),
            (self.pca is None or self.pca >= self.n_components, "pca has to leave at least n_components dimensions"),
            (self.optimizer in ("adam", "sgd"), "optimizer must be adam or sgd"),
            (self.method in ("umap", "tumap", "largevis", "leopold"), "unknown method"),
            (self.dens_scale is None or 0 <= self.dens_scale <= 1, "dens_scale must be between 0 and 1"),
        ):
            if not ok:
                raise ValueError(message)


TABLES = ("embedding", "rows", "nn", "graph", "pruned", "stats", "ai")


@dataclass
class Model:
    params: Params
    cols: list[str]
    blocks: list[dict]  # metric, cols, scale, pca
    rows: DataFrame | None  # id, key, and the blocks' vectors
    embedding: DataFrame  # id, key, y
    n_epochs: int
    nn: DataFrame | None = None
    graph: DataFrame | None = None
    stats: DataFrame | None = None
    radii: dict | None = None
    ai: DataFrame | None = None
    blocks_nn: list[DataFrame] = field(default_factory=list)  # a neighbour table for each block; nn is the first
    pruned: DataFrame | None = None  # the graph without edges too light for n_epochs
    frozen: dict = field(default_factory=dict)  # mean neighbour distance of each block, for rows placed one by one
    indexes: dict[int, navigable.Graph] = field(default_factory=dict)  # of a block's rows, built when new rows are first searched
    loaded: bool = True

    def neighbours_by_block(self) -> dict[str, DataFrame]:
        """Neighbour tables by metric; blocks that share one are numbered from the second on."""
        names, out = [b["metric"] for b in self.blocks] or ["given"] * len(self.blocks_nn), {}
        for k, (name, table) in enumerate(zip(names, self.blocks_nn)):
            out[name if name not in out else f"{name}_{k}"] = table
        return out

    def index(self, block: int) -> navigable.Graph | None:
        if block not in self.indexes:
            made = index_of(self.rows.select("id", F.col(f"x{block}").alias("x")), self.blocks[block]["metric"], self.params.nn_method, **self.params.nn_args)
            if made is None:
                return None
            self.indexes[block] = made
        return self.indexes[block]

    def save(self, path: str) -> None:
        """Parquet tables and a line of JSON; an existing path is an error."""
        self._ready()
        spark = self.embedding.sparkSession
        arrays = lambda m: None if m is None else {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in m.items()}
        tables = {name: df for name in TABLES if (df := getattr(self, name)) is not None} | {f"nn{k}": df for k, df in enumerate(self.blocks_nn[1:], 1)}
        meta = {"params": vars(self.params), "cols": self.cols, "n_epochs": self.n_epochs, "radii": self.radii, "blocks": [b | {"pca": arrays(b["pca"])} for b in self.blocks], "tables": list(tables), "frozen": self.frozen, "indexes": list(self.indexes)}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("errorifexists").parquet(f"{path}/meta")
        for name, df in tables.items():
            df.write.mode("errorifexists").parquet(f"{path}/{name}")
        for block, index in self.indexes.items():
            index.save(f"{path}/index{block}")

    def unload(self) -> None:
        """Releases what is held in memory; the model cannot be used afterwards. A second call does nothing."""
        for df in (self.rows, self.embedding, self.graph, *self.blocks_nn):
            if df is not None:
                df.unpersist()
        self.loaded = False

    def _ready(self) -> None:
        if not self.loaded:
            raise ValueError("the model is unloaded")


def load(spark: SparkSession, path: str) -> Model:
    meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
    blocks = [b | {"pca": None if b["pca"] is None else {k: np.array(v) if isinstance(v, list) else v for k, v in b["pca"].items()}} for b in meta["blocks"]]
    read = lambda name: spark.read.parquet(f"{path}/{name}") if name in meta["tables"] else None
    tables = {name: read(name) for name in TABLES}
    more = [read(name) for name in sorted(x for x in meta["tables"] if x[:2] == "nn" and x != "nn")]
    indexes = {k: navigable.load(spark, f"{path}/index{k}") for k in meta["indexes"]}
    return Model(Params(**meta["params"]), meta["cols"], blocks, n_epochs=meta["n_epochs"], radii=meta["radii"], blocks_nn=[tables["nn"], *more] if tables["nn"] is not None else [], frozen=meta["frozen"], indexes=indexes, **tables)


def with_ids(df: DataFrame, key: str) -> DataFrame:
    """df with id from 0 in the order of key."""
    return number(df, [key], "id")


def _blocks(df: DataFrame, p: Params, skip: tuple[str, ...]) -> tuple[list[dict], list[str]]:
    """Numeric blocks, each with its metric and its setting of principal components, and categorical columns."""
    if isinstance(p.metric, str):
        given = [{"metric": p.metric, "cols": numeric_columns(df, skip)}]
    elif isinstance(p.metric, dict):
        given = [{"metric": m} | (x if isinstance(x, dict) else {"cols": list(x)}) for m, x in p.metric.items()]
    else:
        given = [dict(x) for x in p.metric]
    categorical = [c for b in given if b["metric"] == "categorical" for c in b["cols"]]
    blocks = []
    for b in given:
        if b["metric"] != "categorical":
            own = {"metric": b["metric"], "cols": [c for c in b["cols"] if c not in categorical], "n_pca": b.get("pca", p.pca), "pca_center": b.get("pca_center", p.pca_center)}
            if strange := set(b) - {*own, "pca"}:
                raise ValueError(f"a block has no settings {sorted(strange)}")
            blocks.append(own)
    if not blocks:
        raise ValueError("at least one block of numeric columns is needed")
    return blocks, categorical


def _vectors(df: DataFrame, block: dict, name: str) -> DataFrame:
    out = apply_scale(df.select("id", *block["cols"]), block["scale"])
    out = out.select("id", F.array(*[F.col(c).cast("double") for c in block["scale"]["cols"]]).alias("x"))
    return (apply_pca(out, block["pca"]) if block["pca"] else out).select("id", F.col("x").alias(name))


def default_epochs(p: Params, n: int, g: DataFrame) -> int:
    if p.n_epochs is not None and p.n_epochs >= 0:
        return p.n_epochs
    if p.method == "largevis":
        one = g.agg(F.max("w").alias("m"), F.sum("w").alias("s")).first()
        thousands = 1000 if n < 10_000 else 1000 + 9000 * (n - 10_000) / 990_000 if n < 1_000_000 else n / 100
        return int(round(1e6 * thousands * one["m"] / one["s"]))
    return 500 if n <= 10_000 else 200


def lists(nn: DataFrame) -> tuple[DataFrame, bool]:
    """A given table's neighbours, and whether every row comes first in its own list. Where some do not, lists are without their rows
    and may have any length: all of their neighbours then count in the calibration, towards log2(neighbours + 1)."""
    own = nn.groupBy("i").agg(F.max((F.col("i") == F.col("j")).cast("int")).alias("own")).agg(F.min("own")).first()[0]
    return (nn, True) if own else (nn.where("i <> j"), False)


def _weights(nn: DataFrame, p: Params, with_self: bool = True) -> tuple[DataFrame, DataFrame | None]:
    if p.method == "largevis":
        if p.kernel == "knn":
            return G.knn_kernel(nn), None
        w = G.perplexity(nn, p.perplexity)
        return G.symmetrize(w), w.groupBy("i").agg(F.first("sigma").alias("sigma"), F.first("dint").alias("dint"))
    w = cut(G.smooth(nn, p.local_connectivity, p.bandwidth, with_self))
    return G.fuzzy(w, p.set_op_mix_ratio), G.vertex_stats(w)


def mean_distance(nn: DataFrame) -> float:
    return nn.agg(F.avg("d")).first()[0] or 0.0


def supervise(g: DataFrame, rows: DataFrame, y: str | list[str], p: Params) -> DataFrame:
    """y: names of target columns; numeric ones make a graph of their own, others are labels, one after another."""
    names, kinds = ([y] if isinstance(y, str) else list(y)), dict(rows.dtypes)
    numeric = [c for c in names if kinds[c] in ("double", "float", "int", "bigint", "long", "smallint") and not c.endswith("_cat")]
    labels = [c for c in names if c not in numeric]
    label = lambda c: rows.select("id", F.col(c).cast("string").alias("label"))
    if numeric:
        check_complete(rows, numeric, "numeric y")
        target = rows.select("id", F.array(*[F.col(c).cast("double") for c in numeric]).alias("x"))
        yg = G.fuzzy(G.smooth(neighbours(target, p.target_n_neighbors or p.n_neighbors, p.target_metric, p.nn_method)))
        for c in labels:
            yg = G.categorical_intersection(yg, label(c), 0.5)
        return G.intersect(g, cut(yg), p.target_weight, reset=False)
    for c in labels:
        g = cut(G.categorical_intersection(g, label(c), p.target_weight))
    return g


def similarity_graph(df: DataFrame, key: str, p: Params | None = None, y: str | list[str] | None = None, nn: DataFrame | list[DataFrame] | None = None) -> Model:
    """The graph only: a model without coordinates. nn: neighbour tables to use instead of searching, for the first blocks or for all of them
    (ids from 0 in the order of key)."""
    p = p or Params()
    p.check()
    targets = () if y is None else (y,) if isinstance(y, str) else tuple(y)
    rows = cut(with_ids(df, key))
    blocks, categorical = _blocks(df, p, (key, *targets))
    cols = sorted({c for b in blocks for c in b["cols"]})
    check_complete(df, cols, "data")
    n = rows.count()
    given = [] if nn is None else [cut(check_knn(t, n)) for t in ([nn] if isinstance(nn, DataFrame) else nn)]
    if len(given) > len(blocks):
        raise ValueError(f"there are {len(blocks)} blocks, and {len(given)} neighbour tables were given")
    k = p.n_neighbors if p.method != "largevis" else max(2, min(n - 1, int(p.perplexity if p.kernel == "knn" else 3 * p.perplexity)))
    if p.method == "largevis" and p.perplexity >= n:
        raise ValueError(f"a perplexity of {p.perplexity} needs more than {n} rows")
    g, stats, table, tables = None, None, rows.select("id", F.col(key).alias("key")), []
    for b_no, b in enumerate(blocks):
        b["scale"], b["pca"] = fit_scale(rows, b["cols"], p.scale), None
        x = _vectors(rows, b, "x")
        if b["n_pca"] is not None and b["metric"] != "hamming" and b["n_pca"] <= min(n, len(b["scale"]["cols"])):
            b["pca"] = fit_pca(x, b["n_pca"], b["pca_center"])
            x = apply_pca(x, b["pca"])
        x = cut(x)
        found, with_self = lists(given[b_no]) if b_no < len(given) else (cut(neighbours(x, k, b["metric"], p.nn_method, **p.nn_args)), True)
        log.info("block %d of %d: %d rows, %d neighbours, %s", b_no + 1, len(blocks), n, k, b["metric"])
        w, s = _weights(found, p, with_self)
        g = cut(w) if g is None else cut(G.intersect(g, w, 0.5))
        stats = s if b_no == 0 else stats
        tables.append(found)
        table = table.join(x.select("id", F.col("x").alias(f"x{b_no}")), "id")
    for c in categorical:
        g = cut(G.categorical_intersection(g, rows.select("id", F.col(c).cast("string").alias("label")), 0.5))
    if y is not None:
        g = cut(supervise(g, rows, y, p))
    table = cut(table)
    return Model(p, cols, blocks, table, table.select("id", "key"), 0, nn=tables[0], graph=g, stats=stats, blocks_nn=tables, frozen={"means": [mean_distance(t) for t in tables]})


def graph_of(tables: DataFrame | list[DataFrame], p: Params | None = None, y: DataFrame | None = None) -> Model:
    """The graph without data: from a neighbour table, or one for each block. Rows are ids from 0; y: (id, label) of a categorical target.

    Lists may have unequal lengths, and may leave their own row out (see `lists`).
    """
    p = p or Params()
    p.check()
    tables = [tables] if isinstance(tables, DataFrame) else list(tables)
    first, with_self = lists(cut(check_knn(tables[0])))
    n = first.agg(F.max("i")).first()[0] + 1
    g, stats = _weights(first, p, with_self)
    kept = [first]
    for t in tables[1:]:
        other, with_self = lists(cut(check_knn(t, n)))
        g = cut(G.intersect(cut(g), _weights(other, p, with_self)[0], 0.5))
        kept.append(other)
    if y is not None:
        g = G.categorical_intersection(g, y, p.target_weight)
    rows = first.sparkSession.range(n).select("id", F.col("id").alias("key"))
    return Model(p, [], [], rows, rows, 0, nn=first, graph=cut(g), stats=stats, blocks_nn=kept, frozen={"means": [mean_distance(t) for t in kept]})


def graph_of_distances(pairs: DataFrame, p: Params | None = None, triangular: bool = False, zeros: bool = True) -> Model:
    """From distances (i, j, d). zeros: whether a distance of zero is defined, as it is in a table of all distances."""
    p = p or Params()
    return graph_of(knn_from_distances(pairs, p.n_neighbors, triangular, zeros), p)


def fit_distances(pairs: DataFrame, p: Params | None = None, triangular: bool = False) -> Model:
    """A graph from all distances (i, j, d), laid out from classical scaling if init is `pca` or `mds`."""
    p = p or Params()
    m = graph_of_distances(pairs, p, triangular)
    start = classical_scaling(pairs, m.rows.count(), p.n_components) if p.init in ("pca", "mds") else None
    return laid_out(m, start)


def graph_of_terms(terms: DataFrame, p: Params | None = None, metric: str = "cosine") -> Model:
    """From sparse rows in long form (id, term, value)."""
    p = p or Params()
    return graph_of(knn_sparse(terms, p.n_neighbors, metric), p)


def laid_out(m: Model, start: DataFrame | None = None, callback: Callable | None = None) -> Model:
    """A graph's model with coordinates; starts that need features do not work without."""
    coords, m.n_epochs, m.ai = optimize_graph_layout(m.graph, m.rows.count(), m.params, None, start, m.stats, callback)
    m.embedding = cut(m.rows.select("id", "key").join(coords, "id"))
    m.pruned = cut(G.prune(m.graph, m.n_epochs))
    return m


def checked_start(start: DataFrame, n: int, dim: int) -> DataFrame:
    """A user's start: one y of `dim` finite numbers for each id from 0 to n - 1."""
    bad = F.col("y").isNull() | (F.size("y") != dim) | F.exists("y", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    one = start.agg(F.count("*").alias("rows"), F.countDistinct("id").alias("ids"), F.min("id").alias("low"), F.max("id").alias("high"), F.sum(F.coalesce(bad, F.lit(True)).cast("int")).alias("bad")).first()
    if one["bad"] or (one["rows"], one["ids"], one["low"], one["high"]) != (n, n, 0, n - 1):
        raise ValueError(f"a start needs {dim} finite coordinates for each of the {n} rows")
    return start


def warn_if_wide(coords: DataFrame, dim: int) -> None:
    wide = coords.agg(*[F.stddev_samp(F.col("y")[k]).alias(str(k)) for k in range(dim)]).first()
    if max((x or 0.0) for x in wide) > 10:
        log.warning("the starting coordinates spread further (standard deviation over 10) than an optimiser can well mend")


def optimize_graph_layout(g: DataFrame, n: int, p: Params | None = None, rows: DataFrame | None = None, start: DataFrame | None = None, stats: DataFrame | None = None, callback: Callable | None = None) -> tuple[DataFrame, int, DataFrame | None]:
    """(coordinates, epochs, ai) from a symmetric graph over ids 0 to n - 1."""
    p = p or Params()
    p.check()
    graph_table(g)
    if p.binary_edge_weights:
        g = g.withColumn("w", F.lit(1.0))
    epochs = default_epochs(p, n, g)
    coords = I.scale_coords(checked_start(start, n, p.n_components), p.init_sdev) if start is not None else I.initial(p.init, g, rows, n, p.n_components, p.init_sdev, p.seed, p.negative_sample_rate)
    a, b = (p.a, p.b) if p.a is not None and p.b is not None else L.find_ab(p.spread, p.min_dist)
    ai = None
    if p.method == "leopold":
        ai = cut(G.scale_radii(stats, a, 0.5 if p.dens_scale is None else p.dens_scale))
        coords = coords.join(ai.select(F.col("i").alias("id"), "ai"), "id")
    if epochs > 0:
        warn_if_wide(coords, p.n_components)
        edges = cut(L.number_edges(L.epochs_per_sample(G.prune(g, epochs))))
        opt = {"alpha": p.learning_rate, "optimizer": p.optimizer} | p.opt_args
        coords = L.center(L.optimize(coords, edges, epochs, p.method, a, b, p.repulsion_strength, p.negative_sample_rate, seed=p.seed, callback=callback, **opt))
    return coords.select("id", "y"), epochs, ai


def fit(df: DataFrame, key: str, p: Params | None = None, y: str | list[str] | None = None, nn: DataFrame | list[DataFrame] | None = None, start: DataFrame | None = None, callback: Callable | None = None) -> Model:
    """similarity_graph and optimize_graph_layout in turn; model.embedding has (id, key, y)."""
    m = similarity_graph(df, key, p, y, nn)
    n = m.rows.count()
    coords, m.n_epochs, m.ai = optimize_graph_layout(m.graph, n, m.params, m.rows.select("id", F.col("x0").alias("x")), start, m.stats, callback)
    m.embedding = cut(m.rows.select("id", "key").join(coords, "id"))
    m.pruned = cut(G.prune(m.graph, m.n_epochs))
    if m.ai is not None:
        ends = m.stats.agg(F.min("localr").alias("lo"), F.max("localr").alias("hi")).first()
        a_ends = m.ai.agg(F.min("ai").alias("lo"), F.max("ai").alias("hi")).first()
        x0, x1 = -np.log(ends["hi"]), -np.log(ends["lo"])
        slope = (2 * np.log(a_ends["hi"]) - 2 * np.log(a_ends["lo"])) / ((x1 - x0) or 1.0)
        m.radii = {"intercept": float(2 * np.log(a_ends["lo"]) - slope * x0), "slope": float(slope)}
    return m


def umap(df: DataFrame, key: str, y=None, **args) -> Model:
    return fit(df, key, Params(**args), y)


def umap2(df: DataFrame, key: str, y=None, **args) -> Model:
    args = {"min_dist": 0.1, "init_sdev": "range", "n_epochs": 500} | args
    if args.get("a") == 1 and args.get("b") == 1 and args.get("dens_scale") is None:
        args["method"] = "tumap"
    return fit(df, key, Params(**args), y)


def tumap(df: DataFrame, key: str, y=None, **args) -> Model:
    return fit(df, key, Params(**{"method": "tumap"} | args), y)


def lvish(df: DataFrame, key: str, **args) -> Model:
    return fit(df, key, Params(**{"method": "largevis", "init": "lvrandom", "scale": "maxabs", "repulsion_strength": 7.0, "n_epochs": -1} | args))


def transform_init(nn: DataFrame, coords: DataFrame, weighted: bool = True) -> DataFrame:
    """(id, y): each new row's mean of its neighbours' coordinates, weighted by w or plain. nn: (i, j, w)."""
    w = F.col("w") if weighted else F.lit(1.0)
    dim = coords.select(F.size("y")).first()[0]
    both = nn.join(coords.select(F.col("id").alias("j"), "y"), "j")
    return both.groupBy(F.col("i").alias("id")).agg(F.array(*[F.sum(F.col("y")[k] * w) / F.sum(w) for k in range(dim)]).alias("y"))


def transform(model: Model, df: DataFrame, key: str, n_epochs: int | None = None, weighted: bool = True, seed: int | None = None, nn: list[DataFrame] | None = None, graph: bool = False, start: DataFrame | None = None, frozen: bool = False) -> DataFrame:
    """(key, y) of new rows; the model's coordinates stay.

    frozen: nothing is taken over the new rows together. The mean distance that bounds narrow bandwidths is the training rows', edges are as
    often sampled as their weights are of 1, and draws go by a row's key, so that a row has the same place alone and in any company. Otherwise
    both come from the rows given.
    start: (key, y) to begin with instead of the neighbours' means.

    nn: for each block, neighbours (i, rank, j, d) of the new rows (ids from 0 in the order of key) among the model's, instead of a search.
    graph: the weights (i, j, w) between new and old rows instead of coordinates.
    """
    model._ready()
    p = model.params
    missing = [c for c in model.cols if c not in df.columns]
    if missing and nn is None:
        raise ValueError(f"the model needs columns that are not there: {missing}")
    if nn is None:
        check_complete(df, model.cols, "data")
    elif len(nn) != max(1, len(model.blocks)):
        raise ValueError(f"the model has {max(1, len(model.blocks))} blocks, and {len(nn)} neighbour tables were given")
    rows = cut(with_ids(df, key))
    n_old = model.rows.count()
    user, table, start = start, None, None
    old = model.embedding.select("id", "y")
    if user is not None:
        user = checked_start(rows.select("id", F.col(key).alias("key")).join(user.select("key", "y"), "key").select("id", "y"), rows.count(), p.n_components)
    stats = None
    for k in range(len(nn) if nn is not None else len(model.blocks)):
        if nn is not None:
            found = cut(nn[k].select("i", "rank", "j", "d"))
        else:
            b = model.blocks[k]
            x = model.rows.select("id", F.col(f"x{k}").alias("x"))
            found = cut(neighbours(x, min(p.n_neighbors, n_old), b["metric"], p.nn_method, query=_vectors(rows, b, "x"), index=model.index(k), **p.nn_args))
        mean = model.frozen["means"][k] if frozen else None
        w = cut(G.smooth(found, max(0.0, p.local_connectivity - 1), 1.0, True, float(np.log2(p.n_neighbors)) * p.bandwidth, mean))
        stats = stats if stats is not None else G.vertex_stats(w)
        one = transform_init(w, old, weighted)
        start = one if start is None else start.join(one.withColumnRenamed("y", "y2"), "id").select("id", F.zip_with("y", "y2", lambda a, c: (a + c) / 2).alias("y"))
        g = w.select("i", "j", "w").where("w <> 0")
        table = g if table is None else G.general_intersection(table, g, 0.5)
    if graph:
        return table
    epochs = max(2, round(model.n_epochs / 3)) if n_epochs is None else n_epochs
    start = start if user is None else user
    if epochs > 0:
        g = table.withColumn("w", F.lit(1.0)) if p.binary_edge_weights else table
        top = 1.0 if frozen else None
        edges = L.epochs_per_sample(G.prune(g, epochs, top), top)
        if frozen:
            named = rows.select(F.col("id").alias("i"), F.col(key).cast("string").alias("_key"))
            edges = cut(edges.join(named, "i").select("i", "j", "eps", F.xxhash64("_key", "j").alias("edge_id")))
        else:
            edges = cut(L.number_edges(edges))
        a, b = (p.a, p.b) if p.a is not None and p.b is not None else L.find_ab(p.spread, p.min_dist)
        fixed = old
        if p.method == "leopold":
            s = 0.5 if p.dens_scale is None else p.dens_scale
            top, low = float(np.sqrt(a * 10 ** (2 * s))), min(float(np.sqrt(a * 10 ** (-2 * s))), 0.1)
            ai = F.exp(0.5 * (model.radii["intercept"] + model.radii["slope"] * -F.log("localr")))
            start = start.join(stats.select(F.col("i").alias("id"), F.greatest(F.lit(low), F.least(F.lit(top), ai)).alias("ai")), "id")
            fixed = old.join(model.ai.select(F.col("i").alias("id"), "ai"), "id")
        opt = {"alpha": p.learning_rate / 4 if p.optimizer == "sgd" else p.learning_rate, "optimizer": p.optimizer} | p.opt_args
        start = L.optimize(start, edges, epochs, p.method, a, b, p.repulsion_strength, p.negative_sample_rate, seed=p.seed if seed is None else seed, fixed=fixed, **opt)
    return rows.select("id", F.col(key).alias("key")).join(start.select("id", "y"), "id").drop("id")
