"""Random-projection trees over tables of any size, and best-first search in them.

The first level of every tree is fit on a bounded sample and broadcast. A node that holds more rows than a leaf may is split further by planes fit
on a sample of its own rows, level by level, so leaves keep their size however large the table is; the planes of later levels are a
table, joined with the rows that they part. What no plane parts (equal rows) stays one node and is dealt by a hash.

A search visits the leaves of all trees in the order of their margins, the nearest first, until they hold search_k rows.
"""

from __future__ import annotations

import heapq
import logging
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.metrics import distances
from skein.operators.knn import numbers, ranked
from skein.operators.layout import BROADCAST_CELLS
from skein.operators.tables import cut

log = logging.getLogger("skein")

NODE_SAMPLE = 2048  # rows that planes of later levels are fit on
SALTED = 65_536  # rows of one node that are parted in one task
STUCK = "!"  # ends the name of a node that no plane parts


def planar(x: np.ndarray, metric: str) -> np.ndarray:
    """Rows whose planes part what the metric parts."""
    if metric in ("correlation", "spearmanr"):
        x = x - x.mean(1, keepdims=True)
    if metric in ("cosine", "correlation", "spearmanr", "tsss"):
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    return np.sqrt(np.abs(x)) if metric == "hellinger" else x


@dataclass
class Tree:
    """A node's plane is half-way between two of its rows; a child below zero is a leaf, leaf 1 being -1."""

    normals: np.ndarray
    offsets: np.ndarray
    children: np.ndarray

    @classmethod
    def grow(cls, x: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
        normals, offsets, children, leaves = [], [], [], 0
        todo = [(np.arange(len(x)), None)]
        while todo:
            own, place = todo.pop()
            best = None
            for _ in range(5 if len(own) > leaf else 0):
                u, v = x[rng.choice(own, 2, replace=False)]
                size = np.linalg.norm(u - v)
                if size == 0:
                    continue
                normal = (u - v) / size
                at = normal @ (u + v) / 2
                side = x[own] @ normal > at
                if best is None or abs(side.mean() - 0.5) < abs(best[2].mean() - 0.5):
                    best = normal, at, side
                if 0.1 < side.mean() < 0.9:
                    break
            if best is None or best[2].all() or not best[2].any():
                leaves += 1
                node = -leaves
            else:
                node = len(normals)
                normals.append(best[0]), offsets.append(best[1]), children.append([0, 0])
                todo += [(own[best[2] == side], (node, side)) for side in (0, 1)]
            if place:
                children[place[0]][place[1]] = node
        return cls(np.array(normals).reshape(len(normals), x.shape[1]), np.array(offsets, float), np.array(children, np.int64).reshape(-1, 2))

    def leaves(self, m: np.ndarray) -> np.ndarray:
        node = np.zeros(len(m), np.int64) if len(self.offsets) else np.full(len(m), -1)
        while (on := np.flatnonzero(node >= 0)).size:
            own = node[on]
            side = (m[on] * self.normals[own]).sum(1) > self.offsets[own]
            node[on] = self.children[own, side.astype(np.int64)]
        return -node


def nearest_leaves(trees: list[Tree], x: np.ndarray, sizes: list[dict[int, int]], budget: int) -> list[tuple[int, int]]:
    """(tree, leaf) in falling order of the smallest margin on the way there, until the leaves' sizes sum to budget."""
    heap = [(-np.inf, t, 0 if len(tree.offsets) else -1) for t, tree in enumerate(trees)]
    heapq.heapify(heap)
    out, total = [], 0
    while heap and total < budget:
        far, t, node = heapq.heappop(heap)
        tree = trees[t]
        while node >= 0:
            margin = float(tree.normals[node] @ x - tree.offsets[node])
            side = int(margin > 0)
            heapq.heappush(heap, (max(far, abs(margin)), t, int(tree.children[node, 1 - side])))
            node = int(tree.children[node, side])
        held = sizes[t].get(-node, 0)
        if held:
            out.append((t, -node))
            total += held
    return out


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(ids in order, their rows)."""
    ids = np.asarray(t.column("id"))
    order = np.argsort(ids)
    return ids[order], np.asarray(t.column("x").combine_chunks().flatten()).reshape(len(ids), -1)[order]


def _rows(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


@dataclass
class Forest:
    """rows: (id, x, tree, node, part), each row once a tree; levels: (tree, node, planes, sizes) of the nodes that were split further."""

    metric: str
    leaf: int
    trees: list[Tree]
    sizes: list[dict[int, int]]  # what the first level's leaves stand for: their rows, or `leaf` if they are split further
    rows: DataFrame
    parts: DataFrame  # (tree, node, parts)
    levels: list[DataFrame]
    n: int


def _routed(df: DataFrame, trees: list[Tree], metric: str) -> DataFrame:
    """(id, x, tree, node): each row once for each tree."""
    known = df.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = planar(_rows(b.column(1)), metric)
                leaf = np.stack([t.leaves(m) for t in known.value], 1).astype(str)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(leaf.tolist(), pa.list_(pa.string()))], names=["id", "x", "nodes"])

    return numbers(df).mapInArrow(run, "id long, x array<double>, nodes array<string>").select("id", "x", F.posexplode("nodes").alias("tree", "node"))


def _planes(rows: DataFrame, metric: str, leaf: int, seed: int) -> DataFrame:
    """(tree, node, planes) for each node of rows (id, x, tree, node, count), fit on about NODE_SAMPLE of its rows; null where none parts them."""
    share = F.lit(2.0 * NODE_SAMPLE * 2**32) / F.col("count")
    picked = rows.where(F.pmod(F.xxhash64(F.lit(seed), "id", "tree"), F.lit(2**32)) < share)

    def fit(key: tuple, t: pa.Table) -> pa.Table:
        tree, node = key[0].as_py(), key[1].as_py()
        rng = np.random.default_rng([seed, tree, zlib.crc32(node.encode())])
        x = planar(_matrix(t)[1], metric)
        x = x[rng.permutation(len(x))[:NODE_SAMPLE]]
        found = Tree.grow(x, max(8, leaf * len(x) // t.column("count")[0].as_py()), rng)
        return pa.table({"tree": pa.array([tree], pa.int32()), "node": [node], "planes": pa.array([pickle.dumps(found) if len(found.offsets) else None], pa.binary())})

    return picked.groupBy("tree", "node").applyInArrow(fit, "tree int, node string, planes binary")


def _salted(rows: DataFrame, planes: DataFrame, count: str, key: str) -> tuple:
    """Both sides dealt by a hash of rows' key, so that no task parts more than about SALTED rows of one node."""
    salts = F.ceil(F.col(count) / SALTED)
    many = rows.groupBy("tree", "node").agg(F.max(salts).alias("salts"))
    wide = planes.join(many, ["tree", "node"]).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    return rows.withColumn("salt", F.pmod(F.xxhash64(key), salts)).groupBy("tree", "node", "salt"), wide.groupBy("tree", "node", "salt")


def _parted(rows: DataFrame, planes: DataFrame, metric: str) -> DataFrame:
    """(id, x, tree, parent, child) of rows (id, x, tree, node, count); child 0 where no plane parts a node."""

    def run(key: tuple, t: pa.Table, p: pa.Table) -> pa.Table:
        held = p.column("planes")[0].as_py() if p.num_rows else None
        x = t.column("x").combine_chunks()
        child = pickle.loads(held).leaves(planar(_rows(x), metric)) if held and t.num_rows else np.zeros(t.num_rows, np.int64)
        return pa.table({"id": t.column("id"), "x": x, "tree": t.column("tree"), "parent": t.column("node"), "child": child})

    a, b = _salted(rows, planes, "count", "id")
    return a.cogroup(b).applyInArrow(run, "id long, x array<double>, tree int, parent string, child long")


def _named(parent: str, child: str):
    return F.when(F.col(child) > 0, F.concat_ws(".", parent, child)).otherwise(F.concat(parent, F.lit(STUCK)))


def grow(df: DataFrame, metric: str = "euclidean", trees: int = 12, leaf: int = 64, seed: int = 42, sample: int = 16_384) -> Forest:
    """A forest over df's rows (id, x). Leaves hold 4 * leaf rows at most, but for rows that are equal, which are dealt into parts of that size."""
    n = df.count()
    taken = numbers(df).orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample).toPandas()  # `sample` rows
    x = planar(np.stack(taken["x"].to_numpy()), metric)
    rng = np.random.default_rng(seed)
    first = [Tree.grow(x, max(8, leaf * len(x) // n), rng) for _ in range(trees)]
    at, done, levels, sizes = cut(_routed(df, first, metric)), [], [], None
    while True:
        count = cut(at.groupBy("tree", "node").count())
        if sizes is None:  # sample / 8 leaves a tree at most
            sizes = [{} for _ in first]
            for r in count.collect():
                sizes[r["tree"]][int(r["node"])] = r["count"] if r["count"] <= 4 * leaf else leaf
        wide = (F.col("count") > 4 * leaf) & ~F.endswith("node", F.lit(STUCK))
        rows = at.join(count, ["tree", "node"])
        done.append(rows.where(~wide))
        if not count.where(wide).limit(1).count():
            break
        full = rows.where(wide)
        planes = cut(_planes(full, metric, leaf, seed + len(levels) + 1))
        parted = cut(_parted(full, planes, metric))
        held = parted.groupBy("tree", F.col("parent").alias("node"), "child").count()
        stands = F.when(F.col("count") <= 4 * leaf, F.col("count")).otherwise(F.lit(leaf))
        held = held.groupBy("tree", "node").agg(F.map_from_entries(F.collect_list(F.struct("child", stands.alias("n")))).alias("sizes"))  # NODE_SAMPLE / 8 at most
        levels.append(cut(held.join(planes, ["tree", "node"], "left")))
        at = parted.select("id", "x", "tree", _named("parent", "child").alias("node"))
    rows = reduce(DataFrame.unionByName, done)
    parts = F.ceil(F.col("count") / (4 * leaf))
    rows = cut(rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("id", "tree"), "parts")).drop("count"))
    return Forest(metric, leaf, first, sizes, rows.drop("parts"), cut(rows.groupBy("tree", "node").agg(F.first("parts").alias("parts"))), levels, n)


def leaf_pairs(forest: Forest, k: int) -> DataFrame:
    """(i, j, d): the k nearest of each row, itself among them, within each of its leaves."""
    metric = forest.metric

    def inside(t: pa.Table) -> pa.Table:
        ids, m = _matrix(t)
        d = distances(metric, m, m)
        np.fill_diagonal(d, -1.0)
        at = np.argsort(d, axis=1, kind="stable")[:, :k]
        return pa.table({"i": np.repeat(ids, at.shape[1]), "j": ids[at].ravel(), "d": np.maximum(np.take_along_axis(d, at, 1).ravel(), 0.0)})

    return forest.rows.groupBy("tree", "node", "part").applyInArrow(inside, "i long, j long, d double").distinct()


def asked_leaves(forest: Forest, query: DataFrame, search_k: int) -> DataFrame:
    """(i, x, tree, node, budget): the leaves that each row of query (id, x) visits."""
    metric, known = forest.metric, query.sparkSession.sparkContext.broadcast((forest.trees, forest.sizes))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, sizes = known.value
        for b in batches:
            if b.num_rows:
                found = [nearest_leaves(trees, x, sizes, search_k) for x in planar(_rows(b.column(1)), metric)]
                own = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                tree, leaf = (np.array([p[k] for f in found for p in f], np.int64) for k in (0, 1))
                held = [sizes[t][n] for t, n in zip(tree.tolist(), leaf.tolist())]
                yield pa.RecordBatch.from_arrays([b.column(0).take(own), b.column(1).take(own), pa.array(tree, pa.int32()), pa.array(leaf.astype(str).tolist(), pa.string()), pa.array(held, pa.int64())], names=["i", "x", "tree", "node", "budget"])

    def deeper(key: tuple, q: pa.Table, p: pa.Table) -> pa.Table:
        node, out = key[1].as_py(), []
        x, left = planar(_rows(q.column("x").combine_chunks()), metric), q.column("budget").to_pylist()
        if p.num_rows and (planes := p.column("planes")[0].as_py()):
            tree, sizes = pickle.loads(planes), [dict(p.column("sizes")[0].as_py())]
            for r in range(q.num_rows):
                out += [(r, f"{node}.{leaf}", sizes[0][leaf]) for _, leaf in nearest_leaves([tree], x[r], sizes, left[r])]
        else:
            out = [(r, node + STUCK, b) for r, b in enumerate(left)]
        own = pa.array([r for r, _, _ in out], pa.int64())
        return pa.table({"i": q.column("i").take(own), "x": q.column("x").take(own), "tree": q.column("tree").take(own), "node": pa.array([n for _, n, _ in out], pa.string()), "budget": pa.array([b for _, _, b in out], pa.int64())})

    schema = "i long, x array<double>, tree int, node string, budget long"
    at = numbers(query).mapInArrow(start, schema)
    for level in forest.levels:
        at = cut(at)
        split = level.select("tree", "node")
        inner = at.join(split, ["tree", "node"], "left_semi")
        inner = inner.join(inner.groupBy("tree", "node").count(), ["tree", "node"])
        a, b = _salted(inner, level, "count", "i")
        at = at.join(split, ["tree", "node"], "left_anti").unionByName(a.cogroup(b).applyInArrow(deeper, schema))
    return at


def _search_held(forest: Forest, query: DataFrame, k: int, search_k: int) -> DataFrame:
    """search where trees of one level and all rows go to every task: nothing is shuffled, and a row's leaves meet it where it is."""
    metric = forest.metric
    x = forest.rows.where("tree = 0").select("id", "x").toPandas().sort_values("id")  # at most BROADCAST_CELLS numbers
    ids, m = x["id"].to_numpy(), np.stack(x["x"].to_numpy())
    own = forest.rows.select("id", "tree", F.col("node").cast("int").alias("leaf")).toPandas().sort_values(["tree", "leaf", "id"])
    at, (tree, leaf) = np.searchsorted(ids, own["id"].to_numpy()), (own[c].to_numpy() for c in ("tree", "leaf"))
    edge = np.flatnonzero(np.concatenate([[True], (tree[1:] != tree[:-1]) | (leaf[1:] != leaf[:-1])]))
    members = dict(zip(zip(tree[edge].tolist(), leaf[edge].tolist()), np.split(at, edge[1:])))
    known = query.sparkSession.sparkContext.broadcast((forest.trees, forest.sizes, ids, m, members))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, sizes, ids, m, members = known.value
        for b in batches:
            found = []
            for i, q, flat in zip(b.column(0).to_pylist(), rows := _rows(b.column(1)) if b.num_rows else [], planar(rows, metric) if b.num_rows else []):
                near = np.unique(np.concatenate([members[place] for place in nearest_leaves(trees, flat, sizes, search_k)]))
                d = distances(metric, q[None], m[near])[0]
                best = np.argsort(d, kind="stable")[:k]
                found.append((np.full(len(best), i), ids[near[best]], d[best]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["i", "j", "d"])

    return numbers(query).mapInArrow(run, "i long, j long, d double")


def search(forest: Forest, query: DataFrame, k: int, search_k: int) -> DataFrame:
    """(i, j, d): up to k of the rows that share a visited leaf with each row of query (id, x)."""
    metric = forest.metric
    held = forest.n * (len(forest.trees) + len(forest.trees[0].normals[0])) if len(forest.trees[0].offsets) else np.inf
    if not forest.levels and held <= BROADCAST_CELLS and not forest.parts.where("parts > 1").limit(1).count():
        return _search_held(forest, query, k, search_k)
    at = asked_leaves(forest, query, search_k).join(forest.parts, ["tree", "node"])
    some = F.least(F.col("parts"), F.ceil(F.col("budget") / (4 * forest.leaf)))  # rows that no plane parts are alike: some of their parts do
    at = at.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), some - 1)))
    at = cut(at.withColumn("part", F.pmod(F.xxhash64("i", "tree") + F.col("step"), "parts")).select("i", "x", "tree", "node", "part"))
    by = ["tree", "node", "part"]
    salts = at.groupBy(*by).agg(F.ceil(F.count("*") / 4096).alias("salts"))
    at = at.join(salts, by).withColumn("salt", F.pmod(F.xxhash64("i"), "salts")).drop("salts")
    rows = forest.rows.join(salts, by).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")

    def across(q: pa.Table, r: pa.Table) -> pa.Table:
        if not q.num_rows or not r.num_rows:
            return pa.table({"i": pa.array([], pa.int64()), "j": pa.array([], pa.int64()), "d": pa.array([], pa.float64())})
        (qi, a), (rj, b) = _matrix(q.rename_columns(["id" if c == "i" else c for c in q.column_names])), _matrix(r)
        d = distances(metric, a, b)
        at = np.argsort(d, axis=1, kind="stable")[:, :k]
        return pa.table({"i": np.repeat(qi, at.shape[1]), "j": rj[at].ravel(), "d": np.take_along_axis(d, at, 1).ravel()})

    by = [*by, "salt"]
    found = at.groupBy(*by).cogroup(rows.groupBy(*by)).applyInArrow(across, "i long, j long, d double")
    return found.groupBy("i", "j").agg(F.min("d").alias("d"))  # products in leaves of other sizes may round a pair's distance otherwise


def enough(table: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """table, if every row of query has k neighbours in it."""
    short = query.select(F.col("id").cast("long").alias("i")).join(table.groupBy("i").count(), "i", "left").where(F.coalesce("count", F.lit(0)) < k)
    if first := short.orderBy("i").first():
        raise ValueError(f"row {first['i']} has only {first['count'] or 0} of {k} neighbours: raise search_k or n_trees")
    return table


def self_hits(table: DataFrame) -> float:
    """Share of rows that are among their own neighbours: a search over its own rows should find them."""
    return table.groupBy("i").agg(F.max((F.col("i") == F.col("j")).cast("int")).alias("hit")).agg(F.avg("hit")).first()[0] or 0.0


def forest_knn(df: DataFrame, k: int, metric: str = "euclidean", trees: int = 50, leaf: int = 32, search_k: int | None = None, seed: int = 42, sample: int = 16_384, query: DataFrame | None = None) -> DataFrame:
    """Neighbours of query's rows (df's own if None) from best-first search: search_k (2 * k * trees if None) rows are looked at, or a few more."""
    if query is None and df.count() < k:
        raise ValueError("n_neighbors must be at most the number of rows")
    own = query is None
    query = df if own else query
    found = cut(search(grow(df, metric, trees, leaf, seed, sample), query, k, search_k or 2 * k * trees))
    if own:
        share = self_hits(found)
        log.info("%.2f %% of rows found themselves", 100 * share)
        found = found.where("i <> j").union(query.select(F.col("id").cast("long").alias("i"), F.col("id").cast("long").alias("j"), F.lit(0.0).alias("d")))
    return enough(cut(ranked(found, k, own)), query, k)
