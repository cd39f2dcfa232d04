"""Neighbours by descent: neighbours of a row are likely neighbours of each other.

A round joins, at every row, its candidates: neighbours both ways, of which at least one is new since it was joined last. Rows are dealt to
buckets by a tree, so that rows of a bucket have candidates in common; each bucket gets every vector once and measures all its rows' pairs.
Only pairs that improve one of their ends leave the task. Rounds end when fewer than delta * n * k entries of the table change.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions.metrics import distances
from skein.operators.forest import Forest, grow, leaf_pairs
from skein.operators.knn import numbers, ranked
from skein.operators.tables import cut

log = logging.getLogger("skein")
BUCKET = 1024


@dataclass
class Descent:
    table: DataFrame  # (i, rank, j, d)
    rounds: int
    measured: list[int]  # distances of each round
    places: DataFrame  # (id, bucket)


def places_of(df: DataFrame, metric: str, seed: int = 42, sample: int = 16_384, size: int = BUCKET) -> DataFrame:
    """(id, bucket): rows that lie together share a bucket of at most 4 * size rows."""
    one = grow(df, metric, 1, size, seed, sample)
    return cut(one.rows.select("id", F.concat_ws("/", "node", "part").alias("bucket")))


def vectors_by_bucket(need: DataFrame, rows: DataFrame) -> DataFrame:
    """(bucket, id, x, ...) of the distinct (bucket, id) in need, with all columns of rows."""
    return need.select(F.col("bucket").alias("bucket"), F.col("id").alias("id")).distinct().join(rows, "id")


def candidates(table: DataFrame, most: int, seed: int, turn: int) -> tuple[DataFrame, DataFrame]:
    """(v, u, new) to be joined at v, and the table with what is joined marked as old. At most `most` new and old ones each way."""
    draw = lambda *c: F.xxhash64(F.lit(seed), F.lit(turn), *c)
    e = table.where("i <> j")
    e = e.withColumn("at", F.row_number().over(W.partitionBy("i", "new").orderBy(draw("i", "j"), "j")))
    ahead = e.where(F.col("at") <= most).select(F.col("i").alias("v"), F.col("j").alias("u"), "new")
    # of a hub's many entries each task keeps `most`, before they meet
    back = ahead.select(F.col("u").alias("v"), F.col("v").alias("u"), "new")
    back = back.withColumn("at", F.row_number().over(W.partitionBy("v", "new").orderBy(draw("u", "v"), "u"))).where(F.col("at") <= most)
    marked = e.select("i", "j", "d", (F.col("new") & (F.col("at") > most)).alias("new"))
    return ahead.unionByName(back.drop("at")), marked


def _joined(x: np.ndarray, far: np.ndarray, starts: np.ndarray, u: np.ndarray, new: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(a, b, d) of pairs nearer than the farthest neighbour of one end, a < b, and how many were measured."""
    n, left, right, dist, measured = len(x), [], [], [], 0
    flat = metric in ("euclidean", "sqeuclidean")
    square = (x * x).sum(1) if flat else None
    reach = far if metric != "euclidean" else far * far
    for low, high in zip(starts[:-1], starts[1:]):
        own, fresh = u[low:high], new[low:high]
        a = np.unique(own[fresh])
        if not len(a):
            continue
        b = np.concatenate([a, np.setdiff1d(own[~fresh], a)])
        d = square[a][:, None] + square[b][None] - 2 * x[a] @ x[b].T if flat else distances(metric, x[a], x[b])
        measured += d.size
        limit = np.maximum(reach[a][:, None], reach[b][None])
        close = d <= (limit * (1 + 1e-9) + 1e-9 * (square[a][:, None] + square[b][None]) if flat else limit)
        close[:, : len(a)] &= a[:, None] < a[None]
        p, q = np.nonzero(close)
        left.append(np.minimum(a[p], b[q])), right.append(np.maximum(a[p], b[q])), dist.append(d[p, q])
    if not left:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0), measured)
    code = np.concatenate(left) * n + np.concatenate(right)
    code, first = (np.unique(code), None) if flat else np.unique(code, return_index=True)
    a, b = code // n, code % n
    # products lose digits between rows that nearly coincide: what is kept is measured from differences
    d = np.concatenate(dist)[first] if not flat else ((x[a] - x[b]) ** 2).sum(1)
    d = np.sqrt(d) if metric == "euclidean" else d
    return a, b, d, measured


def join_round(table: DataFrame, rows: DataFrame, places: DataFrame, k: int, metric: str, most: int, seed: int, turn: int) -> tuple[DataFrame, int, int]:
    """(table, entries that changed, distances) of one round; table: (i, j, d, new)."""
    cand, marked = candidates(table, most, seed, turn)
    cand = cut(cand.join(places.withColumnRenamed("id", "v"), "v"))
    worst = table.groupBy(F.col("i").alias("id")).agg(F.when(F.count("*") >= k, F.max("d")).otherwise(float("inf")).alias("far"))
    held = vectors_by_bucket(cand.select("bucket", F.col("u").alias("id")), rows.join(worst, "id", "left"))

    def run(e: pa.Table, r: pa.Table) -> pa.Table:
        ids = np.asarray(r.column("id"))
        order = np.argsort(ids)
        ids = ids[order]
        x = np.asarray(r.column("x").combine_chunks().flatten()).reshape(len(ids), -1)[order]
        far = np.nan_to_num(np.asarray(r.column("far").fill_null(np.inf))[order], nan=np.inf, posinf=np.inf)
        v = np.asarray(e.column("v"))
        by = np.argsort(v, kind="stable")
        u, new = np.searchsorted(ids, np.asarray(e.column("u"))[by]), np.asarray(e.column("new").combine_chunks().to_numpy(zero_copy_only=False))[by]
        starts = np.concatenate([[0], np.flatnonzero(np.diff(v[by])) + 1, [len(v)]])
        a, b, d, measured = _joined(x, far, starts, u, new, metric)
        i, j, d = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([d, d])
        near = d <= far[i]
        i, j, d = i[near], j[near], d[near]
        # by row and distance: places above, the distance's bits, which rise with it, below
        at = np.argsort((i.astype(np.uint64) << np.uint64(32)) | np.maximum(d, 0).astype(np.float32).view(np.uint32))
        i, j, d = i[at], j[at], d[at]
        spot = np.arange(len(i)) - np.searchsorted(i, i)
        i, j, d = (c[spot < k] for c in (i, j, d))  # the table takes no more
        return pa.table({"i": np.append(ids[i], -1), "j": np.append(ids[j], -1), "d": np.append(d, float(measured))})

    found = cut(cand.groupBy("bucket").cogroup(held.groupBy("bucket")).applyInArrow(run, "i long, j long, d double"))
    measured = int(found.where("j = -1").agg(F.sum("d")).first()[0] or 0)
    # state: 0 joined before, 1 new, 2 of this round; by row once: pairs and ranks then need no further shuffle
    both = marked.select("i", "j", "d", F.col("new").cast("int").alias("state")).unionByName(found.where("j <> -1").withColumn("state", F.lit(2)))
    one = both.repartition("i").groupBy("i", "j").agg(F.min("d").alias("d"), F.min("state").alias("state"))
    best = one.withColumn("rank", F.row_number().over(W.partitionBy("i").orderBy("d", "j"))).where(F.col("rank") < k)
    best = cut(best.select("i", "j", "d", "state"))
    return best.select("i", "j", "d", (F.col("state") > 0).alias("new")), best.where("state = 2").count(), measured


def descend(df: DataFrame, k: int, metric: str = "euclidean", trees: int | None = None, leaf: int | None = None, rounds: int | None = None, delta: float = 0.001, max_candidates: int = 30, width: int | None = None, seed: int = 42, sample: int = 16_384) -> Descent:
    """The table of df's rows (id, x) after descent from the leaves of a few trees.

    trees, leaf, rounds: by the rows' number and k if None. width: entries of a row while it descends (k + 15 if None); k of them are returned.
    """
    n = df.count()
    if n < k:
        raise ValueError(f"n_neighbors must be at most the number of rows ({n})")
    wide = min(n, k + 15 if width is None else max(width, k))
    trees = min(16, 4 + round(n**0.25 / 4)) if trees is None else trees
    rounds = max(5, round(np.log2(n))) if rounds is None else rounds
    rows = cut(numbers(df))
    forest = grow(rows, metric, trees, leaf or max(10, min(256, 5 * k)), seed, sample)
    table = cut(ranked(leaf_pairs(forest, wide), wide).where("i <> j").select("i", "j", "d", F.lit(True).alias("new")))
    places = places_of(rows, metric, seed + 1, sample)
    measured, turn = [], 0
    for turn in range(1, rounds + 1):
        table, changed, count = join_round(table, rows, places, wide, metric, max_candidates, seed, turn)
        measured.append(count)
        log.info("round %d: %d of %d entries changed, %.0f distances a row", turn, changed, n * wide, count / n)
        if changed <= delta * n * wide:
            break
    own = rows.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("d"))
    return Descent(cut(ranked(table.select("i", "j", "d").union(own), k)), turn, measured, places)
