"""Weighted graphs (i, j, w) from neighbour tables: calibration per vertex, symmetrisation, set algebra, supervision, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.operators.tables import cut, number

BIG = np.finfo(float).max


def _vertices(knn: DataFrame) -> DataFrame:
    """One row per vertex: neighbours and distances by rank. A vertex has k of them, never all rows."""
    packed = F.array_sort(F.collect_list(F.struct("rank", "j", "d")))
    return knn.groupBy("i").agg(packed.alias("v")).select("i", F.col("v.j").alias("j"), F.col("v.d").alias("d"))


def _padded(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    out = np.full((len(rows), max(map(len, rows), default=0)), np.nan)
    for r, x in enumerate(rows):
        out[r, : len(x)] = x
    return out


def rho_of(d: np.ndarray, connectivity: float) -> np.ndarray:
    """Distance to the connectivity-th nearest neighbour that is not at zero, interpolated."""
    nz = np.sort(np.where(d > 0, d, np.inf), axis=1)
    n, k = (nz < np.inf).sum(1), int(connectivity)
    part, at = connectivity - k, lambda c: nz[:, min(c, nz.shape[1] - 1)]
    if k > 0:
        enough = at(k - 1) + (part * (at(k) - at(k - 1)) if part >= 1e-5 else 0.0)
    else:
        enough = part * at(0)
    most = np.where(nz < np.inf, nz, 0).max(1) if nz.shape[1] else np.zeros(len(d))
    return np.where(n >= max(connectivity, 1e-300), np.where(n > 0, enough, 0.0), np.where(n > 0, most, 0.0)) if connectivity > 0 else np.zeros(len(d))


def bisect(value, target: np.ndarray, rounds: int, tol: float, rising: bool) -> tuple[np.ndarray, np.ndarray]:
    """(x, found) with value(x) = target per row, from 1, doubling until bracketed; rising: value grows with x."""
    n = len(target)
    x, low, high = np.ones(n), np.zeros(n), np.full(n, BIG)
    best, miss, found = np.ones(n), np.full(n, np.inf), np.zeros(n, bool)
    for _ in range(rounds):
        v = value(x)
        gap = np.abs(v - target)
        better = ~found & (gap < miss)
        best, miss = np.where(better, x, best), np.where(better, gap, miss)
        found |= gap < tol
        over = (v > target) if rising else (v < target)
        go = ~found
        high = np.where(go & over, x, high)
        low = np.where(go & ~over, x, low)
        step = np.where(high == BIG, 2 * x, (low + high) / 2)
        x = np.where(go, step, x)
    return best, found


def smooth(knn: DataFrame, connectivity: float = 1.0, bandwidth: float = 1.0, skip_first: bool = True, target: float | None = None, mean_distance: float | None = None) -> DataFrame:
    """(i, j, d, w, sigma, rho, found): calibrated weights of each vertex's neighbours.

    sigma solves sum exp(-(d - rho) / sigma) = log2(k) * bandwidth over the neighbours but the first (itself).
    """
    if mean_distance is None and connectivity < 1:
        mean_distance = knn.agg(F.avg("d")).first()[0]
    whole = mean_distance or 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            d = _padded(b.column(2))
            real = ~np.isnan(d)
            n = real.sum(1)
            rho = rho_of(np.where(real, d, 0.0), connectivity)
            gap = np.where(real, d - rho[:, None], np.inf)
            use = gap[:, 1:] if skip_first else gap
            goal = np.full(len(d), target) if target is not None else np.log2(n if skip_first else n + 1) * bandwidth
            value = lambda s: np.where(use <= 0, 1.0, np.exp(-np.where(use <= 0, 0.0, use) / s[:, None])).sum(1)
            sigma, found = bisect(value, goal, 64, 1e-5, True)
            own = np.where(real, d, 0.0).sum(1) / np.maximum(n, 1)
            sigma = np.maximum(sigma, 1e-3 * np.where(rho > 0, own, whole or own))
            w = np.where(gap <= 0, 1.0, np.exp(-np.where(gap <= 0, 0.0, gap) / sigma[:, None]))
            r, c = np.nonzero(real)
            j = np.concatenate([np.asarray(x) for x in b.column(1).to_pylist()])
            i = np.asarray(b.column(0))
            cols = [i[r], j, d[r, c], w[r, c], sigma[r], rho[r], found[r]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["i", "j", "d", "w", "sigma", "rho", "found"])

    return _vertices(knn).mapInArrow(run, "i long, j long, d double, w double, sigma double, rho double, found boolean")


def vertex_stats(smoothed: DataFrame) -> DataFrame:
    """(i, sigma, rho, localr)."""
    return smoothed.groupBy("i").agg(F.first("sigma").alias("sigma"), F.first("rho").alias("rho")).withColumn("localr", F.col("sigma") + F.col("rho"))


def _both_ways(e: DataFrame) -> DataFrame:
    e = e.where("i <> j and w <> 0").select("i", "j", "w")
    return e.union(e.select(F.col("j"), F.col("i"), F.col("w")))


def fuzzy(weights: DataFrame, mix_ratio: float = 1.0) -> DataFrame:
    """Symmetric (i, j, w): union a + b - ab at ratio 1, intersection ab at 0, linear between. One shuffle."""
    if not 0 <= mix_ratio <= 1:
        raise ValueError("set_op_mix_ratio must be between 0.0 and 1.0")
    both = _both_ways(weights).groupBy("i", "j").agg(F.sum("w").alias("s"), F.count("*").alias("n"), (F.min("w") * F.max("w")).alias("p"))
    product = F.when(F.col("n") == 2, F.col("p")).otherwise(0.0)
    union = F.col("s") - product
    return both.select("i", "j", (mix_ratio * union + (1 - mix_ratio) * product).alias("w")).where("w <> 0")


def symmetrize(weights: DataFrame) -> DataFrame:
    return _both_ways(weights).groupBy("i", "j").agg((F.sum("w") / 2).alias("w")).where("w <> 0")


def perplexity(knn: DataFrame, perplexity: float) -> DataFrame:
    """(i, j, w, sigma, dint): row-normalised Gaussian affinities at the given perplexity, and the intrinsic dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            d = _padded(b.column(2))[:, 1:]
            real = ~np.isnan(d)
            d2 = np.where(real, d, 0.0) ** 2
            shift = np.where(real, d2 - np.where(real, d2, np.inf).min(1, keepdims=True), 0.0)

            def entropy(beta):
                w = np.where(real, np.exp(-shift * beta[:, None]), 0.0)
                z = w.sum(1)
                return np.log(z) + beta * (shift * w).sum(1) / z

            beta, _ = bisect(entropy, np.full(len(d), np.log(perplexity)), 200, 1e-5, False)
            w = np.where(real, np.exp(-shift * beta[:, None]), 0.0)
            p = w / w.sum(1, keepdims=True)
            logp = np.log(p + np.finfo(float).eps)
            h = -(p * logp).sum(1)
            dint = -2 * (d2 * p * (logp + h[:, None])).sum(1) * beta
            i = np.asarray(b.column(0))
            r, c = np.nonzero(real)
            j = np.concatenate([np.asarray(x[1:]) for x in b.column(1).to_pylist()])
            cols = [i[r], j, p[r, c], (1 / np.sqrt(beta))[r], dint[r]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["i", "j", "w", "sigma", "dint"])

    return _vertices(knn).mapInArrow(run, "i long, j long, w double, sigma double, dint double")


def knn_kernel(knn: DataFrame) -> DataFrame:
    """Every neighbour counts 1 / (k - 1); symmetrised."""
    n = F.count("*").over(W.partitionBy("i"))
    return symmetrize(knn.where("i <> j").select("i", "j", (1.0 / n).alias("w")))


def scale_radii(stats: DataFrame, a: float, scale: float) -> DataFrame:
    """(i, ai): -log local radius, stretched over all vertices to log(a * 10^(-2 scale)) .. log(a * 10^(2 scale)); ai = sqrt(exp)."""
    low, high = np.log(a * 10 ** (-2 * scale)), np.log(a * 10 ** (2 * scale))
    x = -F.log("localr")
    ends = stats.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    span = (ends["hi"] - ends["lo"]) or 1.0
    return stats.select("i", F.sqrt(F.exp((x - F.lit(ends["lo"])) / F.lit(span) * F.lit(high - low) + F.lit(low))).alias("ai"))


def _default(g: DataFrame) -> float:
    return max((g.agg(F.min("w")).first()[0] or 0.0) / 2, 1e-8)


def _paired(x: DataFrame, y: DataFrame) -> tuple[DataFrame, float, float]:
    lx, ly = _default(x), _default(y)
    both = x.select("i", "j", F.col("w").alias("l")).join(y.select("i", "j", F.col("w").alias("r")), ["i", "j"], "full_outer")
    return both.select("i", "j", F.coalesce("l", F.lit(lx)).alias("l"), F.coalesce("r", F.lit(ly)).alias("r"), (F.coalesce("l", F.lit(0.0)) + F.coalesce("r", F.lit(0.0))).alias("s")), lx, ly


def general_intersection(x: DataFrame, y: DataFrame, weight: float = 0.5) -> DataFrame:
    """Missing weights are half the smallest; the side of less weight is damped; cells at both defaults keep their sum."""
    both, lx, ly = _paired(x, y)
    l, r = F.col("l"), F.col("r")
    w = l * F.pow(r, F.lit(weight / (1 - weight))) if weight < 0.5 else r * F.pow(l, F.lit((1 - weight) / weight))
    return both.select("i", "j", F.when((l > lx) | (r > ly), w).otherwise(F.col("s")).alias("w")).where("w <> 0")


def general_union(x: DataFrame, y: DataFrame) -> DataFrame:
    both, _, _ = _paired(x, y)
    return both.select("i", "j", (F.col("l") + F.col("r") - F.col("l") * F.col("r")).alias("w")).where("w <> 0")


def reset_metric(g: DataFrame, neighbours: float = 15.0) -> DataFrame:
    """Raise each vertex's weights to the power at which they sum to log2(neighbours)."""
    packed = g.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "w"))).alias("v")).select("i", F.col("v.j").alias("j"), F.col("v.w").alias("w"))
    goal = float(np.log2(neighbours))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            w = _padded(b.column(2))
            real = ~np.isnan(w)
            p = np.where(real, w, 0.0)
            power = lambda m: np.where(real, np.power(p, m[:, None]), 0.0)
            low, high, m, done = np.zeros(len(p)), np.full(len(p), BIG), np.ones(len(p)), np.zeros(len(p), bool)
            for _ in range(32):
                v = power(m).sum(1)
                done |= np.abs(v - goal) < 1e-5
                less = ~done & (v < goal)
                more = ~done & (v >= goal)
                high = np.where(less, m, high)
                low = np.where(more, m, low)
                m = np.where(done, m, np.where(high == BIG, m * 2, (low + high) / 2))
            r, c = np.nonzero(real)
            j = np.concatenate([np.asarray(x) for x in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(b.column(0))[r]), pa.array(j), pa.array(power(m)[r, c])], names=["i", "j", "w"])

    return packed.mapInArrow(run, "i long, j long, w double")


def reset_connectivity(g: DataFrame, metric: bool = False, neighbours: float = 15.0) -> DataFrame:
    """Divide by each vertex's largest weight, optionally reset the metric, and unite both directions."""
    top = F.max("w").over(W.partitionBy("i"))
    out = g.select("i", "j", (F.col("w") / top).alias("w"))
    return fuzzy(reset_metric(out, neighbours) if metric else out)


def intersect(x: DataFrame, y: DataFrame, weight: float = 0.5, reset: bool = True) -> DataFrame:
    return reset_connectivity(general_intersection(x, y, weight), metric=reset)


def union(x: DataFrame, y: DataFrame) -> DataFrame:
    return reset_connectivity(general_union(x, y), metric=True)


def categorical_intersection(g: DataFrame, labels: DataFrame, weight: float = 0.5) -> DataFrame:
    """labels: (id, label); unknown on either end costs a factor e^-1, different labels e^-far."""
    far = 1e12 if weight >= 1 else 2.5 / (1 - weight)
    a, b = (labels.select(F.col("id").alias(k), F.col("label").alias(f"l{k}")) for k in "ij")
    known = g.join(a, "i", "left").join(b, "j", "left")
    w = F.when(F.col("li").isNull() | F.col("lj").isNull(), F.col("w") * F.exp(F.lit(-1.0))).when(F.col("li") != F.col("lj"), F.col("w") * F.exp(F.lit(-far))).otherwise(F.col("w"))
    return reset_connectivity(known.select("i", "j", w.alias("w")).where("w <> 0"))


def components(g: DataFrame, vertices: DataFrame | None = None, rounds: int = 60) -> DataFrame:
    """(id, component): numbered from 0 by each component's smallest vertex. Labels spread and are halved along pointers each round."""
    ids = (g.select(F.col("i").alias("id")).union(g.select("j")) if vertices is None else vertices.select("id")).distinct()
    e = cut(g.select("i", "j").union(g.select("j", "i")).where("i <> j").distinct())
    label = cut(ids.select("id", F.col("id").alias("c")))
    for _ in range(rounds):
        near = e.join(label, e["j"] == label["id"]).groupBy("i").agg(F.min("c").alias("n"))
        low = label.join(near, label["id"] == near["i"], "left").select("id", "c", F.least("c", F.coalesce("n", "c")).alias("n"))
        up = low.select(F.col("id").alias("p"), F.col("n").alias("pn"))
        new = cut(low.join(up, low["n"] == up["p"], "left").select("id", "c", F.least("n", F.coalesce("pn", "n")).alias("n")))
        changed = new.where("n <> c").limit(1).count()
        label = new.select("id", F.col("n").alias("c"))
        if not changed:
            break
    else:
        raise RuntimeError(f"labels still change after {rounds} rounds")
    numbered = number(label.select("c").distinct(), ["c"], "component")
    return label.join(numbered, "c").select("id", "component")


def prune(g: DataFrame, epochs: int, top: float | None = None) -> DataFrame:
    """Drops edges too light to be sampled in so many epochs. top: the weight that is sampled in each (the heaviest if None)."""
    if epochs <= 0:
        return g
    return g.where(F.col("w") >= F.lit(((g.agg(F.max("w")).first()[0] or 0.0) if top is None else top) / epochs))
