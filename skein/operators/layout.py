"""Layouts: the curve, the sampling schedule, gradients, and epochs as Spark jobs.

An epoch joins the edges that fire with the coordinates of both ends and of the sampled other vertices, sums clamped gradients per head, and
moves all vertices. epoch() is that plan in DataFrame operations, at any size. optimize() runs many epochs and keeps edges packed per head
partition; the coordinates, whose size is checked against BROADCAST_CELLS, are broadcast, and beyond it every epoch is a plan of joins with the
same draws, so that the size changes how the work is done but not its result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.tables import cut, number

EPS = 1.1920928955078125e-07
BROADCAST_CELLS = 8_000_000
KERNELS = ("umap", "tumap", "largevis", "leopold")


def find_ab(spread: float = 1.0, min_dist: float = 0.01) -> tuple[float, float]:
    """a and b of 1 / (1 + a x^(2b)), fitted by least squares to 1 below min_dist and an exponential beyond."""
    x = np.linspace(0, spread * 3, 300)
    y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    p = np.array([1.0, 1.0])
    lx = np.log(np.where(x > 0, x, 1e-300))

    def curve(a, b):
        return np.where(x > 0, np.exp(2 * b * lx), 0.0) * a + 1

    cost, damp = np.inf, 1e-3
    for _ in range(500):
        c = curve(*p)
        res = y - 1 / c
        cost = (res**2).sum()
        power = (c - 1) / p[0]
        jac = np.stack([-power / c**2, -(c - 1) * 2 * np.where(x > 0, lx, 0) / c**2], 1)
        h = jac.T @ jac
        step = np.linalg.solve(h + damp * np.diag(np.diag(h) + 1e-12), jac.T @ res)
        q = p + step
        if q[0] > 0 and ((y - 1 / curve(*q)) ** 2).sum() < cost:
            p, damp = q, damp / 5
            if np.abs(step).max() < 1e-12:
                break
        else:
            damp *= 5
            if damp > 1e12:
                break
    if not np.isfinite(p).all():
        raise ValueError("Can't find a, b for provided spread and min_dist values")
    return float(p[0]), float(p[1])


def epochs_per_sample(g: DataFrame, top: float | None = None) -> DataFrame:
    """g with eps = top / w, top being the heaviest weight if None; edges of no weight never fire (-1)."""
    top = (g.agg(F.max("w")).first()[0] or 0.0) if top is None else top
    return g.withColumn("eps", F.when(F.col("w") > 0, F.lit(top) / F.col("w")).otherwise(-1.0))


def number_edges(g: DataFrame) -> DataFrame:
    """edge_id from 0 in order of (i, j)."""
    return number(g, ["i", "j"], "edge_id")


def schedule(edges: DataFrame, epoch: int, rate: float = 5.0) -> DataFrame:
    """Edges that fire in the epoch, with the number of negatives: the k-th firing is at ceil(k * eps)."""
    p, t = F.col("eps"), float(epoch)
    k = F.floor(F.lit(t) / p)
    fires = (p > 0) & (k >= 1) & (F.ceil(k * p) == epoch)
    before = F.when(k == 1, F.lit(1)).otherwise(F.floor(rate * F.ceil((k - 1) * p) / p))
    return edges.where(fires).withColumn("negatives", F.greatest(F.lit(0), F.floor(rate * F.lit(t) / p) - before))


def _coefficients(kernel: str, d2, a, b, gamma, lib):
    """(attract, repel) factors of the difference; works on columns and arrays alike."""
    if kernel in ("umap", "leopold"):
        p = lib.pow(d2, b)
        up = 1.0 if kernel == "leopold" else gamma
        return -2.0 * a * b * p / (d2 * (a * p + 1.0)), 2.0 * up * b / ((0.001 + d2) * (a * p + 1.0))
    lift = 0.1 if kernel == "largevis" else 0.001
    return -2.0 / (d2 + 1.0), 2.0 * gamma / ((lift + d2) * (d2 + 1.0))


class _Sql:
    @staticmethod
    def pow(x: Column, b: float) -> Column:
        return F.pow(x, F.lit(b))


class _Np:
    pow = staticmethod(np.power)


def bound(kernel: str) -> float:
    return 5.0 if kernel == "largevis" else 4.0


def epoch(coords: DataFrame, edges: DataFrame, t: int, n_epochs: int, n: int, kernel: str = "umap", a: float = 1.0, b: float = 1.0, gamma: float = 1.0, rate: float = 5.0, alpha: float = 1.0, optimizer: str = "sgd", beta1: float = 0.5, beta2: float = 0.9, eps: float = 1e-7) -> DataFrame:
    """One batch epoch as a plan of joins, with the deterministic negative (edge_id * (t + 1)) mod n.

    coords: (id, y array<double>[, m, v, ai]); edges: (edge_id, i, j, eps). Gradients are summed in the order of edges, so that the
    result does not depend on partitions.
    """
    fired = schedule(edges, t, rate)
    pulls = fired.select("i", F.col("j").alias("o"), F.lit(2.0).alias("mult"), F.lit(True).alias("pull"), F.col("edge_id").alias("at"))
    pushes = fired.select("i", F.pmod(F.col("edge_id") * (t + 1), F.lit(n)).alias("o"), F.col("negatives").cast("double").alias("mult"), F.lit(False).alias("pull"), F.col("edge_id").alias("at"))
    return _moved(coords, pulls.union(pushes.where("o <> i and mult > 0")), None, t, n_epochs, kernel, a, b, gamma, alpha, optimizer, beta1, beta2, eps)


def _moved(coords: DataFrame, acts: DataFrame, fixed: DataFrame | None, t: int, n_epochs: int, kernel: str, a: float, b: float, gamma: float, alpha: float, optimizer: str, beta1: float, beta2: float, eps: float) -> DataFrame:
    """coords after the acts (i, o, mult, pull, at) of an epoch. fixed: where the other ends are, if they do not move."""
    with_ai = "ai" in coords.columns
    head = coords.select(F.col("id").alias("i"), F.col("y").alias("yi"), *[F.col("ai").alias("ai_i")] * with_ai)
    tail = (coords if fixed is None else fixed).select(F.col("id").alias("o"), F.col("y").alias("yo"), *[F.col("ai").alias("ai_o")] * with_ai)
    acts = acts.join(head, "i").join(tail, "o")
    diff = F.zip_with("yi", "yo", lambda x, y: x - y)
    acts = acts.withColumn("diff", diff).withColumn("d2", F.greatest(F.lit(EPS), F.aggregate("diff", F.lit(0.0), lambda s, x: s + x * x)))
    size = F.col("ai_i") * F.col("ai_o") if with_ai else F.lit(a)
    pull, push = _coefficients(kernel, F.col("d2"), size, b, gamma, _Sql)
    top = bound(kernel)
    grad = F.transform("diff", lambda x: F.col("mult") * F.greatest(F.lit(-top), F.least(F.lit(top), F.when(F.col("pull"), pull).otherwise(push) * x)))
    per = acts.select("i", "at", "pull", grad.alias("g")).groupBy("i").agg(F.array_sort(F.collect_list(F.struct("at", "pull", "g"))).alias("gs"))
    total = per.select(F.col("i").alias("id"), F.aggregate(F.slice(F.col("gs.g"), 2, F.size("gs")), F.col("gs.g")[0], lambda s, x: F.zip_with(s, x, lambda u, v: u + v)).alias("g"))
    moved = coords.join(total, "id", "left").withColumn("g", F.coalesce("g", F.transform("y", lambda x: F.lit(0.0))))
    step = alpha if t == 0 else alpha * (1 - (t - 1) / n_epochs)
    keep = [c for c in coords.columns if c not in ("y", "m", "v")]
    if optimizer == "sgd":
        return moved.select(*keep, F.zip_with("y", "g", lambda y, g: y + step * g).alias("y"))
    s, e = step * np.sqrt(1 - beta2 ** (t + 1)) / (1 - beta1 ** (t + 1)), eps * np.sqrt(1 - beta2 ** (t + 1))
    moved = moved.withColumn("v", F.zip_with("v", "g", lambda v, g: v + (1 - beta2) * (g * g - v))).withColumn("m", F.zip_with("m", "g", lambda m, g: m + (1 - beta1) * (g - m)))
    delta = F.zip_with("m", "v", lambda m, v: F.lit(float(s)) * m / (F.sqrt(v) + F.lit(float(e))))
    return moved.select(*keep, F.zip_with("y", delta, lambda y, d: y + d).alias("y"), "m", "v")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def draw(seed: int, t: int, edge: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """Vertices by a counter: the same for any partitioning."""
    key = edge.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 1_000_003 + t * 97)
    return (_mix(_mix(key) + place.astype(np.uint64)) % np.uint64(n)).astype(np.int64)


def sampled(fired: DataFrame, t: int, n: int, seed: int, fitting: bool) -> DataFrame:
    """(i, o, mult, pull, at) of the edges that fire: each pull, and each of its negatives, drawn among n vertices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e, i, j, many = (np.asarray(batch.column(k)).astype(np.int64) for k in range(4))
            edge = np.repeat(np.arange(len(e)), many)
            o = draw(seed, t, e[edge], np.arange(len(edge)) - np.repeat(np.cumsum(many) - many, many), n)
            edge, o = (x[o != i[edge]] for x in (edge, o)) if fitting else (edge, o)
            pull = np.arange(len(e) + len(edge)) < len(e)
            cols = np.concatenate([i, i[edge]]), np.concatenate([j, o]), np.where(pull & fitting, 2.0, 1.0), pull, np.concatenate([e, e[edge]])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["i", "o", "mult", "pull", "at"])

    return fired.select("edge_id", "i", "j", "negatives").mapInArrow(run, "i long, o long, mult double, pull boolean, at long")


def optimize(
    coords: DataFrame, edges: DataFrame, n_epochs: int, kernel: str = "umap", a: float = 1.0, b: float = 1.0, gamma: float = 1.0, rate: float = 5.0, alpha: float = 1.0, optimizer: str = "adam",
    seed: int = 42, beta1: float = 0.5, beta2: float = 0.9, eps: float = 1e-7, fixed: DataFrame | None = None, callback: Callable | None = None,
) -> DataFrame:
    """(id, y) after n_epochs batch epochs. coords: (id from 0, y[, ai]); edges: (edge_id, i, j, eps).

    fixed: coordinates of the tails that do not move (a transform); then j and the negatives are among them.
    """
    dim, n = coords.select(F.size("y")).first()[0], coords.count()
    others = n if fixed is None else fixed.count()
    with_ai = "ai" in coords.columns
    if (n + others) * dim > BROADCAST_CELLS:
        state = coords.withColumns({x: F.transform("y", lambda x: F.lit(0.0)) for x in ("m", "v")}) if optimizer == "adam" else coords
        for t in range(n_epochs):
            acts = sampled(schedule(edges, t, rate), t, others, seed, fixed is None)
            state = _moved(state, acts, fixed, t, n_epochs, kernel, a, b, gamma, alpha, optimizer, beta1, beta2, eps)
            state = cut(state) if t % 5 == 4 or t == n_epochs - 1 or callback else state
            if callback:  # here with a table of coordinates
                callback(t + 1, n_epochs, state.select("id", "y"), *([] if fixed is None else [fixed]))
        return state.select("id", "y")
    spark = coords.sparkSession

    def table(df: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
        p = df.select("id", "y", *["ai"] * with_ai).toPandas().sort_values("id")  # at most BROADCAST_CELLS numbers
        if p["id"].tolist() != list(range(rows)):
            raise ValueError("ids of coordinates must be 0 to n - 1")
        return np.stack(p["y"].to_numpy()).astype(float) if rows else np.empty((0, dim)), p["ai"].to_numpy() if with_ai else np.ones(rows)

    y, ai = table(coords, n)
    base, base_ai = (y, ai) if fixed is None else table(fixed, others)
    m, v, top, fitting = np.zeros_like(y), np.zeros_like(y), bound(kernel), fixed is None

    # heads are dealt to partitions once; a head's edges, and so its gradient, are all in one
    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("edge_id")
        return pa.table({k: pa.array([np.asarray(t.column(k)).tobytes()], pa.binary()) for k in ("edge_id", "i", "j", "eps")})

    parts = max(1, min(spark.sparkContext.defaultParallelism, -(-edges.count() // 20_000)))
    packed = edges.withColumn("_p", F.pmod(F.xxhash64("i"), F.lit(parts))).groupBy("_p").applyInArrow(lambda t: pack(t), "edge_id binary, i binary, j binary, eps binary").repartition(parts).cache()
    try:
        for t in range(n_epochs):
            known = spark.sparkContext.broadcast((y, base, ai, base_ai))
            here = t

            def gradients(batches: Iterator[pa.RecordBatch], known=known, t=here) -> Iterator[pa.RecordBatch]:
                y, base, ai, base_ai = known.value
                for batch in batches:
                    for r in batch.to_pylist():
                        e, i, j = (np.frombuffer(r[k], np.int64) for k in ("edge_id", "i", "j"))
                        p = np.frombuffer(r["eps"])
                        with np.errstate(divide="ignore", invalid="ignore"):
                            k = np.floor(t / p)
                            on = (p > 0) & (k >= 1) & (np.ceil(k * p) == t)
                            many = np.floor(rate * t / p) - np.where(k == 1, 1, np.floor(rate * np.ceil((k - 1) * p) / p))
                        e, i, j, many = e[on], i[on], j[on], np.maximum(0, many[on]).astype(np.int64)
                        from_ = np.repeat(np.arange(len(e)), many)
                        place = np.arange(len(from_)) - np.repeat(np.cumsum(many) - many, many)
                        o = draw(seed, t, e[from_], place, len(base))
                        ok = (o != i[from_]) if fitting else np.ones(len(o), bool)
                        g = np.zeros_like(y)
                        for heads, tails, pull in ((i, j, True), (i[from_][ok], o[ok], False)):
                            diff = y[heads] - base[tails]
                            d2 = np.maximum(EPS, (diff**2).sum(1))
                            size = ai[heads] * base_ai[tails] if with_ai else a
                            c = _coefficients(kernel, d2, size, b, gamma, _Np)[0 if pull else 1]
                            step = np.clip(c[:, None] * diff, -top, top) * (2.0 if pull and fitting else 1.0)
                            for q in range(y.shape[1]):
                                g[:, q] += np.bincount(heads, step[:, q], len(y))
                        rows = np.flatnonzero(g.any(1))
                        yield pa.RecordBatch.from_arrays([pa.array([rows.tobytes()], pa.binary()), pa.array([g[rows].tobytes()], pa.binary())], names=["rows", "g"])

            grad = np.zeros_like(y)
            for r in packed.mapInArrow(gradients, "rows binary, g binary").collect():
                grad[np.frombuffer(r["rows"], np.int64)] = np.frombuffer(r["g"]).reshape(-1, dim)
            known.unpersist()
            step = alpha if t == 0 else alpha * (1 - (t - 1) / n_epochs)
            if optimizer == "sgd":
                y = y + step * grad
            else:
                v = v + (1 - beta2) * (grad**2 - v)
                m = m + (1 - beta1) * (grad - m)
                s, e_ = step * np.sqrt(1 - beta2 ** (t + 1)) / (1 - beta1 ** (t + 1)), eps * np.sqrt(1 - beta2 ** (t + 1))
                y = y + s * m / (np.sqrt(v) + e_)
            if fixed is None:
                base = y
            if callback:
                callback(t + 1, n_epochs, y.copy()) if fixed is None else callback(t + 1, n_epochs, y.copy(), base)
    finally:
        packed.unpersist()
    return spark.createDataFrame(pa.table({"id": np.arange(n), "y": pa.array(y.tolist(), pa.list_(pa.float64()))}))


def center(coords: DataFrame) -> DataFrame:
    """Subtracts the column means."""
    dim = coords.select(F.size("y")).first()[0]
    means = coords.agg(*[F.avg(F.col("y")[k]).alias(f"m{k}") for k in range(dim)]).first()
    return coords.withColumn("y", F.zip_with("y", F.array(*[F.lit(float(x)) for x in means]), lambda y, m: y - m))
