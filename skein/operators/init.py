"""Initial coordinates: spectral, principal components, random, and their scaling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.operators.components import each_row, leading, packed_rows
from skein.operators.graph import components, fuzzy, smooth
from skein.operators.knn import mid_near
from skein.operators.layout import BROADCAST_CELLS
from skein.operators.scaling import apply_pca, fit_pca, gram
from skein.operators.tables import cut

NAMES = ("spectral", "random", "lvrandom", "normlaplacian", "laplacian", "spca", "pca", "inormlaplacian", "ispectral", "agspectral", "irlba_spectral", "irlba_laplacian", "pacpca", "midspectral")
SPECTRAL = ("spectral", "normlaplacian", "laplacian", "inormlaplacian", "ispectral", "irlba_spectral", "irlba_laplacian")


def name_of(init: str) -> str:
    """Partial names are taken where one name fits."""
    fits = [x for x in NAMES if x == init] or [x for x in NAMES if x.startswith(init)]
    if not fits:
        raise ValueError(f"unknown init {init!r}; known are {NAMES}")
    return fits[0]


def scale_coords(coords: DataFrame, sdev: float | str | None) -> DataFrame:
    """A number: centre and give each column that standard deviation; "range": each column to 0..10; None: as they are."""
    if sdev is None:
        return coords
    dim = coords.select(F.size("y")).first()[0]
    fs = (F.min, F.max) if sdev == "range" else (F.avg, F.stddev_samp)
    one = coords.agg(*[f(F.col("y")[k]).alias(f"{n}{k}") for k in range(dim) for n, f in zip("ab", fs)]).first()
    if sdev == "range":
        cols = [(F.col("y")[k] - one[f"a{k}"]) / F.lit((one[f"b{k}"] - one[f"a{k}"]) or 1.0) * 10.0 for k in range(dim)]
    else:
        cols = [(F.col("y")[k] - one[f"a{k}"]) * F.lit(float(sdev) / (one[f"b{k}"] or 1.0)) for k in range(dim)]
    return coords.withColumn("y", F.array(*cols))


def random_coords(ids: DataFrame, dim: int, seed: int = 42, normal: bool = False) -> DataFrame:
    """U(-10, 10), or N(0, 1e-4); by a hash of the id, so that partitions do not matter."""
    u = lambda salt: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col("id")), F.lit(2**53)) + 0.5) / float(2**53)
    one = lambda k: F.sqrt(-2.0 * F.log(u(2 * k))) * F.cos(2 * np.pi * u(2 * k + 1)) * 1e-4 if normal else u(2 * k) * 20.0 - 10.0
    return ids.select("id", F.array(*[one(k) for k in range(dim)]).alias("y"))


def pca_coords(rows: DataFrame, dim: int) -> DataFrame:
    return apply_pca(rows, fit_pca(rows, dim)).select("id", F.col("x").alias("y"))


def normalized_entries(g: DataFrame) -> DataFrame:
    """(i, j, v): entries of D^-1/2 A D^-1/2."""
    degree = g.groupBy("i").agg(F.sum("w").alias("deg"))
    both = g.join(degree, "i").join(degree.select(F.col("i").alias("j"), F.col("deg").alias("deg_j")), "j")
    return both.select("i", "j", (F.col("w") / F.sqrt(F.col("deg") * F.col("deg_j"))).alias("v"))


def _starting(ids: DataFrame, width: int, seed: int) -> DataFrame:
    return random_coords(ids, width, seed, normal=True)


def eigen_coords(g: DataFrame, n: int, dim: int, rounds: int = 60, seed: int = 42, walk: bool = False) -> DataFrame | None:
    """Eigenvectors 2 .. dim + 1 of the normalised graph by subspace iteration; ids are 0 to n - 1; None for graphs of too few vertices.

    Up to BROADCAST_CELLS numbers, each round multiplies a few vectors, broadcast, with edges held in partitions; beyond, vectors are a table
    that is joined with the edges. Both start alike and stop by the same rule. walk: of the random walk.
    """
    width = dim + 5
    if n < 3 or n <= dim + 1:
        return None
    small = n * width <= BROADCAST_CELLS
    y = _eigen_local(g, n, width, dim, rounds, seed, walk) if small else _eigen_joined(g, width, dim, rounds, seed, walk)
    top = y.agg(*[F.max_by(F.col("y")[k], F.abs(F.col("y")[k])).alias(f"t{k}") for k in range(dim)]).first()
    return y.withColumn("y", F.array(*[F.col("y")[k] * float(np.sign(top[f"t{k}"]) or 1.0) for k in range(dim)]))


def krylov_coords(g: DataFrame, n: int, dim: int, seed: int = 42, walk: bool = False, tol: float = 1e-6, products: int = 200) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(coordinates, values, residuals): eigenvectors 2 .. dim + 1 as eigen_coords has them, from a restarted block Krylov basis, which also tells
    apart values that lie close together. A product joins the edges with the basis' newest vectors; nothing of n rows leaves the tasks.
    Raises RuntimeError if residuals are not below tol after so many products.
    """
    degree = g.groupBy(F.col("i").alias("id")).agg(F.sum("w").alias("deg"))
    edges = cut(normalized_entries(g))

    def times(x: DataFrame, width: int) -> DataFrame:
        both = edges.join(each_row(x, "x", width).withColumnRenamed("at", "j"), "j")
        sums = both.groupBy(F.col("i").alias("at")).agg(*[F.sum(F.col("v") * F.col("x")[k]).alias(f"s{k}") for k in range(width)])
        return packed_rows(sums.select("at", F.array(*[f"s{k}" for k in range(width)]).alias("v")), n)

    found = leading(times, n, dim + 1, False, tol=tol, products=products, seed=seed, spark=g.sparkSession)
    v = each_row(found.blocks, "v", len(found.values)).withColumnRenamed("at", "id").join(degree, "id")
    size = 1 / F.sqrt("deg") if walk else F.lit(1.0)
    y = cut(v.select("id", F.array(*[F.col("v")[k] * size for k in range(1, dim + 1)]).alias("y")))
    top = y.agg(*[F.max_by(F.col("y")[k], F.abs(F.col("y")[k])).alias(f"t{k}") for k in range(dim)]).first()
    y = y.withColumn("y", F.array(*[F.col("y")[k] * float(np.sign(top[f"t{k}"]) or 1.0) for k in range(dim)]))
    return y, found.values[1:], found.residuals[1:]


def mid_near_graph(g: DataFrame, rows: DataFrame, n: int, weight: float = 0.9, mid: int = 5, draws: int = 6, seed: int = 42) -> DataFrame:
    """weight times g, and 1 - weight times the fuzzy graph of `mid` rows that are neither near nor far: the second closest of `draws`."""
    if not 0 <= weight <= 1:
        raise ValueError("graph_weight lies from 0 to 1")
    by_distance = F.row_number().over(W.partitionBy("i").orderBy("d", "j"))
    far = fuzzy(smooth(mid_near(rows, n, mid, draws, seed).groupBy("i", "j").agg(F.min("d").alias("d")).withColumn("rank", by_distance)))
    parts = [df.select("i", "j", (F.col("w") * share).alias("w")) for df, share in ((g, weight), (far, 1 - weight)) if share > 0]
    both = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    return cut(both.groupBy("i", "j").agg(F.sum("w").alias("w")))


def _settled(value: np.ndarray, last: np.ndarray, dim: int) -> bool:
    return bool(np.abs(value - last)[-dim - 1 :].max() < 1e-7)


def _eigen_joined(g: DataFrame, width: int, dim: int, rounds: int, seed: int, walk: bool) -> DataFrame:
    degree = cut(g.groupBy("i").agg(F.sum("w").alias("deg")))
    entries = cut(normalized_entries(g))
    q = cut(_turned(_starting(degree.select(F.col("i").alias("id")), width, seed), None))
    last = np.zeros(width)
    for _ in range(rounds):
        part = entries.join(q, entries["j"] == q["id"]).select("i", F.transform("y", lambda x: x * F.col("v")).alias("y"))
        part = part.groupBy(F.col("i").alias("id")).agg(F.array(*[F.sum(F.col("y")[k]) for k in range(width)]).alias("p"))
        z = cut(q.join(part, "id").select("id", "y", F.zip_with("p", "y", lambda a, b: a + b).alias("z")))
        _, _, square = gram(z.select(F.concat("y", "z").alias("x")))  # a few vectors' products
        value, turn = np.linalg.eigh((square[:width, width:] + square[:width, width:].T) / 2)
        q = cut(_turned(z.select("id", F.col("z").alias("y")), turn[:, ::-1]))
        if _settled(value, last, dim):
            break
        last = value
    if walk:
        q = q.join(degree.select(F.col("i").alias("id"), "deg"), "id").select("id", F.transform("y", lambda x: x / F.sqrt("deg")).alias("y"))
    q = q.select("id", F.slice("y", 2, dim).alias("y"))
    if walk:
        size = q.agg(*[F.sqrt(F.sum(F.col("y")[k] ** 2)).alias(f"n{k}") for k in range(dim)]).first()
        q = q.withColumn("y", F.array(*[F.col("y")[k] / size[f"n{k}"] for k in range(dim)]))
    return q


def _turned(z: DataFrame, turn: np.ndarray | None) -> DataFrame:
    """z (times turn) with orthonormal columns; only their products come to the driver."""
    _, _, square = gram(z, "y")
    turn = np.eye(len(square)) if turn is None else turn
    low = np.linalg.cholesky(turn.T @ square @ turn)
    by = turn @ np.linalg.inv(low).T
    return apply_pca(z, {"center": 0.0, "rotation": by}, "y")


def _eigen_local(g: DataFrame, n: int, width: int, dim: int, rounds: int, seed: int, walk: bool) -> DataFrame:
    spark = g.sparkSession
    degree = g.groupBy("i").agg(F.sum("w").alias("deg")).toPandas()  # n rows, checked above
    deg = np.zeros(n)
    deg[degree["i"].to_numpy()] = degree["deg"].to_numpy()
    half = 1 / np.sqrt(np.where(deg > 0, deg, 1.0))
    parts = max(1, min(spark.sparkContext.defaultParallelism, -(-g.count() // 50_000)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            cols = [np.concatenate([np.asarray(b.column(k)) for b in held]) for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cols], names=["i", "j", "w"])

    # each partition has the edges of some vertices that follow each other, and sums for those alone
    own = g.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("w").cast("double").alias("w")).repartitionByRange(parts, "i")
    entries = own.mapInArrow(pack, "i binary, j binary, w binary").cache()

    def times(q: np.ndarray) -> np.ndarray:
        known = spark.sparkContext.broadcast(q * half[:, None])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x = known.value
            for b in batches:
                for r in b.to_pylist():
                    i, j = (np.frombuffer(r[k], np.int64) for k in ("i", "j"))
                    low, w = i.min(), np.frombuffer(r["w"])
                    out = np.stack([np.bincount(i - low, w * x[j, c]) for c in range(x.shape[1])], 1)
                    yield pa.RecordBatch.from_arrays([pa.array([low]), pa.array([out.tobytes()], pa.binary())], names=["low", "s"])

        total = np.zeros_like(q)
        for r in entries.mapInArrow(run, "low long, s binary").collect():
            part = np.frombuffer(r["s"]).reshape(-1, q.shape[1])
            total[r["low"] : r["low"] + len(part)] += part
        known.unpersist()
        return total * half[:, None] + q  # the graph's matrix plus one has no negative eigenvalues

    def orthonormal(z: np.ndarray) -> np.ndarray:
        return z @ np.linalg.inv(np.linalg.cholesky(z.T @ z)).T

    try:
        start = _starting(spark.range(n), width, seed).toPandas().sort_values("id")
        q = orthonormal(np.stack(start["y"].to_numpy()))
        last = np.zeros(width)
        for _ in range(rounds):
            z = times(q)
            value, turn = np.linalg.eigh((q.T @ z + z.T @ q) / 2)
            q = orthonormal(z @ turn[:, ::-1])
            if _settled(value, last, dim):
                break
            last = value
    finally:
        entries.unpersist()
    if walk:
        q = q * half[:, None]
    y = q[:, 1 : dim + 1]
    if walk:
        y = y / np.linalg.norm(y, axis=0)
    return spark.createDataFrame(pa.table({"id": np.arange(n), "y": pa.array(y.tolist(), pa.list_(pa.float64()))}))


def scale_and_jitter(coords: DataFrame, top: float = 10.0, sdev: float = 1e-4, seed: int = 42) -> DataFrame:
    largest = coords.agg(F.max(F.array_max(F.transform("y", F.abs)))).first()[0] or 1.0
    noise = random_coords(coords.select("id"), coords.select(F.size("y")).first()[0], seed, normal=True).withColumnRenamed("y", "e")
    return coords.join(noise, "id").select("id", F.zip_with("y", "e", lambda y, e: y * F.lit(top / largest) + e * F.lit(sdev / 1e-4)).alias("y"))


def initial(init: str, g: DataFrame, rows: DataFrame | None, n: int, dim: int, sdev: float | str | None = None, seed: int = 42, rate: float = 5.0) -> DataFrame:
    """(id, y) by name; a spectral start on a graph in pieces falls back to scaled principal components, or random without features."""
    init, spark = name_of(init), g.sparkSession
    ids = spark.range(n)
    if init == "midspectral":
        if rows is None:
            raise ValueError(f"init {init} needs features")
        g, init = mid_near_graph(g, rows, n, seed=seed), "spectral"
    if init in SPECTRAL and components(g, ids).agg(F.max("component")).first()[0]:
        init, sdev = ("spca", 1.0) if rows is not None else ("random", sdev)
    if init in ("pca", "spca", "pacpca") and rows is None:
        raise ValueError(f"init {init} needs features")
    if init in SPECTRAL or init == "agspectral":
        if init == "agspectral":
            extra = ids.select(F.col("id").alias("i"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(int(rate))), lambda k: F.pmod(F.xxhash64(F.lit(seed), k, F.col("id")), F.lit(n)))).alias("j")).where("i <> j")
            flat = g.select("i", "j", F.lit(1.0).alias("w")).union(extra.select("i", "j", F.lit(0.1).alias("w"))).union(extra.select("j", "i", F.lit(0.1).alias("w")))
            g = flat.groupBy("i", "j").agg(F.when(F.max("w") >= 1, 1.0).otherwise(0.1).alias("w"))
        out = eigen_coords(g, n, dim, seed=seed, walk=init in ("laplacian", "irlba_laplacian"))
        out = random_coords(ids, dim, seed) if out is None else scale_and_jitter(out, seed=seed) if "spectral" in init else out
    elif init in ("random", "lvrandom"):
        out = random_coords(ids, dim, seed, normal=init == "lvrandom")
    else:
        out = pca_coords(rows, dim)
        if init == "spca":
            sdev = 1e-4 if sdev is None else sdev
        if init == "pacpca":
            out = out.withColumn("y", F.transform("y", lambda x: x * 0.01))
    return scale_coords(out, sdev)
