"""Leading directions of an operator over tables: principal components of sparse rows, and classical scaling of distances.

Both grow a restarted block Krylov basis. It lies in blocks of SIDE rows, packed (p, v); a step is one product of the data with the newest
columns, and only Gram matrices of the basis (a few dozen numbers square) come to the driver. Steps end when the leading pairs leave a
residual below `tol` of the largest value; not settling is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.tables import cut, number

SIDE = 1024  # rows of a block


def _packed(p: int, name: str, m: np.ndarray, **more: int) -> pa.RecordBatch:
    cols = {"p": p, **more}
    return pa.RecordBatch.from_arrays([*[pa.array([v], pa.int64()) for v in cols.values()], pa.array([np.ascontiguousarray(m).tobytes()], pa.binary())], names=[*cols, name])


def _each(df: DataFrame, name: str, what: Callable[..., np.ndarray], **widths: int) -> DataFrame:
    """(p, name): what of the matrices in the columns named by widths, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                yield _packed(r["p"], name, what(*[np.frombuffer(r[c]).reshape(-1, w) for c, w in widths.items()]))

    return df.select("p", *widths).mapInArrow(run, f"p long, {name} binary")


def _sums(df: DataFrame, what: Callable[..., np.ndarray], **widths: int) -> np.ndarray:
    """The sum over blocks of a small vector made from each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for r in b.to_pylist():
                one = what(*[np.frombuffer(r[c]).reshape(-1, w) for c, w in widths.items()])
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["k", "v"])

    parts = df.select(*widths).mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v"))
    return parts.toPandas().sort_values("k")["v"].to_numpy()


def _root(gram: np.ndarray) -> np.ndarray:
    """What turns vectors with this Gram matrix into orthonormal ones, as many as are independent."""
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    on = value > max(value.max(), 0) * 1e-12 + 1e-200
    return vector[:, on] / np.sqrt(value[on])


@dataclass
class Leading:
    blocks: DataFrame  # (p, v): orthonormal vectors, one for each value
    values: np.ndarray
    residuals: np.ndarray  # over the largest value
    products: int


def leading(times: Callable[[DataFrame, int], DataFrame], n: int, wanted: int, center: bool, extra: int = 8, blocks: int = 8, products: int = 200, tol: float = 1e-6, seed: int = 42, spark=None) -> Leading:
    """The largest values of a symmetric operator on n coordinates. times(x, width): (p, y), the operator on blocks (p, x). center: on what is
    orthogonal to the constant vector only."""
    size = n - 1 if center else n
    wanted, width = min(wanted, size), min(size, wanted + extra)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column(0).to_pylist():
                yield _packed(p, "y", np.random.default_rng([seed, p]).normal(size=(min(SIDE, n - p * SIDE), width)))

    basis, own, made = None, np.zeros((0, 0)), 0  # own: the operator within the basis
    fresh, c = spark.range(-(-n // SIDE)).withColumnRenamed("id", "p").mapInArrow(start, "p long, y binary"), 0
    while True:
        # y: what joins the basis, or the operator on its newest columns
        state = cut(fresh if basis is None else basis.join(fresh, "p"))
        w = width
        if basis is not None:
            # one job for what the basis holds of y, one for what is left, with what rounding left within the basis
            got = _sums(state, lambda v, y: np.concatenate([y.sum(0), (v.T @ y).ravel()]), v=c, y=w)
            low, inside = got[:w] / n if center else np.zeros(w), got[w:].reshape(c, w)
            own = np.pad(own, ((0, c - len(own)), (0, c - len(own))))
            own[:, c - w :], own[c - w :, :] = inside, inside.T
            rest = lambda v, y, low=low, inside=inside: y - low - v @ inside
            got = _sums(state, lambda v, y: np.concatenate([(v.T @ (r := rest(v, y))).ravel(), (r.T @ r).ravel()]), v=c, y=w)
            twice = got[: c * w].reshape(c, w)
            gram = got[c * w :].reshape(w, w) - twice.T @ twice
            value, turned = np.linalg.eigh((own + own.T) / 2)
            value, turned = value[::-1], turned[:, ::-1]
            left = np.sqrt(np.maximum(0, np.einsum("rk,rs,sk->k", turned[c - w :], gram, turned[c - w :]))) / max(abs(value).max(), 1e-300)
            if (left[:wanted] <= tol).all() or c >= size:
                top = turned[:, :wanted]
                return Leading(cut(_each(state, "v", lambda v: v @ top, v=c)), value[:wanted], left[:wanted], made)
            if made >= products:
                raise RuntimeError(f"not settled after {made} products: residuals {left[:wanted]}")
            root = _root(gram)
            if c + root.shape[1] > blocks * width or not root.shape[1]:
                # begin again with the best of the basis
                width = min(wanted + extra, c)
                top = turned[:, :width]
                basis, own, c = cut(_each(state, "v", lambda v: v @ top, v=c)), np.zeros((0, 0)), width
            else:
                basis = cut(_each(state, "v", lambda v, y: np.concatenate([v, (rest(v, y) - v @ twice) @ root], 1), v=c, y=w))
                c, width = c + root.shape[1], root.shape[1]
        else:
            low = _sums(state, lambda y: y.sum(0), y=w) / n if center else np.zeros(w)
            root = _root(_sums(state, lambda y: ((y - low).T @ (y - low)).ravel(), y=w).reshape(w, w))
            basis = cut(_each(state, "v", lambda y: (y - low) @ root, y=w))
            c = width = root.shape[1]
        at = c - width
        fresh, made = times(_each(basis, "x", lambda v: v[:, at:], v=c), width), made + 1


def each_row(df: DataFrame, name: str, width: int) -> DataFrame:
    """(at, name array) from blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                m = np.frombuffer(r[name]).reshape(-1, width)
                yield pa.RecordBatch.from_arrays([pa.array(r["p"] * SIDE + np.arange(len(m))), pa.array(m.tolist(), pa.list_(pa.float64()))], names=["at", name])

    return df.select("p", name).mapInArrow(run, f"at long, {name} array<double>")


def packed_rows(df: DataFrame, n: int) -> DataFrame:
    """(p, y): blocks from (at, v array) of n rows; rows that are not there are zero."""

    def pack(key: tuple, b: pa.Table) -> pa.Table:
        p = key[0].as_py()
        v = np.stack(b.column("v").to_pylist())
        m = np.zeros((min(SIDE, n - p * SIDE), v.shape[1]))
        m[np.asarray(b.column("at")) - p * SIDE] = v
        return pa.Table.from_batches([_packed(p, "y", m)])

    return df.withColumn("p", F.floor(F.col("at") / SIDE).cast("long")).groupBy("p").applyInArrow(pack, "p long, y binary")


def _signs(df: DataFrame, key: str, name: str, width: int) -> np.ndarray:
    """Each column's largest entry is to be positive."""
    ends = df.agg(*[F.max_by(F.col(name)[k], F.struct(F.abs(F.col(name)[k]), F.hash(key))) for k in range(width)]).first()
    return np.where(np.array(ends, float) < 0, -1.0, 1.0)


def _summed(df: DataFrame, key: str, width: int) -> DataFrame:
    """(key, v): per key, the sums of value times the vectors in v."""
    sums = df.groupBy(key).agg(*[F.sum(F.col("value") * F.col("v")[k]).alias(f"s{k}") for k in range(width)])
    return sums.select(key, F.array(*[f"s{k}" for k in range(width)]).alias("v"))


@dataclass
class Components:
    rotation: DataFrame  # (term, mean, loadings): an entry for each term that occurs
    variance: np.ndarray
    residual: np.ndarray
    shift: np.ndarray  # the centre's own scores


def sparse_pca(terms: DataFrame, n: int, components: int, center: bool = True, tol: float = 1e-6, seed: int = 42) -> Components:
    """Principal components of n rows in long form (id, term, value); what is not there is zero. No table is ever as wide as the terms.

    A product is two joins: rows with the terms' part of the basis, and back. Rows without values only count in n.
    """
    t = terms.where("value <> 0").select("id", "term", F.col("value").cast("double").alias("value"))
    means = number(t.groupBy("term").agg((F.sum("value") / n if center else F.lit(0.0)).alias("mean")), ["term"], "at")
    means = cut(means)
    size = means.count()
    t = cut(t.join(means.select("term", "at"), "term").select("id", "at", "value"))
    packed = lambda df: packed_rows(df, size)
    mean_blocks = cut(packed(means.select("at", F.array("mean").alias("v"))).withColumnRenamed("y", "m"))

    def times(x: DataFrame, width: int) -> DataFrame:
        scores = cut(_summed(t.join(each_row(x, "x", width).withColumnRenamed("x", "v"), "at"), "id", width))
        total = np.array(scores.agg(*[F.coalesce(F.sum(F.col("v")[k]), F.lit(0.0)) for k in range(width)]).first(), float)
        back = packed(_summed(t.join(scores, "id"), "at", width)).join(mean_blocks, "p")
        # (A - 1m')'(A - 1m') V = A'AV - m (1'AV) - (A'1 - n m) m'V, and the last bracket is zero
        return _each(back, "y", lambda y, m: (y - m * total) / max(1, n - 1), y=width, m=1)

    found = leading(times, size, components, False, tol=tol, seed=seed, spark=terms.sparkSession)
    width = len(found.values)
    loads = cut(means.join(each_row(found.blocks, "v", width), "at").select("term", "mean", "v"))
    sign = _signs(loads, "term", "v", width)
    loads = cut(loads.select("term", "mean", F.array(*[F.col("v")[k] * float(sign[k]) for k in range(width)]).alias("loadings")))
    shift = np.array(loads.agg(*[F.coalesce(F.sum(F.col("mean") * F.col("loadings")[k]), F.lit(0.0)) for k in range(width)]).first(), float)
    return Components(loads, found.values, found.residuals, shift)


def sparse_scores(terms: DataFrame, model: Components, ids: DataFrame | None = None) -> DataFrame:
    """(id, y) of rows in long form; ids: (id) of all rows, so that those without values are there too."""
    width = len(model.variance)
    rows = _summed(terms.join(model.rotation.select("term", F.col("loadings").alias("v")), "term"), "id", width).withColumnRenamed("v", "y")
    if ids is not None:
        rows = ids.select("id").join(rows, "id", "left").select("id", F.coalesce("y", F.array_repeat(F.lit(0.0), width)).alias("y"))
    return rows.select("id", F.array(*[F.col("y")[k] - float(model.shift[k]) for k in range(width)]).alias("y"))


def _distance_blocks(pairs: DataFrame, n: int) -> DataFrame:
    """(p, q, m): squared distances of SIDE rows and SIDE columns, from pairs given either or both ways."""
    e = pairs.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("d").cast("double").alias("d"))
    both = e.union(e.select("j", "i", "d")).groupBy("i", "j").agg(F.max("d").alias("d"))

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        p, q = key[0].as_py(), key[1].as_py()
        m = np.zeros((min(SIDE, n - p * SIDE), min(SIDE, n - q * SIDE)))
        m[np.asarray(t.column("i")) - p * SIDE, np.asarray(t.column("j")) - q * SIDE] = np.asarray(t.column("d")) ** 2
        return pa.Table.from_batches([_packed(p, "m", m, q=q)])

    by = [F.floor(F.col(c) / SIDE).cast("long").alias(b) for c, b in (("i", "p"), ("j", "q"))]
    return both.select("i", "j", "d", *by).groupBy("p", "q").applyInArrow(pack, "p long, q long, m binary")


def classical_scaling(pairs: DataFrame, n: int, dim: int, tol: float = 1e-6, seed: int = 42) -> DataFrame:
    """(id, y): coordinates whose products are those of the doubly centred squared distances (i, j, d) among ids 0 to n - 1.

    The table of distances is packed into blocks once; a product multiplies them with the basis' blocks. A coordinate whose value is not
    positive, as distances of no Euclidean space may give, is zero.
    """
    if dim >= n:
        raise ValueError(f"{n} rows have fewer than {dim} dimensions")
    blocks = cut(_distance_blocks(pairs, n))

    def times(x: DataFrame, width: int) -> DataFrame:
        def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    v = np.frombuffer(r["x"]).reshape(-1, width)
                    yield _packed(r["p"], "y", np.frombuffer(r["m"]).reshape(-1, len(v)) @ v / -2, q=r["q"])

        def added(t: pa.Table) -> pa.Table:
            order = np.argsort(np.asarray(t.column("q")))  # sums in the order of the columns
            y = sum(np.frombuffer(t.column("y")[int(k)].as_py()) for k in order)
            return pa.Table.from_batches([_packed(t.column("p")[0].as_py(), "y", y)])

        made = blocks.join(x.withColumnRenamed("p", "q"), "q").select("p", "q", "m", "x").mapInArrow(product, "p long, q long, y binary")
        return made.groupBy("p").applyInArrow(added, "p long, y binary")

    return _scaled(leading(times, n, dim, True, tol=tol, seed=seed, spark=pairs.sparkSession), dim)


def scaled_rows(rows: DataFrame, n: int, dim: int, tol: float = 1e-6, seed: int = 42) -> DataFrame:
    """(id, y): classical_scaling of the Euclidean distances of rows (id from 0 to n - 1, x array), of which no table is made.

    Their squares are |a|^2 + |b|^2 - 2 ab, so a product with all of them is two products with the rows: time, memory and disk follow n.
    """
    if dim >= n:
        raise ValueError(f"{n} rows have fewer than {dim} dimensions")
    blocks = cut(packed_rows(rows.select(F.col("id").alias("at"), F.col("x").cast("array<double>").alias("v")), n).withColumnRenamed("y", "m"))
    wide = rows.select(F.size("x")).first()[0]
    mean = _sums(blocks, lambda m: m.sum(0), m=wide) / n

    def times(x: DataFrame, width: int) -> DataFrame:
        both = blocks.join(x, "p")

        def totals(m: np.ndarray, v: np.ndarray) -> np.ndarray:
            m = m - mean
            return np.concatenate([np.stack([v.sum(0), ((m * m).sum(1)[:, None] * v).sum(0)]), m.T @ v]).ravel()

        one, square, *inner = _sums(both, totals, m=wide, x=width).reshape(-1, width)

        def product(m: np.ndarray, v: np.ndarray) -> np.ndarray:
            m = m - mean
            return m @ np.stack(inner) - ((m * m).sum(1)[:, None] * one + square) / 2

        return _each(both, "y", product, m=wide, x=width)

    return _scaled(leading(times, n, dim, True, tol=tol, seed=seed, spark=rows.sparkSession), dim)


def _scaled(found: Leading, dim: int) -> DataFrame:
    scale = np.sqrt(np.maximum(found.values, 0))
    y = cut(each_row(_each(found.blocks, "v", lambda v: v * scale, v=dim), "v", dim))
    sign = _signs(y, "at", "v", dim)
    return y.select(F.col("at").alias("id"), F.array(*[F.col("v")[k] * float(sign[k]) for k in range(dim)]).alias("y"))
