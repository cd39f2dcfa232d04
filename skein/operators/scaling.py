"""Numeric columns, scaling, and principal components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODES = ("none", "z", "maxabs", "range", "colrange")
TINY = 2.2250738585072014e-308


def numeric_columns(df: DataFrame, skip: tuple[str, ...] = ()) -> list[str]:
    """Names of the numeric columns; others are left out, as in a numeric block."""
    found = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]
    if not found:
        raise ValueError("the table has no numeric columns")
    return found


def fit_scale(df: DataFrame, cols: list[str], mode: str) -> dict:
    """One aggregate over the columns (two for maxabs and z); the result scales any table with them."""
    if mode not in MODES:
        raise ValueError(f"scale must be one of {MODES}")
    if mode == "none":
        return {"mode": mode, "cols": list(cols)}
    d = lambda c: F.col(c).cast("double")
    one = df.agg(*[f(d(c)).alias(f"{n}_{c}") for c in cols for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg), ("sd", F.stddev_samp))]).first()
    at = lambda n: {c: one[f"{n}_{c}"] for c in cols}
    low, high, mean, sd = at("min"), at("max"), at("avg"), at("sd")
    out = {"mode": mode, "cols": list(cols), "min": low, "max": high, "mean": mean, "sd": sd}
    if mode == "range":
        out |= {"low": min(low.values()), "high": max(high.values())}
    if mode == "maxabs":
        out["top"] = max(max(abs(low[c] - mean[c]), abs(high[c] - mean[c])) for c in cols)
    if mode == "z":
        ss = df.agg(*[F.sum((d(c) - F.lit(mean[c])) ** 2).alias(c) for c in cols]).first()
        out["cols"] = [c for c in cols if ss[c] >= TINY]
    return out


def apply_scale(df: DataFrame, s: dict) -> DataFrame:
    """df with the columns scaled by what fit_scale found; columns that do not vary go in mode z."""
    d = lambda c: F.col(c).cast("double")
    how = {
        "none": lambda c: d(c),
        "z": lambda c: (d(c) - F.lit(s["mean"][c])) / F.lit(s["sd"][c]),
        "maxabs": lambda c: (d(c) - F.lit(s["mean"][c])) / F.lit(s["top"]),
        "range": lambda c: (d(c) - F.lit(s["low"])) / F.lit(s["high"] - s["low"]),
        "colrange": lambda c: F.try_divide(d(c) - F.lit(s["min"][c]), F.lit(s["max"][c] - s["min"][c])),
    }[s["mode"]]
    dropped = [c for c in s.get("mean", {}) if c not in s["cols"]]
    return df.drop(*dropped).withColumns({c: how(c) for c in s["cols"]})


def gram(df: DataFrame, col: str = "x") -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, sum of vectors, sum of outer products), from partial sums of partitions: d * d numbers each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, None, None
        for b in batches:
            if b.num_rows:
                m = np.asarray(b.column(0).flatten()).reshape(b.num_rows, -1)
                n += len(m)
                total = m.sum(0) + (0 if total is None else total)
                square = m.T @ m + (0 if square is None else square)
        if n:
            flat = np.concatenate([[n], total, square.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["k", "v"])

    parts = df.select(F.col(col).cast("array<double>").alias("x")).mapInArrow(run, "k long, v double")
    flat = parts.groupBy("k").agg(F.sum("v").alias("v")).toPandas().sort_values("k")["v"].to_numpy()
    d = int((np.sqrt(4 * len(flat) - 3) - 1) / 2)
    return int(flat[0]), flat[1 : d + 1], flat[d + 1 :].reshape(d, d)


def fit_pca(df: DataFrame, n_components: int, center: bool = True, col: str = "x") -> dict:
    """Rotation (d, p) and centre; the sign makes each component's largest loading positive."""
    n, total, square = gram(df, col)
    mean = total / n if center else np.zeros(len(total))
    value, vector = np.linalg.eigh((square - n * np.outer(mean, mean)) / max(1, n - 1))
    rotation = vector[:, ::-1][:, :n_components]
    rotation = rotation * np.sign(rotation[np.abs(rotation).argmax(0), np.arange(rotation.shape[1])])
    return {"center": mean, "rotation": rotation, "variance": value[::-1][:n_components], "total": float(value.sum())}


def apply_pca(df: DataFrame, model: dict, col: str = "x") -> DataFrame:
    """df with vectors in `col` projected; the rotation is d * p numbers."""
    center, rotation = model["center"], model["rotation"]

    @F.pandas_udf("array<double>")
    def project(x):
        import pandas as pd

        return pd.Series(list((np.stack(x.to_numpy()) - center) @ rotation)) if len(x) else pd.Series([], dtype=object)

    return df.withColumn(col, project(F.col(col).cast("array<double>")))
