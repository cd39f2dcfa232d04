"""Vectors as short codes: one codebook for each part of the dimensions, in integers, so that results do not depend on partitions.

Every component becomes floor(scale * x). A vector is cut into equal parts, and each part is replaced by the number of its nearest codebook
entry. Codebooks start as the parts of the smallest ids and move to floored means a few times. Entries are searched by partial distances:
dimensions in descending order of the codebook's variance, and a pair of row and entry is dropped as soon as what it has gathered strictly
exceeds the row's best complete distance. Only codebooks (parts * entries * width numbers) and their partial sums leave the tasks; vectors are
never shuffled.

Defined results: rows whose vector is null, empty or holds null, NaN or infinite components are dropped; ties go to the lower entry; of rows
with one id the one with the smaller components comes first among the codebook's starts, and null ids come last; repeated rows get equal
codes, and each of them counts in means and in sums by label; with fewer rows than entries there are fewer entries; an entry that no part is
nearest to stays; an empty table gives an empty table; null labels are one label; other columns are not read. Vectors of unequal length, a
length that the parts do not divide, and integers beyond 2^26 (whose squares would not fit) are a ValueError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.tables import cut, join_hot

LARGEST = 1 << 26
ROWS = 4096  # searched at once


@dataclass(frozen=True)
class Coding:
    parts: int = 16
    entries: int = 64
    rounds: int = 2
    scale: int = 256
    block: int = 16  # entries that are compared with one best distance before it is brought up to date


def kept(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Rows whose vector is there and finite."""
    x = F.col(vec_col).cast("array<double>")
    return df.where((F.size(x) > 0) & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))))


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of (rows, dims)."""
    v = np.floor(x.astype(np.float64) * scale)
    if v.size and np.abs(v).max() > LARGEST:
        raise ValueError(f"components beyond {LARGEST} / {scale} are too large to code")
    return v.astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray, block: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each row of x: exact, ties to the lower entry."""
    order = np.argsort(-book.var(0), kind="stable")
    x, book = x[:, order], book[:, order]
    # a first complete distance: to the entry next to the row in the leading dimension
    lead = np.argsort(book[:, 0], kind="stable")
    entry = lead[np.minimum(np.searchsorted(book[lead, 0], x[:, 0]), len(book) - 1)]
    best = ((x - book[entry]) ** 2).sum(1)
    for low in range(0, len(book), block):
        part = book[low : low + block]
        so_far = (x[:, :1] - part[:, 0]) ** 2
        row, own = np.nonzero(so_far <= best[:, None])
        so_far = so_far[row, own]
        for d in range(1, x.shape[1]):
            so_far = so_far + (x[row, d] - part[own, d]) ** 2
            on = so_far <= best[row]
            row, own, so_far = row[on], own[on], so_far[on]
        own = own + low
        rank = np.lexsort((own, so_far, row))
        row, own, so_far = row[rank], own[rank], so_far[rank]
        first = np.flatnonzero(np.diff(row, prepend=-1))
        row, own, so_far = row[first], own[first], so_far[first]
        better = (so_far < best[row]) | (own < entry[row])
        best[row[better]], entry[row[better]] = so_far[better], own[better]
    return entry, best


class Codebooks:
    """(parts, entries, width) integers."""

    def __init__(self, books: np.ndarray, coding: Coding):
        self.books, self.coding = books, coding

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, parts) entries and distances."""
        parts, _, width = self.books.shape
        if x.shape[1] != parts * width:
            raise ValueError(f"a vector has {x.shape[1]} components, the codebooks are for {parts * width}")
        both = [nearest(x[:, p * width : (p + 1) * width], self.books[p], self.coding.block) for p in range(parts)]
        return np.stack([b[0] for b in both], 1), np.stack([b[1] for b in both], 1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """(rows, dims) integers that the codes stand for."""
        return self.books[np.arange(len(self.books)), codes].reshape(len(codes), -1)


def _matrix(column: pa.Array, scale: int) -> np.ndarray:
    sizes = np.unique(np.diff(np.asarray(column.offsets)))
    if len(sizes) > 1:
        raise ValueError("vectors have unequal lengths")
    return integers(np.asarray(column.flatten()).reshape(len(column), -1), scale)


def fit(df: DataFrame, coding: Coding = Coding(), id_col: str = "vec_id", vec_col: str = "embedding") -> Codebooks | None:
    """Codebooks after `rounds` passes over all rows; None if no row is left."""
    rows = kept(df, vec_col).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("x"))
    few = rows.orderBy(F.col("id").asc_nulls_last(), "x").limit(coding.entries).collect()  # `entries` rows
    if not few:
        return None
    if len({len(r.x) for r in few}) > 1 or len(few[0].x) % coding.parts:
        raise ValueError(f"vectors must have one length that {coding.parts} parts divide")
    start = integers(np.array([r.x for r in few]), coding.scale)
    books = np.ascontiguousarray(start.reshape(len(few), coding.parts, -1).transpose(1, 0, 2))
    width, cells = books.shape[2], coding.parts * len(few)
    for _ in range(coding.rounds):
        known = df.sparkSession.sparkContext.broadcast(Codebooks(books, coding))

        def sums(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros((cells, width), np.int64), np.zeros(cells, np.int64)
            for b in batches:
                for low in range(0, b.num_rows, ROWS):
                    x = _matrix(b.column(0)[low : low + ROWS], coding.scale)
                    cell = (known.value.assign(x)[0] + np.arange(coding.parts) * (cells // coding.parts)).ravel()
                    np.add.at(total, cell, x.reshape(-1, width))
                    count += np.bincount(cell, minlength=cells)
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, width)), pa.array(np.tile(np.arange(width), len(used))), pa.array(total[used].ravel()), pa.array(np.repeat(count[used], width))], names=["cell", "at", "total", "n"])

        parts = rows.select("x").mapInArrow(sums, "cell long, at long, total long, n long")
        moved = parts.groupBy("cell", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toPandas()  # cells * width rows at most
        flat = books.reshape(cells, width).copy()
        flat[moved["cell"], moved["at"]] = moved["total"].to_numpy() // moved["n"].to_numpy()
        books = flat.reshape(books.shape)
    return Codebooks(books, coding)


def encode(df: DataFrame, books: Codebooks, id_col: str = "vec_id", vec_col: str = "embedding", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, code, error) and the carried columns: code has two hex digits a part, error is the sum of squared integer distances."""
    known = df.sparkSession.sparkContext.broadcast(books)
    taken = kept(df, vec_col).select(F.struct(F.col(id_col).alias("id"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(carry)]).alias("row"), F.col(vec_col).cast("array<double>").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, ROWS):
                own = b.slice(low, ROWS)
                code, error = known.value.assign(_matrix(own.column(1), known.value.coding.scale))
                text = [bytes(c).hex() for c in code.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(text, pa.string()), pa.array(error.sum(1))], names=["row", "code", "error"])

    kind = taken.schema["row"].dataType.simpleString()
    out = taken.mapInArrow(run, f"row {kind}, code string, error long")
    return out.select(F.col("row.id").alias(id_col), "code", "error", *[F.col(f"row.c{k}").alias(c) for k, c in enumerate(carry)])


def digest(df: DataFrame, coding: Coding = Coding()) -> DataFrame:
    """The contract's columns."""
    books = fit(df, coding)
    if books is None:
        kind = dict(df.dtypes)["vec_id"]
        return df.sparkSession.createDataFrame([], f"vec_id {kind}, code string, error long, label_error long, codebooks_sha256 string")
    coded = encode(df, books, carry=("label",))
    coded = cut(coded.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))))
    by_label = cut(coded.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows")))
    return join_hot(coded, by_label, "key", "rows").select("vec_id", "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))
